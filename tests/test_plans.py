"""What the physical plans must look like at any scale."""

from claimlens.operators.encode import Lexicon, bucket_weights, lexicon
from claimlens.operators.knn import knn_join
from claimlens.plans.queries import QUERIES
from claimlens.session import durable

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_in_retrieval(spark):
    text = plan(QUERIES["retrieve"](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_knn_prunes_before_the_shuffle_and_leaves_items_in_place(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    text = plan(knn_join(vecs, vecs, 6, "vec_id", "vec_id"))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange hashpartitioning") == 1
    assert "label" not in text  # only the id and the vector are read


def test_encoder_tokenises_once_and_sums_before_the_exchange(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lex = lexicon(docs, "doc_id", "text")
    text = plan(bucket_weights(docs, "doc_id", "text", Lexicon(durable(lex.df), lex.n_docs)))
    assert text.count("REPARTITION_BY_COL") == 1
    # The tree is printed with the exchange above the task that sums, and the text is split once.
    assert text.index("REPARTITION_BY_COL") < text.index("MapInArrow")
    assert text.count("split(lower(") == text.count("MapInArrow") == 1


def test_history_takes_the_newest_without_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["recent_history"](spark, SF))
