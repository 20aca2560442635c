"""Evidence, claim, vector and history tables: readers and writers with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from claimlens import schemas as S
from claimlens.functions import text as X
from claimlens.operators import retrieve as R
from claimlens.operators.encode import Lexicon
from claimlens.operators.ledger import recent_history
from claimlens.operators.lexical import TermIndex
from claimlens.operators.postings import read_index, write_index
from claimlens.sources.records import read_records

# Three rows to try the reader and the corpus with.
DEMO_EVIDENCE = [
    (0, "Water boils at a lower temperature on high mountains.", "https://example.org/boiling"),
    (1, "Honey that is kept dry and closed stays edible for years.", "https://example.org/honey"),
    (2, "The tides of the sea follow the moon and the sun.", "https://example.org/tides"),
]


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files with one common header and one line each; a file with another header,
    or a value that does not fit its column, is an error."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header each, quotes doubled, nulls empty and empty strings quoted."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _column_order(names: list[str], types: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])


def read_evidence_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """evidence(evidence_id, text, source_url) from CSV.

    With `multi_line` values may hold line breaks and each file may order its columns in
    its own way; files are split among tasks all the same. Without an `id` column the id is
    derived from the row's content, which is the same on every read and needs no global
    numbering; equal rows share it and are kept apart by a counter.
    """
    if multi_line:
        df = read_records(spark, path, ["text", "source_url"], ["id"])
    else:
        names = _csv_header(spark, path)
        _require(names, ("text", "source_url"), path)
        df = _read_csv(spark, path, _column_order(names, {"id": T.LongType()}))
    if "id" in df.columns:
        return df.select(F.col("id").cast("long").alias("evidence_id"), "text", "source_url")
    return with_content_id(df.select("text", "source_url"), "evidence_id")


def with_content_id(df: DataFrame, name: str) -> DataFrame:
    """Stable LONG ids for rows without one: content hash, then a counter for copies.

    Copies are numbered within (hash, task) and then shifted by the copies of the
    tasks before, so no group of copies is pulled into one task.
    """
    cols = df.columns
    keyed = df.withColumn("_h", F.xxhash64(*cols)).withColumn("_p", F.spark_partition_id())
    keyed = keyed.withColumn("_m", F.monotonically_increasing_id())
    counts = keyed.groupBy("_h", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    shift = counts.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(
                W.partitionBy("_h").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).select("_h", "_p", "_before")
    ordinal = F.row_number().over(W.partitionBy("_h", "_p").orderBy("_m")) - 1
    numbered = keyed.withColumn("_i", ordinal).join(shift, ["_h", "_p"])
    copy = F.col("_before") + F.col("_i")
    new_id = F.when(copy == 0, F.col("_h")).otherwise(F.xxhash64("_h", copy))
    return numbered.select(new_id.alias(name), *cols)


def _require(names: list[str], wanted: tuple[str, ...], path: str) -> None:
    missing = [w for w in wanted if w not in names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")


def load_labeled_claims(
    raw: DataFrame, rules=X.LABEL_RULES, null_as_text: bool = False
) -> DataFrame:
    """claims_labeled(text, label, source) from (label, statement, source).

    Null and blank statements are dropped; with null_as_text a null becomes 'nan'.
    """
    _require(raw.columns, ("label", "statement", "source"), "labelled claims")
    statement = F.col("statement")
    if null_as_text:
        statement = F.coalesce(statement, F.lit("nan"))
    out = raw.select(
        X.clean_text(statement).alias("text"),
        X.normalize_label(F.col("label"), rules).alias("label"),
        "source",
    )
    return out if null_as_text else out.where("text is not null and text <> ''")


def read_claims_csv(
    spark: SparkSession, path: str, multi_line: bool = False, **options
) -> DataFrame:
    if multi_line:
        return load_labeled_claims(read_records(spark, path, ["label", "statement", "source"]), **options)
    names = _csv_header(spark, path)
    _require(names, ("label", "statement", "source"), path)
    return load_labeled_claims(_read_csv(spark, path, _column_order(names, {})), **options)


def write_demo_evidence(spark: SparkSession, path: str) -> None:
    write_csv(spark.createDataFrame(DEMO_EVIDENCE, "id long, text string, source_url string"), path)


def write_vectors(
    evidence: DataFrame, vectors: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    """One parquet table with the evidence and its vectors; append to extend it."""
    joined = evidence.join(vectors, "evidence_id")
    joined.select("evidence_id", "text", "source_url", "embedding").write.mode(mode).parquet(path)


def write_by_id(evidence: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Store evidence as the table `name`, in files by a hash of its id, sorted by id.

    Hits that are joined to it by id move; the texts do not, however many hits there are.
    """
    (
        evidence.select("evidence_id", "text", "source_url")
        .repartition(buckets, "evidence_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "evidence_id")
        .sortBy("evidence_id")
        .option("path", path)
        .saveAsTable(name)
    )


def write_corpus(corpus: R.Corpus, path: str) -> None:
    """Persist a whole index: evidence with vectors, words, and the keyword sources, large ones
    with their posting lists."""
    write_vectors(corpus.evidence, corpus.vectors, f"{path}/evidence")
    if corpus.lex is not None:
        corpus.lex.df.write.mode("overwrite").parquet(f"{path}/words")
    for rank, _, source in corpus.sources():
        table = source.items.join(
            source.vectors.select("item_id", "embedding"), "item_id", "left"
        ).join(source.index.terms.withColumnRenamed("id", "item_id"), "item_id", "left")
        table.write.mode("overwrite").parquet(f"{path}/source-{rank}")
        source.index.lex.df.write.mode("overwrite").parquet(f"{path}/source-{rank}-words")
        if source.index.lex.n_docs >= R.INDEX_ARTICLES:
            stored = table.sparkSession.read.parquet(f"{path}/source-{rank}")
            write_index(stored.select(F.col("item_id").alias("id"), "terms"), f"{path}/source-{rank}-index")


def read_corpus(
    spark: SparkSession, path: str, encoder: R.EncoderOf | None = None
) -> R.Corpus:
    """An index written by `write_corpus`; a keyword source that is absent is off.

    A corpus built with a plugged-in encoder needs the same one to encode claims.
    """

    def lexicon(words: str, table: DataFrame) -> Lexicon:
        df = spark.read.schema("token string, df long").parquet(f"{path}/{words}")
        return Lexicon(df, table.count())

    def source(rank: int) -> R.Source | None:
        try:
            table = spark.read.parquet(f"{path}/source-{rank}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        terms = table.select(F.col("item_id").alias("id"), "terms")
        words = lexicon(f"source-{rank}-words", table)
        return R.Source(
            table.select("item_id", "source", "text"),
            TermIndex(terms, words),
            table.select("item_id", "embedding"),
            stored=read_index(spark, f"{path}/source-{rank}-index") if words.n_docs >= R.INDEX_ARTICLES else None,
        )

    evidence = read_vectors(spark, f"{path}/evidence")
    return R.Corpus(
        evidence.select("evidence_id", "text", "source_url"),
        evidence.select("evidence_id", "embedding"),
        lexicon("words", evidence) if encoder is None else None,
        source(R.ENCYCLOPAEDIA),
        source(R.NEWS),
        encoder,
    )


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, or no rows with its schema when there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, S.VECTORS)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, S.HISTORY)


def append_history(rows: DataFrame, path: str) -> None:
    """Add the rows of whole batches, in a folder by batch; a batch that is written again replaces itself."""
    (
        rows.repartition("seq")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("seq")
        .parquet(path)
    )


def read_recent(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The last n entries of a stored history, newest first.

    Batches are looked at from the newest one back, twice as many each time, until they hold
    n entries; only their folders are read, and for counting no column of them.
    """
    history = read_history(spark, path)
    newest, oldest = history.agg(F.max("seq"), F.min("seq")).first()
    back = 1
    while newest is not None:
        some = history.where(F.col("seq") > newest - back)
        if newest - back < oldest or some.count() >= n:
            return recent_history(some, n=n)
        back *= 2
    return history
