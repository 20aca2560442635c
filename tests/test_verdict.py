from pyspark.sql import functions as F

from claimlens.functions import verdict as V

OUTPUTS = [
    ('{"label":"Fake","confidence":0.9,"explanation":"e"}', "Fake", 0.9),
    ('{"label":"Fake","confidence":"0.8"}', "Fake", 0.8),
    ("{}", "Uncertain", 0.6),
    ('{"confidence":null}', "Uncertain", 0.5),
    ('{"confidence":"high"}', "Uncertain", 0.5),
    ('{"confidence":true}', "Uncertain", 1.0),
    ('{"confidence":"true"}', "Uncertain", 0.5),
    ('{"label":null,"confidence":0.7}', None, 0.7),
    ('{"label":"True"', "Uncertain", 0.5),
    ('{"label":"True"} junk', "Uncertain", 0.5),
    ("{'label':'x'}", "Uncertain", 0.5),
    ('{"label":"A","label":"B"}', "B", 0.6),
    ('{"reasoning":["a","b"]}', "Uncertain", 0.6),
    (' \n{"label":"True"}\n ', "True", 0.6),
    ('{"label":"A"}{"label":"B"}', "Uncertain", 0.5),
    ('{"label":"A"} {"label":"B"}', "Uncertain", 0.5),
    ('{"a":{"confidence": true},"confidence":"true"}', "Uncertain", 0.5),
    ('{"label":"A","confidence":"true","b":{"confidence": true}}', "Uncertain", 0.5),
    ('{"confidence":1e400}', "Uncertain", float("inf")),
    ('{"confidence":-Infinity}', "Uncertain", float("-inf")),
    ('{"confidence":"１"}', "Uncertain", 1.0),
    ('{"confidence":" 1_0.5 "}', "Uncertain", 10.5),
    ('{"label":"A","confidence":[0.5]}', "Uncertain", 0.5),
    ('{"label":7,"confidence":false}', "7", 0.0),
    ('\u00a0{"label":"A"}', "Uncertain", 0.5),
    ('{"label":"' + "a" * 100_000 + '"}', "a" * 100_000, 0.6),
    ("{" + '"a":[' * 100_000, "Uncertain", 0.5),
    ("This is not true.", "Fake", 0.8),
    ("It is FALSE", "Fake", 0.8),
    ("That is true", "True", 0.8),
    ("Fake", "Uncertain", 0.5),
    ("[1]", "Uncertain", 0.5),
    ("", "Uncertain", 0.5),
]


def test_parse_output(spark):
    df = spark.createDataFrame(
        [(i, t) for i, (t, _, _) in enumerate(OUTPUTS)], "i int, raw_output string"
    )
    rows = V.with_parsed_output(df).orderBy("i").collect()
    assert [(r.verdict.label, r.verdict.confidence) for r in rows] == [o[1:] for o in OUTPUTS]
    by_text = {r.raw_output: r.verdict for r in rows}
    assert by_text["{}"].explanation == "" and by_text["{}"].reasoning == []
    assert by_text['{"confidence":null}'].explanation == '{"confidence":null}'
    assert by_text['{"reasoning":["a","b"]}'].reasoning == ["a", "b"]


def test_json_values_that_are_no_text(spark):
    texts = ['{"confidence":NaN}', '{"reasoning":"abc"}', '{"reasoning":null}', '{"reasoning":[1,"b",null,{"c":[2]}]}']
    texts += ['{"explanation":"\\ud800x","counterfactual":{"a":1}}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_output string")
    got = [r.verdict for r in V.with_parsed_output(df).orderBy("i").collect()]
    assert got[0].confidence != got[0].confidence and got[0].label == "Uncertain"
    assert [v.reasoning for v in got[1:4]] == [["abc"], None, ["1", "b", None, '{"c":[2]}']]
    assert (got[4].explanation, got[4].counterfactual, got[5]) == ("?x", '{"a":1}', None)


RULES = [
    ("Widely debunked.", "any", "Fake", 0.95),
    ("a falsehood", "any", "Fake", 0.95),
    ("Scientific consensus holds", "X is flat", "Fake", 0.95),
    ("Scientific consensus holds", "X is round", "True", 0.95),
    ("Scientific consensus confirms it", "X is flat", "Fake", 0.95),
    ("tests confirm it", "any", "True", 0.9),
    ("there is no evidence", "any", "Uncertain", 0.6),
    ("confirmed hoax", "any", "Fake", 0.95),
    ("", "any", "True", 0.95),
]


def test_evidence_rules(spark):
    rows = [(i, e, c) for i, (e, c, _, _) in enumerate(RULES)]
    df = spark.createDataFrame(rows, "i int, e string, claim string").select(
        "i",
        "claim",
        F.filter(F.array("e"), lambda t: t != "").alias("texts"),
        F.lit('{"label":"True","confidence":0.95,"explanation":"x"}').alias("raw_output"),
    )
    out = V.with_evidence_rules(V.with_parsed_output(df), "verdict", "claim", "texts")
    got = [r.verdict for r in out.orderBy("i").collect()]
    assert [(v.label, v.confidence) for v in got] == [r[2:] for r in RULES]
    assert got[2].explanation == V.CONSENSUS_EXPLANATION
    assert got[5].explanation == "x" and got[0].explanation == V.REFUTED_EXPLANATION


def test_prompt_shows_five_texts_and_rules_read_six(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c", "d", "e", "hoax"], "claim", '{"label":"True"}')],
        "texts array<string>, claim string, raw_output string",
    )
    row = V.with_evidence_rules(V.with_parsed_output(df), "verdict", "claim", "texts").select(
        "verdict", V.prompt(F.col("claim"), F.col("texts")).alias("p")
    ).first()
    assert row.verdict.label == "Fake"
    assert "\na b c d e\n" in row.p and "hoax" not in row.p
    empty = df.select(V.prompt(F.col("claim"), F.array().cast("array<string>"))).first()[0]
    assert V.NO_EVIDENCE in empty


def test_param_defaults(spark):
    df = spark.createDataFrame([({"temperature": 0.1},), (None,)], "p map<string,double>")
    rows = df.select(*[c.alias(n) for n, c in V.resolved_params(F.col("p")).items()]).collect()
    assert rows[0].asDict() == {**V.PARAM_DEFAULTS, "temperature": 0.1}
    assert rows[1].asDict() == V.PARAM_DEFAULTS


def test_evaluated_label(spark):
    df = spark.createDataFrame(
        [
            ("A", "B", "fake"),
            (None, "B", "fake"),
            (None, None, "fake but true"),
            (None, None, "True"),
            (None, None, "x"),
            (None, None, None),
        ],
        "label string, predicted string, raw string",
    )
    got = df.select(V.evaluated_label(F.col("label"), F.col("predicted"), F.col("raw"))).collect()
    assert [r[0] for r in got] == ["A", "B", "Fake", "True", "Uncertain", "Uncertain"]
