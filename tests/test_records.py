import csv
import io
import random

import pytest

from claimlens.sources import records as R
from claimlens.sources import tables as T


def _text(rng):
    some = ["a", "b c", ",", '"', '""', "\n", "\r\n", "\n\n", " ", "é", "x" * 50, "'"]
    return "".join(rng.choices(some, k=rng.randint(0, 12)))


def _write(path, header, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name, value in zip(names, ("200", "0")):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits, end):
    """Random quotes and line breaks, cut every 200 bytes, several column orders."""
    rng = random.Random(11)
    want = []
    orders = [["id", "text", "source_url"], ["source_url", "x,y", "text", "id"], ["text", "id", "source_url"]]
    for n, order in enumerate(orders):
        rows = [{"id": 100 * n + i, "text": _text(rng), "source_url": f"u{i}", "x,y": _text(rng)} for i in range(60)]
        # One value that covers many splits.
        rows[7]["text"] = 'long\n"' * 300
        want += [(r["id"], r["text"] or None, r["source_url"]) for r in rows]
        _write(tmp_path / f"{n}.csv", order, [[r[c] for c in order] for r in rows], end)
    lines = R._lines(spark, str(tmp_path))
    assert R._summaries(lines).count() > 60
    got = T.read_evidence_csv(spark, str(tmp_path), multi_line=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_states_of_splits_run_over_all_kinds(spark):
    rng = random.Random(12)
    rows = []
    for f in range(6):
        state = 0
        for at in range(40):
            to = rng.choice([(0, 1), (1, 0), (0, 0), (1, 1)])
            rows.append((f, at, *to, state))
            state = to[state]
    df = spark.createDataFrame(rows, "file long, at long, out_to int, in_to int, want int")
    assert R._starts(df).where("inside <> want").count() == 0


def test_lines_are_told_as_the_csv_module_reads_them():
    """A line ends inside quotes exactly when the record goes on in the next one."""
    rng = random.Random(13)
    for _ in range(4000):
        line = "".join(rng.choices(['"', '""', ",", "a", " "], k=rng.randint(0, 9)))
        for inside in (False, True):
            lead = ['"x\n'] if inside else []
            read = csv.reader([*lead, line + "\n", "END\n"])
            fields = next(read)
            goes_on = any("END" in f for f in fields) if line or inside else False
            assert R.ends_inside(line, inside) == goes_on, (line, inside)


def test_stray_quotes_and_nulls(spark, tmp_path):
    body = 'text,source_url\n5" pipe,"u"x\n"",\n,""\n\n"a ""q"" b",v'
    (tmp_path / "f.csv").write_text(body)
    got = R.read_records(spark, str(tmp_path), ["text", "source_url"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([('5" pipe', "ux"), ("", None), (None, ""), ('a "q" b', "v")], key=str)


def test_bad_files_are_errors(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    _write(a, ["text", "source_url"], [["x", "u"]])
    _write(b, ["text", "source_url", "id"], [["x", "u", 1]])
    with pytest.raises(ValueError, match="id"):
        T.read_evidence_csv(spark, [str(a), str(b)], multi_line=True)
    with pytest.raises(ValueError, match="statement"):
        T.read_claims_csv(spark, str(a), multi_line=True)
    a.write_text("text,source_url\nx\n")
    with pytest.raises(Exception, match="a record of 1 values under a header of 2"):
        T.read_evidence_csv(spark, str(a), multi_line=True).collect()


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,source_url\n")
    (tmp_path / "b.csv").write_text("")
    assert R.read_records(spark, str(tmp_path), ["text", "source_url"]).collect() == []


def test_other_splits_are_noticed(spark, tmp_path):
    _write(tmp_path / "a.csv", ["text", "source_url"], [["x" * 90, "u"]] * 20)
    df = R.read_records(spark, str(tmp_path), ["text", "source_url"])
    assert df.count() == 20
    for name, value in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(name, value)
    try:
        with pytest.raises(Exception, match="splits of the files have changed"):
            df.select("*", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_written_values_come_back(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, rng.choice([None, "", " lead", "trail ", '"', "a\\", _text(rng)]), f"s,{i}") for i in range(200)]
    T.write_csv(spark.createDataFrame(rows, "id long, text string, source_url string"), str(tmp_path / "w"))
    got = T.read_evidence_csv(spark, str(tmp_path / "w"), multi_line=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_values_of_keeps_what_the_module_keeps():
    text = 'a,"b\nc",\n"",x,y\n'
    assert list(R.values_of(text.split("\n"))) == [["a", "b\nc", None], ["", "x", "y"]]
    assert list(csv.reader(io.StringIO(text)))[0] == ["a", "b\nc", ""]
