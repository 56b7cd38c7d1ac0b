"""Stored tables, workbooks and changes: what is rewritten, what a failed write leaves, and which of several changes counts."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.operators import changes as C
from tabulon.operators import exports as X
from tabulon.sources import store as S
from tabulon.sources import tables as IO

TABLE = "table_id long, document_id long, table_index int, label string"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_an_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = spark.createDataFrame([(d * 10 + i, d, i, "old") for d in range(40) for i in range(2)], TABLE)
    assert len(S.upsert_tables(folder, first, partitions=16)) > 8
    before = files(folder)
    change = spark.createDataFrame([(999, 3, 0, "new"), (998, 3, 5, "more"), (997, 77, 0, "fresh")], TABLE)
    touched = S.upsert_tables(folder, change, partitions=16)
    after = files(folder)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if not any(f"{S.PARTITION}={p}/" in f for p in touched)}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert all(any(f"{S.PARTITION}={p}/" in f for p in touched) for f in set(after) - kept)
    want = Counter((d * 10 + i, d, i, "new" if (d, i) == (3, 0) else "old") for d in range(40) for i in range(2)) + Counter([(998, 3, 5, "more"), (997, 77, 0, "fresh")])
    assert rows(S.stored_tables(spark, folder, TABLE)) == want
    # Once more: the same rows.
    S.upsert_tables(folder, change, partitions=16)
    assert rows(S.stored_tables(spark, folder, TABLE)) == want
    assert rows(S.stored_tables(spark, folder, TABLE, [3, 5], partitions=16)) == Counter({r: n for r, n in want.items() if r[1] in (3, 5)})
    assert S.upsert_tables(folder, change.limit(0), partitions=16) == []
    assert S.stored_tables(spark, str(tmp_path / "none"), TABLE).count() == 0


def test_a_failed_upsert_leaves_the_old_rows(spark, tmp_path):
    folder = str(tmp_path / "store")
    S.upsert_tables(folder, spark.createDataFrame([(1, 1, 0, "old")], TABLE))
    bad = spark.createDataFrame([(2, 1, 0, "x")], TABLE).withColumn("label", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        S.upsert_tables(folder, bad)
    assert rows(S.stored_tables(spark, folder, TABLE)) == Counter([(1, 1, 0, "old")])


def test_a_workbook_is_published_whole(spark, tmp_path):
    folder = str(tmp_path / "book")
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,), (3,)], "n int")
    with pytest.raises(ValueError):
        S.read_workbook(spark, folder)
    assert S.write_workbook({"Codebook": a, "Counts": b}, folder) == 1
    broken = b.withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        S.write_workbook({"Codebook": a.limit(0), "Counts": broken}, folder)
    book = S.read_workbook(spark, folder)
    assert list(book) == ["Codebook", "Counts"] and rows(book["Codebook"]) == rows(a) and rows(book["Counts"]) == rows(b)
    assert S.write_workbook({"Counts": b.limit(0)}, folder) == 2
    assert list(S.read_workbook(spark, folder)) == ["Counts"] and list(S.read_workbook(spark, folder, 1)) == ["Codebook", "Counts"]
    assert rows(S.workbook_manifest({"A": a, "B": b})) == Counter([(0, "A", 2, 1), (1, "B", 1, 2)])
    with pytest.raises(ValueError):
        S.write_workbook({}, folder)


def test_the_last_of_several_changes_counts(spark):
    # Columns named as the operators might name their own.
    df = spark.createDataFrame([(1, "a", "p", "q"), (2, "b", "p", "q")], "k int, v string, new_v string, change string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "z", 3), (1, "y", 2), (3, "n", 1), (3, None, 2)], "k int, v string, at int")
    assert rows(C.set_columns(df, changes, ["k"], ["v"], at="at")) == Counter([(1, "z", "p", "q"), (2, "b", "p", "q")])
    assert rows(C.upsert(df, changes, ["k"], at="at")) == Counter([(1, "z", "p", "q"), (2, "b", "p", "q"), (3, None, None, None)])
    assert rows(C.upsert(df, changes, ["k"], keep=["v"], at="at")) == Counter([(1, "a", "p", "q"), (2, "b", "p", "q"), (3, None, None, None)])
    reviewed = spark.createDataFrame([(1, 5, "decision", "old", "ai", "pending", False, "mine", "no")], "candidate_id int, run_id int, kind string, candidate_text string, source string, status string, edited boolean, text string, action string")
    two = spark.createDataFrame([(1, "accept", " new ", 2), (1, "delete", None, 1)], "candidate_id int, action string, text string, at int")
    assert rows(C.review_candidates(reviewed, two, at="at")) == Counter([(1, 5, "decision", "new", "ai", "accepted", True, "mine", "no")])


def test_attributes_are_merged_and_deleted(spark):
    kind = "doc long, speaker string, attributes map<string,string>"
    old = spark.createDataFrame([(1, "a", {"age": "3", "sex": "f"}), (1, "b", {"age": "4"}), (2, "c", {"x": "y"})], kind)
    new = spark.createDataFrame([(1, "a", {"age": None, "town": "T"}), (1, "b", {"age": None}), (3, "d", {"k": "v", "n": None})], kind)
    got = {(r.doc, r.speaker): r.attributes for r in C.merge_attributes(old, new).collect()}
    assert got == {(1, "a"): {"sex": "f", "town": "T"}, (2, "c"): {"x": "y"}, (3, "d"): {"k": "v"}}


def test_calibration_starts_once_and_resets(spark):
    kind = "codebook_id long, segment_id long"
    samples = C.start_calibration(spark.createDataFrame([(1, 10)], kind), spark.createDataFrame([(1, 11), (2, 20), (2, 20)], kind))
    assert rows(samples) == Counter([(1, 10), (2, 20)])
    labels = spark.createDataFrame([(10, 100, True), (20, 200, False)], "segment_id long, code_id long, applies boolean")
    codes = spark.createDataFrame([(100, 1), (200, 2)], "code_id long, codebook_id long")
    left, marks = C.reset_calibration(samples, labels, codes, codes.where("codebook_id = 1"))
    assert rows(left) == Counter([(2, 20)]) and rows(marks) == Counter([(20, 200, False)])


def test_csv_keeps_breaks_and_quotes(spark, tmp_path):
    sheet = spark.createDataFrame([(1, 'say "hi", then\nleave'), (2, None), (3, "plain")], "k int, v string")
    X.write_csv(sheet.coalesce(1), str(tmp_path / "out"))
    text = "".join(open(os.path.join(d, f), newline="").read() for d, _, names in os.walk(tmp_path / "out") for f in names if f.endswith(".csv"))
    assert text.splitlines()[0] == '"k","v"' and '"say ""hi"", then\nleave"' in text
    back = IO.load_csv(spark, str(tmp_path / "out")).orderBy("__row").select("k", "v").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi", then\nleave'), (2, None), (3, "plain")]


def test_labelled_files(spark, tmp_path, monkeypatch):
    paths = {n: str(tmp_path / n) for n in ("data", "headers", "labels", "twice")}
    spark.createDataFrame([(1.0, "n", float("nan")), (2.0, None, 3.0)], "q1 double, q2 string, q3 double").write.parquet(paths["data"])
    spark.createDataFrame([("q1", "Sex"), ("q2", " "), ("gone", "Gone")], "raw string, label string").write.parquet(paths["headers"])
    spark.createDataFrame([("q1", "1", "f"), ("q1", "2", "m")], "column string, code string, label string").write.parquet(paths["labels"])
    got = IO.load_labelled(spark, paths["data"], paths["headers"], paths["labels"])
    assert got.columns == ["Sex", "q2", "q3"] and rows(got) == Counter([("f", "n", None), ("m", None, 3.0)])
    spark.createDataFrame([("q1", "Sex"), ("q1", "Gender")], "raw string, label string").write.parquet(paths["twice"])
    with pytest.raises(ValueError, match="more than one label"):
        IO.load_labelled(spark, paths["data"], paths["twice"], paths["labels"])
    monkeypatch.setattr(IO, "MOST_COLUMNS", 2)
    with pytest.raises(ValueError, match="more than 2 columns"):
        IO.load_labelled(spark, paths["data"], paths["headers"], paths["labels"])


def test_a_tenant_sees_its_rows(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int").write.parquet(str(tmp_path / "t"))
    assert rows(IO.load(spark, str(tmp_path / "t"), "a")) == Counter([("a", 1)])
    plan = IO.load(spark, str(tmp_path / "t"), "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant_id,a)" in plan
