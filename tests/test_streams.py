"""Usage and batch markers as two streams: the same as the table form, in whatever order files arrive."""

import itertools

import pytest
from pyspark.sql import functions as F

from tabulon.operators.evidence import usage_batches
from tabulon.streaming import usage as U

MARK, USE = "user string, at timestamp", "user string, event_id long, at timestamp, tokens double"


def tables(spark):
    day = "2024-01-0{} {:02d}:00:00"
    marks = [("a", day.format(1, 1)), ("a", day.format(1, 9)), ("b", day.format(1, 5)), ("c", day.format(2, 1)), ("a", day.format(2, 3))]
    uses = [("a", 1, day.format(1, 0), 1.0), ("a", 2, day.format(1, 1), 2.0), ("a", 3, day.format(1, 8), 3.0), ("a", 4, day.format(1, 9), 4.0), ("b", 5, day.format(1, 4), 5.0), ("b", 6, day.format(2, 6), 6.5), ("a", 7, day.format(2, 4), None), ("d", 8, day.format(1, 4), 9.0), ("a", 9, day.format(2, 1), 0.25)]
    # Far in the future, so that everything before is settled.
    marks += [("end", "2030-01-01 00:00:00")]
    uses += [("end", 100, "2030-01-01 00:00:00", 0.0)]
    as_frame = lambda rows, kind: spark.createDataFrame(rows, kind.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at"))
    return as_frame(marks, MARK), as_frame(uses, USE)


@pytest.mark.parametrize("backwards", list(itertools.product([False, True], [False, True])))
def test_streams_equal_the_table(spark, tmp_path, backwards):
    marks, uses = tables(spark)
    folders = []
    for name, df, turned in (("marks", marks, backwards[0]), ("uses", uses, backwards[1])):
        rows = df.where("user <> 'end'").orderBy("at").collect()
        for row in reversed(rows) if turned else rows:
            spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        df.where("user = 'end'").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        folders.append(str(tmp_path / name))
    read = lambda folder, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).parquet(folder)
    owned = U.own_batches(read(folders[0], MARK), read(folders[1], USE), "user", reach="30 days", late="5 days")
    query = owned.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out"))
    live = lambda df: df.where("user <> 'end'")
    got = sorted(map(tuple, U.batch_totals(live(marks), live(out), "user").collect()))
    assert got == sorted(map(tuple, usage_batches(live(marks), live(uses), "user").collect())) and len(got) == 5
    assert out.count() == len({r.event_id for r in out.collect()})
    table = U.own_batches(marks, uses, "user", reach="30 days")
    assert sorted(map(tuple, live(table).collect())) == sorted(map(tuple, live(out).select(table.columns).collect()))


def test_markers_out_of_reach_own_nothing(spark):
    marks, uses = tables(spark)
    got = {r.event_id: r.batch_at for r in U.own_batches(marks, uses, "user", reach="2 hours").collect()}
    assert sorted(got) == [2, 4, 7, 100] and U.own_batches(marks.limit(0), uses, "user").count() == 0
