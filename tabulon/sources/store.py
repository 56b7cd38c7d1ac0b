"""Tables kept in folders: an upsert that rewrites touched partitions only, and workbooks published whole by a manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tabulon.operators.changes import upsert
from tabulon.plans.lineage import cut

#: Partitions of a table store and the column that names them; an upsert rewrites those that its documents fall into.
PARTITIONS, PARTITION = 256, "store_part"
#: Columns of a workbook's manifest.
MANIFEST = "version long, place int, sheet string, rows long, folder string"


def read_folder(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """A folder of Parquet files, of no rows while it doesn't exist."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _part(document: str, partitions: int) -> Column:
    return F.pmod(F.xxhash64(F.col(document).cast("string")), F.lit(partitions)).cast("int")


def upsert_tables(folder: str, tables: DataFrame, keys: tuple[str, ...] = ("document_id", "table_index"), keep: tuple[str, ...] = ("table_id",), at: str | None = None, partitions: int = PARTITIONS) -> list[int]:
    """Rows of ``tables`` written over those of their keys in a store, others kept; returns the partitions that were rewritten.

    The store is dealt by a hash of the first key, the document.  Only the
    partitions of documents that ``tables`` has are read, merged and replaced, so
    an upsert costs what it touches.  Columns in ``keep``, such as a table's id,
    keep a value that is there; of several rows of one key the last by ``at``
    counts.  Tables that a document no longer has stay.  The same upsert again
    leaves the store as it is, and one that fails leaves the old files.
    """
    spark = tables.sparkSession
    due = cut(tables.withColumn(PARTITION, _part(keys[0], partitions)))
    # At most ``partitions`` numbers.
    touched = sorted(r[0] for r in due.select(PARTITION).distinct().collect())
    if not touched:
        return []
    old = read_folder(spark, folder, due.schema).where(F.col(PARTITION).isin(touched))
    merged = upsert(old, due, [*keys, PARTITION], keep=list(keep), at=at)
    # Written in full before the old files go; one task a partition.
    merged = cut(merged.repartition(PARTITION))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(folder)
    return touched


def stored_tables(spark: SparkSession, folder: str, schema: str, documents: list | None = None, document: str = "document_id", partitions: int = PARTITIONS) -> DataFrame:
    """The rows of a store, of some documents if they are named, for which only their partitions are read."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = read_folder(spark, folder, StructType([*kind.fields]).add(PARTITION, IntegerType()))
    if documents is not None:
        named = spark.createDataFrame([(d,) for d in documents], StructType([kind[document]]))
        parts = [r[0] for r in named.select(_part(document, partitions)).distinct().collect()]
        rows = rows.where(F.col(PARTITION).isin(parts) & F.col(document).isin(documents))
    return rows.drop(PARTITION)


def write_workbook(sheets: dict[str, DataFrame], folder: str) -> int:
    """All sheets as one version of a workbook, published by its manifest, which is written last; returns the version.

    Sheets go to a folder of their own, so a write that fails leaves the version
    before as it was; what it staged is never read.
    """
    if not sheets:
        raise ValueError("a workbook has at least one sheet")
    spark = next(iter(sheets.values())).sparkSession
    version = (read_folder(spark, f"{folder}/manifest", MANIFEST).agg(F.max("version")).first()[0] or 0) + 1
    staged, rows = f"{folder}/v{version}-{uuid.uuid4().hex}", []
    for place, (name, sheet) in enumerate(sheets.items()):
        sheet.write.parquet(f"{staged}/{place}")
        rows.append((version, place, name, spark.read.schema(sheet.schema).parquet(f"{staged}/{place}").count(), f"{staged}/{place}"))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def read_workbook(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The sheets of a version, the last one published if none is named, in order."""
    manifest = read_folder(spark, f"{folder}/manifest", MANIFEST)
    wanted = version or manifest.agg(F.max("version")).first()[0]
    rows = manifest.where(F.col("version") == wanted).orderBy("place").collect() if wanted else []
    if not rows:
        raise ValueError(f"{folder} has no workbook" + (f" of version {version}" if version else ""))
    return {r["sheet"]: spark.read.parquet(r["folder"]) for r in rows}


def workbook_manifest(sheets: dict[str, DataFrame]) -> DataFrame:
    """(place, sheet, columns, rows) of sheets in order, without writing them."""
    parts = [s.agg(F.lit(i).alias("place"), F.lit(n).alias("sheet"), F.lit(len(s.columns)).alias("columns"), F.count(F.lit(1)).alias("rows")) for i, (n, s) in enumerate(sheets.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
