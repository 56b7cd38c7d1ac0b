"""Loading tables with an ingest ordinal and a tenant filter, and cleaning their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import is_missing

#: Value labels and columns that a statistics file may have; more are an error.
MOST_LABELS, MOST_COLUMNS = 100_000, 100_000


def load(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    """Parquet table, filtered to one tenant where it has the column; the filter reaches the scan."""
    df = spark.read.parquet(path)
    return df.where(F.col("tenant_id") == tenant) if tenant is not None and "tenant_id" in df.columns else df


def load_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """CSV of RFC 4180 with a header, types inferred, empty cells null, and ``__row``: the file and the place in it, whose order is that of ingest.

    Cells may be quoted and hold line breaks and doubled quotes, so a file is read
    by one task; files are read side by side and ordered by name.  Rows of fewer
    cells than the header end in nulls.
    """
    df = spark.read.csv(path, header=header, inferSchema=True, nullValue="", multiLine=True, quote='"', escape='"')
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("__row"))


def load_labelled(spark: SparkSession, data: str, headers: str, labels: str) -> DataFrame:
    """A statistics file unpacked to Parquet: codes, (raw, label) headers and (column, code, label) values, as one labelled table.

    Headers name columns of one file: more than MOST_COLUMNS, and two labels for
    one column, are an error; columns without one keep their name, and headers of
    columns that the file lacks don't count.
    """
    df = spark.read.parquet(data)
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    rows = spark.read.parquet(headers).where(F.col("raw").isin(df.columns)).select("raw", "label").distinct().limit(MOST_COLUMNS + 1).collect()
    names = {r["raw"]: r["label"] for r in rows}
    if len(names) < len(rows):
        raise ValueError("a column has more than one label")
    decoded = decode_labels(clean_cells(df), spark.read.parquet(labels))
    return decoded.toDF(*unique_headers(df.columns, [names.get(c) for c in df.columns]))


def unique_headers(raw: list[str], labels: list[str | None]) -> list[str]:
    """Labels as headers; a label that repeats gets its raw name behind it."""
    out: list[str] = []
    for name, label in zip(raw, labels, strict=True):
        head = (label or "").strip() or name
        out.append(head if head not in out else f"{head} ({name})")
    return out


def decode_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Codes of (column, code, label) replaced by their labels, where there is one; other cells stay.

    A code is looked up as it stands, then as a whole number.  Of repeated codes
    the least label counts.  Labels describe a file and are few: they are counted
    and become one map that rides along with the rows; more than MOST_LABELS are
    an error.
    """
    one = labels.where(F.col("column").isin(df.columns)).groupBy("column", F.col("code").cast("string").alias("code")).agg(F.min("label").alias("label"))
    rows = one.limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} value labels")
    by_column: dict[str, dict[str, str]] = {}
    for r in rows:
        by_column.setdefault(r["column"], {})[r["code"]] = r["label"]

    def decoded(c: str):
        named = F.create_map(*[F.lit(x) for kv in by_column[c].items() for x in kv])
        text = F.col(c).cast("string")
        return F.coalesce(F.try_element_at(named, text), F.try_element_at(named, F.col(c).try_cast("long").cast("string")), text).alias(c)

    return df.select([decoded(c) if c in by_column else F.col(c) for c in df.columns])


def records(rows: DataFrame) -> DataFrame:
    """Rows (table_id, row, headers, cells) as maps of header to cell; tables without headers and blank rows are dropped.

    Cells beyond the headers don't count, missing ones are null.
    """
    padded = F.transform("headers", lambda h, i: F.try_element_at("cells", (i + 1).cast("int")))
    full = rows.where(F.size("headers") > 0).withColumn("padded", padded).where(F.exists("padded", lambda c: c.isNotNull()))
    return full.select("table_id", "row", F.map_from_arrays("headers", "padded").alias("record"))


def page_batches(pages: DataFrame, size: int = 5) -> DataFrame:
    """(doc, batch, first, last, text): pages five at a time, each under its number; fixed values: the size and the page line."""
    placed = pages.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1) / size))
    line = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), "text")
    g = placed.groupBy("doc", "batch").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.sort_array(F.collect_list(F.struct("page", line.alias("t")))).alias("l"))
    return g.select("doc", "batch", "first", "last", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))


def register_uploads(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files with new ones (document_id, run_id, kind, ingestion_type, source_filename) added.

    Fixed values: the kinds, and raw or aggregated for tables only.  Uploads of
    another kind are left out; a table without a type is aggregated; ids that are
    there already stay as they are.
    """
    fine = new.where(F.col("kind").isin("report", "table", "evidence", "transcript"))
    kind = F.when(F.col("kind") == "table", F.when(F.col("ingestion_type") == "raw", "raw").otherwise("aggregated"))
    fresh = fine.withColumn("ingestion_type", kind).join(files.select("document_id"), "document_id", "left_anti").dropDuplicates(["document_id"])
    return files.unionByName(fresh.select(*[c for c in files.columns if c in fresh.columns]), allowMissingColumns=True)


def clean_cells(df: DataFrame) -> DataFrame:
    """NaN becomes null, dates and times become ISO text."""
    kinds = dict(df.dtypes)

    def one(c: str):
        if kinds[c] in ("double", "float"):
            return F.when(~F.isnan(c), F.col(c)).alias(c)
        if kinds[c] == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        if kinds[c].startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
        return F.col(c)

    return df.select([one(c) for c in df.columns])


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, n) of each table."""
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def blank_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that stand for nothing, as null."""
    return df.withColumns({c: F.when(~is_missing(F.col(c)), F.col(c)) for c in columns})
