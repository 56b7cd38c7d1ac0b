"""Coding grids: a researcher's coding in a table of themes, in coded sentences or in a matrix of marks, and themed paragraphs.

A grid is rows (sheet, row, cells).  All shapes come out as entries (sheet,
row, theme, code, quote, definition, inclusion, exclusion, keywords).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import BLANK

#: Patterns of headers by role, tried in order on the trimmed, lower-case header.
IDENTIFIER, QUOTATION = r"\bids?\b", "quot"
ROLES = (
    ("inclusion", r"(inclusion|include when|applies when)"),
    ("exclusion", r"(exclusion|exclude when|does not apply)"),
    ("keywords", r"(key ?words?|key phrases?|search terms?)"),
    ("definition", r"(definition|description|meaning|what it means|criteria)"),
    ("count", r"(count|freq|frequency|references|mentions|how many|^n$|^no\.?$|number of)"),
    ("document", r"(^document|^file|transcript name|^source$|^interview$)"),
)
QUOTE = r"(quot|excerpt|verbatim|segment|extract|passage|sentence|statement|response|content|\btext\b|illustrat|example)"
NOT_QUOTE = r"(?i)(name|\bid\b|comment|memo|note|reference|position|count|freq|number|^no\.?$|grounded|density)"
CODE = r"^(codes?|themes?|code name|theme name|categor(y|ies)|nodes?|labels?|tags?|concepts?|code\/theme|theme\/code)$|(^|\b)(code|theme|node|categor|concept)"
#: Marks of a matrix, bullets, an attribution behind a quote, longest code, shortest quoted span, rows searched for headers, shortest quote of a list.
MARK = r"(?i)^(1|x|y|yes|true|✓|✔|tick|\+)$"
BULLET = r"^(?:[\s•\-–*]+|\d+[.)]\s+)"
ATTRIBUTION = r"\s*[(\[]\s*[A-Za-z]{1,12}[_\s-]?\d+[^)\]]*[)\]]\s*$"
CODE_MOST, SPAN_LEAST, HEADER_ROWS, LISTED_LEAST = 160, 12, 15, 25
META = ("definition", "inclusion", "exclusion", "keywords")


def clean(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), BLANK + "+", " "))


def header_role(header: Column) -> Column:
    """Role of a header by the first pattern it meets, else ``other``."""
    h = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    out = F.when(h == "", "other").when(h.rlike(IDENTIFIER) & ~h.rlike(QUOTATION), "other")
    for role, pattern in ROLES:
        out = out.when(h.rlike(pattern), role)
    quote = h.rlike(QUOTE) & ~F.regexp_replace(h, "quotation content|quote content", "").rlike(NOT_QUOTE)
    return out.when(quote, "quote").when(h.rlike(CODE), "code").otherwise("other")


def split_codes(cell: Column) -> Column:
    """Codes of a cell: split at line breaks, semicolons and bars, never commas; bullets and numbers off, blanks and overlong ones dropped."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"[\n;|]"), lambda s: clean(F.regexp_replace(s, BULLET, "")))
    return F.filter(parts, lambda s: (s != "") & (F.length(s) <= CODE_MOST))


def quoted_spans(line: Column) -> Column:
    """Spans of twelve characters or more between quotation marks."""
    return F.transform(F.regexp_extract_all(line, F.lit(rf'["“”]([^"“”]{{{SPAN_LEAST},}})["“”]'), F.lit(1)), clean)


def split_quotes(cell: Column) -> Column:
    """Quotes of a cell: the quoted spans of each line, or the line without its attribution; a wrapped sentence is one quote.

    Lines are several quotes if any has quoted spans or all have 25 characters.
    """
    raw = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\r?\n+"), lambda s: clean(F.regexp_replace(s, BULLET, ""))), lambda s: s != "")
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, ATTRIBUTION, ""), "^[\"“”']+|[\"“”']+$", ""))
    lines = F.flatten(F.transform(raw, lambda s: F.when(F.size(quoted_spans(s)) > 0, quoted_spans(s)).otherwise(F.array(bare(s)))))
    kept = F.filter(lines, lambda s: s != "")
    several = (F.size(kept) <= 1) | F.exists(raw, lambda s: F.size(quoted_spans(s)) > 0) | F.forall(kept, lambda s: F.length(s) >= LISTED_LEAST)
    return F.when(several, kept).otherwise(F.array(F.array_join(kept, " ")))


def fill_down(df: DataFrame, sheet: str, row: str, column: str) -> DataFrame:
    """The last non-blank value above, in the same sheet."""
    w = Window.partitionBy(sheet).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.when(F.trim(column) != "", F.col(column)), ignorenulls=True).over(w))


def header_rows(grid: DataFrame) -> DataFrame:
    """(sheet, header_row, headers, roles): the first of fifteen rows with a code and a quote or criteria, else with a quote among three headers.

    ``fallback``, the code that a sheet is named after, is carried along; with it
    one header is enough.
    """
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("row"))
    roles = F.transform("cells", header_role)
    has = lambda *r: F.exists(F.col("roles"), lambda x: x.isin(*r))
    filled = F.size(F.filter("cells", lambda c: clean(c) != ""))
    top = grid.withColumn("k", place).where(F.col("k") <= HEADER_ROWS).withColumn("roles", roles)
    first, second = has("code") & has("quote", "definition", "inclusion", "exclusion"), has("quote") & (filled >= F.when(F.col("fallback").isNotNull(), 1).otherwise(3))
    ranked = top.where(first | second).withColumn("rank", F.row_number().over(Window.partitionBy("sheet").orderBy(F.when(first, 0).otherwise(1), "row")))
    return ranked.where("rank = 1").select("sheet", F.col("row").alias("header_row"), F.transform("cells", clean).alias("headers"), "roles", "fallback")


def parse_grid(grid: DataFrame) -> DataFrame:
    """Entries (sheet, row, shape, theme, code, quote, definition, inclusion, exclusion, keywords) of grids (sheet, row, cells[, fallback]).

    Of two code columns the one headed as sub-theme or code is the code and the
    other its theme, filled down.  Without a code column a sheet with a fallback
    is that code's list of quotes; one without is a matrix whose other columns
    are codes where marked.  Sheets without headers give nothing.
    """
    grid = grid if "fallback" in grid.columns else grid.withColumn("fallback", F.lit(None).cast("string"))
    head = header_rows(grid)
    # Places from 1, 0 for none.
    code_places = F.filter(F.sequence(F.lit(1), F.size("roles")), lambda i: F.element_at("roles", i) == "code")
    specific = F.filter("codes", lambda i: F.element_at("headers", i).rlike(r"(?i)sub|\bcode\b"))
    code = F.when((F.size("codes") > 1) & (F.size(specific) > 0), F.element_at(specific, 1)).otherwise(F.coalesce(F.try_element_at("codes", F.lit(1)), F.lit(0)))
    shaped = head.withColumn("codes", code_places).withColumn("code_at", code)
    parent = F.when(F.size("codes") > 1, F.coalesce(F.try_element_at(F.filter("codes", lambda i: i != F.col("code_at")), F.lit(1)), F.lit(0))).otherwise(0)
    shaped = shaped.withColumn("parent_at", parent).withColumns({f"{m}_at": F.array_position("roles", F.lit(m)) for m in ("quote", *META)})
    shaped = shaped.withColumn("shape", F.when((F.col("code_at") == 0) & F.col("fallback").isNull(), "matrix").otherwise("table"))
    body = grid.drop("fallback").join(F.broadcast(shaped), "sheet").where((F.col("row") > F.col("header_row")) & F.exists("cells", lambda c: clean(c) != ""))
    cell = lambda at: F.when(F.col(at) > 0, F.try_element_at("cells", F.col(at).cast("int")))
    some = lambda at: F.nullif(clean(cell(at)), F.lit(""))

    rows = fill_down(body.where("shape = 'table'").withColumn("theme", some("parent_at")), "sheet", "row", "theme")
    codes = F.when(F.col("code_at") > 0, split_codes(cell("code_at"))).otherwise(F.array("fallback"))
    quotes = split_quotes(F.coalesce(cell("quote_at"), F.lit("")))
    meta = [some(f"{m}_at").alias(m) for m in META]
    listed = rows.select("sheet", "row", "shape", "theme", F.posexplode(codes).alias("i", "code"), quotes.alias("q"), *meta)
    table = listed.select("sheet", "row", "shape", "theme", "code", "i", F.posexplode_outer("q").alias("j", "quote"), *META)

    marks = body.where("shape = 'matrix' AND quote_at > 0").withColumn("quote", some("quote_at")).where("quote IS NOT NULL")
    each = marks.select("sheet", "row", "shape", "quote", "roles", "quote_at", F.posexplode("headers").alias("i", "code"), "cells").where((F.col("i") + 1 != F.col("quote_at")) & (F.col("code") != "") & ~F.element_at("roles", F.col("i") + 1).isin("count", "document"))
    matrix = each.where(clean(F.try_element_at("cells", F.col("i") + 1)).rlike(MARK)).select("sheet", "row", "shape", F.lit(None).cast("string").alias("theme"), "code", "i", F.lit(0).alias("j"), "quote", *[F.lit(None).cast("string").alias(m) for m in META])
    return table.unionByName(matrix)


def parse_paragraphs(lines: DataFrame) -> DataFrame:
    """Entries of themed extracts (sheet, row, line): THEME and Code lines, then lines with quoted words; notes in brackets are left out.

    A theme line ends the code before it; the longest quoted span of a line counts.
    """
    t = lines.withColumn("t", clean(F.col("line"))).where("t <> '' AND NOT startswith(t, '[')")
    theme = F.nullif(F.regexp_extract("t", r"(?i)^(?:main\s+|global\s+)?theme\b[^:\n]{0,12}:\s*(.+)$", 1), F.lit(""))
    code = F.when(theme.isNull(), F.nullif(F.regexp_extract("t", r"(?i)^(?:sub-?theme|code|category)\s*:\s*(.+)$", 1), F.lit("")))
    marked = t.withColumn("theme_line", theme).withColumn("code_line", code)
    so_far = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn("theme", F.last("theme_line", ignorenulls=True).over(so_far)).withColumn("block", F.count("theme_line").over(so_far))
    in_block = Window.partitionBy("sheet", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("code", F.last("code_line", ignorenulls=True).over(in_block)).where("theme_line IS NULL")
    longest = F.element_at(F.array_sort(quoted_spans(F.col("t")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)), 1)
    spoken = (F.size(quoted_spans(F.col("t"))) > 0) & F.coalesce("code", "theme").isNotNull()
    none = [F.lit(None).cast("string").alias(m) for m in META]
    named = placed.where("code_line IS NOT NULL").select("sheet", "row", F.lit("table").alias("shape"), "theme", "code", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("string").alias("quote"), *none)
    said = placed.where(F.col("code_line").isNull() & spoken).select("sheet", "row", F.lit("table").alias("shape"), F.when(F.col("code").isNotNull(), F.col("theme")).alias("theme"), F.coalesce("code", "theme").alias("code"), F.lit(0).alias("i"), F.lit(0).alias("j"), longest.alias("quote"), *none)
    return named.union(said)


def unique_codes(entries: DataFrame) -> DataFrame:
    """One row a code, case aside, over all sheets and parts: the first spelling, and the first value of each other field that isn't empty."""
    order = F.struct("sheet", "row", "i", "j")
    first = [F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", order)).alias(c) for c in ("theme", *META)]
    return entries.groupBy(F.lower("code").alias("key")).agg(F.min_by("code", order).alias("code"), *first)


def merge_parts(*parts: DataFrame) -> DataFrame:
    """Entries of several files as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skipped_rows(grid: DataFrame) -> DataFrame:
    """(sheet, skipped): rows with a quote and no code."""
    head = header_rows(grid if "fallback" in grid.columns else grid.withColumn("fallback", F.lit(None).cast("string"))).withColumn("code_at", F.array_position("roles", F.lit("code"))).withColumn("quote_at", F.array_position("roles", F.lit("quote"))).where("code_at > 0 AND quote_at > 0")
    body = grid.drop("fallback").join(F.broadcast(head), "sheet").where(F.col("row") > F.col("header_row"))
    bare = (F.size(split_codes(F.try_element_at("cells", F.col("code_at").cast("int")))) == 0) & (F.size(split_quotes(F.try_element_at("cells", F.col("quote_at").cast("int")))) > 0)
    return body.groupBy("sheet").agg(F.count_if(bare).alias("skipped"))


def import_coding(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc, quotes_total, quotes_matched, in_moderator_turns, codes, codes_without_quotes) of entries (doc, quote_id, code, quote) and their matches."""
    asked = entries.join(matches.select("quote_id", "doc", "match", "role", "spans_turns"), ["quote_id", "doc"], "left")
    found = F.col("quote").isNotNull() & F.coalesce((F.col("match") != "none") & ~F.col("spans_turns"), F.lit(False))
    moderator = found & F.coalesce(F.col("role") == "moderator", F.lit(False))
    kept = found & ~moderator
    code = F.lower("code")
    g = asked.groupBy("doc").agg(F.count("quote").alias("quotes_total"), F.count_if(kept).alias("quotes_matched"), F.count_if(moderator).alias("in_moderator_turns"), F.count_distinct(code).alias("codes"), F.count_distinct(F.when(kept, code)).alias("with"))
    return g.select("doc", "quotes_total", "quotes_matched", "in_moderator_turns", "codes", (F.col("codes") - F.col("with")).alias("codes_without_quotes"))
