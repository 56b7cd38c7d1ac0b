"""Queries over the test tables, one for each operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import (
    chat_format, embedding_dedup, fingerprints, html_extract, importance_resampling, jaccard_join, language_id, neighbour_search, sentencepiece_codec, source_mixing,
    spelling_variants, substring_dedup, token_counts,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document replicated to target weights proportional to the root of each source's size."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mixing.mix_sources(docs)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), rule="start")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.training_rows(docs))
    found = language_id.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = rows.union(extra).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    return chat_format.digest_conversations(chat_format.format_conversations(messages))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text, and digests of the text and of what the pieces decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs))
    return coded.select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_pieces", "piece_ids", F.sha2("text", 256).alias("text_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_documents(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op11_neighbour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id 20 divides; edge cases as in the operator."""
    rows = _table(spark, sf_dir, "embeddings")
    return neighbour_search.nearest_neighbours(rows.where("vec_id % 20 = 0"), rows)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark texts, a quarter of them drawn; edge cases as in the operator."""
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of all documents, each word with its form and root; edge cases as in the operator."""
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extract": op8_html_extract,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_neighbour_search": op11_neighbour_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, min(root) AS component_id
FROM sets JOIN reach ON node = sets.doc_id GROUP BY ALL
"""

SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, list(i) AS places FROM windows SEMI JOIN twice USING (s) GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(places, lambda i: range(i, i + 35)))) AS g FROM hits)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE
         array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]), ' ') END, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

#: CRC-32 of a string's UTF-8 bytes, by a table of 256 words made from the polynomial.
CRC_SQL = r"""
crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i)))"""


def _crc_sql(text: str) -> str:
    """SQL expression of the CRC-32 of ``text``, over a relation that holds the table t."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * p + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda p: {byte})), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


RESAMPLING_SQL = rf"""
WITH {CRC_SQL.strip()},
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
counts AS (SELECT side, id, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT f, {_crc_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counts), crc_table),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
  FROM counts JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM buckets),
weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM counts JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS eligible,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (id) WHERE side = 'd')
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN eligible AND r <= many * 25 // 100 THEN r END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS r, count(*) FILTER (eligible) OVER () AS many FROM scored)
"""

SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_SQL.strip()},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
counts AS (SELECT doc_id::VARCHAR || ':' || r AS named, r, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT r, k, {_crc_sql('named')} AS h FROM counts, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
less AS (SELECT word, n, length(word) AS l, p, left(word, p) || substr(word, p + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.p = b.p AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
known AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (
  SELECT word, coalesce(form, word) FROM known
  UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.root AND k.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN chain USING (word)
WHERE root NOT IN (SELECT word FROM known WHERE form IS NOT NULL)
"""

ORACLE_SQL = {"op6_substring_dedup": SUBSTRING_SQL, "op9_jaccard_join": JACCARD_SQL, "op1_source_mixing": source_mixing.MIX_SQL, "op12_importance_resampling": RESAMPLING_SQL, "op13_spelling_variants": SPELLING_SQL}
