"""Each operator on small tables with nulls, empties, long texts, ties, repeats, clashing names, and against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import (
    chat_format, crc, embedding_dedup, fingerprints, html_extract, importance_resampling, jaccard_join, language_id, neighbour_search, sentencepiece_codec, source_mixing,
    spelling_variants, substring_dedup, token_counts, words,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) if schema == DOC else tuple(r) for r in rows], schema)


def edge_rows():
    base = " ".join(f"tok{i}" for i in range(80))
    return [
        (1, base, "en", "a", 3), (2, base + " more", "en", "a", None), (2, base + " more", "en", "a", None), (3, None, None, None, None), (4, "", "en", None, 0),
        (5, " \t\n", "de", "b", 3), (6, LONG, "en", "b", 1), (None, base, None, "a", 1), (7, "one", "fr", "c", 1), (8, "ünïcode 漢字 🙂", "fr", "c", 1), (9, "1234 %%% 5", "fr", "c", 1),
    ]


# words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t漢 \x0b\xa0A"), max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = words.words_of(pa.array(texts, pa.string()))
    want = [w for t in texts for w in WORD.findall(t or "")]
    got = [found.data[s:e].tobytes().decode() for s, e in zip(found.start, found.end, strict=True)]
    assert got == want
    assert list(found.counts) == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(zip(want, found.hash.tolist(), strict=True))) == len(set(want)) == len(set(found.hash.tolist()))


def test_shingle_sets_match_brute_force():
    texts = ["a b c d a b c", "a b", None, "", "A B c d"]
    values, off = words.shingle_sets(pa.array(texts, pa.string()), 3, lower=True)
    assert list(np.diff(off)) == [4, 1, 0, 0, 2]
    assert set(values[off[4] : off[5]].tolist()) <= set(values[off[0] : off[1]].tolist())


# 1


def test_poisson_quantile_is_the_inverse_distribution(spark):
    from pyspark.sql import functions as F

    rows = [(u, m) for u in (0.0, 0.1, 0.5, 0.9, 0.999999) for m in (0.0, 0.3, 1.0, 5.5)]
    got = spark.createDataFrame(rows, "u double, m double").select("u", "m", source_mixing.poisson_quantile(F.col("u"), F.col("m")).alias("k")).collect()
    for r in got:
        total, k = math.exp(-r.m), 0
        while total <= r.u:
            k += 1
            total += math.exp(-r.m) * r.m**k / math.factorial(k)
        assert r.k == k


def test_poisson_quantile_of_large_means(spark):
    from pyspark.sql import functions as F

    rows = [(u, m) for u in (0.0, 0.001, 0.1, 0.5, 0.9, 0.999999) for m in (8.5, 9.0, 20.0, 50.0, 1000.0)]
    got = spark.createDataFrame(rows, "u double, m double").select("u", "m", source_mixing.poisson_quantile(F.col("u"), F.col("m")).alias("k")).collect()
    for r in got:
        total, k = math.exp(-r.m), 0
        while total <= r.u and r.u > 0:
            k += 1
            total += math.exp(k * math.log(r.m) - r.m - math.lgamma(k + 1))
        assert r.k == k, r
    few = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    n = [r.mix_count for r in source_mixing.mix_sources(few, budget_ratio=20.0).where("mix_copy = 0").collect()]
    assert abs(np.mean(n) - 20) < 0.5 and abs(np.var(n) - 20) < 3


@pytest.mark.parametrize("rate", [3.0, 9.0, 20.0])
def test_replication_has_the_variance_of_its_mean(spark, rate):
    rows = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "'a' AS source", "1 AS mix_rate", "2 AS SOURCE_KEY")
    got = source_mixing.mix_sources(rows, budget_ratio=rate)
    assert got.columns == [*rows.columns, "mix_copy", "mix_count", "mix_key"]
    n = {r.doc_id: r.mix_count for r in got.select("doc_id", "mix_count").distinct().collect()}
    n = np.array([n.get(i, 0) for i in range(6000)])
    assert abs(n.mean() - rate) < 0.05 * rate and abs(n.var() - rate) < 0.08 * rate


def test_mix_sources_meets_weights_and_edges(spark):
    from pyspark.sql import functions as F

    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("mix_copy"))
    got = source_mixing.mix_sources(many, {"a": 1.0, "b": 1.0}, budget_ratio=2.0)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 6000) < 400 and abs(n["b"] - 6000) < 400
    assert got.columns == ["doc_id", "text", "source", "mix_copy", "mix_count", "mix_key"]
    assert source_mixing.mix_sources(many, {"a": 1.0}).where("source = 'b'").count() == 0
    edges = docs(spark, edge_rows())
    assert source_mixing.mix_sources(edges, budget_ratio=3.0).where("source IS NULL").count() > 0
    assert source_mixing.mix_sources(edges.limit(0)).count() == 0


# 2


def test_fingerprint_edits(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(edge_rows())]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    sets = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(lowered(t))] for i in range(max(1, len(w) - 4))} if WORD.findall(t or "") else set()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = sets(t), sets(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.12
    assert got[1].fingerprint == got[2].fingerprint and got[3].fingerprint == ""


def test_borrowed_bins_of_short_texts_are_independent():
    low, some = fingerprints.signatures(pa.array([f"one{i} two{i} three{i} four{i} five{i}" for i in range(401)]))
    near = fingerprints.likeness(low[:-1], low[1:], some[:-1], some[1:])
    assert near.max() < 0.12 and near.mean() < 0.05
    same, ok = fingerprints.signatures(pa.array(["a b c", "A b  c"]))
    assert fingerprints.likeness(same[:1], same[1:], ok[:1], ok[1:])[0] == 1.0


def test_fingerprint_edits_with_repeated_and_null_ids(spark):
    frame = docs(spark, edge_rows())
    assert fingerprints.fingerprint_edits(frame).count() == len(edge_rows())
    assert fingerprints.fingerprint_edits(frame.limit(0)).count() == 0
    assert fingerprints.fingerprint_edits(docs(spark, [(5, "a b c")])).first().near_next == 1.0
    assert fingerprints.fingerprint_documents(frame.withColumnRenamed("lang", "fingerprint")).columns[-1] == "fingerprint"


# 3


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, rule):
    rows = [(1, "one two\n\n\nthree  \n four"), (2, None), (3, ""), (4, "é\n🙂🙂\n"), (5, LONG), (5, LONG)]
    got = token_counts.token_counts(docs(spark, rows), rule).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    encoder, _ = token_counts._encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    for i, t in rows[:4]:
        own = sorted(by[i], key=lambda r: r.section)
        assert [(t or "")[r.start_char : r.end_char] for r in own] == ((t or "").splitlines(keepends=True) or [""])
        assert sum(r.n_tokens for r in own) == pytest.approx(len(encoder.encode_ordinary(t or ""))) == own[0].doc_tokens
    assert sum(r.n_tokens for r in by[5]) == pytest.approx(2 * len(encoder.encode_ordinary(LONG)))
    assert token_counts.token_counts(docs(spark, rows).limit(0)).count() == 0


def test_crossing_tokens_follow_the_rule():
    ends, bounds = np.array([2, 6, 8]), np.array([0, 3, 8])
    assert token_counts.allot(ends, bounds, "start")[0].tolist() == [2, 1]
    assert token_counts.allot(ends, bounds, "majority")[0].tolist() == [1, 2]
    assert token_counts.allot(ends, bounds, "split")[0].tolist() == [1.25, 1.75]
    assert token_counts.allot(ends, bounds, "start")[1].tolist() == [1, 0]


def brute_allot(text, spans, rule):
    """Tokens of each span, from the library's own token bytes; spans are in characters."""
    encoder, _ = token_counts._encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    at, owner = [], []
    for i, (a, b) in enumerate(spans):
        owner += [i] * len(text[a:b].encode())
    for t in encoder.encode_ordinary(text):
        n = len(encoder.decode_single_token_bytes(t))
        at.append(owner[:n])
        owner = owner[n:]
    out = [0.0] * len(spans)
    for own in at:
        c = Counter(own)
        if rule == "start":
            out[own[0]] += 1
        elif rule == "majority":
            out[max(c, key=lambda i: (c[i], -i))] += 1
        else:
            for i, n in c.items():
                out[i] += n / len(own)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_spans_and_fields_match_brute_force(spark, rule):
    text = "Hällo wörld, 漢字 and 🙂🙂 everything"
    cuts = [(2, 7), (7, 7), (9, 20), (20, 24)]
    whole = [(0, 2), (2, 7), (7, 7), (7, 9), (9, 20), (20, 24), (24, len(text))]
    rows = [(1, text, cuts, "x"), (2, None, None, "x"), (3, "abc", [], "x"), (4, "abc", [(0, 3)], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>, spans string")
    got = defaultdict(list)
    for r in token_counts.token_counts(frame, rule, spans="parts").collect():
        got[r.doc_id].append(r)
    own = sorted(got[1], key=lambda r: (r.start_char, r.end_char))
    assert [(r.start_char, r.end_char) for r in own] == whole and [r.section for r in own] == [-1, 0, 1, -1, 2, 3, -1]
    assert [r.n_tokens for r in own] == pytest.approx(brute_allot(text, whole, rule))
    assert [(r.section, r.doc_tokens) for r in got[2]] == [(-1, 0)] and [r.section for r in got[3]] == [-1] and [r.section for r in got[4]] == [0]
    with pytest.raises(Exception, match="overlaps"):
        token_counts.token_counts(spark.createDataFrame([(1, "ab", [(0, 2), (1, 2)])], "doc_id long, text string, p array<struct<start:int,end:int>>"), spans="p").collect()
    fields = spark.createDataFrame([(1, "Tïtle", "Some body, here"), (2, None, "x"), (3, "a", None)], "doc_id long, title string, body string")
    by = defaultdict(list)
    for r in token_counts.token_counts(fields, rule, fields=["title", "body"]).collect():
        by[r.doc_id].append(r)
    for i, (a, b) in {1: ("Tïtle", "Some body, here"), 2: ("", "x"), 3: ("a", "")}.items():
        spans = [(0, len(a) + 1), (len(a) + 1, len(a) + 1 + len(b))]
        assert [r.n_tokens for r in sorted(by[i], key=lambda r: r.section)] == pytest.approx(brute_allot(f"{a}\n{b}", spans, rule))
    with pytest.raises(ValueError):
        token_counts.token_counts(fields, "other")


# 4


def test_scores_match_brute_force_shares(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et la souris", "fr"), ("the dog and the cat", "en")])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)

    def grams(text):
        folded = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        return [folded[i : i + n] for n in language_id.SIZES for i in range(len(folded) - n + 1) if folded[i : i + n].strip()]

    known = defaultdict(set)
    for _, t, x in rows:
        known[x] |= set(grams(t))
    for text in ["the katze sat", "Der Hund, the dog!", "la souris 123 et le chien", "x" * 5000]:
        shares = {x: sum(g in known[x] for g in grams(text)) / len(grams(text)) for x in known}
        lang, score = model.predict(pa.array([text]))
        assert shares[lang[0]] >= max(shares.values()) - 0.03 and abs(score[0] - max(shares.values())) < 0.05
    long = " ".join(t for _, t, _ in rows) + " "
    one, many = model.predict(pa.array([long * 4000])), model.predict(pa.array([long]))
    assert one[0] == many[0] and abs(one[1][0] - many[1][0]) < 0.01


def test_equal_texts_score_equally_at_every_place(spark):
    rows = [(1, "der die das und der", "de"), (2, "the cat and the dog", "en")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["1. der the", " 1. der the", "the der", ""]
    alone = {t: [x[0] for x in model.predict(pa.array([t]))] for t in texts}
    for order in itertools.permutations([*texts, texts[0], None]):
        lang, score = model.predict(pa.array(order, pa.string()))
        assert [[a, b] for a, b in zip(lang, score, strict=True)] == [alone[t or ""] for t in order]


def test_a_filter_too_large_to_broadcast_is_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_BYTES", 1000)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([(1, "der die das", "de")], "doc_id long, text string, lang string"))


def test_language_accuracy_on_held_out_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(language_id.training_rows(frame))
    got = language_id.identify_language(frame, model).where(language_id.held_out()).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    for r in frame.select("doc_id", language_id.held_out().alias("h")).limit(50).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_edges(spark):
    frame = docs(spark, edge_rows())
    got = {r.doc_id: r for r in language_id.identify_language(frame, language_id.fit(frame)).collect()}
    for i in (3, 4, 5, 9):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[6].lang_pred == "en" and 0 < got[6].score <= 1
    none = language_id.fit(frame.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.identify_language(frame, none).collect()} == {"und"}
    assert language_id.identify_language(frame.limit(0), none).count() == 0


# 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROL, "<", "|", "\\", "[", "INST]", "turn|>", "x", "\n", "é"]), max_size=8).map("".join))
def test_escape_is_reversible_and_defuses(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROL)
    formatted, spans, _ = chat_format.format_messages(["assistant", "user"], [[{"kind": "text", "text": text}], [{"kind": "text", "text": text}]])
    assert chat_format.read_turns(formatted) == [("assistant", text), ("user", text)]
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [text]


def test_conversations_read_back(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\n<|end|>"), (1, 1, "assistant", "a\n<|end|>"), (2, 0, None, None), (2, None, "user", "x"), (None, 0, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    parts = frame.withColumn("parts", chat_format.text_parts(F.col("text")))
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_conversations(parts)).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == sha([("user", "hi"), ("assistant", "a\n<|end|>"), ("assistant", "a\n<|end|>")]) and got[1].loss_chars == 18
    assert got[2].turns_sha256 == sha([("user", "x"), ("", "")]) and got[2].loss_chars == 0
    assert got[None].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert chat_format.format_conversations(parts.limit(0)).count() == 0


def test_large_and_null_ids_stay_apart(spark):
    from pyspark.sql import functions as F

    ids = [*range(2**53, 2**53 + 40), None, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(i, t, "user", str(i)) for i in ids for t in (0, 1)], "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(frame.withColumn("parts", chat_format.text_parts(F.col("text"))))
    assert made.schema["conv_id"].dataType.simpleString() == "bigint"
    got = {r.conv_id: r for r in made.collect()}
    assert set(got) == set(ids) and all(chat_format.read_turns(got[i].formatted) == [("user", str(i))] * 2 for i in ids)
    assert {(r.conv_id, r.n_turns) for r in chat_format.digest_conversations(made).collect()} == {(i, 2) for i in ids}


def test_attachments_leave_placeholders_and_references(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://x.png", 3), ("audio", None, "y", None), ("document", None, "z", 2), ("text", "<|image|>", None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PART_TYPE}")
    got = chat_format.format_conversations(frame).first()
    assert got.formatted.count("<|image|>") == 3 and got.formatted.count("<|audio|>") == 1 and got.formatted.count("<|document|>") == 2
    for a in got.attachments:
        mark = chat_format.PLACEHOLDERS[a.kind]
        assert got.formatted[a.at :].startswith(mark * a.n_tokens)
    assert [a.ref for a in got.attachments] == ["s3://x.png", "y", "z"]


# 6


def brute_substring(rows, length):
    split = [WORD.findall(t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(w) - length + 1):
            if n[tuple(w[s : s + length])] > 1:
                gone |= set(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("length", "most"), [(35, 64), (14, 64), (14, 2), (1, 8), (8, 64), (11, 2), (12, 64), (74, 1), (75, 64), (100, 1)])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, length, most):
    monkeypatch.setattr(substring_dedup, "SHARD_FRAGMENTS", most)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 400)
    rng = np.random.default_rng(3)
    shared = [" ".join(f"p{k}{i}" for i in range(n)) for k, n in enumerate((13, 14, 34, 35, 36, 60))]
    fill = lambda n: " ".join(rng.choice(["a", "b", "c", "the"], n))
    rows = [(i, " ".join([fill(int(rng.integers(0, 30))), shared[int(rng.integers(0, 6))], fill(int(rng.integers(0, 9))), shared[int(rng.integers(0, 6))]])) for i in range(40)]
    rows += [(100, " ".join(["x"] * 90)), (101, None), (102, ""), (103, LONG), (7, "other text " + shared[5]), (None, shared[4]), (104, shared[3] + " " + shared[3])]
    rows += rows[:2]
    rows += [(200 + i, " ".join(f"v{j}" for j in range(i, i + 130))) for i in range(0, 30, 10)]
    frame = docs(spark, rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "sd_found").withColumnRenamed("n_chars", "Packed").selectExpr("*", "1 AS SD_KEY", "2 AS first")
    made = substring_dedup.remove_repeated_spans(frame, length)
    assert set(made.columns) == {"doc_id", "text", "sd_found", "Packed", "SD_KEY", "first", "n_words", "n_removed", "spans", "kept"}
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in made.collect())
    assert got == brute_substring(rows, length)
    if length == 14:
        assert substring_dedup.remove_repeated_spans(frame.limit(0), length).count() == 0
        with pytest.raises(ValueError):
            substring_dedup.remove_repeated_spans(frame, 0)


def test_reference_spans_are_removed_by_broadcast_automata(spark):
    passage = " ".join(f"q{i}" for i in range(50))
    frame = docs(spark, [(1, "before " + passage + " after"), (2, " ".join(passage.split()[:34])), (3, None)])
    got = {r.doc_id: (r.n_removed, r.kept) for r in substring_dedup.remove_reference_spans(frame, docs(spark, [(9, passage), (8, None)])).collect()}
    assert got == {1: (50, "before after"), 2: (0, " ".join(passage.split()[:34])), 3: (0, "")}
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(frame, docs(spark, [(9, passage)]), most_words=10)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=5), st.integers(1, 4))
def test_automaton_counts_occurrences(sequences, length):
    automaton = substring_dedup.SuffixAutomaton()
    for s in sequences:
        automaton.add(s, 1)
    automaton.close()
    n = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        assert automaton.ends(s, length, 2) == [i + length - 1 for i in range(len(s) - length + 1) if n[tuple(s[i : i + length])] > 1]


# 7


TEXTS = ["", "  a  b ", "pa.\nLa", "漢字 🙂 xyz", "a b\n\n c", " lead", "trail ", "\n", "tab\tx", "\uffffa b", "a \uffff", "\uffff\n\uffff x"]


def test_pieces_equal_plain_merging_and_round_trip(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rows = [(i, t) for i, t in enumerate([*TEXTS, LONG])] + [(99, None)]
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    frame = docs(spark, rows).select("doc_id", "text").union(sample)
    for r in sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(frame)).collect():
        assert r.piece_ids == library.encode(r.text or "") and r.n_pieces == len(r.piece_ids)
        assert r.decoded == (r.text or "")
    assert sentencepiece_codec.encode_documents(frame.limit(0)).count() == 0


def test_unigram_search_finds_the_best_sum():
    tool = sentencepiece_codec.Codec(sentencepiece_codec.MODEL, "unigram")

    def best(word):
        score = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                i = tool.ids.get(word[s:e])
                if i is not None or e - s == 1:
                    score[e] = max(score[e], score[s] + (tool.scores[i] if i is not None else tool.floor))
        return score[-1]

    lined = sorted({"▁there", "▁therefore", "▁thereof", "▁x", "the", "▁ünknown"})
    for word, ids in zip(lined, tool.encode_sorted(lined), strict=True):
        assert sum(tool.scores.get(i, 0) for i in ids) == pytest.approx(best(word))


# 8


def test_page_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- x -->"
        '<div class="ad">Buy this, now.</div><article><h1>Head &amp; tail</h1><p><b>First bit, with text.<br><p>Second &eacute;\n  part, here.</p>'
        '<aside>Aside.</aside><form><p>Sign up.</p></form><div class="comments"><p>Reader says, hello.</p></div></article><footer>&copy; x</footer></body></html>'
    )
    plain = "<body><div id=menu><a>One</a><a>Two</a></div><div><p>Long text, with marks. And more, and more.</p><p>Another long text, with marks; again.</p></div><div class='cookie-notice'>We use cookies.</div></body>"
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", plain), (4, "w", plain), (5, "x", "<p>unclosed <b>text"), (6, "y", "no tags at all"), (8, "b", "<article><p>a<br>b &lt;c&gt;</p></article>"), (7, "z", "<article>" + "<p>word, word.</p>" * 20000 + "</article>")]
    got = defaultdict(list)
    for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["Head & tail\nFirst bit, with text.\nSecond é part, here."]
    assert got[2] == got[3] == [""]
    assert got[4] == ["Long text, with marks. And more, and more.\nAnother long text, with marks; again."] * 2
    assert got[8] == ["a b <c>"]
    assert got[5] == ["unclosed text"] and got[6] == ["no tags at all"]
    assert got[7] == ["\n".join(["word, word."] * 20000)]


def test_short_blocks_of_an_article_stay():
    long = "<p>" + "Some words, and others. " * 9 + "</p>"
    text = " ".join(("Some words, and others. " * 9).split())
    inner = f"<h1>Head</h1><div>{long}{long}<ul><li>one<ul><li>deep</li></ul></li><li>two</li></ul></div><table><tr><th>k</th><td>v</td></tr></table><dl><dt>t</dt><dd>d</dd></dl><figure><figcaption>Cap</figcaption></figure>"
    want = "\n".join(["Head", text, text, "one", "deep", "two", "k", "v", "t", "d", "Cap"])
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<body><ul><li>menu</li></ul><{tag}>{inner}<div class='share'>x</div><nav>y</nav></{tag}><p>after</p></body>") == want
    assert html_extract.main_text(f"<body><main><div class='page-wrap'><article>{inner}</article></div></main></body>") == want
    assert html_extract.main_text(f"<body class='x'><div class='layout no-sidebar' id='page-header'><article class='has_comments'>{inner}<div class='x cookie_notice'>x</div></article></div></body>") == want


def test_ratios_choose_where_names_say_nothing():
    body = "<p>Long text, with marks. And more, and more of it.</p><p>Another text; long, with marks.</p>"
    pages = [
        f"<body><div><a>One</a> <a>Two</a> <a>Three</a></div><div><h2>Short</h2>{body}<ul><li>item</li></ul></div><div>© 2020 Foo</div></body>",
        f"<body><article>{body}<ul><li><a>Share</a></li><li><a>Tweet</a></li><li><a>Mail</a></li></ul></article></body>",
        f"<body><table><tr><td><a>x</a><td>{body}</table></body>",
    ]
    text = "Long text, with marks. And more, and more of it.\nAnother text; long, with marks."
    assert [html_extract.main_text(x) for x in pages] == [f"Short\n{text}\nitem", text, text]
    assert [html_extract.main_text(x, threshold=0) for x in pages[:2]] != [html_extract.main_text(x) for x in pages[:2]]
    for page in (f'<div class="layout with-sidebar">{body}</div>', f"<form id=f><nav><a>x</a></nav><div>{body}</div></form>", f'<main class="content search-results">{body}</main>'):
        assert html_extract.main_text(page) == text
    assert html_extract.main_text('<div class="comments"><p>only readers, here.</p></div>') == ""
    assert html_extract.main_text('<article><p>Short.</p></article><div class="commentList"><p>' + "Reader says, hello. " * 50 + "</p></div>") == "Short."
    assert html_extract.main_text('<p class=x">text</p> <p title="a>b">z</p>') == "text\nz"


@pytest.mark.parametrize("depth", [1, 8, 9, 40])
@pytest.mark.parametrize("guard", ["form", 'div class="widget"'])
def test_text_inside_nested_guards_stays(depth, guard):
    body = "".join(f"<p>Sentence {i}, of the text, ends here.</p>" for i in range(30))
    page = f"<body>{f'<{guard}>' * depth}{body}{f'</{guard.split()[0]}>' * depth}</body>"
    assert html_extract.main_text(page) == "\n".join(f"Sentence {i}, of the text, ends here." for i in range(30))


@pytest.mark.parametrize("blanks", [0, 1, 63, 64, 80, 5000])
def test_quotes_may_stand_far_behind_their_sign(blanks):
    assert html_extract.main_text(f'<article><p>Go to <a href={" " * blanks}"x>y">link</a>, now. It\'s fine.</p></article>') == "Go to link, now. It's fine."


def test_the_header_of_an_article_holds_its_title():
    page = "<body><header><p>Site name</p></header><article><header><h1>Title</h1><nav><a href=x>menu</a></nav></header><p>Text of it, here.</p></article></body>"
    assert html_extract.main_text(page) == "Title\nText of it, here."


def test_ratios_alone_find_the_article_of_varied_pages():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    cut_short = 0
    for k in range(20):
        paragraphs = [" ".join(sentence(int(rng.integers(6, 15))) for _ in range(int(rng.integers(3, 7)))) for _ in range(int(rng.integers(4, 12)))]
        items = [sentence(3) for _ in range(int(rng.integers(0, 4)))]
        menu = "<ul>" + "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(int(rng.integers(4, 12)))) + "</ul>"
        inner = "".join(f"<p>{p}</p>" for p in paragraphs[:2]) + ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if items else "") + "".join(f"<p>{p}</p>" for p in paragraphs[2:])
        shell = ("<section>{}</section>", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>")[k % 3]
        page = f"<body><div>{menu}</div>{shell.format(inner)}<div>{menu}<span>{word()} {word()}</span></div></body>"
        assert html_extract.main_text(page) == "\n".join(paragraphs[:2] + items + paragraphs[2:])
        cut_short += html_extract.main_text(page, threshold=50.0) != html_extract.main_text(page)
    assert cut_short == 20


def test_malformed_pages_take_time_in_proportion():
    import time

    for part in ("<a ", '<a href="x', "<b>", "<p title='x>", "<!--", "<script>", "<form>", "</p><p><div>"):
        began = time.time()
        html_extract.main_text(part * (300_000 // len(part)))
        assert time.time() - began < 8, part


# 9


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "least", "crowd"), [(3, 90, 8, 100), (5, 80, 8, 2), (3, 90, 1, 100), (5, 80, 2, 4), (2, 50, 2, 3)])
def test_jaccard_components_match_brute_force(spark, monkeypatch, k, percent, least, crowd):
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", least)
    monkeypatch.setattr(jaccard_join, "BLOCK_COUNT", 1)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng = np.random.default_rng(5)
    common = [f"line{i}" for i in range(25)]
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(3, 120)))]
        for _ in range(8):
            own = list(base) + (common if g % 3 == 0 else [])
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " ", "One", "one", "one two", "ONE two", LONG, LONG + " x", " ".join(common), " ".join(common[:-1])])]
    frame = docs(spark, rows).withColumnRenamed("lang", "node")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_documents(frame, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 90)])
def test_jaccard_links_lone_pairs_with_text_added_or_cut_off(spark, k, percent):
    rows = []
    for g in range(120):
        n = 4 * (5 + g % 12) if percent == 80 else 9 * (2 + g % 12)  # n shingles against n / 4 or n / 9 more: right at the threshold
        more = n * 100 // percent - n
        own = [f"g{g}w{i}" for i in range(n + more + k - 1)]
        rows.append((2 * g, " ".join(own[: n + k - 1] if g % 2 else own)))
        rows.append((2 * g + 1, " ".join(own if g % 2 else own[: n + k - 1] if g % 4 else own[more:])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_documents(docs(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)
    assert all(got[2 * g + 1][1] == 2 * g for g in range(120))


def test_jaccard_edges(spark):
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.near_duplicate_documents(docs(spark, edge_rows()), 3, 90).collect())
    assert sum(got.values()) == len(edge_rows()) and got[2, 1] == 2 and got[None, 1] == 1 and got[3, 3] == 1
    assert jaccard_join.near_duplicate_documents(docs(spark, edge_rows()).limit(0)).count() == 0


# 10


def test_jaccard_links_rows_without_id(spark):
    base = [f"t{i}" for i in range(40)]
    rows = [(None, " ".join(base)), (5, " ".join([*base, "more"])), (None, "a b c d"), (None, "a b c d"), (7, "other words here"), (None, "other words here")]
    got = jaccard_join.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90)
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert found == Counter([(None, 38, 5), (5, 39, 5), (None, 2, None), (None, 2, None), (7, 1, 7), (None, 1, 7)])


def test_jaccard_texts_that_share_runs_of_common_words_alone_meet_nowhere(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"common{rng.integers(20)}" if rng.random() < 0.7 else f"d{i}w{j}" for j in range(120))) for i in range(300)]
    held, cut = [], jaccard_join.cut

    def counted(frame):
        out = cut(frame)
        if "lead" in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cut", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_documents(docs(spark, rows), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)
    assert len(held) == 1 and held[0] < 30  # of about 3,900 signatures


def test_jaccard_order_of_a_token_is_the_same_in_every_set():
    cost = np.random.default_rng(5).integers(0, 18, 1 << jaccard_join.SLOT_BITS).astype(np.uint8)
    base = [f"w{i % 37}x{i % 11}" for i in range(200)]
    texts = pa.array([" ".join(base), " ".join(base[50:150]), None, "one two", " ".join(["more", *base[::-1], *base])])
    values, off = jaccard_join.ordered_sets(texts, 3, cost)
    plain, plain_off = words.shingle_sets(texts, 3, lower=True)
    assert off.tolist() == plain_off.tolist()
    place = {}
    for i in range(len(texts)):
        own = values[off[i] : off[i + 1]].tolist()
        assert sorted(own) == plain[off[i] : off[i + 1]].tolist()
        place[i] = {t: at for at, t in enumerate(own)}
    for i in (0, 4):
        both = sorted(set(place[1]) & set(place[i]), key=place[1].get)
        assert both and both == sorted(both, key=place[i].get)


def test_documents_that_surely_stay_are_told_without_a_join(spark):
    frame = spark.range(1000).selectExpr("id AS doc_id").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    got = jaccard_join.may_hold(frame, frame.where("doc_id % 100 = 7"))
    marked = {r.doc_id for r in got.where("nd_may").collect()}
    assert got.count() == 1001 and {7 + 100 * i for i in range(10)} <= marked and len(marked) < 30
    assert jaccard_join.may_hold(frame, frame.limit(0)).where("NOT nd_may").count() == 1001


def test_vectors_that_share_an_id_have_each_their_own_links(spark):
    e = np.eye(4)
    rows = [(1, e[0]), (1, e[1]), (2, e[0] + 0.01), (3, e[1] + 0.01), (4, e[2]), (None, e[3]), (None, e[3]), (None, e[3] + 0.01), (9, e[3] + 0.02)]
    rows = [(i, [float(x) for x in v], 1) for i, v in rows]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    found = Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect())
    assert found == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (None, 3, 9), (None, 3, 9), (None, 3, 9), (9, 3, 9)])


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(40):
        base = rng.standard_normal(16)
        for _ in range(6):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.2).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [None] + [1.0] * 15, 0), (604, rows[0][1], None), (605, [], 0), (606, [float("inf")] * 16, 1), (607, [1.0, 2.0], 0), (608, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(frame, block=64).collect()}
    links, root = Counter(), {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fine = [(i, np.array(v, float), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for (i, a, x), (j, b, y) in itertools.combinations(fine, 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i] += 1
            links[j] += 1
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    want = {i: (links[i], find(i), find(i) == i) for i, *_ in rows}
    wrong = [i for i in want if want[i] != got[i]]
    found = sum(v[0] for v in got.values()) / sum(links.values())
    assert 0.97 <= found <= 1.0 and all(got[i][0] <= want[i][0] for i in want)
    assert len(wrong) <= 0.1 * len(want)
    assert all(got[i] == want[i] for i in range(600, 609))
    assert embedding_dedup.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_collision_count_is_calibrated():
    need = embedding_dedup.collisions_needed(40, 1.0, 0.998)
    p = math.erf(1 / math.sqrt(2))
    tail = lambda k: sum(math.comb(40, j) * p**j * (1 - p) ** (40 - j) for j in range(k, 41))
    assert tail(need) >= 0.998 > tail(need + 1)


def test_recall_in_64_dimensions_and_clashing_names(spark):
    rng = np.random.default_rng(9)
    base = np.repeat(rng.standard_normal((60, 64)), 8, axis=0)
    vectors = base + rng.standard_normal(base.shape) * 0.26
    labels = np.repeat(np.arange(60) % 3, 8)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    links = near.sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist(), int(x), 1, 2, 3) for i, (v, x) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int, rep int, cell int, subs int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(frame, block=100).collect()}
    assert sum(got.values()) >= 0.97 * links.sum() > 300
    assert all(got[i] <= n for i, n in enumerate(links))


def test_windows_on_sorted_lines_are_counted():
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((40, 5)), rng.standard_normal((70, 5))
    x[:5] = q[:5]
    near = (np.abs(q[:, None, :] - x[None, :, :]) <= 0.4).sum(axis=2)
    for need in (1, 3, 5):
        a, b = embedding_dedup.colliding_pairs(q, x, 0.4, need)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near >= need)), strict=True))


# 11 nearest neighbours


def brute_neighbours(queries, rows, k):
    """(query_id, rank, vec_id) by exact inner products, equal rows once; own ids left out."""
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def distinct(some):
        return list({(i, tuple(v)) for i, v in some if i is not None and fine(v)})

    out, scores = [], {}
    for qi, q in distinct(queries):
        near = sorted((-sum(float(a) * float(b) for a, b in zip(q, v, strict=True)), i) for i, v in distinct(rows) if i != qi and len(v) == len(q))
        out += [(qi, r, i) for r, (_, i) in enumerate(near[:k], 1)]
        scores.update({(qi, r): -s for r, (s, _) in enumerate(near[:k], 1)})
    return Counter(out), scores


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-4, 5, (30, 3)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[1].tolist()) for i in range(40)]  # copies: ties to smaller ids
    rows += [(5, base[5].tolist()), (7, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 2.0])]
    rows += [(205, [float("inf"), 1.0, 1.0]), (206, [1.0, 2.0]), (207, [3.0, -1.0]), (208, [1e6, -1e6, 1e6]), (209, [1e-6, 1e-6, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    asked = table.where("vec_id % 5 = 0 OR vec_id IN (7, 206, 208, 209) OR vec_id IS NULL")
    got = neighbour_search.nearest_neighbours(asked, table, k=4).collect()
    want, scores = brute_neighbours([(r.vec_id, r.embedding) for r in asked.collect()], rows, 4)
    assert Counter((r.query_id, r.rank, r.vec_id) for r in got) == want
    by_key = Counter((r.query_id, r.rank) for r in got)
    assert all(r.score == pytest.approx(scores[r.query_id, r.rank]) for r in got if by_key[r.query_id, r.rank] == 1)
    few = neighbour_search.nearest_neighbours(asked, table, k=500)
    assert Counter((r.query_id, r.rank, r.vec_id) for r in few.collect()) == brute_neighbours([(r.vec_id, r.embedding) for r in asked.collect()], rows, 500)[0]
    assert neighbour_search.nearest_neighbours(asked.limit(0), table).count() == 0 == neighbour_search.nearest_neighbours(asked, table.limit(0)).count()


@pytest.mark.parametrize("spread", [0.0, 0.8])
def test_neighbours_of_many_vectors_reach_the_recall(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbour_search, "BLOCK", 128)
    monkeypatch.setattr(neighbour_search, "KEPT", 500)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    x *= (np.exp(spread * rng.standard_normal(3000)) / np.linalg.norm(x, axis=1))[:, None]
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in neighbour_search.nearest_neighbours(table.where("vec_id % 20 = 0"), table).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    exact = x[::20].astype(float) @ x.astype(float).T
    hits = 0
    for row, q in enumerate(range(0, 3000, 20)):
        own = [i for i in np.argsort(-exact[row], kind="stable") if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert [got[q][r][1] for r in range(1, 21)] == sorted((s for _, s in got[q].values()), reverse=True)
        assert all(s == pytest.approx(exact[row, i]) for i, s in got[q].values())
        hits += len({i for i, _ in got[q].values()} & set(own))
    assert hits >= 0.97 * 20 * 150


# 12 importance resampling


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=8), st.integers(0, 2**32 - 1))
def test_crc_of_spans(parts, seed):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    start = end - [len(p) for p in parts]
    got = crc.extend(np.full(len(parts), seed, np.uint32), data, start, end)
    assert got.tolist() == [zlib.crc32(p, seed) for p in parts]
    assert crc.extend_byte(got, 0x20).tolist() == [zlib.crc32(p + b" ", seed) for p in parts]


def brute_resampling(rows, target, percent=25, least=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def bag(text):
        w = word.findall(lowered(text))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in itertools.pairwise(w))]]

    source, goal = Counter(), Counter()
    for _, text in rows:
        source.update(bag(text)[1])
    for text in target:
        goal.update(bag(text)[1])
    all_s, all_t = sum(source.values()), sum(goal.values())
    scored = []
    for key, text in rows:
        n, own = bag(text)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1) * (all_s + 10000) / ((source[b] + 1) * (all_t + 10000)))) for b in own) // len(own) if own else 0
        h = None if key is None else int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(own), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least and h is not None))
    able = sorted((-s, k) for k, _, _, s, ok in scored if ok)
    return scored, able[: percent * len(able) // 100]


def test_resampling_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "Beta", "gämma", "x1", "漢字", "tok", "and", "W" * 80]
    rows = [(i % 37, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(120)]
    rows += [(500, rows[3][1])] * 40 + [(1, None), (2, ""), (3, "-- ?"), (None, rows[4][1]), (None, None), (77, LONG)]
    target = ["alpha beta x1", None, "", "gämma gämma 漢字", "alpha"]
    table = spark.createDataFrame([(i, t, 9, "r") for i, t in rows], "doc_id long, text string, score int, rank string")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resampling.resample(table, aims).collect()
    scored, drawn = brute_resampling(rows, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(s[:4] for s in scored)
    ranked = sorted((r.rank, -r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [x[0] for x in ranked] == list(range(1, len(drawn) + 1)) and [x[1:] for x in ranked] == drawn
    assert importance_resampling.resample(table.limit(0), aims).count() == 0
    assert importance_resampling.resample(table, aims.limit(0)).count() == len(rows)
    assert all(r["rank"] is None for r in importance_resampling.resample(table.where("doc_id = 2"), aims).collect())


def test_ranks_of_one_score_follow_ids(spark):
    rows = [(i % 50, 1, 2, 3, True) for i in range(200)] + [(900, 1, 2, 9, True), (901, 1, 2, 99, False)]
    got = importance_resampling.draw_highest(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean"), 50).collect()
    ranks = sorted((r["rank"], r.doc_id) for r in got if r["rank"] is not None)
    assert ranks == [(1, 900)] + [(i + 2, i // 4) for i in range(99)] and len(got) == 202


# 13 spelling variants


def brute_variants(rows, every=97, least_chars=5, least=3):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_chars and n >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        own = sorted((-words[x], x) for x in words if x != w and near(w, x))
        form[w] = own[0][1] if own and -own[0][0] >= 2 * n else None
        out[w] = len(own)
    found = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return found


@pytest.mark.parametrize("block", [2, 256])
@pytest.mark.parametrize("every", [2, 97])
def test_variants_match_brute_force(spark, block, every):
    rng = np.random.default_rng(block + every)
    stems = ["abcde", "abcdef", "aaaaa", "aaaaaa", "straße", "éàüöñ", "Éàüöñ", "xabcde", "bcdefg", "m×n÷pq", "short", "shirt", "shorts", "z" * 300, "z" * 299 + "y"]
    rows = []
    for i in range(150):
        words = []
        for stem in rng.choice(stems, 12):
            w = list(stem)
            if rng.random() < 0.4:
                w[rng.integers(len(w))] = rng.choice(list("abxyzé"))
            words.append("".join(w))
        rows.append((int(i % 40), rng.choice(["1", ", ", " "]).join(words)))
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, "abcde " * 50), (5, "abcde " * 50)]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, form int")
    got = spelling_variants.group_variants(table, every=every, block=block).collect()
    assert len(got) > 50 and {tuple(r) for r in got} == brute_variants(rows, every)
    assert len(got) == len({r.word for r in got})
    assert spelling_variants.group_variants(table.limit(0)).count() == 0


def test_a_crowded_family_keeps_all_its_pairs(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [("same" + a + b + "tail", 3) for a in letters for b in letters]
    pairs = spelling_variants.near_words(spark.createDataFrame(words, "word string, n long"), block=20)
    n = Counter(r.word for r in pairs.collect())
    assert len(n) == 676 and set(n.values()) == {50}


def test_chains_lead_to_their_ends(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w5")]
    got = {r.word: r.root for r in spelling_variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w11" for w, _ in forms}


def test_a_full_table_keeps_the_words_at_hand(monkeypatch):
    from tabulon.llm import sentencepiece_codec

    tool, made = sentencepiece_codec.codec(sentencepiece_codec.MODEL, "bpe"), []
    encode = tool.encode_sorted
    monkeypatch.setattr(tool, "encode_sorted", lambda words: made.extend(words) or encode(words), raising=False)
    monkeypatch.setattr(sentencepiece_codec, "KEPT_WORDS", 5)
    parts = [["the red tea"], ["the red cup and"], ["the red jug"], ["a  b\nthe"]]
    table = {}
    got = [x for part in parts for x in sentencepiece_codec.encode_texts(tool, part, table)]
    assert got == [sentencepiece_codec.encode_texts(tool, part, {})[0] for part in parts]
    count = made[: len(made) - sum(len(set(tool.split(p[0]))) for p in parts)]
    assert count.count("▁the") == 1 and count.count("▁red") == 1 and len(table) <= 5
