"""Rounding, coercion, missing values and text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as missing after trimming and lower-casing.
MISSING = ("", "na", "n/a", "nan", "null", "#n/a", ".")
#: Words that never tell two statements apart.
STOPWORDS = (
    "the a an of in on for to and or is are was were has have had that this these those by with as at its it their among between than most least more less not be which who".split()
)
#: Blanks as JavaScript's \s knows them.
BLANK = r"[\s   -     　﻿]"
_WORD = "[^" + BLANK[1:]


def strip(x: Column) -> Column:
    """Without the blanks at both ends."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")


def jround(x: Column, digits: int = 0) -> Column:
    """Half rounds up, towards plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def num_to_text(x: Column) -> Column:
    """A double as a survey tool prints it: integral values without a fraction, no exponents for numbers of a few decimals."""
    plain = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    shown = F.when((F.abs(x) >= 1e7) | (F.abs(x) < 1e-3), plain).otherwise(x.cast("string"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(shown)


def is_missing(x: Column) -> Column:
    """Null, blank, or one of the texts that stand for nothing."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*MISSING), F.lit(True))


def as_number(x: Column, percent: bool = False) -> Column:
    """Number of a text without thousands commas (and one trailing % if asked); null if it isn't one."""
    text = F.trim(F.regexp_replace(x.cast("string"), ",", ""))
    if percent:
        text = F.trim(F.regexp_replace(text, "%$", ""))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def generic_header(x: Column) -> Column:
    """Headers such as Q12 or var_3 that say nothing, and empty ones."""
    return (F.trim(x) == "") | F.trim(x).rlike(r"(?i)^(var|v|q|col|column|field|x)[\s_]*\d+$")


def normalize_text(x: Column) -> Column:
    """Straight quotes and hyphens for curly ones and dashes, no soft hyphens, single blanks, lower case."""
    text = F.replace(F.translate(x, "‘’“”–—", "''\"\"--"), F.lit("\u00ad"), F.lit(""))
    return F.trim(F.lower(F.regexp_replace(text, BLANK + "+", " ")))


def normalize_page(x: Column) -> Column:
    """As ``normalize_text``, with ligatures of fi and fl taken apart and words joined that a line break parts."""
    text = F.replace(F.replace(x, F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))
    joined = F.regexp_replace(F.replace(F.translate(text, "–—", "--"), F.lit("\u00ad"), F.lit("")), rf"-{BLANK}*\n{BLANK}*", "")
    return normalize_text(joined)


def statement_tokens(x: Column) -> Column:
    """Distinct words of a statement: letters, digits, % and dots, two characters or more, no stopwords."""
    words = F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9%.\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def echo_words(x: Column) -> Column:
    """Distinct lower-case words longer than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}']+"), lambda w: F.length(w) > 2))


def count_words(x: Column) -> Column:
    """Blank-separated pieces with a letter or digit."""
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def count_sentences(x: Column) -> Column:
    """Stretches between sentence marks that end a word; at least one."""
    parts = F.filter(F.split(F.coalesce(x, F.lit("")), r"[.!?]+(?:\s|$)"), lambda s: F.trim(s) != "")
    return F.greatest(F.lit(1), F.size(parts))


def split_keywords(x: Column) -> Column:
    """Distinct terms of a keyword cell: the quoted ones if any are, else the parts between commas, semicolons, lines or bars; 80 characters at most."""
    quoted = F.regexp_extract_all(x, F.lit("[\"“”]([^\"“”]+)[\"“”]"), F.lit(1))
    parts = F.when(F.size(quoted) > 0, quoted).otherwise(F.split(x, r"[,;\n|]"))
    return F.array_distinct(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (s != "") & (F.length(s) <= 80)))


def keyword_count(text: Column, keyword: Column) -> Column:
    """Whole-word, case-blind occurrences of a keyword."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(keyword), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.regexp_count(F.lower(text), pattern)


def code_key(x: Column) -> Column:
    """A name's key: trimmed, single blanks, lower case."""
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def slug(x: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, 60 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))


def split_numbered(x: Column) -> Column:
    """Lines of a numbered block, their numbers taken off; blank lines dropped, a bare number leaves an empty item."""
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), r"\n"), strip)
    return F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.regexp_replace(s, rf"^\d+\.{BLANK}*", ""))


def join_numbered(items: Column) -> Column:
    """The reverse: one item stands alone, several are numbered from 1."""
    lines = F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.when(F.size(items) == 1, items[0]).otherwise(F.array_join(lines, "\n"))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of a text."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("bigint"))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(4294967296)))


def ordered_list(value: Column, *keys: Column) -> Column:
    """array_agg(value order by keys), nulls of value kept."""
    rows = F.sort_array(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cap_words(text: Column, budget: Column) -> Column:
    """At most ``budget`` words: cut behind the last sentence that fits and keeps three fifths of it, else hard with an ellipsis.

    Words are split once and no further than needed: a lambda's inside is worked
    out anew for each of its elements.
    """

    def cut_at(said: Column, words: Column, last: Column) -> Column:
        behind = F.regexp_substr(said, F.concat(F.lit(f"^(?:{_WORD}+{BLANK}+){{"), (last - 1).cast("string"), F.lit(f"}}{_WORD}+")))
        hard = F.concat(F.array_join(F.slice(words, F.lit(1), budget), " "), F.lit("…"))
        return F.when(F.size(words) <= budget, said).when(last.isNotNull(), behind).otherwise(hard)

    def last_end(words: Column) -> Column:
        """The place of the last word that ends a sentence and keeps enough, null if there is none."""
        return F.array_max(F.transform(F.slice(words, F.lit(1), budget), lambda w, i: F.when((i + 1 >= budget * 0.6) & w.rlike(r"[.!?]$"), i + 1)))

    return _let(strip(F.coalesce(text, F.lit(""))), lambda said: _let(F.split(said, BLANK + "+", budget + 1), lambda words: _let(last_end(words), lambda last: cut_at(said, words, last))))
