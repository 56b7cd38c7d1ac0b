"""Quotes sought in a whole corpus, against looking for each in each turn."""

import random

from tabulon.operators import quotes as Q


def test_quotes_in_a_corpus_match_brute_force(spark):
    rng = random.Random(3)
    letters = "ab cé漢. "
    turns = [(d, i, rng.choice(["participant", "moderator"]), "".join(rng.choice(letters) for _ in range(rng.randrange(0, 120)))) for d in range(12) for i in range(15)]
    turns += [(50, 0, "participant", None), (50, 1, "participant", ""), (51, 0, "participant", turns[3][3]), (51, 0, "participant", turns[3][3])]
    quotes = []
    for n in range(120):
        text = rng.choice(turns)[3] or ""
        at = rng.randrange(0, max(1, len(text) - 8))
        quotes.append((n, text[at : at + rng.randrange(5, 40)]))
    quotes += [(500, "not said by anybody here"), (501, None), (502, ""), (503, "short"), (504, quotes[0][1]), (505, "“Curly” – quotes")]
    turns.append((60, 2, "participant", 'He said "curly" - quotes, and more'))
    plain = lambda t: " ".join((t or "").lower().split())
    want = {}
    for n, q in quotes:
        q = plain((q or "").translate(str.maketrans("“”–", '""-')))
        hits = [(r == "moderator", d, i) for d, i, r, t in turns if len(q) >= Q.FRAGMENT_LEAST and q in plain(t)]
        if hits:
            want[n] = min(hits)[1:]
    frames = spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(turns, "doc long, idx long, role string, text string")
    got = {r.quote_id: (r.doc, r.idx) for r in Q.quotes_in_corpus(*frames).collect()}
    assert got == want and len(want) > 60 and 505 in want
    assert Q.quotes_in_corpus(frames[0].limit(0), frames[1]).count() == 0 == Q.quotes_in_corpus(frames[0], frames[1].limit(0)).count()
