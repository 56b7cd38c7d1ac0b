"""Resumable requests and the rules of answers: runs that break off, answers that can't be used, values of the wrong kind."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.operators import judge as J
from tabulon.operators import validators as W


def requests(spark, n=5, run=1):
    items = spark.createDataFrame([(run, i, i) for i in range(n)], "run_id long, item_id long, at long")
    return J.numbered_requests(items, "verify_findings", ["at"], F.concat(F.lit("finding "), F.col("item_id").cast("string")), 2, 4)


def good(prompts):
    return [json.dumps({"verdicts": [{"index": 0, "verdict_tier": "robust", "rationale": "r"}]}) for _ in prompts]


def never(prompts):
    raise AssertionError("asked again")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_requests_number_their_lines_up_to_the_cap(spark):
    got = sorted((r.chunk, r.n, r["items"], r.prompt) for r in requests(spark).collect())
    assert got == [(0, 2, [0, 1], "0. finding 0\n1. finding 1"), (1, 2, [2, 3], "0. finding 2\n1. finding 3")]
    assert requests(spark, 0).count() == 0


def test_a_second_run_asks_nothing(spark, tmp_path):
    folder = str(tmp_path / "answers")
    first = J.judge_into(folder, requests(spark), good, W.judged_findings)
    assert rows(first, "attempt", "accepted") == Counter({(1, True): 2})
    assert J.judge_into(folder, requests(spark), never, W.judged_findings).count() == 2
    more = J.judge_into(folder, requests(spark).union(requests(spark, 1, 2)), good, W.judged_findings)
    assert more.count() == 3


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    folder = str(tmp_path / "answers")

    def half(prompts):
        return [good([p])[0] if "finding 0" in p else "no list" for p in prompts]

    assert rows(J.judge_into(folder, requests(spark), half, W.judged_findings, attempts=1), "attempt", "accepted") == Counter({(1, True): 1, (1, False): 1})

    def rest(prompts):
        assert all("finding 2" in p for p in prompts)
        return good(prompts)

    after = J.judge_into(folder, requests(spark), rest, W.judged_findings, attempts=2)
    assert rows(after, "attempt", "accepted") == Counter({(1, True): 1, (1, False): 1, (2, True): 1})
    done, failed = J.accepted_answers(requests(spark), after)
    assert done.count() == 2 and failed.count() == 0


def test_what_cannot_be_used_is_kept_and_given_up(spark):
    none = spark.createDataFrame([], J.ANSWERS)
    made = J.judge_pending(requests(spark), none, lambda prompts: [None] * len(prompts), W.judged_findings)
    assert rows(made, "attempt", "answer", "accepted") == Counter({(1, None, False): 2, (2, None, False): 2})
    assert J.judge_pending(requests(spark), made, never, W.judged_findings).count() == 0
    done, failed = J.accepted_answers(requests(spark), made)
    assert done.count() == 0 and failed.count() == 2


def test_a_provider_that_raises_stops_the_run(spark):
    with pytest.raises(Exception, match="asked again"):
        J.judge_pending(requests(spark), spark.createDataFrame([], J.ANSWERS), never, W.judged_findings)


def answer(spark, *values):
    return spark.createDataFrame([(str(i), v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "key string, answer string")


def test_values_of_another_kind_do_not_count(spark):
    asked = spark.createDataFrame([("0", 3), ("1", 3), ("2", 3)], "key string, n int")
    entry = lambda i, tier="robust", why="w": {"index": i, "verdict_tier": tier, "rationale": why}
    answers = answer(spark, {"verdicts": [entry(0), entry(0, "not_supported"), entry("1"), entry(1.5), entry(2.0), entry(3), entry(-1), entry(1, "bogus"), entry(1, why=""), entry(1, why=7), "x", None]}, "not json", {"verdicts": {"a": 1}})
    assert rows(W.judged_findings(answers, asked), "key", "index", "tier") == Counter([("0", 0, "robust"), ("0", 2, "robust")])


def test_a_failed_request_holds_its_run_back(spark):
    asked = spark.createDataFrame([("a", 1, [10, 11]), ("b", 1, [12]), ("c", 2, [20, 21])], "key string, run_id long, items array<long>")
    judged = spark.createDataFrame([("a", 0, "robust", "w"), ("c", 1, "use_with_caution", "w")], "key string, index int, tier string, rationale string")
    failed = asked.where("key = 'b'")
    got = W.pass_verdicts(judged, asked.where("key <> 'b'"), failed)
    assert rows(got, "item_id", "tier", "rationale") == Counter([(20, "insufficient_information", W.NOT_JUDGED), (21, "use_with_caution", "w")])


def test_contradictions_point_into_the_list(spark):
    asked = spark.createDataFrame([(str(i), [5, 6, 7]) for i in range(6)], "key string, claims array<long>")
    answers = answer(spark, {"contradicted_indices": [0, 2, 0, 3, -1, 1.5, "1", None], "detail": " why "}, {"contradicted_indices": [1], "detail": 4}, {"contradicted_indices": []}, {"detail": "x"}, "[1]", None)
    checked, found = W.contradiction_answers(answers, asked)
    assert rows(checked, "key") == Counter([("0",), ("1",), ("2",), ("3",)])
    assert rows(found, "key", "claim_id", "detail") == Counter([("0", 5, "why"), ("0", 7, "why"), ("1", 6, W.CONFLICT)])


def test_recommendations_need_every_text(spark):
    whole = {t: f" {t} " for t in W.ACTION_TEXTS}
    asked = spark.createDataFrame([("0", 2)], "key string, n int")
    answers = answer(spark, {"recommendations": [{"index": 0, "priority": "high", **whole}, {"index": 1, "priority": "high", **whole, "metric": " "}, {"index": 1, "priority": "urgent", **whole}, {"index": 2, "priority": "low", **whole}, {"index": 1, "priority": "low", **{**whole, "timeline": 3}}]})
    got = W.recommendation_answers(answers, asked).collect()
    assert [(r["index"], r.priority, r.metric, r.owner_role) for r in got] == [(0, "high", "metric", "owner_role")]


def test_framing_takes_texts_only(spark):
    got = W.framing_answers(answer(spark, {"business_problem": " a ", "research_objective": None}, {"business_problem": "", "research_objective": 4}, "x", None))
    assert rows(got, "key", "business_problem", "research_objective") == Counter([("0", "a", None), ("1", None, None), ("2", None, None), ("3", None, None)])
    prompts = spark.createDataFrame([("b" * 50_000, None), (None, ""), ("x", "y")], "b string, p string").select(W.framing_prompt(F.col("b"), F.col("p")).alias("t")).collect()
    assert len(prompts[0].t) == 40_014 and prompts[1].t is None and prompts[2].t == "=== BRIEF ===\nx\n\n=== PROPOSAL ===\ny"
