"""Model judgements: requests to a provider, its answers as a store that a later run goes on from, checked by deterministic rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.plans.lineage import cut

#: Scores a rubric allows.
SCORES = (1, 3, 5)
#: Times that a request is asked, and the columns of stored answers.
ATTEMPTS = 2
ANSWERS = "request_id string, agent string, attempt int, answer string, accepted boolean"


def stub_provider(prompts: list[str]) -> list[str]:
    """Deterministic answers for tests: a score of 1, 3 or 5 from a hash of the prompt."""
    return [json.dumps({"score": SCORES[int(hashlib.sha256(p.encode()).hexdigest(), 16) % 3], "rationale": "stub"}) for p in prompts]


def judge(df: DataFrame, key: str, prompt: Column, provider: Callable[[list[str]], list[str]], batch: int = 20) -> DataFrame:
    """(key, prompt_sha, answer): the provider is called in batches of rows inside each task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = [a for i in range(0, len(f), batch) for a in provider(f["prompt"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({key: f[key], "prompt_sha": f["prompt_sha"], "answer": answers})

    rows = df.select(key, prompt.alias("prompt")).withColumn("prompt_sha", F.sha2("prompt", 256))
    return rows.mapInPandas(work, f"{key} long, prompt_sha string, answer string")


def valid_scores(answers: DataFrame, key: str) -> DataFrame:
    """(key, score, rationale) of answers whose score is allowed and that give a reason; the first of each key."""
    parsed = answers.select(key, "prompt_sha", F.from_json("answer", "score int, rationale string").alias("a")).select(key, "prompt_sha", "a.*")
    fine = parsed.where(F.col("score").isin(*SCORES) & (F.trim("rationale") != ""))
    return fine.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("prompt_sha"))).where("k = 1").select(key, "score", "rationale")


def numbered_requests(items: DataFrame, agent: str, order: list[str], line: Column, size: int, most: int) -> DataFrame:
    """(request_id, agent, run_id, chunk, n, items, prompt): items (run_id, item_id, ...) of each run in order, ``size`` to a request, the first ``most`` of a run.

    A prompt numbers its lines from 0; ``items`` holds the ids in that order.  The
    request's id is a hash of agent and prompt, so equal questions are one.
    """
    placed = items.select("run_id", "item_id", line.alias("line"), F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).alias("place")).where(F.col("place") <= most)
    rows = placed.withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("int")).groupBy("run_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "item_id", "line"))).alias("l"))
    lines = F.transform("l", lambda x, i: F.concat(i.cast("string"), F.lit(". "), x["line"]))
    return with_request_ids(rows.select(F.lit(agent).alias("agent"), "run_id", "chunk", F.size("l").alias("n"), F.transform("l", lambda x: x["item_id"]).alias("items"), F.array_join(lines, "\n").alias("prompt")))


def with_request_ids(requests: DataFrame) -> DataFrame:
    """Requests (agent, prompt, ...) with the hash that names each."""
    return requests.select(F.sha2(F.concat_ws("\n", "agent", "prompt"), 256).alias("request_id"), *requests.columns)


def pending(requests: DataFrame, answers: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(request_id, agent, prompt, attempt) of requests without an accepted answer that have attempts left, each once."""
    used = answers.groupBy("request_id").agg(F.max("attempt").alias("used"), F.bool_or("accepted").alias("done"))
    both = requests.select("request_id", "agent", "prompt").dropDuplicates(["request_id"]).join(used, "request_id", "left")
    open_ = both.where(~F.coalesce("done", F.lit(False)) & (F.coalesce("used", F.lit(0)) < attempts))
    return open_.select("request_id", "agent", "prompt", (F.coalesce("used", F.lit(0)) + 1).alias("attempt"))


def ask(due: DataFrame, provider: Callable[[list[str]], list[str | None]], batch: int = 20) -> DataFrame:
    """(request_id, agent, attempt, answer): the provider is called for some prompts at a time inside each task; null is a call that failed."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = [a for i in range(0, len(f), batch) for a in provider(f["prompt"].iloc[i : i + batch].tolist())]
            yield f[["request_id", "agent", "attempt"]].assign(answer=answers)

    return due.mapInPandas(work, "request_id string, agent string, attempt int, answer string")


def judge_pending(requests: DataFrame, answers: DataFrame, provider: Callable[[list[str]], list[str | None]], usable: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = ATTEMPTS, batch: int = 20) -> DataFrame:
    """The new answers (request_id, agent, attempt, answer, accepted) to requests that the stored ones leave open.

    ``usable`` takes answers (key, answer) and requests (key, ...) and returns a
    row for each key whose answer can be used; what can't is kept too, with
    accepted false, and asked again while attempts are left.  A run that broke
    off goes on from the answers it stored, and one that is done asks nothing.
    """
    requests, made = cut(requests), answers.limit(0)
    for _ in range(attempts):
        due = cut(pending(requests, answers.unionByName(made), attempts))
        if due.isEmpty():
            break
        got = cut(ask(due, provider, batch))
        keyed = requests.withColumnRenamed("request_id", "key").dropDuplicates(["key"])
        fine = usable(got.select(F.col("request_id").alias("key"), "answer").where("answer IS NOT NULL"), keyed).select(F.col("key").alias("request_id")).distinct().withColumn("fine", F.lit(True))
        made = cut(made.unionByName(got.join(fine, "request_id", "left").select("request_id", "agent", "attempt", "answer", F.coalesce("fine", F.lit(False)).alias("accepted"))))
    return made


def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers stored in a folder of Parquet files; none where there is no folder yet."""
    try:
        return spark.read.schema(ANSWERS).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)


def judge_into(folder: str, requests: DataFrame, provider: Callable[[list[str]], list[str | None]], usable: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """All answers after the open requests were asked and theirs added to the folder."""
    spark = requests.sparkSession
    judge_pending(requests, cut(stored_answers(spark, folder)), provider, usable, attempts).write.mode("append").parquet(folder)
    return stored_answers(spark, folder)


def accepted_answers(requests: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, failed): requests with their accepted answer, and those that have none."""
    done = answers.where("accepted").groupBy("request_id").agg(F.max_by("answer", "attempt").alias("answer"))
    return requests.join(done, "request_id"), requests.join(done, "request_id", "left_anti")


def accepted_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, members) from (cluster, member): each member counts in its first cluster; two members or more make one."""
    first = clusters.groupBy("member").agg(F.min("cluster").alias("cluster"))
    return first.groupBy("cluster").agg(F.sort_array(F.collect_list("member")).alias("members")).where(F.size("members") >= 2)
