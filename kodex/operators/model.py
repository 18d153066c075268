"""The boundary to a model: distinct prompts, one retry, replies as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodex.operators.classify import violation
from kodex.schema import MODEL_LABELS
from kodex.session import stage


def unasked(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per cache_key of prompts that the cache lacks: a question asked by many edges is put once."""
    once = prompts.groupBy("cache_key").agg(F.min(F.struct("prompt", "context_text")).alias("_p")).select("cache_key", "_p.*")
    return once.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def _replies(prompts: DataFrame, call: Callable[[str], str], attempt: int) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "attempt": attempt, "reply": [call(p) for p in pdf["prompt"]]})

    # written at once, so that a lost executor doesn't put a question again that was answered
    return stage(prompts.select("cache_key", "prompt").mapInPandas(batches, "cache_key string, attempt int, reply string"))


def judged_replies(replies: DataFrame, prompts: DataFrame, field: str, allowed: list[str]) -> DataFrame:
    """replies (cache_key, attempt, reply) with `violation` against the context of their key's prompt, null where there is none."""
    return replies.join(prompts.select("cache_key", "context_text"), "cache_key").withColumn("violation", violation(F.col("reply"), F.col("context_text"), field, allowed)).drop("context_text")


def answered(prompts: DataFrame, cache: DataFrame, call: Callable[[str], str], field: str = "label", allowed: list[str] = MODEL_LABELS) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected) of (cache_key, prompt, context_text): the loop of cache, question, one retry.

    A cached reply (cache: cache_key, reply, created_at; the newest of a key) passes the gate again before it counts, as the
    context may have changed; one that fails is asked for anew. Each key is asked once, and once more with what was wrong.
    answers: cache_key, reply, attempt (0: from the cache), all good, those of attempt 1 and 2 to be put into the cache.
    rejected: cache_key, violation of the last attempt, of the keys without an answer. Prompts without a key are left out.
    """
    once = stage(unasked(prompts.filter("cache_key is not null"), cache.limit(0)))
    newest = cache.groupBy("cache_key").agg(F.max_by("reply", F.struct("created_at", "reply")).alias("reply")).withColumn("attempt", F.lit(0))
    kept = stage(judged_replies(newest.select("cache_key", "attempt", "reply"), once, field, allowed).filter("violation is null"))
    asked = stage(judged_replies(ask(once.join(kept, "cache_key", "left_anti"), call, field, allowed), once, field, allowed))
    good = asked.filter("violation is null").groupBy("cache_key").agg(F.min(F.struct("attempt", "reply")).alias("_r")).select("cache_key", "_r.reply", "_r.attempt")
    last = asked.groupBy("cache_key").agg(F.max_by("violation", "attempt").alias("violation"), F.count_if(F.col("violation").isNull()).alias("_good")).filter("_good = 0")
    return kept.select("cache_key", "reply", "attempt").unionByName(good), last.select("cache_key", "violation")


def ask(prompts: DataFrame, call: Callable[[str], str], field: str = "label", allowed: list[str] = MODEL_LABELS) -> DataFrame:
    """(cache_key, attempt, reply): the model's reply to each prompt, and a second one where the gate rejects the first.

    prompts: cache_key, prompt, context_text. `call` takes a prompt and gives JSON text; it runs in the Python workers. The
    second prompt states what was wrong. Replies are not judged here: `judged` and `judged_pairs` pass them through the gate.
    """
    first = _replies(prompts, call, 1)
    wrong = first.join(prompts, "cache_key").withColumn("_v", violation(F.col("reply"), F.col("context_text"), field, allowed)).filter("_v is not null")
    again = F.concat("prompt", F.lit("\n\nYour previous answer was rejected: "), "_v", F.lit("\nReturn one JSON object of the same shape, its span copied from the context."))
    return first.unionByName(_replies(wrong.select("cache_key", again.alias("prompt")), call, 2))
