"""Mix sources to target shares of a token total, repeating documents within limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodex.llm.flow import Flow
from kodex.llm.tokens import FOLDER, count
from kodex.session import stage, widened

TOKENIZER = "byte_bpe_50k.tiktoken"
SEED = 42
#: Hash ranges into which a pattern's documents are cut for their prefix sums, so that no task holds a whole pattern.
RANGES = 4096


def sized_texts(documents: DataFrame, sources: DataFrame, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """(h, n_tokens, members array<struct<source, doc_id>>, pattern): one row per distinct text of the given sources.

    Copies of a text under several sources make its membership pattern; in each source its least doc_id stands for it.
    Null and empty texts have no tokens and are left out, as are rows without an id or source.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "h": pdf["h"], "n_tokens": count(pdf["text"].tolist(), tokenizer, folder)})

    rows = documents.join(F.broadcast(sources.select("source").distinct()), "source").filter(F.length("text") > 0).filter("doc_id is not null")
    # the text itself isn't shuffled: two independent 64-bit hashes stand for it
    rows = rows.select("doc_id", "source", F.concat_ws("-", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("h"), "text")
    rows = widened(rows).mapInPandas(batches, "doc_id long, source string, h string, n_tokens long")
    per_source = rows.groupBy("h", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = per_source.groupBy("h").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"))
    return texts.withColumn("pattern", F.array_join("members.source", "\x1f"))


def _solve(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int], bool]:
    """Route pattern tokens to quotas: the flow by (pattern, source), and whether every quota is met."""
    g, arcs = Flow(), {}
    quotas = {s: round(total * share) for s, (share, _) in targets.items()}
    for p, tokens in patterns.items():
        for use in range(max(targets[s][1] for s in p)):  # the n-th use of the same tokens costs n: convex
            g.arc("from", p, tokens, use + 1)
        for s in p:
            arcs[p, s] = g.arc(p, s, tokens * targets[s][1])
    for s, q in quotas.items():
        g.arc(s, "to", q)
    sent = g.run("from", "to")
    return sent, {k: g.left[e + 1] for k, e in arcs.items()}, sent == sum(quotas.values())


def plan(sizes: list[tuple[str, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[list[tuple[str, str]], list[tuple[str, str, int, int, int]]]:
    """(pattern, line) of each pattern and (line, source, the line's tokens, first token, tokens) of each allocation.

    A line is the set of target sources that a pattern's texts may count for.

    Without a total, the greatest is taken at which every source that has documents meets its share, the shares of the
    others being spread over it in proportion. With a total that can't be met, each source gets what it can.
    """
    have = {s for p, n in sizes for s in p.split("\x1f") if n > 0}
    targets = {s: v for s, v in targets.items() if s in have and v[0] > 0 and v[1] > 0}
    whole = sum(share for share, _ in targets.values())
    targets = {s: (share / whole, repeats) for s, (share, repeats) in targets.items()}
    patterns: dict[tuple[str, ...], int] = {}
    named: dict[str, tuple[str, ...]] = {}
    for p, n in sorted(sizes):
        of = tuple(s for s in p.split("\x1f") if s in targets)
        if of and n > 0:
            named[p] = of
            patterns[of] = patterns.get(of, 0) + n
    if not patterns:
        return [], []
    if total is None:
        low, high = 0, sum(n * max(targets[s][1] for s in p) for p, n in patterns.items())
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if _solve(patterns, targets, middle)[2] else (low, middle - 1)
        total = low
    _, flow, _ = _solve(patterns, targets, total)
    first: dict[tuple[str, ...], int] = {}
    out = []
    for (of, s), n in sorted(flow.items()):
        if n:
            out.append(("\x1f".join(of), s, patterns[of], first.get(of, 0), n))
            first[of] = first.get(of, 0) + n
    return [(p, "\x1f".join(of)) for p, of in named.items()], out


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, folder: str = FOLDER, max_patterns: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents to take and how often, so that each source has its share of the tokens.

    A minimum-cost flow over all membership patterns (the sets of target sources that a text occurs in: at most 2^sources)
    decides how many tokens of each pattern go to which source; only these sums reach the driver. `max_patterns`, off by
    default, is a bound on their number that is checked before they are collected and raises where it is exceeded; it never
    changes a result. Documents are then laid out in seeded order, and
    those that begin within a source's stretch of the line are taken, each pass over a pattern being one use of its texts.
    A text is used at most as often as the source it counts for allows. Shares differ from the target by less than one
    document per allocation. A source without documents gives nothing; documents of other sources, of none, or without
    text are not used; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    goal = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source is not null and target_share is not null and max_repeats is not null").select("source", "target_share", "max_repeats").collect()}
    texts = stage(sized_texts(documents, targets, tokenizer, folder))
    per = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n"))
    if max_patterns is not None and (found := per.count()) > max_patterns:
        raise ValueError(f"{found} membership patterns are more than max_patterns")
    sizes = [(r["pattern"], r["n"]) for r in per.collect()]
    lines, allocations = plan(sizes, goal, total)
    parts = F.broadcast(spark.createDataFrame(allocations, "line string, source string, size long, first long, tokens long"))
    rows = texts.join(F.broadcast(spark.createDataFrame(lines, "pattern string, line string")), "pattern")
    rows = rows.withColumn("_o", F.xxhash64(F.lit(seed), "h")).withColumn("_b", F.pmod(F.shiftrightunsigned("_o", 40), F.lit(RANGES)))
    ranges = rows.groupBy("line", "_b").agg(F.sum("n_tokens").alias("_n"))
    ranges = ranges.withColumn("_before", F.sum("_n").over(Window.partitionBy("line").orderBy("_b")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("line", "_b").orderBy("_o", "h")
    rows = rows.withColumn("_at", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(ranges, ["line", "_b"]).withColumn("_at", F.col("_at") + F.col("_before"))
    rows = rows.join(parts, "line")
    passes = lambda upto: F.greatest(F.lit(0), F.ceil((upto - F.col("_at")) / F.col("size")))
    taken = rows.withColumn("repeats", (passes(F.col("first") + F.col("tokens")) - passes(F.col("first"))).cast("int")).filter("repeats > 0")
    doc = F.expr("filter(members, m -> m.source = source)[0].doc_id")
    return taken.select(doc.alias("doc_id"), "source", "n_tokens", "repeats")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, max_used, tokens, actual_share) of every target source, also of those without documents."""
    sums = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("max_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    rows = targets.select("source", "target_share").join(F.broadcast(sums), "source", "left").fillna(0, ["documents", "max_used", "tokens"])
    whole = F.broadcast(rows.agg(F.sum("tokens").alias("_all")))
    return rows.join(whole).withColumn("actual_share", F.round(F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)), 6)).drop("_all")
