"""Mixing sources to target weights by entropy balancing.

Every document of a listed source gets a rate, the number of times it is to appear. Among all rates that give each source its
tokens and stay between 0 and the source's repeat cap, the ones closest to "each document once" in relative entropy are

    rate = min(cap, exp(lambda_source * tokens / mean_tokens_source)),

and the lambdas solve a convex dual. Newton steps on it need two sums per source and step; they are taken over the table of
distinct (source, tokens) with its counts, which one pass over the documents fills and which is far smaller than the corpus. The
rates are then rounded into copies: the whole part, and one more copy for the documents with the lowest hash / fraction until the
source's tokens are met; the limit is narrowed by a few passes that count all sources at once.

No shuffle carries rows of documents; what comes to the driver is a few numbers per row of the target table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .bpe import VOCABULARY, token_counts

#: Relative error of a source's expected tokens at which the Newton steps stop, and their largest number.
TOLERANCE, STEPS = 1e-9, 60
#: Rounding: limits tried per source and pass, and passes.
_LIMITS, _PASSES = 32, 5


class NotConverged(RuntimeError):
    """The steps for the weights ran out before a source met its goal."""


@dataclass(frozen=True)
class Weighted:
    """What is known of one source. ``lam`` and ``limit`` stay None where nothing of it is taken."""

    source: str
    share: float
    cap: int
    docs: int
    tokens: int
    goal: float
    lam: float | None
    limit: float


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, cap). One row per source; of repeated rows the largest share counts, null or negative values are 0."""
    rows = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("m"))).alias("x"))
        .select("source", "x.s", "x.m")
    )
    return {r[0]: (max(0.0, r[1]) if math.isfinite(r[1]) else 0.0, max(0, int(r[2]))) for r in rows.collect()}


def _rate(lam, cap, tokens, mean):
    """The rate as a column; exponents are kept where exp is finite."""
    return F.least(cap.cast("double"), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * tokens / mean))))


def _solve(histogram: DataFrame, sizes: dict, goals: dict, caps: dict) -> dict[str, float]:
    """lambda per source: safeguarded Newton steps on the dual, all sources in one aggregation per step.

    Raises `NotConverged` if a source's tokens aren't within TOLERANCE of its goal after STEPS."""
    spark = histogram.sparkSession
    low = {s: -math.inf for s in goals}
    high = {s: math.inf for s in goals}
    lam = {s: 0.0 for s in goals}
    done: set[str] = set()
    for taken in range(STEPS + 1):
        todo = [s for s in goals if s not in done]
        if not todo:
            break
        if taken == STEPS:
            raise NotConverged(f"{STEPS} steps didn't meet the goals of {', '.join(map(repr, sorted(todo)))}")
        now = spark.createDataFrame([(s, lam[s], caps[s], sizes[s][1] / sizes[s][0]) for s in todo], "source string, lam double, cap int, mean double")
        r = _rate(F.col("lam"), F.col("cap"), F.col("tokens"), F.col("mean"))
        sums = (
            histogram.join(F.broadcast(now), "source")  # one row per row of the target table
            .select("source", (r * F.col("tokens") * F.col("n")).alias("f"), F.when(r < F.col("cap"), r * F.col("tokens") * F.col("tokens") / F.col("mean") * F.col("n")).alias("h"))
            .groupBy("source").agg(F.sum("f").alias("f"), F.coalesce(F.sum("h"), F.lit(0.0)).alias("h"))
        )
        for s, f, h in sums.collect():
            miss = f - goals[s]
            if abs(miss) <= TOLERANCE * goals[s]:
                done.add(s)
                continue
            if miss < 0:
                low[s] = max(low[s], lam[s])
            else:
                high[s] = min(high[s], lam[s])
            step = lam[s] - miss / h if h > 0 else math.inf * (-1 if miss > 0 else 1)
            if not low[s] < step < high[s] or abs(step - lam[s]) > 4:
                a = low[s] if math.isfinite(low[s]) else min(lam[s], high[s]) - 4
                b = high[s] if math.isfinite(high[s]) else max(lam[s], low[s]) + 4
                step = (a + b) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else (a if miss > 0 else b)
            lam[s] = step
    return lam


def _priority():
    """Hash of the document in (0, 1) over the fraction of its rate: the order in which documents get one more copy."""
    u = (F.pmod(F.xxhash64("doc_id", "source", F.lit(7)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.when(F.col("frac") > 0, u / F.col("frac"))


def _limits(rated: DataFrame, goals: dict[str, float]) -> dict[str, float]:
    """Per source the highest priority that still gets one more copy, so that the tokens come closest to the goal."""
    spark = rated.sparkSession
    base = {r[0]: r[1] for r in rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens"))).collect()}
    need = {s: goals[s] - base.get(s, 0) for s in goals}
    span = {s: (0.0, 4.0) for s in goals}
    for _ in range(_PASSES):
        edges = {s: [a + (b - a) * i / _LIMITS for i in range(_LIMITS + 1)] for s, (a, b) in span.items()}
        now = spark.createDataFrame([(s, e[0], (e[-1] - e[0]) / _LIMITS) for s, e in edges.items()], "source string, start double, width double")
        bucket = F.when(F.col("priority") <= F.col("start"), F.lit(-1)).otherwise(F.least(F.lit(_LIMITS), F.ceil((F.col("priority") - F.col("start")) / F.col("width")) - 1)).cast("int")
        sums = rated.where("priority is not null").join(F.broadcast(now), "source").groupBy("source", bucket.alias("b")).agg(F.sum("tokens").alias("t")).collect()
        got: dict[str, dict[int, int]] = {}
        for s, b, t in sums:
            got.setdefault(s, {})[b] = t
        for s, e in edges.items():
            reached = got.get(s, {}).get(-1, 0)
            for i in range(_LIMITS):
                more = reached + got.get(s, {}).get(i, 0)
                if more >= need[s]:
                    # the last pass decides for the nearer end, the others narrow the span
                    span[s] = (e[i], e[i + 1]) if _ + 1 < _PASSES else ((e[i],) * 2 if need[s] - reached < more - need[s] else (e[i + 1],) * 2)
                    break
                reached = more
            else:
                span[s] = (e[-1], e[-1]) if _ + 1 == _PASSES else (e[-1], e[-1] + (e[-1] - e[0]))
    return {s: b for s, (_, b) in span.items()}


def plan_mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[Weighted]]:
    """The table ``(doc_id, source, tokens, rate, copies)`` of all documents with tokens of listed sources, and the plan per source.

    ``total_tokens`` is the size of the mix that the shares refer to; by default all tokens of the listed sources. A source that
    can't fill its share even with every document at the cap gives all it has; the others aren't raised for it, so that every
    source stays as near to its share as it can. Names are compared byte for byte; documents of other sources, without source,
    or with an empty or null text, aren't used. Rows of the same doc_id count as documents of their own.
    """
    wanted = _targets(targets)
    spark = documents.sparkSession
    counted = materialize(token_counts(documents.where(F.col("source").isNotNull()), vocabulary).where("tokens > 0"), "tokens")
    names = spark.createDataFrame([(s,) for s in wanted] or [], "source string")
    used = counted.join(F.broadcast(names), "source")
    histogram = materialize(used.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = {r[0]: (r[1], r[2]) for r in histogram.groupBy("source").agg(F.sum("n"), F.sum(F.col("n") * F.col("tokens"))).collect()}
    total = float(sum(t for _, t in sizes.values())) if total_tokens is None else float(total_tokens)
    goals, full = {}, set()
    for s, (share, cap) in wanted.items():
        if s in sizes and share > 0 and cap > 0:
            goals[s] = min(share * total, float(cap * sizes[s][1]))
            if goals[s] >= cap * sizes[s][1]:
                full.add(s)
    caps = {s: wanted[s][1] for s in goals}
    lam = _solve(histogram, sizes, {s: g for s, g in goals.items() if s not in full}, caps)
    rows = [(s, lam.get(s), caps[s], sizes[s][1] / sizes[s][0]) for s in goals]
    rates = spark.createDataFrame(rows, "source string, lam double, cap int, mean double")
    rate = F.when(F.col("lam").isNull(), F.col("cap").cast("double")).otherwise(_rate(F.col("lam"), F.col("cap"), F.col("tokens"), F.col("mean")))
    rated = (
        used.join(F.broadcast(rates), "source")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("frac", F.col("rate") - F.col("whole"))
        .withColumn("priority", _priority())
    )
    limit = _limits(rated, {s: g for s, g in goals.items() if s not in full}) if len(full) < len(goals) else {}
    ends = spark.createDataFrame([(s, limit.get(s, 0.0)) for s in goals], "source string, limit double")
    copies = (
        rated.join(F.broadcast(ends), "source")
        .select("doc_id", "source", "tokens", "rate", (F.col("whole") + F.when(F.col("priority") <= F.col("limit"), 1).otherwise(0)).cast("int").alias("copies"))
    )
    plan = [
        Weighted(s, share, cap, *sizes.get(s, (0, 0)), goals.get(s, 0.0), lam.get(s), limit.get(s, 0.0))
        for s, (share, cap) in sorted(wanted.items())
    ]
    return copies, plan


def mix_copies(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, rate, copies)`` of every usable document, with 0 copies where it stays out. See `plan_mix`."""
    return plan_mix(documents, targets, total_tokens, vocabulary)[0]


def mix_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per source of ``targets`` with what it was to give and what it gives.

    ``actual_share`` is the part of all tokens in the mix, ``filled`` the part of the source's own goal share * total; both are 0
    where there is nothing to divide by. Sources without documents have a row too.
    """
    spark = documents.sparkSession
    copies, plan = plan_mix(documents, targets, total_tokens, vocabulary)
    used = copies.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") > 0).alias("documents_used")
    )
    total = sum(p.tokens for p in plan) if total_tokens is None else total_tokens
    known = spark.createDataFrame(
        [(p.source, p.share, p.cap, p.docs, p.tokens, p.share * total) for p in plan],
        "source string, target_share double, max_repeats int, documents bigint, tokens bigint, target_tokens double",
    )
    joined = known.join(F.broadcast(used), "source", "left").fillna(0, ["mixed_tokens", "most_copies", "documents_used"])
    whole = joined.agg(F.sum("mixed_tokens").alias("whole"))
    return joined.crossJoin(F.broadcast(whole)).select(  # one row beside at most one per source
        "source", "target_share", "max_repeats", "documents", "tokens", "target_tokens", "documents_used", "most_copies", "mixed_tokens",
        F.when(F.col("whole") > 0, F.col("mixed_tokens") / F.col("whole")).otherwise(0.0).alias("actual_share"),
        F.when(F.col("target_tokens") > 0, F.col("mixed_tokens") / F.col("target_tokens")).otherwise(0.0).alias("filled"),
    )
