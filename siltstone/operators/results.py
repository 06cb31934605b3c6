"""Merging verdicts with local evidence, ordering results, rolling up costs, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.vocabulary import RESULTS, THRESHOLD


#: How an entry's contents were seen.
COVERAGES = ("text", "sampled", "folder", "unavailable", "name_only", "protected")


def merge_evidence(evidence: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a path: the last verdict decides, and local evidence counts only where there is none.

    ``evidence`` has path, seq, probability (null for local evidence) and score.  A path whose last verdict is under the
    threshold goes."""
    is_verdict = F.col("probability").isNotNull()
    best = F.max_by(F.struct("probability", "score"), F.struct(is_verdict.alias("v"), F.col("seq").alias("s")))
    merged = evidence.groupBy("path").agg(best.alias("b")).select("path", "b.probability", "b.score")
    return merged.where(F.col("probability").isNull() | (F.col("probability") >= threshold))


def result_order() -> list[Column]:
    """Verified first, then rank, the shallower, the newer, and the path."""
    return [F.desc(F.col("probability").isNotNull()), F.desc("rank"), F.col("depth"), F.desc(F.coalesce("modified", F.lit(0.0))), F.col("path")]


def ordered(hits: DataFrame, limit: int = RESULTS) -> DataFrame:
    return hits.orderBy(*result_order()).limit(limit)


def verified_counts(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count_if(F.col("probability").isNotNull()).alias("verified"), F.count_if(F.col("probability").isNull()).alias("unverified"))


def valid_cost(cost: Column) -> Column:
    """A reported cost as a number if it is finite and not negative, else null."""
    value = cost.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), value)


def cost_rollup(calls: DataFrame) -> DataFrame:
    """cost, requests, reports and unreported over judge calls with a cost string each."""
    value = valid_cost(F.col("cost"))
    return calls.agg(
        F.coalesce(F.round(F.sum(value), 6), F.lit(0.0)).alias("cost"), F.count(F.lit(1)).alias("requests"), F.count(value).alias("reports"), F.count_if(value.isNull()).alias("unreported")
    )


#: Phases in which a search goes on, and in which its costs may lack some.
RUNNING, UNSURE = ("starting", "scanning", "thinking"), ("stopped", "partial", "error")


def cost_label(cost: Column, reports: Column, unreported: Column, phase: Column) -> Column:
    """Struct of label and value: what a search cost so far, or that nothing says so."""
    amount = F.when(valid_cost(cost.cast("string")).isNotNull(), cost).otherwise(0.0)
    nothing = (unreported > 0) & (reports == 0)
    unsure = (unreported > 0) | phase.isin(*UNSURE)
    label = F.when(nothing, "Cost unavailable").when(unsure, "Reported cost").when(phase.isin(*RUNNING), "Cost so far").otherwise("Search cost")
    shown = F.when((amount > 0) & (amount < 0.0001), "<$0.0001").otherwise(F.concat(F.lit("$"), F.format_string("%.4f", amount)))
    return F.struct(label.alias("label"), F.when(nothing, "—").otherwise(shown).alias("value"))


def route_counts(chosen: DataFrame) -> DataFrame:
    """How many candidates each route gave."""
    return chosen.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def byte_counts(texts: DataFrame, text: str = "text", budget: int | None = None) -> DataFrame:
    """One row: bytes of all texts, of the largest, and whether they keep within a budget."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return texts.agg(total.alias("bytes"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest"), (F.lit(True) if budget is None else total <= budget).alias("within"))


def coverage_counts(records: DataFrame) -> DataFrame:
    """How many records were read, sampled, unavailable, known by name only, or protected."""
    is_ = lambda name: F.count_if(F.col("coverage") == name).alias(name)
    return records.agg(F.count(F.lit(1)).alias("scanned"), *[is_(c) for c in ("text", "sampled", "unavailable", "name_only", "protected")])


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: queries, ndcg_10, hit_5 and recall_100 with binary gains; ``ranked`` has query, doc and rank (from 1)."""
    r = relevant.select("query", "doc").distinct()
    per = r.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.join(r, ["query", "doc"], "left_semi")
    gain = F.when(F.col("rank") <= 10, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    got = hits.groupBy("query").agg(F.sum(gain).alias("dcg"), F.max((F.col("rank") <= 5).cast("int")).alias("hit"), F.count_if(F.col("rank") <= 100).alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / F.log2(k + F.lit(1.0)))
    both = per.join(got, "query", "left").na.fill(0)
    return both.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg_10"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_5"),
        F.round(F.avg(F.col("found") / F.col("n")), 6).alias("recall_100"),
    )
