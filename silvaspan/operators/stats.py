"""Robust statistics over observation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from silvaspan.operators.ordering import sum_before
from silvaspan.scratch import Scratch


def measured(df: DataFrame, warm_up: str, failed: str) -> DataFrame:
    """Rows that are no warm-up and no failure."""
    return df.where(~F.col(warm_up) & ~F.col(failed))


def robust_summary(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, n, median, p25, p75, iqr, min, max) with exact, interpolated percentiles."""
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.min(metric).alias("min"), F.max(metric).alias("max"))
    at = [F.round(F.get("q", F.lit(k)), 6) for k in range(3)]
    return got.select(*by, "n", at[1].alias("median"), at[0].alias("p25"), at[2].alias("p75"), F.round(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), 6).alias("iqr"), "min", "max")


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """(keys, metric, value) for the named columns, or all that end in _seconds or _bytes."""
    names = metrics or [c for c in df.columns if c.endswith(("_seconds", "_bytes"))]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where("value is not null")


def summarize_observations(df: DataFrame, keys: list[str], metrics: list[str] | None = None, state: str | None = None, warm_up: str | None = None) -> DataFrame:
    """(keys, metric, n, quantiles, min, max) of all metrics; with a state column over successes alone, beside count, successes and failures of the measured rows of each key."""
    rows = df.where(~F.coalesce(F.col(warm_up), F.lit(False))) if warm_up else df
    if state is None:
        return robust_summary(unpivot_metrics(rows, keys, metrics), [*keys, "metric"], "value")
    good = F.coalesce(F.col(state) == "success", F.lit(False))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"))
    return counts.join(robust_summary(unpivot_metrics(rows.where(good), keys, metrics), [*keys, "metric"], "value"), keys)


def frame_stats(df: DataFrame, by: list[str], frame: str, budget: float) -> DataFrame:
    """(by, frames, median, p95, max, over_budget, over_33, over_50, share_over): negative frames are dropped; empty groups are absent."""
    f = F.col(frame)
    got = df.where(f >= 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.percentile(f, F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.max(f).alias("max"),
        F.count_if(f > budget).alias("over_budget"), F.count_if(f > 33.3).alias("over_33"), F.count_if(f > 50).alias("over_50"),
    )
    return got.select(*by, "frames", F.round(F.get("q", F.lit(0)), 6).alias("median"), F.round(F.get("q", F.lit(1)), 6).alias("p95"), "max", "over_budget", "over_33", "over_50", F.round(F.try_divide(F.col("over_budget"), F.col("frames")), 6).alias("share_over"))


def condition_summary(df: DataFrame, keys: list[str], warm_up: str, state: str, metric: str) -> DataFrame:
    """(keys, warm_ups, measured, successes, failures, timeouts, invalid, median, p25, p75) per condition."""
    m, s = ~F.col(warm_up), F.col(state)
    good = F.when(m & (s == "success"), F.col(metric))
    got = df.groupBy(*keys).agg(
        F.count_if(F.col(warm_up)).alias("warm_ups"), F.count_if(m).alias("measured"), F.count_if(m & (s == "success")).alias("successes"), F.count_if(m & (s == "failure")).alias("failures"),
        F.count_if(m & (s == "timeout")).alias("timeouts"), F.count_if(m & (s == "invalid")).alias("invalid"), F.percentile(good, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    )
    return got.select(*keys, "warm_ups", "measured", "successes", "failures", "timeouts", "invalid", *(F.round(F.get("q", F.lit(k)), 6).alias(n) for k, n in ((1, "median"), (0, "p25"), (2, "p75"))))


def stage_summary(df: DataFrame, stage: str, metric: str) -> DataFrame:
    return df.groupBy(stage).agg(F.count(metric).alias("n"), F.round(F.median(metric), 6).alias("median"), F.round(F.avg(metric), 6).alias("mean"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def compare_runs(base: DataFrame, current: DataFrame, stage: str) -> DataFrame:
    """(stage, base_median, current_median, ratio) of two stage summaries; stages of one run only stay."""
    a, b = base.select(stage, F.col("median").alias("base_median")), current.select(stage, F.col("median").alias("current_median"))
    rows = a.join(b, stage, "full_outer")
    return rows.withColumn("ratio", F.when(F.col("base_median") > 0, F.round(F.col("current_median") / F.col("base_median"), 6)))


def invalidate_mixed(df: DataFrame, keys: list[str], identity: str, state: str) -> DataFrame:
    """df where every success of a group with several identities becomes invalid."""
    kinds = df.groupBy(*keys).agg(F.count_distinct(identity).alias("_n"))
    rows = df.join(kinds, keys)
    return rows.withColumn(state, F.when((F.col(state) == "success") & (F.col("_n") > 1), "invalid").otherwise(F.col(state))).drop("_n")


def duration_metric(before: Column, after: Column) -> Column:
    """after - before; null unless both are finite and the difference is not negative."""
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (before, after)]
    ok = finite[0] & finite[1] & (after >= before)
    return F.when(ok, after - before)


def paired_metrics(df: DataFrame, full: str, lod: str) -> DataFrame:
    """df with reduction, speed_up and difference, and the reason where they are unavailable."""
    reason = F.when(F.col(full).isNull() | F.col(lod).isNull(), "missing").when(F.col(full) <= 0, "no base").when(F.col(lod) <= 0, "no value")
    ok = reason.isNull()
    return df.select("*", reason.alias("reason"), F.when(ok, F.round(1 - F.col(lod) / F.col(full), 6)).alias("reduction"), F.when(ok, F.round(F.col(full) / F.col(lod), 6)).alias("speed_up"), F.when(ok, F.round(F.col(full) - F.col(lod), 6)).alias("difference"))


def pair_summary(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, valid, invalid, median, p25, p75) over rows of paired_metrics."""
    rows = pairs.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("x.*")
    got = rows.groupBy("metric").agg(F.count("value").alias("valid"), F.count_if(F.col("value").isNull()).alias("invalid"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return got.select("metric", "valid", "invalid", *(F.round(F.get("q", F.lit(k)), 6).alias(n) for k, n in ((1, "median"), (0, "p25"), (2, "p75"))))


def phase_summary(df: DataFrame, by: list[str], phases: list[str], total: str, state: str | None = None) -> DataFrame:
    """(by, n, successes, unbalanced, and median, p25 and p75 of every phase and of the rest) over successes: what the phases leave of the total, and rows whose phases miss it by more than 1e-6.

    Without a state column every row is a success.
    """
    spent = sum((F.col(p) for p in phases[1:]), F.col(phases[0]))
    good = F.coalesce(F.col(state) == "success", F.lit(False)) if state else F.lit(True)
    values = [*((p, F.col(p)) for p in phases), ("rest", F.col(total) - spent)]
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("successes"), F.count_if(good & (F.abs(F.col(total) - spent) > 1e-6)).alias("unbalanced"), *(F.percentile(F.when(good, v), quartiles).alias(f"_{p}") for p, v in values))
    return got.select(*by, "n", "successes", "unbalanced", *(F.round(F.get(f"_{p}", F.lit(k)), 6).alias(f"{p}_{name}") for p, _ in values for k, name in ((1, "median"), (0, "p25"), (2, "p75"))))


def check_grid(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, found): cells of the grid whose number of rows is not the expected one, and rows outside the grid."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    rows = expected.join(got, keys, "full_outer").select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return rows.where("expected <> found")


def compare_systems(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys, a_…, b_…): robust summaries side by side on equal conditions; a condition without partner is an error."""
    left, right = (robust_summary(df, keys, metric).select(*keys, *(F.col(c).alias(f"{n}_{c}") for c in ("n", "median", "p25", "p75"))) for df, n in ((a, "a"), (b, "b")))
    if left.join(right, keys, "left_anti").limit(1).count() or right.join(left, keys, "left_anti").limit(1).count():
        raise ValueError("a condition has no partner")
    return left.join(right, keys)


def audit_event_phases(df: DataFrame, key: str, order: str, start: str, at: str, settled: str) -> DataFrame:
    """(key, events, out_of_order, outside): events per key, steps back in time, events outside [start, settled]."""
    before = F.lag(at).over(W.partitionBy(key).orderBy(order))
    rows = df.withColumn("_b", before)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col(at) < F.col("_b")).alias("out_of_order"), F.count_if((F.col(at) < F.col(start)) | (F.col(at) > F.col(settled))).alias("outside"))


def series_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """robust_summary for plots; a value that is not finite is an error."""
    if df.where(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).limit(1).count():
        raise ValueError("a value is not finite")
    return robust_summary(df, keys, value)


def combine_runs(base: DataFrame, replacement: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the replacement, and those of the base whose cell it lacks."""
    return replacement.unionByName(base.join(replacement.select(*keys).distinct(), keys, "left_anti"))


def constant_faults(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): columns that should hold one value in all rows, and hold n."""
    row = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*").where("n <> 1")


def phase_faults(df: DataFrame, key: str, phases: list[str], total: str) -> DataFrame:
    """(key, negative, unbalanced): rows with a negative phase, and whose phases miss the total by more than 1e-6."""
    spent = sum((F.col(p) for p in phases[1:]), F.col(phases[0]))
    return df.groupBy(key).agg(F.count_if(F.least(*phases, F.lit(0.0)) < 0).alias("negative"), F.count_if(F.abs(F.col(total) - spent) > 1e-6).alias("unbalanced"))


def timer_gaps(df: DataFrame, key: str, scheduled: str, fired: str, requested: str, tie: str) -> DataFrame:
    """(key, wait, request): for the last timer that fired, of simultaneous ones that of the largest ``tie``, from its schedule to its firing, and from there to the request."""
    last = df.where(F.col(fired).isNotNull()).groupBy(key).agg(F.max_by(F.struct(scheduled, fired, requested), F.struct(fired, tie)).alias("t"))
    return last.select(key, (F.col(f"t.{fired}") - F.col(f"t.{scheduled}")).alias("wait"), (F.col(f"t.{requested}") - F.col(f"t.{fired}")).alias("request"))


def select_targets(clusters: DataFrame, shares: tuple[float, ...] = (0.10, 0.50, 0.99)) -> DataFrame:
    """(share, cluster_id, members) of clusters (level, cluster_id, members) of several members, one per share, each of at least twice the members of the one before.

    The wanted number of members is that of the cluster at the share's rank, by members, level and id, counted from 0 to the last and rounded half to even. Of the numbers
    in use the one nearest to it is taken, the smaller of two, and of its clusters the first by level and id. An error if no cluster is left for a share.
    """
    kept = clusters.where("members > 1").groupBy("members").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("level", "cluster_id")).alias("first"))
    sizes = Scratch(clusters.sparkSession, "targets").save(sum_before(kept, ["members"], "n", "before"), "sizes")
    n, least, out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 2, None
    for share in sorted(shares):
        at = round(share * (n - 1))
        wanted = sizes.where((F.col("before") <= at) & (F.col("before") + F.col("n") > at)).select("members").first()
        row = wanted and sizes.where(F.col("members") >= least).agg(F.min_by("members", F.struct(F.abs(F.col("members") - F.lit(wanted[0])), "members"))).first()[0]
        if row is None:
            raise ValueError("too few kinds of clusters for all shares")
        one = sizes.where(F.col("members") == row).select(F.lit(share).alias("share"), "first.cluster_id", "members")
        out, least = one if out is None else out.unionByName(one), 2 * row
    return out
