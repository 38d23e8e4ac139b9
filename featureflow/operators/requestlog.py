"""Request-log analysis (A10 summary, A11 per phase, P3 success/failure
split, V12 latency flags) and the request-log sink (IO7).

Counts, rates and wall time come from one aggregate with conditional
aggregates (no filtered copies of the log); latency statistics cover
successful requests only while throughput counts every request, as in the
reference. The 95th percentile is exact (linear interpolation) by default,
computed without gathering a group in one task: the one aggregate also counts
the latencies by their leading bits, and a second pass ranks the few rows
around the percentile. ``approx=True`` uses ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from featureflow.functions.lookup import join_null_safe
from featureflow.operators.quantile import CELL as _B, lead, percentile_of_cells
from featureflow.schema import REQUEST_LOG
from featureflow.session import written

# Alarm thresholds of the reference's load-test analysis.
HIGH_LATENCY_S = 1.0
TIMEOUT_S = 5.0


def latency_summary(log: DataFrame, group_cols: Sequence[str] = (), p: float | None = 0.95,
                    approx: bool = False) -> DataFrame:
    """One row per group (null is a group); ``p=None`` leaves the percentile null."""
    groups = list(group_cols)
    ok = F.col("success")
    rt = F.col("response_time").cast("double")
    end = F.col("timestamp") + F.col("response_time")
    exact = p is not None and not approx
    cell = F.when(ok & rt.isNotNull(), lead(rt)) if exact else F.lit(None).cast("long")
    cells = log.groupBy(*groups, cell.alias(_B)).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
        F.min("timestamp").alias("start"), F.max(end).alias("end"), F.sum(F.when(ok, rt)).alias("total"),
        F.count(F.when(ok, rt)).alias("n"), F.min(F.when(ok, rt)).alias("low"), F.max(F.when(ok, rt)).alias("high"),
        *([F.percentile_approx(F.when(ok, rt), p, 10000).cast("double").alias("approx")] if approx and p is not None else []))
    if exact:  # read by the summary and by the percentile
        cells = written(cells, "latency-cells")
    p95 = F.max("approx") if approx and p is not None else F.lit(None).cast("double")
    base = cells.groupBy(*groups).agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("successful_requests"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_requests"),
        (F.max("end") - F.min("start")).alias("total_time"),
        F.try_divide(F.sum("total"), F.sum("n")).alias("avg_response_time"), F.min("low").alias("min_response_time"),
        F.max("high").alias("max_response_time"), p95.alias("p95_response_time"))
    if exact:
        vals = log.where(ok & rt.isNotNull()).select(*groups, rt.alias("response_time"))
        pct = percentile_of_cells(vals, cells.where(F.col(_B).isNotNull()), "response_time", p, groups, "p95_response_time")
        base = base.drop("p95_response_time")
        if groups:
            base = join_null_safe(base, pct, groups, "left")
        else:  # one global value: a scalar subquery, not a join
            base = base.withColumn("p95_response_time", pct.select("p95_response_time").scalar())
    n, s = F.col("total_requests"), F.col("successful_requests")
    has_ok = s > 0
    return base.select(
        *groups, "total_requests", "successful_requests", "failed_requests",
        F.try_divide(F.lit(100.0) * s, n).alias("success_rate"),
        "total_time",
        F.when(F.col("total_time") > 0, n / F.col("total_time")).alias("requests_per_second"),
        "avg_response_time", "min_response_time", "max_response_time", "p95_response_time",
        F.when(has_ok, F.col("avg_response_time") > HIGH_LATENCY_S).alias("high_latency"),
        F.when(has_ok, F.col("failed_requests") > 0).alias("has_failures"),
        F.when(has_ok, F.col("max_response_time") > TIMEOUT_S).alias("timeout_issues"),
    )


def latency_flags(summary: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Alarm rows ``(group..., flag, observed, threshold, raised)`` (V12);
    like the reference, nothing is judged for a group without successes."""
    groups = list(group_cols)
    rows = F.array(
        F.struct(F.lit("high_latency").alias("flag"), F.col("avg_response_time").alias("observed"),
                 F.lit(HIGH_LATENCY_S).alias("threshold"), F.col("high_latency").alias("raised")),
        F.struct(F.lit("failed_requests").alias("flag"), F.col("failed_requests").cast("double").alias("observed"),
                 F.lit(0.0).alias("threshold"), F.col("has_failures").alias("raised")),
        F.struct(F.lit("timeout_issues").alias("flag"), F.col("max_response_time").alias("observed"),
                 F.lit(TIMEOUT_S).alias("threshold"), F.col("timeout_issues").alias("raised")),
    )
    return summary.where(F.col("successful_requests") > 0).select(*groups, F.inline(rows))


def write_request_log(log: DataFrame, path: str) -> None:
    """All records as JSON lines (IO7)."""
    log.write.mode("overwrite").json(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_LOG).option("mode", "FAILFAST").json(path)
