"""What operators return beside rows: a report of what each branch could and could not do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "branch string, count long, status string, reason string"


@dataclass
class Result:
    """Rows and their report: branch, count, status (ok, empty, degraded, unavailable) and reason."""

    rows: DataFrame
    report: DataFrame


def report(spark: SparkSession, ranked: DataFrame, branches: list[str], unavailable: dict[str, str] | None = None, degraded: dict[str, str] | None = None) -> DataFrame:
    """One row per branch, also for those without hits: not having run is unlike having matched nothing."""
    known = spark.createDataFrame([(b, (unavailable or {}).get(b), (degraded or {}).get(b)) for b in branches], "branch string, gone string, weak string")
    counts = ranked.groupBy("branch").agg(F.count("*").alias("count"))
    n = F.coalesce("count", F.lit(0))
    status = F.when(F.col("gone").isNotNull(), "unavailable").when(n == 0, "empty").when(F.col("weak").isNotNull(), "degraded").otherwise("ok")
    reason = F.coalesce("gone", F.when(n == 0, F.coalesce("weak", F.lit("matched nothing"))).otherwise(F.col("weak")))
    return known.join(counts, "branch", "left").select("branch", n.alias("count"), status.alias("status"), reason.alias("reason"))
