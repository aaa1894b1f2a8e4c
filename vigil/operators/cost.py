"""Cost analysis and savings recommendations.

Input: a ``costs`` DataFrame (provider, compute, storage, total), e.g. aggregated from
billing lines with ``groupBy(provider)``.  Outputs stay DataFrames: per-provider rows, a
one-row summary, and recommendation rows built from that one row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

# Fixed values of the reference's recommendation rules.
COMPUTE_TO_STORAGE = 3          # top provider: compute above 3x storage
COMPUTE_SHARE = Decimal("0.15")  # ... saves 15 % of its compute
TOTAL_COMPUTE_LIMIT = 10_000    # all compute above this
WAREHOUSE_SHARE = Decimal("0.10")  # ... saves 10 %
TOTAL_STORAGE_LIMIT = 2_000     # all storage above this
STORAGE_SHARE = Decimal("0.20")  # ... saves 20 %


def _select(costs: DataFrame, provider: str) -> DataFrame:
    # An unknown provider yields no rows (the reference silently fell back to all).
    return costs if provider == "all" else costs.filter(F.col("provider") == provider)


def cost_by_provider(costs: DataFrame, provider: str = "all") -> DataFrame:
    """O9 rows: provider, compute, storage, total, share of the grand total (round 4)."""
    c = _select(costs, provider)
    grand = c.agg(F.sum("total").alias("g")).scalar()
    return c.select("provider", "compute", "storage", "total",
                    F.round(F.try_divide(F.col("total"), grand), 4).cast("double").alias("share"))


def cost_summary(costs: DataFrame, provider: str = "all") -> DataFrame:
    """O9 one row: monthly_total, top_provider (highest total, ties to the larger name)."""
    c = _select(costs, provider)
    return c.agg(F.sum("total").alias("monthly_total"),
                 F.max_by("provider", F.struct("total", "provider")).alias("top_provider"),
                 F.count(F.lit(1)).alias("providers"))


def cost_recommendations(costs: DataFrame, provider: str = "all") -> DataFrame:
    """O10 rows: area, potential_savings (whole units), suggestion, total_potential_savings (of all rows)."""
    c = _select(costs, provider)
    one = c.agg(
        F.max_by(F.struct("provider", "compute", "storage"), F.struct("total", "provider")).alias("top"),
        F.sum("compute").alias("all_compute"), F.sum("storage").alias("all_storage"))

    def rec(area, savings, text):
        return F.struct(F.lit(area).alias("area"), F.round(savings, 0).cast("bigint").alias("potential_savings"),
                        text.alias("suggestion"))

    items = F.array(
        F.when(F.col("top.compute") > F.col("top.storage") * COMPUTE_TO_STORAGE,
               rec("compute_optimization", F.col("top.compute") * F.lit(COMPUTE_SHARE),
                   F.concat(F.col("top.provider"),
                            F.lit(": Consider auto-scaling or spot instances for non-production workloads")))),
        F.when(F.col("all_compute") > TOTAL_COMPUTE_LIMIT,
               rec("warehouse_sizing", F.col("all_compute") * F.lit(WAREHOUSE_SHARE),
                   F.lit("Review warehouse sizing: consider multi-cluster warehouses for concurrent workloads"))),
        F.when(F.col("all_storage") > TOTAL_STORAGE_LIMIT,
               rec("storage_optimization", F.col("all_storage") * F.lit(STORAGE_SHARE),
                   F.lit("Implement data lifecycle policy: auto-archive data not accessed in 90+ days"))),
    )
    found = F.filter(items, lambda x: x.isNotNull())
    total = F.aggregate(found, F.lit(0).cast("bigint"), lambda t, x: t + x["potential_savings"])
    return (one.select(found.alias("f"), total.alias("total_potential_savings"))
               .select(F.explode("f").alias("r"), "total_potential_savings").select("r.*", "total_potential_savings"))
