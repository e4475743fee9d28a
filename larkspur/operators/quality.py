"""Gates and audits as ordinary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases (slug, alias) that stand under several slugs, any case."""
    return aliases.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("slug").alias("n"), F.array_join(F.sort_array(F.collect_set("slug")), ",").alias("slugs")).where("n > 1")


def large_untagged(tx: DataFrame, acknowledged: DataFrame, least: float) -> DataFrame:
    """Large untagged expenses that nobody acknowledged."""
    big = tx.where((F.col("amount") <= -least) & (F.size("tags") == 0))
    return big.join(acknowledged.select("seq"), "seq", "left_anti").select("seq", F.col("amount").cast("double").alias("amount"))


def stale_assets(assets: DataFrame, otc: DataFrame, today: str, days: int = 365) -> DataFrame:
    """Active assets past maturity, and inactive ones with movements in the last days."""
    t = F.lit(today).cast("date")
    recent = otc.where(F.col("date") > F.date_sub(t, days)).select("product").distinct().withColumn("moved", F.lit(True))
    both = assets.join(recent, "product", "left")
    kind = F.when(F.col("active") & (F.col("maturity") < t), "stale_active").when(~F.col("active") & F.coalesce("moved", F.lit(False)), "stale_inactive")
    return both.select("product", kind.alias("kind")).where("kind is not null")


def misfiled(income: DataFrame, fixed: DataFrame) -> DataFrame:
    """Income rows of assets that are fixed income: they belong in another ledger."""
    return income.join(fixed.select("ticker"), "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value"))


def invalid_inputs(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows (id, kind) that an upsert must refuse: empty or repeated ids, unknown kinds."""
    named = rows.where(F.coalesce("id", F.lit("")) != "")
    repeated = named.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    why = F.when(F.coalesce("id", F.lit("")) == "", "empty").when(F.col("_n") > 1, "repeated").when(~F.col("kind").isin(*kinds), "unknown_kind")
    return rows.join(repeated, "id", "left").withColumn("why", why).where("why is not null").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def quality_label(otc: DataFrame, cut: str) -> DataFrame:
    """How far a product's history can be trusted: one row only, a short window, or complete."""
    per = otc.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.bool_and(F.col("source") == "manual").alias("manual"))
    days = F.datediff(F.lit(cut).cast("date"), "first")
    return per.select("product", F.when((F.col("n") == 1) & F.col("manual"), "unverified").when(days < 90, "short_window").otherwise("complete").alias("label"))


def bucket_divergence(rates: DataFrame, stored: DataFrame, most: float) -> DataFrame:
    """Simple mean of a bucket's rates against a stored one."""
    per = rates.groupBy("bucket").agg(F.round(F.avg("rate"), 6).alias("mean"))
    return per.join(stored, "bucket").withColumn("gap", F.round(F.abs(F.col("mean") - F.col("stored")), 6)).withColumn("passed", F.col("gap") <= most)
