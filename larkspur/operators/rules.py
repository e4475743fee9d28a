"""The rule engine: first matching layer decides; recurrence, date bases, routing, tags. Rules are small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layered(tx: DataFrame, self_patterns: tuple[str, ...], refunds: dict[str, str], values: list[tuple[str, float, str]]) -> DataFrame:
    """tx (with default_category, its supplier's) with layer, category and confidence of each row by the first layer that matches: transfers to oneself (unless the row is a
    reimbursement), reimbursements, amounts within 5 % of a vendor's reference, the supplier's default, none."""
    text = F.lower("description")
    own = F.lit(False)
    for p in self_patterns:
        own = own | text.contains(p.lower())
    refund = F.lit(None).cast("string")
    for p, c in refunds.items():
        refund = F.coalesce(refund, F.when((F.col("amount") > 0) & text.contains(p.lower()), c))
    value = F.lit(None).cast("string")
    for vendor, amount, c in values:
        near = F.abs(F.abs(F.col("amount").cast("double")) - amount) <= 0.05 * amount
        value = F.coalesce(value, F.when(text.contains(vendor.lower()) & near, c))
    # columns, not expressions within one another: Spark compiles no code that is as long as five layers told in each other's terms
    cols = [c for c in tx.columns if c not in ("layer", "category", "confidence")]
    seen = tx.select(*cols, own.alias("_own"), refund.alias("_refund"), value.alias("_value"))
    layer = F.when(F.col("_own") & F.col("_refund").isNull(), F.lit(1)).when(F.col("_refund").isNotNull(), 2).when(F.col("_value").isNotNull(), 3).when(F.col("default_category").isNotNull(), 4).otherwise(5)
    told = seen.withColumn("layer", layer.cast("long"))
    layer = F.col("layer")
    name = F.when(layer == 1, "intercontas").when(layer == 2, F.col("_refund")).when(layer == 3, F.col("_value")).when(layer == 4, F.col("default_category")).otherwise("a_identificar")
    sure = F.when(layer <= 3, "high").when(layer == 4, "medium").otherwise("low")
    return told.select(*cols, "layer", name.alias("category"), sure.alias("confidence"))


def classified(tx: DataFrame, self_patterns: tuple[str, ...], refunds: dict[str, str], values: list[tuple[str, float, str]], suppliers: DataFrame) -> DataFrame:
    """seq, layer, category and confidence of each row; suppliers (supplier, default_category) has a row a supplier."""
    both = tx.join(suppliers.select("supplier", "default_category"), "supplier", "left")
    return layered(both, self_patterns, refunds, values).select("seq", "layer", "category", "confidence")


def recurrence(n: Column, m: Column, category: Column, defaults: dict[str, str], fallback: str = "one_off") -> Column:
    """Installments recur; then the category's default; transfers have none."""
    by = F.lit(None).cast("string")
    for c, r in defaults.items():
        by = F.coalesce(by, F.when(category == c, r))
    return F.when(category == "intercontas", F.lit(None)).when(n.isNotNull() & (m >= 2), "installment").otherwise(F.coalesce(by, F.lit(fallback)))


def date_bases(tx: DataFrame) -> DataFrame:
    """Cash and accrual dates: card rows are paid on the 10th of the month after, all else on its own day."""
    paid = F.date_add(F.last_day("date"), 10)
    return tx.select("seq", F.when(F.col("source_type") == "fatura", paid).otherwise(F.col("date")).cast("string").alias("cash"), F.col("date").cast("string").alias("accrual"))
