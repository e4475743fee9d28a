"""The spend ledger from raw rows to normalised ones, in one chain: pairs, classes, recurrence, dates, names, tags, overrides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import installment
from .categorise import IDENTITY, canonicalised, dated, identified, recurring, rule_tags
from .containment import longest_alias
from .joins import offsetting_pairs
from .rules import layered


@dataclass
class Rules:
    """aliases: (alias, rank, supplier, default_category); vendors: (vendor, recurrence, rank); invoices: (bank, month,
    payment_date); accruals: (date, description, amount, accrual); names: (raw, canonical); overrides: (date, description, amount,
    category, tags). The rest are small settings, as the operators have them."""

    aliases: DataFrame
    vendors: DataFrame
    invoices: DataFrame
    accruals: DataFrame
    names: DataFrame
    overrides: DataFrame
    self_patterns: tuple[str, ...] = ()
    refunds: dict[str, str] = field(default_factory=dict)
    values: list[tuple[str, float, str]] = field(default_factory=list)
    recurrences: dict[str, str] = field(default_factory=dict)
    refund_tags: dict[str, str] = field(default_factory=dict)
    projects: list[tuple[tuple[str, ...], str, str]] = field(default_factory=list)


def normalised(raw: DataFrame, rules: Rules) -> DataFrame:
    """raw (seq, date, amount, bank, currency, description, source_type) with category, confidence, recurrence, cash, accrual,
    supplier, tags, manual and conflict: what the classifier said where an override says otherwise.

    The order matters, and each step sees what those before it left: a row that pairs with another is a transfer, whatever the
    rules would say; recurrence and tags go by the classifier's category, not by the override's; tags go by the supplier's
    canonical name; the override comes last and replaces category and tags where it has any. Columns are added along the chain;
    joins back to rows are those of pairs and of the two logs, by identity. Of several log entries of one identity the largest
    counts. seq is unique."""
    pairs = offsetting_pairs(raw)
    paired = pairs.select(F.col("in_seq").alias("seq")).union(pairs.select(F.col("out_seq").alias("seq"))).distinct().withColumn("paired", F.lit(True))
    n, m = installment(F.col("description"))
    named = longest_alias(raw.join(paired, "seq", "left").withColumn("n", n).withColumn("m", m), rules.aliases, "description").drop("match")
    known = rules.aliases.groupBy("alias").agg(F.min_by(F.struct("supplier", "default_category"), F.struct("rank", "supplier")).alias("s"))
    supplied = named.join(known, "alias", "left").withColumn("supplier", F.col("s.supplier")).withColumn("default_category", F.col("s.default_category")).drop("s", "alias")
    told = layered(supplied, rules.self_patterns, rules.refunds, rules.values)
    told = told.withColumn("category", F.when(F.col("paired"), "intercontas").otherwise(F.col("category"))).withColumn("confidence", F.when(F.col("paired"), "exact").otherwise(F.col("confidence")))
    recurs = recurring(told, rules.vendors, rules.recurrences)
    logged = identified(rules.accruals).groupBy(*IDENTITY).agg(F.max(F.trim(F.col("accrual").cast("string"))).alias("a"))
    day = F.col("a").try_cast("date")
    parsed = F.when(F.col("a").isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("no date: "), "a"))).otherwise(day)
    keyed = identified(recurs).join(logged, IDENTITY, "left").withColumn("accrual", parsed).drop("a")
    clear = canonicalised(dated(keyed, rules.invoices), "supplier", rules.names).withColumn("tags", F.array().cast("array<string>"))
    tagged = clear.withColumn("tags", rule_tags(rules.refund_tags, rules.projects))
    last = identified(rules.overrides).groupBy(*IDENTITY).agg(F.max(F.struct(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("category", "tags")))).alias("o"))
    both = tagged.join(last, IDENTITY, "left")
    own = F.nullif("o.category", F.lit(""))
    return both.select(
        *raw.columns, F.coalesce(own, "category").alias("category"), "confidence", "recurrence", "cash", "accrual", F.coalesce("supplier", F.lit("")).alias("supplier"),
        F.coalesce(F.nullif("o.tags", F.lit("")), "tags").alias("tags"), F.col("o").isNotNull().alias("manual"), F.when(own != F.col("category"), F.col("category")).alias("conflict"))
