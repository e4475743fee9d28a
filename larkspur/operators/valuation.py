"""Valuation of positions: records, totals, summary cards, flows by class and their quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valuation_method(kind: Column, otc: tuple[str, ...], crypto: tuple[str, ...]) -> Column:
    return F.when(kind.isin(*otc), "balance").when(kind.isin(*crypto), "crypto").otherwise("price")


def market(ticker: Column) -> Column:
    """Where a ticker is listed, by its form."""
    return F.when(ticker.rlike(r"^[A-Z]{4}(3|4|5|6|11|34)F?$"), "B3").when(ticker.rlike(r"^[A-Z]{1,5}(\.[A-Z])?$"), "US").when(ticker.rlike(r"^[A-Z]+-(USD|BRL)$"), "crypto").otherwise("unknown")


def asset_kind(name: Column, patterns: list[tuple[str, str]], otherwise: str = "acao") -> Column:
    """The kind of the first pattern (regular expression, kind) that the name matches, any case."""
    out = F.lit(None).cast("string")
    for p, kind in patterns:
        out = F.coalesce(out, F.when(name.rlike(f"(?i){p}"), kind))
    return F.coalesce(out, F.lit(otherwise))


def entries(positions: DataFrame, prices: DataFrame, rates: DataFrame, spot: float, least: float = 1e-6) -> DataFrame:
    """A record per position (id, currency, quantity, cost, dividends) that is not nil: value, profit, yield on cost, and in
    the home currency. prices: id, price. rates: id, rate and cost_brl of foreign holdings; without one the spot rate counts.
    Positions below zero are left out. What a foreign position returned splits into return_usd and return_fx_brl, and both
    are null without a price."""
    r = lambda c, n: F.round(c, n)
    both = positions.where(F.col("quantity") > least).join(prices.select("id", "price"), "id", "left").join(rates.select("id", "rate", "cost_brl"), "id", "left")
    cost, value = r(F.col("cost"), 2), r(F.col("quantity") * F.coalesce("price", F.lit(0.0)), 2)
    usd = F.col("currency") != "BRL"
    priced = F.coalesce("price", F.lit(0.0)) != 0
    share = lambda a: F.when(F.col("cost_basis") > 0, r(a / F.col("cost_basis"), 4)).otherwise(0.0)
    out = both.withColumn("cost_basis", cost).withColumn("value", value)
    out = out.withColumn("cost_home", F.when(~usd, F.col("cost_basis")).when(F.col("cost_brl") > 0, r(F.col("cost_brl"), 2)).otherwise(r(F.col("cost_basis") * spot, 2)))
    out = out.withColumn("value_home", F.when(usd, r(F.col("value") * spot, 2)).otherwise(F.col("value")))
    return out.select(
        "id", "currency", r(F.col("quantity"), 8).alias("quantity"), "cost_basis", "value", r(F.col("value") - F.col("cost_basis"), 2).alias("pnl"), share(F.col("value") - F.col("cost_basis")).alias("pnl_share"),
        share(F.col("dividends")).alias("yield_on_cost"), "cost_home", "value_home", r(F.col("value_home") - F.col("cost_home"), 2).alias("pnl_home"),
        F.when(usd & priced, r(F.col("value") - F.col("cost_basis"), 2)).alias("return_usd"), F.when(usd & priced, r(F.col("cost_basis") * spot - F.col("cost_home"), 2)).alias("return_fx_brl"),
    )


def totals(entries_: DataFrame) -> DataFrame:
    """Value, cost and profit of the whole portfolio in the home currency."""
    t = entries_.agg(F.sum(F.col("value_home").cast("decimal(24,2)")).alias("v"), F.sum(F.col("cost_home").cast("decimal(24,2)")).alias("c"), F.count(F.lit(1)).alias("n"))
    return t.select("n", F.col("v").cast("double").alias("value"), F.col("c").cast("double").alias("cost"), (F.col("v") - F.col("c")).cast("double").alias("pnl"), F.when(F.col("c") > 0, F.round((F.col("v") - F.col("c")).cast("double") / F.col("c").cast("double"), 4)).otherwise(0.0).alias("pnl_share"))


def cards(entries_: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind (id, kind): positions, value, how many gain, the largest one's share (dominance), and what is foreign."""
    b = entries_.join(kinds, "id").groupBy("kind")
    out = b.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value_home").cast("decimal(24,2)")).cast("double").alias("value"), F.count(F.when(F.col("pnl_home") > 0, 1)).alias("gaining"), F.max("value_home").alias("largest"), F.sum(F.coalesce("return_usd", F.lit(0.0)).cast("decimal(24,2)")).cast("double").alias("return_usd"))
    return out.select("kind", "n", "value", "gaining", F.when(F.col("value") > 0, F.round(F.col("largest") / F.col("value"), 4)).otherwise(0.0).alias("dominance"), "return_usd")


def active_otc(products: DataFrame, least: float = 1.0) -> DataFrame:
    """Products (product, flow, value) that still count: a net flow of more than least or a value."""
    return products.where((F.abs("flow") > least) | (F.coalesce("value", F.lit(0.0)) != 0))


def class_flows(trades: DataFrame, income: DataFrame, otc: DataFrame, classes: DataFrame, rates: DataFrame) -> DataFrame:
    """Signed flows in the home currency by class and day: what buys and applications take out, what sells, redemptions and
    income bring in. classes: id, class, else other. rates: id, rate of foreign ids; others count at 1."""
    t = trades.select(F.col("ticker").alias("id"), "date", F.when(F.col("side") == "C", -F.col("total")).otherwise(F.col("total")).cast("double").alias("flow"))
    i = income.select(F.col("ticker").alias("id"), "date", F.col("value").cast("double").alias("flow"))
    o = otc.select(F.col("product").alias("id"), "date", F.col("amount").cast("double").alias("flow"))
    named = t.unionByName(i).unionByName(o).groupBy("id", "date").agg(F.sum(F.col("flow").cast("decimal(24,4)")).cast("double").alias("flow"), F.count(F.lit(1)).alias("n")).join(classes, "id", "left").join(rates.select("id", "rate"), "id", "left")
    home = F.round(F.col("flow") * F.coalesce("rate", F.lit(1.0)), 4).cast("decimal(24,4)")
    return named.groupBy(F.coalesce("class", F.lit("other")).alias("class"), "date").agg(F.sum(home).cast("double").alias("flow"), F.sum("n").alias("n"))


def class_summary(flows: DataFrame, entries_: DataFrame, classes: DataFrame, warn: int = 50) -> DataFrame:
    """Per class: flows, their sum, terminal value; too many flows of no class are a warning."""
    ends = entries_.join(classes, "id", "left").groupBy(F.coalesce("class", F.lit("other")).alias("class")).agg(F.sum(F.col("value_home").cast("decimal(24,2)")).cast("double").alias("terminal"))
    per = flows.groupBy("class").agg(F.sum("n").alias("n_flows"), F.sum(F.col("flow").cast("decimal(24,4)")).cast("double").alias("net"))
    return per.join(ends, "class", "full").select("class", F.coalesce("n_flows", F.lit(0)).alias("n_flows"), F.coalesce("net", F.lit(0.0)).alias("net"), F.coalesce("terminal", F.lit(0.0)).alias("terminal"), ((F.col("class") == "other") & (F.coalesce("n_flows", F.lit(0)) >= warn)).alias("warn"))


def drift(computed: DataFrame, stored: DataFrame, most: float = 0.005) -> DataFrame:
    """Returns (id, xirr) computed anew against stored ones."""
    both = computed.select("id", "xirr").join(stored.select("id", F.col("xirr").alias("stored")), "id", "full")
    gap = F.round(F.abs(F.col("xirr") - F.col("stored")), 6)
    return both.select("id", "xirr", "stored", F.when(F.col("xirr").isNull() | F.col("stored").isNull(), "missing").when(gap > most, "drift").otherwise("same").alias("verdict"))


def quote_table(tickers: DataFrame, returns: DataFrame, delisted: DataFrame) -> DataFrame:
    """Each ticker's status: DELISTED before MISSING (no quotes) before OK, with its close and returns."""
    both = tickers.select("ticker").join(returns, "ticker", "left").join(delisted.select("ticker", F.lit(True).alias("_gone")), "ticker", "left")
    return both.withColumn("status", F.when(F.col("_gone"), "DELISTED").when(F.col("last").isNull(), "MISSING").otherwise("OK")).drop("_gone")
