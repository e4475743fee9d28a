"""Filters, projections and aggregations over the spend ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import EXCLUDED


def month(c: str = "date") -> Column:
    return F.date_format(c, "yyyy-MM")


def is_expense() -> Column:
    return ~F.col("category").isin(*EXCLUDED)


def refund(patterns: Sequence[str] = ("refund",)) -> Column:
    """A positive row whose description names a reimbursement."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.lower("description").contains(p.lower())
    return (F.col("amount") > 0) & hit


def net_spend(tx: DataFrame) -> DataFrame:
    """Net spend by month and supplier; blank suppliers are one; excluded categories don't count."""
    who = F.when(F.trim("supplier") == "", "(unmapped)").otherwise(F.col("supplier"))
    return tx.where(is_expense()).groupBy(month().alias("month"), who.alias("supplier")).agg(F.sum(-F.col("amount")).cast("double").alias("spend"))


def spend_spikes(totals: DataFrame, threshold: float = 0.2, min_base: float = 100.0) -> DataFrame:
    """Months whose spend rose by more than threshold over the calendar month before, or that follow one of no spend."""
    prior = totals.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("month"), "supplier", F.col("spend").alias("prior"))
    both = totals.join(prior, ["month", "supplier"])
    rise = F.round((F.col("spend") - F.col("prior")) / F.col("prior"), 6)
    return (
        both.select("month", "supplier", "spend", "prior", F.when(F.col("prior") > 0, rise).alias("pct"), (F.col("prior") <= 0).alias("appeared"))
        .where(((F.col("prior") >= min_base) & (F.col("pct") > threshold)) | ((F.col("prior") <= 0) & (F.col("spend") >= min_base)))
    )


def supplier_rollup(tx: DataFrame, end: str, days: int = 92, least: float = 200.0) -> DataFrame:
    """Suppliers' volume in the days up to end; small and unseen ones are 'Outros'."""
    last = F.lit(end).cast("date")
    inside = (F.col("date") >= F.date_sub(last, days)) & (F.col("date") <= last)
    per = tx.groupBy("supplier").agg(F.coalesce(F.sum(F.when(inside, F.abs("amount"))), F.lit(0)).cast("double").alias("volume"))
    return per.withColumn("rolled", F.when((F.col("volume") >= least) & (F.col("supplier") != ""), F.col("supplier")).otherwise("Outros"))


def net_amount() -> Column:
    """Negative rows and reimbursements count; other income does not."""
    return F.when(F.col("amount") < 0, F.col("amount")).when(refund(), F.col("amount")).otherwise(0)


def net_by_category(tx: DataFrame) -> DataFrame:
    """Net spend of categories that spent, their share of all, and how much of it recurs (installments)."""
    net = -net_amount()
    per = tx.where(is_expense()).groupBy("category").agg(
        F.sum(net).cast("double").alias("net"), F.sum(F.when(F.col("description").contains("PARC "), net).otherwise(0)).cast("double").alias("recurring")
    ).where("net > 0")
    total = per.agg(F.sum("net").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("category", "net", F.round(F.col("net") / F.col("total"), 6).alias("share"), F.round(F.col("recurring") / F.col("net"), 6).alias("recurring_share"))


def tag_totals(tx: DataFrame) -> DataFrame:
    """A row counts in each of its tags; reimbursements lower the total."""
    return tx.where(is_expense()).select(F.explode("tags").alias("tag"), net_amount().alias("net")).groupBy("tag").agg(F.sum(-F.col("net")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


def month_kpis(tx: DataFrame) -> DataFrame:
    """Expense, income, number of rows, recurring and one-off expense of each month."""
    out = -F.when(is_expense(), net_amount()).otherwise(0)
    rec = F.col("description").contains("PARC ")
    return tx.groupBy(month().alias("month")).agg(
        F.sum(out).cast("double").alias("expense"), F.sum(F.when((F.col("category") == "receitas") & ~refund(), F.col("amount")).otherwise(0)).cast("double").alias("income"),
        F.count(F.lit(1)).alias("n"), F.sum(F.when(rec, out).otherwise(0)).cast("double").alias("recurring"), F.sum(F.when(rec, 0).otherwise(out)).cast("double").alias("one_off"),
    )


def evolution(tx: DataFrame, keep: int = 3) -> DataFrame:
    """Spend by month, the largest categories in columns of their own by rank and the rest as other; change over the month before."""
    spend = tx.where(is_expense()).groupBy("category", month().alias("month")).agg(F.sum(-F.col("amount")).alias("v"))
    rank = spend.groupBy("category").agg(F.sum("v").alias("t")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("t"), "category")))
    slot = F.when(F.col("rank") <= keep, F.concat(F.lit("top"), F.col("rank").cast("string"))).otherwise("other")
    wide = spend.join(rank.select("category", "rank"), "category").withColumn("slot", slot).groupBy("month").pivot("slot", [*(f"top{i}" for i in range(1, keep + 1)), "other"])
    wide = wide.agg(F.sum("v"))
    cols = [*(f"top{i}" for i in range(1, keep + 1)), "other"]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
    wide = wide.withColumn("total", total.cast("double"))
    prior = F.lag("total").over(Window.orderBy("month"))  # a row a month
    return wide.select("month", *(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in cols), "total", F.round((F.col("total") - prior) / prior, 6).alias("change"))


def filter_page(tx: DataFrame, categories: Sequence[str], tags: Sequence[str], text: str, page: int = 1, size: int = 30) -> DataFrame:
    """Expenses of any given category and tag whose description holds the text; newest first, one page."""
    hit = tx.where(F.col("category").isin(*categories) & F.arrays_overlap("tags", F.array(*map(F.lit, tags))) & F.lower("description").contains(text.lower()) & (F.col("amount") < 0))
    return hit.orderBy(F.desc("date"), "seq").offset((page - 1) * size).limit(size).select("seq", F.col("date").cast("string").alias("date"), "category", F.col("amount").cast("double").alias("amount"))


def ledger_sample(tx: DataFrame, month_prefix: str, category: str, low: float, high: float, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows of a month and category (any case) whose size lies in a band; at most 50."""
    hit = tx.where(month().startswith(month_prefix) & (F.lower("category") == category.lower()) & F.abs("amount").between(low, high))
    return hit.orderBy("date", "seq").offset(offset).limit(min(limit, 50)).select("seq", F.col("date").cast("string").alias("date"), "category", F.col("amount").cast("double").alias("amount"))


def any_column(tx: DataFrame, pattern: str, cap: int = 100) -> DataFrame:
    """Rows where any text column holds the pattern (any case); at most 100."""
    hit = F.lit(False)
    for c in ("category", "bank", "supplier", "description", "source_type", "currency"):
        hit = hit | F.lower(c).contains(pattern.lower())
    return tx.where(hit).orderBy("seq").limit(cap).select("seq", "description")


def statement_window(tx: DataFrame, first: str) -> DataFrame:
    """Rows of a statement month: card rows may lie five days outside it; kept and removed rows are counted by bank."""
    a = F.lit(first).cast("date")
    z = F.last_day(a)
    inside = F.when(F.col("source_type") == "fatura", F.col("date").between(F.date_sub(a, 5), F.date_add(z, 5))).otherwise(F.col("date").between(a, z))
    return tx.groupBy("bank").agg(F.count(F.when(F.col("date").isNull() | inside, 1)).alias("kept"), F.count(F.when(~inside, 1)).alias("removed"))


def coverage(tx: DataFrame) -> DataFrame:
    """Tagged share of spending, by amount and by rows, per month; no spending: 1."""
    neg = (F.col("amount") < 0) & is_expense()
    tagged = neg & (F.size("tags") > 0)
    return tx.groupBy(month().alias("month")).agg(
        F.sum(F.when(neg, -F.col("amount"))).cast("double").alias("spent"), F.sum(F.when(tagged, -F.col("amount"))).cast("double").alias("tagged"),
        F.count(F.when(neg, 1)).alias("n"), F.count(F.when(tagged, 1)).alias("n_tagged"),
    ).select(
        "month", F.coalesce(F.round(F.coalesce("tagged", F.lit(0.0)) / F.col("spent"), 6), F.lit(1.0)).alias("coverage"),
        F.when(F.col("n") > 0, F.round(F.col("n_tagged") / F.col("n"), 6)).otherwise(1.0).alias("row_coverage"), (F.coalesce(F.coalesce("tagged", F.lit(0.0)) / F.col("spent"), F.lit(1.0)) >= 0.7).alias("passed"),
    )


def transaction_count_gate(tx: DataFrame, most_outside: float = 0.1) -> DataFrame:
    """Per bank: the most frequent month (earliest on ties) and the share of rows outside it by over five days."""
    per = tx.groupBy("bank", month().alias("m")).agg(F.count(F.lit(1)).alias("k"))
    mode = per.groupBy("bank").agg(F.min_by("m", F.struct(-F.col("k"), "m")).alias("expected"))
    first = F.to_date(F.concat("expected", F.lit("-01")))
    out = ~F.col("date").between(F.date_sub(first, 5), F.date_add(F.last_day(first), 5))
    return tx.join(mode, "bank").groupBy("bank", "expected").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(out.cast("double")), 6).alias("outside")).withColumn("passed", F.col("outside") <= most_outside)


def boundary_days(tx: DataFrame) -> DataFrame:
    """Rows by bank in the first or last five days of a month that need a prompt (no card rows)."""
    day, last = F.dayofmonth("date"), F.dayofmonth(F.last_day("date"))
    edge = (day <= 5) | (day >= last - 4)
    return tx.groupBy("bank").agg(F.count(F.when(edge, 1)).alias("on_boundary"), F.count(F.when(edge & (F.col("source_type") != "fatura"), 1)).alias("prompts"))


def top_suppliers(tx: DataFrame, k: int = 10) -> DataFrame:
    return net_spend(tx).groupBy("supplier").agg(F.round(F.sum("spend"), 2).alias("spend")).orderBy(F.desc("spend"), "supplier").limit(k)


def month_delta(tx: DataFrame) -> DataFrame:
    """Spend of each month against the calendar month before (none: 0)."""
    per = tx.where(is_expense()).groupBy(month().alias("month")).agg(F.sum(-F.col("amount")).cast("double").alias("spend"))
    prior = per.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("month"), F.col("spend").alias("prior"))
    return per.join(prior, "month", "left").select("month", "spend", F.round(F.col("spend") - F.coalesce("prior", F.lit(0.0)), 2).alias("delta"))
