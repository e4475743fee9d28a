"""Positions, lots, flows, returns and income."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed


class _Month:
    """A month of a ticker's trades as a line through the cost at its start: cost at the end = a * cost at the start + b."""

    def __init__(self, ticker: str, month: str) -> None:
        self.key, self.a, self.b, self.held = (ticker, month), 1.0, 0.0, None

    def add(self, before: float, buy: bool, quantity: float, cost: float) -> tuple:
        held = before if self.held is None else self.held
        if buy:
            self.b += cost
        elif held > 0:
            left = 1.0 - min(quantity / held, 1.0)
            self.a, self.b = self.a * left, self.b * left
        self.held = held + quantity if buy else held - quantity
        return ()

    def end(self) -> list[tuple]:
        return [(*self.key, self.a, self.b, self.held)]


class _Months:
    """The months of a ticker, each a line, one after the other."""

    def __init__(self, ticker: str) -> None:
        self.ticker, self.cost, self.held = ticker, 0.0, 0.0

    def add(self, a: float, b: float, held: float) -> tuple:
        self.cost, self.held = a * self.cost + b, held
        return ()

    def end(self) -> list[tuple]:
        return [(self.ticker, self.held, self.cost)]


def average_cost(trades: DataFrame) -> DataFrame:
    """Quantity and average cost per ticker. A buy adds its cost; a sell takes cost in proportion while something is held, and
    the quantity may go below zero.

    What is held before a trade is a running sum, so it is known for each month from a table of months; given that, a trade maps
    the cost by a line (a * cost + b), and lines compose. So each month of a ticker is a stream of its own, and a ticker that
    holds a third of all trades still spreads over its months. Sums of quantities that carry over are rounded to 9 places."""
    buy = F.col("side") == "C"
    rows = trades.select("ticker", F.date_format("date", "yyyy-MM").alias("month"), "date", "ord", buy.alias("buy"), "quantity", F.abs("total").cast("double").alias("cost"))
    before = F.round(F.sum("moved").over(Window.partitionBy("ticker").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), 9)
    months = rows.groupBy("ticker", "month").agg(F.sum(F.when(F.col("buy"), F.col("quantity")).otherwise(-F.col("quantity"))).alias("moved")).select("ticker", "month", F.coalesce(before, F.lit(0.0)).alias("before"))
    lines = streamed(rows.join(months, ["ticker", "month"]), ["ticker", "month"], ["date", "ord"], ["before", "buy", "quantity", "cost"], _Month, "ticker string, month string, a double, b double, held double")
    return streamed(lines, ["ticker"], ["month"], ["a", "b", "held"], _Months, "ticker string, quantity double, cost double").select("ticker", F.round("quantity", 4).alias("quantity"), F.round("cost", 2).alias("cost"))


def fifo_cost(trades: DataFrame) -> DataFrame:
    """Cost of what each ticker sold, oldest lots first, as an overlap of cumulative intervals: buys cover
    [B - q, B), effective sells [E before, E). What a sell exceeds the holdings by is dropped."""
    w = Window.partitionBy("ticker").orderBy("date", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buy = F.col("side") == "C"
    run = trades.withColumn("b", F.sum(F.when(buy, F.col("quantity")).otherwise(0.0)).over(w)).withColumn("s", F.sum(F.when(buy, 0.0).otherwise(F.col("quantity"))).over(w))
    run = run.withColumn("low", F.min(F.col("b") - F.col("s")).over(w)).withColumn("e", F.col("s") - F.greatest(F.lit(0.0), -F.col("low")))
    before = Window.partitionBy("ticker").orderBy("date", "ord")
    sells = run.where(~buy).withColumn("e0", F.coalesce(F.lag("e").over(before), F.lit(0.0))).where("e > e0").select("ticker", "e0", "e")
    buys = run.where(buy).select("ticker", (F.col("b") - F.col("quantity")).alias("b0"), "b", (F.col("total").cast("double") / F.col("quantity")).alias("price"))
    # lots and sells meet in bins of quantity, and count in the bin where their overlap starts
    width = 64.0
    bins = lambda a, z: F.explode(F.sequence(F.floor(a / width), F.floor(z / width)))
    met = sells.withColumn("bin", bins(F.col("e0"), F.col("e"))).join(buys.withColumn("bin", bins(F.col("b0"), F.col("b"))), ["ticker", "bin"])
    start = F.greatest("e0", "b0")
    met = met.where((F.least("e", "b") > start) & (F.floor(start / width) == F.col("bin")))
    part = F.least("e", "b") - start
    return met.groupBy("ticker").agg(F.round(F.sum(part), 4).alias("sold"), F.round(F.sum((part * F.col("price")).cast("decimal(28,6)")), 4).cast("double").alias("cost"))


def flows(trades: DataFrame) -> DataFrame:
    """Signed cash flow per ticker and day: buys out, sells in."""
    return trades.groupBy("ticker", "date").agg(F.sum(F.when(F.col("side") == "C", -F.col("total")).otherwise(F.col("total"))).alias("flow"))


def running_flow(trades: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flows(trades).select("ticker", F.col("date").cast("string").alias("date"), F.col("flow").cast("double").alias("flow"), F.sum("flow").over(w).cast("double").alias("running"))


def xirr(flow: DataFrame, terminal: DataFrame, steps: int = 60) -> DataFrame:
    """Money-weighted return per ticker: the rate at which flows (ticker, date, flow) and the terminal value (ticker,
    tdate, value) sum to nothing, t in days over 365.25. Bisection on [-0.99, 10], then [-0.5, 5]; null without both
    signs, with fewer than two flows, or where neither bracket holds a change of sign."""
    per = flow.where("flow <> 0").groupBy("ticker").agg(F.collect_list(F.struct("date", F.col("flow").cast("double").alias("flow"))).alias("fs"))
    all_ = per.join(terminal, "ticker").withColumn("fs", F.filter(F.concat("fs", F.array(F.struct(F.col("tdate").alias("date"), F.col("value").alias("flow")))), lambda x: x["flow"] != 0))
    first = F.array_min(F.transform("fs", lambda x: x["date"]))
    all_ = all_.withColumn("first", first).withColumn("fs", F.array_sort(F.transform("fs", lambda x: F.struct((F.datediff(x["date"], F.col("first")) / 365.25).alias("t"), x["flow"].alias("f")))))

    def npv(r: Column) -> Column:
        return F.aggregate("fs", F.lit(0.0), lambda s, x: s + x["f"] / F.pow(F.lit(1.0) + r, x["t"]))

    def bisect(low: float, high: float) -> Column:
        start = F.struct(F.lit(low).alias("a"), F.lit(high).alias("z"), F.signum(npv(F.lit(low))).alias("sa"))

        def half(s: Column, _: Column) -> Column:
            m = (s["a"] + s["z"]) / 2
            same = F.signum(npv(m)) == s["sa"]
            return F.struct(F.when(same, m).otherwise(s["a"]).alias("a"), F.when(same, s["z"]).otherwise(m).alias("z"), s["sa"].alias("sa"))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half)
        return F.when(F.signum(npv(F.lit(low))) != F.signum(npv(F.lit(high))), (end["a"] + end["z"]) / 2)

    signs = F.exists("fs", lambda x: x["f"] > 0) & F.exists("fs", lambda x: x["f"] < 0) & (F.size("fs") >= 2)
    return all_.select("ticker", F.size("fs").cast("long").alias("n_flows"), F.when(signs, F.round(F.coalesce(bisect(-0.99, 10.0), bisect(-0.5, 5.0)), 5)).alias("xirr"))


def latest_close(quotes: DataFrame, by: str) -> DataFrame:
    return quotes.where(F.col("date") <= F.lit(by).cast("date")).groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("tdate"))


def offset_returns(quotes: DataFrame, offsets: tuple[int, ...] = (1, 30, 90, 180, 365)) -> DataFrame:
    """Return of each ticker's last close over the latest close at least so many days older, and since the year's first."""
    last = quotes.groupBy("ticker").agg(F.max_by("close", "date").alias("last"), F.max("date").alias("end"))
    both = quotes.join(last, "ticker")
    age = F.datediff("end", "date")
    picks = [F.max_by(F.when(age >= n, F.col("close")), F.when(age >= n, F.col("date"))).alias(f"c{n}") for n in offsets]
    ytd = F.year("date") == F.year("end")
    got = both.groupBy("ticker", "last").agg(*picks, F.min_by(F.when(ytd, F.col("close")), F.when(ytd, F.col("date"))).alias("y"))
    return got.select("ticker", "last", *(F.round(F.col("last") / F.col(f"c{n}") - 1, 4).alias(f"r{n}") for n in offsets), F.round(F.col("last") / F.col("y") - 1, 4).alias("ytd"))


def negative_episodes(events: DataFrame) -> DataFrame:
    """Stretches where an account's running balance is below zero: start, end (next event at or above), lowest balance."""
    order = Window.partitionBy("account").orderBy("ts", "event_id")
    run = events.withColumn("balance", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    neg = F.col("balance") < 0
    begun = run.withColumn("begin", neg & ~F.coalesce(F.lag(neg).over(order), F.lit(False))).withColumn("next", F.lead("ts").over(order))
    grouped = begun.withColumn("episode", F.sum(F.col("begin").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(neg)
    return grouped.groupBy("account", "episode").agg(
        F.min("ts").cast("string").alias("started"), F.min("balance").cast("double").alias("lowest"), F.count(F.lit(1)).alias("n"), F.max("next").alias("ended"),
    ).select("account", "episode", F.substring("started", 1, 19).alias("started"), "lowest", "n", F.substring(F.col("ended").cast("string"), 1, 19).alias("ended"))


def allocation(positions: DataFrame, key: str, value: str = "cost") -> DataFrame:
    """Value by key and its share of all."""
    per = positions.groupBy(key).agg(F.sum(value).alias("value"))
    total = per.agg(F.sum("value").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(key, F.col("value").cast("double").alias("value"), F.round(F.col("value").cast("double") / F.col("total").cast("double"), 6).alias("share"))


def income_by_month(income: DataFrame, latest: int = 24) -> DataFrame:
    """Income of the latest months, by type in columns."""
    per = income.groupBy(F.date_format("date", "yyyy-MM").alias("month")).pivot("type", ["dividendo", "jcp", "rendimento"]).agg(F.sum("value"))
    return per.orderBy(F.desc("month")).limit(latest).select("month", *(F.coalesce(F.col(t), F.lit(0)).cast("double").alias(t) for t in ("dividendo", "jcp", "rendimento")))


def income_kpis(income: DataFrame) -> DataFrame:
    """Lifetime income, that of the last 12 months present, number of payers and best month."""
    per = income.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("value").alias("v"))
    top = per.orderBy(F.desc("month")).limit(12).agg(F.sum("v").cast("double").alias("ttm"))
    life = per.agg(F.sum("v").cast("double").alias("lifetime"), F.max_by("month", F.struct("v", "month")).alias("best"))
    payers = income.agg(F.count_distinct("ticker").alias("payers"))
    return life.crossJoin(top).crossJoin(payers)


def unified_history(trades: DataFrame, income: DataFrame, otc: DataFrame) -> DataFrame:
    """All ledgers in one schema; value is signed: buys and applications out, the rest in."""
    t = trades.select("date", F.lit("orders").alias("ledger"), F.col("ticker").alias("id"), F.col("side").alias("kind"), F.when(F.col("side") == "C", -F.col("total")).otherwise(F.col("total")).cast("decimal(18,4)").alias("value"))
    i = income.select("date", F.lit("income").alias("ledger"), F.col("ticker").alias("id"), F.col("type").alias("kind"), F.col("value").cast("decimal(18,4)").alias("value"))
    o = otc.select("date", F.lit("otc").alias("ledger"), F.col("product").alias("id"), F.col("operation").alias("kind"), F.col("amount").cast("decimal(18,4)").alias("value"))
    return t.unionByName(i).unionByName(o)


def phantom_income(otc: DataFrame) -> DataFrame:
    """Totals per product, and whether it pays interest on nothing applied."""
    total = lambda op: F.sum(F.when(F.col("operation") == op, F.abs("amount")).otherwise(0)).cast("double").alias(op)
    return otc.groupBy("product").agg(total("aplicacao"), total("resgate"), total("juros")).withColumn("phantom", (F.col("juros") > 0) & (F.col("aplicacao") == 0))


def latest_snapshot(otc: DataFrame) -> DataFrame:
    """Last row of each product; of equal dates the one with the smallest key, operation, source and amount."""
    return otc.groupBy("product").agg(F.min_by(F.struct("date", "operation", "source", "amount"), F.struct(-F.datediff("date", F.lit("1970-01-01")), "key", "operation", "source", "amount")).alias("s")).select(
        "product", F.col("s.date").cast("string").alias("date"), "s.operation", "s.source", F.col("s.amount").cast("double").alias("amount"))


def order_total_gate(trades: DataFrame, most: float = 0.005) -> DataFrame:
    """Orders (broker, side, quantity, price, fees, total) whose booked total is off quantity x price, plus fees for a buy and
    less them for a sell, by more than most; per broker. A total of zero is not judged."""
    total = F.abs(F.col("total").cast("double"))
    gross, fees = F.col("quantity") * F.col("price"), F.coalesce("fees", F.lit(0.0))
    expected = F.when(F.col("side") == "C", gross + fees).otherwise(gross - fees)
    bad = (total != 0) & (F.abs(total - expected) / total > most)
    return trades.groupBy("broker").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad")).withColumn("passed", F.col("bad") == 0)


def irr_band_gate(rates: DataFrame, most: float = 2.0) -> DataFrame:
    verdict = F.when(F.col("xirr").isNull(), "missing").when(F.abs("xirr") > most, "out_of_band").otherwise("ok")
    return rates.select("ticker", verdict.alias("verdict"))


def trailing_sum(rows: DataFrame, key: str, days: int = 92) -> DataFrame:
    """Sum of the last so many days at each day of a key."""
    day = F.datediff("date", F.lit("1970-01-01"))
    per = rows.groupBy(key, "date").agg(F.sum("total").alias("v")).withColumn("day", day)
    return per.select(key, F.col("date").cast("string").alias("date"), F.sum("v").over(Window.partitionBy(key).orderBy("day").rangeBetween(-days, 0)).cast("double").alias("trailing"))
