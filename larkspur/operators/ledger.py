"""Ordered folds over ledgers that no window expresses: corporate actions that move holdings between tickers, and
foreign-currency accounts. A fold runs per group of tickers that actions connect, or per account; groups run apart."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import streamed
from .graph import connected


#: Kinds of assets that are held in whole units.
WHOLE = ("acao", "opcao", "direito_subscricao", "bdr", "fii")


class _Positions:
    """The tickers of one group: quantity and cost of each, known from its first trade or from what an action gave it."""

    def __init__(self, group: str) -> None:
        self.held: dict[str, list[float]] = {}

    def add(self, ticker: str, kind: str, n: float, total: float, ratio: float | None, target: str | None, whole: bool, target_whole: bool) -> tuple:
        if kind in ("C", "V"):
            p = self.held.setdefault(ticker, [0.0, 0.0])
            if kind == "C":
                p[0], p[1] = p[0] + n, p[1] + abs(total)
            else:
                p[1] = p[1] * (1 - min(n / p[0], 1.0)) if p[0] > 0 else p[1]
                p[0] -= n
            return ()
        p = self.held.get(ticker)
        if p is None:
            return ()
        if kind == "expiracao":
            p[0] = 0.0
        elif kind == "ajuste":
            p[0] = p[1] = 0.0
        elif ratio is None or ratio != ratio or ratio == 0:
            pass  # an action whose ratio is not filled in yet
        elif kind in ("grupamento", "desdobramento", "bonificacao"):
            p[0] *= ratio + (kind == "bonificacao")
            p[0] = float(int(p[0])) if whole else p[0]
        elif target is not None and kind in ("conversao", "incorporacao", "fusao", "cisao"):
            q = self.held.setdefault(target, [0.0, 0.0])
            if kind == "cisao":
                part = p[1] * ratio / (1 + ratio)
                q[0], q[1] = p[0] * ratio, part
                p[1] -= part
            else:
                q[0], q[1] = q[0] + p[0] * ratio, q[1] + p[1]
                p[0] = p[1] = 0.0
            q[0] = float(int(q[0])) if target_whole else q[0]
        return ()

    def end(self) -> list[tuple]:
        return [(t, q, c) for t, (q, c) in self.held.items()]


def positions(events: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Quantity and average cost per ticker after trades (C, V) and corporate actions, in order of seq. Tickers that an action
    connects are folded together, as one stream. ratio: new per old; an action whose ratio is not filled in yet, or whose ticker
    is not known yet, does nothing. An expiry clears the quantity and keeps the cost, an adjustment clears both. A demerger sets
    the new ticker's quantity and gives it ratio / (1 + ratio) of the cost. types (ticker, type): what actions leave of kinds
    that come in whole units is cut to whole units."""
    moves = events.where("target is not null").select(F.col("ticker").alias("u"), F.col("target").alias("v")).distinct()
    group = connected(moves)
    keyed = events.join(group, events["ticker"] == group["node"], "left").withColumn("g", F.coalesce("component", "ticker")).select(*events.columns, "g")
    for column, name in (("ticker", "whole"), ("target", "target_whole")):
        if types is None:
            keyed = keyed.withColumn(name, F.lit(False))
        else:
            kinds = types.groupBy("ticker").agg(F.max(F.lower(F.trim("type")).isin(*WHOLE)).alias(name)).withColumnRenamed("ticker", "_t")
            keyed = keyed.join(kinds, F.col(column) == F.col("_t"), "left").drop("_t").withColumn(name, F.coalesce(name, F.lit(False)))
    return streamed(keyed, ["g"], ["seq"], ["ticker", "kind", "quantity", "total", "ratio", "target", "whole", "target_whole"], _Positions, "ticker string, quantity double, cost double")


#: The order of events within a day.
TIERS = ("in", "income", "sell", "buy", "out")


#: What is less than this is nothing: a remainder of rounding, no lot.
NIL = 1e-12


def _consume(lots: deque, amount: float) -> None:
    """Takes amount from the oldest lots [quantity, rate, ...]; what they lack is lost. What is left of a lot is what the running
    total of the lots exceeds the amount by."""
    total = 0.0
    while lots:
        total += lots[0][0]
        left = min(lots[0][0], total - amount)
        if left > NIL:
            lots[0][0] = left
            return
        lots.popleft()


def _mean_rate(lots: deque) -> tuple[float, float]:
    held = worth = 0.0  # added up one by one: sum() of floats corrects its rounding, other engines' sums don't
    for x in lots:
        held, worth = held + x[0], worth + x[0] * x[1]
    return held, worth / held if held > 0 else 0.0


def _cost(lots: deque) -> float:
    cost = 0.0  # added up as above
    for n, rate, price in lots:
        cost += n * rate * price
    return cost


class _Account:
    """One foreign-currency account: its balance and average, tranches [amount, rate] and lots [quantity, rate, price]."""

    def __init__(self, account: str) -> None:
        self.account, self.balance, self.average, self.last = account, 0.0, 0.0, 0.0
        self.tranches: deque = deque()
        self.tickers: dict[str, deque] = {}

    def joined(self, amount: float, rate: float) -> float:
        """The average once amount has come in at a rate."""
        new = self.balance + amount
        return self.average if new <= 0 else rate if self.balance <= 0 else (self.balance * self.average + amount * rate) / new

    def rate(self, ticker: str) -> float:
        held, mean = _mean_rate(self.tickers.get(ticker, ()))
        return mean if held > 0 else self.average or self.last

    def add(self, seq: int, kind: str, ticker: str, amount: float, rate: float, quantity: float) -> list[tuple]:
        if kind == "in":
            if self.balance <= 0 and self.balance + amount > 0:
                self.tranches.clear()
            self.average, self.balance = self.joined(amount, rate), self.balance + amount
            if amount > 0:
                self.tranches.append([amount, rate])
        elif kind == "out":
            self.balance -= amount
            _consume(self.tranches, amount)
            held, mean = _mean_rate(self.tranches)
            if held > 0:
                self.average = mean
            elif self.balance <= 0:
                self.last, self.average = self.average if self.average > 0 else self.last, 0.0
        elif kind == "income":
            used = self.rate(ticker)
            self.average, self.balance = self.joined(amount, used), self.balance + amount
            return [(self.account, "income", ticker, seq, amount, used, None, amount * used)]
        elif kind == "buy":
            self.tickers.setdefault(ticker, deque()).append([quantity, self.average, amount / quantity if quantity else 0.0])
            self.balance -= amount
        elif kind == "sell":
            _consume(self.tickers.get(ticker, deque()), quantity)
            self.balance += amount
        return []

    def end(self) -> list[tuple]:
        out = [(self.account, "account", None, None, self.balance, self.average, self.last, None)]
        for t in sorted(self.tickers, key=lambda t: (t is not None, t)):
            lots = self.tickers[t]
            out.append((self.account, "ticker", t, None, _mean_rate(lots)[0], self.rate(t), None, _cost(lots)))
        return out


def fx_engine(events: DataFrame) -> DataFrame:
    """Foreign-currency accounts from events (account, date, seq, kind, ticker, amount, rate, quantity), folded by day, then in,
    income, sell, buy, out, then seq. One account is one ordered stream; its tranches and lots are taken oldest first.

    Rows by what: account (amount: the balance; rate: its average, 0 once all has gone home; last: the average before that),
    ticker (quantity held, mean rate of its lots or else the account's, cost in home currency of the lots that are open, each at
    its own price and rate), income (seq, amount, rate used, value in home currency). A transfer into an account that is not
    above zero replaces the average and its tranches; one out leaves the average of the tranches that remain; income counts at
    its ticker's rate, else the account's, else the last. A lot bought while the average is 0 has the rate 0."""
    kind = "account string, what string, ticker string, seq long, amount double, rate double, last double, brl double"
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("kind"))
    return streamed(events.withColumn("_tier", tier), ["account"], ["date", "_tier", "seq"], ["seq", "kind", "ticker", "amount", "rate", "quantity"], _Account, kind)


def fx_accounts(events: DataFrame) -> DataFrame:
    """Balance, average rate and last rate that was not zero per account. Columns that events lack are filled in: one day, no
    ticker, the amount as quantity."""
    for name, value in (("date", F.lit("").cast("string")), ("ticker", F.lit("").cast("string")), ("quantity", F.col("amount"))):
        events = events if name in events.columns else events.withColumn(name, value)
    return fx_engine(events).where("what = 'account'").select("account", F.col("amount").alias("balance"), F.col("rate").alias("average"), "last")


def spot_rate(accounts: DataFrame, fallback: float = 5.0) -> DataFrame:
    """The rate to value an account's holdings at: its average, else its last, else a fixed one."""
    return accounts.select("account", F.coalesce(F.nullif("average", F.lit(0.0)), F.nullif("last", F.lit(0.0)), F.lit(fallback)).alias("rate"))


def bridged_flows(flows: DataFrame, actions: DataFrame) -> DataFrame:
    """flows (ticker, date, flow) under the ticker that each belongs to in the end. actions (seq, date, kind, ticker, target,
    share): a conversion, merger or fusion hands all flows of its ticker on; a demerger those up to its day by its share (none
    where that is not known yet). Actions run in order of date and seq, so chains of renames are followed to their end.
    Tickers that actions connect are folded together; a fold works on one row a ticker and day, however many flows it has."""
    daily = flows.groupBy("ticker", "date").agg(F.sum("flow").cast("double").alias("flow"))
    group = connected(actions.where("target is not null").select(F.col("ticker").alias("u"), F.col("target").alias("v")))
    keyed = lambda rows: rows.join(group, rows["ticker"] == group["node"]).select(F.col("component").alias("g"), *rows.columns)

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = left[["ticker", "date", "flow"]]
        for _, day, kind, old, new, share in right.sort_values(["date", "seq"])[["seq", "date", "kind", "ticker", "target", "share"]].itertuples(index=False):
            mine = held["ticker"] == old
            if new is None or not mine.any():
                continue
            if kind in ("conversao", "incorporacao", "fusao"):
                held = held.assign(ticker=held["ticker"].where(~mine, new))
            elif kind == "cisao" and share == share and 0 < share < 1:
                moved = held[mine & (held["date"] <= day)]
                held = held.assign(flow=held["flow"].where(~(mine & (held["date"] <= day)), held["flow"] * (1 - share)))
                held = pd.concat([held, moved.assign(ticker=new, flow=moved["flow"] * share)])
        return held[["ticker", "date", "flow"]]

    touched = keyed(daily).groupBy("g").cogroup(keyed(actions).groupBy("g")).applyInPandas(fold, "ticker string, date date, flow double")
    alone = daily.join(group.select(F.col("node").alias("ticker")), "ticker", "left_anti")
    return alone.unionByName(touched).groupBy("ticker", "date").agg(F.sum("flow").alias("flow"))


def crypto_positions(trades: DataFrame) -> DataFrame:
    """Quantity and average cost per asset and exchange. A trade (seq, date, exchange, buy_asset, buy_quantity, sell_asset,
    sell_quantity, price_brl) is a buy of what it gains and a sell of what it gives; the home currency is no asset."""
    from .invest import average_cost

    legs = [
        trades.where(f"{s}_asset is not null and {s}_asset <> 'BRL'").select(
            F.concat_ws("@", f"{s}_asset", "exchange").alias("ticker"), "date", F.struct("seq").alias("ord"), F.lit(side).alias("side"), F.col(f"{s}_quantity").alias("quantity"), F.coalesce("price_brl", F.lit(0.0)).alias("total"))
        for s, side in (("buy", "C"), ("sell", "V"))
    ]
    return average_cost(legs[0].unionByName(legs[1]))
