"""Join patterns that Spark has no operator for: as-of, tolerance, offsetting pairs, bag difference,
snapshot comparison. All are equi-joins, windows and aggregates; nothing is paired with everything."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed

BUCKET = "yyyy-MM"


def asof_join(left: DataFrame, right: DataFrame, key: str, on: str, value: str, first_after: bool = True) -> DataFrame:
    """left with ``value`` of the latest right row of the key at or before ``on``; before the first: the earliest, if
    first_after. Windows run within (key, month); what a month inherits is carried over a table of months, so a key
    that holds a third of all rows still spreads over its months. right: one row a key and date."""
    month = F.date_format(on, BUCKET)
    r = right.select(key, on, value).withColumn("_m", month)
    ends = r.groupBy(key, "_m").agg(F.max_by(value, on).alias("_last"), F.min_by(value, on).alias("_first"))
    months = left.select(key, month.alias("_m")).union(r.select(key, "_m")).distinct()
    w = Window.partitionBy(key).orderBy("_m")  # a row a month
    carried = months.join(ends, [key, "_m"], "left").select(
        key, "_m", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.first("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_earliest"),
    )
    both = left.withColumn("_m", month).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_l", F.lit(1))
    rows = both.unionByName(r.select(key, on, "_m", F.col(value).alias("_v"), F.lit(0).alias("_l")), allowMissingColumns=True)
    inside = Window.partitionBy(key, "_m").orderBy(on, "_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside)).where("_l = 1")
    fallback = [F.col("_earliest")] if first_after else []
    return seen.join(carried, [key, "_m"]).withColumn(value, F.coalesce("_seen", "_carry", *fallback)).select(*left.columns, value)


class _Pairs:
    """Rows of one day, currency and size as they come: each is taken by the first row that waits for one of the other sign and
    another bank, or waits itself. That is what a scan does in which each row takes the first later one that is left: of all
    that wait for a row, the first one's turn comes first. A missing bank is a bank of its own."""

    def __init__(self, *key) -> None:
        self.key, self.waiting = key, {}

    def add(self, seq: int, bank: str | None, up: bool) -> list[tuple]:
        able = [q for (other, b), q in self.waiting.items() if other != up and b != bank and q]
        if not able:
            self.waiting.setdefault((up, bank), deque()).append(seq)
            return []
        first = min(able, key=lambda q: q[0]).popleft()
        return [(*self.key, seq, first) if up else (*self.key, first, seq)]

    def end(self) -> list[tuple]:
        return []


def offsetting_pairs(tx: DataFrame) -> DataFrame:
    """Rows of one day and currency that cancel between two banks: in order of seq (no two rows share one) each row takes the
    first one left of the opposite amount and another bank, so a row is used once; a missing bank is a bank of its own. Groups
    (date, currency, size) of two rows, which most are, need the group's aggregates only; larger ones with both signs and two
    banks stream through a fold, as each pair depends on those before it. Both parts read one and the same shuffle."""
    keys = ["date", "currency", "size"]
    sized = tx.where("amount <> 0").select(F.col("date").cast("string").alias("date"), "currency", F.abs("amount").cast("double").alias("size"), "seq", "bank", (F.col("amount") > 0).alias("up"))
    w, row = Window.partitionBy(*keys), F.struct("seq", "bank", "up")
    n, known = F.count(F.lit(1)).over(w), F.count("bank").over(w)
    banks = (F.min("bank").over(w) != F.max("bank").over(w)) | ((known > 0) & (known < n))
    able = sized.withColumn("_n", n).withColumn("_able", banks & F.bool_or("up").over(w) & F.bool_or(~F.col("up")).over(w)).withColumn("_a", F.min(row).over(w)).withColumn("_b", F.max(row).over(w)).where("_able")
    two = able.where((F.col("_n") == 2) & F.col("up")).select(*keys, F.col("seq").alias("in_seq"), F.when(F.col("_a.up"), F.col("_b.seq")).otherwise(F.col("_a.seq")).alias("out_seq"))
    return two.unionByName(streamed(able.where("_n > 2"), keys, ["seq"], ["seq", "bank", "up"], _Pairs, "date string, currency string, size double, in_seq long, out_seq long"))


def cross_source_dedup(rows: DataFrame, preferred: str = "broker", dropped: tuple[str, ...] = ("b3",)) -> DataFrame:
    """Rows of a dropped source go where the preferred one has the same date, operation, product and size."""
    key = ["date", "operation", "product", "size"]
    keyed = rows.withColumn("size", F.abs("amount"))
    known = keyed.where(F.col("source") == preferred).select(*key).distinct()
    other = keyed.where(F.col("source").isin(*dropped)).join(known, key, "left_anti")
    return keyed.where(~F.col("source").isin(*dropped)).unionByName(other.select(*keyed.columns)).drop("size")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Groups of one date, operation, product and size that several sources report."""
    return (
        rows.groupBy("date", "operation", "product", F.abs("amount").alias("size")).agg(F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n"))
        .where(F.size("sources") > 1)
        .select(F.col("date").cast("string").alias("date"), "operation", "product", F.col("size").cast("double").alias("size"), F.array_join("sources", ",").alias("sources"), "n", F.array_contains("sources", "broker").alias("covered"))
    )


def close_within(a: Column, b: Column, percent: float) -> Column:
    return (a == b) | (F.abs(a - b) <= F.lit(percent / 100) * F.greatest(F.abs(a), F.abs(b)))


def _bin(number: str, percent: float) -> tuple[Column, float]:
    """Logarithmic bins: numbers within percent of the larger one differ by at most one bin."""
    if not 0 <= percent < 100:
        raise ValueError("percent must be at least 0 and below 100")
    width = max(-math.log1p(-percent / 100), 1e-9) * (1 + 1e-9)
    return F.floor(F.log(F.greatest(F.abs(number), F.lit(1e-9))) / F.lit(width)), width


def tolerance_match(source: DataFrame, ledger: DataFrame, exact: list[str], number: str, percent: float) -> DataFrame:
    """For each source row the number of ledger rows of equal exact fields whose number lies within percent. Numbers meet
    in logarithmic bins (own and both neighbours), so one hot group of exact fields is not joined with itself. Rows alike
    in all columns are counted once and get the same."""
    bin_, _ = _bin(number, percent)
    row = F.struct(*source.columns).alias("_row")
    left = source.distinct().select("*", row).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: bin_ + o)))
    right = ledger.select(*exact, F.col(number).alias("_n"), bin_.alias("_b"))
    hits = left.join(right, [*exact, "_b"]).where(close_within(F.col(number), F.col("_n"), percent)).groupBy("_row").agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(F.col(number) == F.col("_n"), 1)).alias("exact")).withColumnRenamed("_row", "_hit")
    return source.select("*", row).join(hits, F.col("_row").eqNullSafe(F.col("_hit")), "left").drop("_row", "_hit").fillna(0, ["matches", "exact"])


def consumed_matches(source: DataFrame, ledger: DataFrame, exact: list[str], number: str, percent: float) -> DataFrame:
    """Source rows (seq, exact fields, number) with the ledger row (match: its seq, how: exact or fuzzy) that each takes, in
    order of seq: the first one left of equal exact fields within percent; a ledger row is taken at most once. What finds
    none is an insert. A fold per group of exact fields, as each match depends on those before it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_side", "seq"])
        mine, theirs = rows[rows["_side"] == 1], rows[rows["_side"] == 0]
        left = sorted(zip(theirs[number].tolist(), theirs["seq"].tolist()))
        numbers = [n for n, _ in left]
        used, out = set(), []
        for seq, x in zip(mine["seq"].tolist(), mine[number].tolist()):
            reach = abs(x) * percent / (100 - percent) + 1e-12
            near = range(bisect_left(numbers, x - reach), bisect_right(numbers, x + reach))
            fits = [i for i in near if i not in used and (numbers[i] == x or abs(numbers[i] - x) <= percent / 100 * max(abs(numbers[i]), abs(x)))]
            best = min(fits, key=lambda i: left[i][1], default=None)
            if best is not None:
                used.add(best)
            out.append((seq, None if best is None else left[best][1], "insert" if best is None else "exact" if numbers[best] == x else "fuzzy"))
        return pd.DataFrame(out, columns=["seq", "match", "how"]).astype({"match": "Int64"})

    both = source.select("seq", *exact, number, F.lit(1).alias("_side")).unionByName(ledger.select("seq", *exact, number, F.lit(0).alias("_side")))
    return both.groupBy(*exact).applyInPandas(fold, "seq long, match long, how string")


def bag_difference(source: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Rows by which source outnumbers ledger, per key: the surplus that an insert would add."""
    a, b = source.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), ledger.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, key, "left").select(*key, "n", F.coalesce("m", F.lit(0)).alias("known"), F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)).alias("surplus"))


def snapshot_delta(now: DataFrame, before: DataFrame, key: str, value: str, move: float = 0.2) -> DataFrame:
    """Ids that are new, gone to zero, or moved by more than ``move``; exactly ``move`` is none."""
    both = now.select(key, F.col(value).alias("now")).join(before.select(key, F.col(value).alias("before")), key, "full")
    change = F.round((F.col("now") - F.col("before")) / F.col("before"), 6)
    kind = (
        F.when(F.col("before").isNull(), "new").when(F.coalesce("now", F.lit(0.0)) == 0, "zeroed")
        .when((F.col("before") != 0) & (F.abs(change) > move), "moved")
    )
    return both.select(key, "now", "before", F.when(F.col("before") != 0, change).alias("change"), kind.alias("kind")).where("kind is not null")


def near_misses(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Number of rows that share a request's date or its amount, but not both; requests without any are left out. Rows
    are counted by date, by amount and by both first, so no pair is built."""
    known = rows.where("date is not null and amount is not null")
    n = F.count(F.lit(1))
    counts = [known.groupBy(*k).agg(n.alias(c)) for k, c in ((["date"], "_d"), (["amount"], "_a"), (["date", "amount"], "_b"))]
    met = requests.where("date is not null and amount is not null").select("rid", "date", "amount").join(counts[0], "date", "left").join(counts[1], "amount", "left").join(counts[2], ["date", "amount"], "left").fillna(0, ["_d", "_a", "_b"])
    return met.groupBy("rid").agg(F.sum(F.col("_d") + F.col("_a") - 2 * F.col("_b")).alias("near")).where("near > 0")


def path_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """added, changed and removed paths between two tables (path, hash)."""
    both = stored.select("path", F.col("hash").alias("a")).join(current.select("path", F.col("hash").alias("b")), "path", "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", kind.alias("kind")).where("kind is not null")
