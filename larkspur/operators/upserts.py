"""Upserts into ledgers and registers, each as the table that results or as the plan of what would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of new whose key it lacks; of equal keys in new the smallest row."""
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    return existing.unionByName(one.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def _least(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: the smallest by its other columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else rows.select(*key).distinct()


def seeded(existing: DataFrame, new: DataFrame, seeds: DataFrame, key: list[str], product: str = "product") -> DataFrame:
    """existing, then new rows of unknown key, then seeds of unknown key whose product has no flow before the seed's day. Of several
    rows of one key the smallest by its other columns counts, so that runs agree."""
    flows = existing.unionByName(_least(new, key).join(existing.select(*key), key, "left_anti").select(*existing.columns))
    first = flows.groupBy(product).agg(F.min("date").alias("_first"))
    keep = _least(seeds, key).join(flows.select(*key), key, "left_anti").join(first, product, "left").where(F.col("_first").isNull() | (F.col("_first") >= F.col("date")))
    return flows.unionByName(keep.select(*existing.columns))


def _wants(incoming: Column, stored: Column) -> Column:
    """Whether a field would change: blanks never do."""
    return (F.coalesce(F.trim(incoming.cast("string")), F.lit("")) != "") & ~incoming.eqNullSafe(stored)


def row_diff(existing: DataFrame, incoming: DataFrame, key: str, permitted: list[str]) -> DataFrame:
    """key, action (insert, update, noop), changed and blocked fields of each incoming row: what is stored changes only in
    permitted fields and only for something that is not blank."""
    fields = [c for c in incoming.columns if c != key]
    both = incoming.select(key, *(F.col(c).alias(f"_n_{c}") for c in fields)).join(existing.select(F.col(key), *(F.col(c).alias(f"_o_{c}") for c in fields), F.lit(True).alias("_known")), key, "left")
    listed = lambda some: F.array_compact(F.array(*(F.when(F.col("_known") & _wants(F.col(f"_n_{c}"), F.col(f"_o_{c}")), F.lit(c)) for c in some))) if some else F.array().cast("array<string>")
    changed, blocked = listed([c for c in fields if c in permitted]), listed([c for c in fields if c not in permitted])
    action = F.when(F.col("_known").isNull(), "insert").when(F.size(changed) > 0, "update").otherwise("noop")
    return both.select(key, action.alias("action"), F.array_join(changed, ",").alias("changed"), F.array_join(blocked, ",").alias("blocked"))


def owned_upsert(existing: DataFrame, incoming: DataFrame, key: str, permitted: list[str]) -> DataFrame:
    """existing with new rows added whole and known ones updated as row_diff says. One row a key on either side."""
    fields = [c for c in existing.columns if c != key]
    both = existing.select(key, *(F.col(c).alias(f"_o_{c}") for c in fields), F.lit(True).alias("_known")).join(incoming.select(key, *(F.col(c).alias(f"_n_{c}") for c in fields), F.lit(True).alias("_sent")), key, "full")

    def field(c: str) -> Column:
        old, new = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        keep = F.when(F.col("_sent") & _wants(new, old), new).otherwise(old) if c in permitted else old
        return F.when(F.col("_known").isNull(), new).otherwise(keep).alias(c)

    return both.select(key, *map(field, fields))


def method_upsert(existing: DataFrame, incoming: DataFrame, key: list[str], methods: list[str]) -> DataFrame:
    """What each incoming row (key, value, method) does to the table: insert; skip or upgrade where the value is the same and
    the stored method ranks no lower or lower (methods: best first); conflict where values differ."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, methods)), c)
    both = incoming.select(*key, F.col("value").alias("new"), F.col("method").alias("via")).join(existing.select(*key, F.col("value").alias("old"), F.col("method").alias("stored")), key, "left")
    action = F.when(F.col("stored").isNull(), "insert").when(~F.col("old").eqNullSafe(F.col("new")), "conflict").when(rank(F.col("via")) < rank(F.col("stored")), "upgrade").otherwise("skip")
    return both.select(*key, "new", "old", action.alias("action"))


def surplus_rows(source: DataFrame, ledger: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of source beyond as many as the ledger has of their key, in order: what an insert would add. Ranks run within
    the key, and counts come from the aggregated ledger, so no row meets another."""
    n = ledger.groupBy(*key).agg(F.count(F.lit(1)).alias("_known"))
    ranked = source.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.join(n, key, "left").where(F.col("_r") > F.coalesce("_known", F.lit(0))).drop("_r", "_known")


def fuzzy_gate(matches: DataFrame) -> DataFrame:
    """A report of matches (how) passes only without fuzzy ones."""
    return matches.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("how") == "fuzzy", 1)).alias("fuzzy"), F.count(F.when(F.col("how") == "insert", 1)).alias("inserts")).withColumn("passed", F.col("fuzzy") == 0)


def first_within(rows: DataFrame, records: DataFrame, key: list[str], number: str, most: float = 0.005, value: str = "value") -> DataFrame:
    """rows (rid, key, number) with the value of the first record (seq) of their key whose number is within most."""
    bin_ = lambda c: F.floor(c / (2 * most))
    r = rows.select("rid", *key, F.col(number).alias("_a"), F.explode(F.array(*(bin_(F.col(number)) + k for k in (-1, 0, 1)))).alias("_b"))
    c = records.select("seq", *key, F.col(number).alias("_n"), F.col(value).alias("_v"), bin_(F.col(number)).alias("_b"))
    hit = r.join(c, [*key, "_b"]).where(F.abs(F.col("_a") - F.col("_n")) < most).groupBy("rid").agg(F.min_by("_v", "seq").alias(value))
    return rows.select("rid").join(hit, "rid", "left")


def corrected(rows: DataFrame, corrections: DataFrame, rel: float = 1e-6) -> DataFrame:
    """rows (ticker, date, quantity, seq) with the quantity of the first correction (ticker, date, from_value, to_value, seq) whose
    from_value is the row's quantity to rel of its size. Few corrections share a ticker and day."""
    c = corrections.select("ticker", "date", "from_value", "to_value", F.col("seq").alias("_c"))
    near = F.abs(F.col("quantity") - F.col("from_value")) <= rel * F.greatest(F.abs("quantity"), F.abs("from_value"))
    hit = rows.join(c, ["ticker", "date"]).where(near).groupBy("seq").agg(F.min_by("to_value", "_c").alias("_to"))
    return rows.join(hit, "seq", "left").withColumn("corrected", F.col("_to").isNotNull()).withColumn("quantity", F.coalesce("_to", "quantity")).drop("_to")


def phantom(moves: DataFrame, migrations: DataFrame) -> DataFrame:
    """moves without those that only a migration of codes makes: a redemption of the old product on its last day, an
    application to the new one on its first. migrations: from_product, from_date, to_product, to_date."""
    out = migrations.select(F.col("from_product").alias("product"), F.col("from_date").alias("date"), F.lit("resgate").alias("operation"))
    back = migrations.select(F.col("to_product").alias("product"), F.col("to_date").alias("date"), F.lit("aplicacao").alias("operation"))
    return moves.join(out.unionByName(back).distinct(), ["product", "date", "operation"], "left_anti")


def migration_seeds(migrations: DataFrame) -> DataFrame:
    """One row a new product: what all its old codes held goes in, on the latest of their days."""
    return migrations.groupBy(F.col("to_product").alias("product")).agg(F.max("from_date").alias("date"), (-F.sum("from_total")).alias("amount")).withColumn("operation", F.lit("aplicacao"))


def earliest_real(moves: DataFrame) -> DataFrame:
    """First day of each product, seeds not counted."""
    return moves.groupBy("product").agg(F.min(F.when(~F.col("source").endswith("_seed"), F.col("date"))).cast("string").alias("first"))


def method_merged(existing: DataFrame, incoming: DataFrame, key: list[str], methods: list[str], order: str = "n") -> tuple[DataFrame, DataFrame]:
    """The table after incoming rows (key, value, method, n) were taken in order, and what became of each row: inserted, skipped,
    upgraded or a conflict.

    A key's value is the table's, or else that of its first incoming row; it is never overwritten. Rows of the same value may
    better the method (methods: best first; unknown ones are worst), so of several each is compared with the best before it.
    existing (key, value, method) has a key once. All is windows over a key's rows: no row is looked up in a loop."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, methods)), c), F.lit(0)), F.lit(len(methods) + 1))
    stored = existing.select(*key, "value", "method", F.lit(None).cast(incoming.schema[order].dataType).alias(order), F.lit(True).alias("_old"))
    rows = stored.unionByName(incoming.select(*key, "value", "method", order, F.lit(False).alias("_old")))
    w = Window.partitionBy(*key).orderBy(F.desc("_old"), order, "value", "method")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = F.col("value").eqNullSafe(F.col("_base"))
    best = F.min(F.when(same, rank(F.col("method")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_base", F.first("value").over(first)).withColumn("_at", F.row_number().over(w)).withColumn("_best", best)
    action = F.when(F.col("_old"), F.lit(None).cast("string")).when(F.col("_at") == 1, "inserted").when(~same, "conflict").when(rank(F.col("method")) < F.col("_best"), "upgraded").otherwise("skipped")
    told = marked.withColumn("action", action)
    merged = told.where(same).groupBy(*key).agg(F.first("_base").alias("value"), F.min_by("method", F.struct(rank(F.col("method")), "_at")).alias("method"))
    return merged, told.where("not _old").select(*key, order, F.col("_base").alias("kept"), F.col("value").alias("sent"), "action")
