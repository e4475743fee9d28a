"""The row pipeline of the spend ledger: overrides by identity, classification, recurrence, dates, names, tags, suppliers.

A row's identity is its trimmed date and description and its amount as a number (as trimmed text where it is none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["_day", "_text", "_amount"]


def amount_key(c: Column) -> Column:
    """'1.0', '1.00' and 1 are one amount; what is no number counts as it is written."""
    s = F.trim(c.cast("string"))
    return F.coalesce(s.try_cast("double").cast("string"), s)


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_day", F.trim(F.col("date").cast("string"))).withColumn("_text", F.trim("description")).withColumn("_amount", amount_key(F.col("amount")))


def overridden(tx: DataFrame, overrides: DataFrame) -> DataFrame:
    """tx with category and accrual replaced where an override (date, description, amount, category, accrual) has the
    row's identity; blank fields leave the row as it is. An accrual that is no date is an error. Of several overrides of
    one identity the largest wins, by category, then accrual."""
    o = identified(overrides).groupBy(*IDENTITY).agg(F.max(F.struct("category", "accrual")).alias("o"))
    day = F.nullif(F.trim("o.accrual"), F.lit(""))
    parsed = F.when(day.isNotNull() & day.try_cast("date").isNull(), F.raise_error(F.concat(F.lit("no date: "), day))).otherwise(day.try_cast("date"))
    both = identified(tx).join(o, IDENTITY, "left")
    return both.withColumn("category", F.coalesce(F.nullif(F.trim("o.category"), F.lit("")), F.col("category"))).withColumn("accrual", F.coalesce(parsed, F.col("accrual"))).withColumn("manual", F.col("o").isNotNull()).drop("o", *IDENTITY)


def match_counts(requests: DataFrame, tx: DataFrame) -> DataFrame:
    """Requests (rid, date, description, amount) with how many ledger rows they name: none, one or many."""
    n = identified(tx).groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"))
    got = identified(requests).join(n, IDENTITY, "left").select("rid", F.coalesce("n", F.lit(0)).alias("n"))
    return got.withColumn("verdict", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many"))


def unique_within(requests: DataFrame, tx: DataFrame, cents: float = 0.5) -> DataFrame:
    """The one ledger row (seq) of a request's date and description whose amount is within half a cent; more than one is
    an error. Amounts meet in bins of a cent and their neighbours."""
    bin_ = lambda c: F.round(c * 100).cast("long")
    r = requests.select("rid", "date", "description", F.col("amount").alias("a"), F.explode(F.array(*(bin_(F.col("amount")) + k for k in (-1, 0, 1)))).alias("_b"))
    t = tx.select("seq", "date", "description", F.col("amount").alias("b"), bin_(F.col("amount")).alias("_b"))
    hit = r.join(t, ["date", "description", "_b"]).where(F.abs(F.col("a") - F.col("b")) <= cents / 100 + 1e-9).groupBy("rid").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return hit.select("rid", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several rows for "), F.col("rid").cast("string")))).otherwise(F.col("seq")).alias("seq"))


def recurring(tx: DataFrame, vendors: DataFrame, defaults: dict[str, str], fallback: str = "one_off") -> DataFrame:
    """tx with recurrence: none for transfers; else the longest vendor override (vendor, recurrence) that the description
    contains, any case, of equally long ones the first by ``rank`` where vendors has one (a vendor that stands twice has the
    first recurrence by name); installments; the category's default."""
    from .containment import longest_alias
    from .rules import recurrence

    named = longest_alias(tx, vendors.select(F.col("vendor").alias("alias"), F.col("rank") if "rank" in vendors.columns else F.lit(0).alias("rank")).distinct(), "description")
    both = named.join(vendors.groupBy(F.col("vendor").alias("alias")).agg(F.min("recurrence").alias("own")), "alias", "left")
    base = recurrence(F.col("n"), F.col("m"), F.col("category"), defaults, fallback)
    return both.select(*tx.columns, F.when(F.col("category") == "intercontas", F.lit(None)).otherwise(F.coalesce("own", base)).alias("recurrence"))


def recurrences(tx: DataFrame, vendors: DataFrame, defaults: dict[str, str], fallback: str = "one_off") -> DataFrame:
    """seq and recurrence of each row."""
    return recurring(tx.select("seq", "description", "category", "n", "m"), vendors, defaults, fallback).select("seq", "recurrence")


def dated(tx: DataFrame, invoices: DataFrame) -> DataFrame:
    """tx with cash and accrual: a card row is paid with its bank's invoice of its month (bank, month, payment_date) and accrues on
    its own day, or where an override (accrual) says so; a card row without an invoice is an error."""
    month = F.date_format("date", "yyyy-MM")
    both = tx.withColumn("month", month).join(invoices, ["bank", "month"], "left")
    card = F.col("source_type") == "fatura"
    paid = F.when(card & F.col("payment_date").isNull(), F.raise_error(F.concat(F.lit("no invoice of "), F.col("bank"), F.lit(" "), F.col("month")))).when(card, F.col("payment_date")).otherwise(F.col("date"))
    return both.select(*(c for c in tx.columns if c != "accrual"), paid.cast("string").alias("cash"), F.coalesce("accrual", "date").cast("string").alias("accrual"))


def basis_dates(tx: DataFrame, invoices: DataFrame) -> DataFrame:
    """seq, cash and accrual of each row."""
    return dated(tx, invoices).select("seq", "cash", "accrual")


def canonical_name(c: Column, exceptions: DataFrame | None = None) -> Column:
    """Each word starts with a capital and goes on in small letters; a letter after anything but a letter starts a word."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000)))), "")


def canonicalised(rows: DataFrame, name: str, exceptions: DataFrame) -> DataFrame:
    """name as the exception list (raw, canonical; any case) has it, else in title case."""
    e = exceptions.groupBy(F.lower("raw").alias("_k")).agg(F.min("canonical").alias("_c"))
    return rows.withColumn("_k", F.lower(name)).join(e, "_k", "left").withColumn(name, F.coalesce("_c", canonical_name(F.col(name)))).drop("_k", "_c")


def rule_tags(refunds: dict[str, str], projects: list[tuple[tuple[str, ...], str, str]]) -> Column:
    """A row's tags and those that rules add, sorted: of a supplier's incoming rows (supplier: tag), and of suppliers within a
    category (suppliers, category, tag)."""
    none = F.array().cast("array<string>")
    out = F.col("tags")
    for supplier, tag in refunds.items():
        out = F.array_union(out, F.when((F.col("supplier") == supplier) & (F.col("amount") > 0), F.array(F.lit(tag))).otherwise(none))
    for suppliers, category, tag in projects:
        out = F.array_union(out, F.when(F.col("supplier").isin(*suppliers) & (F.col("category") == category), F.array(F.lit(tag))).otherwise(none))
    return F.array_join(F.sort_array(out), "|")


def tagged(tx: DataFrame, refunds: dict[str, str], projects: list[tuple[tuple[str, ...], str, str]]) -> DataFrame:
    """seq and tags of each row."""
    return tx.select("seq", rule_tags(refunds, projects).alias("tags"))


def movable(tx: DataFrame, suppliers: DataFrame) -> DataFrame:
    """seq, movable of the row's supplier (movable: yes, no, mixed). Mixed goes by the category's hint, and without one is an error."""
    both = tx.select("seq", "supplier", "hint").join(suppliers.select("supplier", "movable"), "supplier", "left")
    mixed = F.when(F.col("hint").isNull(), F.raise_error(F.concat(F.lit("no hint for "), F.col("supplier")))).otherwise(F.col("hint"))
    return both.select("seq", F.when(F.col("movable") == "mixed", mixed).when(F.col("movable") == "yes", True).when(F.col("movable") == "no", False).alias("movable"))


def cash_expense(source_type: Column, supplier: Column, cash: tuple[str, ...]) -> Column:
    return (source_type == "extrato") & F.lower(F.trim(supplier)).isin(*(c.lower() for c in cash))


def tag_sign_ok(tag: Column, amount: Column, income_only: tuple[str, ...], expense_only: tuple[str, ...]) -> Column:
    """Whether a tag may stand on a row of this sign."""
    return ~((tag.isin(*income_only) & (amount <= 0)) | (tag.isin(*expense_only) & (amount >= 0)))


def config_overlaps(aliases: DataFrame, vendors: DataFrame, patterns: DataFrame) -> DataFrame:
    """Aliases (slug, alias) that value rules (vendor) or patterns of transfers to oneself (pattern) name as well."""
    key = lambda c: F.upper(F.trim(c))
    a = aliases.select("slug", key(F.col("alias")).alias("key"))
    hit = lambda other, column, code: a.join(other.select(key(F.col(column)).alias("key")).distinct(), "key").select(F.lit(code).alias("check"), "slug", "key")
    return hit(vendors, "vendor", "vendor").unionByName(hit(patterns, "pattern", "self_transfer"))


def category_tag_collisions(categories: DataFrame, tags: DataFrame) -> DataFrame:
    """Names that are a category and a tag; there must be none."""
    once = lambda d: d.select(F.lower("name").alias("name")).distinct()  # noqa: E731  before they meet: a name may be on most rows
    return once(categories).intersect(once(tags))


def rule_fires(classified: DataFrame) -> DataFrame:
    """How often each layer decided, and its share."""
    n = classified.groupBy("layer", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def unknown_suppliers(tx: DataFrame, least: int = 2) -> DataFrame:
    """Rows without a supplier by description: how many, how much, first day."""
    return tx.where(F.trim("supplier") == "").groupBy(F.upper(F.trim("description")).alias("description")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"), F.min("date").cast("string").alias("first")).where(F.col("n") >= least)


def review_queue(tx: DataFrame, reimbursable: tuple[str, ...]) -> DataFrame:
    """Rows to look at, in three passes: unknown suppliers, unidentified categories, incoming rows of reimbursers."""
    one = tx.where(F.trim("supplier") == "").select(F.lit(1).alias("pass"), "seq")
    two = tx.where((F.trim("supplier") != "") & (F.col("category") == "a_identificar")).select(F.lit(2).alias("pass"), "seq")
    three = tx.where((F.col("amount") > 0) & F.col("supplier").isin(*reimbursable)).select(F.lit(3).alias("pass"), "seq")
    return one.unionByName(two).unionByName(three)


def pass_gate(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per pass how many rows are open, and whether it may start: all passes before it must be empty."""
    open_ = queue.join(resolved, "seq", "left_anti").groupBy("pass").agg(F.count(F.lit(1)).alias("open"))
    every = queue.select("pass").distinct().join(open_, "pass", "left").select("pass", F.coalesce("open", F.lit(0)).alias("open"))
    before = F.sum("open").over(Window.orderBy("pass").rowsBetween(Window.unboundedPreceding, -1))  # three rows
    return every.withColumn("may_start", F.coalesce(before, F.lit(0)) == 0)


def tag_state(events: DataFrame) -> DataFrame:
    """Governance of proposed tags from events (token, seq, action): the last action decides; a rejected token comes back for
    review each third time that it is rejected."""
    per = events.groupBy("token").agg(F.max_by("action", "seq").alias("state"), F.count(F.when(F.col("action") == "reject", 1)).alias("rejections"))
    return per.withColumn("resurface", (F.col("state") == "reject") & (F.col("rejections") % 3 == 0))


def renamed(tx: DataFrame, tags: dict[str, str], categories: dict[str, str]) -> DataFrame:
    """Retro-rewrite: tags and categories by their new names (a tag that is there already is not doubled), and whether a row changed."""
    new_tag = lambda t: F.coalesce(*(F.when(t == a, F.lit(b)) for a, b in tags.items()), t)
    new = F.array_distinct(F.transform("tags", new_tag))
    category = F.coalesce(*(F.when(F.col("category") == a, F.lit(b)) for a, b in categories.items()), F.col("category"))
    changed = (new != F.col("tags")) | ~category.eqNullSafe(F.col("category"))
    return tx.withColumn("changed", changed).withColumn("tags", new).withColumn("category", category)
