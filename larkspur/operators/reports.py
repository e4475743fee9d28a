"""Smaller reports, lookups and classifiers over the ledgers and the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Total of each key and its share of all."""
    per = rows.groupBy(key).agg(F.sum(value).cast("double").alias("total"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("total").alias("_all")))).select(key, "total", F.round(F.col("total") / F.col("_all"), 6).alias("share"))


def maturity_ladder(assets: DataFrame) -> DataFrame:
    return assets.groupBy(F.year("maturity").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("active"), 1)).alias("n_active"))


def latest_filed(facts: DataFrame) -> DataFrame:
    """Of facts (metric, period, filed, value) the one filed last per metric and period; the largest value on ties."""
    return facts.groupBy("metric", "period").agg(F.max_by("value", F.struct("filed", "value")).alias("value"), F.max("filed").cast("string").alias("filed"))


def indicators(quotes: DataFrame) -> DataFrame:
    """Last close and its change from the close before; needs two."""
    w = Window.partitionBy("ticker").orderBy("date")
    two = quotes.withColumn("before", F.lag("close").over(w)).groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max_by("before", "date").alias("before"))
    return two.where("before is not null").select("ticker", "close", F.round(F.col("close") / F.col("before") - 1, 6).alias("change"))


def options(tx: DataFrame) -> DataFrame:
    """Values that filters can offer, by field."""
    each = [tx.select(F.lit(c).alias("field"), F.col(c).alias("value")).distinct() for c in ("bank", "category", "currency", "source_type")]
    out = tx.select(F.lit("tag").alias("field"), F.explode("tags").alias("value")).distinct()
    for e in each:
        out = out.unionByName(e)
    return out


def subdivision(docs: DataFrame, least: int = 10) -> DataFrame:
    """Kinds with enough documents to stand alone, per source; the rest are stragglers."""
    per = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("verdict", F.when(F.col("n") >= least, "subdivide").otherwise("straggler"))


def cross_currency(tx: DataFrame, vendors: tuple[str, ...] = ("URGENT",), funding: tuple[str, ...] = (), noise: tuple[str, ...] = (), matched: DataFrame | None = None) -> DataFrame:
    """Best counterpart of each funding row on its day: other bank and currency, opposite signs; a vendor's name in the counterpart's
    description scores 100, a plausible rate 10; ties to the smallest seq. Only rows whose description holds a word of
    ``funding`` are served (all without words), counterparts with a word of ``noise`` don't count, any case; rows of ``matched``
    (seq) are out on both sides.

    A funding row meets the smallest seq of each kind of counterpart, and for the rate that of each logarithmic bin of
    amounts between 3 and 8 times its own; only in the bins at both ends do amounts meet one by one."""

    def holds(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for x in words:
            out = out | F.contains(F.upper(F.coalesce("description", F.lit(""))), F.lit(x.upper()))
        return out

    tx = tx.join(matched.select("seq"), "seq", "left_anti") if matched is not None else tx
    width = 0.05
    bin_ = lambda x: F.floor(F.log(x) / width)
    a = tx.where((F.col("amount") > 0) & (holds(funding) if funding else F.lit(True))).select(F.col("seq").alias("fund"), "date", F.col("bank").alias("ba"), F.col("currency").alias("ca"), F.col("amount").cast("double").alias("aa"))
    named = F.when(holds(vendors), 100).otherwise(0).alias("score")
    b = tx.where((F.col("amount") < 0) & ~holds(noise)).select("seq", "date", "bank", "currency", named, F.col("amount").cast("double").alias("amount")).withColumn("bin", bin_(F.abs("amount")))
    least = F.min("seq").alias("seq")
    kind = ["date", "bank", "currency", "score"]
    low, high = bin_(F.col("aa") * 3), bin_(F.col("aa") * 8)
    inner = a.withColumn("bin", F.explode(F.sequence(low + 2, high - 2)))
    ends = a.withColumn("bin", F.explode(F.array(*(e + o for e in (low, high) for o in (-1, 0, 1)))))
    ratio = F.abs(F.col("amount") / F.col("aa"))
    plausible = (F.col("score") + 10).alias("score")
    met = (
        a.join(b.groupBy(*kind).agg(least), "date").where("bank <> ba and currency <> ca").select("fund", "seq", "score")
        .unionByName(inner.join(b.groupBy(*kind, "bin").agg(least), ["date", "bin"]).where("bank <> ba and currency <> ca").select("fund", "seq", plausible))
        .unionByName(ends.join(b.groupBy(*kind, "bin", "amount").agg(least), ["date", "bin"]).where("bank <> ba and currency <> ca").where(ratio.between(3.0, 8.0)).select("fund", "seq", plausible))
    )
    best = met.groupBy("fund").agg(F.min(F.struct(-F.col("score"), F.col("seq"))).alias("b"))
    return best.select("fund", "b.seq", (-F.col("b.col1")).cast("long").alias("score"))


def name_lookup(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Canonical names by exact key, then by the key in any case; the rest are unknown."""
    exact = rows.join(names.select(F.col("raw").alias("name"), F.col("canonical").alias("a")), "name", "left")
    loose = names.groupBy(F.lower("raw").alias("_k")).agg(F.min("canonical").alias("b"))
    return exact.withColumn("_k", F.lower("name")).join(loose, "_k", "left").select("id", F.coalesce("a", "b").alias("canonical"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "folded").otherwise("unknown").alias("how"))


def asset_class(kind: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """The class (name: kinds) that lists the kind, else other."""
    out = F.lit(None).cast("string")
    for name, kinds in classes.items():
        out = F.coalesce(out, F.when(kind.isin(*kinds), name))
    return F.coalesce(out, F.lit("other"))


def rate_form(indexer: Column, rate: Column, percent: Column) -> Column:
    """How a bond pays: a fixed rate, a spread over an indexer, or a percentage of one."""
    return (
        F.when((indexer == "PRE") & rate.isNotNull(), "prefixed").when((indexer != "PRE") & rate.isNotNull() & (F.coalesce(percent, F.lit(100.0)) == 100), "spread")
        .when((indexer != "PRE") & rate.isNull() & percent.isNotNull(), "percent_of_indexer").otherwise("invalid")
    )


def size_bucket(chars: Column) -> Column:
    n = F.floor(chars / 4)
    return F.when(n.isNull() | (n >= 5000), "large").otherwise("small")


def duration_kind(days: Column) -> Column:
    return F.when(days.between(80, 100), "quarterly").when(days.between(350, 380), "annual")


def institution(name: Column, known: list[tuple[str, str]]) -> Column:
    """The first known fragment (fragment, label) of a name decides."""
    out = F.lit(None).cast("string")
    for part, label in known:
        out = F.coalesce(out, F.when(name.contains(part), label))
    return F.coalesce(out, F.lit("outros"))


def footnote_order(docs: DataFrame, pattern: str) -> DataFrame:
    """Marks in the order of first appearance per document, numbered anew."""
    marks = docs.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("pos", "mark"))
    first = marks.groupBy("id", "mark").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return first.select("id", "mark", "n", F.row_number().over(Window.partitionBy("id").orderBy("first")).cast("long").alias("number"))


def rename_collisions(docs: DataFrame) -> DataFrame:
    """New names that several documents (title) would get."""
    from ..functions.scalar import slug

    return docs.select(slug(F.col("title")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and name <> ''")


def lead_sentence(text: Column, most: int = 80) -> Column:
    """First line, up to its first full stop where that is 15 characters in or more, cut at a word."""
    line = F.trim(F.split(text, "\n").getItem(0))
    stop = F.instr(line, ".")
    one = F.when(stop >= 15, F.left(line, stop)).otherwise(line)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(most)), r" [^ ]*$", ""), F.lit("...")))


def routed_date(text: Column) -> Column:
    """The one date that a line names; null for none or several."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), 0))
    return F.when(F.size(found) == 1, found[0].try_cast("date"))


def contamination(quotes: DataFrame) -> DataFrame:
    """Share of a day's quotes that repeat the ticker's close of the day before: a sign of stale snapshots."""
    w = Window.partitionBy("ticker").orderBy("date")
    same = quotes.withColumn("same", (F.lag("close").over(w) == F.col("close")).cast("int"))
    return same.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("same", F.lit(0))).alias("repeated"))


def sorted_nulls_last(rows: DataFrame, k: int = 25) -> DataFrame:
    return rows.orderBy(F.col("value").desc_nulls_last(), "id").limit(k)


def concentration(otc: DataFrame, k: int = 2) -> DataFrame:
    """The largest k products of each source."""
    per = otc.groupBy("source", "product").agg(F.sum(F.abs("amount")).alias("v"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("v"), "product"))
    return per.withColumn("r", r).where(F.col("r") <= k).select("source", "product", F.col("r").cast("long").alias("r"), F.col("v").cast("double").alias("v"))
