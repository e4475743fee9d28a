"""Which of many patterns a text contains, patterns of any length, anywhere in the text, by anchors.

Every pattern is filed under its rarest run of characters, as long as the largest power of two that it holds; a text meets only
the patterns whose anchor it holds, in an equi-join, and each meeting is verified on the whole pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Lengths of anchors, and tasks over which the texts of one anchor are dealt.
SIZES, PARTS = (1, 2, 4, 8, 16, 32), 16
#: Up to so many runs are broadcast, and up to so many aliases are part of the plan.
FEW, LISTED = 200_000, 64


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) for every distinct text (texts.text) and distinct pattern (patterns.pattern) that it contains. Nulls take
    no part and an empty pattern is in no text; characters are compared as they are.

    Only anchors are joined: the rarest run of each pattern by the number of texts that hold it, so what meets is near what
    matches. Runs are nearly as long as the patterns: of three characters, a thousand numbers share each, and what meets grows
    with the square of the input. Runs and texts are joined as hashes; texts come back for the verification, which also settles
    equal hashes. The texts of an anchor are dealt over PARTS tasks, as a short pattern's anchor may be in all of them."""
    t = texts.select("text").where("text is not null").distinct().select(F.xxhash64("text").alias("h"), "text")
    return t.join(_met(t, patterns), "h").where(F.contains("text", "pattern")).select("text", "pattern")


def naming(texts: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(key, pattern) for every row of texts (key, text; keys unique) and distinct pattern (patterns.pattern) that its text contains.
    As ``contained``, but texts go by their keys: they are shuffled once, to be verified, and what leaves the verification is narrow."""
    t = texts.where("text is not null").select(F.col(key).alias("h"), "text")
    return t.join(_met(t, patterns), "h").where(F.contains("text", "pattern")).select(F.col("h").alias(key), "pattern")


def _met(t: DataFrame, patterns: DataFrame) -> DataFrame:
    """(h, pattern) for texts (h, text) and the patterns whose anchors they hold."""
    p = patterns.select("pattern").where("pattern <> ''").distinct()
    size = F.greatest(*(F.when(F.length("pattern") >= n, F.lit(n)) for n in SIZES), F.lit(1))
    runs = F.coalesce(*(F.when(F.col("q") == n, _grams(F.col("pattern"), n)) for n in SIZES))
    wanted = p.withColumn("q", size).select("pattern", "q", F.explode(runs).alias("gram")).select("pattern", "q", F.xxhash64("gram").alias("gram"))
    lengths = {r["q"]: r["n"] for r in wanted.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a length
    if not lengths:
        return t.select("h", F.col("text").alias("pattern")).limit(0)
    asked = wanted.select("gram").distinct()
    if sum(lengths.values()) <= FEW:
        asked = F.broadcast(asked)  # bounded; other runs of a text go before they are shuffled
    held = t.select("h", F.explode(F.concat(*(_grams(F.col("text"), n) for n in sorted(lengths)))).alias("gram")).select("h", F.xxhash64("gram").alias("gram")).join(asked, "gram", "left_semi")
    held = cut(held, "held")  # as it is read twice, and cutting texts into runs takes long
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a run that no text holds has no count: its pattern is in no text, and it must not be filed under another run
    filed = wanted.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a")).where("a.n > 0")
    anchors = filed.select("pattern", F.col("a.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("slot"))
    return held.withColumn("slot", F.pmod(F.xxhash64("h"), F.lit(PARTS)).cast("int")).join(anchors, ["gram", "slot"]).select("h", "pattern").distinct()


def longest_alias(texts: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """texts with ``alias`` and ``match`` ('exact' or 'partial'): the longest alias (then the first by ``rank``, then the first by
    itself) that the text contains, any case, inside words too. aliases: (alias, rank); empty ones match nothing.

    A table of at most LISTED aliases is tried on each text, best alias first, where the text is; texts then are neither cut into
    runs nor shuffled. More aliases meet the texts by anchors."""
    upper = aliases.select(F.upper("alias").alias("pattern"), "alias", "rank")
    best_first = [-F.length("pattern"), "rank", "alias"]
    few = upper.where("pattern <> ''").distinct().orderBy(*best_first).limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        named = F.coalesce(F.lit(None).cast("string"), *(F.when(F.contains(F.upper(text), F.lit(r["pattern"])), F.lit(r["alias"])) for r in few))
        return texts.withColumn("alias", named).withColumn("match", _match(text))
    found = contained(texts.select(F.upper(text).alias("text")), upper)
    best = found.join(upper, "pattern").groupBy("text").agg(F.min_by("alias", F.struct(*best_first)).alias("alias")).withColumnRenamed("text", "_text")
    return texts.join(best, F.upper(text) == F.col("_text"), "left").drop("_text").withColumn("match", _match(text))


def _match(text: str) -> Column:
    return F.when(F.upper("alias") == F.upper(text), "exact").when(F.col("alias").isNotNull(), "partial")


def normal_run(c: Column) -> Column:
    """Lower-cased runs of letters and digits, one blank between them and one at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def overlapping_entries(concepts: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, entry) where one of an entry's signals stands in a concept as a run of whole words, whatever separates them. concepts:
    (id, terms: array of texts); registry: (entry, signal), a row a keyword or name. Signals without letters or digits are
    none; null terms are left out."""
    hay = concepts.select("id", normal_run(F.array_join("terms", " ")).alias("text"))
    signals = registry.select("entry", normal_run(F.col("signal")).alias("pattern")).where(F.length(F.trim("pattern")) > 0).distinct()
    return contained(hay, signals).join(signals, "pattern").join(hay, "text").select("id", "entry").distinct()
