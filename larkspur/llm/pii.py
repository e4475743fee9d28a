"""Operator 7, personal data: bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of the strict forms below. Words around seeds induce lexical patterns (the word before, the two
words before, the words on both sides). Candidates are near misses of a kind's form (addresses without a dotted
domain, dotted quads with a part over 255, digit groups of a card's length that fail its check digit, phone numbers
without a plus or of another length) and, for every kind, any other word of MIN_OTHER characters or more with a digit
or an @ in it: what kind such a word is, and whether any, only the patterns say. Patterns and instances form a graph: a
pattern's confidence is the smoothed mean score of its instances, a candidate's score comes from its best patterns, and
a few rounds pass scores along, so that a candidate found by one pattern supports other patterns, which find further
candidates. Candidates of high score become spans beside the seeds.

Matches are marked inside the text with two control characters and the text is split at them, which gives offsets
without leaving the JVM; only matches, lengths and nearby words are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, ascii_lower, text_key, written

#: Kinds in their order, and their strict forms. Quantifiers are possessive where nothing that follows
#: could use what they give back, and runs are entered only at their start or where the last match ended, so that no
#: text makes them slow.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Near misses that the strict forms do not match at all.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Words that may be an identifier of any kind: with a digit or an @, so many characters or more.
MIN_OTHER = 6
OTHER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What does not belong to such a word at its end.
STOPS = ".,;:!?'\"()[]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)
    return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(False)


def _valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", _luhn(m))
        .otherwise((n >= 9) & (n <= 15))
    )


def marked(docs: DataFrame, forms: list[tuple[str, bool, str]]) -> DataFrame:
    """doc_id, th, kind, strict, start, end (code points, end exclusive), m (the match), left (the last words
    before it, one that touches it included) and right (the next word). Words count whole, however long."""
    text = F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "��")
    # one pass for all forms; only texts with a match of a form are split by it
    hit = F.array_compact(F.array(*(F.when(F.col("t").rlike(p), F.lit(i)) for i, (_, _, p) in enumerate(forms))))
    parts = F.lit(None).cast("array<string>")
    for i, (_, _, p) in enumerate(forms):
        parts = F.when(F.col("f") == i, F.split(F.regexp_replace("t", p, "\x01$0\x02"), "\x01", -1)).otherwise(parts)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), text.alias("t"))
    cut = rows.select("doc_id", "th", "t", F.explode(hit).alias("f")).select("doc_id", "th", "f", F.posexplode(parts).alias("pos", "part"))
    m = F.when(F.col("pos") > 0, F.substring_index("part", "\x02", 1)).otherwise("")
    rest = F.when(F.col("pos") > 0, F.expr("substr(part, instr(part, '\x02') + 1)")).otherwise(F.col("part"))
    slim = cut.select(
        "doc_id", "th", "f", "pos", m.alias("m"), (F.length("part") - (F.col("pos") > 0).cast("int")).alias("size"),
        F.regexp_extract(rest, rf"^{GAP}({WORD})", 1).alias("right"), F.substring_index(F.regexp_replace(rest, GAP, " "), " ", -3).alias("tail"),
    )
    return slim.dropDuplicates(["doc_id", "th", "f", "pos"])


def _placed(slim: DataFrame, forms: list[tuple[str, bool, str]]) -> DataFrame:
    w = Window.partitionBy("doc_id", "th", "f").orderBy("pos")
    kinds, stricts = F.array(*(F.lit(k) for k, _, _ in forms)), F.array(*(F.lit(s) for _, s, _ in forms))
    return (
        slim.withColumn("start", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.lag("tail").over(w)).where("pos > 0")
        .select("doc_id", "th", kinds[F.col("f")].alias("kind"), stricts[F.col("f")].alias("strict"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("m")).cast("long").alias("end"), "m", "left", "right")
    )


def _contexts(found: DataFrame) -> DataFrame:
    """One row a pattern that a match stands in."""
    before = F.filter(F.split(ascii_lower(F.coalesce("left", F.lit(""))), " "), lambda x: x != "")
    n = F.size("before")
    one, two = F.element_at("before", -1), F.concat_ws(" ", F.slice("before", F.greatest(n - 1, F.lit(1)), 2))
    patterns = F.array(
        F.when(n >= 1, F.concat(F.lit("1 "), one)), F.when(n >= 2, F.concat(F.lit("2 "), two)),
        F.when((n >= 1) & (F.col("after") != ""), F.concat(F.lit("b "), one, F.lit(" _ "), F.col("after"))),
    )
    return found.withColumn("before", before).withColumn("after", ascii_lower(F.col("right"))).select("*", F.explode(F.array_compact(patterns)).alias("pattern"))


def _apart(found: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of found that overlap none of taken in their document."""
    s = taken.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("known")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "known")
    met = found.join(s, found["doc_id"].eqNullSafe(F.col("d")) & (found["th"] == F.col("t")), "left")
    return met.where(F.col("known").isNull() | ~F.exists("known", lambda k: (k["start"] < F.col("end")) & (k["end"] > F.col("start")))).select(*found.columns)


def find(docs: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text), kind, strict, start, end: strict matches and what the patterns add.

    rounds: of passing scores; least: score from which a candidate is taken; support: distinct seeds (or accepted
    candidates) that a pattern needs, twice as many where it alone says what kind a word is. Null and empty texts have
    none; repeated rows (doc_id and text) are one here; extra columns play no part; an empty table gives an empty one."""
    forms = [(k, True, STRICT[k]) for k in KINDS] + [(k, False, p) for k, p in LOOSE.items()] + [("other", False, OTHER)]
    placed = _placed(written(marked(docs, forms), "pii-marked"), forms)
    other = F.col("kind") == "other"
    placed = placed.withColumn("m", F.when(other, F.rtrim("m", F.lit(STOPS))).otherwise(F.col("m"))).withColumn("end", F.col("start") + F.length("m"))
    checked = placed.withColumn("ok", F.col("strict") & _valid(F.col("kind"), F.col("m")))
    digits = F.length(_digits(F.col("m")))
    likely = F.when(F.col("kind") == "card", digits.between(12, 20)).when(F.col("kind") == "phone", digits.between(7, 16)).when(other, F.length("m") >= MIN_OTHER).otherwise(True)
    all_ = written(checked.where(F.col("ok") | likely).select("doc_id", "th", "kind", "start", "end", "m", "left", "right", "ok"), "pii-matches")
    seeds = all_.where("ok")
    # loose and strict forms may give one candidate twice; what overlaps a seed of its document is part of it
    near = _apart(all_.where("not ok and kind <> 'other'").dropDuplicates(["doc_id", "th", "kind", "start", "end"]), seeds)
    rest = _contexts(_apart(all_.where("kind = 'other'"), seeds.unionByName(near))).where("not pattern like '1 %'").withColumn("instance", ascii_lower(F.col("m"))).drop("kind")
    named = _contexts(seeds.unionByName(near)).select("kind", "pattern", ascii_lower(F.col("m")).alias("instance"), "ok")
    named = written(named.groupBy("kind", "pattern", "instance").agg(F.max("ok").alias("seed")), "pii-named")
    telling = named.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * support).select("kind", "pattern")
    rest = written(rest.join(telling, "pattern").select("doc_id", "th", "kind", "start", "end", "pattern", "instance"), "pii-others")
    edges = written(named.unionByName(rest.select("kind", "pattern", "instance", F.lit(False).alias("seed"))).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    sure = written(edges.where("seed").select("kind", "instance").distinct(), "pii-seeds")
    every = written(edges.where("not seed").select("kind", "instance").distinct().join(sure, ["kind", "instance"], "left_anti"), "pii-candidates")
    scores = every.withColumn("score", F.lit(0.0))
    patterns = None
    for _ in range(rounds):
        rated = edges.join(scores, ["kind", "instance"], "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(1.0))))
        patterns = written(
            rated.groupBy("kind", "pattern").agg(F.sum("s").alias("sum"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("s") >= least, 1)).alias("good"))
            .where(F.col("good") >= support).select("kind", "pattern", "good", (F.col("sum") / (F.col("n") + 0.5)).alias("confidence")), "pii-patterns",
        )
        best = edges.join(every, ["kind", "instance"]).join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("confidence").alias("score"))
        scores = written(every.join(best, ["kind", "instance"], "left").select("kind", "instance", F.coalesce("score", F.lit(0.0)).alias("score")), "pii-scores")
    taken = scores.where(F.col("score") >= least).select("kind", "instance").unionByName(sure)  # a seed's text may stand elsewhere
    added = near.withColumn("instance", ascii_lower(F.col("m"))).join(taken, ["kind", "instance"], "left_semi").select("doc_id", "th", "kind", F.lit(False).alias("strict"), "start", "end")
    # a word of no form counts only where a sure pattern stands around it, as what the surest says
    said = rest.join(patterns.where((F.col("confidence") >= least) & (F.col("good") >= 2 * support)), ["kind", "pattern"])
    words = said.groupBy("doc_id", "th", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")).select("doc_id", "th", "kind", F.lit(False).alias("strict"), "start", "end")
    return seeds.select("doc_id", "th", "kind", F.lit(True).alias("strict"), "start", "end").unionByName(added).unionByName(words)


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the strict matches, spans with the added ones, has_pii; one
    row per row of docs. Spans read kind:start:end by kind, then start, joined by commas; none: an empty string."""
    spans = find(docs)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    one = F.struct(order.alias("k"), "start", "end", "strict", F.concat_ws(":", "kind", "start", "end").alias("s"))
    per = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(one)).alias("found")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "found")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"))
    met = rows.join(per, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["th"] == F.col("t")), "left")
    found = F.coalesce("found", F.array().cast(per.schema["found"].dataType))
    base = F.filter(found, lambda x: x["strict"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")

    def count(k: int) -> Column:  # a lambda of two parameters would get the element's index as its second
        return F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return met.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"), (F.size(found) > 0).alias("has_pii"))


def op7_pii(docs: DataFrame) -> DataFrame:
    return pii(docs)
