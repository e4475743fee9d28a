"""Controlled damage to texts: what carries a signal is found by class, a share of it is cut out, and each higher share cuts all that
a lower one does. Used to see whether a checker notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a class is made of: tokens that match, or whole lines or sentences that hold a match.
UNITS = {"token": None, "line": r"[^\n]+", "sentence": r"[^.!?\n]+[.!?]*"}

#: class: (unit, pattern).
CLASSES = {
    "caveat": ("sentence", r"(?i)(?:^|[^\p{L}])(?:however|although|but|except|unless)(?:[^\p{L}]|$)"),
    "named": ("token", r"\[\[[^\]\n]+\]\]"),
    "numeric": ("token", r"\d[\d.,]*\d%?|\d%?"),
    "reason": ("sentence", r"(?i)(?:^|[^\p{L}])(?:because|therefore|since|thus|hence)(?:[^\p{L}]|$)"),
    "table_row": ("line", r"^\s*\|.*\|\s*$"),
}


def spans(docs: DataFrame, classes: dict[str, tuple[str, str]] = CLASSES) -> DataFrame:
    """(id, cls, start, end) of all that each class finds in docs (id, text), in characters from 0, end exclusive; ids are unique,
    null texts hold nothing. A text is taken apart into matches and what lies between them; lengths add up to places."""
    found = None
    for unit, whole in UNITS.items():
        mine = {c: p for c, (u, p) in classes.items() if u == unit}
        for cls, pattern in ([(None, whole)] if whole and mine else mine.items() if not whole else []):
            cut = F.lit(rf"(?s)(.*?)(?:({pattern if cls else whole})|\z)")
            parts = docs.where("text is not null").select("id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", cut, F.lit(1)).alias("gap"), F.regexp_extract_all("text", cut, F.lit(2)).alias("hit"))).alias("k", "x")).select("id", "k", "x.gap", "x.hit")
            end = F.sum(F.length("gap") + F.length("hit")).over(Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            placed = parts.withColumn("end", end).where("hit <> ''").select("id", "hit", (F.col("end") - F.length("hit")).alias("start"), "end")
            named = [placed.withColumn("cls", F.lit(cls))] if cls else [placed.where(F.col("hit").rlike(p)).withColumn("cls", F.lit(c)) for c, p in mine.items()]
            for one in named:
                one = one.select("id", "cls", "start", "end")
                found = one if found is None else found.unionByName(one)
    return found


def graded(found: DataFrame, grades: tuple[float, ...] = (0.05, 0.25, 0.5), seed: str = "") -> DataFrame:
    """found, once for each grade that takes it. Each text has one order: the first of every class, the second of every class and
    so on, within a class by a hash; a grade takes its share of the text's finds, rounded up, from the start of that order, so
    a higher grade takes all that a lower one does and a low one touches every class."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), "cls", F.col("start").cast("string")))
    ranked = found.withColumn("_m", mark).withColumn("_r", F.row_number().over(Window.partitionBy("id", "cls").orderBy("_m", "start")))
    text = Window.partitionBy("id")
    placed = ranked.withColumn("place", F.row_number().over(text.orderBy("_r", "cls"))).withColumn("_n", F.count(F.lit(1)).over(text))
    shares = F.explode(F.array(*map(F.lit, grades)))
    return placed.withColumn("grade", shares).where(F.col("place") <= F.ceil(F.round(F.col("grade") * F.col("_n"), 9))).select("id", "grade", "cls", "start", "end", F.col("place").cast("long").alias("place"))


def class_counts(found: DataFrame, chosen: DataFrame, grades: tuple[float, ...] = (0.05, 0.25, 0.5)) -> DataFrame:
    """(id, grade, cls, eligible, deleted), zeros included."""
    all_ = found.groupBy("id", "cls").agg(F.count(F.lit(1)).alias("eligible")).withColumn("grade", F.explode(F.array(*map(F.lit, grades))))
    gone = chosen.groupBy("id", "grade", "cls").agg(F.count(F.lit(1)).alias("deleted"))
    return all_.join(gone, ["id", "grade", "cls"], "left").na.fill(0, ["deleted"]).select("id", "grade", "cls", "eligible", "deleted")


def graded_counts(found: DataFrame, grades: tuple[float, ...] = (0.05, 0.25, 0.5)) -> DataFrame:
    """class_counts of found and of what ``graded`` takes of it, from the numbers of finds alone: the r-th of a class has before it
    those of the classes before its own, r of each at most, and r - 1 at most of each other one."""
    per = found.groupBy("id", "cls").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.collect_list(F.struct("cls", "n")).alias("all"), F.sum("n").alias("_n"))
    each = per.withColumn("grade", F.explode(F.array(*map(F.lit, grades)))).select("id", "grade", "all", F.ceil(F.round(F.col("grade") * F.col("_n"), 9)).alias("take"), F.explode("all").alias("c")).select("id", "grade", "all", "take", "c.cls", "c.n")
    zero = F.lit(0).cast("long")
    place = lambda r: r + F.aggregate("all", zero, lambda s, x: s + F.when(x["cls"] < F.col("cls"), F.least(x["n"], r)).when(x["cls"] > F.col("cls"), F.least(x["n"], r - 1)).otherwise(zero))
    taken = F.size(F.filter(F.sequence(F.lit(1).cast("long"), "n"), lambda r: place(r) <= F.col("take")))
    return each.select("id", "grade", "cls", F.col("n").alias("eligible"), taken.cast("long").alias("deleted"))


def without(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, grade, text): docs less the chosen spans of each grade. Overlapping and touching spans are one; one that is a whole
    line takes its line break along. Texts without a chosen span have no row."""
    order = Window.partitionBy("id", "grade").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_b"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = chosen.withColumn("_b", before).withColumn("_i", island).groupBy("id", "grade", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    listed = cut.groupBy("id", "grade").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    char = lambda at: F.substr(F.col("text"), at + 1, F.lit(1))
    line = lambda c: (c["start"] == 0) | (char(c["start"] - 1) == "\n")
    ends = F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), F.when(line(c) & (char(c["end"]) == "\n"), c["end"] + 1).otherwise(c["end"]).alias("end")))
    both = docs.join(listed, "id").withColumn("cuts", ends)
    from_ = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"]))
    to = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length("text").cast("long")))
    kept = F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda x: F.substr(F.col("text"), x["a"].cast("int") + 1, F.greatest(x["b"] - x["a"], F.lit(0)).cast("int")))
    return both.select("id", "grade", F.array_join(kept, "").alias("text"))
