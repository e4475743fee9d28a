"""Links by name: mentions of pages by names of any number of words, broken targets with what was meant, targets resolved to
files, and logs whose entries go once their page exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fold_key
from ..sources.tables import cut
from .notes import prose_only

#: Hashes of up to so many names are broadcast.
MANY = 2_000_000

#: Types of log entries that wait for a page or a decision, and types that are no longer in use.
WAITING = ("candidate-topic", "candidate-mention", "proposed-new-thesis", "speculative-thesis-update")
RETIRED = ("ingest", "concept-created", "entity-created", "topic-created", "topic-updated", "topic-coverage-candidate", "lint")


def name_mentions(docs: DataFrame, names: DataFrame, links: DataFrame, rejected: DataFrame) -> DataFrame:
    """(id, target, term, n, hub) where the prose of a document (id, text; ids are unique) names another (id, name) as whole
    words, whatever separates them, n times, without linking it (src, dst) and without the pair being rejected (term, target).
    hub: the name is one word, so it tells little. Names without ASCII letters or digits, and null texts, mention nothing.

    A document's runs of as many words as names have meet the names in an equi-join, so no text moves; runs that no name's hash has
    go before. Names are written once, less the rejected pairs, so that mentions meet neither. Mentions don't overlap: only a name
    that begins as it ends ('so and so') could, so its places are kept and those too near the last one taken are left out."""
    clean = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    words = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    w, k = F.col("ws"), F.size("ws")
    again = (k > 1) & F.exists(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: F.slice(w, F.lit(1), i) == F.slice(w, k - i + 1, i))
    named = names.select(F.col("id").alias("target"), clean(F.col("name")).alias("term")).where("term <> ''").distinct().join(rejected.select("term", "target"), ["term", "target"], "left_anti")
    named = cut(named.withColumn("ws", words(F.col("term"))).select("target", "term", (k == 1).alias("hub"), again.alias("again"), k.alias("k")), "names")
    lengths = {r["k"]: r["n"] for r in named.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a number of words
    hashes = named.groupBy(F.xxhash64("term").alias("h")).agg(F.max("again").alias("again"))
    if sum(lengths.values()) <= MANY:
        hashes = F.broadcast(hashes)  # bounded; what names nothing goes before it is shuffled
    next_ = F.arrays_zip(*(F.slice(w, n + 1, F.greatest(k, F.lit(1))).alias(f"w{n}") for n in range(max(lengths, default=1))))
    run = lambda n: F.when(F.col(f"z.w{n - 1}").isNotNull(), F.concat_ws(" ", *(f"z.w{i}" for i in range(n))))
    prose = docs.where("text is not null").select("id", clean(prose_only(F.col("text"))).alias("text")).select("id", words(F.col("text")).alias("ws"))
    runs = prose.select("id", F.posexplode(next_).alias("at", "z")).select("id", "at", F.explode(F.array(*map(run, sorted(lengths) or [1]))).alias("term")).where("term is not null")
    said = runs.withColumn("h", F.xxhash64("term")).join(hashes, "h").groupBy("id", "term", F.when(F.col("again"), F.col("at")).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
    long = F.size(F.split("term", " "))
    taken = F.aggregate(F.array_sort(F.collect_list("at")), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda s, x: F.when(x >= s["end"], F.struct((s["n"] + 1).alias("n"), (x + F.first("k")).alias("end"))).otherwise(s), lambda s: s["n"])
    # n is 1 at each place; as both halves ask for it, Spark reads one shuffle for both
    apart = said.where("again").withColumn("k", long).groupBy("id", "term").agg((taken * F.min("n")).alias("n"))
    met = said.where("not again").select("id", "term", "n").unionByName(apart).join(named.select("target", "term", "hub"), "term").where("id <> target")
    return met.join(links.select(F.col("src").alias("id"), F.col("dst").alias("target")), ["id", "target"], "left_anti").select("id", "target", "term", "n", "hub")


def broken_targets(links: DataFrame, files: DataFrame) -> DataFrame:
    """(src, target, bucket, suggestion, candidates) for each link (src, target) to a .md whose last step names no file (name).
    Bucket A: one file's name differs in case, accents, quotes, dashes or separators alone, and is the suggestion; else
    needs-judgment, with the files of that key, several or none, in order. Repeated links are one."""
    step = F.substring_index("target", "/", -1)
    asked = links.select("src", F.trim("target").alias("target")).where(F.endswith("target", F.lit(".md"))).distinct().withColumn("name", step)
    lost = asked.join(files.select("name"), "name", "left_anti").withColumn("key", fold_key(F.col("name")))
    by = files.select("name", fold_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    # candidates are gathered a missing name, not a link: as many links may ask for one name
    found = lost.select("name", "key").distinct().join(by.withColumnRenamed("name", "file"), "key").groupBy("name").agg(F.sort_array(F.collect_list("file")).alias("candidates"))
    one = F.size("candidates") == 1
    return lost.join(found, "name", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).select(
        "src", "target", F.when(one, "A").otherwise("needs-judgment").alias("bucket"), F.when(one, F.col("candidates")[0]).alias("suggestion"), "candidates")


def stem(c: Column) -> Column:
    """A file's name without its last ending; a name that only begins with a dot has none."""
    return F.regexp_replace(c, r"(?<=.)\.[^./]+$", "")


def resolved_targets(targets: DataFrame, items: DataFrame, roots: Sequence[str] = ("",)) -> DataFrame:
    """(target, n, path, verdict) for each distinct target: the items (path, origin, filename) that it may mean, by path below one
    of the roots, by origin and name or stem where it has steps, by name or stem where it has none. unresolved: none;
    ambiguous: several, without a path; else unique. Null targets go."""
    t = targets.select("target").where("target is not null").distinct().withColumn("plain", F.regexp_replace(F.regexp_replace("target", r"\\", "/"), "^/+|/+$", ""))
    t = t.withColumn("steps", F.split("plain", "/")).withColumn("name", F.element_at("steps", -1)).withColumn("origin", F.when(F.size("steps") > 1, F.get("steps", F.size("steps") - 2)).otherwise(""))
    i = items.select("path", "origin", "filename").distinct()
    asked = t.select("target", F.explode(F.array(*(F.concat(F.lit(r), "plain") for r in dict.fromkeys(roots)))).alias("path"))
    hits = asked.join(i.select("path"), "path").select("target", "path")
    keys = lambda name: F.explode(F.array_distinct(F.array(F.concat(F.lit("n"), name), F.concat(F.lit("s"), stem(name))))).alias("key")
    # a name without steps is asked for in every origin, so each item stands under its own origin and under none
    held = i.select("path", F.explode(F.array(F.col("origin"), F.lit(""))).alias("origin"), "filename").distinct().select("path", "origin", keys(F.col("filename")))
    hits = hits.unionByName(t.select("target", "origin", keys(F.col("name"))).join(held, ["origin", "key"]).select("target", "path")).distinct()
    by = hits.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    n = F.coalesce("n", F.lit(0))
    return t.select("target").join(by, "target", "left").select("target", n.alias("n"), F.when(n == 1, F.col("path")).alias("path"), F.when(n == 0, "unresolved").when(n > 1, "ambiguous").otherwise("unique").alias("verdict"))


def _blocks(c: Column) -> Column:
    return F.split(c, r"(?m)^(?=## )")


def log_plan(docs: DataFrame, pages: DataFrame, today: str, floor: int = 7, waiting: Sequence[str] = WAITING, retired: Sequence[str] = RETIRED) -> DataFrame:
    """(id, pos, header, action, page, age, dropped) of every block of the logs (id, text) that begins with '## '; pos from 1.

    Entries read '## [time] type | brief' and may have a line '- name: ...'. heading: no entry. retired: of such a type; goes.
    unknown: of no known type. awaiting: the last of the waiting types, a decision. spent: a page (name, kind) has the slug of
    the brief or else of the name; goes. The first waiting type asks for pages of the kind topic and the third for those of the
    kind thesis. aging: of the first type and at least floor days old; undated: of the first type, without a date; else pending."""
    topic, _, thesis, decision = waiting
    parts = docs.select("id", F.posexplode(_blocks(F.col("text"))).alias("pos", "part")).where(F.startswith("part", F.lit("## ")))
    head = F.rtrim(F.substring_index("part", "\n", 1))
    pattern = r"^## \[([^\]]+)\]\s+([a-z0-9-]+)\s*\|\s*(.*)$"
    e = parts.select("id", F.col("pos").cast("long").alias("pos"), head.alias("header"), F.regexp_extract(head, pattern, 2).alias("type"), F.regexp_extract(head, pattern, 3).alias("brief"), F.regexp_extract("part", r"(?m)^- name:[^\S\n]*(\S.*)$", 1).alias("name"),
                     F.regexp_extract(F.regexp_extract(head, pattern, 1), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date").alias("day"))
    slug = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9.-]+", "-"), F.lit("-"))
    asked = e.where(F.col("type").isin(*waiting[:3])).select("id", "pos", "type", F.posexplode(F.array(slug(F.col("brief")), slug(F.col("name")))).alias("rank", "slug")).where("slug <> ''")
    kind = F.when(F.col("type") == topic, "topic").when(F.col("type") == thesis, "thesis")
    known = pages.select(F.regexp_replace("name", r"\.md$", "").alias("slug"), "name", F.col("kind").alias("_kind")).where(F.endswith("name", F.lit(".md"))).distinct()
    met = asked.join(known, "slug").where(kind.isNull() | (kind == F.col("_kind"))).groupBy("id", "pos").agg(F.min(F.struct("rank", "name"))["name"].alias("page"))
    age = F.datediff(F.lit(today).cast("date"), "day")
    is_ = lambda t: F.col("type") == t
    action = (F.when(F.col("type") == "", "heading").when(F.col("type").isin(*retired), "retired").when(~F.col("type").isin(*waiting), "unknown").when(is_(decision), "awaiting").when(F.col("page").isNotNull(), "spent")
              .when(is_(topic) & F.col("day").isNull(), "undated").when(is_(topic) & (age >= floor), "aging").otherwise("pending"))
    return e.join(met, ["id", "pos"], "left").select("id", "pos", "header", action.alias("action"), "page", age.alias("age"), action.isin("retired", "spent").alias("dropped"))


def pruned(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The logs (id, text) without the blocks that the plan drops; all else stays byte by byte."""
    gone = plan.where("dropped").groupBy("id").agg(F.collect_set(F.col("pos").cast("int")).alias("_gone"))
    kept = F.array_join(F.filter(_blocks(F.col("text")), lambda x, i: ~F.array_contains("_gone", i)), "")
    return docs.join(gone, "id", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone")
