"""Markdown notes and pages: sections, chunks, tables, links resolved by name, folding of names, numbers in text, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fold_key, tokens, url_key
from .corpus import counted_names

#: Words of scale, and the marks of sentences that caution or give reasons.
SCALES = (("bn", 9), ("billion", 9), ("mn", 6), ("million", 6), ("k", 3), ("thousand", 3))
CAVEATS = "however|although|but|except|unless"
REASONS = "because|therefore|since|thus|hence"


def prose_only(c: Column) -> Column:
    """Text without code blocks, inline code, link targets and heading marks; [[target|shown]] and [shown](target) leave what they show."""
    s = F.regexp_replace(c, r"(?s)```.*?```", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"`[^`\n]*`", " "), r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]*)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"), r"(?m)^#+ +", "")


def substantive_words(c: Column, least: int = 4) -> Column:
    return F.size(F.filter(tokens(prose_only(c)), lambda w: F.length(w) >= least)).cast("long")


def kebab_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words, and the parts of those with hyphens; stop words out, each once."""
    t = tokens(c)
    both = F.array_distinct(F.flatten(F.transform(t, lambda w: F.concat(F.array(w), F.split(w, "-")))))
    return F.filter(both, lambda w: (w != "") & (~w.isin(*stop) if stop else F.lit(True)))


def sections(docs: DataFrame) -> DataFrame:
    """id, title (the first H1, else the id), pos, anchor (heading of level 2, empty before the first), body. A first block
    between lines of --- is metadata and goes."""
    text = F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", "")
    head = F.regexp_extract(text, r"(?m)^# +([^\n]+)", 1)
    parts = docs.select("id", F.when(head != "", head).otherwise(F.col("id").cast("string")).alias("title"), F.posexplode(F.split(text, r"(?m)^## +")).alias("pos", "part"))
    first = F.col("pos") == 0
    return parts.select("id", "title", F.col("pos").cast("long").alias("pos"), F.when(first, "").otherwise(F.substring_index("part", "\n", 1)).alias("anchor"),
                        F.when(first, F.col("part")).when(F.instr("part", "\n") == 0, "").otherwise(F.expr("substr(part, instr(part, '\n') + 1)")).alias("body"))


def section_body(docs: DataFrame, heading: str) -> DataFrame:
    """The body of each section of level 2 with this name, any case."""
    return sections(docs).where((F.col("pos") > 0) & (F.lower(F.trim("anchor")) == heading.lower())).select("id", "pos", "body")


def chunked(docs: DataFrame, most: int = 6000) -> DataFrame:
    """Pages as chunks: id, pos (over the whole page, from 0), anchor (heading of level 2, empty before the first), text: title and
    anchor, an empty line, content. The title is the first H1, which is no content, or else the id; a first block between lines
    of --- is metadata and goes. A section longer than most is cut at empty lines: a paragraph longer than most gives pieces of
    that length at once, what is left of it and shorter ones are put together while they fit, and come after such pieces."""
    begin, end = "\ufdd0", "\ufdd1"  # no characters, by Unicode's word, so they are in no text
    bare = lambda c: F.btrim(c, F.lit(" \t\r\n\x0b\f"))
    body = F.regexp_replace("text", r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    h1 = F.regexp_extract(body, r"(?dm)^#\s+(.+?)\s*$", 1)
    rest = F.regexp_replace(F.regexp_replace(body, r"(?dm)\A([\s\S]*?)^#\s+(.+?)\s*$", "$1"), r"(?dm)^##\s+(.+?)\s*$", f"{begin}$1{end}")

    def pack(state: Column, p: Column) -> Column:
        pieces = F.greatest(F.ceil(F.length(p) / most).cast("int") - 1, F.lit(0))
        cut = F.transform(F.filter(F.sequence(F.lit(0), pieces), lambda i: i < pieces), lambda i: F.substr(p, i * most + 1, F.lit(most)))
        left = F.substr(p, pieces * most + 1, F.lit(most))
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(left) + 2 > most)
        return F.struct(
            F.concat(state["done"], cut, F.when(full, F.array(state["open"])).otherwise(F.array().cast("array<string>"))).alias("done"),
            F.when(full | (state["open"] == ""), left).otherwise(F.concat(state["open"], F.lit("\n\n"), left)).alias("open"))

    def parts(content: Column) -> Column:
        last = lambda s: F.concat(s["done"], F.when(bare(s["open"]) != "", F.array(s["open"])).otherwise(F.array().cast("array<string>")))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        return F.when(F.length(content) <= most, F.array(content)).otherwise(F.aggregate(F.split(content, "\n\n"), start, pack, last))

    def section(text: Column, i: Column) -> Column:
        anchor = F.when(i == 0, "").otherwise(bare(F.substring_index(text, end, 1)))
        content = bare(F.when(i == 0, text).otherwise(F.substring_index(text, end, -1)))
        return F.transform(F.when(content == "", F.array().cast("array<string>")).otherwise(parts(content)), lambda p: F.struct(anchor.alias("anchor"), bare(p).alias("content")))

    cut = docs.select("id", F.when(h1 != "", bare(h1)).otherwise(F.col("id").cast("string")).alias("title"), F.posexplode(F.flatten(F.transform(F.split(rest, begin), section))).alias("pos", "c"))
    head = F.when(F.col("c.anchor") != "", F.concat_ws(" — ", "title", "c.anchor")).otherwise(F.col("title"))
    return cut.select("id", F.col("pos").cast("long").alias("pos"), "c.anchor", F.concat(head, F.lit("\n\n"), "c.content").alias("text"))


def table_rows(docs: DataFrame) -> DataFrame:
    """Rows of Markdown tables: id, line, cells. Pipes with a backslash are text; the line of dashes is no row."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.col("s").rlike(r"^\s*\|.*\|\s*$") & ~F.col("s").rlike(r"^[\s|:-]+$"))
    cells = F.split(F.regexp_replace(F.trim("s"), r"^\||\|$", ""), r"(?<!\\)\|")
    return lines.select("id", F.col("line").cast("long").alias("line"), F.transform(cells, lambda x: F.trim(F.replace(x, F.lit("\\|"), F.lit("|")))).alias("cells"))


def hrefs(pages: DataFrame) -> DataFrame:
    """Links of pages: src, name (the key of a target's last step)."""
    got = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'<a[^>]*\shref="([^"#?]*)'), 1)).alias("href"))
    return got.select("src", fold_key(F.substring_index("href", "/", -1)).alias("name")).where("name <> ''").distinct()


def titles(pages: DataFrame) -> DataFrame:
    """Names of pages (id, name): the key of the first word of the title."""
    word = F.regexp_extract("html", r"<title>\s*([^\s<]+)", 1)
    return pages.select(F.col("page_id").alias("id"), fold_key(word).alias("name")).where("name <> ''")


def resolved(links: DataFrame, names: DataFrame) -> DataFrame:
    """links with the one page that their name stands for: unresolved (none), ambiguous (several; the smallest id) or unique."""
    by = names.groupBy("name").agg(F.min("id").alias("dst"), F.count_distinct("id").alias("n"))
    return links.join(by, "name", "left").select("src", "name", "dst", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("unique").alias("verdict"))


def source_matches(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of each queued source (id, url, doi, title): by url, or one's url going on from the other's at a slash; else by
    a common DOI; else by title. Addresses meet at their own prefixes, cut at slashes, so the join is one of equals. Of the pages that
    share an address, DOI or title only the first can win, so a source meets one page for each, however many share it."""
    key = url_key(F.col("url"))
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/"))), lambda i: F.array_join(F.slice(F.split("key", "/"), 1, i), "/"))
    q, p = (d.select(F.col("id").alias(n), key.alias("key"), F.lower("doi").alias("doi"), F.lower(F.trim("title")).alias("title")) for d, n in ((queue, "q"), (pages, "p")))
    up = lambda d: d.where("key <> ''").select("*", F.explode(steps).alias("step"))
    least = lambda d, c: d.where(F.col(c) != "").groupBy(c).agg(F.min("p").alias("p"))
    url = up(q).select("q", F.col("step").alias("key")).join(least(p, "key"), "key").select("q", "p")
    url = url.unionByName(q.join(least(up(p), "step").withColumnRenamed("step", "key"), "key").select("q", "p"))
    doi, title = (q.join(least(p, c), c).select("q", "p") for c in ("doi", "title"))
    hits = url.select("q", "p", F.lit(1).alias("r")).unionByName(doi.select("q", "p", F.lit(2).alias("r"))).unionByName(title.select("q", "p", F.lit(3).alias("r")))
    return hits.groupBy("q").agg(F.min(F.struct("r", "p")).alias("b")).select(F.col("q").alias("id"), F.col("b.p").alias("page"), F.element_at(F.array(F.lit("url"), F.lit("doi"), F.lit("title")), F.col("b.r")).alias("how"))


def candidates(sources: DataFrame, topics: DataFrame, cited: DataFrame, rejected: DataFrame) -> DataFrame:
    """Sources (id, words) that name a topic (id, slug), each with how often, less those cited already or rejected (source, topic)."""
    named = counted_names(sources.select("id", F.explode("words").alias("w")), topics.select(F.col("id").alias("target"), F.col("slug").alias("w"))).select(F.col("id").alias("source"), F.col("target").alias("topic"), "n")
    return named.join(cited, ["source", "topic"], "left_anti").join(rejected, ["source", "topic"], "left_anti").select("source", "topic", "n")


def coverage(expected: DataFrame, drafted: DataFrame, cited: DataFrame) -> DataFrame:
    """Per topic what of the expected pairs (source, topic) was drafted, was cited already, or is a gap."""
    both = expected.join(drafted.select("source", "topic", F.lit(True).alias("_d")).distinct(), ["source", "topic"], "left").join(cited.select("source", "topic", F.lit(True).alias("_c")).distinct(), ["source", "topic"], "left")
    state = F.when(F.col("_d"), "drafted").when(F.col("_c"), "cited").otherwise("gap")
    return both.groupBy("topic").agg(*(F.count(F.when(state == k, 1)).alias(k) for k in ("drafted", "cited", "gap"))).withColumn("passed", F.col("gap") == 0)


def ingested(raw: DataFrame, index: DataFrame, backlinks: DataFrame, stems: DataFrame) -> DataFrame:
    """Raw names that any of three signals (name each) says are in, with the signals."""
    said = None
    for k, d in (("index", index), ("backlink", backlinks), ("stem", stems)):
        one = raw.join(d.select("name").distinct(), "name", "left_semi").select("name", F.lit(k).alias("signal"))
        said = one if said is None else said.unionByName(one)
    return said.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))


def footnote_gaps(docs: DataFrame, mark: str, definition: str) -> DataFrame:
    """Per document the footnotes used but not defined, and defined but not used (patterns with one group)."""
    used, known = (F.array_distinct(F.regexp_extract_all("text", F.lit(p), 1)) for p in (mark, definition))
    return docs.select("id", F.array_join(F.sort_array(F.array_except(used, known)), ",").alias("missing"), F.array_join(F.sort_array(F.array_except(known, used)), ",").alias("stale"))


def signals(docs: DataFrame) -> DataFrame:
    """Per document counts of numbers, table rows, labels of rules, sentences that caution and that give reasons, and names
    (runs of two or more capitalised words)."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    sentence = lambda words: rf"(?i)\b(?:{words})\b[^.!?\n]*[.!?]"
    return docs.select(
        "id", n(r"[0-9]+(?:[.,][0-9]+)*").alias("numbers"), n(r"(?m)^\s*\|.*\|\s*$").alias("table_rows"), n(r"(?m)^[A-Z][A-Z ]{2,}:").alias("labels"), n(sentence(CAVEATS)).alias("caveats"),
        n(sentence(REASONS)).alias("reasons"), n(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+").alias("names"))


def number_tokens(c: Column) -> Column:
    """Numbers of a text with their words of scale: 'US$ 1,234.5 mn' is 1234500000. Commas group thousands."""
    words = "|".join(w for w, _ in SCALES)
    found = F.regexp_extract_all(c, F.lit(rf"(?i)([0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?\s*(?:(?:{words})\b)?)"), 1)

    def value(x: Column) -> Column:
        v = F.regexp_replace(F.regexp_extract(x, r"^([0-9,.]+)", 1), ",", "").cast("double")
        word = F.lower(F.regexp_extract(x, r"([A-Za-z]+)$", 1))
        scale = F.lit(0)
        for w, power in SCALES:
            scale = F.when(word == w, power).otherwise(scale)
        return v * F.pow(F.lit(10.0), scale)

    return F.transform(found, value)


def currency_of(c: Column) -> Column:
    return F.when(c.contains("R$"), "BRL").when(c.rlike(r"US\$|\bUSD\b"), "USD").when(c.rlike(r"€|\bEUR\b"), "EUR").when(c.contains("$"), "USD")


def dois(c: Column) -> Column:
    """DOIs of a text in small letters, without what ends a sentence, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(10\.[0-9]{4,9}/[^\s\"<>]+)"), 1), lambda x: F.rtrim(x, F.lit(".,;)"))))


def log_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of a log: id, pos, date, kind and body of each block that begins with '## [date] kind'."""
    parts = docs.select("id", F.posexplode(F.split("text", r"(?m)^## (?=\[[0-9]{4}-[0-9]{2}-[0-9]{2}\])")).alias("pos", "part")).where("pos > 0")
    return parts.select("id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("part", r"^\[([0-9-]{10})\]", 1).try_cast("date").alias("date"), F.trim(F.regexp_extract("part", r"^\[[0-9-]{10}\]([^\n]*)", 1)).alias("kind"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def rounded(v: Column, places: int) -> Column:
    """Half away from zero, on decimals."""
    return F.round(v.cast("decimal(28,8)"), places).cast("double")


def display(v: Column) -> Column:
    """From 10 up whole numbers, below with one place; a trailing .0 goes."""
    s = F.when(F.abs(v) >= 10, F.format_string("%.0f", rounded(v, 0))).otherwise(F.format_string("%.1f", rounded(v, 1)))
    return F.regexp_replace(s, r"\.0$", "")


def delta(a: Column, b: Column) -> Column:
    """Change from a to b as a signed percentage with one place; n/a from nothing."""
    return F.when(a.isNull() | b.isNull() | (a == 0), "n/a").otherwise(F.format_string("%+.1f%%", rounded((b - a) / F.abs(a) * 100, 1)))


def ligatures(c: Column) -> Column:
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def published(c: Column) -> Column:
    """A date from the first ten characters, or a year and month, or a year, between 1800 and 2200; else null."""
    s = F.trim(c)
    d = F.coalesce(F.left(s, F.lit(10)).try_cast("date"), F.concat(F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2})$", 1), F.lit("-01")).try_cast("date"), F.concat(F.regexp_extract(s, r"^([0-9]{4})$", 1), F.lit("-01-01")).try_cast("date"))
    return F.when(F.year(d).between(1800, 2200), d)


def parallel_arrays(filings: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """Rows (id, date, form, value) of JSON that holds parallel arrays: {"date": [...], "form": [...], "value": [...]}; ragged ends are nulls."""
    got = filings.select("id", F.from_json("json", "date array<string>, form array<string>, value array<double>").alias("j"))
    return got.select("id", F.explode(F.arrays_zip("j.date", "j.form", "j.value")).alias("r")).select("id", F.col("r.date").try_cast("date").alias("date"), "r.form", "r.value").where(F.col("form").isin(*forms))


def fact_durations(facts: DataFrame) -> DataFrame:
    """Rows of nested company facts {"concept": {"units": [{"start", "end", "val"}]}} with their kind by length in days."""
    from .reports import duration_kind

    got = facts.select("id", F.explode(F.from_json("json", "map<string, struct<units: array<struct<start: string, end: string, val: double>>>>")).alias("concept", "v"))
    rows = got.select("id", "concept", F.explode("v.units").alias("u"))
    days = F.datediff(F.col("u.end").try_cast("date"), F.col("u.start").try_cast("date"))
    return rows.select("id", "concept", days.alias("days"), duration_kind(days).alias("kind"), F.col("u.val").alias("value"))
