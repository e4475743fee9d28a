"""Filters over ledgers, positions, histories and documents whose conditions may each be left out, and checks that stores agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import contained

#: Most rows that a slice for a reader may have.
SLICE = 200


def _folded(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def name_map_slice(names: DataFrame, order: list[str], source: str | None = None, field: str | None = None, raw: str | None = None, canonical: str | None = None, asset_type: str | None = None, limit: int = 50) -> DataFrame:
    """The first rows of the name map (source, field, raw_value, canonical_value, asset_type), at most SLICE: source, field and type as
    a whole, raw and canonical by what they contain, any case, blanks around don't count."""
    same = [(source, "source"), (field, "field"), (asset_type, "asset_type")]
    part = [(raw, "raw_value"), (canonical, "canonical_value")]
    want = [_folded(c) == v.lower() for v, c in same if v] + [F.contains(_folded(c), F.lit(v.lower())) for v, c in part if v]
    return names.where(_all(want)).orderBy(*order).limit(min(limit, SLICE))


def positions_of(positions: DataFrame, bucket: str | None = None, currency: str | None = None, asset_type: str | None = None) -> DataFrame:
    """Positions of a bucket, a currency (blank: BRL) and a type; a condition that is left out holds for all."""
    money = F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.lit("BRL")))
    want = [F.col("bucket") == bucket] if bucket else []
    want += [money == currency.upper()] if currency else []
    want += [F.lower(F.coalesce("type", F.lit(""))) == asset_type.lower()] if asset_type else []
    return positions.where(_all(want))


def history_of(history: DataFrame, ledger: str = "all", broker: str = "all", search: str = "", first: str | None = None, last: str | None = None, fields: tuple[str, ...] = ("asset", "operation", "broker", "source")) -> DataFrame:
    """Rows of a history (date, ledger, broker, ...) of a ledger, a broker and a span of days, both ends in, whose fields, with
    blanks between them, contain the search, any case."""
    want = [F.col(c) == v for c, v in (("ledger", ledger), ("broker", broker)) if v != "all"]
    want += [F.col("date") >= F.lit(first).cast("date")] if first else []
    want += [F.col("date") <= F.lit(last).cast("date")] if last else []
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in fields)))
    want += [F.contains(text, F.lit(search.strip().lower()))] if search.strip() else []
    return history.where(_all(want))


def of_types(documents: DataFrame, prefixes: dict[str, str], types: list[str] | None) -> DataFrame:
    """Documents whose path begins with the prefix of one of the types; all without types. An unknown type is an error."""
    if not types:
        return documents
    out = F.lit(False)
    for t in types:
        out = out | F.startswith(F.col("path"), F.lit(prefixes[t]))
    return documents.where(out)


def triplets(balances: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per day of any of the three stores (a row with ``date`` each): how many balance rows, whether there is a file, whether the
    manifest lists it, and what is wrong: a stale manifest, a missing file, a close that was cut off."""
    rows = balances.groupBy("date").agg(F.count(F.lit(1)).alias("balance_rows"))
    known = lambda d, name: d.select("date").distinct().withColumn(name, F.lit(True))
    all_ = rows.join(known(files, "has_file"), "date", "full").join(known(manifest, "listed"), "date", "full").na.fill(0, ["balance_rows"]).na.fill(False, ["has_file", "listed"])
    wrong = F.concat_ws(",", F.when(F.col("has_file") & ~F.col("listed"), "stale_manifest"), F.when(F.col("listed") & ~F.col("has_file"), "missing_file"), F.when((F.col("balance_rows") > 0) & ~(F.col("has_file") & F.col("listed")), "interrupted_close"))
    return all_.withColumn("problems", wrong).withColumn("consistent", wrong == "")


def file_sources(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, source): the first rule by ``rank`` that fits each file, null if none does.

    files: (file, name, head: its first lines, one text). rules: (rank, source, how, pattern): how is exact, startswith, contains
    (of the name) or header (what a line of the head contains). Patterns meet names and heads by anchors, not by pairs."""
    of = lambda *how: rules.where(F.col("how").isin(*how))
    exact = files.join(of("exact"), F.col("name") == F.col("pattern")).select("file", "rank", "source")
    named = contained(files.select(F.col("name").alias("text")), of("startswith", "contains").select("pattern"))
    by_name = files.join(named, F.col("name") == F.col("text")).join(of("startswith", "contains"), "pattern").where((F.col("how") == "contains") | F.startswith("name", "pattern")).select("file", "rank", "source")
    headed = contained(files.select(F.col("head").alias("text")), of("header").select("pattern"))
    by_head = files.join(headed, F.col("head") == F.col("text")).join(of("header"), "pattern").select("file", "rank", "source")
    best = exact.unionByName(by_name).unionByName(by_head).groupBy("file").agg(F.min(F.struct("rank", "source")).alias("b"))
    return files.select("file").join(best, "file", "left").select("file", "b.source")


def latest(files: DataFrame, group: str, count: int = 1) -> DataFrame:
    """The last ``count`` files of each group by name."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("name")))).where(F.col("_r") <= count).drop("_r")


def resolved(tx: DataFrame, answers: DataFrame) -> DataFrame:
    """tx (seq, category, supplier, confidence, tags, accrual) with the answers of review put in.

    answers: (seq, n: their order, kind, decision, value, token, target). kind category, supplier (value; decision: the confidence,
    'exact' if none), boundary (move: value is the new accrual day; keep) or tag: accept adds the token if it is not there, merge
    replaces it by target and leaves each tag once, reject drops it. Answers of a row work in order, the last one of a field counts;
    tags are folded answer by answer. Rows without answers stay; answers of unknown kinds or decisions are errors."""
    ok = (F.col("kind").isin("category", "supplier")) | ((F.col("kind") == "boundary") & F.col("decision").isin("move", "keep")) | ((F.col("kind") == "tag") & F.col("decision").isin("accept", "merge", "reject"))
    sound = answers.where(F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.concat_ws(" ", F.lit("unknown answer:"), "kind", "decision")).cast("boolean")).otherwise(True))
    last = lambda kind, c, more=F.lit(True): F.max_by(c, F.when((F.col("kind") == kind) & more, F.col("n")))
    per = sound.groupBy("seq").agg(
        last("category", "value").alias("_category"), last("supplier", "value").alias("_supplier"), last("supplier", F.coalesce("decision", F.lit("exact"))).alias("_confidence"),
        last("boundary", "value", F.col("decision") == "move").alias("_accrual"), F.array_sort(F.collect_list(F.when(F.col("kind") == "tag", F.struct("n", "decision", "token", "target")))).alias("_said"))

    def step(tags: Column, a: Column) -> Column:
        swapped = F.array_distinct(F.transform(tags, lambda t: F.when(t == a["token"], a["target"]).otherwise(t)))
        return F.when(a["decision"] == "accept", F.when(F.array_contains(tags, a["token"]), tags).otherwise(F.concat(tags, F.array(a["token"])))).when(a["decision"] == "merge", swapped).otherwise(F.filter(tags, lambda t: t != a["token"]))

    both = tx.join(per, "seq", "left")
    put = {"category": F.coalesce("_category", "category"), "supplier": F.coalesce("_supplier", "supplier"), "confidence": F.coalesce("_confidence", "confidence"), "accrual": F.coalesce(F.col("_accrual").cast("date"), "accrual"),
           "tags": F.when(F.size("_said") > 0, F.aggregate("_said", F.col("tags"), step)).otherwise(F.col("tags"))}
    return both.select(*(put[c].alias(c) if c in put else F.col(c) for c in tx.columns))
