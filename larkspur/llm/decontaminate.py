"""Operator 10, benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage by e = n * rate edits. Cut into e + 1 pieces, at least one piece
must then stand in the passage unchanged. An Aho-Corasick automaton over all pieces finds the hits in whole texts;
each hit's window is verified with Myers' bit-parallel distance. Case, punctuation and white space don't count: both
sides are lower-cased and runs of anything but letters and digits become one space.

An item too short for an edit (fewer than 1 / rate characters) must stand as whole words, so that "a" is not found in "the cat".

The items are a stated query set. They are taken in blocks of bounded size, one pass over the texts a block: the driver
holds one block at a time, sends it to the workers as a broadcast, and each worker builds a block's automaton once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import written

_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece) of the item's budget-plus-one pieces, of lengths as equal as can be."""
    k = budget(item, rate) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


def within(item: str, window: str, most: int) -> bool:
    """Whether some substring of window is at most so many edits from item (Myers 1999; integers hold the columns)."""
    m = len(item)
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | (1 << i)
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in window:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        if score <= most:
            return True
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return False


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        named = ((i, normal(t)) for i, t in items)
        self.items = [(i, n if budget(n, rate) else f" {n} ", budget(n, rate)) for i, n in named if n]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, n, _) in enumerate(self.items):
            for offset, piece in pieces(n, rate):
                where.setdefault(piece, []).append((k, offset))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        if where:
            self.auto.make_automaton()

    def find(self, text: str | None) -> list[int]:
        """Ids of the items that the text holds, sorted."""
        t = f" {normal(text or '')} "
        found, tried = set(), set()
        if not self.items:
            return []
        for end, (size, at) in self.auto.iter(t):
            for k, offset in at:
                if k in found:
                    continue
                _, item, most = self.items[k]
                start = end + 1 - size - offset
                if start >= 0 and t.startswith(item, start):
                    found.add(k)
                elif most and (k, start) not in tried:
                    tried.add((k, start))
                    if within(item, t[max(0, start - most) : max(0, start) + len(item) + most], most):
                        found.add(k)
        return sorted({self.items[k][0] for k in found})


#: The matcher of the block that this worker is at.
_held: dict[str, Matcher] = {}


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_bytes: int = 8_000_000) -> DataFrame:
    """``row`` (all columns of docs) and ``items`` (sorted ids of the benchmark items it holds, perhaps none).

    Null and empty texts hold nothing; null, empty and all-punctuation items are found nowhere; repeated items and
    rows each count; items of a null id are left out. Ids may be of any type. Tables may be empty. Extra columns ride
    along in ``row``. block_bytes: how many bytes of items are taken at once, on average over a hash of the items."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    items_of = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    ids = ArrayType(benchmark.schema["item_id"].dataType)
    now = docs.select(F.struct("*").alias("row"), F.col("text"), F.lit(None).cast(ids).alias("items"))
    kind = StructType([StructField("row", now.schema["row"].dataType), StructField("text", now.schema["text"].dataType), StructField("items", ids)])
    spark = docs.sparkSession
    for k in range(blocks):
        block = items_of.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in block))
        name = uuid.uuid4().hex

        def run(batches: Iterator, sent=sent, name=name) -> Iterator:
            import pyarrow as pa

            if name not in _held:
                _held.clear()
                _held[name] = Matcher(sent.value, rate)
            matcher = _held[name]
            for b in batches:
                got = [sorted({*(old.as_py() or []), *matcher.find(t.as_py())}) for t, old in zip(b.column("text"), b.column("items"))]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(got, b.column("items").type)], names=["row", "text", "items"])

        done = now.mapInArrow(run, kind)
        now = written(done, "decontaminated", now) if k < blocks - 1 else done
    return now.select("row", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """The rows of docs that hold no benchmark item; columns as they are."""
    return contaminated(docs, benchmark, rate).where(F.size("items") == 0).select("row.*")


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return contaminated(slim, benchmark).select("row.doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")
