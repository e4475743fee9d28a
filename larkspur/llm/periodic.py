"""Operator 13, periodic run detection: Re-Pair on the word ids, runs at each nonterminal's boundary once, merged.

A run lies wholly in some nonterminal's expansion and crosses the boundary between its two halves, so it is enough to look at
that one boundary of every nonterminal, once, and to translate what is found to all positions that it derives. What is left
of a text when no pair repeats is closed off by a balanced tree, whose nodes stand once each.

Texts are read in Arrow batches and nothing is shuffled: a document is one task's work, in time near n log n and memory of
some hundred bytes a word that may lie in a run. Words whose triples occur fewer than three times in their document can't lie
in a run of four periods (``stretches``), so most of a text never reaches the grammar.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]  # start, end, period

#: Least number of words, and of periods, in a run.
LEAST, PERIODS = 6, 4


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts of ids that can hold runs: of a run of at least four periods and six words every triple of neighbours occurs
    three times or more. Parts of fewer words than a run needs go too."""
    if len(ids) < LEAST:
        return []
    one = ids.astype(np.int64)
    size = int(one.max()) + 1
    _, code = np.unique(one[:-1] * size + one[1:], return_inverse=True)
    _, code, counts = np.unique(code[:-1] * size + one[2:], return_inverse=True, return_counts=True)
    often = counts[code] >= 3
    if not often.any():
        return []
    inside = np.zeros(len(ids) + 2, dtype=bool)
    for k in range(3):
        inside[k + 1 : k + 1 + len(often)] |= often
    edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= LEAST]


def re_pair(ids: list[int], parts: list[tuple[int, int]]) -> tuple[list[tuple[int, int, list[int]]], list[list[int]]]:
    """A grammar of the parts: rules (words in the left half, words, starts of what they derive) and, for each part, the
    starts of the symbols that are left, and its end.

    The most frequent pair goes first, of equal ones the oldest, which keeps trees shallow. A symbol sits at the position
    of its first word; ``after`` and ``before`` link the symbols of a part, -1 at its ends."""
    n = len(ids)
    symbol, after, before = list(ids), [-1] * n, [-1] * n
    size, fresh = {}, max(ids, default=0) + 1
    places: dict[tuple[int, int], set[int]] = {}
    for a, b in parts:
        for i in range(a, b - 1):
            after[i], before[i + 1] = i + 1, i
            places.setdefault((symbol[i], symbol[i + 1]), set()).add(i)
    born = {pair: k for k, pair in enumerate(places)}
    heap = [(-len(at), born[pair], pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int, list[int]]] = []

    def leave(i: int) -> None:
        at = places.get((symbol[i], symbol[after[i]]))
        if at is not None:
            at.discard(i)

    def enter(i: int, touched: set) -> None:
        pair = (symbol[i], symbol[after[i]])
        if pair not in places:
            places[pair] = set()
            born[pair] = len(born)
        places[pair].add(i)
        touched.add(pair)

    while heap:
        count, age, pair = heapq.heappop(heap)
        at = places.get(pair)
        if at is None:
            continue
        if len(at) != -count:  # counts went down since
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), age, pair))
            continue
        left, right = pair
        new, starts, touched = fresh, [], set()
        for i in sorted(at):
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # overlaps the one before (as in aaa)
            h, k = before[i], after[j]
            if h >= 0:
                leave(h)
            if k >= 0:
                leave(j)
            symbol[i], symbol[j] = new, -1
            after[i] = k
            if k >= 0:
                before[k] = i
                enter(i, touched)
            if h >= 0:
                enter(h, touched)
            starts.append(i)
        del places[pair]
        if starts:
            words = size.get(left, 1)
            size[new] = words + size.get(right, 1)
            rules.append((words, size[new], starts))
            fresh += 1
        touched.discard(pair)
        for p in touched:
            if p in places and len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), born[p], p))
    rest = []
    for a, b in parts:
        starts, i = [], a
        while i >= 0:
            starts.append(i)
            i = after[i]
        rest.append([*starts, b])
    return rules, rest


def _agree(s: list[int], t: list[int]) -> np.ndarray:
    """For each position of t the length of the longest common prefix of t from there and s (the Z algorithm on s, #, t)."""
    joined = [*s, -1, *t]
    z, left, right = [0] * len(joined), 0, 0
    for i in range(1, len(joined)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(joined) and joined[k] == joined[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return np.array(z[len(s) + 1 :], dtype=np.int64)


def crossing(words: np.ndarray, middle: int) -> list[Run]:
    """The longest stretches of words, of at least LEAST words and PERIODS periods, that hold both words[middle - 1] and
    words[middle], each with its smallest period.

    Such a stretch of period q holds q words on one side of the boundary at least. For those on the right, how far words equal
    those q later is the common prefix of the right half with itself from q on, and the common suffix of the left half with
    what ends at middle + q; on the left it is the same, mirrored. Only distances at which the pair around the boundary comes
    again can be periods; with few of them they are measured one by one, otherwise all at once."""
    n = len(words)
    most = n // PERIODS
    lo, hi = max(0, middle - 1 - most), min(n - 1, middle + most)
    again = np.flatnonzero((words[lo:hi] == words[middle - 1]) & (words[lo + 1 : hi + 1] == words[middle])) + lo
    periods = np.unique(np.abs(again - (middle - 1)))[1:]  # its own distance, 0, goes
    if not len(periods) or n < LEAST:
        return []
    found: dict[tuple[int, int], int] = {}
    if len(periods) <= 8:
        for q in map(int, periods):
            differs = np.flatnonzero(words[:-q] != words[q:])
            for anchor in (middle, middle - q):
                if 0 <= anchor <= n - q:
                    k = int(np.searchsorted(differs, anchor))
                    end = int(differs[k]) if k < len(differs) else n - q
                    start = int(differs[k - 1]) + 1 if k else 0
                    _keep(found, start, end + q, q, middle)
    else:
        left, right = words[:middle].tolist(), words[middle:].tolist()
        q = np.arange(1, most + 1)
        for u, v, mirrored in ((left, right, False), (right[::-1], left[::-1], True)):
            if not v:
                continue
            ok = q[q <= len(v)]
            ahead, behind = np.append(_agree(v, v), 0)[ok], _agree(u[::-1], (u + v)[::-1])[len(v) - ok]
            good = ahead + behind + ok >= np.maximum(LEAST, PERIODS * ok)
            for p, f, b in zip(ok[good].tolist(), ahead[good].tolist(), behind[good].tolist()):
                start, end = len(u) - b, len(u) + p + f
                _keep(found, *((n - end, n - start) if mirrored else (start, end)), p, middle)
    return [(a, b, p) for (a, b), p in found.items()]


def _keep(found: dict[tuple[int, int], int], start: int, end: int, period: int, middle: int) -> None:
    if start < middle < end and end - start >= max(LEAST, PERIODS * period):
        found[start, end] = min(period, found.get((start, end), period))


def merged(found: list[Run]) -> list[Run]:
    """Maximal runs by start, then period: stretches of one period that share a period's words are one; of equal stretches
    the smallest period counts, the others are its multiples."""
    whole: dict[tuple[int, int], int] = {}
    last: Run | None = None
    for start, end, q in [*sorted(set(found), key=lambda r: (r[2], r[0], -r[1])), (0, 0, 0)]:
        if last and q == last[2] and start <= last[1] - q:
            last = (last[0], max(last[1], end), q)
            continue
        if last:
            whole[last[:2]] = min(last[2], whole.get(last[:2], last[2]))
        last = (start, end, q)
    return sorted(((a, b, q) for (a, b), q in whole.items()), key=lambda r: (r[0], r[2]))


def runs_of(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of ids, by the grammar of the parts that can hold any."""
    parts = stretches(ids)
    if not parts:
        return []
    rules, rest = re_pair(ids.tolist(), parts)
    found: list[Run] = []
    for half, words, starts in rules:
        if words >= LEAST:
            here = crossing(ids[starts[0] : starts[0] + words], half)
            found += [(s + a, s + b, q) for a, b, q in here for s in starts]
    nodes = [(starts, 0, len(starts) - 1) for starts in rest]
    while nodes:
        starts, a, b = nodes.pop()
        if b - a < 2 or starts[b] - starts[a] < LEAST:
            continue
        m = (a + b) // 2
        found += [(starts[a] + x, starts[a] + y, q) for x, y, q in crossing(ids[starts[a] : starts[b]], starts[m] - starts[a])]
        nodes += [(starts, a, m), (starts, m, b)]
    return merged(found)


def periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The registered query's input: one document in ten (by its id) goes on periodically from some word."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _described(words: list[bytes]) -> dict:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    runs = runs_of(ids)
    lost = np.zeros(len(words) + 1, dtype=np.int64)
    for start, end, q in runs:
        lost[start + q] += 1
        lost[end] -= 1
    kept = words if not runs else [words[i] for i in np.flatnonzero(np.cumsum(lost[:-1]) == 0)]
    return {"runs": [{"start": a, "length": b - a, "period": q} for a, b, q in runs], "collapsed": b" ".join(kept)}


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start, then period) and ``collapsed`` (each run cut to its first period,
    words joined by one space) of every row of docs.

    A run is a longest stretch of words with a smallest period q, of six words and four periods at least. A null or empty
    text has no words: no runs, an empty text. Repeated rows get a result each, extra columns are not looked at, an empty
    table gives an empty one. planted: each text is first continued periodically as ``periodic_tail`` says; texts of a null
    doc_id are taken as they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()
                made.append(_described(periodic_tail(words, doc_id) if planted else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m["runs"] for m in made], RUNS), pa.array([m["collapsed"].decode() for m in made], pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(each, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return (
        periodic_runs(docs, planted=True)
        .select("doc_id", "runs", "collapsed", longest.alias("r"))
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", (-F.col("r.minus")).alias("length"), "r.period", F.expr("-r.minus * 1000 div r.period").alias("exponent_milli"),
            F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
