"""Operator 1, suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts elsewhere goes.

Each string of LENGTH bytes belongs to one segment, the run of strings that share their leftmost smallest gram; equal
strings have the same gram at the same place. So only segments whose gram is found twice can hold repeats, and
segments that are equal as a whole are repeats as a whole: those two cases are counted by hashes, map-side first, and
copies of any number cost no more. What is left, different segments around one gram, is dealt to shards by gram and
sorted by external induced suffix sorting (induced.py), whose common-prefix lengths say which strings repeat. No shard
needs what another has. Where more than MANY segments differ around one gram, their strings are counted by hash too, so
that a group that is sorted has at most MANY segments, however many documents hold its gram.

Texts move compressed, twice: to cut out the segments that are sorted, and to meet the spans they lose.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key, written
from .induced import CAP, sort_suffixes

LENGTH, GRAM = 200, 50
#: So many grams stand in a string of LENGTH.
SPAN = LENGTH - GRAM + 1
_U = np.uint64
_BYTE = np.random.default_rng(1).integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_MUL = 0x9E3779B97F4A7C15
_BLOCK = 1 << 15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(2 * _BLOCK, _MUL), _powers(2 * _BLOCK, pow(_MUL, -1, 2**64))


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes of a block."""
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * _POW[: len(b)], out=sums[1:])
    n = len(b) - GRAM + 1
    x = (sums[GRAM : GRAM + n] - sums[:n]) * _INV[:n]
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's strings of LENGTH, as runs that share their leftmost smallest gram: first start, number of starts,
    the gram's place after the first start, the gram's hash. Equal strings have their smallest gram at the same place."""
    b = np.frombuffer(text, np.uint8)
    total = len(b) - LENGTH + 1
    first, place, hashes = [], [], []
    for at in range(0, max(total, 0), _BLOCK):
        n = min(_BLOCK, total - at)
        h = _grams(b[at : at + n + LENGTH - 1])
        low = (h & ~_U(0xFFFF)) | np.arange(len(h), dtype=_U)
        k = 1
        while 2 * k <= SPAN:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[: len(low) - (SPAN - k)], low[SPAN - k :])
        p = (low & _U(0xFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        first.append(new + at)
        place.append(p[new] + at)
        hashes.append(h[p[new]])
    if not first:
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(_U)
    s, p, h = np.concatenate(first), np.concatenate(place), np.concatenate(hashes)
    own = np.concatenate(([True], p[1:] != p[:-1]))  # a run may go on in the next block
    s, p, h = s[own], p[own], h[own]
    return s, np.diff(np.concatenate((s, [total]))), p - s, h


def _segment_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    for b in batches:
        row, first, count, place, gram, whole = [], [], [], [], [], []
        for k, t in enumerate(b.column("text").cast(pa.binary())):
            text = t.as_py() or b""
            s, m, o, h = segments(text)
            row.append(np.full(len(s), k))
            first.append(s)
            count.append(m)
            place.append(o)
            gram.append(h.view(np.int64))
            whole += [xxhash.xxh3_64_intdigest(text[i : i + j + LENGTH - 1]) for i, j in zip(s.tolist(), m.tolist())]
        if not row:
            continue
        at = pa.array(np.concatenate(row))
        cols = [np.concatenate(first).astype(np.int32), np.concatenate(count).astype(np.int32), np.concatenate(place).astype(np.int32), np.concatenate(gram).astype(np.int64), np.array(whole, _U).view(np.int64)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), *map(pa.array, cols)], names=["doc_id", "th", "s", "m", "o", "h", "c"])


def _packed(batches: Iterator) -> Iterator:
    """Texts compressed, so that their shuffle is smaller."""
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = [z.compress(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(texts, pa.binary())], names=["doc_id", "th", "z"])


def _cut_out(batches: Iterator) -> Iterator:
    """The bytes of wanted segments (x); of those around a gram with many variants a hash of each string (k)."""
    import pyarrow as pa
    import xxhash
    import zstandard

    z = zstandard.ZstdDecompressor()

    def table(b, rows: list[tuple]):
        at, h, once, s, k, x = zip(*rows)
        i = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(i), b.column("th").take(i), pa.array(h, pa.int64()), pa.array(once, pa.bool_()), pa.array(s, pa.int32()), pa.array(k, pa.int64()), pa.array(x, pa.binary())],
            names=["doc_id", "th", "h", "once", "s", "k", "x"],
        )

    for b in batches:
        rows = []
        for at, (packed, want) in enumerate(zip(b.column("z"), b.column("want"))):
            text = z.decompress(packed.as_py())
            for w in want.as_py():
                s, m, h, once = w["s"], w["m"], w["h"], w["once"]
                if w["split"]:
                    k = np.array([xxhash.xxh3_64_intdigest(text[i : i + LENGTH]) for i in range(s, s + m)], _U).view(np.int64).tolist()
                    rows += [(at, h, once, s + i, y, None) for i, y in enumerate(k)]
                else:
                    rows.append((at, h, once, s, None, text[s : s + m + LENGTH - 1]))
                if len(rows) >= 20_000:
                    yield table(b, rows)
                    rows = []
        if rows:
            yield table(b, rows)


def _repeats(batches: Iterator) -> Iterator:
    """Sorts the shard's suffixes, in files, and gives runs of strings that start twice, of segments found once."""
    import pyarrow as pa

    with tempfile.TemporaryDirectory() as folder:
        ids, starts, sizes, onces, at = [], [], [], [], 0
        with open(f"{folder}/text", "wb") as f:
            for b in batches:
                x = b.column("x")
                size = np.array([len(v) for v in x.to_pylist()]) if len(x) else np.empty(0, np.int64)
                for v in x.to_pylist():
                    np.append(np.frombuffer(v, np.uint8).astype(np.uint16) + 2, np.uint16(1)).tofile(f)
                ids.append(b.select(["doc_id", "th"]))
                starts.append(b.column("s").to_numpy(zero_copy_only=False))
                onces.append(b.column("once").to_numpy(zero_copy_only=False))
                sizes.append(size)
                at += int(size.sum()) + len(size)
            np.zeros(1 + CAP + 40, np.uint16).tofile(f)
        if not at:
            return
        size, start, once = np.concatenate(sizes), np.concatenate(starts), np.concatenate(onces)
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
        text = np.memmap(f"{folder}/text", np.uint16, "r")
        valid = np.zeros(at + 1, bool)  # where a string of LENGTH starts that lies in its segment
        delta = np.zeros(at + 2, np.int8)
        delta[begin] += 1
        np.add.at(delta, begin + np.maximum(size - LENGTH + 1, 0), -1)
        np.cumsum(delta[:-1], out=delta[:-1])
        valid[:] = delta[:-1] > 0
        del delta
        twice = np.zeros(at + 1, bool)

        def keep(pos: np.ndarray, lcp: np.ndarray) -> None:
            # separators are ordinary symbols, so a common prefix of LENGTH that starts where a string does is that string
            same = (lcp >= LENGTH)[1:] & valid[pos[1:]] & valid[pos[:-1]]
            twice[pos[1:][same]] = True
            twice[pos[:-1][same]] = True

        sort_suffixes(text, at + 1, 258, folder, keep)
        own = np.repeat(once, size + 1)
        hit = twice[:-1] & own
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        a, z = edge[::2], edge[1::2]
        row = np.searchsorted(begin, a, side="right") - 1
        table = pa.Table.from_batches(ids).take(pa.array(row)).combine_chunks()
        first = start[row] + (a - begin[row])
        table = table.append_column("a", pa.array(first.astype(np.int32))).append_column("e", pa.array((first + (z - a) - 1 + LENGTH).astype(np.int32)))
        yield from table.to_batches(max_chunksize=50_000)


#: Where more segments than this differ around one gram, their strings are counted by hash and not sorted.
MANY = 2000


def repeated_spans(docs: DataFrame, shard_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, th (a hash of the text), spans: array of (a, e), bytes from a to before e repeat. Documents without repeats
    have no row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text")
    seg = written(keyed.mapInArrow(_segment_rows, f"doc_id {kind}, th long, s int, m int, o int, h long, c long"), "seg")
    again = seg.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = written(seg.join(again, "h", "left_semi"), "seg-shared")
    groups = written(shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "s", "m", "o")).alias("at")), "seg-groups")
    differ = groups.groupBy("h").agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("low")).where("v > 1 and low = 1").select("h", "v")
    wanted = groups.join(differ, "h").select("at.doc_id", "at.th", F.struct("h", F.col("at.s").alias("s"), F.col("at.m").alias("m"), F.col("at.o").alias("o"), (F.col("n") == 1).alias("once"), (F.col("v") > MANY).alias("split")).alias("w"))
    wanted = written(wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("want"), F.sum(F.when(~F.col("w.split"), F.col("w.m") + LENGTH)).alias("bytes")), "seg-wanted")
    shards = max(1, -(-(wanted.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    whole = groups.where("n > 1").select("h", "c")
    full = shared.join(whole, ["h", "c"], "left_semi").select("doc_id", "th", F.col("s").alias("a"), (F.col("s") + F.col("m") - 1 + LENGTH).alias("e"))
    # one text a (doc_id, th): rows alike in both are one row here, and repeat as a whole anyway
    texts = keyed.mapInArrow(_packed, f"doc_id {kind}, th long, z binary")
    need = wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "want")
    strings = (
        texts.join(need, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["th"] == F.col("t"))).select("doc_id", "th", "z", "want")
        .mapInArrow(_cut_out, f"doc_id {kind}, th long, h long, once boolean, s int, k long, x binary")
    )
    if not differ.where(F.col("v") > MANY).isEmpty():
        strings = written(strings, "seg-strings")
        hashed = strings.where("k is not null").select("doc_id", "th", "h", "once", "s", "k")
        twice = hashed.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "k")
        full = full.unionByName(hashed.where("once").join(twice, ["h", "k"], "left_semi").select("doc_id", "th", F.col("s").alias("a"), (F.col("s") + LENGTH).alias("e")))
        strings = strings.where("x is not null")
    part = strings.select("doc_id", "th", "h", "once", "s", "x").repartition(int(shards), "h").mapInArrow(_repeats, f"doc_id {kind}, th long, a int, e int")
    return full.unionByName(part).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def _removed(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for packed, spans in zip(b.column("z"), b.column("spans")):
            text = z.decompress(packed.as_py())
            got = merged([(w["a"], w["e"]) for w in spans.as_py() or []])
            kept, at = [], 0
            for a, e in got:
                kept.append(text[at:a])
                at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((len(text), len(text) - len(rest), len(got), [{"a": a, "e": e} for a, e in got], rest))
        n, r, k, s, x = zip(*rows) if rows else ([],) * 5
        kind = pa.list_(pa.struct([("a", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(s, kind), pa.array(x, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of a, e) and kept (the bytes left; a cut may fall inside a
    character), a row per row of docs.

    Null texts are empty; texts below LENGTH bytes lose nothing. Repeated rows repeat each other. A null doc_id is a
    document like any other. An empty table gives an empty one; extra columns are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans")
    texts = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text").mapInArrow(_packed, f"doc_id {kind}, th long, z binary")
    met = texts.join(spans, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["th"] == F.col("t")), "left").select("doc_id", "z", "spans")
    return met.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<a:int,e:int>>, kept binary")


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    return repeats_removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """The same by a table of all strings (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    return {d: merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]) for d, t in texts.items()}
