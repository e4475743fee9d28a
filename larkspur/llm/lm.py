"""Operator 4, LM scoring: a hashed maximum-entropy model with class-factored softmax.

    P(word | history) = product over a path of P(turn | node, history) * P(word | leaf)

A word's class is a leaf of a tree of DEPTH two-way softmaxes: ENDING bits are a hash of its last two bytes, the others
of the whole word, so what n-grams learn first is shared by words of one ending, and then tells words of it apart. Each softmax has hashed features: the word before (bigram), the word before that (skip)
and both (trigram), each crossed with the node; its bias is the node's share in all training tokens, so a model without
features is the base. P(word | leaf) is the smoothed unigram within the leaf.

Training: each task makes AdaGrad updates on mini-batches of its documents, Spark averages the tasks' weights entry by
entry, weighted by how much each task saw of an entry, in a tree of partial means, and hands the mean back for the next
round. The table of weights has 2^20 entries for up to 2^28 tokens, so that few features of a small corpus share an entry,
and then grows with the square root of their number (2^22 at 30 GB) up to 2^26 entries at 2^40 tokens, as the driver collects
12 bytes an entry; the counts grow with the vocabulary without bound. The number of training tasks is lowered where all
their tables together would exceed the texts.

Counts meet texts by chunk, a bounded group of documents: a chunk sends each distinct token once with its own count
and gets back only totals that differ. No list of a token's documents is ever built, and the vocabulary, which grows
with the corpus, is never in one place. Tokens count by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configured, text_key, written
from .near import _SPACE, _mix, word_hashes
from .near import BATCH as ARROW

DEPTH, ENDING = 8, 4
LEAVES = 1 << DEPTH
_U = np.uint64
_I = np.uint32
END, NONE = _U(0x6C62272E07BB0142), _U(0x27D4EB2F165667C5)
#: Entries of a block of weights on its way, tokens scored at once, and bytes of which texts are split into tokens together.
BLOCK, BATCH, BYTES = 1 << 14, 1 << 15, 1 << 16
#: Bounds of bits_for.
FEWEST, MOST = 20, 26


def bits_for(tokens: int) -> int:
    """log2 of the number of weights: one more for each fourfold number of tokens, between FEWEST and MOST."""
    return min(MOST, max(FEWEST, 19 + int(np.floor(np.log2(max(tokens, 1) / 2**26) / 2))))


def encoded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and leaf of each token of a text, the end included."""
    h, k, _ = encoded_all([text])
    return h, k


def encoded_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and leaf of each token of the texts, one after the other, and each text's number of tokens, its end included. Texts
    go through together, as a call costs more than a short text's few words."""
    low = b"\n".join(texts).lower()
    b = np.frombuffer(low, np.uint8)
    space = _SPACE[b]
    last = np.flatnonzero(~space & np.append(space[1:], True)) if len(b) else np.empty(0, np.intp)
    ends = np.searchsorted(last, np.cumsum([len(t) + 1 for t in texts]) - 1)  # words up to each text's end
    two = np.where((last > 0) & ~space[last - 1], b[last - 1], 0).astype(_I)
    top = ((b[last] + (two << _I(8)) + _I(1)) * _I(2654435761)) >> _I(32 - ENDING)
    h, top = np.insert(word_hashes(low), ends, END), np.insert(top, ends, _I(0))
    return h, (top << _I(DEPTH - ENDING) | (h >> _U(64 - DEPTH + ENDING)).astype(_I)).astype(np.uint8), np.diff(ends, prepend=0) + 1


def features(h: np.ndarray, starts: np.ndarray | int = 0) -> np.ndarray:
    """Hashed features (3, tokens) of each token's history within its document. starts: where documents start in h."""
    one = np.append(NONE, h[:-1])
    one[starts] = NONE
    two = np.append(NONE, one[:-1])
    two[starts] = NONE
    return np.stack([one >> _U(32), (two * _U(0x9E3779B97F4A7C15)) >> _U(32), (one * _U(3) + _mix(two)) >> _U(32)]).astype(_I)


def together(texts) -> Iterator[list[bytes]]:
    """The texts (Arrow's binary values) in groups of BYTES or one more text."""
    group, held = [], 0
    for t in texts:
        group.append(t := t.as_py() or b"")
        held += len(t)
        if held >= BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def indices(f: np.ndarray, leaf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per level of the tree: nodes (DEPTH, tokens), turns taken there, and places of the weights (DEPTH, 3, tokens)."""
    leaf = leaf.astype(_I)
    node = np.stack([(leaf >> _I(DEPTH - d)) | _I(1 << d) for d in range(DEPTH)])
    turn = np.stack([(leaf >> _I(DEPTH - 1 - d)) & _I(1) for d in range(DEPTH)])
    x = f[None, :, :] ^ (node * _I(0x9E3779B1))[:, None, :]
    x *= _I(0x85EBCA6B)
    x ^= x >> _I(15)
    x *= _I(0xC2B2AE35)
    x >>= _I(32 - bits)
    return node, turn, x


def log_p(w: np.ndarray, bias: np.ndarray, f: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural log of P(leaf | history) for each token."""
    node, turn, at = indices(f, leaf, len(w).bit_length() - 1)
    z = bias[node]
    z += w[at].sum(axis=1)
    z *= 1 - 2 * turn.astype(np.float32)
    return -np.logaddexp(0, z).sum(axis=0, dtype=np.float64)


def update(w: np.ndarray, sq: np.ndarray, bias: np.ndarray, f: np.ndarray, leaf: np.ndarray, rate: float) -> None:
    node, turn, at = indices(f, leaf, len(w).bit_length() - 1)
    z = bias[node]
    z += w[at].sum(axis=1)
    off = 1 / (1 + np.exp(-z)) - turn
    g = np.bincount(at.ravel(), np.repeat(off[:, None, :], 3, axis=1).ravel(), minlength=len(w)).astype(np.float32)
    sq += g * g
    g /= np.sqrt(sq + np.float32(1))
    w -= np.float32(rate) * g


def biases(leaves: np.ndarray) -> np.ndarray:
    """Log odds of each node's second turn, from smoothed shares of the leaves."""
    share = np.asarray(leaves, np.float64)
    out = np.zeros(LEAVES, np.float32)
    for d in range(DEPTH - 1, -1, -1):
        both = share.reshape(-1, 2)
        out[1 << d : 2 << d] = np.log(both[:, 1] / both[:, 0])
        share = both.sum(axis=1)
    return out


def _trained(start: bytes | None, bias: np.ndarray, bits: int, rate: float, groups: int, step: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        size = 1 << bits
        both = np.zeros((2, size), np.float32) if start is None else np.frombuffer(start, np.float32).reshape(2, size).copy()
        w, sq = both
        before = sq.copy()
        fs, ks, held, n = [], [], 0, 0

        def go() -> None:
            nonlocal fs, ks, held
            f, k = np.concatenate(fs, axis=1), np.concatenate(ks)
            for i in range(0, len(k), step):
                update(w, sq, bias, f[:, i : i + step], k[i : i + step], rate)
            fs, ks, held = [], [], 0

        for b in batches:
            for texts in together(b.column("text").cast(pa.binary())):
                h, k, tokens = encoded_all(texts)
                fs.append(features(h, np.cumsum(tokens) - tokens))
                ks.append(k)
                held += len(k)
                n += len(k)
                if held >= max(BATCH, step):
                    go()
        if held:
            go()
        if n:
            seen = sq - before + np.float32(1e-6)  # how much this task saw of each entry
            group = TaskContext.get().partitionId() % groups
            for i in range(0, size, BLOCK):
                z = slice(i, i + BLOCK)
                row = np.stack([w[z] * seen[z], seen[z], sq[z]]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([group], pa.int32()), pa.array([1], pa.int64()), pa.array([row], pa.binary())], names=["block", "part", "n", "w"])

    return run


def _summed(batches: Iterator) -> Iterator:
    """Sums of blocks as they stream by; one array a block and part."""
    import pyarrow as pa

    total: dict[tuple, list] = {}
    for b in batches:
        for key in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("w")):
            block, part, n, w = key
            x = np.frombuffer(w.as_py(), np.float32).astype(np.float64)
            if (block, part) in total:
                total[block, part][0] += n
                total[block, part][1] += x
            else:
                total[block, part] = [n, x]
    for (block, part), (n, x) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["block", "part", "n", "w"])


def train(docs: DataFrame, leaves: np.ndarray, tokens: int, bytes_: int, rounds: int = 2, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) from the documents, given smoothed counts of the leaves, the number of tokens and of bytes."""
    bits, bias = bits_for(tokens), biases(leaves)
    size = 1 << bits
    texts = docs.select("text")
    tasks = texts.rdd.getNumPartitions()
    most = max(1, bytes_ // (12 * size))  # all tasks' tables together are no larger than the texts
    if tasks > most:
        tasks, texts = most, texts.coalesce(most)
    groups, blocks = max(1, int(tasks**0.5)), size // BLOCK
    # a batch costs a pass over the table, so batches grow with it; a small corpus still gets 64 of them a task
    step = max(256, min(size >> 6, tokens // (64 * max(1, tasks))))
    kind = "block int, part int, n long, w binary"
    state: bytes | None = None
    for _ in range(rounds):
        parts = texts.mapInArrow(_trained(state, bias, bits, rate, groups, step), kind)
        some = parts.repartition(blocks * groups, "block", "part").mapInArrow(_summed, kind).withColumn("part", F.lit(0))
        rows = sorted(some.repartition(blocks, "block").mapInArrow(_summed, kind).collect(), key=lambda r: r["block"])
        if not rows:
            return np.zeros(size, np.float32), bias
        x = np.concatenate([np.frombuffer(bytes(r["w"]), np.float32).reshape(3, -1) for r in rows], axis=1)
        state = np.stack([x[0] / x[1], x[2] / rows[0]["n"]]).astype(np.float32).tobytes()
    return np.frombuffer(state, np.float32)[:size], bias


def _packed(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("chunk"), pa.array([z.compress(t.as_py() or b"") for t in b.column("text").cast(pa.binary())], pa.binary())], names=["doc_id", "held_out", "chunk", "z"])


def _unpacked(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and leaf of each token of a chunk's texts, and each text's number of tokens."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    parts, group, held = [], [], 0
    for x in table.column("z"):
        group.append(z.decompress(x.as_py()))
        held += len(group[-1])
        if held >= BYTES:
            parts.append(encoded_all(group))
            group, held = [], 0
    if group:
        parts.append(encoded_all(group))
    h, k, tokens = zip(*parts) if parts else ([np.empty(0, _U)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)])
    return np.concatenate(h), np.concatenate(k), np.concatenate(tokens)


def _local(h: np.ndarray, k: np.ndarray, tokens: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a chunk, their leaves, their counts in training documents, and each token's index."""
    if not len(h):
        return h, k, np.empty(0, np.int64), np.empty(0, np.int32)
    order = np.argsort(h)
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    u, first = s[new], np.flatnonzero(new)
    del s  # arrays of a chunk's tokens are large
    n = np.add.reduceat(np.repeat(~held, tokens)[order], first, dtype=np.int64)
    back = np.empty(len(h), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return u, k[order[first]], n, back


def _vocabulary(key, table):
    import pyarrow as pa

    u, k, n, _ = _local(*_unpacked(table), table.column("held_out").to_numpy())
    return pa.table([pa.array(np.full(len(u), key[0].as_py(), np.int32)), pa.array(u.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], names=["chunk", "h", "k", "n"])


def _grouped(tokens: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts that are scored together: the first, the one after the last, and the same of their tokens."""
    ends = np.cumsum(tokens)
    at = done = 0
    while at < len(tokens):
        end = min(len(tokens), int(np.searchsorted(ends, done + BATCH)) + 1)
        yield at, end, done, int(ends[end - 1])
        at, done = end, int(ends[end - 1])


def _log10s(w: np.ndarray, bias: np.ndarray, hs: list[np.ndarray], ks: list[np.ndarray]) -> list[float]:
    """log10 P(leaves | histories) of each text. Short texts go together, as a call costs more than a text's few tokens."""
    out: list[float] = []
    for at, end, _, _ in _grouped(np.array([len(h) for h in hs], np.int64)):
        n = np.array([len(h) for h in hs[at:end]])
        out += _log10_of(w, bias, np.concatenate(hs[at:end]), np.concatenate(ks[at:end]), np.cumsum(n) - n).tolist()
    return out


def _log10_of(w: np.ndarray, bias: np.ndarray, h: np.ndarray, k: np.ndarray, starts: np.ndarray) -> np.ndarray:
    f = features(h, starts)
    p = np.concatenate([log_p(w, bias, f[:, i : i + BATCH], k[i : i + BATCH]) for i in range(0, len(k), BATCH)])
    return np.add.reduceat(p, starts) / np.log(10)  # no text is without a token, its end


def score(docs: DataFrame, held_out, rounds: int = 2, chunk_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a Boolean column expression.

    Null and empty texts are one token, the end. Rows are independent, repeated rows count as often as they stand. An
    empty table gives an empty one; extra columns are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(max(1, -(-size // chunk_bytes)))
    chunk = F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(chunks)).cast("int")
    packed = rows.select("doc_id", "held_out", chunk.alias("chunk"), "text").mapInArrow(_packed, f"doc_id {kind}, held_out boolean, chunk int, z binary").repartition(chunks, "chunk")
    with configured(docs.sparkSession, ARROW):
        vocabulary = written(packed.groupBy("chunk").applyInArrow(_vocabulary, "chunk int, h long, k int, n long"), "lm-vocabulary")
    totals = written(vocabulary.groupBy("h").agg(F.first("k").alias("k"), F.sum("n").alias("c"), F.count(F.lit(1)).alias("m")), "lm-counts")
    known = totals.where("c > 0").groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_all, v_all = sum(r["n"] for r in known), sum(r["v"] for r in known)
    smooth = np.ones(LEAVES)
    for r in known:
        smooth[r["k"]] += r["n"] + r["v"]
    with configured(docs.sparkSession, ARROW):
        weights, bias = train(rows.where("not held_out"), smooth, n_all, size, rounds)
    # from the smoothed share of a leaf's words to that of all words
    gain = np.log10((n_all + v_all + 1) / smooth)

    def scored(key, texts, counts):
        import pyarrow as pa

        h, k, tokens = _unpacked(texts)
        u, _, own, back = _local(h, k, tokens, texts.column("held_out").to_numpy())
        if len(u) and counts.num_rows:
            own[np.searchsorted(u, counts.column("h").to_numpy().view(_U))] = counts.column("c").to_numpy()
        log, none = np.log10(own + 1.0), np.empty(0)
        known, base, score = [none], [none], [none]
        for at, end, i, j in _grouped(tokens):
            starts = np.cumsum(tokens[at:end]) - tokens[at:end]
            mine = back[i:j]
            known.append(np.add.reduceat(own[mine] > 0, starts, dtype=np.int64))
            base.append(np.add.reduceat(log[mine], starts) - tokens[at:end] * np.log10(n_all + v_all + 1.0))
            score.append(base[-1] + np.add.reduceat(gain[k[i:j]], starts) + _log10_of(weights, bias, h[i:j], k[i:j], starts))
        cols = [tokens, np.concatenate(known).astype(np.int64), np.full(len(tokens), n_all, np.int64), np.concatenate(base), np.concatenate(score)]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *(pa.array(x) for x in cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # a token that every chunk holds has a row a chunk here, never one a document
    back = vocabulary.join(totals.where("m > 1").select("h", "c"), "h").where("c <> n").select("chunk", "h", "c").repartition(chunks, "chunk")
    return packed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(docs: DataFrame) -> DataFrame:
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
