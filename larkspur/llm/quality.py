"""Operator 6, quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

Viterbi decoding finds the best labels of a document's lines together; the share of characters on content lines
decides whether it stays. The field is fitted here, on a bounded sample of labelled documents (``fit_docs`` of either
quality, those with the lowest hashes of doc_id): the lines of documents of quality 1 are content, of quality 0
boilerplate. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What counts as a symbol.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
FEATURES = ("bias", "symbols", "many_symbols", "pipes", "many_pipes", "upper", "mostly_upper", "marks", "many_marks", "repeated", "same_words")
_SPACE, _UPPER, _SYMBOL, _PIPE, _MARK, _CONT = 1, 2, 8, 16, 32, 64
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in ((b" \t\n\x0b\x0c\r", _SPACE), (bytes(range(65, 91)), _UPPER), (SYMBOLS, _SYMBOL), (b"|", _PIPE), (b"!?;:=_~^{}[]/\\@", _MARK), (bytes(range(128, 192)), _CONT)):
    _CLASS[list(_chars)] |= _bit


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in windows of so many words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x94D049BB133111EB) + x[k : k + n]
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    d = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(d, at, 1)
    np.add.at(d, at + width, -1)
    return int((np.cumsum(d[:-1]) > 0).sum())


def lines_of(text: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int, int]]:
    """Features of each line, its code points, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    again = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if line in seen:
            again[i] = True
        else:
            seen.add(line)
    words = text.split()
    c = _CLASS[np.frombuffer(text + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1))

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64).astype(np.float64)

    space = (c & _SPACE) > 0
    whole = (c & _CONT) == 0
    first = ~space
    first[1:] &= space[:-1]
    n, chars = per_line(first), per_line(whole & ~space)
    symbol = (c & _SYMBOL) > 0
    safe = np.maximum(chars, 1)
    sym, pipe, up, mark = per_line(symbol) / safe, per_line((c & _PIPE) > 0) / np.maximum(n, 1), per_line((c & _UPPER) > 0) / safe, per_line((c & _MARK) > 0) / safe
    # words that repeat the word before them
    same = np.zeros(len(words) + 1, bool)
    same[1:-1] = [x == y for x, y in zip(words, words[1:])]
    line_of_word = np.searchsorted(starts, np.flatnonzero(first), side="right") - 1
    alike = np.bincount(line_of_word[same[: len(line_of_word)]], minlength=len(lines)) / np.maximum(n, 1)
    f = np.stack([
        np.ones(len(lines)), np.minimum(4 * sym, 2), sym > 0.1, np.minimum(2 * pipe, 2), pipe > 0.2, np.minimum(2 * up, 2), up > 0.4,
        np.minimum(4 * mark, 2), mark > 0.1, again & (n > 0), np.minimum(2 * alike, 2),
    ], axis=1).astype(np.float64)
    base = (len(words), int(chars.sum()), int(symbol.sum()), int((again & (n > 0)).sum()), repeat_words(words))
    return f, chars, base


def viterbi(score: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels for scores (lines, 2) and transition scores (from, to)."""
    n = len(score)
    back = np.zeros((n, 2), np.int8)
    a, b = float(score[0, 0]), float(score[0, 1])
    (t00, t01), (t10, t11) = step.tolist()
    for i, (s0, s1) in enumerate(score[1:].tolist(), 1):
        x, y, z, w = a + t00, b + t10, a + t01, b + t11
        back[i, 0], back[i, 1] = y > x, w > z
        a, b = max(x, y) + s0, max(z, w) + s1
    out = np.zeros(n, np.int8)
    out[-1] = b > a
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def fit_crf(sequences: list[tuple[np.ndarray, int]], steps: int = 300, rate: float = 0.1, l2: float = 1e-5, window: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and transitions (2, 2) that maximise the labels' conditional likelihood, by full gradients
    (forward-backward over sequences cut to windows of lines) and Adam."""
    parts = [(f[i : i + window], y) for f, y in sequences for i in range(0, len(f), window)]
    parts.sort(key=lambda p: -len(p[0]))
    size = np.array([len(f) for f, _ in parts])
    longest = int(size[0])
    x = np.zeros((len(parts), longest, len(FEATURES)))
    for i, (f, _) in enumerate(parts):
        x[i, : len(f)] = f
    y = np.array([q for _, q in parts])
    live = np.array([(size > t).sum() for t in range(longest)])
    mask = np.arange(longest)[None, :] < size[:, None]
    balance = np.where(y == 1, 0.5 / max(1, mask[y == 1].sum()), 0.5 / max(1, mask[y == 0].sum()))
    theta = np.zeros(2 * len(FEATURES) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda z, axis: (k := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - k).sum(axis=axis))
    for it in range(1, steps + 1):
        w, t = theta[:-4].reshape(len(FEATURES), 2), theta[-4:].reshape(2, 2)
        u = x @ w
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for k in range(1, longest):
            n = live[k]
            alpha[:n, k] = lse(alpha[:n, k - 1, :, None] + t, 1) + u[:n, k]
        for k in range(longest - 2, -1, -1):
            n = live[k + 1]
            beta[:n, k] = lse(t + (u[:n, k + 1] + beta[:n, k + 1])[:, None, :], 2)
        z = lse(alpha[:, 0] + beta[:, 0], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        truth = np.zeros_like(p)
        truth[np.arange(len(y)), :, y] = mask
        gw = np.einsum("ilf,ilc,i->fc", x, truth - p, balance)
        gt = np.zeros((2, 2))
        for k in range(1, longest):
            n = live[k]
            pair = np.exp(alpha[:n, k - 1, :, None] + t + (u[:n, k] + beta[:n, k])[:, None, :] - z[:n, None, None])
            gt -= np.einsum("icd,i->cd", pair, balance[:n])
            for q in (0, 1):
                gt[q, q] += balance[:n][y[:n] == q].sum()
        g = np.concatenate([gw.ravel(), gt.ravel()]) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-9)
    return theta[:-4].reshape(len(FEATURES), 2), theta[-4:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 600, fit_lines: int = 2_000) -> tuple[np.ndarray, np.ndarray] | None:
    """The field, or None where either quality has no labelled document with a text.

    The sample to fit on is bounded: fit_docs documents of either quality, and of a longer one fit_lines lines, evenly
    spread over it."""
    ids = None
    for q in (0, 1):
        some = labels.where(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        ids = some if ids is None else ids.unionByName(some)
    # at most 2 * fit_docs ids; one text an id
    got = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def features(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            found = (lines_of(t.encode())[0].astype(np.float32) for t in b["text"])
            yield pd.DataFrame({"quality": b["quality"], "f": [x[:: -(-len(x) // fit_lines)].tobytes() for x in found]})

    rows = got.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInPandas(features, "quality int, f binary").collect()
    rows = sorted({(0, r["quality"], bytes(r["f"])) for r in rows})
    if {q for _, q, _ in rows} != {0, 1}:
        return None
    return fit_crf([(np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)).astype(np.float64), q) for _, q, f in rows])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judged(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least_share: float = 0.5, columns: str = "doc_id") -> DataFrame:
    """``row`` (struct of the given columns, ``*``: all) and the verdict's columns. kept: not base_failed and a content
    share of at least least_share; without a model (no labels of both kinds) the base alone decides.

    Null and empty texts have no words and fail the base. Rows are independent, so repeated rows give repeated rows and
    an empty table an empty one; extra columns ride along in ``row``."""
    packed = docs.select(F.struct(*([columns] if columns != "*" else docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = packed.schema["row"].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for t in b.column("text").cast(pa.binary()):
                f, chars, (n, wc, sym, dup, rep) = lines_of(t.as_py())
                failed = n < 20 or 100 * rep > 30 * n
                share = 1.0
                if model is not None and chars.sum() > 0:
                    share = float(chars[viterbi(f @ model[0], model[1]) == 1].sum() / chars.sum())
                rows.append((n, wc, sym, dup, rep, failed, share, not failed and share >= least_share))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = ["row", *(x.split()[0] for x in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    from pyspark.sql.types import StructField, StructType

    return packed.mapInArrow(run, StructType([StructField("row", kind), *StructType.fromDDL(SCHEMA).fields]))


def quality_filter(docs: DataFrame, labels: DataFrame, fit_docs: int = 600, least_share: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, columns as they are."""
    return judged(docs, fit(docs, labels, fit_docs), least_share, "*").where("kept").select("row.*")


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, fit(docs, labels)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
