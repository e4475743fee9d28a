"""Operator 8, token counts by compiled finite-state transducers.

The tokenizer's file (normalisation, split pattern, byte-pair merges with word ends) is compiled into two
deterministic transducers. The first reads character classes and marks where pieces start. Its six states are few
enough that a chunk of text is a map from each entry state to an exit state: all chunks step side by side from all
states, the maps compose through a parallel prefix scan, and with the entry states known each chunk emits its marks.
The second reads the bytes of a piece, the last one as a symbol of its own: arcs carry the tokens gained. It is compiled
from the merges by lazy determinisation (class Merges): states and arcs come into being as texts reach them, and are
kept in tables. The pieces of a batch are counted once each; equal pieces are verified by their characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

# states of the piece transducer: before a piece, in letters, in other marks, one and two left of a contraction, after a closed piece
START, WORD, MARKS, ONE, TWO, CLOSED = range(6)
# classes of characters
SPACE, LETTER, NUMBER, OTHER, SHORT, LONG = range(6)
#: What the file's split pattern must be for this transducer to be its compilation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORTS, LONGS = "stmd", ("re", "ve", "ll")
#: The mark of a piece's last byte, and the characters that stand for bytes in the merges.
END = "</w>"
_NEVER = 1 << 62
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in set(_PLAIN)]
_BYTES = [chr(b) if b in set(_PLAIN) else chr(256 + _REST.index(b)) for b in range(256)]
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by state and class."""
    to, new = np.zeros((6, 6), np.uint8), np.zeros((6, 6), bool)
    goes = {SPACE: START, LETTER: WORD, NUMBER: CLOSED, OTHER: MARKS, SHORT: ONE, LONG: TWO}
    for s in range(6):
        for c, t in goes.items():
            to[s, c], new[s, c] = t, c != SPACE
    new[WORD, LETTER] = False
    to[MARKS, [OTHER, SHORT, LONG]], new[MARKS, [OTHER, SHORT, LONG]] = MARKS, False
    to[ONE], new[ONE] = CLOSED, False
    to[TWO], new[TWO] = ONE, False
    return to, new


TO, NEW = _tables()


def scan(classes: np.ndarray, width: int = 1024) -> np.ndarray:
    """Where pieces start. Chunks of width characters step side by side, from every state, then from the right one."""
    n = len(classes)
    rows = -(-n // width)
    c = np.full(rows * width, SPACE, np.uint8)
    c[:n] = classes
    c = np.ascontiguousarray(c.reshape(rows, width).T)
    flat = TO.ravel()
    maps = np.tile(np.arange(6, dtype=np.uint8), (rows, 1))
    for col in c:
        maps = flat[maps * np.uint8(6) + col[:, None]]
    # inclusive scan by doubling: after it, row i is the map of chunks 0 to i
    d = 1
    while d < rows:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.int64), axis=1)
        d *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, START]
    out = np.empty((width, rows), bool)
    new = NEW.ravel()
    for i, col in enumerate(c):
        k = state * np.uint8(6) + col
        out[i] = new[k]
        state = flat[k]
    return out.T.ravel()[:n]


class Merges:
    """The transducer of the byte-pair merges: from the bytes of a piece to the number of its tokens.

    In a byte-pair encoding the tokens of a prefix are fixed by its last token t and the tokens before t, which are those
    of the shorter prefix; t may follow the token before it only if merging both from scratch gives the two back. So what
    counts for the rest of a piece are the open places, those from which the bytes read so far start some token: for each
    its node in the trie of tokens, the last token there, and how many tokens fewer it has. That tuple is the state. It has
    no more members than the longest token has bytes, so the states are finite; they are numbered when first reached.
    At most ``most`` states are held; beyond that they are forgotten and built anew, which changes no count."""

    def __init__(self, merges: list[tuple[str, str]], most: int = 300_000):
        self.ids: dict[str, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        self.made: dict[tuple[int, int], int] = {}
        for c in _BYTES:
            for end in ("", END):
                self._token(c + end, None)
        for a, b in merges:
            pair = self.ids[a], self.ids[b]
            self.made[pair] = self._token(a + b, pair)
        # trie over symbols; a byte's symbol is 2 * byte, 2 * byte + 1 where it ends the piece
        self.child: dict[tuple[int, int], int] = {}
        self.at: list[int] = [-1]
        self.open: list[bool] = [True]
        number = {c: i for i, c in enumerate(_BYTES)}
        for name, t in self.ids.items():
            ends = name.endswith(END)
            body = [2 * number[c] for c in (name.removesuffix(END) if ends else name)]
            body[-1] += ends
            if self._cut(t) != (t,):
                continue  # never the result of merging its own bytes
            node = 0
            for k in body:
                new = self.child.get((node, k))
                if new is None:
                    new = self.child[node, k] = len(self.at)
                    self.at.append(-1)
                    self.open.append(False)
                self.open[node] = True
                node = new
            self.at[node] = t
        self.most = most
        self._forget()

    def _token(self, name: str, parts: tuple[int, int] | None) -> int:
        self.ids[name] = len(self.parts)
        self.parts.append(parts)
        return self.ids[name]

    def _forget(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}
        self.allowed: dict[tuple[int, int], bool] = {}

    def _leaves(self, t: int) -> list[int]:
        p = self.parts[t]
        return [t] if p is None else self._leaves(p[0]) + self._leaves(p[1])

    def _merged(self, seq: list[int]) -> tuple[int, ...]:
        """Plain merging: always the earliest merge that fits, leftmost first. Tokens are numbered in the order of merges."""
        while True:
            found = [(self.made[pair], i) for i, pair in enumerate(zip(seq, seq[1:])) if pair in self.made]
            if not found:
                return tuple(seq)
            t, i = min(found)
            seq = [*seq[:i], t, *seq[i + 2 :]]

    def _cut(self, t: int) -> tuple[int, ...]:
        return self._merged(self._leaves(t)) if self.parts[t] else (t,)

    def _spine(self, t: int, side: int) -> list[int]:
        """The tokens at one end of t's own merging (0: left, 1: right) in the order in which they come about."""
        out = [t]
        while self.parts[out[-1]] is not None:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging both from scratch gives a, b: no merge across the seam comes before one side's own next merge.

        Left of the seam stands a token of a's right spine, right of it one of b's left spine; each stays until the merge
        that makes the next one (numbers are the order of merges; of equal merges the leftmost comes first)."""
        got = self.allowed.get((a, b))
        if got is None:
            left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
            got = True
            while got:
                over_x = left[i + 1] if i + 1 < len(left) else _NEVER
                over_y = right[j + 1] if j + 1 < len(right) else _NEVER
                m = self.made.get((left[i], right[j]), _NEVER)
                if m < over_x and m <= over_y and m < _NEVER:
                    got = False
                elif over_x == over_y == _NEVER:
                    break
                elif over_x <= over_y:
                    i += 1
                else:
                    j += 1
            self.allowed[a, b] = got
        return got

    def _arc(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and tokens gained; built where no text has gone this way yet."""
        go, found = [], None
        for node, last, less in self.states[state]:
            new = self.child.get((node, symbol))
            if new is None:
                continue
            t = self.at[new]
            if t >= 0 and found is None and (last < 0 or self.may_follow(last, t)):
                found = (t, 1 - less)
            go.append((new, last, less))
        t, gained = found  # a single byte is a token, so there is one
        key = (*((n, last, less + gained) for n, last, less in go if self.open[n]), (0, t, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        arc = self.arcs[state << 9 | symbol] = to, gained
        return arc

    def count(self, piece: bytes) -> int:
        if len(self.states) > self.most:
            self._forget()
        state = n = 0
        arcs = self.arcs
        for x in piece[:-1]:
            state, gained = arcs.get(state << 9 | 2 * x) or self._arc(state, 2 * x)
            n += gained
        x = 2 * piece[-1] + 1
        return n + (arcs.get(state << 9 | x) or self._arc(state, x))[1]


class Counter:
    """Token counts of texts, as the library gives them for the file at path."""

    def __init__(self, path: str, most_paths: int = 500_000):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if [p["pattern"]["Regex"] for p in split] != [PATTERN] or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: its normalisation or split pattern is not the one compiled here")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"{path}: not the kind of byte-pair model compiled here")
        self.merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                self.kind[c] = LETTER if k == "L" else NUMBER
        self.kind[[ord(c) for c in SPACES]] = SPACE
        self.paths: dict[str, int] = {}
        self.most = most_paths
        rng = np.random.default_rng(8)
        self.mul = int(rng.integers(0, 2**62)) * 2 + 1
        self.pow = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            p = np.full(2 * n, self.mul, np.uint64)
            p[0] = 1
            self.pow = np.multiply.accumulate(p)
            i = np.full(2 * n, pow(self.mul, -1, 2**64), np.uint64)
            i[0] = 1
            self.inv = np.multiply.accumulate(i)

    def normal(self, text: str) -> tuple[str, int]:
        """Normalised text (white space may stay as it is: it is dropped anyway), and the number of special tokens in it."""
        specials = 0
        if self.special and "<|" in text:
            text, specials = self.special.subn(" ", text)
        if not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() >= 0xCC:
            return self.normalizer.normalize_str(text), specials  # U+0300 and beyond, where marks compose
        return text.lower(), specials

    def counts(self, texts: list[str]) -> list[int]:
        done = [self.normal(t) for t in texts]
        whole = " ".join(t for t, _ in done)
        specials = np.array([s for _, s in done], np.int64)
        if not whole:
            return specials.tolist()
        ends = np.cumsum([len(t) + 1 for t, _ in done])
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        for i in np.flatnonzero(code == 0x27).tolist():
            if whole[i + 1 : i + 2] and whole[i + 1] in SHORTS:
                kind[i] = SHORT
            elif whole[i + 1 : i + 3] in LONGS:
                kind[i] = LONG
        start = scan(kind)
        a = np.flatnonzero(start)
        if not len(a):
            return specials.tolist()
        # a piece ends before the next start or the next space
        stop = np.append(np.flatnonzero(start | (kind == SPACE)), len(code))
        z = stop[np.searchsorted(stop, a, side="right")]
        self._powers(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        np.cumsum(x * self.pow[: len(code)], out=sums[1:])
        h = (sums[z] - sums[a]) * self.inv[a] + (z - a).astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.paths) > self.most:
            self.paths.clear()
        known, counts = self.paths, []
        for piece in map(whole.__getitem__, map(slice, a[first].tolist(), z[first].tolist())):
            n = known.get(piece)
            if n is None:
                n = known[piece] = self.merges.count(piece.encode())
            counts.append(n)
        per = np.array(counts, np.int64)[back]
        for i in np.flatnonzero(_differ(code, a, z, a[first][back], z[first][back])).tolist():
            per[i] = self.merges.count(whole[a[i] : z[i]].encode())  # another piece of the same hash
        doc = np.searchsorted(ends, a, side="right")
        return (np.bincount(doc, weights=per, minlength=len(texts)).astype(np.int64) + specials).tolist()


def _differ(code: np.ndarray, a: np.ndarray, z: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the characters from a to z are others than those from b to y, pair by pair."""
    size = z - a
    out = size != y - b
    start = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(start, size)
    other = np.minimum(np.repeat(b, size) + inside, len(code) - 1)
    bad = code[np.repeat(a, size) + inside] != code[other]
    return out | np.logical_or.reduceat(bad, start)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, batch_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. Null and empty texts have no tokens; rows are independent, so repeated
    rows and empty tables need nothing special; extra columns are left out. ``path``: the tokenizer's file, which
    must be at this place on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for b in batches:
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            got: list[int] = []
            part: list[str] = []
            size = 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size >= batch_chars:
                    got += counter.counts(part)
                    part, size = [], 0
            if part:
                got += counter.counts(part)
            n = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(got, pa.int64()), pa.array([g > limit for g in got], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path(name))
