"""External induced suffix sorting of one shard, with common-prefix lengths.

The text lies in a file (a memory map). Suffixes wait in monotone priority queues: the priority is the first symbol,
then the order of arrival, so a queue is one FIFO a symbol, which spills to disk beyond a bound. A queued tuple is
(position, common-prefix length with the tuple before it in the same FIFO). Scanning tuples in order induces the
suffix one symbol further left, whose common prefix is one more than the least on the way since the last tuple that
went to that FIFO. Substrings between local minima (LMS) are sorted by one induction, named, the shorter string of
names is sorted in turn, and a second induction carries its order and common prefixes to all suffixes.

Prefixes count up to CAP; suffixes alike that far may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

CAP = 255
TUPLE = np.dtype([("pos", np.uint32), ("lcp", np.uint8)])


class Fifo:
    """Tuples in order of arrival; those beyond ``hold`` wait on disk."""

    def __init__(self, folder: str, hold: int):
        self.folder, self.hold, self.parts, self.held = folder, hold, [], 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        t = np.empty(len(pos), TUPLE)
        t["pos"], t["lcp"] = pos, lcp
        if self.held + len(t) > self.hold:
            f = tempfile.NamedTemporaryFile(dir=self.folder, delete=False)
            with f:
                t.tofile(f)
            self.parts.append(f.name)
        else:
            self.parts.append(t)
            self.held += len(t)

    def drain(self):
        """Takes what is there now, in batches; what comes meanwhile waits for the next call."""
        parts, self.parts, self.held = self.parts, [], 0
        near: list[np.ndarray] = []
        for p in parts:
            if isinstance(p, str):
                if near:
                    yield np.concatenate(near)
                    near = []
                yield np.fromfile(p, TUPLE)
                os.unlink(p)
            else:
                near.append(p)
        if near:
            yield np.concatenate(near)

    def all(self) -> np.ndarray:
        got = list(self.drain())
        return np.concatenate(got) if got else np.empty(0, TUPLE)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = CAP) -> np.ndarray:
    """Common-prefix lengths of the suffixes at a and b, up to most. The text is followed by most symbols of padding."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 8
    while len(live):
        x = a[live] + out[live]
        y = b[live] + out[live]
        span = np.arange(step)
        same = text[x[:, None] + span] == text[y[:, None] + span]
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[live] += run
        live = live[(run == step) & (out[live] < most)]
        step = min(32, step * 2)
    return np.minimum(out, most)


class _Way:
    """Where induced tuples of one pass go: a FIFO a symbol, and for each symbol the least common prefix scanned since
    its last tuple (-1: none yet)."""

    def __init__(self, symbols: int, folder: str, hold: int):
        self.to = [Fifo(folder, hold) for _ in range(symbols)]
        self.least = np.full(symbols, -1, np.int16)

    def scan(self, pos: np.ndarray, lcp: np.ndarray, before: np.ndarray, go: np.ndarray) -> None:
        """pos, lcp: scanned in order (lcp with the one scanned before); before: the symbol left of each."""
        if not len(pos):
            return
        sel = np.flatnonzero(go)
        known = self.least >= 0
        if len(sel):
            order = np.argsort(before[sel], kind="stable")
            k = sel[order]
            c = before[k]
            first = np.empty(len(k), bool)
            first[0] = True
            np.not_equal(c[1:], c[:-1], out=first[1:])
            cut = np.zeros((len(k), 2), np.int64)
            cut[1:, 0] = k[:-1] + 1
            cut[first, 0] = 0
            cut[:, 1] = k + 1
            mins = np.minimum.reduceat(np.append(lcp, np.uint8(CAP)), cut.ravel())[::2].astype(np.int16)
            f = np.flatnonzero(first)
            had = self.least[c[f]]
            mins[f] = np.where(had < 0, -1, np.minimum(mins[f], had))
            value = np.minimum(mins + 1, CAP).astype(np.uint8)
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(CAP))
            last = np.append(f[1:], len(k)) - 1
        self.least[known] = np.minimum(self.least[known], int(lcp.min()))
        if len(sel):
            for a, z, s in zip(f.tolist(), (last + 1).tolist(), c[f].tolist()):
                self.to[s].push(pos[k[a:z]] - 1, value[a:z])
            self.least[c[f]] = tail[k[last] + 1]


def _induce(text: np.ndarray, n: int, is_s: np.ndarray, symbols: int, stars: np.ndarray, star_lcp: np.ndarray, folder: str, hold: int, keep: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """From sorted LMS suffixes to all: keep gets positions and common prefixes, from the largest bucket down."""
    batch = 1 << 17
    right = _Way(symbols, folder, hold)
    l_sorted = [Fifo(folder, hold) for _ in range(symbols)]
    head = text[stars]
    edge = np.searchsorted(head, np.arange(symbols + 1))

    def scan_left(pos: np.ndarray, lcp: np.ndarray, c: int) -> None:
        for i in range(0, len(pos), batch):
            p = pos[i : i + batch].astype(np.int64)
            b = text[p - 1]
            right.scan(p, lcp[i : i + batch], b, (p > 0) & (b >= c))

    for c in range(symbols):
        last = -1
        while right.to[c].parts:
            for t in right.to[c].drain():
                l_sorted[c].push(t["pos"], t["lcp"])
                last = int(t["pos"][-1])
                scan_left(t["pos"], t["lcp"], c)
        a, z = edge[c], edge[c + 1]
        if a < z:
            p, l = stars[a:z], star_lcp[a:z].copy()
            l[0] = _common(text, np.array([last]), p[:1])[0] if last >= 0 else 0
            scan_left(p, l, c)
    left = _Way(symbols, folder, hold)

    def scan_right(pos: np.ndarray, lcp: np.ndarray, c: int) -> None:
        for i in range(0, len(pos), batch):
            p = pos[i : i + batch].astype(np.int64)
            b = text[p - 1]
            left.scan(p, lcp[i : i + batch], b, (p > 0) & is_s[p - 1])

    for c in range(symbols - 1, -1, -1):
        s_pos, s_lcp = [], []
        while left.to[c].parts:
            for t in left.to[c].drain():
                s_pos.append(t["pos"])
                s_lcp.append(t["lcp"])
                scan_right(t["pos"], t["lcp"], c)
        ls = l_sorted[c].all()
        lp, ll = ls["pos"], ls["lcp"]
        sp = np.concatenate(s_pos) if s_pos else np.empty(0, np.uint32)
        sl = np.concatenate(s_lcp) if s_lcp else np.empty(0, np.uint8)
        seam = 0
        if len(lp) and len(sp):
            seam = int(_common(text, lp[-1:].astype(np.int64), sp[-1:].astype(np.int64))[0])
        if len(lp):
            back = np.append(np.uint8(seam), ll[:0:-1])  # with the one scanned before, which is the next larger
            scan_right(lp[::-1], back, c)
        if len(lp) or len(sp):
            up = np.append(np.uint8(seam), sl[:0:-1]) if len(sp) else sl
            keep(np.concatenate((lp, sp[::-1])).astype(np.int64), np.concatenate((ll, up)))
    keep(np.array([n - 1]), np.zeros(1, np.uint8))  # the end itself, which nothing induces


def _rank(names: np.ndarray, depth: int = 8) -> np.ndarray:
    """Order of the suffixes of the string of names, by doubling; alike over 2**depth names: in any order."""
    rank = names.astype(np.int64)
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    for d in range(depth):
        r = rank[order]
        if (r[1:] != r[:-1]).all():
            break
        nxt = np.full(n, -1, np.int64)
        nxt[: max(0, n - (1 << d))] = rank[1 << d :]
        key = rank * (n + 1) + nxt + 1
        # only ties move: their places are known
        tie = np.zeros(n, bool)
        tie[1:] = r[1:] == r[:-1]
        tie[:-1] |= tie[1:]
        at = np.flatnonzero(tie)
        some = order[at]
        order[at] = some[np.argsort(key[some], kind="stable")]
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        rank = new
    return order


def sort_suffixes(text: np.ndarray, n: int, symbols: int, folder: str, keep: Callable[[np.ndarray, np.ndarray], None], hold: int = 1 << 20) -> None:
    """keep gets (positions, common prefixes with the suffix before) bucket by bucket, largest symbol first; within a
    call in ascending order. text: n symbols below ``symbols``, then at least CAP + 32 of padding; the last of the n is
    0 and stands nowhere else."""
    t = text[:n]
    up = t[:-1] < t[1:]
    flat = t[:-1] == t[1:]
    is_s = np.empty(n, bool)
    is_s[-1] = True
    # type of a run of equal symbols is that of its last
    idx = np.where(flat, 0, np.arange(1, n))
    nxt = np.minimum.accumulate(np.where(idx > 0, idx, n)[::-1])[::-1]
    kind = np.append(up, True)
    is_s[:-1] = kind[np.minimum(nxt - 1, n - 1)]
    stars = np.flatnonzero(np.append(False, is_s[1:] & ~is_s[:-1]))
    if len(stars) > 1:
        # LMS substrings: bucket order in, sorted order out
        first = stars[np.argsort(text[stars], kind="stable")]
        seen = []
        star = np.zeros(n, bool)
        star[stars] = True
        _induce(text, n, is_s, symbols, first, np.zeros(len(first), np.uint8), folder, hold, lambda p, _: seen.append(p[star[p]]))
        by = np.concatenate(seen[::-1])
        place = np.empty(n, np.int64)
        place[stars] = np.arange(len(stars))
        ends = np.append(stars[1:], n - 1) + 1
        size = (ends - stars)[place[by]]
        a, b = by[:-1], by[1:]
        alike = size[:-1] == size[1:]
        maybe = np.flatnonzero(alike)
        got = np.zeros(len(alike), bool)
        for i in range(0, len(maybe), 1 << 16):
            m = maybe[i : i + (1 << 16)]
            got[m] = _common(text, a[m], b[m], CAP) >= np.minimum(size[:-1][m], CAP)
        names = np.empty(len(stars), np.int64)
        names[place[by]] = np.cumsum(np.append(False, ~got))
        stars = stars[_rank(names)]
    lcp = np.zeros(len(stars), np.uint8)
    for i in range(1, len(stars), 1 << 16):
        z = min(len(stars), i + (1 << 16))
        lcp[i:z] = _common(text, stars[i - 1 : z - 1], stars[i:z])
    _induce(text, n, is_s, symbols, stars, lcp, folder, hold, keep)
