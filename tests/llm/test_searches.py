"""Operators 11 to 13 against brute force: orders one by one, all pairs of vectors, every period of every text."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from larkspur.llm import audit, periodic, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, n int, h string, bits int, good int, runs string"
LABELS = "doc_id long, quality int, toxic int, text string"


def hexed(text):
    return sha256(text.encode()).hexdigest()


# --- operator 11


def audited(docs, labels):
    """Every order, document by document."""
    least = {}
    below = lambda i: (i is not None, i or 0)
    for i, t, _ in docs:
        t = t or ""
        if t not in least or below(i) < below(least[t]):
            least[t] = i
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if below(least[t]) < below(i) else set()
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                gone, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                failing = [r for r in rows if r[0] == part and x in r[1]]
                shapley[part, x] += len(gone)
                out[part, order, step] = [len(stay), len(gone), len(failing) - len(gone), sum(len(r[1]) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    r = random.Random(3)
    many = [" ".join(r.choice(["plain", "Word", "SHOUT", "x#", "é", "𝄞", str(k)]) if r.random() < 0.3 else f"w{r.randrange(500)}" for k in range(r.choice([5, 99, 100, 130]))) for _ in range(40)]
    docs = [(i, r.choice(many), r.choice(["en", "fr", None, ""])) for i in range(90)]
    docs += [(90, None, "en"), (91, "", "fr"), (92, " \n ", None), (None, many[0], "en"), (None, None, "fr"), (5, docs[5][1], docs[5][2]), (5, docs[5][1], "xx"), (5, "other", "en"), (94, "long " * 30000, "en"), (95, " ".join(map(str, range(200))), "en"), (96, " ".join(map(str, range(200))), "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (900, 1, 1)]
    d = spark.createDataFrame([(*x, "p", 1, "h", 2, 3, "r") for x in docs], DOCS).repartition(3)
    lab = spark.createDataFrame([(*x, "t") for x in labels], LABELS)
    got = audit.op11_filter_audit(d, lab).collect()
    want = audited(docs, labels)
    assert len(got) == len(want) == 120 * 5 * len({x[2] or "" for x in docs})
    assert {(g["part"], g["filter_order"], g["step"]): tuple(g[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for g in got} == want
    assert audit.op11_filter_audit(d.limit(0), lab).count() == 0
    assert audit.op11_filter_audit(d, lab.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_audit_takes_any_letters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 0), ("p", 2, 2, 2, 1), ("p", 3, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit.audit(masks, "xy").collect()}
    assert got == {("xy", 1): (7, 7, 0, 3, 10), ("xy", 2): (5, 2, 4, 2, 8), ("yx", 1): (8, 6, 0, 2, 8), ("yx", 2): (5, 3, 4, 3, 10)}


def test_intervals_cover_every_order_once():
    orders = ["".join(p) for p in permutations("ABCD")]
    held = defaultdict(list)
    for mask, step, low, high in audit.intervals("ABCD"):
        for rank in range(low, high):
            held[mask, rank].append(step)
    for mask in range(1, 16):
        for rank, order in enumerate(orders):
            assert held[mask, rank] == [next(s for s, x in enumerate(order, 1) if mask >> "ABCD".index(x) & 1)]


# --- operator 12


def searched(rows, k=5):
    whole = [(i, [min(max(floor(256 * float(x)), -(1 << 63)), (1 << 63) - 1024) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is not None and i % 50 == 0:
            hits = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, u)))), j is None, j or 0, j) for b, (j, u) in enumerate(whole) if a != b), key=lambda h: h[:3])[:k]
            out += [(i, n, h[3], -h[0]) for n, h in enumerate(hits, 1)]
    return Counter(out)


@pytest.mark.parametrize("blocks,wave", [(1, 16384), (5, 2)])
def test_top_k(spark, monkeypatch, blocks, wave):
    monkeypatch.setattr(topk, "LEAST", 1)
    monkeypatch.setattr(topk, "BLOCKS", blocks)
    monkeypatch.setattr(topk, "WAVE", wave)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-1, 1), 0.5]) for _ in range(8)]) for i in range(260)]
    rows += [(i, [0.25] * 8) for i in range(300, 340)]  # copies, so ties
    rows += [(400, None), (450, [1.0, None]), (500, [nan] * 8), (550, [inf] * 8), (600, []), (650, [0.5, 1.0]), (700, [-0.0] * 12), (None, [0.5] * 8), (None, None)]
    rows += [rows[50], rows[50], (100, [1.0] * 8), (-50, [1.0] * 8), (301, [0.25] * 8)]
    df = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], "vec_id long, embedding array<double>, n int, block string").repartition(3)
    assert Counter(map(tuple, topk.op12_top_k(df).collect())) == searched(rows)


def test_top_k_of_few_and_of_huge(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0])], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(0, []), (50, [])]):
        assert Counter(map(tuple, topk.op12_top_k(spark.createDataFrame(rows, kind)).collect())) == searched(rows)
    huge = [(0, [3e38, 2.0]), (1, [3e38, -1.0]), (2, [-3e38, 1.0]), (3, [1.0, 1.0]), (50, [1e7, 1e7]), (51, [1e7, 1e6])]
    assert Counter(map(tuple, topk.op12_top_k(spark.createDataFrame(huge, kind)).collect())) == searched([(i, np.float32(v).astype(float).tolist()) for i, v in huge])


# --- operator 13


def runs_by_period(ids):
    """Every period, every stretch."""
    n, out = len(ids), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs(spark):
    r = random.Random(1)
    for _ in range(1500):
        n, v = r.randint(0, 120), r.choice([1, 2, 2, 3, 5, 20])
        ids = [r.randrange(v) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 8:
                a, p = r.randrange(n), r.randint(1, n // 5 or 1)
                for i in range(a + p, min(n, a + p * r.randint(2, 9))):
                    ids[i] = ids[i - p]
        if r.random() < 0.1:
            ids = ((ids[:7] * 10)[: r.randint(6, 70)] + [99]) * r.randint(1, 6)
        assert periodic.runs_of(np.array(ids, dtype=np.int64)) == runs_by_period(ids), ids


def test_grammar_derives_its_text():
    r = random.Random(2)
    for _ in range(200):
        ids = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randint(6, 80))]
        rules, rest = periodic.re_pair(ids, [(0, len(ids))])
        for half, words, starts in rules:
            assert 0 < half < words and len({tuple(ids[s : s + words]) for s in starts}) == 1
        ends = rest[0]
        assert ends[0] == 0 and ends[-1] == len(ids) and ends == sorted(set(ends))
        pieces = [tuple(ids[a:b]) for a, b in zip(ends, ends[1:])]
        pairs = [(a, b) for a, b in zip(pieces, pieces[1:]) if a != b]
        assert len(set(pairs)) == len(pairs)  # no pair is left twice


def described(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_period(words)
    dropped = {i for a, b, q in found for i in range(a + q, b)}
    best = min(((a - b, a, q) for a, b, q in found), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    return (doc_id, len(found), *top, hexed("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), hexed(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_runs(spark):
    r = random.Random(8)
    say = lambda n, v=60: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    docs = [(i, say(r.randint(1, 90), r.choice([2, 60, 500]))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " \t\x0b\n"), (1003, "a b " * 300), (1004, "é é " * 9), (1005, "a " * 5), (1006, "a\n" * 6), (1007, "x a b c a b c a b c a b c a b y"), (1008, say(700, 4000) + " z" * 9), (None, "a " * 7), (None, None), (3, docs[3][1]), (3, docs[3][1]), (-7, say(50))]
    df = spark.createDataFrame([(i, t, "l", "p", 1, "h", 2, 3, "runs") for i, t in docs], DOCS).repartition(3)
    out = periodic.op13_periodic_runs(df)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, out.collect())) == Counter(described(*d) for d in docs)
    assert sum(d[1] > 0 for d in (described(*d) for d in docs)) > 30
    assert periodic.op13_periodic_runs(df.limit(0)).count() == 0
    plain = {r["doc_id"]: r["collapsed"] for r in periodic.periodic_runs(df.where("doc_id >= 1003")).collect()}
    assert plain[1003] == "a b" and plain[1006] == "a" and plain[1005] == "a a a a a"
