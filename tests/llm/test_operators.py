"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import pytest

from larkspur.llm import chat, decontaminate, lines, lm, mixing, near, pii, quality, repeats, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_lines int, copies int, items int, node int"


def words_of(t):
    return WORD.findall(t or "")


def corpus():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, passage = say(12).capitalize() + ".", say(60)
    docs = []
    for i in range(60):
        body = [say(r.randint(5, 40)) for _ in range(r.randint(1, 5))]
        if i % 5 == 0:
            body.insert(r.randint(0, len(body)), r.choice(["  ", ""]) + r.choice([shared, shared.upper()]) + " \t")
        if i % 7 == 0:
            body[0] += " " + passage + " " + say(3)
        docs.append((i, "\n".join(body)))
    base = docs[3][1] + "\n" + say(150)
    docs += [(60 + k, base if k < 3 else " ".join(w if j % (40 * k) else "edit" for j, w in enumerate(base.split(" ")))) for k in range(8)]
    docs += [(70, None), (71, ""), (72, " \n\n "), (73, "one two three"), (74, "one two three"), (75, "é" * 300 + "\n" + "é" * 300), (76, say(30000)), (5, docs[5][1]), (5, docs[5][1]), (6, "another text of number six"), (None, say(30)), (None, None)]
    return docs


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", None if i is None or i % 9 == 0 else f"s{i % 4}", len(t) if t is not None else None, "r", 1, 2, 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_repeats(docs, none, texts):
    keyed = {(k, i): (t or "").encode() for k, (i, t) in enumerate(texts)}
    want = []
    for (k, i), spans in repeats.brute_force(keyed).items():
        t, kept, at = keyed[k, i], [], 0
        for a, e in spans:
            kept.append(t[at:a])
            at = e
        kept.append(t[at:])
        want.append((i, len(t), sum(e - a for a, e in spans), len(spans), sha(b"".join(kept))))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, repeats.op1_suffix_dedup(docs).collect()), key=key) == sorted(want, key=key)
    assert sum(r[3] > 0 for r in want) > 15
    assert repeats.op1_suffix_dedup(none).count() == 0


def test_repeats_around_one_passage(spark, monkeypatch):
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, before = say(400), say(10)
    docs = {i: say(300) + (before if i % 3 == 0 else "") + passage + say(300) for i in range(120)}
    sort = repeats._repeats

    def bounded(batches):
        held = list(batches)
        most = Counter(h for b in held for h in b.column("h").to_pylist())
        assert not most or max(most.values()) <= 20, most.most_common(3)
        yield from sort(iter(held))

    monkeypatch.setattr(repeats, "MANY", 20)
    monkeypatch.setattr(repeats, "_repeats", bounded)
    got = repeats.repeats_removed(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()
    want = repeats.brute_force({i: t.encode() for i, t in docs.items()})
    assert {x["doc_id"]: [(s["a"], s["e"]) for s in x["spans"]] for x in got} == want and all(want.values())


def test_repeats_in_split_groups(docs, texts, monkeypatch):
    whole = sorted(map(str, repeats.op1_suffix_dedup(docs).collect()))
    monkeypatch.setattr(repeats, "MANY", 0)
    assert sorted(map(str, repeats.op1_suffix_dedup(docs).collect())) == whole


def test_segments_agree_for_equal_strings():
    r = random.Random(1)
    common = bytes(r.randrange(97, 100) for _ in range(450))
    a, b = (bytes(r.randrange(97, 123) for _ in range(n)) + common + b"\x00" * 70_000 for n in (10, 333))
    places = []
    for t in (a, b):
        s, m, o, h = repeats.segments(t)
        assert s[0] == 0 and (s[1:] == s[:-1] + m[:-1]).all() and s[-1] + m[-1] == len(t) - 199
        at = t.index(common)
        of = {i: (int(s[k] + o[k]) - i, int(h[k])) for k in range(len(s)) for i in range(s[k], s[k] + m[k]) if at <= i <= at + 250}
        places.append([of[at + i] for i in range(251)])
    assert places[0] == places[1]


def test_chat(spark):
    rows = [(1, 2, "assistant", "b <|im_end|>\n\\n \\"), (1, 1, "user", "a"), (2, 1, None, None), (3, 1, "tool\nx<|", "<|im_start|>assistant\nno"), (1, 2, "assistant", "b <|im_end|>\n\\n \\"), (None, 1, "user", "x")]
    got = {r["conv_id"]: r for r in chat.op2_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    a = "b <|im_end|>\n\\n \\"
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * len(a) and got[1]["loss_sha256"] == sha(2 * a)
    assert got[1]["turns_sha256"] == sha(f"user\na\nassistant\n{a}\nassistant\n{a}\n")
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0
    assert got[3]["turns_sha256"] == sha("tool\nx<|\n<|im_start|>assistant\nno\n") and got[3]["loss_chars"] == 0
    assert got[-1]["loss_sha256"] == sha(chat.PROBE)
    assert [r["conv_id"] for r in chat.op2_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-1]


def test_chat_layouts(spark):
    records = [
        '{"prompt": "p", "completion": "c"}', '{"instruction": "i", "input": "", "output": "o"}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
        '{"messages": [{"role": "user", "content": "u"}], "system": "s"}', '{"dialog": {"turns": [{"speaker": "bot", "text": "t"}]}}', '{"odd": 1}', "broken", None,
    ]
    got = chat.format_chats(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()
    turns = [chat.read_back(r["formatted"]) if r["formatted"] is not None else None for r in sorted(got, key=lambda r: r["conv_id"])]
    assert turns == [
        [("user", "p"), ("assistant", "c")], [("user", "i"), ("assistant", "o")], [("user", "h"), ("assistant", "g")], [("system", "s"), ("user", "u")], [("assistant", "t")], None, None, None,
    ]
    assert [r["layout"] is None for r in got].count(True) == 2
    back = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_chats(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string"))).collect()}
    assert back == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: None, 6: None, 7: None}


def test_chat_with_clashing_columns(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain.selectExpr("*", "9 as m", "'x' as record", "'y' as formatted", "3 as n_turns", "4 as messages")
    assert sorted(map(str, chat.op2_chat(more).collect())) == sorted(map(str, chat.op2_chat(plain).collect()))


def test_lines(docs, none, texts):
    strip = lambda s: s.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    having = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            having.setdefault(strip(line), set()).add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in having.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t in texts:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if strip(x) not in last or last[strip(x)] == i]
        want.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    assert last
    assert sorted(map(str, map(tuple, lines.op3_line_dedup(docs).collect()))) == sorted(map(str, want))
    out = lines.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.op3_line_dedup(none).count() == 0 and lines.line_dedup(none).columns == docs.columns


def test_lm(docs, none, texts):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    seq = [(i, (t or "").encode().lower().split() + [None]) for i, t in texts]
    c = Counter(x for i, s in seq if not held(i) for x in s)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(s), sum(c[x] > 0 for x in s), n, round(sum(log10((c[x] + 1) / (n + v + 1)) for x in s), 6)) for i, s in seq)
    got = lm.op4_lm_scoring(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm.op4_lm_scoring(none).count() == 0


def test_lm_score_is_a_plain_sum_over_paths(docs, texts, monkeypatch):
    """The score of every document, from the trained weights, by loops over tokens and nodes; the leaves' chances sum to 1."""
    from math import exp, log

    import numpy as np

    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: kept.setdefault("w", train(*a, **k)))
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in lm.op4_lm_scoring(docs).collect()}
    w, bias = kept["w"]
    bits = len(w).bit_length() - 1
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    seq = [(i, *(x.tolist() for x in lm.encoded((t or "").encode()))) for i, t in texts]
    c = Counter(x for i, h, _ in seq if not held(i) for x in h)
    leaf_of = {x: k for _, hs, ks in seq for x, k in zip(hs, ks)}
    n, v = sum(c.values()), len(c)
    in_leaf = Counter()
    for x, m in c.items():
        in_leaf[leaf_of[x]] += m + 1

    def chance(f, leaf):
        p = 0.0
        for d in range(lm.DEPTH):
            node, turn = (leaf >> (lm.DEPTH - d)) | 1 << d, leaf >> (lm.DEPTH - 1 - d) & 1
            z = float(bias[node])
            for x in f:
                x = (x ^ node * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF
                z += float(w[((x ^ x >> 15) * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - bits])
            p -= log(1 + exp(-z if turn else z))
        return p

    assert np.any(w)
    for i, hs, ks in sorted(seq, key=lambda x: len(x[1]))[-40:]:
        f = lm.features(np.array(hs, np.uint64)).T.tolist()
        want = sum(chance(a, k) / log(10) + log10((c[x] + 1) / (in_leaf[k] + 1)) for a, k, x in zip(f, ks, hs))
        base = round(sum(log10((c[x] + 1) / (n + v + 1)) for x in hs), 6)
        assert abs(got[i, len(hs), base] - want) < 1e-3 * max(1, len(hs) / 100)
    assert abs(sum(exp(chance(f[-1], k)) for k in range(lm.LEAVES)) - 1) < 1e-6


def test_lm_beats_the_base_on_held_out_text(spark):
    """Words whose class follows from the word before."""
    import numpy as np

    r = random.Random(2)
    text = lambda: " ".join(f"{r.randint(0, 40)}{'aa' if k % 2 else 'bb'}" for k in range(200))
    d = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string")
    held = [r for r in lm.op4_lm_scoring(d).collect() if r["held_out"]]
    assert np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in held]) > 0.15


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def test_near(docs, none, texts):
    rows = [(i, shingle_set(t)) for i, t in texts]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    want = sorted((str(i), len(s), str(i if i is None else root(i)), i is None or root(i) == i) for i, s in rows)
    got = near.op5_near_dedup(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == want
    assert sum(not w[3] for w in want) >= 4
    kept = near.near_dedup(docs, 80)
    assert kept.columns == docs.columns and near.op5_near_dedup(none).count() == 0


def test_near_chain_and_bad_pivot(spark):
    """Copies that reach one another only through others, and a pivot that is far from all."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in r.sample(range(300), 14 if k == 0 else r.randint(0, 6)):
            w[j] = f"x{k}_{j}"
        rows.append((k, " ".join(w)))
    for k in range(12):  # a chain: each shifts a little further
        rows.append((100 + k, " ".join(f"c{j}" for j in range(20 * k, 20 * k + 320))))
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] > comp[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    got = {r["doc_id"]: r["component_id"] for r in near.op5_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp and len(set(comp.values())) > 2


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in comp:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == comp


def base_quality(t):
    w = words_of(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        dup += bool(words_of(line)) and line in seen
        seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w))


def test_quality(spark, docs, none, texts, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = [(200, "a b c d e f g h " * 5 + "# $ |"), (201, "x\nx\n\n\ny\nx"), (202, "é ü\x0bß")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = quality.op6_quality(more, labels.limit(0)).collect()
    want = sorted((str(i), *base_quality(t)) for i, t in [*texts, *odd])
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # no labels: the base alone
    assert quality.op6_quality(none, labels).count() == 0
    assert quality.quality_filter(docs, labels.limit(0)).columns == docs.columns


def test_quality_on_held_out_labels(spark, sf):
    """Fitted on the smallest table, judged on another."""
    read = lambda d, t: spark.read.parquet(f"{d}/{t}.parquet")
    big = sf.replace("0.001", "0.01")
    model = quality.fit(read(big, "documents").where("doc_id % 2 = 0"), read(big, "labels"))
    got = quality.judged(read(big, "documents").where("doc_id % 2 = 1"), model).select("row.doc_id", "kept", "base_failed").join(read(big, "labels"), "doc_id").where("not base_failed").collect()
    right = [r["kept"] == (r["quality"] == 1) for r in got]
    assert sum(right) >= 0.97 * len(right) and all(r["kept"] for r in got if r["quality"] == 1)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 6):
        s, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(s[i, y[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        assert tuple(quality.viterbi(s, t)) == best


def test_verdicts_against_all_labellings(spark, sf):
    """The share of content on the best of all labellings, for texts of up to eight lines."""
    import itertools

    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    w, step = model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    short = docs.where("size(split(text, '\n')) <= 8")
    got = {r["doc_id"]: r for r in quality.judged(short, model).select("row.doc_id", "content_share", "base_failed", "kept").collect()}
    checked = 0
    for r in short.collect():
        f, chars, _ = quality.lines_of((r["text"] or "").encode())
        if not chars.sum():
            continue
        u = f @ w
        best = max(itertools.product((0, 1), repeat=len(u)), key=lambda y: sum(u[i, y[i]] for i in range(len(u))) + sum(step[a, b] for a, b in zip(y, y[1:])))
        share = float(chars[np.array(best) == 1].sum() / chars.sum())
        assert got[r["doc_id"]]["content_share"] == pytest.approx(share) and got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and share >= 0.5)
        checked += 1
    assert checked > 20


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else kind == "email" or 9 <= len(d) <= 15


def test_pii_base(spark, none):
    r = random.Random(6)
    bits = ["a@b.c", "_d@e.f-g.h", "@", ".", "1.2.3.4", "256.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+1234567890123456", " ", "é", "\x01", "\x02", "x", "7", "-", "+", "\n", "(", "user@host"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(400)] + [(400, None), (401, "a" * 50_000), (402, "1" * 50_000), (403, "a." * 20_000 + "@" + "b." * 20_000), (7, "a@b.c"), (7, "a@b.c")]
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as kind", "3 as start", "4 as f", "5 as m", "'x' as pattern", "7 as score")
    got = pii.op7_pii(clash).collect()

    def expect(t):
        found = {k: [m.span() for m in re.finditer(p, t or "") if valid(k, m[0])] for k, p in FORMS.items()}
        return (*(len(v) for v in found.values()), sha(",".join(f"{k}:{a}:{z}" for k, v in found.items() for a, z in v)))

    want = sorted((i, *expect(t)) for i, t in rows)
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    assert all(len({w[k] for w in want}) > 1 for k in (1, 2, 3, 4)) and len({w[1:5] for w in want}) > 10
    assert all(r["has_pii"] == (r["spans"] != "") for r in got)
    assert pii.op7_pii(none).count() == 0


def test_pii_patterns_find_near_misses(spark):
    rows = [(i, f"please write to user{i}@mail{i % 7}.example.com today") for i in range(20)] + [(50, "please write to someone@intranet today"), (51, "the odd thing root@box stays")]
    got = {r["doc_id"]: r["spans"] for r in pii.op7_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "email:16:32" and got[51] == "" and got[3].startswith("email:16:")


def test_pii_recall_on_planted_words(spark):
    """Half of the identifiers have their kind's form; of the others each stands once, in a context of its kind."""
    r = random.Random(4)
    card = lambda: next(c for x in [f"4{r.randrange(10**13, 10**14)}"] for k in range(100) if valid("card", c := f"{x}{k}"))
    say = {"email": "mail goes to {} at once", "ip": "the host sits at {} for now", "card": "charged my card {} last week", "phone": "do call me on {} after nine"}
    whole = {"email": lambda: f"u{r.randrange(10**6)}@ex{r.randrange(99)}.org", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "card": card, "phone": lambda: f"+1 {r.randrange(200, 999)} 555 {r.randrange(1000, 9999)}"}
    odd = {"email": lambda: f"u{r.randrange(10**6)}(at)corp", "ip": lambda: f"fe80::{r.randrange(1000, 9999)}:1", "card": lambda: f"4{r.randrange(10**14, 10**15 - 1)}", "phone": lambda: f"{r.randrange(200, 999)}-555-{r.randrange(1000, 9999)}"}
    rows, planted = [], {}
    for k in say:
        for i in range(40):
            rows.append((len(rows), f"well, {say[k].format(whole[k]())} or so"))
        for i in range(20):
            x = odd[k]()
            t = f"well, {say[k].format(x)} or so"
            if not any(valid(kind, m[0]) for kind, p in FORMS.items() for m in re.finditer(p, t)):
                planted[len(rows)] = f"{k}:{t.index(x)}:{t.index(x) + len(x)}"
            rows.append((len(rows), t))
    clean = range(len(rows), len(rows) + 40)
    rows += [(i, f"chapter {i} has part no. {r.randrange(10**7)} in its {i}th row") for i in clean]
    got = {r["doc_id"]: r["spans"] for r in pii.op7_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(got[i] == s for i, s in planted.items())
    assert len(planted) > 60 and hit >= 0.9 * len(planted), (hit, len(planted))
    assert not any(got[i] for i in clean)


def test_tokens(docs, none, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = "it's WE'LL <|endoftext|> ΟΔΟΣ é ١٢ '' 'sx <|startoftext|>"
    assert tokens.Counter(public_tokenizers.path("word_bpe_49k.json")).counts([more, "", more]) == [len(t.encode(more, add_special_tokens=False)), 0, len(t.encode(more, add_special_tokens=False))]
    got = tokens.op8_token_counts(docs).collect()
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 2048) for i, x in texts)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokens.op8_token_counts(none).count() == 0


def test_merges_as_a_transducer():
    """Random words of letters, of whole and of broken tokens against the library; forgetting states changes nothing."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter, r = Tokenizer.from_file(path), tokens.Counter(path), random.Random(3)
    names = [k.removesuffix("</w>") for k in sorted(library.get_vocab()) if k.isascii() and k.removesuffix("</w>").isalpha()]
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 12))) for _ in range(1500)]
    words += [(r.choice(names) + r.choice(names)[: r.randint(0, 4)]).lower() for _ in range(3000)] + ["a" * 700, "é" * 40, "日本語" * 9]
    want = [len(library.encode(w, add_special_tokens=False)) for w in words]
    assert counter.counts(words) == want
    small = tokens.Merges([tuple(m) for m in __import__("json").load(open(path))["model"]["merges"]], most=50)
    plain = [(w, n) for w, n in zip(words, want) if w.isalpha() and w.isascii()]
    assert [small.count(w.encode()) for w, _ in plain] == [n for _, n in plain]


def test_pieces_of_one_hash_are_told_apart():
    import numpy as np

    code = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2], np.uint32)
    a, z = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    assert tokens._differ(code, a, z, np.zeros(4, int), np.full(4, 3)).tolist() == [False, False, True, True]


def test_piece_scan_in_small_chunks():
    import numpy as np

    rng = np.random.default_rng(0)
    c = rng.integers(0, 6, 500).astype(np.uint8)
    assert (tokens.scan(c, 7) == tokens.scan(c, 1024)).all()


def test_mixing(docs, none, texts):
    got = mixing.op9_mixing(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(words_of(t))) for i, t in texts)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), [0, 0])
        by[r["source_size"], r["target"]][0] += r["taken"]
        by[r["source_size"], r["target"]][1] += r["size"]
    assert len(by) == 5 and all(w == size for (size, _), (_, w) in by.items())
    # one source holds a document of 30,000 words, which whole copies can only take or leave
    assert all(abs(t - target) < (0.05 * target + 30 if size < 30_000 else 30_000) for (size, target), (t, _) in by.items())
    assert sorted(map(str, mixing.op9_mixing(docs).collect())) == sorted(map(str, got))
    assert mixing.op9_mixing(none).count() == 0
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "copies_"] and out.count() == docs.count()


def test_mixing_dual_by_bisection(spark):
    """Rates of an independent dual, solved by bisection on plain lists."""
    import math

    r = random.Random(7)
    rows = [(i, "w " * min(400, int(math.exp(r.gauss(3, 1.2)))), "abc"[i % 7 % 3]) for i in range(3000)]
    got = mixing.op9_mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = {r["doc_id"]: r["size"] for r in got}, {r["doc_id"]: r["taken"] for r in got}
    for s in "abc":
        mine = [sizes[i] for i, _, x in rows if x == s and sizes[i]]
        target = next(r["target"] for r in got if rows[r["doc_id"]][2] == s)
        mean = sum(n * n for n in mine) / sum(mine)
        rate = lambda n, lam: min(3.0, math.exp(min(50, lam * n / mean)))
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * rate(n, mid) for n in mine) < target else (low, mid)
        by = Counter()
        for i, _, x in rows:
            if x == s and sizes[i]:
                by[sizes[i]] += taken[i] / sizes[i]
        for n, copies in by.items():  # a cell is off by its rounding and by what larger cells carried over
            assert abs(copies - mine.count(n) * rate(n, low)) <= 0.5 + 400 / n, (s, n)
        assert abs(sum(taken[i] for i, _, x in rows if x == s) - target) <= 2


def test_water_fill():
    assert mixing.water_fill({"a": 100, "b": 10, "c": 100, None: 0}) == pytest.approx({"a": 150.0, "b": 30.0, "c": 30.0, None: 0.0})


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark, docs, none):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    items = [(i, say(r.randint(12, 40))) for i in range(12)] + [(12, None), (13, "..."), (14, "Short one")]
    rows = []
    for k in range(60):
        i, t = items[k % 12]
        s = list(t)
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(s))
            s[at : at + r.randint(0, 1)] = r.choice([[], ["z"]])
        s = "".join(s)
        rows.append((k, f"{say(20)} {s.upper() if k % 2 else s} {say(10)}"))
    rows += [(60, None), (61, ""), (62, "a short; ONE!"), (62, "a short; ONE!"), (63, "shortone"), (64, "ashort one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.op10_decontamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    norm = lambda t: (n := decontaminate.normal(t)) and (n if len(n) >= 20 else f" {n} ")
    whole = lambda t: f" {decontaminate.normal(t)} "
    want = sorted((d, sorted(i for i, t in items if t and norm(t) and edit_distance_inside(norm(t), whole(x or "")) <= int(len(decontaminate.normal(t)) * 0.05))) for d, x in rows)
    assert sorted((r["doc_id"], r["items"]) for r in got) == want
    assert 20 < sum(bool(i) for _, i in want) < 62
    blocks = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=300).collect()
    assert sorted((r["row"]["doc_id"], r["items"]) for r in blocks) == want
    named = bench.selectExpr("concat('item-', item_id) as item_id", "text")
    some = decontaminate.op10_decontamination(spark.createDataFrame(rows, "doc_id long, text string"), named).collect()
    assert sorted((r["doc_id"], len(r["items"])) for r in some) == [(d, len(i)) for d, i in want]
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.op10_decontamination(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_texts_are_scored_together_as_alone():
    """op4's CPU: a call of the model for each short text."""
    import numpy as np

    r = np.random.default_rng(3)
    w, bias = r.normal(size=1 << 20).astype(np.float32), r.normal(size=256).astype(np.float32)
    texts = [b"", b"a b c", b"x " * 40_000, *(b"w%d of %d" % (i, i % 7) for i in range(300))]
    hs, ks = zip(*map(lm.encoded, texts))
    alone = [lm.log_p(w, bias, lm.features(h), k).sum() / np.log(10) for h, k in zip(hs, ks)]
    assert np.allclose(lm._log10s(w, bias, list(hs), list(ks)), alone, rtol=1e-9) and lm._log10s(w, bias, [], []) == []


def test_texts_are_split_together_as_alone_in_little_memory():
    """op4's memory: a chunk's tokens were copied over and over when its distinct ones were found; and its CPU: a call for each short text."""
    import tracemalloc

    import numpy as np

    texts = [b"", b" \n ", b"A b\xc3\xa9 C", b"", b"x", b"\n", *(b"w%d of\t%d\n" % (i, i % 7) for i in range(50)), b""]
    h, k, n = lm.encoded_all(texts)
    alone = [lm.encoded(t) for t in texts]
    assert n.tolist() == [len(x) for x, _ in alone] == [len(t.split()) + 1 for t in texts]
    assert np.array_equal(h, np.concatenate([x for x, _ in alone])) and np.array_equal(k, np.concatenate([x for _, x in alone]))
    assert np.array_equal(lm.features(h, np.cumsum(n) - n), np.concatenate([lm.features(x) for x, _ in alone], axis=1))
    held = np.arange(len(texts)) % 3 == 0
    u, leaf, c, back = lm._local(h, k, n, held)
    assert np.array_equal(u[back], h) and np.array_equal(leaf[back], k)
    assert dict(zip(u.tolist(), c.tolist())) == {x: sum(y == x for t, out in zip(alone, held) if not out for y in t[0].tolist()) for x in set(h.tolist())}
    assert [len(x) for x in lm._local(h[:0], k[:0], n[:0], held[:0])] == [0] * 4
    h = np.random.default_rng(2).integers(0, 1000, 1_000_000).astype(np.uint64)
    tracemalloc.start()
    lm._local(h, np.zeros(len(h), np.uint8), np.array([len(h)]), np.array([False]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 * len(h)  # bytes
