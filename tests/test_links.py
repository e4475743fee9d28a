"""Mentions by names, broken and resolved targets and pruned logs on small rows, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import links, overlaps


def test_name_mentions(spark):
    texts = [(1, "Deep Learning, deep-learning; deep/learning!"), (2, "deeplearning deep learnings"), (3, "the the the"), (4, None), (5, ""), (6, "`deep learning` [[deep learning|x]] so\n# Deep Learning"), (7, "x" * 50000 + " deep  learning"), (7, "x" * 50000 + " deep  learning")]
    names = [(10, "deep-learning"), (3, "the"), (11, "The The"), (12, "--"), (13, None), (14, "deep")]
    docs = spark.createDataFrame(texts, "id int, text string")
    got = links.name_mentions(docs.distinct(), spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(7, 14)], "src int, dst int"), spark.createDataFrame([("deep", 2)], "term string, target int"))
    want = set()
    for i, t in set(texts):
        prose = {6: "  x so\nDeep Learning"}.get(i, t or "").lower()
        for j, name in names:
            words = re.findall("[a-z0-9]+", (name or "").lower())
            n = len(re.findall("(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])", prose)) if words else 0
            if n and i != j and (i, j) != (7, 14):
                want.add((i, j, " ".join(words), n, len(words) == 1))
    assert {tuple(r) for r in got.collect()} == want and (1, 10, "deep learning", 3, False) in want and (3, 11, "the the", 1, False) in want
    assert links.name_mentions(docs.limit(0), docs.limit(0).withColumnRenamed("text", "name"), spark.createDataFrame([], "src int, dst int"), spark.createDataFrame([], "term string, target int")).count() == 0
    rejected = spark.createDataFrame([("deep learning", 10)], "term string, target int")
    assert links.name_mentions(docs, spark.createDataFrame(names[:1], "id int, name string"), spark.createDataFrame([], "src int, dst int"), rejected).count() == 0


def test_broken_targets(spark):
    files = spark.createDataFrame([("ação-café.md",), ("Two Words.md",), ("two-words.md",), ("here.md",), (None,)], "name string")
    asked = [(1, "Acao Cafe.md"), (1, "Acao Cafe.md"), (2, " dir/here.md "), (3, "TWO WORDS.md"), (4, "gone.md"), (5, "image.png"), (6, None), (7, "日本.md")]
    got = {(r["src"], r["target"]): (r["bucket"], r["suggestion"], r["candidates"]) for r in links.broken_targets(spark.createDataFrame(asked, "src int, target string"), files).collect()}
    assert got == {(1, "Acao Cafe.md"): ("A", "ação-café.md", ["ação-café.md"]), (3, "TWO WORDS.md"): ("needs-judgment", None, ["Two Words.md", "two-words.md"]),
                   (4, "gone.md"): ("needs-judgment", None, []), (7, "日本.md"): ("needs-judgment", None, [])}


def test_resolved_targets(spark):
    items = spark.createDataFrame([("raw/a/x.md", "a", "x.md"), ("raw/b/x.md", "b", "x.md"), ("raw/b/y.pdf", "b", "y.pdf"), ("raw/b/y.md", "b", "y.md"), ("raw/c/z.v2.md", "c", "z.v2.md"), ("raw/c/z.v2.md", "c", "z.v2.md")], "path string, origin string, filename string")
    want = {"raw/a/x.md": 1, "a/x.md": 1, "a\\x.md": 1, "/a/x/": 1, "x.md": 2, "x": 2, "b/y.pdf": 2, "y.md": 2, "z.v2": 0, "c/z.v2.pdf": 1, "c/none": 0, "a": 0, "": 0}
    rows = spark.createDataFrame([(t,) for t in [*want, "x", None]], "target string")
    got = {r["target"]: r for r in links.resolved_targets(rows, items, ("", "raw/", "raw/")).collect()}
    assert {k: r["n"] for k, r in got.items()} == want
    assert all(r["verdict"] == ("unresolved", "unique")[r["n"]] if r["n"] < 2 else r["verdict"] == "ambiguous" and r["path"] is None for r in got.values())
    assert got["a\\x.md"]["path"] == "raw/a/x.md" and got["c/z.v2.pdf"]["path"] == "raw/c/z.v2.md"


def test_log_plan(spark):
    entry = lambda when, kind, brief, *more: "\n".join([f"## [{when}] {kind} | {brief}", *more, ""])
    blocks = [
        ("spent", entry("2024-01-01", "candidate-topic", "Deep Learning", "text")), ("aging", entry("2024-01-01", "candidate-topic", "Gone", "- trigger: x")), ("pending", entry("2024-01-09", "candidate-topic", "Gone")),
        ("undated", entry("some day", "candidate-topic", "Gone")), ("undated", entry("2024-13-01", "candidate-topic", "Gone")), ("spent", entry("x", "candidate-mention", "Gone", "- name: A Thesis")), ("pending", entry("x", "proposed-new-thesis", "deep learning")),
        ("spent", entry("x", "proposed-new-thesis", "a-thesis")), ("awaiting", entry("2024-01-01", "speculative-thesis-update", "a-thesis")), ("retired", entry("2024-01-01", "lint", "")), ("unknown", entry("2024-01-01", "other", "deep learning")),
        ("heading", "## Notes (review)\n### below\nname: x\n"), ("pending", entry("x", "candidate-mention", "")),
    ]
    text = "before\n# log\n" + "".join(b for _, b in blocks)
    docs = spark.createDataFrame([(1, text), (2, "no block"), (3, None), (4, "")], "id int, text string")
    pages = spark.createDataFrame([("deep-learning.md", "topic"), ("deep-learning.md", "topic"), ("a-thesis.md", "thesis"), (None, None)], "name string, kind string")
    plan = links.log_plan(docs, pages, "2024-01-10")
    got = plan.orderBy("pos").collect()
    assert [r["action"] for r in got] == [k for k, _ in blocks] and [r["pos"] for r in got] == list(range(1, len(blocks) + 1))
    assert (got[0]["page"], got[1]["age"], got[5]["page"]) == ("deep-learning.md", 9, "a-thesis.md")
    out = {r["id"]: r["text"] for r in links.pruned(docs, plan).collect()}
    assert out == {1: "before\n# log\n" + "".join(b for k, b in blocks if k not in ("spent", "retired")), 2: "no block", 3: None, 4: ""}


def test_mentions_move_no_texts(spark):
    """Names meet a text's runs of words: no text is joined or searched for each name; a name that ends as it begins is counted apart."""
    docs = spark.createDataFrame([(1, "La la la la: red fox, red fox"), (2, "fox")], "id int, text string")
    none = spark.createDataFrame([], "src int, dst int"), spark.createDataFrame([], "term string, target int")
    plain = links.name_mentions(docs, spark.createDataFrame([(9, "red fox"), (8, "Fox")], "id int, name string"), *none)
    assert sorted(tuple(r) for r in plain.collect()) == [(1, 8, "fox", 2, True), (1, 9, "red fox", 2, False), (2, 8, "fox", 1, True)]
    assert "Contains(" not in plain._jdf.queryExecution().optimizedPlan().toString()
    same = links.name_mentions(docs, spark.createDataFrame([(7, "la la")], "id int, name string"), *none)
    assert [tuple(r) for r in same.collect()] == [(1, 7, "la la", 2, False)]


def test_rarest_common_members(spark):
    from larkspur.operators import overlaps
    from larkspur.operators.containment import naming

    left, right = [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (2, None), (3, "q")], [(7, "x"), (7, "y"), (7, "y"), (8, "z"), (8, "q")]
    df = lambda rows: spark.createDataFrame(rows, "id long, member string")
    ranks = spark.createDataFrame([("x", 5), ("y", 2), ("z", 2), ("q", 9)], "member string, df long")
    got = lambda least: sorted((r["a"], r["b"], r["n"], *r["rarest"]) for r in overlaps.set_overlaps(df(left), df(right), least, ranks).collect())
    assert got(1) == [(1, 7, 2, 2, "y"), (1, 8, 1, 2, "z"), (2, 7, 1, 5, "x"), (3, 8, 1, 9, "q")]
    assert got(2) == [(1, 7, 2, 2, "y")]
    texts = spark.createDataFrame([(4, "a b"), (5, "a b"), (6, None), (7, "c")], "id long, text string")
    names = spark.createDataFrame([("b",), ("a b",), ("",), ("d",)], "pattern string")
    assert sorted(map(tuple, naming(texts, names, "id").collect())) == [(4, "a b"), (4, "b"), (5, "a b"), (5, "b")]


def test_texts_are_shuffled_by_key_alone(spark):
    """Texts that are searched for names are cut into runs once, into a table, and are no key of a shuffle."""
    from larkspur.operators.containment import naming

    texts = spark.createDataFrame([(i, f"text {i % 7} of a fox") for i in range(50)], "id long, text string")
    got = naming(texts, spark.createDataFrame([("fox",), ("text 3",), ("none",)], "pattern string"), "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(text" not in plan and "regexp_extract_all(text" not in plan
    assert sorted(map(tuple, got.collect())) == sorted([(i, "fox") for i in range(50)] + [(i, "text 3") for i in range(3, 50, 7)])


def test_a_queued_source_meets_one_page_a_signal(spark):
    from larkspur.operators import notes

    page = spark.range(300).selectExpr("id", "concat('x.org/a/', id) as url", "'10.1/a' as doi", "'T' as title")
    queue = spark.createDataFrame([(1, "x.org/a", "10.1/a", "t"), (2, "o", "10.1/A", "t"), (3, "o", "", " t"), (4, "o", "", ""), (5, "x.org/a/7/b", "", "")], "id long, url string, doi string, title string")
    got = notes.source_matches(queue, page)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "url"), (2, 0, "doi"), (3, 0, "title"), (5, 7, "url")]
    seen, nodes = 0, [got._jdf.queryExecution().optimizedPlan()]
    while nodes:  # each join has one row a key on its right: an aggregate
        n = nodes.pop()
        if n.nodeName() == "Join":
            assert n.right().nodeName() == "Aggregate" or n.left().nodeName() == "Aggregate"
            seen += 1
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    assert seen == 4


def test_blocks_send_only_their_best(spark):
    from larkspur.operators import corpus

    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(400)] + [(900, None), (901, [1.0, None, 2.0])]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    q = v.where("id in (0, 5, 901)").withColumnRenamed("id", "qid")
    got = {}
    for r in corpus.cosine_top_k(v, q, k=4, blocks=3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))

    def score(a, b):
        if a is None or None in a or None in b:
            return None
        dot = lambda x, y: sum(s * t for s, t in zip(x, y))
        return round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 6)

    for qid, w in ((0, rows[0][1]), (5, rows[5][1]), (901, rows[401][1])):
        ranked = sorted(((score(x, w), i) for i, x in rows), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))[:4]
        assert sorted(got[qid]) == [(k + 1, i, s) for k, (s, i) in enumerate(ranked)]
    assert "FlatMapCoGroups" in corpus.cosine_top_k(v, q)._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_are_dealt_without_a_join(spark, monkeypatch):
    from larkspur.sources import tables

    monkeypatch.setattr(tables, "HOT", 4)
    rows = spark.createDataFrame([(bytearray(b"a"), i) for i in range(40)] + [(bytearray(b"b"), 1), (None, 2)], "h binary, v long")
    many, few, on = tables.deal(rows, spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),)], "h binary"), ["h"], ["v"])
    assert few.count() == 65 and {r["_slot"] for r in many.where("h is null or h = X'62'").collect()} == {0}
    assert many.where("h = X'61'").select("_slot").distinct().count() > 10
    assert many.join(few, on).count() == 41
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 100])
def test_only_words_that_are_names_are_shuffled(spark, few, monkeypatch):
    """all words of all texts were shuffled and counted before they met the names."""
    from larkspur.operators import corpus

    monkeypatch.setattr(corpus, "FEW", few)
    words = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "z"), (3, "y"), (3, None), (None, "x")], "id long, w string")
    names = spark.createDataFrame([(1, "x"), (7, "x"), (7, "y"), (8, None)], "target long, w string")
    got = corpus.counted_names(words, names)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 1), (1, 7, 2), (2, 1, 1), (2, 7, 1), (3, 7, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan and "hashpartitioning(w" not in plan) or not few


def test_names_on_most_rows_do_not_meet_row_by_row(spark):
    """a category's rows met the tags' rows in one task before they were made distinct."""
    from larkspur.operators import categorise

    rows = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = categorise.category_tag_collisions(rows(["A", "a", "b", None]), rows(["a", "A", "c", None]))
    assert sorted(map(tuple, got.collect()), key=str) == [("a",), (None,)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate", plan.index("LeftSemi"))


@pytest.mark.parametrize("least,meetings", [(1, 2_000_000), (1, 7), (2, 7)])
def test_pairs_of_sources_and_topics_are_not_shuffled(spark, monkeypatch, least, meetings):
    """Whatever the number of blocks, the pairs are those of a loop over all, and no shuffle is by source or topic."""
    monkeypatch.setattr(overlaps, "MEETINGS", meetings, raising=False)
    monkeypatch.setattr(overlaps, "LARGE", 3 * meetings, raising=False)
    r = random.Random(8)
    some = lambda n: {(i, r.choice("abcdefgh")) for i in range(n) for _ in range(r.randrange(4))}
    links, key, related = some(12), some(9), some(5)
    sources = [(i, r.choice([None, "On Foxes", "x"]), r.choice([None, "red fox", "a dog, a fox"])) for i in range(12)]
    topics = [(i, r.choice(["", "fox", "Dog", "a"])) for i in range(9)]
    cited, rejected = [(0, 1), (2, 3)], [(4, 4)]
    df = lambda rows, kind: spark.createDataFrame(sorted(rows, key=str), kind)
    linked = lambda rows: df([*rows, *rows, (None, "a"), (1, None)], "id int, member string")
    pair = "source int, topic int"
    made = overlaps.backfill(df(sources, "id int, title string, body string"), linked(links), df(topics, "id int, slug string"), linked(key), linked(related), F.broadcast(df(cited, pair)), F.broadcast(df(rejected, pair)), least, 3)
    assert "hashpartitioning(source" not in made._jdf.queryExecution().executedPlan().toString()
    n = lambda m: len({i for i, x in links if x == m})
    want = {}
    for i, title, body in sources:
        for t, slug in topics:
            mine = {m for j, m in links if j == i}
            both, meta = mine & {m for j, m in key if j == t}, mine & {m for j, m in related if j == t}
            told = [name for name, has in (("slug-match", slug and slug.lower() in "\n".join(x for x in (title, body) if x).lower()), ("key-concept-overlap", len(both) >= least), ("related-overlap", len(meta) >= least)) if has]
            if told and (i, t) not in cited + rejected:
                rank = min((n(m), m) for m in both) if len(both) >= least else (None, None)
                want[i, t] = (",".join(told), len(both) if rank[0] else None, rank[1], rank[0], (rank[0] or 0) >= 3)
    assert {tuple(x)[:2]: tuple(x)[2:] for x in made.select("source", "topic", "signals", "overlap", "match", "rarest", "weak").collect()} == want


def test_texts_are_cut_into_runs_once(spark):
    """Names that end as they begin share the pass, and the shuffle, of all others; their mentions don't overlap."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["so", "and", "x", "-", "So,"]) for _ in range(r.randrange(60)))) for i in range(30)]
    names = [(100, "so and so"), (101, "so so"), (102, "x"), (103, "and x"), (104, "so x so x so"), (105, "SO-SO")]
    got = links.name_mentions(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([], "src int, dst int"), spark.createDataFrame([("x", 102)], "term string, target int"))
    want = set()
    for i, text in docs:
        for j, name in names:
            term, text_ = (re.findall("[a-z]+", t.lower()) for t in (name, text))
            n = len(re.findall("".join(f" {w} " for w in term), "".join(f" {w} " for w in text_)))
            if n and j != 102:
                want.add((i, j, " ".join(term), n, len(term) == 1))
    assert {tuple(x) for x in got.collect()} == want and {j for _, j, *_ in want} == {100, 101, 103, 104, 105}
    ran = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("Generate posexplode") == 1


def test_a_block_of_sources_is_taken_in_runs(monkeypatch):
    """Few meetings at once, and all of them: the same pairs as in one run, nulls and sources without a topic included."""
    import pyarrow as pa

    r = random.Random(4)
    left = {(r.choice([None, *range(9)]), r.randrange(3), r.choice("abcd")) for _ in range(60)} | {(3, 1, "z")}
    right = {(r.randrange(7), r.randrange(3), r.choice("abcd")) for _ in range(40)}
    rank = {"a": 5, "b": 2, "c": 2, "d": 9}
    rows = [{"source": i, "topic": None, "k": k, "member": m, "df": None, "asked": False} for i, k, m in left] + [{"source": None, "topic": t, "k": k, "member": m, "df": rank[m] if k == 1 else None, "asked": True} for t, k, m in right]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema({"source": pa.int64(), "topic": pa.int64(), "k": pa.int32(), "member": pa.string(), "df": pa.int64(), "asked": pa.bool_()}))

    def told(n):
        monkeypatch.setattr(overlaps, "RUN", n)
        made = list(overlaps._told(iter([batch.slice(0, 50), batch.slice(50)])))
        return len(made), sorted((tuple(x.values()) for b in made for x in b.to_pylist()), key=str)

    (few, want), (many, got) = told(10**9), told(4)
    assert few == 1 and many > 5 and got == want
    pairs = {}
    for i, k, m in left:
        for t, q, x in right:
            if (k, m) == (q, x):
                pairs.setdefault((i, t), []).append((k, rank[m], m))
    of = lambda met, k: [x[1:] for x in met if x[0] == k]
    assert want == sorted(((*p, bool(of(met, 0)), len(of(met, 1)), len(of(met, 2)), *min(of(met, 1), default=(None, None))) for p, met in pairs.items()), key=str)
    assert list(overlaps._told(iter([batch.filter(batch["asked"])]))) == []
