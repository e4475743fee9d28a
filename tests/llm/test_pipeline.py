import corpus_pipeline
from larkspur.llm.common import written as written_
from larkspur.llm.decontaminate import Matcher
from larkspur.llm.near import shingles


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, []
    from larkspur.llm.common import written

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), f"test-{k}")
        rows.append(docs.collect())
        assert docs.columns == (columns if k < 4 else [*columns, "copies"]), name
    ids = [{r["doc_id"] for r in x} for x in rows]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] and len(ids[1]) == len(ids[0])
    # no near duplicates at 0.8 stay, and no document goes without a partner
    sets = {r["doc_id"]: set(shingles(r["text"].encode()).tolist()) for r in rows[1] if r["text"]}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a])
    left = sorted(ids[2] & set(sets))
    assert not [(a, b) for i, a in enumerate(left) for b in left[:i] if alike(a, b)]
    assert all(any(b != a and alike(a, b) for b in sets) for a in ids[1] - ids[2])
    m = Matcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 0.05)
    assert {r["doc_id"] for r in rows[2] if m.find(r["text"])} == ids[2] - ids[3]
    assert {r["doc_id"]: r["text"] for r in rows[3]} == {r["doc_id"]: r["text"] for r in rows[4]}


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, repeated rows, ties and clashing extra columns pass all stages."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    good = [r["text"] for r in corpus_pipeline.quality_stage(spark, base, sf).orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    shared = "This very line of more than forty characters stands in many documents."
    rows = [(i, f"{t}\n{shared}", "en", f"s{i % 2}", 1, 0.5, "x") for i, t in enumerate(good)]
    rows += [rows[0], rows[0], (900, rows[1][1], None, None, None, None, None), (901, None, None, None, None, None, None), (902, "", "en", "s1", 0, 0.0, "y")]
    rows += [(None, good[2] + " and one more end to it", None, None, None, None, None), (903, f"{good[3]}\n{item}", "en", "s0", 5, 0.1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies double, row string").repartition(3)
    columns, out = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written_(stage(spark, docs, sf), f"odd-{k}")
        assert docs.columns == (columns if k < 4 else [*columns, "copies_"]), name
        out.append(docs.collect())
    kept, lined, near, clean, mixed = out
    assert {901, 902}.isdisjoint({r["doc_id"] for r in kept}) and sum(r["doc_id"] == 0 for r in kept) == 3
    holding = [r["doc_id"] for r in lined if shared in r["text"]]
    assert set(holding) == {900} and len(lined) == len(kept)
    assert 900 not in {r["doc_id"] for r in near} and sum(r["doc_id"] == 0 for r in near) == 3 and any(r["doc_id"] is None for r in near)
    assert {r["doc_id"] for r in near} - {r["doc_id"] for r in clean} == {903} & {r["doc_id"] for r in near}
    assert len(mixed) == len(clean) and all(0 <= r["copies_"] <= 3 for r in mixed)
    assert [r["text"] for r in mixed if r["doc_id"] is None] == [good[2] + " and one more end to it"]
