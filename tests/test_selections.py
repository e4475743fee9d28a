"""Filters, review answers, merges by method, files by source, damaged texts and the row pipeline on small rows."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ablation, row_pipeline, selections, upserts
from larkspur.sources import texts


def test_name_map_slice(spark):
    rows = [(i, " B3 " if i % 2 else "x", "Product", f"Raw {i}", f"CANON {i % 7}", "fii") for i in range(500)] + [(900, None, None, None, None, None)]
    names = spark.createDataFrame(rows, "id int, source string, field string, raw_value string, canonical_value string, asset_type string")
    assert [r["id"] for r in selections.name_map_slice(names, ["id"], source="b3", canonical="canon 3").collect()] == [i for i in range(500) if i % 2 and i % 7 == 3][:50]
    assert selections.name_map_slice(names, ["id"], limit=9999).count() == 200
    assert selections.name_map_slice(names, ["id"], raw="raw 499", asset_type="FII").count() == 1


def test_positions_and_history(spark):
    p = spark.createDataFrame([("a", "x", "usd", "ETF"), ("b", "x", None, "etf"), ("c", "y", "", None)], "id string, bucket string, currency string, type string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(selections.positions_of(p)) == ["a", "b", "c"] and ids(selections.positions_of(p, currency="brl")) == ["b", "c"]
    assert ids(selections.positions_of(p, "x", "USD", "etf")) == ["a"]
    h = spark.createDataFrame([("a", dt.date(2024, 1, 1), "orders", "xp", "C", None), ("b", dt.date(2024, 2, 1), "otc", None, "juros", "b3")], "asset string, date date, ledger string, broker string, operation string, source string")
    assert [r["asset"] for r in selections.history_of(h, search=" JUROS  b3 ").collect()] == ["b"]  # blanks of a missing broker count
    assert [r["asset"] for r in selections.history_of(h, ledger="orders", broker="xp", first="2024-01-01", last="2024-01-01").collect()] == ["a"]
    docs = spark.createDataFrame([("topics/a.md",), ("sources/b.md",), ("other",)], "path string")
    assert selections.of_types(docs, {"topic": "topics/", "source": "sources/"}, ["topic"]).count() == 1 and selections.of_types(docs, {}, None).count() == 3
    with pytest.raises(KeyError):
        selections.of_types(docs, {}, ["topic"])


def test_triplets(spark):
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "date string")
    got = {r["date"]: (r["balance_rows"], r["problems"], r["consistent"]) for r in selections.triplets(days("a", "a", "b"), days("a", "c", "d"), days("a", "d", "e")).collect()}
    assert got == {"a": (2, "", True), "b": (1, "interrupted_close", False), "c": (0, "stale_manifest", False), "d": (0, "", True), "e": (0, "missing_file", False)}


def test_files_by_source(spark, tmp_path):
    (tmp_path / "Extrato_1.csv").write_text("x\nData;Valor\n1\n")
    (tmp_path / "late.csv").write_text("1\n2\n3\n4\n5\nData;Valor\n")
    (tmp_path / "wise.csv").write_bytes("ção\nData;Valor".encode("latin-1"))
    (tmp_path / "other.csv").write_text("a\n")
    rules = spark.createDataFrame([(1, "wise", "exact", "wise.csv"), (2, "bank", "startswith", "Ext"), (3, "head", "header", "Data;Valor"), (4, "csv", "contains", "late"), (5, "never", "startswith", "csv")], "rank int, source string, how string, pattern string")
    files = texts.heads(spark, str(tmp_path))
    named = {r["name"]: r["source"] for r in selections.file_sources(files, rules).join(files, "file").collect()}
    assert named == {"Extrato_1.csv": "bank", "late.csv": "csv", "wise.csv": "wise", "other.csv": None}


def test_card_invoices(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Data;Estabelecimento;Portador;Valor;Parcela\n01/02/2024; Café ;X;R$ 1.234,50;-\n\n03/02/2024;Estorno;X;-10,00;-\n".encode())
    got = texts.read_card_invoices(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r["date"], r["description"], float(r["amount"])) for r in got] == [(dt.date(2024, 2, 1), "Café", -1234.5), (dt.date(2024, 2, 3), "Estorno", 10.0)]


ANSWER = "seq int, n int, kind string, decision string, value string, token string, target string"


def test_answers_work_in_order(spark):
    tx = spark.createDataFrame([(1, "c", "s", "low", ["a", "b"], dt.date(2024, 1, 1)), (2, "c", "s", "low", [], dt.date(2024, 1, 1)), (3, "c", "s", "low", ["a"], None)], "seq int, category string, supplier string, confidence string, tags array<string>, accrual date")
    said = [(1, 1, "tag", "merge", None, "a", "b"), (1, 2, "tag", "accept", None, "z", None), (1, 3, "tag", "reject", None, "b", None), (1, 5, "category", None, "new", None, None), (1, 4, "category", None, "old", None, None),
            (2, 1, "tag", "accept", None, "q", None), (2, 2, "tag", "accept", None, "q", None), (2, 3, "boundary", "move", "2024-03-01", None, None), (2, 4, "boundary", "keep", None, None, None), (2, 5, "supplier", None, "S", None, None)]
    got = {r["seq"]: tuple(r)[1:] for r in selections.resolved(tx, spark.createDataFrame(said, ANSWER)).collect()}
    assert got == {1: ("new", "s", "low", ["z"], dt.date(2024, 1, 1)), 2: ("c", "S", "exact", ["q"], dt.date(2024, 3, 1)), 3: ("c", "s", "low", ["a"], None)}
    with pytest.raises(Exception, match="unknown answer: tag maybe"):
        selections.resolved(tx, spark.createDataFrame([(1, 1, "tag", "maybe", None, "a", None)], ANSWER)).collect()


def test_merge_by_method_is_the_loop(spark):
    r = random.Random(2)
    methods = ["best", "good", "poor"]
    known = [(k, r.choice([1.0, 2.0]), r.choice(methods)) for k in range(0, 30, 2)]
    sent = [(r.randrange(30), r.choice([1.0, 2.0, 2.0]), r.choice([*methods, "odd"]), n) for n in range(200)]
    table, want = {k: [v, m] for k, v, m in known}, []
    rank = lambda m: methods.index(m) if m in methods else 9
    for k, v, m, n in sent:
        if k not in table:
            table[k] = [v, m]
            want.append((n, "inserted"))
        elif table[k][0] != v:
            want.append((n, "conflict"))
        elif rank(m) < rank(table[k][1]):
            table[k][1] = m
            want.append((n, "upgraded"))
        else:
            want.append((n, "skipped"))
    merged, told = upserts.method_merged(spark.createDataFrame(known, "k int, value double, method string"), spark.createDataFrame(sent, "k int, value double, method string, n int"), ["k"], methods)
    assert {x["k"]: [x["value"], x["method"]] for x in merged.collect()} == table
    assert sorted((x["n"], x["action"]) for x in told.collect()) == want


def test_ablation(spark):
    r = random.Random(5)
    words = ["plain", "12,5%", "3", "[[link.md]]", "however", "because", "é", "end.", "stop!", "\n", "\n| a | b |\n", "x"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 80)))) for i in range(40)] + [(100, ""), (101, None), (102, "no signal here"), (103, "7")]
    df = spark.createDataFrame(docs, "id int, text string")
    found = ablation.spans(df)
    want = set()
    for i, t in docs:
        for cls, (unit, pattern) in ablation.CLASSES.items():
            pattern = pattern.replace(r"\p{L}", "a-zA-Zé")
            for m in re.finditer(ablation.UNITS[unit] or pattern, t or ""):
                if not ablation.UNITS[unit] or re.search(pattern, m.group()):
                    want.add((i, cls, m.start(), m.end()))
    assert {tuple(x) for x in found.collect()} == want
    chosen = {(x["grade"], x["id"], x["cls"], x["start"], x["end"]) for x in ablation.graded(found, seed="s").collect()}
    by = lambda g, i: {x[2:] for x in chosen if x[:2] == (g, i)}
    total = {i: sum(w[0] == i for w in want) for i, _ in docs}
    for i, _ in docs:
        assert [len(by(g, i)) for g in (0.05, 0.25, 0.5)] == [math.ceil(round(g * total[i], 9)) for g in (0.05, 0.25, 0.5)]
        assert by(0.05, i) <= by(0.25, i) <= by(0.5, i)  # each grade is a subset of the next
    counts = {(x["id"], x["grade"], x["cls"]): (x["eligible"], x["deleted"]) for x in ablation.class_counts(found, ablation.graded(found, seed="s")).collect()}
    assert counts == {(i, g, c): (sum(w[:2] == (i, c) for w in want), sum(x[0] == c for x in by(g, i))) for i, c in {w[:2] for w in want} for g in (0.05, 0.25, 0.5)}
    cut = {(x["id"], x["grade"]): x["text"] for x in ablation.without(df, ablation.graded(found, seed="s")).collect()}
    for i, t in docs:
        for g in (0.05, 0.25, 0.5):
            out, prev, joined = "", 0, []
            for s, e in sorted(x[1:] for x in by(g, i)):
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(e, joined[-1][1])
                else:
                    joined.append([s, e])
            for s, e in joined:
                out += t[prev:s]
                prev = e + ((s == 0 or t[s - 1] == "\n") and t[e : e + 1] == "\n")
            assert cut.get((i, g)) == (out + t[prev:] if joined else None)


def test_the_order_of_the_row_pipeline(spark):
    """Rows that come out otherwise if any two steps change places."""
    d = lambda s: dt.date.fromisoformat(s)
    raw = spark.createDataFrame([
        (1, d("2024-01-05"), 100.0, "A", "BRL", "refund of MARKET plus", "extrato"),  # pairs, though it looks like a refund
        (2, d("2024-01-05"), -100.0, "B", "BRL", "MARKET plus", "extrato"),
        (3, d("2024-01-06"), 50.0, "A", "BRL", "MARKET plus", "extrato"),  # its override comes after tags and recurrence
        (4, d("2024-01-07"), -30.0, "A", "BRL", "GYM PARC 2/10", "fatura"),
        (5, d("2024-01-08"), 10.0, "A", "BRL", "refund x", "extrato"),
        (6, d("2024-01-09"), -1.0, "A", "BRL", "what", "extrato"),
    ], "seq int, date date, amount double, bank string, currency string, description string, source_type string")
    rules = row_pipeline.Rules(
        aliases=spark.createDataFrame([("market", 1, "the market", "food"), ("gym", 2, "gym", "sport")], "alias string, rank int, supplier string, default_category string"),
        vendors=spark.createDataFrame([], "vendor string, recurrence string, rank int"), invoices=spark.createDataFrame([("A", "2024-01", d("2024-02-10"))], "bank string, month string, payment_date date"),
        accruals=spark.createDataFrame([("2024-01-08", " refund x", "10.00", "2023-12-01")], "date string, description string, amount string, accrual string"),
        names=spark.createDataFrame([("The Market", "MKT")], "raw string, canonical string"),
        overrides=spark.createDataFrame([("2024-01-06", "MARKET plus", "50", "leisure", ""), ("2024-01-05", "MARKET plus", "-100.0", "", "own")], "date string, description string, amount string, category string, tags string"),
        refunds={"refund": "reimbursed"}, recurrences={"food": "monthly", "leisure": "yearly"}, refund_tags={"MKT": "back"}, projects=[(("MKT",), "food", "meal"), (("MKT",), "leisure", "fun")])
    got = {r["seq"]: r for r in row_pipeline.normalised(raw, rules).collect()}
    pick = lambda s, *c: tuple(got[s][x] for x in c)
    assert pick(1, "category", "confidence", "recurrence", "supplier", "tags") == ("intercontas", "exact", None, "MKT", "back")
    assert pick(2, "category", "tags", "manual", "conflict") == ("intercontas", "own", True, None)
    assert pick(3, "category", "recurrence", "supplier", "tags", "manual", "conflict") == ("leisure", "monthly", "MKT", "back|meal", True, "food")
    assert pick(4, "category", "recurrence", "cash", "accrual", "supplier") == ("sport", "installment", "2024-02-10", "2024-01-07", "Gym")
    assert pick(5, "category", "cash", "accrual", "supplier") == ("reimbursed", "2024-01-08", "2023-12-01", "")
    assert pick(6, "category", "confidence", "recurrence", "manual") == ("a_identificar", "low", "one_off", False)
    lost = raw.where("seq = 4").withColumn("bank", F.lit("Z"))
    with pytest.raises(Exception, match="no invoice of Z"):
        row_pipeline.normalised(lost, rules).collect()


def test_counts_of_graded_damage_need_no_order(spark):
    """finds were made twice and ranked twice to be counted."""
    from pyspark.sql import functions as F

    rows = [(i, c, 10 * k, 10 * k + 3) for i in range(12) for c, n in (("a", i % 4), ("b", i * 2), ("c", 5 - i % 5)) for k in range(n)]
    found = spark.createDataFrame(rows, "id long, cls string, start long, end long")
    got = ablation.graded_counts(found)
    want = ablation.class_counts(found, ablation.graded(found))
    shown = lambda d: sorted(map(tuple, d.select("id", F.col("grade").cast("double"), "cls", "eligible", "deleted").collect()))
    assert shown(got) == shown(want) and "Window" not in got._jdf.queryExecution().toString()
