"""Sources, sinks, incremental results and global order, on small files and tables."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import incremental, order, overlaps, routing
from larkspur.sources import sinks, texts

SMALL = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_statements_in_many_splits_and_encodings(spark, tmp_path, small_splits):
    r = random.Random(1)
    want = []
    for k, (encoding, end) in enumerate([("utf-8", "\n"), ("latin-1", "\r\n"), ("utf-8", "\r\n"), ("latin-1", "\n")]):
        rows = [(f"{k}-{i}", r.choice(["ação", "plain", "Data;x"][:2]), str(i)) for i in range(60)]
        head = ["Conta;1;2", "", "Anterior", "Data;O que;Valor"]
        body = [";".join(x) for x in rows]
        body.insert(30, "")
        body.insert(31, "Data;again;0")  # only the first such line is the header
        want += rows + [("Data", "again", "0")]
        (tmp_path / f"f{k}.txt").write_bytes(end.join(head + body).encode(encoding))
    (tmp_path / "none.txt").write_text("no header\nDatum;1;2\n")
    (tmp_path / "empty.txt").write_text("")
    all_ = texts.lines(spark, str(tmp_path))
    assert all_.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] > 5
    got = texts.read_statement(spark, str(tmp_path), "Data;", "id string, what string, v string")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def blocks_serially(text, header):
    out, name = [], None
    for line in text.split("\n"):
        if line.startswith(header):
            name = line[len(header) :].split()[0]
        elif name is not None and line.strip() and not line.startswith("Data,"):
            out.append((name, line.split(",")[0]))
    return out


@pytest.mark.parametrize("size", ["16", "64", "1000", "1000000"])
def test_blocks_at_any_split_size(spark, tmp_path, small_splits, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    r = random.Random(2)
    want = []
    for f in range(2):
        out = ["lost,1", "Data,Valor"]
        for b in range(9):
            out += [f"Fundo: F{f}{b} x"] * r.choice([1, 1, 2]) + ["Data,Valor"] + [f"r{f}{b}{i},{i}" for i in range(r.choice([0, 1, 30]))] + [""]
        text = "\n".join(out)
        (tmp_path / f"{f}.csv").write_text(text)
        want += blocks_serially(text, "Fundo: ")
    got = texts.read_blocks(spark, str(tmp_path), r"^Fundo:\s*(\S+)", "a string, b int", ",", skip="^Data,", keep_place=True)
    assert [(x["block"], x["a"]) for x in got.orderBy("file", "start", "at").collect()] == want


MONTHS = "id int, month string"


def months(spark, at):
    return {r["month"]: r["ids"] for r in sinks.read_months(spark, at, MONTHS).groupBy("month").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}


def test_closed_months_are_frozen(spark, tmp_path):
    at = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, MONTHS)
    assert months(spark, at) == {}
    assert sinks.write_months(df((1, "2024-01"), (2, "2024-02"), (3, "2024-03")), at, "month", "2024-03") == ["2024-01", "2024-02", "2024-03"]
    before = {"2024-01": [1], "2024-02": [2], "2024-03": [3]}
    with pytest.raises(sinks.Frozen, match="2024-02"):
        sinks.write_months(df((9, "2024-02"), (9, "2024-03")), at, "month", "2024-03")
    assert months(spark, at) == before  # nothing at all was written
    with pytest.raises(sinks.Rejected, match="positive"):
        sinks.write_months(df((-1, "2024-03")), at, "month", "2024-03", checks={"positive": lambda d: d.where("id < 0")})
    with pytest.raises(sinks.Rejected):
        sinks.write_months(df((1, None)), at, "month", "2024-03")
    failing = df((7, "2024-03")).withColumn("id", F.expr("assert_true(id < 0)").isNull().cast("int"))
    with pytest.raises(Exception, match="(?i)assert|is not true"):
        sinks.write_months(failing, at, "month", "2024-03")
    assert months(spark, at) == before
    sinks.write_months(df((4, "2024-03"), (5, "2023-12")), at, "month", "2024-03")  # a closed month that is not there yet
    sinks.write_months(df((6, "2024-01")), at, "month", "2024-03", force=True)
    assert months(spark, at) == {"2023-12": [5], "2024-01": [6], "2024-02": [2], "2024-03": [4]}
    assert not [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert sinks.write_months(df(), at, "month", "2024-03") == [] and len(months(spark, at)) == 4


def test_a_commit_that_is_cut_off_is_mended(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.write_months(spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], MONTHS), at, "month", "2024-01")
    (tmp_path / "t" / "month=2024-01").rename(tmp_path / "t" / ".old-x~month=2024-01")  # put aside, nothing in its place yet
    (tmp_path / "t" / ".staged-y").mkdir()
    sinks.recover(spark, at)
    assert months(spark, at) == {"2024-01": [1], "2024-02": [2]}
    assert not (tmp_path / "t" / ".staged-y").exists()


def links_of(pages, ids):
    edges = pages.select("id", F.explode("to").alias("key"))
    known = pages.select(F.col("name").alias("key")).distinct().withColumn("hit", F.lit(1))
    n = edges.join(known, "key", "left").groupBy("id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("n"))
    return ids.join(n, "id", "left").na.fill(0)


def test_incremental_equals_full_after_random_edits(spark, tmp_path):
    r = random.Random(4)
    pages = {i: (f"n{i % 15}", [f"n{r.randrange(20)}" for _ in range(r.randrange(4))]) for i in range(30)}
    keys = lambda p: p.select("id", F.col("name").alias("key"))
    needs = lambda p: p.select("id", F.explode("to").alias("key"))
    modes = []
    for step in range(6):
        df = spark.createDataFrame([(i, n, t) for i, (n, t) in pages.items()], "id int, name string, to array<string>")
        done = incremental.refresh(df, "id", str(tmp_path / "s"), links_of, keys, needs, version="1" if step < 4 else "2", full_every=3)
        full = links_of(df, df.select("id"))
        assert sorted(map(tuple, done.results.collect())) == sorted(map(tuple, full.collect()))
        modes.append(done.full)
        dirty = {x["id"] for x in done.dirty.collect()}
        if step == 1:
            assert dirty == want_dirty  # noqa: F821
        for _ in range(2):
            k = r.randrange(30)
            if k in pages and r.random() < 0.4:
                del pages[k]
            else:
                pages[k] = (f"n{r.randrange(20)}", [f"n{r.randrange(20)}" for _ in range(r.randrange(4))])
        if step == 0:
            old = {x["id"]: (x["name"], x["to"]) for x in df.collect()}
            moved = {i for i in old.keys() | pages.keys() if old.get(i) != pages.get(i)}
            names = {old[i][0] for i in moved if i in old} | {pages[i][0] for i in moved if i in pages}
            want_dirty = {i for i in moved if i in pages} | {i for i, (_, t) in pages.items() if set(t) & names}
    assert modes == ["first", None, "scheduled", None, "version", "scheduled"]
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("run-")]) == 2


def test_dense_index(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 1, 2, 5, 9]), r.randrange(50)) for _ in range(5000)]
    got = order.dense_index(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a"]).orderBy("index").collect()
    assert [x["index"] for x in got] == list(range(5000))
    assert [(x["a"], x["b"]) for x in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert order.dense_index(spark.createDataFrame([], "a int"), ["a"]).count() == 0
    seen = order.first_seen(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0)], "k string, at int"), "k", ["at"]).collect()
    assert {x["k"]: x["index"] for x in seen} == {None: 0, "b": 1, "a": 2}


def runs_one_by_one(items, deps):
    out = []
    for f in sorted({x[0] for x in items}):
        mine = sorted((x for x in items if x[0] == f), key=lambda x: x[1])
        runs = []
        for x in mine:
            if not runs or not x[4]:
                runs.append([])
            runs[-1].append(x)
        open_ = {x[2]: x for x in mine if not x[3]}
        for run in runs:
            ids = {x[2] for x in run}
            left = [(x, {n for g, i, n in deps if g == f and i == x[2] and n in open_ and n in ids}) for x in run]
            done, after = set(), []
            while left:
                ready = [x for x, s in left if s <= done]
                if not ready:
                    after += [(x, True) for x, _ in left]
                    break
                after += [(x, False) for x in ready]
                done |= {x[2] for x in ready}
                left = [(x, s) for x, s in left if x not in ready]
            out += [(f, x[2], run.index(x), k, cyc) for k, (x, cyc) in enumerate(after)]
    return sorted(out)


def test_sorted_runs(spark):
    r = random.Random(12)
    items = [(f, i * 10, f"{f}{i}", r.random() < 0.15, i > 0 and r.random() < 0.8) for f in "abc" for i in range(25)]
    deps = [(f, f"{f}{r.randrange(25)}", f"{f}{r.randrange(25)}") for f in "abc" for _ in range(22)] + [("a", "a1", "zz")]
    got = order.sorted_runs(spark.createDataFrame(items, "file string, at int, id string, done boolean, adjacent boolean"), spark.createDataFrame(deps, "file string, id string, needs string"))
    assert sorted((x["file"], x["id"], x["before"], x["after"], x["cyclic"]) for x in got.collect()) == runs_one_by_one(items, deps)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_set_overlaps(spark, least):
    r = random.Random(7)
    sets = lambda n: {i: {min(int(r.expovariate(0.1)), 60) for _ in range(r.randrange(12))} for i in range(n)}
    a, b = sets(60), sets(50)
    rows = lambda s: spark.createDataFrame([(i, m) for i, x in s.items() for m in x] * 2 + [(None, 1), (1, None)], "id int, member int")
    got = {(x["a"], x["b"]): x["n"] for x in overlaps.set_overlaps(rows(a), rows(b), least).collect()}
    assert got == {(i, j): len(x & y) for i, x in a.items() for j, y in b.items() if len(x & y) >= least}


def test_every_operation_is_routed(spark):
    """Each operation with each kind of asset, direction and shape, against plain conditions."""
    side = {"Compra": "C", "Venda": "V", "Cessão de Direitos": "V"}
    by_direction = ("Transferência - Liquidação", "COMPRA/VENDA", "COMPRA / VENDA", "COMPRA/VENDA DEFINITIVA/CESSAO")
    income = {"Leilão de Fração": "fracao", "Fração em Ativos": "fracao", "Dividendo": "dividendo", "Juros Sobre Capital Próprio": "jcp", "Rendimento": "rendimento", "Rendimento Líquido": "rendimento", "Bonificação em Dinheiro": "bonificacao_dinheiro"}
    corporate = {"Grupamento": "grupamento", "Desdobramento": "desdobramento", "Cisão": "cisao", "Bonificação em Ativos": "bonificacao", "Incorporação": "incorporacao", "Conversão de Ativos": "conversao", "Fusão": "fusao"}
    ignored = ["Atualização", "TRANSFERENCIA SEM FINANCEIRO", "TRANSFERÊNCIA SEM FINANCEIRO", "RETIRADA DE CUSTÓDIA", "Recibo de Subscrição", "Solicitação de Subscrição", "Direitos de Subscrição - Não Exercido", "Cessão de Direitos - Solicitada", "Direito de Subscrição", "Transferência", "Juros Sobre Capital Próprio - Transferido"]

    def want(op, rf, way, n, price, v, known):
        op = op.strip().rstrip("/")
        if op in ignored or op in ("AMORTIZACAO PROGRAMADA", "PAGAMENTO DE JUROS") and way == "Debito":
            return "ignored", "", None
        if op == "Empréstimo/Aluguel de Ativos":
            return "flagged", "manual", None
        if not known:
            return "unknown", "", None
        if op in side or op in by_direction:
            s = side.get(op, "C" if way == "Credito" else "V")
            return "otc" if rf else "orders", (("aplicacao" if s == "C" else "resgate") if rf else s), -abs(v) if s == "C" else abs(v)
        if op in ("Direitos de Subscrição - Exercido", "Sobras de Subscrição"):
            return "orders", "C", -abs(v)
        if op in income:
            return "income", income[op], v
        if op in ("PAGAMENTO DE JUROS", "Juros"):
            return ("otc", "juros", abs(v)) if rf else ("income", "juros", v)
        if op in ("AMORTIZAÇÃO", "AMORTIZACAO PROGRAMADA"):
            return "otc" if rf else "income", "amortizacao", v
        if op == "Restituição de Capital":
            return ("corporate", "restituicao_capital", None) if n > 0 and price == v == 0 else ("income", "restituicao_capital", v)
        if op in ("APLICAÇÃO", "RESGATE ANTECIPADO", "VENCIMENTO"):
            return "otc", {"APLICAÇÃO": "aplicacao", "VENCIMENTO": "vencimento"}.get(op, "resgate"), -abs(v) if op == "APLICAÇÃO" else abs(v)
        return ("corporate", corporate[op], None) if op in corporate else ("flagged", "", None)

    ops = [*side, *by_direction, *income, *corporate, *ignored, "Empréstimo/Aluguel de Ativos", "Direitos de Subscrição - Exercido", "Sobras de Subscrição", "PAGAMENTO DE JUROS", "Juros", "AMORTIZAÇÃO", "AMORTIZACAO PROGRAMADA", "Restituição de Capital", "APLICAÇÃO", "RESGATE ANTECIPADO/", "VENCIMENTO", "Nova operação", " Venda// "]
    rows = [(op, t, way, 2.0, p, v, known) for op in ops for t in ("acao", " CDB ", None) for way in ("Credito", "Debito", None) for p, v in ((0.0, 0.0), (5.0, -10.0), (5.0, 10.0)) for known in (True, False)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)] + [(-1, " ", "acao", "Credito", 1.0, 1.0, 1.0, True), (-2, None, None, None, None, None, None, None), (-3, "Compra", None, None, None, None, None, None)],
                               "key int, operation string, asset_type string, direction string, quantity double, price double, value double, known boolean")
    got = {x["key"]: (x["ledger"], x["kind"], x["value"]) for x in routing.routed(df).collect()}
    assert got.pop(-3) == ("orders", "C", 0.0)
    assert got == {k: want(op, t == " CDB ", way, n, p, v, known) for k, (op, t, way, n, p, v, known) in enumerate(rows)}


def test_two_rows_that_fit_alike_are_an_error():
    with pytest.raises(ValueError, match="two rows"):
        routing.decided("A | rf | | | x | y | +\nA | | Credito | | x | z | +")


def test_files_of_blocks_do_not_grow_with_the_rows(spark, sf, monkeypatch):
    """a task wrote all rows of an operation as one file."""
    from pyspark.sql import functions as F

    from larkspur.plans import store_queries
    from larkspur.plans.catalog import QUERIES
    from larkspur.sources import texts

    monkeypatch.setattr(store_queries, "LINES", 500)
    rows = spark.range(4000).select(F.lit("x").alias("by"), (F.col("id") + 10).alias("pos"), F.concat(F.lit("row "), "id").alias("line"))
    head = spark.range(1).select(F.lit("x").alias("by"), F.lit(0).cast("long").alias("pos"), F.lit("head").alias("line"))
    at = store_queries.written_lines(spark, rows, head, "by", "lines", "UTF-8")
    sizes = [r[1] for r in texts.lines(spark, at).groupBy("file").count().collect()]
    assert sum(sizes) == 4000 + len(sizes) and max(sizes) < 800
    firsts = texts.lines(spark, at).groupBy("file").agg(F.min_by("line", F.struct("block", "at")).alias("first")).select("first").distinct().collect()
    assert [r[0] for r in firsts] == ["head"]
    few = sorted(map(tuple, QUERIES["fund_blocks"](spark, sf).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, QUERIES["fund_blocks"](spark, sf).collect()))


def test_a_long_split_is_many_windows(spark, tmp_path, monkeypatch):
    """what rules a line is carried over pieces of a split, not held in one window of the whole split."""
    from larkspur.sources import texts

    (tmp_path / "a.txt").write_text("".join(f"Fundo: F{i}\n" + "".join(f"r{j},{j}\n" for j in range(i % 7)) for i in range(40)))
    got = lambda: sorted(map(tuple, texts.read_blocks(spark, str(tmp_path), r"^Fundo:\s*(\S+)", "a string, b int", ",").collect()))
    whole = got()
    monkeypatch.setattr(texts, "PIECE", 1)
    assert got() == whole == sorted((f"F{i}", f"r{j}", j) for i in range(40) for j in range(i % 7))


@pytest.mark.parametrize("small", [0, 4, 32])
def test_sets_meet_by_twos_of_members(spark, small, monkeypatch):
    """sets that share one member met in pairs, and nearly none of them were in the result."""
    r = random.Random(11)
    sets = lambda n: {i: {min(int(r.expovariate(0.1)), 60) for _ in range(r.randrange(12))} for i in range(n)}
    a, b = sets(60), sets(50)
    rows = lambda s: spark.createDataFrame([(i, m) for i, x in s.items() for m in x] * 2 + [(None, 1), (1, None)], "id int, member int")
    monkeypatch.setattr(overlaps, "SMALL", small)
    got = lambda df: sorted(map(tuple, df.select("a", "b", "n").collect()))
    made = overlaps.set_overlaps(rows(a), rows(b), 2)
    assert got(made) == sorted((i, j, len(x & y)) for i, x in a.items() for j, y in b.items() if len(x & y) >= 2)
    one = rows(a)
    assert got(overlaps.set_overlaps(one, one, 2).where("a < b")) == sorted((i, j, len(x & y)) for i, x in a.items() for j, y in a.items() if i < j and len(x & y) >= 2)
    if small == 32:
        assert "array_intersect" not in made._jdf.queryExecution().toString()


def test_records_are_numbered_in_many_tasks(spark, sf):
    """all income was sorted and numbered in one task."""
    from larkspur.plans.catalog import QUERIES

    assert "windowspecdefinition(date" not in QUERIES["income_first_record"](spark, sf)._jdf.queryExecution().toString()
