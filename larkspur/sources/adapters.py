"""Domain tables as views over the given star schema, and the same views in SQL for the oracle.

Amounts are DECIMAL(18,2), so that sums don't depend on their order. Blank suppliers, refunds, several currencies and
cross-source twins are derived from keys, so every operator meets its odd cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

MONEY = "decimal(18,2)"


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Spend ledger: one row an order."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("seq"), F.to_date("o_orderdate").alias("date"),
        (F.col("o_totalprice").cast(MONEY) * F.when(done, 1).otherwise(-1)).cast(MONEY).alias("amount"),
        F.when(done & (k % 4 != 0), "receitas").when(k % 13 == 0, "intercontas").otherwise(F.lower("c_mktsegment")).alias("category"),
        F.col("o_orderpriority").alias("bank"),
        F.when(F.col("o_custkey") % 17 == 0, "").otherwise(F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string"))).alias("supplier"),
        F.concat_ws(" ", "o_orderpriority", "c_name", F.when(k % 9 == 0, "refund"), F.when(k % 8 == 0, F.format_string("PARC %d/%d", k % 12 + 1, k % 5 + 8))).alias("description"),
        F.when(k % 3 == 0, "fatura").otherwise("extrato").alias("source_type"),
        F.when(F.col("n_regionkey") == 0, "USD").when(F.col("n_regionkey") == 1, "EUR").otherwise("BRL").alias("currency"),
        F.array_compact(F.array(F.when(k % 2 == 0, "home"), F.when(k % 3 == 0, "travel"), F.when(k % 5 == 0, "work"))).alias("tags"),
    )


TX = """tx as (
  select o_orderkey as seq, cast(o_orderdate as date) as date,
    cast(cast(o_totalprice as decimal(18,2)) * case when o_orderstatus = 'F' then 1 else -1 end as decimal(18,2)) as amount,
    case when o_orderstatus = 'F' and o_orderkey % 4 <> 0 then 'receitas' when o_orderkey % 13 = 0 then 'intercontas' else lower(c_mktsegment) end as category,
    o_orderpriority as bank, case when o_custkey % 17 = 0 then '' else 'S' || (o_custkey % 50) end as supplier,
    o_orderpriority || ' ' || c_name || case when o_orderkey % 9 = 0 then ' refund' else '' end
      || case when o_orderkey % 8 = 0 then ' PARC ' || (o_orderkey % 12 + 1) || '/' || (o_orderkey % 5 + 8) else '' end as description,
    case when o_orderkey % 3 = 0 then 'fatura' else 'extrato' end as source_type,
    case n_regionkey when 0 then 'USD' when 1 then 'EUR' else 'BRL' end as currency,
    list_filter([case when o_orderkey % 2 = 0 then 'home' end, case when o_orderkey % 3 = 0 then 'travel' end, case when o_orderkey % 5 = 0 then 'work' end], lambda x: x is not null) as tags
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

#: Categories that are no spending.
EXCLUDED = ("receitas", "intercontas", "ignorar", "venda")
EXCLUDED_SQL = "('receitas', 'intercontas', 'ignorar', 'venda')"


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Order ledger of listed assets: one row a line item, with ``ord`` to order the rows of a ticker."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.to_date("l_shipdate").alias("date"), F.concat(F.lit("T"), (F.col("l_partkey") % 200).cast("string")).alias("ticker"),
        F.when(F.col("l_returnflag") == "R", "V").otherwise("C").alias("side"), F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("total"), F.col("l_tax").cast("double").alias("tax"), F.concat(F.lit("B"), (F.col("l_suppkey") % 5).cast("string")).alias("broker"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"),
    )


TRADES = """trades as (
  select cast(l_shipdate as date) as date, 'T' || (l_partkey % 200) as ticker, case when l_returnflag = 'R' then 'V' else 'C' end as side,
    cast(l_quantity as double) as quantity, cast(l_extendedprice as decimal(18,2)) as total, cast(l_tax as double) as tax, 'B' || (l_suppkey % 5) as broker,
    row_number() over (partition by l_partkey % 200 order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as seq
  from lineitem)"""


def income(spark: SparkSession, d: str) -> DataFrame:
    """Income ledger: dividends and the like."""
    li = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    kind = F.when(F.col("l_linenumber") <= 3, "dividendo").when(F.col("l_linenumber") <= 5, "jcp").otherwise("rendimento")
    return li.select(
        F.to_date("l_shipdate").alias("date"), F.concat(F.lit("T"), (F.col("l_partkey") % 200).cast("string")).alias("ticker"), kind.alias("type"),
        (F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast("decimal(6,2)")).cast("decimal(18,4)").alias("value"), F.col("l_quantity").cast("double").alias("quantity"),
    )


INCOME = """income as (
  select cast(l_shipdate as date) as date, 'T' || (l_partkey % 200) as ticker,
    case when l_linenumber <= 3 then 'dividendo' when l_linenumber <= 5 then 'jcp' else 'rendimento' end as type,
    cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(6,2)) as decimal(18,4)) as value, cast(l_quantity as double) as quantity
  from lineitem where l_linestatus = 'F')"""


def otc(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-income ledger, with twins of some rows reported by a second source."""
    li = table(spark, d, "lineitem")
    op = F.when(F.col("l_returnflag") == "A", "aplicacao").when(F.col("l_returnflag") == "R", "resgate").otherwise("juros")
    base = li.select(
        F.to_date("l_shipdate").alias("date"), op.alias("operation"), F.concat(F.lit("P"), (F.col("l_partkey") % 300).cast("string")).alias("product"),
        (F.col("l_extendedprice").cast(MONEY) * F.when(op == "aplicacao", -1).otherwise(1)).cast(MONEY).alias("amount"), F.col("l_orderkey").alias("key"),
        F.when(F.col("l_suppkey") % 3 == 0, "b3").when(F.col("l_suppkey") % 3 == 1, "broker").otherwise("manual").alias("source"),
    )
    return base.unionByName(base.where("key % 11 = 0 and source = 'broker'").withColumn("source", F.lit("b3")))


OTC = """otc0 as (
  select cast(l_shipdate as date) as date, case l_returnflag when 'A' then 'aplicacao' when 'R' then 'resgate' else 'juros' end as operation, 'P' || (l_partkey % 300) as product,
    cast(cast(l_extendedprice as decimal(18,2)) * case when l_returnflag = 'A' then -1 else 1 end as decimal(18,2)) as amount, l_orderkey as key,
    case l_suppkey % 3 when 0 then 'b3' when 1 then 'broker' else 'manual' end as source
  from lineitem),
otc as (select * from otc0 union all select date, operation, product, amount, key, 'b3' from otc0 where key % 11 = 0 and source = 'broker')"""


def fx_rates(spark: SparkSession, d: str) -> DataFrame:
    """A rate for some days of each currency, from orders."""
    tx = transactions(spark, d).where("currency <> 'BRL' and seq % 3 = 0")
    return tx.groupBy("currency", "date").agg((F.sum(F.abs("amount")) / 100000).cast("decimal(18,4)").alias("rate"))


FX = """fx as (select currency, date, cast(sum(abs(amount)) / 100000 as decimal(18,4)) as rate from tx where currency <> 'BRL' and seq % 3 = 0 group by all)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """A close for each ticker and day: the mean price per unit, whole cents (cut off, so that both engines agree)."""
    per = trades(spark, d).groupBy("ticker", "date").agg((F.sum("total") * 100).cast("long").alias("cents"), F.sum("quantity").cast("long").alias("units"))
    return per.select("ticker", "date", (F.expr("cents div units") / 100).alias("close"))


QUOTES = """quotes as (select ticker, date, (cast(sum(total) * 100 as bigint) // cast(sum(quantity) as bigint)) / 100 as close from trades group by all)"""
