"""The whole row pipeline as one query, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import row_pipeline
from ..sources.adapters import TX, transactions
from .invest_queries import PAIRED
from .registry import query
from .rule_queries import VALUES

ALIASES = [("2-high customer", 1, "ACME high", "housing"), ("refund", 2, "the refunder", None), ("high", 3, "acme", "transport"), ("low", 4, "loW end-shop", None), ("5-low Customer#00000000", 5, "x y", "housing"), ("back", 6, "acme", "transport")]


def raw_rows(s, d):
    """Orders as raw rows, and for every seventh a row of the opposite amount at another bank."""
    t = transactions(s, d).select("seq", "date", "amount", "bank", "currency", "description", "source_type")
    return t.unionByName(t.where("seq % 7 = 0").select((F.col("seq") + 1000000000).alias("seq"), "date", (-F.col("amount")).cast("decimal(18,2)").alias("amount"), F.lit("OTHER").alias("bank"), "currency", F.concat("description", F.lit(" back")).alias("description"), F.lit("extrato").alias("source_type")))


def rules(s, d):
    raw = raw_rows(s, d)
    text = lambda c: F.col(c).cast("string")
    some = lambda step: raw.where(f"seq % {step} = 0").select("seq", text("date").alias("date"), F.concat(F.lit(" "), "description").alias("description"), F.concat(text("amount"), F.lit("0")).alias("amount"), F.col("date").alias("day"))
    return row_pipeline.Rules(
        aliases=s.createDataFrame(ALIASES, "alias string, rank int, supplier string, default_category string"),
        vendors=s.createDataFrame([("parc 3", "weekly", 0), ("URGENT", "yearly", 1), ("parc 3", "weekly", 0)], "vendor string, recurrence string, rank int"),
        invoices=raw.where("source_type = 'fatura'").groupBy("bank", F.date_format("date", "yyyy-MM").alias("month")).agg(F.date_add(F.last_day(F.max("date")), F.length("bank")).alias("payment_date")),
        accruals=some(40).select("date", "description", "amount", F.date_sub("day", 31).alias("accrual")),
        names=s.createDataFrame([("ACME HIGH", "Acme HIGH!")], "raw string, canonical string"),
        overrides=some(27).select("date", "description", "amount", F.when(F.col("seq") % 2 == 0, "manual").otherwise(" ").alias("category"), F.when(F.col("seq") % 3 == 0, "b|a").alias("tags")),
        self_patterns=("Customer#00000001",), refunds={"refund": "reimbursed"}, values=VALUES, recurrences={"housing": "monthly", "reimbursed": "irregular"},
        refund_tags={"Acme": "refund", "Acme HIGH!": "loud"}, projects=[(("Low End-Shop", "Acme HIGH!"), "rent", "project"), (("Acme HIGH!",), "housing", "home")])


NAMES = {"ACME high": "Acme HIGH!", "the refunder": "The Refunder", "acme": "Acme", "loW end-shop": "Low End-Shop", "x y": "X Y"}
SQL_ALIASES = ", ".join(f"('{a}', {r}, '{NAMES[x]}', {c and repr(c) or 'null'})" for a, r, x, c in ALIASES)
query("row_pipeline", """select seq, coalesce(nullif(oc, ''), category) as category, confidence, recurrence, cash, accrual, supplier, coalesce(nullif(ot, ''), tags) as tags, oc is not null as manual, case when oc <> '' and oc <> category then category end as conflict from (
select *, array_to_string(list_sort(list_filter([case when amount > 0 and supplier = 'Acme' then 'refund' end, case when amount > 0 and supplier = 'Acme HIGH!' then 'loud' end, case when category = 'rent' and supplier in ('Low End-Shop', 'Acme HIGH!') then 'project' end, case when category = 'housing' and supplier = 'Acme HIGH!' then 'home' end], lambda x: x is not null)), '|') as tags,
case when category = 'intercontas' then null when contains(upper(description), 'PARC 3') then 'weekly' when contains(upper(description), 'URGENT') then 'yearly' when n >= 1 and n <= m and m <= 48 and m >= 2 then 'installment' when category = 'housing' then 'monthly' when category = 'reimbursed' then 'irregular' else 'one_off' end as recurrence,
cast(case when source_type = 'fatura' then last_day(date) + cast(length(bank) as int) else date end as varchar) as cash, cast(coalesce(a, date) as varchar) as accrual from (
select t.*, coalesce(s.supplier, '') as supplier, case when p.seq is not null then 'intercontas' when own and not refund then 'intercontas' when refund then 'reimbursed' when v is not null then v else coalesce(default_category, 'a_identificar') end as category,
case when p.seq is not null then 'exact' when own or refund or v is not null then 'high' when default_category is not null then 'medium' else 'low' end as confidence,
try_cast(regexp_extract(t.description, 'PARC (\\d+)/(\\d+)', 1) as int) as n, try_cast(regexp_extract(t.description, 'PARC (\\d+)/(\\d+)', 2) as int) as m, a.a, o.oc, o.ot from (
select *, contains(lower(description), 'customer#00000001') as own, amount > 0 and contains(lower(description), 'refund') as refund,
case when contains(lower(description), '1-urgent') and abs(abs(cast(amount as double)) - 250000) <= 12500 then 'salary' when contains(lower(description), '5-low') and abs(abs(cast(amount as double)) - 100000) <= 5000 then 'rent' end as v,
(select alias from aliases where contains(upper(description), upper(alias)) order by length(alias) desc, rank limit 1) as alias from twins) t
left join aliases s using (alias) left join (select distinct unnest([x.a, x.b]) as seq from (select unnest(pairs) as x from (select *, row_number() over (partition by date, currency, size order by k desc) as r from step) where r = 1)) p on p.seq = t.seq
left join (select date, trim(description) as description, amount, max(date - 31) as a from twins where seq % 40 = 0 group by all) a on a.date = t.date and a.description = trim(t.description) and a.amount = t.amount
left join (select date, trim(description) as description, amount, max((case when seq % 2 = 0 then 'manual' else '' end, case when seq % 3 = 0 then 'b|a' else '' end))[1] as oc, max((case when seq % 2 = 0 then 'manual' else '' end, case when seq % 3 = 0 then 'b|a' else '' end))[2] as ot from twins where seq % 27 = 0 group by all) o
on o.date = t.date and o.description = trim(t.description) and o.amount = t.amount))""", TX, """twins as (select seq, date, amount, bank, currency, description, source_type from tx union all select seq + 1000000000, date, cast(-amount as decimal(18,2)), 'OTHER', currency, description || ' back', 'extrato' from tx where seq % 7 = 0)""",
      f"aliases as (select * from (values {SQL_ALIASES}) v(alias, rank, supplier, default_category))", PAIRED)(
    lambda s, d: row_pipeline.normalised(raw_rows(s, d), rules(s, d)).select("seq", "category", "confidence", "recurrence", "cash", "accrual", "supplier", "tags", "manual", "conflict"))
