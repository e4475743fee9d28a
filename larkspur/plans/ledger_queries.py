"""Queries of the row pipeline and the upserts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categorise, joins, order, rules, upserts
from ..sources.adapters import INCOME, OTC, TX, income, otc, table, transactions
from .registry import query
from .rule_queries import SUPPLIERS, VALUES, suppliers, with_parts

double = lambda c: F.col(c).cast("double").alias(c)


# overrides by identity: every 9th row is sent back with its amount written in another way
def overrides(s, d):
    t = transactions(s, d).where("seq % 9 = 0")
    return t.select(F.col("date").cast("string").alias("date"), F.concat(F.lit(" "), "description").alias("description"), F.concat(F.col("amount").cast("string"), F.lit("0")).alias("amount"),
                    F.when(F.col("seq") % 2 == 0, "manual").otherwise("").alias("category"), F.when(F.col("seq") % 27 == 0, F.date_add("date", 31).cast("string")).otherwise("").alias("accrual"))


query("manual_overrides", """select category, manual, count(*) as n, count(*) filter (where accrual <> date) as moved from (
select case when o.c <> '' then o.c else category end as category, coalesce(o.a, tx.date) as accrual, tx.date, o.c is not null as manual from tx left join (
select date, description, amount, max((case when seq % 2 = 0 then 'manual' else '' end, case when seq % 27 = 0 then cast(tx.date + 31 as date) end))[1] as c,
try_cast(max((case when seq % 2 = 0 then 'manual' else '' end, case when seq % 27 = 0 then cast(tx.date + 31 as varchar) else '' end))[2] as date) as a from tx where seq % 9 = 0 group by all) o
on o.date = tx.date and trim(o.description) = trim(tx.description) and o.amount = tx.amount) group by all""", TX)(
    lambda s, d: categorise.overridden(transactions(s, d).withColumn("accrual", F.col("date")), overrides(s, d)).groupBy("category", "manual").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("accrual") != F.col("date"), 1)).alias("moved")))

query("identity_match_counts", """select verdict, count(*) as requests from (select case when n = 0 then 'none' when n = 1 then 'one' else 'many' end as verdict from (
select (select count(*) from (select *, 'x' as one from tx union all select *, 'x' from tx where seq % 30 = 0) b where b.date = a.date and b.description = a.description and cast(b.amount as double) = cast(a.amount as double) + case when a.seq % 20 = 10 then 1 else 0 end) as n from tx a where seq % 10 = 0)) group by verdict""", TX)(
    lambda s, d: categorise.match_counts(
        transactions(s, d).where("seq % 10 = 0").select(F.col("seq").alias("rid"), "date", "description", (F.col("amount").cast("double") + F.when(F.col("seq") % 20 == 10, 1).otherwise(0)).alias("amount")),
        transactions(s, d).unionByName(transactions(s, d).where("seq % 30 = 0"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("requests")))

query("unique_within_half_a_cent", "select a.seq as rid, min(b.seq) as seq from tx a join tx b on a.date = b.date and a.description = b.description and abs(cast(a.amount as double) + 0.004 - cast(b.amount as double)) <= 0.005 + 1e-9 where a.seq % 50 = 0 group by a.seq", TX)(
    lambda s, d: categorise.unique_within(transactions(s, d).where("seq % 50 = 0").select(F.col("seq").alias("rid"), "date", "description", (F.col("amount").cast("double") + 0.004).alias("amount")), transactions(s, d).withColumn("amount", F.col("amount").cast("double"))))

query("vendor_recurrence", """select recurrence, count(*) as n from (select case when category = 'intercontas' then null when regexp_matches(lower(description), '(^| )refund( |$)') then 'irregular' when regexp_matches(lower(description), '(^| )2-high( |$)') then 'weekly'
when description like '%PARC %' and (seq % 12 + 1) <= (seq % 5 + 8) then 'installment' when category = 'household' then 'monthly' else 'one_off' end as recurrence from tx) group by 1""", TX)(
    lambda s, d: categorise.recurrences(with_parts(s, d), s.createDataFrame([("refund", "irregular", 0), ("2-HIGH", "weekly", 1)], "vendor string, recurrence string, rank int"), {"household": "monthly"}).groupBy("recurrence").agg(F.count(F.lit(1)).alias("n")))


def invoices(s, d):
    t = transactions(s, d).where("source_type = 'fatura'")
    return t.groupBy("bank", F.date_format("date", "yyyy-MM").alias("month")).agg(F.date_add(F.last_day(F.max("date")), F.length("bank")).alias("payment_date"))


query("invoice_basis_dates", "select seq, cast(case when source_type = 'fatura' then last_day(tx.date) + cast(length(bank) as int) else tx.date end as varchar) as cash, cast(case when seq % 40 = 0 then tx.date - 31 else tx.date end as varchar) as accrual from tx", TX)(
    lambda s, d: categorise.basis_dates(transactions(s, d).withColumn("accrual", F.when(F.col("seq") % 40 == 0, F.date_sub("date", 31))), invoices(s, d)))

query("canonical_names", "select p_partkey as id, case when lower(p_name) = 'hot gear' then 'GEAR (hot)' else array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end as name from part")(
    lambda s, d: categorise.canonicalised(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name", s.createDataFrame([("Hot Gear", "GEAR (hot)")], "raw string, canonical string")))

query("movable_suppliers", f"""select movable, count(*) as n from (select case k when 'mixed' then seq % 2 = 0 when 'yes' then true when 'no' then false end as movable from tx left join (select supplier, case when default_category = 'housing' then 'no' when default_category = 'transport' then 'mixed' else 'yes' end as k from ({SUPPLIERS})) using (supplier)) group by movable""", TX)(
    lambda s, d: categorise.movable(transactions(s, d).withColumn("hint", F.col("seq") % 2 == 0), suppliers(s).select("supplier", F.when(F.col("default_category") == "housing", "no").when(F.col("default_category") == "transport", "mixed").otherwise("yes").alias("movable"))).groupBy("movable").agg(F.count(F.lit(1)).alias("n")))

query("row_predicates", """select count(*) filter (where source_type = 'extrato' and supplier in ('S1', 'S2')) as cash, count(*) filter (where list_contains(tags, 'home') and amount > 0) as home_in, count(*) filter (where not (list_contains(tags, 'work') and amount <= 0)) as signs_ok from tx""", TX)(
    lambda s, d: transactions(s, d).agg(
        F.count(F.when(categorise.cash_expense(F.col("source_type"), F.col("supplier"), ("s1", "s2")), 1)).alias("cash"), F.count(F.when(F.array_contains("tags", "home") & (F.col("amount") > 0), 1)).alias("home_in"),
        F.count(F.when(F.forall("tags", lambda t: categorise.tag_sign_ok(t, F.col("amount"), ("work",), ())), 1)).alias("signs_ok")))

query("config_overlaps", """with a as (select distinct p_brand as slug, upper(trim(p_name)) as key from part), v as (select distinct upper(trim(p_name)) as key from part where p_size % 10 = 0), q as (select distinct upper(trim(p_name)) as key from part where p_size % 10 = 1)
select 'vendor' as "check", slug, key from a join v using (key) union all select 'self_transfer', slug, key from a join q using (key)""")(
    lambda s, d: categorise.config_overlaps(table(s, d, "part").select(F.col("p_brand").alias("slug"), F.concat(F.lit(" "), "p_name").alias("alias")).distinct(), table(s, d, "part").where("p_size % 10 = 0").select(F.upper("p_name").alias("vendor")), table(s, d, "part").where("p_size % 10 = 1").select(F.col("p_name").alias("pattern"))))

query("category_tag_collisions", "select distinct category as name from tx where category in (select unnest(tags) from tx union all select 'building')", TX)(
    lambda s, d: categorise.category_tag_collisions(transactions(s, d).select(F.upper("category").alias("name")), transactions(s, d).select(F.explode("tags").alias("name")).union(s.range(1).select(F.lit("Building")))))

query("rule_fires", f"""select layer, confidence, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from (select case when lower(description) like '%customer#00000001%' and not (amount > 0 and lower(description) like '%refund%') then 1 when amount > 0 and lower(description) like '%refund%' then 2
when (lower(description) like '%1-urgent%' and abs(abs(cast(amount as double)) - 250000) <= 12500) or (lower(description) like '%5-low%' and abs(abs(cast(amount as double)) - 100000) <= 5000) then 3 when default_category is not null then 4 else 5 end as layer,
case when layer <= 3 then 'high' when layer = 4 then 'medium' else 'low' end as confidence from tx left join ({SUPPLIERS}) using (supplier)) group by layer, confidence""", TX)(
    lambda s, d: categorise.rule_fires(rules.classified(transactions(s, d), ("Customer#00000001",), {"refund": "reimbursed"}, VALUES, suppliers(s))))

query("unknown_suppliers", "select upper(trim(description)) as description, count(*) as n, cast(sum(amount) as double) as amount, cast(min(tx.date) as varchar) as first from tx where supplier = '' group by 1 having count(*) >= 2", TX)(lambda s, d: categorise.unknown_suppliers(transactions(s, d)))


def queue(s, d):
    t = transactions(s, d).withColumn("category", F.when(F.col("seq") % 6 == 0, "a_identificar").otherwise(F.col("category")))
    return categorise.review_queue(t, ("S3", "S4"))


QUEUE = "queue as (select 1 as pass, seq from tx where supplier = '' union all select 2, seq from tx where supplier <> '' and seq % 6 = 0 union all select 3, seq from tx where amount > 0 and supplier in ('S3', 'S4'))"
query("review_queue", "select pass, count(*) as n, min(seq) as first from queue group by pass", TX, QUEUE)(lambda s, d: queue(s, d).groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")))
query("review_pass_gate", """select pass, open, coalesce(sum(open) over (order by pass rows between unbounded preceding and 1 preceding), 0) = 0 as may_start from (
select pass, count(*) filter (where not (seq in (select seq from tx where supplier = '') or seq % 5 = 0)) as open from queue group by pass)""", TX, QUEUE)(
    lambda s, d: categorise.pass_gate(queue(s, d), transactions(s, d).where("supplier = '' or seq % 5 = 0").select("seq")))

query("tag_governance", """select token, arg_max(action, event_id) as state, count(*) filter (where action = 'reject') as rejections, arg_max(action, event_id) = 'reject' and count(*) filter (where action = 'reject') % 3 = 0 as resurface
from (select user_id as token, event_id, case event_id % 3 when 0 then 'accept' else 'reject' end as action from events) group by token""")(
    lambda s, d: categorise.tag_state(table(s, d, "events").select(F.col("user_id").alias("token"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "accept").otherwise("reject").alias("action"))))

query("retro_rename", """select category, t as tags, changed, count(*) as n from (select case category when 'building' then 'house' else category end as category, category = 'building' or list_contains(tags, 'home') as changed,
array_to_string(list_sort(list_distinct(list_transform(tags, lambda x: case when x = 'home' then 'work' else x end))), '|') as t from tx) group by all""", TX)(
    lambda s, d: categorise.renamed(transactions(s, d), {"home": "work"}, {"building": "house"}).select("category", F.array_join(F.sort_array("tags"), "|").alias("tags"), "changed").groupBy("category", "tags", "changed").agg(F.count(F.lit(1)).alias("n")))

# upserts
query("snapshot_insert_absent", """select n, count(*) as keys, cast(sum(v) as double) as total from (select product, date, count(*) as n, sum(amount) as v from (
select product, date, amount from otc where source = 'b3' union all select product, date, min(amount) from otc where source = 'broker' and (product, date) not in (select (product, date) from otc where source = 'b3') group by product, date) group by all) group by n""", OTC)(
    lambda s, d: upserts.insert_absent(*(otc(s, d).where(f"source = '{k}'").select("product", "date", "amount") for k in ("b3", "broker")), ["product", "date"])
    .groupBy("product", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"), F.sum("v").cast("double").alias("total")))

SEEDS = """flow as (select distinct on (product, date, operation) product, date, operation, 'flow' as source from otc where product <> 'P7' and date >= date '1994-01-01'),
seed as (select distinct product, date '1995-01-01' + cast(product[2:] as int) * 7 as date, 'aplicacao' as operation, 'b3_seed' as source from otc)"""
query("ledger_seed_suppression", """select source, count(*) as n, cast(min(date) as varchar) as first from (select * from flow union all
select s.* from seed s where not exists (select 1 from flow f where f.product = s.product and f.date < s.date) and not exists (select 1 from flow f where f.product = s.product and f.date = s.date and f.operation = s.operation)) group by source""", OTC, SEEDS)(
    lambda s, d: upserts.seeded(
        *(otc(s, d).where(f"product <> 'P7' and date >= '1994-01-01' and {w}").select("product", "date", "operation", F.lit("flow").alias("source")).distinct() for w in ("source = 'b3'", "source <> 'b3'")),
        otc(s, d).select("product").distinct().select("product", F.date_add(F.lit("1995-01-01").cast("date"), F.substring("product", 2, 9).cast("int") * 7).alias("date"), F.lit("aplicacao").alias("operation"), F.lit("b3_seed").alias("source")),
        ["product", "date", "operation"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first")))


def registers(s, d):
    p = table(s, d, "part")
    known = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    sent = p.where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.upper("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "NEW").otherwise(F.col("p_type")).alias("kind"), (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("size"))
    return known, sent, "id", ["name", "size"]


REGISTERS = """k as (select p_partkey as id, p_name as name, p_type as kind, p_size as size from part where p_partkey % 5 <> 0),
n as (select p_partkey as id, case when p_partkey % 4 = 0 then '' else upper(p_name) end as name, case when p_partkey % 3 = 0 then 'NEW' else p_type end as kind, p_size + case when p_partkey % 7 = 0 then 1 else 0 end as size from part where p_partkey % 2 = 0)"""
query("row_diff", """select id, case when known is null then 'insert' when a <> '' then 'update' else 'noop' end as action, a as changed, case when known is null or kind = old then '' else 'kind' end as blocked from (
select n.id, k.id as known, n.kind, k.kind as old, array_to_string(list_filter([case when k.id is not null and n.name <> '' and n.name <> k.name then 'name' end, case when n.size <> k.size then 'size' end], lambda x: x is not null), ',') as a from n left join k using (id))""", REGISTERS)(
    lambda s, d: upserts.row_diff(*registers(s, d)))
query("field_owned_upsert", "select id, case when k.id is null or (n.name <> '' and n.name is not null) then n.name else k.name end as name, coalesce(k.kind, n.kind) as kind, coalesce(n.size, k.size) as size from k full join n using (id)", REGISTERS)(lambda s, d: upserts.owned_upsert(*registers(s, d)))

query("method_upsert", """select action, count(*) as n from (select case when b.m is null then 'insert' when a.v <> b.v then 'conflict' when a.m < b.m then 'upgrade' else 'skip' end as action from
(select l_orderkey as k, l_linenumber as l, l_quantity as v, l_suppkey % 3 as m from lineitem where l_partkey % 2 = 0) a left join (select l_orderkey as k, l_linenumber as l, l_quantity + case when l_partkey % 10 = 0 then 1 else 0 end as v, l_partkey % 3 as m from lineitem where l_partkey % 4 = 0) b using (k, l)) group by action""")(
    lambda s, d: upserts.method_upsert(
        table(s, d, "lineitem").where("l_partkey % 4 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), (F.col("l_quantity") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)).alias("value"), F.concat(F.lit("m"), F.col("l_partkey") % 3).alias("method")),
        table(s, d, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("value"), F.concat(F.lit("m"), F.col("l_suppkey") % 3).alias("method")),
        ["k", "l"], ["m0", "m1", "m2"]).groupBy("action").agg(F.count(F.lit(1)).alias("n")))

query("surplus_inserts", """select operation, product, count(*) as n, cast(sum(amount) as double) as amount from (select *, row_number() over (partition by operation, product order by date, key, amount) as r from otc where source = 'b3')
left join (select operation, product, count(*) as m from otc where source = 'broker' group by all) using (operation, product) where r > coalesce(m, 0) group by operation, product""", OTC)(
    lambda s, d: upserts.surplus_rows(otc(s, d).where("source = 'b3'"), otc(s, d).where("source = 'broker'"), ["operation", "product"], ["date", "key", "amount"]).groupBy("operation", "product").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount")))

query("fuzzy_gate", "select count(*) as n, cast(0 as bigint) as fuzzy, count(*) filter (where seq % 3 <> 0) as inserts, true as passed from tx where seq % 2 = 0", TX)(
    lambda s, d: upserts.fuzzy_gate(joins.consumed_matches(
        transactions(s, d).where("seq % 2 = 0").select("seq", "date", double("seq").alias("key")), transactions(s, d).where("seq % 3 = 0").select("seq", "date", double("seq").alias("key")), ["date"], "key", 0.0)))

query("income_first_record", """select a.r as rid, arg_min(b.quantity, b.r) as value from i a left join i b on a.ticker = b.ticker and a.date = b.date and abs(cast(a.value as double) + 0.001 - cast(b.value as double)) < 0.005 where a.r % 50 = 0 group by a.r""", INCOME,
      "i as (select *, row_number() over (order by date, ticker, type, value, quantity) as r from income)")(
    lambda s, d: (lambda i: upserts.first_within(i.where("seq % 50 = 0").select(F.col("seq").alias("rid"), "ticker", "date", (F.col("v") + 0.001).alias("v")), i.withColumn("value", F.col("quantity")), ["ticker", "date"], "v"))(
        order.dense_index(income(s, d), ["date", "ticker", "type", "value", "quantity"], "place").select((F.col("place") + 1).cast("long").alias("seq"), "ticker", "date", double("value").alias("v"), "quantity")))

query("quantity_corrections", "select seq % 8 = 0 as corrected, count(*) as n, cast(sum(cast(round(case when seq % 8 = 0 then amount * 2 else amount end, 2) as decimal(18,2))) as double) as total from tx group by 1", TX)(
    lambda s, d: upserts.corrected(
        transactions(s, d).select("seq", F.concat("bank", F.col("seq").cast("string")).alias("ticker"), "date", double("amount").alias("quantity")),
        transactions(s, d).where("seq % 8 = 0").select(F.concat("bank", F.col("seq").cast("string")).alias("ticker"), "date", (F.col("amount").cast("double") * (1 + 1e-8)).alias("from_value"), (F.col("amount").cast("double") * 2).alias("to_value"), "seq"))
    .groupBy("corrected").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("quantity", 2).cast("decimal(18,2)")).cast("double").alias("total")))


def migrations(s, d):
    """Every tenth product goes over to a new code on its last day."""
    return otc(s, d).where("cast(substr(product, 2) as int) % 10 = 0").groupBy(F.col("product").alias("from_product")).agg(F.max("date").alias("from_date"), F.sum("amount").alias("from_total")).select("from_product", "from_date", "from_total", F.concat(F.lit("P"), F.substring("from_product", 2, 9).cast("int") + 1).alias("to_product"), F.date_add("from_date", 1).alias("to_date"))


MIGRATIONS = "mig as (select product as from_product, max(date) as from_date, sum(amount) as from_total, 'P' || (cast(product[2:] as int) + 1) as to_product, max(date) + 1 as to_date from otc where cast(product[2:] as int) % 10 = 0 group by product)"
query("migration_phantoms", """select operation, count(*) as n, cast(sum(amount) as double) as amount from otc o where not exists (select 1 from mig where (o.operation = 'resgate' and o.product = from_product and o.date = from_date) or (o.operation = 'aplicacao' and o.product = to_product and o.date = to_date)) group by operation""", OTC, MIGRATIONS)(
    lambda s, d: upserts.phantom(otc(s, d), migrations(s, d)).groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount")))
query("migration_seeds", "select to_product as product, cast(max(from_date) as varchar) as date, cast(-sum(from_total) as double) as amount, 'aplicacao' as operation from mig group by to_product", OTC, MIGRATIONS)(
    lambda s, d: upserts.migration_seeds(migrations(s, d)).select("product", F.col("date").cast("string").alias("date"), double("amount"), "operation"))
query("earliest_real_flow", "select product, cast(min(date) filter (where key % 4 <> 0) as varchar) as first from otc group by product", OTC)(
    lambda s, d: upserts.earliest_real(otc(s, d).withColumn("source", F.when(F.col("key") % 4 == 0, F.concat("source", F.lit("_seed"))).otherwise(F.col("source")))))
