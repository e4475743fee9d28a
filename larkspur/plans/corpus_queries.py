"""Text, link, graph, event and scalar-function queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import corpus, graph
from ..sources.adapters import TX, table, transactions
from ..sources.tables import upsert
from .registry import SQL, query


def documents(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: x <> '')"
STOPS = ", ".join(f"'{w}'" for w in corpus.STOP)
BENCH = "q as (select item_id as qid, text from benchmark)"
BM25 = f"""w as (select doc_id as id, {TOK.format('text')} as ts from documents), ql as (select qid, unnest(list_distinct({TOK.format('text')})) as term from q),
tf as (select term, id, len, cast(count(*) as double) as tf from (select id, len(ts) as len, unnest(ts) as term from w) where term in (select term from ql) group by all),
st as (select cast(count(*) as double) as n, avg(len(ts)) as av from w), df as (select term, cast(count(*) as double) as df from tf group by term),
sc as (select qid, id, round(sum(greatest(ln((n - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / av)))), 6) as score from tf join df using (term) join ql using (term), st group by qid, id),
bm as (select * from (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from sc) where rank <= 50)"""


def bm25_ranking(s, d):
    return corpus.bm25(documents(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))


query("bm25_topk", "select * from bm", BENCH, BM25)(bm25_ranking)

VEC = """vs as (select q.vec_id as qid, v.vec_id as id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score
from embeddings v, embeddings q where q.vec_id % 50 = 0), vt as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from vs) where rank <= 50)"""


def vector_ranking(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return corpus.cosine_top_k(e, e.where("id % 50 = 0").withColumnRenamed("id", "qid"))


query("vector_topk", "select qid, id, round(score, 4) as score from vt where rank <= 10", VEC)(lambda s, d: vector_ranking(s, d).where("rank <= 10").select("qid", "id", F.round("score", 4).alias("score")))

RRF = "rr as (select qid, id, round(sum(1.0::double / (60 + rank)), 9) as score from (select qid, id, rank from bm union all select qid, id, rank from vt) group by qid, id), rt as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from rr) where rank <= 25)"
query("rrf_hybrid", "select qid, id, score, rank from rt", BENCH, BM25, VEC, RRF)(lambda s, d: corpus.fuse(bm25_ranking(s, d), vector_ranking(s, d)))
query("rerank_boost", """select qid, id, score, position from (select qid, id, score, row_number() over (partition by qid order by round(score * case when lang in ('de', 'fr') then 1.25::double else 1.0::double end, 9) desc, id) as position from rt join documents on doc_id = id) where position <= 10""", BENCH, BM25, VEC, RRF)(
    lambda s, d: corpus.reranked(corpus.fuse(bm25_ranking(s, d), vector_ranking(s, d)), documents(s, d).select("id", F.col("lang").alias("kind")), ["de", "fr"]))

query("chunk_lines", """select id, row_number() over (partition by id order by slot) - 1 as pos, n_lines, n_chars from (select id, slot, count(*) as n_lines, cast(sum(length(s)) as bigint) as n_chars from (
select id, s, cast(floor(coalesce(sum(length(s) + 1) over (partition by id order by line rows between unbounded preceding and 1 preceding), 0) / 1000) as bigint) as slot
from (select doc_id as id, unnest(string_split(text, chr(10))) as s, unnest(range(len(string_split(text, chr(10))))) as line from documents)) group by id, slot)""")(lambda s, d: corpus.chunks(documents(s, d)))

DUPS = """dd as (select doc_id as id, sha256(coalesce(text, '')) as content, source || '/' || (doc_id % 97) as url, lower(trim(string_split(text, chr(10))[1])) as title from documents),
k as (select 0 as r, 'content' as signal, id, min(id) over (partition by content) as first from dd union all select 1, 'url', id, min(id) over (partition by url) from dd where url <> '' union all select 2, 'title', id, min(id) over (partition by title) from dd where title <> '')"""
query("duplicate_documents", "select id, arg_min(signal, r) as signal, arg_min(first, r) as first from k where id <> first group by id", DUPS)(
    lambda s, d: corpus.duplicate_documents(documents(s, d).select("id", "text", F.concat(F.lit("https://www."), "source", F.lit("/"), (F.col("id") % 97).cast("string"), F.lit("/?q=1")).alias("url"), F.split("text", "\n").getItem(0).alias("title"))))

EDGES = "e as (select distinct doc_id as src, (doc_id * 9 + k * 13) // 8 as dst from documents, (values (1), (2), (3)) v(k) where doc_id <> (doc_id * 9 + k * 13) // 8)"
query("broken_links", "select dst, count(*) as n, min(src) as first from e where dst not in (select doc_id from documents) group by dst", EDGES)(lambda s, d: corpus.broken_links(corpus.edges(documents(s, d)), documents(s, d)))
query("orphans", "select doc_id as id from documents where doc_id not in (select dst from e)", EDGES)(lambda s, d: corpus.orphans(corpus.edges(documents(s, d)), documents(s, d)))
query("link_df_relevance", "select src, dst as rarest, df, df >= 5 as weak from (select src, dst, df, row_number() over (partition by src order by df, dst) as r from e join (select dst, count(*) as df from e group by dst) using (dst)) where r = 1", EDGES)(
    lambda s, d: corpus.link_relevance(corpus.edges(documents(s, d))))
query("unlinked_mentions", f"""select id, target, count(*) as n from (select doc_id as id, unnest({TOK.format('text')}) as w from documents) join (select min(doc_id) as target, lower(regexp_extract(text, '[A-Za-z]+')) as name from documents group by 2) on w = name
where id <> target and not exists (select 1 from e where src = id and dst = target) group by id, target""", EDGES)(
    lambda s, d: corpus.mentions(documents(s, d), documents(s, d).groupBy(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("name")).agg(F.min("id").alias("id")).where("name <> ''"), corpus.edges(documents(s, d))))


query("token_overlap", f"""select a, b, len(list_intersect(x, y)) as shared, len(list_intersect(x, y)) >= 2 as fires from (
select l.doc_id as a, r.doc_id as b, list_filter({TOK.format('l.text')}, lambda t: t not in ({STOPS})) as x, list_filter({TOK.format('r.text')}, lambda t: t not in ({STOPS})) as y
from documents l join documents r on r.doc_id = l.doc_id + 1)""")(
    lambda s, d: corpus.token_overlap(documents(s, d).select(F.col("id").alias("i"), F.col("text").alias("a")).join(documents(s, d).select((F.col("id") - 1).alias("i"), F.col("text").alias("b")), "i"))
    .select(F.col("i").alias("a"), (F.col("i") + 1).alias("b"), "shared", "fires"))


query("span_coalesce", """select id, min(a) as a, max(e) as e from (select *, sum(new) over (partition by id order by a, e) as g from (
select *, case when max(e) over (partition by id order by a, e rows between unbounded preceding and 1 preceding) >= a then 0 else 1 end as new from sp)) group by id, g""",
      "sp as (select user_id as id, event_id % 1000 as a, event_id % 1000 + cast(floor(value) as bigint) % 20 as e from events)")(
    lambda s, d: corpus.coalesced_spans(table(s, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 1000).alias("a"), (F.col("event_id") % 1000 + F.floor("value") % 20).alias("e"))).select("id", "a", "e"))

query("round_robin_sample", """select id, source, r from (select doc_id as id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) as r, count(*) over (partition by source) as n from documents) where r <= ceil(n * 0.25)""")(lambda s, d: corpus.round_robin(documents(s, d).select("id", "source"), "source", 0.25))

query("thin_pages", """select id, lines, share, lines >= 3 and share < 0.5 as thin, quality from (select doc_id as id, len(string_split(text, chr(10))) as lines, round(len(list_filter(w, lambda x: length(x) > 3)) / len(w), 6) as share
from (select *, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as w from documents) where len(w) > 0) left join labels on doc_id = id""")(
    lambda s, d: corpus.thin_pages(documents(s, d), table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality")))

STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))"
query("html_strip", f"select page_id, length({STRIP}) as n, sha256({STRIP}) as hash, left({STRIP}, 240) as snippet from pages")(
    lambda s, d: table(s, d, "pages").select("page_id", scalar.strip_html(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("hash"), F.left("t", F.lit(240)).alias("snippet")))
query("html_density_gate", f"""select page_id, n_bytes, n_prose, case when n_bytes < 16 then 'tiny' when n_prose >= 400 then 'accepted' when n_prose < 25 then 'no_prose' when n_bytes >= 2048 and n_prose / n_bytes < 0.005 then 'sparse' else 'accepted' end as verdict
from (select page_id, octet_length(encode(html)) as n_bytes, length({STRIP}) as n_prose from pages)""")(lambda s, d: corpus.html_gate(table(s, d, "pages")))
query("url_normalise", "select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') as key from pages")(lambda s, d: table(s, d, "pages").select("page_id", scalar.url_key(F.col("url")).alias("key")))

query("event_tail", "select event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events where event_type = 'error' and user_id % 3 = 0 and ts >= timestamp '2024-01-05' order by ts desc, event_id limit 50")(
    lambda s, d: table(s, d, "events").where("event_type = 'error' and user_id % 3 = 0 and ts >= timestamp_ntz'2024-01-05 00:00:00'").orderBy(F.desc("ts"), "event_id").limit(50)
    .select("event_id", "user_id", "event_type", F.substring(F.col("ts").cast("string"), 1, 19).alias("at")))
query("event_json_rollup", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k, count(distinct json_extract_string(props, '$.k')) as kinds from events group by event_type")(
    lambda s, d: table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("long")).alias("k"), F.count_distinct("k").alias("kinds2")).withColumnRenamed("kinds2", "kinds"))

query("open_questions", """select conv_id, count(*) filter (where role = 'user') as asked, count(*) filter (where role = 'user' and (nxt is null or nxt <> 'assistant')) as unanswered
from (select *, lead(role) over (partition by conv_id order by turn) as nxt from conversations) group by conv_id having count(*) filter (where role = 'user' and (nxt is null or nxt <> 'assistant')) > 0""")(
    lambda s, d: table(s, d, "conversations").withColumn("next", F.expr("lead(role) over (partition by conv_id order by turn)")).groupBy("conv_id").agg(
        F.count(F.when(F.col("role") == "user", 1)).alias("asked"), F.count(F.when((F.col("role") == "user") & (F.col("next").isNull() | (F.col("next") != "assistant")), 1)).alias("unanswered")).where("unanswered > 0"))

query("installments", """select seq, n, m from (select seq, try_cast(regexp_extract(description, '(?i)parc(?:ela)?\\s*(\\d{1,2})\\s*(?:/|de)\\s*(\\d{1,2})', 1) as int) as n, try_cast(regexp_extract(description, '(?i)parc(?:ela)?\\s*(\\d{1,2})\\s*(?:/|de)\\s*(\\d{1,2})', 2) as int) as m from tx)
where n >= 1 and n <= m and m >= 2 and m <= 48""", TX)(
    lambda s, d: transactions(s, d).select("seq", scalar.installment(F.col("description"))[0].alias("n"), scalar.installment(F.col("description"))[1].alias("m")).where("n is not null"))

PTBR = "case o_orderkey % 3 when 0 then 'R$ ' else '' end || replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.')"
query("ptbr_parse", "select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as double) * case when o_orderkey % 4 = 0 then -1 else 1 end as v, cast(cast(o_orderdate as date) as varchar) as date from orders")(
    lambda s, d: table(s, d, "orders").withColumn("t", F.translate(F.format_number("o_totalprice", 2), ",.", ".,")).select(
        "o_orderkey", scalar.ptbr_decimal(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("("), "t", F.lit(")"))).otherwise(F.concat(F.lit("R$ "), "t"))).alias("v"),
        scalar.any_date(F.date_format("o_orderdate", "d/M/yyyy")).cast("string").alias("date")))

query("due_buckets", """select bucket, count(*) as n from (select case when n is null then 'none' when n < 0 then 'overdue' when n = 0 then 'today' when n = 1 then 'tomorrow'
when due <= date_trunc('week', date '1998-06-10') + interval 6 day then 'week' when date_trunc('month', due) = date '1998-06-01' then 'month' else 'later' end as bucket
from (select due, due - date '1998-06-10' as n from (select case when o_orderkey % 10 = 0 then null else cast(o_orderdate as date) end as due from orders))) group by bucket""")(
    lambda s, d: table(s, d, "orders").select(scalar.due_bucket(F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")), F.lit("1998-06-10").cast("date")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))

DEPS = "dep as (select doc_id as id, doc_id - doc_id % 7 - 1 as needs from documents where doc_id % 7 <> 0 and doc_id % 100 < 40 and doc_id - doc_id % 7 - 1 >= doc_id - doc_id % 100 union all select doc_id, doc_id + 1 from documents where doc_id % 500 = 498 union all select doc_id, doc_id - 1 from documents where doc_id % 500 = 499)"


def dependencies(s, d):
    i = documents(s, d).select("id")
    j = F.col("id") - F.col("id") % 7 - 1
    return (
        i.where("id % 7 <> 0 and id % 100 < 40").select("id", j.alias("needs")).where("needs >= id - id % 100")
        .unionByName(i.where("id % 500 = 498").select("id", (F.col("id") + 1).alias("needs"))).unionByName(i.where("id % 500 = 499").select("id", (F.col("id") - 1).alias("needs")))
    )


query("topo_waves", """select doc_id as id, case when doc_id in (select id from cyc) then null else coalesce((select max(n) from w where w.id = doc_id), 0) end as wave from documents""", DEPS,
      "w(id, needs, n) as (select id, needs, cast(1 as bigint) from dep where id % 500 < 498 union all select w.id, d.needs, w.n + 1 from w join dep d on d.id = w.needs)", "cyc as (select doc_id as id from documents where doc_id % 500 >= 498)")(
    lambda s, d: graph.waves(documents(s, d), dependencies(s, d)))
query("ready_set", "select doc_id as id from documents where doc_id % 3 <> 0 and doc_id not in (select id from dep where needs % 3 <> 0 or needs not in (select doc_id from documents))", DEPS)(
    lambda s, d: graph.ready_set(documents(s, d), dependencies(s, d), documents(s, d).where("id % 3 = 0").select("id")))

query("asset_upsert", """select kind, count(*) as n, cast(sum(price) as double) as price from (select p_partkey as id, p_type as kind, cast(p_retailprice as decimal(18,2)) as price from part where p_partkey % 5 <> 0
union all select p_partkey, 'NEW', cast(cast(p_retailprice as decimal(18,2)) * 2 as decimal(18,2)) from part where p_partkey % 5 = 0) group by kind""")(
    lambda s, d: upsert(table(s, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").cast("decimal(18,2)").alias("price")),
                        table(s, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"), F.lit("NEW").alias("kind"), (F.col("p_retailprice").cast("decimal(18,2)") * 2).cast("decimal(18,2)").alias("price")), ["id"])
    .groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("price")))
