"""Queries of notes and pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import tokens
from ..operators import corpus, notes
from ..sources.adapters import table
from ..sources.tables import cut
from .corpus_queries import EDGES, STOPS, TOK, documents
from .registry import query


def markdown(s, d):
    """Documents as notes: a title, a heading before every fourth line, a log entry before every seventh, blank lines between lines."""
    line = lambda x, i: F.concat(F.when(i % 4 == 3, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"))).when(i % 7 == 5, F.lit("## [2024-01-05] ingest\n")).otherwise(""), x)
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return documents(s, d).select("id", F.concat(F.lit("---\nkind: note\n---\n# Note "), F.col("id").cast("string"), F.lit("\n"), body).alias("text"))


MD = """md as (select doc_id as id, '# Note ' || doc_id || chr(10) || array_to_string(list_transform(range(len(l)), lambda i: case when i % 4 = 3 then '## Part ' || i || chr(10) when i % 7 = 5 then '## [2024-01-05] ingest' || chr(10) else '' end || l[i + 1]), chr(10) || chr(10)) as text
from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
sec0 as (select id, unnest(p) as part, unnest(range(len(p))) as pos from (select id, regexp_split_to_array(text, '(?m)^## +') as p from md)),
sec as (select id, 'Note ' || id as title, pos, case when pos = 0 then '' else string_split(part, chr(10))[1] end as anchor, case when pos = 0 then part when instr(part, chr(10)) = 0 then '' else part[instr(part, chr(10)) + 1:] end as body from sec0)"""
BARE = "trim({0}, ' ' || chr(9) || chr(13) || chr(10))"
query("note_sections", "select id, title, pos, anchor, length(body) as n, sha256(body) as hash from sec", MD)(lambda s, d: notes.sections(markdown(s, d)).select("id", "title", "pos", "anchor", F.length("body").cast("long").alias("n"), F.sha2("body", 256).alias("hash")))
query("section_by_name", "select id, pos, length(body) as n from sec where pos > 0 and lower(trim(anchor)) = 'part 3'", MD)(lambda s, d: notes.section_body(markdown(s, d), "Part 3").select("id", "pos", F.length("body").cast("long").alias("n")))
EMPTY = "cast([] as varchar[])"
query("heading_chunks", f"""select id, row_number() over (partition by id order by pos, k) - 1 as pos, anchor, sha256(title || case when anchor <> '' then ' — ' || anchor else '' end || chr(10) || chr(10) || {BARE.format('run')}) as hash from (
select *, unnest(runs) as run, unnest(range(len(runs))) as k from (
select *, case when length(content) <= 600 then [content] else list_concat(f.done, case when trim(f.open, ' ' || chr(10)) <> '' then [f.open] else {EMPTY} end) end as runs from (
select *, list_reduce(list_concat([{{'done': {EMPTY}, 'open': ''}}], list_transform(string_split(content, chr(10) || chr(10)), lambda x: {{'done': {EMPTY}, 'open': x}})), lambda s, p: {{
'done': list_concat(list_concat(s.done, list_transform(range(greatest(cast(ceil(length(p.open) / 600.0) as bigint) - 1, 0)), lambda i: p.open[i * 600 + 1:i * 600 + 600])),
  case when s.open <> '' and length(s.open) + length(p.open[greatest(cast(ceil(length(p.open) / 600.0) as bigint) - 1, 0) * 600 + 1:]) + 2 > 600 then [s.open] else {EMPTY} end),
'open': case when s.open = '' or length(s.open) + length(p.open[greatest(cast(ceil(length(p.open) / 600.0) as bigint) - 1, 0) * 600 + 1:]) + 2 > 600 then p.open[greatest(cast(ceil(length(p.open) / 600.0) as bigint) - 1, 0) * 600 + 1:]
  else s.open || chr(10) || chr(10) || p.open[greatest(cast(ceil(length(p.open) / 600.0) as bigint) - 1, 0) * 600 + 1:] end}}) as f from (
select id, title, pos, trim(anchor) as anchor, {BARE.format("case when pos = 0 then regexp_replace(body, '^# [^\\n]*', '') else body end")} as content from sec) where content <> '')))""", MD)(
    lambda s, d: notes.chunked(markdown(s, d), 600).select("id", "pos", "anchor", F.sha2("text", 256).alias("hash")))
query("log_blocks", "select id, count(*) as n, cast(min(try_cast(part[2:11] as date)) as varchar) as first, min(trim(string_split(part[13:], chr(10))[1])) as kind from sec0 where pos > 0 and part[1] = '[' group by id", MD)(
    lambda s, d: notes.log_blocks(markdown(s, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first"), F.min("kind").alias("kind")))

ROWS = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$') and not regexp_matches(x, '^[\\s|:-]+$'))"
query("markdown_tables", f"""select id, count(*) as n, sum(len(string_split(regexp_replace(trim(r), '^\\||\\|$', '', 'g'), '|')))::bigint as cells from (select id, unnest({ROWS}) as r from md2) group by id""",
      "md2 as (select doc_id as id, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(replace(text, '|', ' '), chr(10), ' |' || chr(10) || '| ') || ' |' as text from documents where text is not null)")(
    lambda s, d: notes.table_rows(documents(s, d).select("id", F.concat(F.lit("| a | b |\n|---|---|\n| "), F.replace(F.replace("text", F.lit("|"), F.lit(" ")), F.lit("\n"), F.lit(" |\n| ")), F.lit(" |")).alias("text")))
    .groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("cells")))

LINKS = """ln as (select distinct page_id as src, trim(regexp_replace(regexp_replace(replace(replace(lower(strip_accents(string_split(h, '/')[-1])), 'ß', 'ss'), 'ﬁ', 'fi'), '\\.md$', ''), '[^a-z0-9]+', '-', 'g'), '-') as name from (select page_id, unnest(regexp_extract_all(html, '<a[^>]*\\shref="([^"#?]*)', 1)) as h from pages) where name <> ''),
tt as (select page_id as id, trim(regexp_replace(regexp_replace(replace(replace(lower(strip_accents(regexp_extract(html, '<title>\\s*([^\\s<]+)', 1))), 'ß', 'ss'), 'ﬁ', 'fi'), '\\.md$', ''), '[^a-z0-9]+', '-', 'g'), '-') as name from pages where name <> ''),
nm as (select name, min(id) as dst, count(*) as n from tt group by name),
rs as (select src, ln.name, dst, case when n is null then 'unresolved' when n > 1 then 'ambiguous' else 'unique' end as verdict from ln left join nm using (name))"""
found = lambda s, d: notes.resolved(notes.hrefs(table(s, d, "pages")), notes.titles(table(s, d, "pages")))
query("page_links", "select * from rs", LINKS)(found)
query("page_link_names_unresolved", "select name, count(*) as n, min(src) as first from rs where verdict = 'unresolved' group by name", LINKS)(
    lambda s, d: found(s, d).where("verdict = 'unresolved'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first")))
query("page_orphans", "select page_id as id from pages where page_id not in (select dst from rs where dst is not null)", LINKS)(lambda s, d: corpus.orphans(found(s, d).where("dst is not null"), table(s, d, "pages").select(F.col("page_id").alias("id"))))
query("page_link_relevance", "select src, dst as rarest, df, df >= 5 as weak from (select src, dst, df, row_number() over (partition by src order by df, dst) as r from (select distinct src, dst from rs where dst is not null) join (select dst, count(distinct src) as df from rs where dst is not null group by dst) using (dst)) where r = 1", LINKS)(
    lambda s, d: corpus.link_relevance(found(s, d).where("dst is not null").select("src", "dst").distinct()))

query("source_queue_matches", """select k as id, page, how from (select a.k, b.k as page, case when a.u = b.u or starts_with(a.u, b.u || '/') or starts_with(b.u, a.u || '/') then 'url' when a.doi <> '' and a.doi = b.doi then 'doi' else 'title' end as how,
row_number() over (partition by a.k order by case when a.u = b.u or starts_with(a.u, b.u || '/') or starts_with(b.u, a.u || '/') then 1 when a.doi <> '' and a.doi = b.doi then 2 else 3 end, b.k) as r
from sq a join sp b on a.u = b.u or starts_with(a.u, b.u || '/') or starts_with(b.u, a.u || '/') or (a.doi <> '' and a.doi = b.doi) or (a.t <> '' and a.t = b.t)) where r = 1""",
      "sp as (select doc_id as k, 'ex.org/' || source || '/' || doc_id as u, case when doc_id % 3 = 0 then '10.1/' || (doc_id % 60) else '' end as doi, 't' || (doc_id % 200) as t from documents where doc_id % 2 = 0), sq as (select doc_id as k, case doc_id % 10 when 0 then 'ex.org/' || source || '/' || doc_id || '/p' when 1 then 'ex.org/' || source else 'other/' || doc_id end as u, case when doc_id % 5 = 0 then '10.1/' || (doc_id % 90) else '' end as doi, 't' || (doc_id % 300) as t from documents)")(
    lambda s, d: (lambda i, x: notes.source_matches(
        x.select(i.alias("id"), F.when(i % 10 == 0, F.concat(F.lit("https://www.ex.org/"), "source", F.lit("/"), i, F.lit("/p/"))).when(i % 10 == 1, F.concat(F.lit("http://EX.org/"), "source", F.lit("?q"))).otherwise(F.concat(F.lit("other/"), i)).alias("url"), F.when(i % 5 == 0, F.concat(F.lit("10.1/"), i % 90)).otherwise("").alias("doi"), F.concat(F.lit("T"), i % 300).alias("title")),
        x.where(i % 2 == 0).select(i.alias("id"), F.concat(F.lit("https://ex.org/"), "source", F.lit("/"), i).alias("url"), F.when(i % 3 == 0, F.concat(F.lit("10.1/"), i % 60)).otherwise("").alias("doi"), F.concat(F.lit(" t"), i % 200).alias("title"))))(F.col("id"), documents(s, d)))


def backfill(s, d):
    t = documents(s, d)
    names = t.groupBy(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("slug")).agg(F.min("id").alias("id")).where("slug <> '' and length(slug) > 5")
    linked = corpus.edges(t).select(F.col("src").alias("source"), F.col("dst").alias("topic"))
    return notes.candidates(t.select("id", tokens(F.col("text")).alias("words")), names, linked.where("source % 2 = 1"), linked.where("source % 2 = 0"))


TOPICS = f"""tp as (select min(doc_id) as topic, lower(regexp_extract(text, '[A-Za-z]+')) as slug from documents group by 2 having slug <> '' and length(slug) > 5),
cand as (select source, topic, count(*) as n from (select doc_id as source, unnest({TOK.format('text')}) as slug from documents) join tp using (slug) where source <> topic and not exists (select 1 from e where src = source and dst = topic) group by source, topic)"""
query("backfill_candidates", "select * from cand", EDGES, TOPICS)(backfill)
query("backfill_coverage", """select topic, count(*) filter (where source % 3 = 0) as drafted, count(*) filter (where source % 3 <> 0 and source % 5 = 0) as cited, count(*) filter (where source % 3 <> 0 and source % 5 <> 0) as gap, count(*) filter (where source % 3 <> 0 and source % 5 <> 0) = 0 as passed from cand group by topic""", EDGES, TOPICS)(
    lambda s, d: (lambda c: notes.coverage(c, c.where("source % 3 = 0"), c.where("source % 5 = 0")))(cut(backfill(s, d), "candidates")))
query("ingested_union", """select doc_id as name, array_to_string(list_filter([case when doc_id % 3 = 0 then 'backlink' end, case when doc_id % 4 = 0 then 'index' end, case when doc_id % 5 = 0 then 'stem' end], lambda x: x is not null), ',') as signals from documents where doc_id % 3 = 0 or doc_id % 4 = 0 or doc_id % 5 = 0""")(
    lambda s, d: (lambda n: notes.ingested(n, n.where("name % 4 = 0"), n.where("name % 3 = 0"), n.where("name % 5 = 0")))(documents(s, d).select(F.col("id").alias("name"))))
query("manifest_totals", "select source, count(*) as n, count(*) filter (where not coalesce(quality = 1, false)) as missing, cast(sum(n_chars // 4) as bigint) as tokens from documents left join labels using (doc_id) group by source")(
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.coalesce(F.col("quality") == 1, F.lit(False)), 1)).alias("missing"), F.sum(F.floor(F.col("n_chars") / 4)).alias("tokens")))
query("footnote_gaps", """select id, array_to_string(list_sort(list_filter(u, lambda x: not list_contains(k, x))), ',') as missing, array_to_string(list_sort(list_filter(k, lambda x: not list_contains(u, x))), ',') as stale
from (select doc_id as id, list_distinct(regexp_extract_all(text, '([a-z]+)\\.', 1)) as u, list_distinct(regexp_extract_all(text, '\\n([a-z]+)', 1)) as k from documents where text is not null)""")(
    lambda s, d: notes.footnote_gaps(documents(s, d).where("text is not null"), r"([a-z]+)\.", r"\n([a-z]+)"))
N = lambda p: f"len(regexp_extract_all(text, '{p}'))"
query("text_signals", f"""select doc_id as id, {N('[0-9]+(?:[.,][0-9]+)*')} as numbers, {N('(?m)^[ \\t]*\\|.*\\|[ \\t]*$')} as table_rows, {N('(?m)^[A-Z][A-Z ]{2,}:')} as labels, {N('(?i)\\b(?:however|although|but|except|unless)\\b[^.!?\\n]*[.!?]')} as caveats,
{N('(?i)\\b(?:because|therefore|since|thus|hence)\\b[^.!?\\n]*[.!?]')} as reasons, {N('[A-Z][a-z]+(?: [A-Z][a-z]+)+')} as names from documents where text is not null""")(lambda s, d: notes.signals(documents(s, d).where("text is not null")))
query("kebab_overlap", f"""select doc_id as id, len(list_filter(list_distinct(list_concat(t, flatten(list_transform(t, lambda w: string_split(w, '-'))))), lambda w: w <> '' and w not in ({STOPS}))) as n from (select doc_id, {TOK.format('text')} as t from documents where text is not null)""")(
    lambda s, d: documents(s, d).where("text is not null").select("id", F.size(notes.kebab_tokens(F.col("text"), corpus.STOP)).cast("long").alias("n")))
query("substantive_words", f"""select id, len(list_filter({TOK.format("regexp_replace(text, '(?m)^#+ +', '', 'g')")}, lambda w: length(w) >= 4)) as n from md0""", "md0 as (select doc_id as id, '## Part' || chr(10) || text || chr(10) || 'see other here' as text from documents where text is not null)")(
    lambda s, d: documents(s, d).where("text is not null").select("id", notes.substantive_words(F.concat(F.lit("## Part\n"), "text", F.lit("\nsee [[page|other]] [here](http://x.y/long-target) `code words` ```more code```"))).alias("n")))
query("number_tokens", "select o_orderkey as id, round(floor(o_totalprice) + 0.5, 1) * case o_orderkey % 4 when 0 then 1 when 1 then 1e3 when 2 then 1e6 else 1e9 end as v, 2 as n, case when o_orderkey % 3 = 0 then 'BRL' when o_orderkey % 3 = 1 then 'USD' else 'EUR' end as currency from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "R$ ").when(F.col("o_orderkey") % 3 == 1, "US$ ").otherwise("€"), F.format_number(F.floor("o_totalprice").cast("double") + 0.5, 1), F.element_at(F.array(F.lit(" kg"), F.lit("k"), F.lit(" million"), F.lit(" bn")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(" in 1999")).alias("t"))
    .select("id", notes.number_tokens(F.col("t"))[0].alias("v"), F.size(notes.number_tokens(F.col("t"))).alias("n"), notes.currency_of(F.col("t")).alias("currency")))
query("doi_extraction", "select doc_id as id, '10.1000/abc' || doc_id as first, 2 as n from documents")(
    lambda s, d: documents(s, d).select("id", notes.dois(F.concat(F.lit("See https://doi.org/10.1000/ABC"), F.col("id"), F.lit(", again 10.1000/abc"), F.col("id"), F.lit(". Also (10.99999/x_y).\nEnd"))).alias("d")).select("id", F.col("d")[0].alias("first"), F.size("d").alias("n")))
query("displayed_numbers", """select l_linenumber as k, count(*) as n, sum(length(case when abs(l_quantity / 4) >= 10 then format('{:.0f}', round(l_quantity / 4)) else regexp_replace(format('{:.1f}', round(l_quantity / 4, 1)), '[.]0$', '') end))::bigint as chars, cast(sum(cast(case when abs(l_quantity / 4) >= 10 then round(cast(l_quantity / 4 as decimal(18,4))) else round(cast(l_quantity / 4 as decimal(18,4)), 1) end as decimal(18,1))) as double) as shown, sum(case when l_discount = 0 then 3 else length(printf('%+.1f%%', round(l_discount * 1000) / 10)) end)::bigint as deltas from lineitem group by 1""")(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(notes.display(F.col("l_quantity") / 4))).alias("chars"), F.sum(notes.display(F.col("l_quantity") / 4).cast("decimal(18,1)")).cast("double").alias("shown"), F.sum(F.when(F.col("l_discount") == 0, 3).otherwise(F.length(notes.delta(F.lit(1.0), 1 + F.col("l_discount"))))).alias("deltas")))
query("published_dates", """select cast(p as varchar) as day, count(*) as n from (select case o_orderkey % 5 when 0 then cast(o_orderdate as date) when 1 then date_trunc('month', cast(o_orderdate as date))::date when 2 then date_trunc('year', cast(o_orderdate as date))::date end as p from orders) group by p""")(
    lambda s, d: (lambda k, t: table(s, d, "orders").select(notes.published(F.when(k % 5 == 0, F.date_format(t, "yyyy-MM-dd'T'HH")).when(k % 5 == 1, F.date_format(t, "yyyy-MM")).when(k % 5 == 2, F.date_format(t, " yyyy")).when(k % 5 == 3, F.lit("1750-01-01")).otherwise("soon")).alias("p")).groupBy(F.col("p").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")))(F.col("o_orderkey"), F.col("o_orderdate")))
query("filings_from_arrays", "select l_orderkey as id, cast(cast(l_shipdate as date) as varchar) as date, l_returnflag as form, l_quantity as value from lineitem where l_returnflag in ('A', 'R')")(
    lambda s, d: notes.parallel_arrays(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), "l_returnflag", "l_quantity")).alias("x")).select(
        "id", F.to_json(F.struct(F.col("x.d").alias("date"), F.col("x.l_returnflag").alias("form"), F.col("x.l_quantity").alias("value"))).alias("json")), ("A", "R")).withColumn("date", F.col("date").cast("string")))
query("fact_durations", "select l_returnflag as concept, case when n between 80 and 100 then 'quarterly' when n between 350 and 380 then 'annual' end as kind, count(*) as n, cast(sum(cast(l_quantity as bigint)) as double) as value from (select *, cast(l_shipdate as date) - cast(o_orderdate as date) as n from lineitem join orders on l_orderkey = o_orderkey) group by 1, 2")(
    lambda s, d: notes.fact_durations(
        table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_orderkey").alias("id"), "l_returnflag").agg(F.collect_list(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"), F.col("l_quantity").alias("val"))).alias("units"))
        .groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("units").alias("u"))))).alias("json"))).groupBy("concept", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))
