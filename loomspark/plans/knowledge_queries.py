"""Gold questions, reports, contexts, prompts and experiments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import embed, evaluation, experiments, generation, gold, ingest, reports, retrieval, workflow
from loomspark.plans import retrieval_queries as rq
from loomspark.plans.registry import Tables, collector
from loomspark.plans.training_queries import SALT, _split_sql

QUERIES, ORACLE_SQL, query = collector()

#: Orders as listings.
_LISTINGS = f"""li as (select *, {_split_sql("'project:' || project")} as split from (select o_orderkey as id, case when o_orderkey % 17 <> 0 then 'pr-' || (o_custkey % 40) end as project, case when o_custkey % 40 % 3 <> 0 then 'Project ' || (o_custkey % 40) end as name,
case when o_orderkey % 11 <> 0 then round(o_totalprice) * 100000 end as price, (o_orderkey % 4)::int as bedrooms, case o_custkey % 9 when 0 then '12' when 1 then null else 'phuong-' || (o_custkey % 9) end as ward,
case when o_custkey % 5 <> 0 then o_orderpriority end as district, case when o_custkey % 7 <> 0 then 'City ' || (o_custkey % 40 % 3) end as city, case when o_custkey % 40 % 4 = 0 and o_orderkey % 3 = 0 then 'T' || (o_orderkey % 5) end as building,
case when o_orderkey % 2 = 0 then 'PHƯỜNG ' || (o_custkey % 9) end as ward_name from orders))"""


def _listings(t: Tables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pn = cust % 40
    text = lambda label, n: F.concat(F.lit(label), n.cast("string"))
    rows = t.orders.select(
        key.alias("id"), F.when(key % 17 != 0, text("pr-", pn)).alias("project"), F.when(pn % 3 != 0, text("Project ", pn)).alias("name"), F.when(key % 11 != 0, F.round("o_totalprice") * 100000).alias("price"),
        (key % 4).cast("int").alias("bedrooms"), F.when(cust % 9 == 0, "12").when(cust % 9 != 1, text("phuong-", cust % 9)).alias("ward"), F.when(cust % 5 != 0, F.col("o_orderpriority")).alias("district"),
        F.when(cust % 7 != 0, text("City ", pn % 3)).alias("city"), F.when((pn % 4 == 0) & (key % 3 == 0), text("T", key % 5)).alias("building"), F.when(key % 2 == 0, text("PHƯỜNG ", cust % 9)).alias("ward_name"),
    )
    return rows.withColumn("split", F.when(F.col("project").isNotNull(), evaluation.split_of(F.concat(F.lit("project:"), "project"), SALT)))


_TOP = "order by n desc, project limit 12"
_STANDARD = f"""with {_LISTINGS}, tr as (select * from li where project is not null and split = 'test'),
bd as (select project, list_sort(list(distinct 'Tòa ' || building)) as b from li where building is not null and project is not null group by 1),
f as (select project, n, coalesce(name, 'Pr ' || substr(project, 4)) as name, rooms, np, pl, wi, city, b from (select project, count(*) as n, arg_min(name, id) filter (name is not null) as name, arg_min(bedrooms, id) filter (price is not null and price <> 0 and bedrooms <> 0) as rooms, count(*) filter (price is not null and price <> 0) as np,
  arg_min(struct_pack(ward := ward, district := district), id) filter (ward is not null or district is not null) as pl, arg_min(struct_pack(district := district, city := city), id) filter (district is not null and city is not null) as wi, arg_min(city, id) filter (city is not null) as city from tr group by 1) left join bd using (project)),
o as (select *, row_number() over (partition by city order by n desc, project) - 1 as i from f where city is not null),
pt as (select project, bedrooms, count(distinct round_even(price, 0)) as k, string_agg(distinct replace(printf('%.2f tỷ', price / 1e9), '.00', ''), ', ' order by replace(printf('%.2f tỷ', price / 1e9), '.00', '')) as prices from tr where price is not null and price <> 0 and bedrooms <> 0 group by all),
cf as (select project, min(bedrooms) as bedrooms, arg_min(prices, bedrooms) as prices from pt where k > 1 group by 1),
qs as (
  select 'fact' as query_type, 'Căn ' || rooms || ' phòng ngủ tại dự án ' || name || ' giá bao nhiêu?' as question, project, [project] as ents, [project] as ofs, 'rooms' as mode, rooms from (select * from f where rooms is not null {_TOP}) union all
  select 'one_hop', 'Dự án ' || name || ' nằm ở khu vực nào?', project, [project, coalesce(pl.district, 'Phuong ' || substr(pl.ward, 8))], [project], 'all', null from (select * from f where pl is not null {_TOP}) union all
  select 'two_hop', case when b is not null then 'Dự án ' || name || ' có những tòa nào và mỗi tòa có loại căn gì?' else 'Dự án ' || name || ' thuộc quận nào của tỉnh/thành nào?' end, project, case when b is not null then list_concat([project], b) else [project, wi.district, wi.city] end, [project], case when b is not null then 'building' else 'all' end, null from (select * from f where b is not null or wi is not null {_TOP}) union all
  select 'temporal', 'Thông tin giá của dự án ' || name || ' được ghi nhận vào thời điểm nào và còn hiệu lực không?', project, [project], [project], 'priced', null from (select * from f where np > 0 {_TOP}) union all
  select 'compare', 'So sánh giá và diện tích căn hộ giữa dự án ' || an || ' và dự án ' || bn || ' tại ' || city || '.', a, [a, b], [a, b], 'all', null from (select x.city, x.project as a, x.name as an, y.project as b, y.name as bn from o x join o y on x.city = y.city and y.i = x.i + 1 where x.i % 2 = 0 and (x.n >= 2 or y.n >= 2) order by x.city, x.i limit 12) union all
  select 'conflict', 'Căn ' || cf.bedrooms || ' phòng ngủ tại dự án ' || name || ' đang được rao ở nhiều mức giá (' || cf.prices || ') — dữ liệu nào là nguồn nào?', project, [project], [project], 'rooms', cf.bedrooms from (select * from f join cf using (project) {_TOP}) f join cf using (project)),
ms as (select query_type, question, list(id order by id) as ids from qs join tr on list_contains(ofs, tr.project) and case mode when 'rooms' then price is not null and price <> 0 and bedrooms = qs.rooms when 'priced' then price is not null and price <> 0 when 'building' then building is not null else true end group by all)
select qs.query_type, substr(sha256('v1|' || qs.query_type || '|' || qs.question), 1, 32) as query_key, qs.question, qs.project, coalesce(array_to_string(ids, ','), '') as ids, array_to_string(ents, '|') as entities, array_to_string(list_sort(list_distinct(list_concat([qs.project], list_filter(ents, lambda e: not contains(e, ' ') and e = lower(e) and e <> upper(e))))), '|') as projects from qs left join ms using (query_type, question)"""


def _standard(t: Tables):
    rows = _listings(t)
    built = rows.where("building is not null and project is not null").groupBy("project").agg(F.array_sort(F.collect_set(F.concat(F.lit("Tòa "), "building"))).alias("buildings"))
    return gold.standard(rows.where("project is not null and split = 'test'"), built)


@query(_STANDARD)
def gold_standard_questions(t: Tables):
    made = _standard(t)
    return made.select("query_type", "query_key", "question", "project", F.array_join("expected_ids", ",").alias("ids"), F.array_join("expected_entities", "|").alias("entities"), F.array_join("expected_projects", "|").alias("projects"))


@query(f"with {_LISTINGS}, g as (select ward, coalesce(district, '') as d, count(*) as n, arg_min(ward_name, id) filter (ward_name is not null) as w, array_to_string(list(id order by id), ',') as ids, array_to_string(list_sort(list_distinct(list(project) filter (project is not null))), '|') as projects from li where length(ward) >= 3 and not regexp_full_match(ward, '[0-9]+') group by all having count(*) >= 3 order by n desc, ward, d limit 12) select 'Đang rao bán những bất động sản nào ở ' || case when w is null then 'Phuong ' || substr(ward, 8) else 'Phường ' || substr(w, 8) end || case when d <> '' then ', ' || d else '' end || '?' as question, ids, projects from g")
def gold_location_questions(t: Tables):
    made = gold.located(_listings(t).select("id", "project", "ward", "district", "ward_name"))
    return made.select("question", F.array_join("expected_ids", ",").alias("ids"), F.array_join("expected_projects", "|").alias("projects"))


@query(_STANDARD.replace("select qs.query_type, substr(", "select measure, key, count(*) as n from (select qs.query_type, substr(", 1) + ") s, lateral (select unnest(['query_type', 'difficulty', 'needs_review']) as measure, unnest([s.query_type, 'standard', 'true']) as key) group by all")
def gold_counts(t: Tables):
    return gold.counts(_standard(t).withColumn("difficulty", F.lit("standard")).withColumn("needs_review", F.lit(True)))


#: A data-quality report: orders are listings, labels facts, events a quarantine, suppliers and nations a graph.
_REPORT = f"""with {_LISTINGS}, ls as (select *, id // 2 as cl, id % 2 = 0 as rep, case when price is null then null when price > 1e10 then 'A' else 'B' end as tier, district as kind, case when price is null then 'missing' else 'parsed' end as conf, case when id % 3 = 0 then [1] else [] end as am from li),
fields as (select count(*) as a, count(project) as project, count(ward) as ward, count(district) as district, count(city) as city, count(price) as price, count(*) filter (len(am) > 0) as amenities from ls),
cv as (select unnest(['project', 'ward', 'district', 'city', 'price', 'amenities']) as key, unnest([project, ward, district, city, price, amenities]) as n, a from fields),
rp(section, measure, key, n, pct) as (
select 'clean', 'total', '', count(*), null::double from ls union all select 'clean', 'tier', coalesce(tier, 'None'), count(*), null from ls group by tier union all select 'clean', 'property_type', coalesce(kind, 'None'), count(*), null from ls group by kind union all select 'clean', 'price_confidence', conf, count(*), null from ls group by conf union all
select 'clean', 'coverage', key, n, round_even(100.0::double * n / a, 1) from cv union all select 'dedup', 'clusters', '', count(distinct cl), null from ls union all select 'dedup', 'representatives', '', count(*) filter (rep), null from ls union all select 'dedup', 'duplicates', '', count(*) - count(*) filter (rep), null from ls union all
select 'quarantine', 'total', '', count(*), null from events where event_type = 'error' union all select 'quarantine', 'error_code', 'e' || event_id % 3, count(*), null from events where event_type = 'error' group by event_id % 3 union all
select 'facts', 'total', '', count(*), null from labels union all select 'facts', 'predicate', quality::varchar, count(*), null from labels group by quality union all select 'facts', 'needs_review', '', count(*) filter (toxic = 1), null from labels union all
select 'graph', 'entities', '', count(*), null from supplier union all select 'graph', 'entity_type', case when s_suppkey % 2 = 0 then 'Project' else 'Ward' end, count(*), null from supplier group by s_suppkey % 2 union all select 'graph', 'edges', '', count(*), null from nation union all select 'graph', 'edge_type', 'R' || n_regionkey, count(*), null from nation group by n_regionkey union all
(select 'graph', 'top_projects', s_name, s_nationkey::bigint, null from supplier where s_suppkey % 2 = 0 order by s_nationkey desc, s_name limit 10))"""


def _report(t: Tables):
    ls = _listings(t).select(
        "*", F.expr("id div 2").alias("dedup_cluster_id"), (F.col("id") % 2 == 0).alias("is_cluster_representative"), F.when(F.col("price") > 1e10, "A").when(F.col("price").isNotNull(), "B").alias("tier"), F.col("district").alias("property_type"),
        F.when(F.col("price").isNull(), "missing").otherwise("parsed").alias("price_confidence"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("amenities"),
    )
    errors = t.events.where("event_type = 'error'").select(F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")).alias("error_code"))
    facts = t.labels.select(F.col("quality").cast("string").alias("predicate"), (F.col("toxic") == 1).alias("needs_review"))
    nodes = t.supplier.select(F.when(F.col("s_suppkey") % 2 == 0, "Project").otherwise("Ward").alias("entity_type"), F.col("s_name").alias("canonical_key"), F.col("s_nationkey").cast("long").alias("support"))
    edges = t.nation.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("edge_type"))
    return reports.quality_report(ls, errors, facts, nodes, edges, ("project", "ward", "district", "city", "price"), ("amenities",))


@query(_REPORT + " select * from rp")
def quality_report(t: Tables):
    return _report(t)


@query(_REPORT + f", un as (select project, count(*) as n, {_split_sql("'project:' || project")} as split from li where project is not null group by 1), lk as (select city from li where split is not null and city is not null group by 1 having count(distinct split) > 1) select * from rp union all select 'splits', 'units', split, count(*), null from un group by split union all select 'splits', 'listings', split, sum(n)::bigint, null from un group by split union all select 'leakage', 'groups', '', count(*), null from lk union all select 'gold_queries', 'by_type', event_type, count(*), null from events group by event_type union all select 'chunks', 'total', '', count(*), null from documents union all select 'chunks', 'embedded', '', count(*), null from documents join embeddings on vec_id = doc_id")
def data_card(t: Tables):
    rows = _listings(t).where("project is not null")
    splits = rows.groupBy("project", "split").agg(F.count("*").alias("n")).groupBy("split").agg(F.count("*").alias("units"), F.sum("n").alias("listings"))
    chunks = t.documents.select(F.col("doc_id").alias("vec_id")).join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left")
    return reports.data_card(_report(t), splits, evaluation.leaking(rows, "city"), t.events.select(F.col("event_type").alias("query_type")), chunks)


@query("select doc_id, source, lang from documents where source = 'src3' and lang = 'en'")
def tenant_scan(t: Tables):
    """Rows of a tenant that meet the optional conditions that are given."""
    return reports.conditions(reports.of_tenant(t.documents, "src3", "source").select("doc_id", "source", "lang"), lang="en", source=None)


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50)")
def point_lookups(t: Tables):
    wanted = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return reports.by_keys(t.orders, "o_orderkey", wanted).select("o_orderkey", "o_totalprice")


@query("select 'chunks' as \"table\", count(*) as deleted, 0 as place from documents where source = 'src3' union all select 'edges', count(*), 1 from events where event_type = 'click' and user_id % 3 = 0 union all select 'listings', count(*), 2 from orders where o_orderstatus = 'F'")
def cascade_delete(t: Tables):
    tables = {
        "chunks": t.documents.withColumn("tenant_id", F.when(F.col("source") == "src3", "a").otherwise("b")),
        "edges": t.events.withColumn("tenant_id", F.when((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), "a").otherwise("b")),
        "listings": t.orders.withColumn("tenant_id", F.when(F.col("o_orderstatus") == "F", "a").otherwise("b")),
    }
    return reports.cascade(tables, "a")[1]


@query("""
with o as (select s_name as k, s_nationkey as v from supplier where s_suppkey % 7 <> 0), n as (select s_name as k, case when s_suppkey % 5 = 0 then -1 else s_nationkey end as v from supplier where s_suppkey % 6 <> 0),
c as (select case when o.k is null then 'insert' when n.k is null then 'delete' when o.v = n.v then 'unchanged' else 'update' end as change from o full join n on o.k = n.k) select change, count(*) as n from c group by 1
""")
def graph_diff(t: Tables):
    """What a rebuild of the graph changes: nodes inserted, updated, unchanged and deleted."""
    old = t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_name").alias("canonical_key"), F.col("s_nationkey").alias("support"))
    new = t.supplier.where("s_suppkey % 6 <> 0").select(F.col("s_name").alias("canonical_key"), F.when(F.col("s_suppkey") % 5 == 0, -1).otherwise(F.col("s_nationkey")).alias("support"))
    return ingest.changes(old, new, ["canonical_key"], ["support"]).groupBy("change").agg(F.count("*").alias("n"))


#: Facts of the documents.
_FACTS = """fx as (select doc_id * 10 as fact_id, doc_id as listing, 'total_price_vnd' as predicate, n_chars::varchar as value_text, n_chars * 1e6::double as value_num, case when doc_id % 3 = 0 then '2024-12-31' end as valid_to, case when doc_id % 2 = 0 then 'u/' || doc_id else '' end as source_url from documents union all
select doc_id * 10 + 1, doc_id, 'area_m2', (n_chars // 10)::varchar, (n_chars // 10)::double, null, '' from documents union all select doc_id * 10 + 2, doc_id, 'city', lang, null, null, null from documents union all select doc_id * 10 + 3, doc_id, 'amenity', case when doc_id % 4 = 0 then 'ho_boi' else 'other' end, null, null, null from documents where doc_id % 2 = 0)"""
_PRICE = "case when value_num >= 1e9 then regexp_replace(regexp_replace(printf('%.2f', value_num / 1e9), '0+$', ''), '\\.$', '') || ' tỷ' else printf('%.0f', value_num / 1e6) || ' triệu' end"
_LABEL = "case predicate when 'total_price_vnd' then 'Giá' when 'area_m2' then 'Diện tích' when 'city' then 'Tỉnh/thành' when 'amenity' then 'Tiện ích' end"
_LINE = f"'- ' || {_LABEL} || ': ' || case when predicate = 'total_price_vnd' and value_num <> 0 then {_PRICE} when value_text = 'ho_boi' then 'hồ bơi' else value_text end || case when valid_to is not null then ' [hiệu lực đến ' || valid_to || ']' else '' end || case when coalesce(source_url, '') <> '' then ' (nguồn: ' || source_url || ')' else '' end"
_KCTX = 5
_CONTEXT = f"""{rq._BM25}, {_FACTS}, rs as (select query_id, id, rank, case when rank = 2 then 'p ' || id end as path from bm where rank <= {_KCTX}),
fl as (select query_id, fact_id, {_LINE} as line, row_number() over (partition by query_id order by predicate, fact_id) as i from (select distinct query_id, id from rs) join fx on listing = id),
fk as (select query_id, list(fact_id order by i) as fact_ids, list(line order by i) as lines from fl where i <= 20 group by 1),
sn as (select query_id, list('- Trích tin đăng: ' || replace(substr(text, 1, 500), chr(10), ' ') || ' (nguồn: s/' || id || ')' order by rank) as lines from rs join documents on doc_id = id group by 1),
pa as (select query_id, list('- Quan hệ trong knowledge graph: ' || path order by rank) as lines from rs where path is not null group by 1),
ct as (select query_id, fact_ids, array_to_string(list_concat(list_concat(coalesce(fk.lines, []), sn.lines), coalesce(pa.lines, [])), chr(10)) as context from sn left join fk using (query_id) left join pa using (query_id))"""


def _facts(t: Tables):
    d, i, n = t.documents, F.col("doc_id"), F.col("n_chars")
    none, text = F.lit(None).cast("string"), lambda c: c.cast("string")
    fact = lambda k, p, v, num, to, url: F.struct((i * 10 + k).alias("fact_id"), i.alias("listing"), F.lit(p).alias("predicate"), v.alias("value_text"), num.cast("double").alias("value_num"), to.alias("valid_to"), url.alias("source_url"))
    made = [
        fact(0, "total_price_vnd", text(n), n * 1e6, F.when(i % 3 == 0, "2024-12-31"), F.when(i % 2 == 0, F.concat(F.lit("u/"), text(i))).otherwise("")), fact(1, "area_m2", text(F.expr("n_chars div 10")), F.expr("n_chars div 10"), none, F.lit("")),
        fact(2, "city", F.col("lang"), none, none, none), fact(3, "amenity", F.when(i % 4 == 0, "ho_boi").otherwise("other"), none, none, none),
    ]
    return d.select(F.explode(F.array(*made)).alias("f")).select("f.*").where("predicate <> 'amenity' or listing % 2 = 0")


def _context(t: Tables):
    found = retrieval.bm25_index(rq._index(t), rq._questions(t), _KCTX).withColumn("path", F.when(F.col("rank") == 2, F.concat(F.lit("p "), F.col("id").cast("string"))))
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("listing"), "text", F.concat(F.lit("s/"), F.col("doc_id").cast("string")).alias("source_url"))
    return generation.contexts(found, chunks, _facts(t), _KCTX)


@query(f"with {_FACTS} select fact_id, {_LINE} as line, {_LABEL} || ': ' || case when value_text = 'ho_boi' then 'hồ bơi' else value_text end as payload from fx")
def fact_lines(t: Tables):
    line = generation.fact_line(*[F.col(c) for c in ("predicate", "value_text", "value_num", "valid_to", "source_url")])
    return _facts(t).select("fact_id", line.alias("line"), generation.fact_payload(F.col("predicate"), F.col("value_text")).alias("payload"))


@query(f"with {_CONTEXT} select query_id, array_to_string(fact_ids, ',') as facts, context from ct")
def assemble_context(t: Tables):
    return _context(t).select("query_id", F.array_join("fact_ids", ",").alias("facts"), "context")


_CHANNEL_SQL = lambda i: "case channel " + " ".join(f"when '{c}' then '{spec[i] if i < 3 else '; '.join(spec[3])}'" for c, spec in generation.CHANNELS.items()) + " end"
_PROMPT = f"""pr as (select *, concat_ws(chr(10), 'Nhiệm vụ: viết ' || {_CHANNEL_SQL(0)} || '.', 'Độ dài: ' || {_CHANNEL_SQL(1)} || '–' || {_CHANNEL_SQL(2)} || ' từ.', 'Yêu cầu định dạng: ' || {_CHANNEL_SQL(3)} || '.', 'Khách hàng mục tiêu: ' || case persona {" ".join(f"when '{p}' then '{s}'" for p, s in generation.PERSONAS.items())} end || '.',
'Giọng thương hiệu: {generation.DEFAULT_TONE}.', 'Từ cấm dùng: {generation.DEFAULT_FORBIDDEN}.', '', 'Yêu cầu cụ thể: ' || brief, '', case when config in ('B', 'D') and coalesce(context, '') <> '' then 'Dữ kiện được truy xuất (chỉ dùng những dòng này làm thông tin thực tế):' || chr(10) || context else '{generation.NO_CONTEXT}' end) as prompt from br)"""
_RUNS = f"""with {_CONTEXT}, br as (select item_id as query_id, 'Giới thiệu ' || item_id as brief, (['description', 'facebook', 'email', 'landing_seo'])[item_id % 4 + 1] as channel, (['young_family', 'investor', 'first_home'])[item_id % 3 + 1] as persona, context, fact_ids, config from benchmark left join ct on query_id = item_id, (select unnest(['A', 'B', 'C', 'D']) as config)),
{_PROMPT}, ln as (select *, list_filter(list_transform(str_split(prompt, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as ls from pr), fs as (select *, list_filter(ls, lambda x: starts_with(x, '-'))[1:6] as fl from ln)
select config, case when config in ('C', 'D') then 'template-v1+ad' else 'template-v1' end as model_name, query_id, substr(sha256('sys' || chr(10) || '---' || chr(10) || prompt), 1, 32) as prompt_hash, '{generation.HEADLINE}' as headline, array_to_string(case when len(fl) > 0 then fl else ls[1:5] end, chr(10)) as body, '{generation.CALL}' as cta, coalesce(len(fact_ids), 0) as n_facts from fs"""


def _runs(t: Tables):
    n = F.col("item_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    briefs = t.benchmark.select(n.alias("query_id"), F.concat(F.lit("Giới thiệu "), n.cast("string")).alias("brief"), pick(generation.CHANNELS).alias("channel"), pick(generation.PERSONAS).alias("persona"))
    configs, _ = generation.available(("A", "B", "C", "D"), ["ad"])
    return generation.runs(briefs, _context(t), configs, "sys", {c: generation.resolve_adapter(c, ["ad"]) for c in configs})


@query(_RUNS)
def template_runs(t: Tables):
    return _runs(t).select("config", "model_name", "query_id", "prompt_hash", "headline", "body", "cta", F.coalesce(F.size("reference_fact_ids"), F.lit(0)).alias("n_facts").cast("long")).withColumn("n_facts", F.greatest("n_facts", F.lit(0)))


_ANSWER = "case turn % 4 when 0 then 'HEADLINE: ' || conv_id || chr(10) || 'BODY:' || chr(10) || text || chr(10) || 'CTA: call ' || turn when 1 then 'BODY : ' || text when 2 then '  ' || text || ' ' else 'HEADLINE:x' || chr(10) || 'CTA:  y ' end"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"with a as (select conv_id, turn, text, {_ANSWER} as answer from conversations), p as (select *, {_STRIP.format('case turn % 4 when 0 then text when 1 then text else chr(32) end')} as b from a) select conv_id, turn, case turn % 4 when 0 then conv_id::varchar when 3 then 'x' else '' end as headline, case when b <> '' then b else {_STRIP.format('answer')} end as body, case turn % 4 when 0 then 'call ' || turn when 3 then 'y' else '' end as cta from p")
def parse_output(t: Tables):
    text, nl = F.col("text"), F.lit("\n")
    s = lambda c: F.col(c).cast("string")
    answer = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("HEADLINE: "), s("conv_id"), nl, F.lit("BODY:"), nl, text, nl, F.lit("CTA: call "), s("turn"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("BODY : "), text))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("  "), text, F.lit(" "))).otherwise("HEADLINE:x\nCTA:  y ")
    )
    return t.conversations.select("conv_id", "turn", generation.parsed(answer).alias("p")).select("conv_id", "turn", "p.*")


@query(f"with {_FACTS}, r as (select doc_id as id, case doc_id % 3 when 0 then [doc_id * 10, doc_id * 10 + 1] when 1 then [] end as a, [doc_id * 10 + 2] as b from labels) select id, fact_id, predicate, value_text from (select id, unnest(case when len(coalesce(a, [])) > 0 then a else b end) as fact_id from r) join fx using (fact_id)")
def reference_facts(t: Tables):
    i = F.col("doc_id")
    records = t.labels.select(i.alias("id"), F.when(i % 3 == 0, F.array(i * 10, i * 10 + 1)).when(i % 3 == 1, F.array().cast("array<bigint>")).alias("reference_fact_ids"), F.array(i * 10 + 2).alias("context_fact_ids"))
    return generation.reference_facts(records, _facts(t)).select("id", "fact_id", "predicate", "value_text")


#: Documents as generated records of four configurations.
_RECORDS = """rc as (select (['A', 'B', 'C', 'D'])[doc_id % 4 + 1] as config, doc_id // 4 as brief_no, case when doc_id % 13 = 0 then 'failed' else 'done' end as status, case when doc_id % 5 = 0 then '' else 'h' end as headline, text as body, 'c' as cta, (['description', 'facebook', 'email', 'landing_seo'])[(doc_id // 4) % 4 + 1] as channel, (doc_id % 7) / 10.0::double as rate, doc_id % 9 as claims, doc_id % 3 as forbidden, n_chars % 600 as tokens, doc_id % 1000 as ms from documents),
im as (select *, case when status = 'done' then rate end as unsupported_claim_rate, case when status = 'done' then claims::double end as n_claims, case when status = 'done' then forbidden::double end as n_forbidden, case when status = 'done' then (headline <> '' and body <> '')::int::double end as structured_ok,
  case when status = 'done' then len(list_filter(regexp_split_to_array(headline || ' ' || body || ' ' || cta, '\\s+'), lambda x: x <> ''))::double end as words, case when status = 'done' then ms / 1000.0::double end as latency_s from rc),
it as (select *, case when status = 'done' and tokens < 512 then (case channel when 'description' then words between 180 and 260 when 'facebook' then words between 80 and 140 when 'email' then words between 120 and 200 else words between 250 and 400 end)::int::double end as length_ok from im)"""
_KEYS = ", ".join(experiments.MEASURES)


def _records(t: Tables):
    i = F.col("doc_id")
    return experiments.item_metrics(t.documents.select(
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (i % 4 + 1).cast("int")).alias("config"), F.expr("doc_id div 4").alias("brief_no"), F.when(i % 13 == 0, "failed").otherwise("done").alias("status"), F.when(i % 5 == 0, "").otherwise("h").alias("headline"), F.col("text").alias("body"), F.lit("c").alias("cta"),
        F.element_at(F.array(*[F.lit(c) for c in generation.CHANNELS]), F.expr("cast((doc_id div 4) % 4 + 1 as int)")).alias("channel"), ((i % 7) / F.lit(10.0)).alias("unsupported_rate"), (i % 9).alias("claims"), (i % 3).alias("forbidden"), (F.col("n_chars") % 600).alias("completion_tokens"), (i % 1000).alias("latency_ms"),
    ))


@query(f"with {_RECORDS} select config, brief_no, {_KEYS} from it")
def item_metrics(t: Tables):
    return _records(t).select("config", "brief_no", *experiments.MEASURES)


@query(f"with {_RECORDS} select config, count(*) filter (status = 'done') as n, count(*) filter (status <> 'done') as n_failed, " + ", ".join(f"round_even(avg({m}), 4) as {m}" for m in experiments.MEASURES) + ", count(length_ok) as length_ok_n, count(*) filter (unsupported_claim_rate > 0) as outputs_with_unsupported from it group by config")
def config_summary(t: Tables):
    return experiments.summarize(_records(t))


@query(f"with {_RECORDS} select config, count(*) as n, round_even(avg(unsupported_claim_rate), 4) as unsupported_claim_rate, round_even(avg(n_claims), 2) as claims_per_output, sum(n_forbidden)::bigint as forbidden_total, floor(avg(length(body)))::bigint as body_chars, round_even(avg(ms) / 1000, 1) as latency_s, count(*) filter (unsupported_claim_rate > 0) as outputs_with_unsupported from it where status = 'done' group by config")
def two_way_summary(t: Tables):
    return experiments.two_way(_records(t))


_PAIRED = f"""with {_RECORDS}, lg as (select config, brief_no, unnest({list(experiments.COMPARED)}) as metric, unnest([{', '.join(experiments.COMPARED)}]) as v from it), pl as (select * from (values {', '.join(f"('{a}→{b}', '{f}', '{a}', '{b}')" for a, b, f in experiments.PAIRS)}) p(pair, factor, l, r)),
pp as (select pair, factor, x.metric, x.brief_no, x.v as a, y.v as b from pl join lg x on x.config = l join lg y on y.config = r and y.metric = x.metric and y.brief_no = x.brief_no where x.v is not null and y.v is not null)"""


@query(_PAIRED + " select pair, factor, metric, count(*) as n, round_even(avg(a), 4) as mean_before, round_even(avg(b), 4) as mean_after, round_even(avg(b - a), 4) + 0.0 as mean_diff, count(*) filter (case when metric = 'unsupported_claim_rate' then b < a else b > a end) as wins, count(*) filter (case when metric = 'unsupported_claim_rate' then b > a else b < a end) as losses, count(*) filter (a = b) as ties, case when count(*) >= 2 and stddev_samp(b - a) > 0 then round_even(avg(b - a) / stddev_samp(b - a), 3) + 0.0 end as cohens_dz from pp group by pair, factor, metric")
def compare_all(t: Tables):
    return experiments.compare_all(_records(t))


@query()
def compare_tests(t: Tables):
    """Rows only: draws come from Spark's hash."""
    return experiments.compare_tests(_records(t))


@query(f"with {_LISTINGS}, g as (select project, count(*) as n, arg_min(name, id) filter (name is not null) as name, arg_min(bedrooms, id) filter (bedrooms <> 0) as rooms from li where split = 'test' and project is not null group by 1 order by n desc, project limit 12), r as (select *, (row_number() over (order by n desc, project) - 1)::int as brief_no from g) select project, brief_no, n, (['description', 'facebook', 'email', 'landing_seo'])[brief_no % 4 + 1] as channel, (['young_family', 'investor', 'first_home'])[brief_no % 3 + 1] as persona, 'Giới thiệu ' || case when rooms is not null then 'căn ' || rooms || ' phòng ngủ' else 'bất động sản' end || ' tại dự án ' || coalesce(name, project) as brief from r")
def pick_briefs(t: Tables):
    return experiments.pick_briefs(_listings(t), 12)


@query("select 'chunks' as key, count(*)::varchar as value from documents union all select 'facts', count(*)::varchar from labels union all select 'listings', count(*)::varchar from orders union all select 'prompt', 'prompt_v1' union all select 'weights', 'vector=1.0;bm25=0.6;graph=0.3'")
def run_snapshot(t: Tables):
    return experiments.snapshot({"chunks": t.documents, "facts": t.labels, "listings": t.orders}, {"prompt": "prompt_v1", "weights": ";".join(f"{k}={v}" for k, v in retrieval.DEFAULT_WEIGHTS.items())})


@query("""
with v as (select conv_id, max(turn) as version_no, arg_max(text, turn) as body, arg_max(role, turn) as role from conversations group by 1)
select conv_id, '# ' || case when conv_id % 2 = 0 then 'H' || conv_id else 'T' || conv_id end || chr(10) || chr(10) || left(body, 20) || chr(10) || chr(10) || case when conv_id % 3 = 0 then '' else '**call**' end || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- Truy vết (không đăng kèm) -->' || chr(10)
  || '- Nội dung: `' || conv_id || '` · phiên bản ' || version_no || ' · trạng thái approved' || chr(10) || '- Kênh: email · persona: investor · dự án: ' || case when conv_id % 5 = 0 then '—' else 'p' || conv_id end || chr(10) || '- Sinh bằng: cấu hình B · model `m`' || case when conv_id % 2 = 0 then '' else ' · adapter `ad`' end || chr(10)
  || '- Prompt version: prompt_v1' || chr(10) || '- Người biên tập sửa tay: ' || case when version_no > 2 then 'có' else 'không' end || chr(10) || '- Claim chưa có căn cứ: 1/' || version_no || chr(10) as page from v where role = 'assistant'
""")
def export_markdown(t: Tables):
    """Approved versions with their items: the latest version of each."""
    c, key = t.conversations, F.col("conv_id").cast("string")
    items = c.groupBy("conv_id").agg(F.count("*").alias("turns")).select("conv_id", F.concat(F.lit("T"), key).alias("title"), F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("p"), key)).alias("project"))
    found = workflow.approved(workflow.latest(c, "conv_id", "turn", ["text", "role"]).withColumn("status", F.when(F.col("role") == "assistant", "approved").otherwise("draft")), items, "conv_id")
    lit, col = F.lit, F.col
    page = generation.export_markdown({
        "id": col("conv_id"), "title": col("title"), "headline": F.when(col("conv_id") % 2 == 0, F.concat(lit("H"), key)), "body": F.substring("text", 1, 20), "cta": F.when(col("conv_id") % 3 != 0, "call"), "version_no": col("version"), "status": col("status"), "channel": lit("email"), "persona": lit("investor"),
        "project": col("project"), "config": lit("B"), "model_name": lit("m"), "adapter": F.when(col("conv_id") % 2 != 0, "ad"), "prompt_version": lit("prompt_v1"), "generation_id": lit(""), "edited": col("version") > 2, "n_unsupported": lit(1), "n_claims": col("version"),
    })
    return found.select("conv_id", page.alias("page"))


@query("with s as (select doc_id as id, source, (['facebook','zalo','website','email'])[n % 4 + 1] as channel, (['first_home','investor','family'])[n % 3 + 1] as persona, lang as tier from (select doc_id, source, lang, cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8) as bigint) as n from documents order by doc_id limit 1500) union all select conv_id, 'src1', 'zalo', 'family', 'en' from conversations where turn = 0), u as (select unnest(['channel', 'persona', 'tier']) as measure, unnest([channel, persona, tier]) as key from s) select measure, coalesce(key, 'None') as key, count(*) as n from u group by all union all select 'projects', '', count(distinct source) from s")
def sample_usage(t: Tables):
    """Samples from listings and from approved texts together, counted."""
    made = workflow.rotation(t.documents, "doc_id").join(t.documents.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("tier")), "id").select("id", "source", "channel", "persona", "tier")
    approved = t.conversations.where("turn = 0").select(F.col("conv_id").alias("id"), F.lit("src1").alias("source"), F.lit("zalo").alias("channel"), F.lit("family").alias("persona"), F.lit("en").alias("tier"))
    return reports.usage(made.unionByName(approved), ("channel", "persona", "tier"), "source")


@query("select event_id, array_to_string(list_sort(list_transform(map_entries(map_concat(map(['a', 'b'], [event_type, 'x']), map(['b'], [user_id::varchar]))), lambda e: e.key || '=' || e.value)), ';') as merged from events")
def merged_settings(t: Tables):
    both = reports.merged(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("x")), F.create_map(F.lit("b"), F.col("user_id").cast("string")))
    return t.events.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("merged"))


@query()
def hashed_embeddings(t: Tables):
    """Rows only: BLAKE2b has no SQL."""
    return embed.embed(t.documents.select(F.col("doc_id").alias("id"), "text"), 64)
