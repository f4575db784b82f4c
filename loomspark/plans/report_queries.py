"""Reports, paging, gold questions, briefs and small set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import parse, text
from loomspark.operators import evaluation, gold, graph, ingest, retrieval, workflow
from loomspark.plans.registry import Tables, collector
from loomspark.plans.text_queries import SYLLABLES
from loomspark.plans.training_queries import _UNITS, _units

QUERIES, ORACLE_SQL, query = collector()


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def paging(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("select doc_id, quality, toxic from labels where toxic = 1 order by quality, doc_id limit 40")
def review_queue(t: Tables):
    return t.labels.where("toxic = 1").select("doc_id", "quality", "toxic").orderBy("quality", "doc_id").limit(40)


@query("with e as (select case when event_type = 'error' then 'no_source_row' when value is null or value < 1 then 'missing_provenance' end as c from events), g as (select c, count(*) as n from e where c is not null group by 1) select string_agg(c || '=' || n, ';' order by c) as summary, sum(n)::bigint as total from g")
def error_histogram(t: Tables):
    found = ingest.error_summary(ingest.with_error(t.events, [("no_source_row", F.col("event_type") == "error"), ("missing_provenance", F.col("value").isNull() | (F.col("value") < 1))]))
    line = F.array_sort(F.collect_list(F.concat_ws("=", "error_code", F.col("n").cast("string"))))
    return found.agg(F.array_join(line, ";").alias("summary"), F.sum("n").alias("total"))


@query("select 'documents:' || lang as key, count(*) as n from documents group by lang union all select 'vectors', count(*) from embeddings union all select 'vectors:' || label, count(*) from embeddings group by label")
def retrieval_stats(t: Tables):
    by = lambda df, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return by(t.documents, F.concat(F.lit("documents:"), "lang")).unionByName(by(t.embeddings, F.lit("vectors"))).unionByName(by(t.embeddings, F.concat(F.lit("vectors:"), F.col("label").cast("string"))))


@query("select event_type, arg_max(user_id, struct_pack(a := v, b := -user_id)) as best, arg_min(user_id, struct_pack(a := v, b := user_id)) as worst from (select event_type, user_id, round(avg(value), 6) as v from events group by all) group by event_type")
def best_config(t: Tables):
    means = t.events.groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    return means.groupBy("event_type").agg(F.max_by("user_id", F.struct("v", -F.col("user_id"))).alias("best"), F.min_by("user_id", F.struct("v", "user_id")).alias("worst"))


@query("with s as (select source, count(*) as n from documents group by 1 order by n desc, source limit 12), r as (select *, row_number() over (order by n desc, source) - 1 as i from s) select source, i::int as brief_no, ['facebook','zalo','website','email'][i % 4 + 1] as channel, ['first_home','investor','family'][i % 3 + 1] as persona from r")
def brief_selection(t: Tables):
    top = t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)
    return workflow.cycled(top.withColumn("o", F.struct(-F.col("n"), "source")), "o").select("source", "brief_no", "channel", "persona")


@query(f"select item_id, array_to_string(list_filter(s, lambda t, i: length(t) > 1 and list_position(s, t) = i), ' | ') as q from (select item_id, {SYLLABLES.format('text')} as s from benchmark)")
def or_query_terms(t: Tables):
    """Terms in the order of their first occurrences."""
    return t.benchmark.select("item_id", retrieval.or_query(F.col("text")).alias("q"))


@query("select p_partkey, array_to_string(list_transform(str_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as name, concat_ws(' · ', 'Dự án ' || p_name, nullif(p_brand, ''), p_type) as header from part")
def names_and_headers(t: Tables):
    return t.part.select("p_partkey", parse.slug_name(F.translate("p_name", " ", "-")).alias("name"), F.concat_ws(" · ", F.concat(F.lit("Dự án "), "p_name"), F.nullif("p_brand", F.lit("")), "p_type").alias("header"))


@query("select doc_id, trim(substr(text, greatest(1, p - 40), least(length(text), p - 1 + 7 + 40) - greatest(0, p - 41)), ' ') as snippet from (select doc_id, text, strpos(text, 'License') as p from documents) where p > 0")
def evidence_snippets(t: Tables):
    at = F.locate("License", F.col("text")) - 1
    return t.documents.where(F.col("text").contains("License")).select("doc_id", text.evidence(F.col("text"), at, at + 7).alias("snippet"))


@query("with a as (select user_id, list_distinct(list(event_type) filter (event_id % 2 = 0)) as x, list_distinct(list(event_type) filter (event_id % 2 = 1)) as y from events group by 1) select user_id, coalesce(array_to_string(list_sort(list_intersect(x, y)), ','), '') as both_types, coalesce(array_to_string(list_sort(list_distinct(list_concat(x, y))), ','), '') as any_type from a")
def set_operations(t: Tables):
    some = lambda k: F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type")))
    sets = t.events.groupBy("user_id").agg(some(0).alias("x"), some(1).alias("y"))
    line = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select("user_id", line(F.array_intersect("x", "y")).alias("both_types"), line(F.array_union("x", "y")).alias("any_type"))


_BAND = "case when o_totalprice * 3e4 < 2e9 then 'dưới 2 tỷ' when o_totalprice * 3e4 < 3e9 then 'từ 2 đến 3 tỷ' when o_totalprice * 3e4 < 5e9 then 'từ 3 đến 5 tỷ' when o_totalprice * 3e4 < 1e10 then 'từ 5 đến 10 tỷ' else 'trên 10 tỷ' end"


@query(f"with o as (select o_orderpriority as place, {_BAND} as band, o_orderkey, o_orderstatus from orders), g as (select place, band, count(*) as n, list(o_orderkey order by o_orderkey) as ids, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as projects from o group by all having count(*) >= 3), r as (select *, row_number() over (order by n desc, place, band) as i, 'Có nhà nào ở ' || place || ' tầm giá ' || band || ' không?' as question from g) select 'hard_budget' as query_type, substr(sha256('hard_budget|' || question), 1, 32) as query_key, question, len(ids)::int as n_expected, ids[1] as first_id, projects from r where i <= 12")
def gold_budget_questions(t: Tables):
    rows = t.orders.select(F.col("o_orderpriority").alias("place"), evaluation.price_band(F.col("o_totalprice"), 3e4).alias("band"), "o_orderkey", "o_orderstatus")
    asked = F.concat(F.lit("Có nhà nào ở "), "place", F.lit(" tầm giá "), "band", F.lit(" không?"))
    made = gold.grouped(rows, ["place", "band"], "o_orderkey", "o_orderstatus", "hard_budget", asked)
    return made.select("query_type", "query_key", "question", F.size("expected_ids").alias("n_expected"), F.col("expected_ids")[0].alias("first_id"), F.array_join("expected_projects", ",").alias("projects"))


@query("with a as (select p_brand, p_type, arg_min(p_retailprice, p_partkey) as anchor from part group by all), m as (select p.p_brand, p.p_type, p_partkey, anchor from part p join a using (p_brand, p_type) where abs(p_retailprice - anchor) <= 0.15::double * anchor), g as (select p_brand, p_type, anchor, count(*) as n, min(p_partkey) as first_id from m group by all having count(*) >= 3), r as (select *, row_number() over (order by n desc, p_brand, p_type, anchor) as i from g) select p_brand || '/' || p_type as question, n::int as n_expected, first_id from r where i <= 12")
def gold_attribute_questions(t: Tables):
    near = gold.near_anchor(t.part, ["p_brand", "p_type"], "p_partkey", "p_retailprice")
    made = gold.grouped(near, ["p_brand", "p_type", "anchor"], "p_partkey", None, "hard_attribute", F.concat_ws("/", "p_brand", "p_type"))
    return made.select("question", F.size("expected_ids").alias("n_expected"), F.col("expected_ids")[0].alias("first_id"))


@query("with e as (select 'b' || s_suppkey as src, 'p' || s_nationkey as dst, 'PART_OF' as ty from supplier where s_suppkey % 3 = 0 union all select distinct 'b' || l_suppkey, 'u' || (l_linenumber % 3), 'HAS_UNIT_TYPE' from lineitem where l_suppkey % 3 = 0 union all select 'p' || n_nationkey, 'u' || (n_nationkey % 4), 'HAS_UNIT_TYPE' from nation) select a.dst as project, a.src as building, b.dst as unit, 2 as depth from e a join e b on b.src = a.src and b.ty = 'HAS_UNIT_TYPE' where a.ty = 'PART_OF' union all select src, null, dst, 1 from e where ty = 'HAS_UNIT_TYPE' and src in (select dst from e where ty = 'PART_OF')")
def project_unit_paths(t: Tables):
    node = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    built = t.supplier.where("s_suppkey % 3 = 0").select(node("b", F.col("s_suppkey")).alias("src"), node("p", F.col("s_nationkey")).alias("dst"), F.lit("PART_OF").alias("edge_type"))
    units = t.lineitem.where("l_suppkey % 3 = 0").select(node("b", F.col("l_suppkey")).alias("src"), node("u", F.col("l_linenumber") % 3).alias("dst"), F.lit("HAS_UNIT_TYPE").alias("edge_type")).distinct()
    own = t.nation.select(node("p", F.col("n_nationkey")).alias("src"), node("u", F.col("n_nationkey") % 4).alias("dst"), F.lit("HAS_UNIT_TYPE").alias("edge_type"))
    return graph.unit_paths(built.unionByName(units).unionByName(own))


@query("select 'n' || n_nationkey as node_id, n_name as name, n_regionkey::bigint as support from nation where n_nationkey in (select s_nationkey from supplier) and lower(n_name) like '%ti_n%' order by support desc, name limit 5")
def entity_listing(t: Tables):
    nodes = t.nation.select(F.expr("'n' || n_nationkey").alias("node_id"), F.lit("Project").alias("entity_type"), F.col("n_name").alias("canonical_key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("support"))
    edges = t.supplier.select(F.expr("'s' || s_suppkey").alias("src"), F.expr("'n' || s_nationkey").alias("dst"), F.lit("PART_OF").alias("edge_type"))
    return graph.listed(nodes, edges, "Project", "TI_N", True, 5).select("node_id", "name", "support")


@query("with p as (select 1 as depth, ['IN'] as types, ['s' || s_suppkey, 'n' || s_nationkey] as nodes from supplier union all select 2, ['IN', 'OF'], ['s' || s_suppkey, 'n' || s_nationkey, 'r' || n_regionkey] from supplier join nation on n_nationkey = s_nationkey) select depth, array_to_string(types, '>') as types, array_to_string(nodes, '>') as nodes from p order by p.depth, p.types, p.nodes limit 40")
def path_order(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    one = s.select(F.lit(1).alias("depth"), F.array(F.lit("IN")).alias("types"), F.array(node("s", "s_suppkey"), node("n", "s_nationkey")).alias("nodes"))
    two = s.select(F.lit(2).alias("depth"), F.array(F.lit("IN"), F.lit("OF")).alias("types"), F.array(node("s", "s_suppkey"), node("n", "s_nationkey"), node("r", "n_regionkey")).alias("nodes"))
    return graph.in_order(one.unionByName(two), 40).select("depth", F.array_join("types", ">").alias("types"), F.array_join("nodes", ">").alias("nodes"))


@query(f"with {_UNITS} select doc_id, case when doc_id % 3 = 0 then 'project' else 'cluster' end as unit_type, split from documents join us on us.unit_type = case when doc_id % 3 = 0 then 'project' else 'cluster' end and us.unit_key = case when doc_id % 3 = 0 then source else cast(doc_id // 2 as varchar) end")
def split_of_listing(t: Tables):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("project"), F.expr("doc_id div 2").alias("cluster"))
    return evaluation.split_of_rows(rows, _units(t), "project", "cluster").select("doc_id", "unit_type", "split")


@query("select doc_id as id, case when doc_id % 2 = 0 then 'train' else 'validation' end as split, case when length(text) not between 140 and 4000 then 'length' when doc_id % 5 < 3 then 'few_facts' when doc_id % 7 > 5 then 'unsupported' when doc_id % 11 = 0 then 'forbidden' end as reason, 'system:sys|user:u' || doc_id || '|assistant:HEADLINE: h' || chr(10) || 'BODY:' || chr(10) || text || chr(10) || 'CTA: c' as messages from documents")
def chat_samples(t: Tables):
    i = F.col("doc_id")
    rows = t.documents.select(i.alias("id"), F.when(i % 2 == 0, "train").otherwise("validation").alias("split"), F.concat(F.lit("u"), i.cast("string")).alias("user"), F.lit("h").alias("headline"), F.col("text").alias("body"), F.lit("c").alias("cta"), (i % 5).alias("n_facts"), (i % 7 > 5).cast("double").alias("rate"), (i % 11 == 0).cast("int").alias("n_forbidden"))
    return workflow.samples(rows, "sys").withColumn("messages", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))


@query("select conv_id, turn, to_json({'role': role, 'n': length(text)}) as packed, [role, cast(turn as varchar)] as pair from conversations")
def packed_rows(t: Tables):
    """Rows packed for an interface: an object and a list of each."""
    c = t.conversations
    return c.select("conv_id", "turn", F.to_json(F.struct("role", F.length("text").alias("n"))).alias("packed"), F.array("role", F.col("turn").cast("string")).alias("pair"))
