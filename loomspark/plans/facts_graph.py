"""Facts, chunks and the property graph, over parts, orders, nations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import facts, graph
from loomspark.plans.registry import Tables, collector

QUERIES, ORACLE_SQL, query = collector()


@query("""
with u as (
  select p_partkey as id, 'brand' as predicate, p_brand as value_text, null::double as value_num from part where p_brand <> '' union all
  select p_partkey, 'size', cast(p_size as varchar), p_size::double from part where p_size <> 0 union all
  select p_partkey, 'word', unnest(str_split(p_name, ' ')), null from part)
select id, predicate, value_text, value_num, sha256(concat_ws('|', cast(id as varchar), predicate, value_text)) as fact_key from u
""")
def facts_unpivot(t: Tables):
    part = t.part.withColumn("words", F.split("p_name", " "))
    return facts.keyed(facts.unpivot(part, "p_partkey", {"brand": "p_brand", "size": "p_size"}, {"word": "words"}))


def _candidates(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("Nation").alias("entity_type"), F.col("c_nationkey").cast("string").alias("canonical_key"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("attributes"), F.col("c_custkey").alias("listing_id")
    )


@query("""
with c as (select c_nationkey::varchar as canonical_key, c_mktsegment as name, count(*) as c from customer group by all)
select canonical_key, arg_min(name, struct_pack(a := -c, b := name)) as name, sum(c)::bigint as support, coalesce(array_to_string(list_slice(list(name order by c desc, name), 2, 99), '|'), '') as aliases from c group by canonical_key
""")
def majority_name(t: Tables):
    return graph.majority(_candidates(t), "canonical_key", "name").select("canonical_key", "name", "support", F.array_join("aliases", "|").alias("aliases"))


@query("""
with c as (select c_nationkey::varchar as k, c_mktsegment as name, count(*) as c from customer group by all),
n as (select k, (list(name order by c desc, name))[1] as name, sum(c)::bigint as support from c group by k),
a as (select c_nationkey::varchar as k, arg_min(c_acctbal, c_custkey) as attributes from customer group by 1)
select 'Nation' as entity_type, k as canonical_key, name, support, attributes from n join a using (k)
""")
def graph_nodes(t: Tables):
    return graph.nodes(_candidates(t)).drop("aliases")


@query("""
select 'n' || c_nationkey as src, 'm' || c_mktsegment as dst, 'HAS' as edge_type, count(*) as support, min(c_custkey) as evidence_id, arg_min(c_acctbal, c_custkey) as valid_from from customer group by all
""")
def graph_edges(t: Tables):
    rows = t.customer.select(F.expr("'n' || c_nationkey").alias("src"), F.expr("'m' || c_mktsegment").alias("dst"), F.lit("HAS").alias("edge_type"), F.col("c_custkey").alias("listing_id"), F.col("c_acctbal").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"))
    return graph.edges(rows).drop("valid_to")


def _places(t: Tables):
    nation = t.nation.select(F.expr("'n' || n_nationkey").alias("src"), F.expr("'r' || n_regionkey").alias("dst"), F.lit("PART_OF").alias("edge_type"))
    return nation.unionByName(t.supplier.select(F.expr("'s' || s_suppkey").alias("src"), F.expr("'n' || s_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("edge_type")))


_EDGES = "e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'PART_OF' as ty from nation union all select 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN' from supplier), adj as (select src as a, dst as b, ty from e union all select dst, src, ty from e)"


@query(f"with recursive {_EDGES}, p(start, node, depth, nodes, types) as (select 's' || s_suppkey, 's' || s_suppkey, 0, ['s' || s_suppkey], []::varchar[] from supplier where s_suppkey % 50 = 0 union all select p.start, adj.b, p.depth + 1, list_append(p.nodes, adj.b), list_append(p.types, adj.ty) from p join adj on adj.a = p.node where p.depth < 2 and not list_contains(p.nodes, adj.b)) select start, node, depth, array_to_string(nodes, '>') as nodes, array_to_string(types, '>') as types from p where depth > 0")
def two_hop_paths(t: Tables):
    """All paths of a search set of starts, ids divisible by 50: a path for each neighbour of a hub is the result."""
    paths = graph.traverse(_places(t), t.supplier.where("s_suppkey % 50 = 0").select(F.expr("'s' || s_suppkey").alias("start")))
    return paths.select("start", "node", "depth", F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"))


@query("select 's' || s_suppkey as start, 's' || s_suppkey || ' --LOCATED_IN--> n' || s_nationkey || ' --PART_OF--> r' || n_regionkey as path from supplier join nation on s_nationkey = n_nationkey")
def typed_paths(t: Tables):
    paths = graph.traverse(_places(t), t.supplier.select(F.expr("'s' || s_suppkey").alias("start")), along=("LOCATED_IN", "PART_OF"))
    return paths.where("depth = 2").select("start", graph.path_label(F.col("nodes"), F.col("types")).alias("path"))


@query("select 'r' || r_regionkey as node_id, r_name from region where r_regionkey in (select n_regionkey from nation) and contains(lower(r_name), 'a')")
def with_building_semi(t: Tables):
    nodes = t.region.select(F.expr("'r' || r_regionkey").alias("node_id"), "r_name").where(F.lower("r_name").contains("a"))
    return graph.with_neighbour(nodes, _places(t), "PART_OF")


@query(f"with {_EDGES}, one as (select s.src as start, adj.b as node, 1 as depth from (select src from e where ty = 'LOCATED_IN') s join adj on adj.a = s.src), two as (select one.start, adj.b as node, 2 as depth from one join adj on adj.a = one.node where adj.b <> one.start), b as (select start, node, min(depth) as depth from (select * from one union all select * from two) group by all), r as (select *, row_number() over (partition by start order by depth, node) as rank from b) select start, node, depth, rank from r where rank <= 10")
def depth_capped_projects(t: Tables):
    edges = _places(t)
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    near = graph.nearest(edges, t.supplier.select(F.expr("'s' || s_suppkey").alias("start")), every, 10)
    return graph.capped_by_depth(near, 10).withColumn("rank", F.col("rank").cast("long"))


@query()
def chunk_sentences(t: Tables):
    """Rows only: the packing is a fold over sentences, tested against a plain one."""
    out = facts.chunks(t.documents, "doc_id", F.col("source"), F.concat_ws("\n", "source", "lang"), F.substring("text", 1, 40), F.col("text"))
    return out


@query("""
with o as (select doc_id as k, sha256(text) as h from documents where doc_id % 9 <> 0), n as (select doc_id as k, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as h from documents where doc_id % 8 <> 0)
select case when o.k is null then 'insert' when n.k is null then 'delete' when o.h = n.h then 'unchanged' else 'update' end as change, count(*) as n, count(*) filter (o.h is distinct from n.h) as embeddings_reset from o full join n on o.k = n.k group by 1
""")
def chunk_upsert(t: Tables):
    from loomspark.operators.ingest import changes

    d = t.documents
    old = d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("h"))
    new = d.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("k"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return changes(old, new, ["k"], ["h"]).groupBy("change").agg(F.count("*").alias("n"), F.count_if(F.col("change") != "unchanged").alias("embeddings_reset"))


@query("""
with f as (select l_orderkey as id, l_linenumber as no, 'flag' as predicate, l_returnflag as v from lineitem union all select l_orderkey, l_linenumber + 100, 'status', l_linestatus from lineitem),
d as (select id, predicate, v, min(no) as no from f group by all), l as (select id, min(no) as n, case predicate when 'flag' then 'Flag' else 'Status' end || ': ' || string_agg(v, ', ' order by no, v) as line from d group by id, predicate)
select id, string_agg(line, chr(10) order by n) as card from l group by id
""")
def fact_cards(t: Tables):
    li = t.lineitem
    rows = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("fact_no"), F.lit("flag").alias("predicate"), F.col("l_returnflag").alias("value_text")).unionByName(
        li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") + 100).alias("fact_no"), F.lit("status").alias("predicate"), F.col("l_linestatus").alias("value_text"))
    )
    return facts.fact_card(rows, {"flag": "Flag", "status": "Status"})
