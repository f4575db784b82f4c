"""Contracts, upserts, coverage and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import parse
from loomspark.operators import dedup, evaluation, ingest
from loomspark.plans.registry import Tables, collector

QUERIES, ORACLE_SQL, query = collector()

_RULES = "case when json_extract_string(props, '$.k') is null and false then 'x' when user_id % 97 = 0 then 'missing_source_listing_id' when event_type = 'error' then 'no_source_row' when value is null or value < 1 then 'missing_provenance' end"


@query(f"select coalesce({_RULES}, 'accepted') as status, count(*) as n, min(event_id) as first_id from events group by 1")
def contract_quarantine(t: Tables):
    rules = [("missing_source_listing_id", F.col("user_id") % 97 == 0), ("no_source_row", F.col("event_type") == "error"), ("missing_provenance", F.col("value").isNull() | (F.col("value") < 1))]
    return ingest.with_error(t.events, rules).groupBy(F.coalesce("error_code", F.lit("accepted")).alias("status")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"select e as error_code, source_ref, raw from (select {_RULES} as e, cast(event_id as varchar) as source_ref, substr(props, 1, 500) as raw from events) where e is not null")
def quarantine_rows(t: Tables):
    rules = [("missing_source_listing_id", F.col("user_id") % 97 == 0), ("no_source_row", F.col("event_type") == "error"), ("missing_provenance", F.col("value").isNull() | (F.col("value") < 1))]
    return ingest.quarantined(ingest.with_error(t.events, rules), F.col("event_id").cast("string"), F.col("props"))


#: Two snapshots of orders: some keys leave, some come, some change their status.
_OLD = "select o_orderkey as k, o_orderstatus as hash, o_totalprice as v, 'u' || o_orderkey as url from orders where o_orderkey % 7 <> 0"
_NEW = "select o_orderkey as k, case when o_orderkey % 5 = 0 then 'Z' else o_orderstatus end as hash, o_totalprice + 1 as v, 'n' || o_orderkey as url from orders where o_orderkey % 11 <> 0"


def _snapshots(t: Tables):
    o = t.orders
    old = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("hash"), F.col("o_totalprice").alias("v"), F.expr("'u' || o_orderkey").alias("url"))
    new = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.expr("case when o_orderkey % 5 = 0 then 'Z' else o_orderstatus end").alias("hash"), (F.col("o_totalprice") + 1).alias("v"), F.expr("'n' || o_orderkey").alias("url"))
    return old, new


@query(f"with o as ({_OLD}), n as ({_NEW}) select coalesce(o.k, n.k) as k, case when o.k is null then 'insert' when n.k is null then 'delete' when o.hash is not distinct from n.hash then 'unchanged' else 'update' end as change from o full join n on o.k = n.k")
def upsert_change_class(t: Tables):
    return ingest.changes(*_snapshots(t), ["k"], ["hash"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select coalesce(o.k, n.k) as k, case when o.k is null or (n.k is not null and o.hash is distinct from n.hash) then n.hash else o.hash end as hash, case when o.k is null or (n.k is not null and o.hash is distinct from n.hash) then n.v else o.v end as v, coalesce(o.url, n.url) as url from o full join n on o.k = n.k")
def upsert_snapshot(t: Tables):
    return ingest.upsert(*_snapshots(t), ["k"], ["hash"], ["hash", "v"])


@query(f"with o as ({_OLD}), n as ({_NEW}) select k, 'insert' as action from n where k not in (select k from o) union all select k, 'delete' from o where k % 2 = 0 and k not in (select k from n)")
def stale_anti_join(t: Tables):
    old, new = _snapshots(t)
    return ingest.reconcile(old, new, ["k"], old.where("k % 2 = 0").select("k"), ["k"])


@query("with d as (select * from (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as i from events) where i = 1) select user_id, event_type, event_id, value from d")
def last_wins_index(t: Tables):
    return ingest.last_by(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("select p.page_id, case when p.page_id % 3 = 0 then b.url else p.url end as url from (select page_id, case when page_id % 3 = 0 then '' else url end as url from pages) p left join pages b using (page_id)")
def provenance_fill(t: Tables):
    blank = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("url"))
    return ingest.fill_missing(blank, t.pages, "page_id", "url")


@query("select doc_id, quality, 'v1' as version from labels where doc_id % 2 = 0 union all select doc_id, 1 - quality, 'v2' from labels where doc_id % 3 = 0")
def version_replace(t: Tables):
    one = t.labels.select("doc_id", "quality", F.lit("v1").alias("version")).where("doc_id % 2 = 0")
    old = one.unionByName(t.labels.select("doc_id", "quality", F.lit("v2").alias("version")))
    return ingest.replace_version(old, t.labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("v2").alias("version")), "version")


@query("""
select count(*) as n_total, count(l.quality) as n_labelled, round(100.0 * count(l.quality) / count(*), 1)::double as pct_labelled, count(*) filter (toxic = 1) as n_toxic,
  count(*) filter (len(regexp_extract_all(d.text, '[0-9]+')) > 0) as n_with_numbers, count(distinct sha256(d.text)) as n_distinct, count(distinct source) as n_sources from documents d left join labels l using (doc_id)
""")
def field_coverage(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.agg(
        F.count("*").alias("n_total"), F.count("quality").alias("n_labelled"), F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.count("quality"), F.count("*")), 1), F.lit(0.0)).alias("pct_labelled"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("text").rlike("[0-9]")).alias("n_with_numbers"),
        F.count_distinct(F.sha2("text", 256)).alias("n_distinct"), F.count_distinct("source").alias("n_sources"),
    )


@query("select coalesce(cast(quality as varchar), 'None') as key, count(*) as n from documents left join labels using (doc_id) group by 1")
def group_distribution(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("None")).alias("key")).agg(F.count("*").alias("n"))


@query("select source, count(*) as support from documents group by source order by support desc, source limit 10")
def top_support(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "source").limit(10)


@query("select p_partkey, case when p_size between 1 and 20 then p_size end as rooms, case when p_retailprice * 8 between 5 and 10000 then p_retailprice * 8 end as area, ((p_size > 20)::int + (p_retailprice * 8 > 10000)::int)::int as outliers from part")
def range_sanitize(t: Tables):
    rooms, area = parse.rooms(F.col("p_size")), parse.area(F.col("p_retailprice") * 8)
    return t.part.select("p_partkey", rooms.alias("rooms"), area.alias("area"), (rooms.isNull().cast("int") + area.isNull().cast("int")).alias("outliers"))


_TYPES = "case doc_id % 4 when 0 then 'villa' when 1 then 'land' when 2 then 'apartment' else '' end"


@query(f"select doc_id, case when doc_id % 10 = 0 then 'A' when {_TYPES} in ('land','project_land','warehouse','resort','other') then 'C' when {_TYPES} in ('villa','street_house','private_house','shophouse','condotel') or n_chars >= 300 then 'B' else 'C' end as tier, case when {_TYPES} = '' then null when doc_id % 7 = 0 then {_TYPES} else {_TYPES} || '-' || (doc_id % 7) || 'pn' end as unit_type from documents")
def tier_assign(t: Tables):
    kind = F.expr(_TYPES)
    return t.documents.select("doc_id", parse.tier(kind, F.when(F.col("doc_id") % 10 == 0, "p"), F.col("n_chars")).alias("tier"), parse.unit_type(kind, F.col("doc_id") % 7).alias("unit_type"))


@query("with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as r, count(*) over (partition by lang) as n from documents) select lang, min(n_chars) as low, max(n_chars) filter (r = n // 2) as median, max(n_chars) filter (r = (n * 9) // 10) as p90, max(n_chars) as high from r group by lang")
def nearest_rank_percentiles(t: Tables):
    return evaluation.nearest_rank(t.documents, "n_chars", ["lang"])


@query("select sha256(text) as cluster_key, min(doc_id) as cluster_id, count(*) as cluster_size from documents group by 1")
def exact_dup_clusters(t: Tables):
    return dedup.exact_clusters(t.documents, "doc_id", "text")


_FLAT = "list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[a-z0-9]+'), lambda t: length(t) <= 60)"
_SIM = (
    f"with tk as (select doc_id as id, {_FLAT} as s from documents), g as (select id, unnest(case when len(s) < 3 then s else list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i+1] || ' ' || s[i+2]) end) as g from tk), "
    "h as (select id, cast('0x' || substr(md5(g), 1, 8) as bigint) as h from g), sim as (select id, "
    + " + ".join(f"(case when sum(((h >> {i}) & 1) * 2 - 1) > 0 then {1 << i} else 0 end)::bigint" for i in range(32))
    + " as simhash from h group by id)"
)


@query(_SIM + " select id, simhash from sim")
def simhash_md5_variant(t: Tables):
    return dedup.simhash_md5(t.documents, "doc_id", "text")


_PAIRS = (
    _SIM + ", rep as (select simhash, min(id) as id from sim group by 1), bd as (select id, simhash, i || ':' || ((simhash >> (i * 4)) & 15) as band from rep, range(8) r(i)), "
    "pr as (select distinct x.id as a, y.id as b, bit_count(xor(x.simhash, y.simhash))::int as distance from bd x join bd y on x.band = y.band and x.id < y.id and bit_count(xor(x.simhash, y.simhash)) <= 2 "
    "union all select rep.id, sim.id, 0 from sim join rep using (simhash) where sim.id <> rep.id)"
)


@query(_PAIRS + " select a, b, distance from pr")
def hamming_pairs(t: Tables):
    return dedup.near_pairs(dedup.simhash_md5(t.documents, "doc_id", "text"), most=2)


@query(
    _PAIRS.replace("with tk", "with recursive tk") + ", e as (select a, b from pr union select b, a from pr), reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a), "
    "cl as (select d.doc_id as id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) as cluster_id, any_value(n_chars) as n from documents d left join reach r on r.a = d.doc_id group by d.doc_id) "
    "select id, cluster_id, row_number() over (partition by cluster_id order by n desc, id) = 1 as is_representative, count(*) over (partition by cluster_id) as cluster_size from cl"
)
def near_dup_clusters(t: Tables):
    pairs = dedup.near_pairs(dedup.simhash_md5(t.documents, "doc_id", "text"), most=2)
    return dedup.clusters(t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")), pairs)


def _signed(t: Tables):
    """64-bit BLAKE2b signatures as numbers; a text without words has none."""
    sig = dedup.simhash_exact(t.documents, "doc_id", "text").where("simhash <> ''")
    return sig.select("id", F.conv("simhash", 16, -10).cast("long").alias("simhash"))


@query()
def hamming_pairs_exact(t: Tables):
    """Rows only: BLAKE2b has no SQL. Pairs within 6 of 64 bits, as the near-duplicate operator takes them."""
    return dedup.near_pairs(_signed(t), bits=64, most=dedup.MAX_BITS)


@query()
def near_dup_clusters_exact(t: Tables):
    """Rows only: clusters of equal texts and of the pairs of hamming_pairs_exact."""
    docs = t.documents.withColumn("_h", F.sha2("text", 256))
    first = docs.where("_h is not null").groupBy("_h").agg(F.min("doc_id").alias("a"))
    same = docs.join(first, "_h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    pairs = dedup.near_pairs(_signed(t), bits=64, most=dedup.MAX_BITS).select("a", "b").unionByName(same)
    return dedup.clusters(t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")), pairs)


@query()
def simhash_exact(t: Tables):
    """Rows only: BLAKE2b has no SQL."""
    return dedup.simhash_exact(t.documents, "doc_id", "text")
