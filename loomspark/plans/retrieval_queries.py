"""Retrieval of benchmark questions over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import evaluation, index, retrieval
from loomspark.plans.registry import Tables, collector
from loomspark.plans.text_queries import SYLLABLES
from loomspark.scratch import materialize, releases

QUERIES, ORACLE_SQL, query = collector()

K = 10
WIDE = retrieval.OVERFETCH * K
_T = "list_concat(s, list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || '_' || s[i + 1]))"
_FLAT = "replace(strip_accents(lower({})), 'đ', 'd')"
_DOCS = f"ds as (select doc_id as id, {SYLLABLES.format('text')} as s from documents), dt as (select id, {_T} as t from ds), st as (select count(*) as n, coalesce(avg(len(t)) filter (len(t) > 0), 1.0) as avgdl from dt), tk as (select id, len(t) as dl, unnest(t) as term from dt)"
_ASKED = "q as (select item_id as query_id, text as query from benchmark)"
_BM = f"""qs as (select query_id, {SYLLABLES.format('query')} as s from q), qt as (select distinct query_id, unnest({_T}) as term from qs),
tf as (select id, dl, term, count(*) as tf from tk where term in (select term from qt) group by all), df as (select term, count(*) as df from tf group by 1),
sc as (select query_id, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * greatest(dl, 1) / avgdl))) as score from tf join df using (term) join qt using (term), st group by all),
bm as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from sc)"""
_BM25 = f"{_DOCS}, {_ASKED}, {_BM}"

_indexes: dict[tuple[str, str, int], index.Index] = {}


def _index(t: Tables) -> index.Index:
    """The persisted index of the documents, built once in a session for a folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, releases())
    if key not in _indexes:
        vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
        chunks = t.documents.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("project"), F.when(F.col("doc_id") % 3 == 0, "facts").otherwise("description").alias("chunk_type"))
        _indexes[key] = index.build(chunks, vectors)
    return _indexes[key]


def _questions(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _shown(df):
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_DOCS} select term, id, count(*) as tf, dl from tk group by term, id, dl")
def index_postings(t: Tables):
    return _index(t).postings


@query(f"with d as (select doc_id, text, case when doc_id % 4 = 0 then text end as flat from documents) select doc_id, sha256(coalesce(flat, {_FLAT.format('text')})) as flat_hash from d")
def search_vectors(t: Tables):
    """Filled in where there is none yet; compared by its hash."""
    some = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("flat"))
    return index.search_vectors(some).select("doc_id", F.sha2("flat", 256).alias("flat_hash"))


@query(f"""
with {_DOCS}, o as (select doc_id as id, sha256(text) as h, doc_id % 5 <> 0 as has, case when doc_id % 7 = 0 then 'old' else 'new' end as model from documents where doc_id % 9 <> 0), n as (select doc_id as id, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as h from documents where doc_id % 8 <> 0),
c as (select coalesce(o.id, n.id) as id, case when o.id is null then 'insert' when n.id is null then 'delete' when o.h = n.h then 'unchanged' else 'update' end as change, has, model from o full join n on o.id = n.id),
p as (select id, count(distinct term) as m from tk group by 1)
select count(*) filter (change = 'insert') as inserted, count(*) filter (change = 'update') as updated, count(*) filter (change = 'unchanged') as unchanged, count(*) filter (change = 'delete') as chunks_deleted, count(*) filter (change <> 'delete') as chunks_total,
  coalesce(sum(m) filter (change in ('insert', 'update')), 0)::bigint as postings_written, count(*) filter (change <> 'delete' and not (change = 'unchanged' and has and model = 'new')) as embedded from c left join p using (id)
""")
def index_build(t: Tables):
    d = t.documents.withColumn("id", F.col("doc_id"))
    model = F.when(F.col("doc_id") % 7 == 0, "old").otherwise("new")
    old = d.where("doc_id % 9 <> 0").select("id", F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 5 != 0, F.array(F.lit(1.0))).alias("embedding"), model.alias("embedding_model"))
    new = d.where("doc_id % 8 <> 0").select("id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return index.build_summary(old, new, ["id"], index.term_numbers(_index(t)), "new")


@query("select vec_id from embeddings where vec_id % 3 = 0 or vec_id % 5 = 0")
def stale_embeddings(t: Tables):
    e = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("embedding_model"))
    return index.stale_embeddings(e, "new").select("vec_id")


@query(f"with {_BM25} select query_id, id, round(score, 6) as score, rank from bm where rank <= {K}")
def bm25_topk(t: Tables):
    return _shown(retrieval.bm25_index(_index(t), _questions(t), K))


@query(f"with {_DOCS} select n as n_docs, round(avgdl, 6) as avgdl from st")
def corpus_stats(t: Tables):
    held = _index(t)
    return t.spark.createDataFrame([(held.n_docs, round(held.avgdl, 6))], "n_docs long, avgdl double")


@query(f"with {_DOCS} select term, count(distinct id) as df from tk group by 1")
def document_frequency(t: Tables):
    return index.document_frequency(_index(t))


_FTS = f"fq as (select query_id, list_distinct(list_filter({SYLLABLES.format('query')}, lambda t: length(t) > 1)) as toks from q), fd as (select doc_id as id, {_FLAT.format('text')} as f from documents), fs as (select query_id, id, len(list_filter(toks, lambda t: contains(f, t))) / len(toks)::double as score from fd, fq where len(toks) > 0)"


@query(f"with {_ASKED}, {_FTS}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fs where score > 0) select query_id, id, round(score, 6) as score, rank from r where rank <= {K}")
def fts_token_fraction(t: Tables):
    return _shown(retrieval.token_fraction(_index(t).texts.select("id", "flat"), _questions(t), K))


_VEC = "vs as (select q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score from embeddings v, embeddings q where q.vec_id % 50 = 0), ve as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from vs)"


def _vectors(t: Tables, k: int):
    e = t.embeddings
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return retrieval.vector_topk(e.select(F.col("vec_id").alias("id"), "embedding"), asked, k)


@query(f"with {_VEC} select query_id, id, round(score, 6) as score, rank from ve where rank <= {K}")
def vector_topk(t: Tables):
    return _shown(_vectors(t, K))


_LISTS = "a as (select user_id as query_id, event_id as id, row_number() over (partition by user_id order by value desc, event_id) as rank from events), b as (select user_id as query_id, event_id as id, row_number() over (partition by user_id order by ts desc, event_id) as rank from events), la as (select * from a where rank <= 20), lb as (select * from b where rank <= 20)"


def _lists(t: Tables):
    e = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return retrieval.ranked(e, 20, score="value").drop("value", "at"), retrieval.ranked(e, 20, score="at").drop("value", "at")


@query(f"with {_LISTS}, u as (select query_id, id, 0.6::double / (60 + rank) as s, 'bm25' as b from la union all select query_id, id, 1.0::double / (60 + rank), 'vector' from lb), f as (select query_id, id, sum(s) as score, string_agg(b, '+' order by b) as retriever from u group by all), r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from f) select query_id, id, round(score, 6) as score, retriever, rank from r where rank <= {K}")
def rrf_fusion(t: Tables):
    a, b = _lists(t)
    fused = retrieval.fuse([("bm25", a), ("vector", b)], retrieval.HYBRID_WEIGHTS, K)
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), "retriever", F.col("rank").cast("long").alias("rank"))


@query(f"with {_LISTS}, k as (select la.query_id, la.id, la.rank from la join events on event_id = id where event_type = 'click'), r as (select query_id, id, row_number() over (partition by query_id order by rank) as rank from k) select query_id, id, rank from r where rank <= 5")
def restricted_rerank(t: Tables):
    a, _ = _lists(t)
    allowed = t.events.where("event_type = 'click'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"))
    return retrieval.restrict(a.withColumn("score", -F.col("rank")), allowed, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"with {_BM25}, o as (select b.query_id, b.id, b.rank from bm b join documents d on d.doc_id = b.id where b.rank <= {WIDE} and d.lang = 'en'), r as (select query_id, id, row_number() over (partition by query_id order by rank) as rank from o) select query_id, id, rank from r where rank <= {K}")
def overfetch_filter(t: Tables):
    wide = materialize(retrieval.bm25_index(_index(t), _questions(t), WIDE), "overfetched")
    allowed = wide.join(_index(t).chunks.where("lang = 'en'").select("id"), "id", "left_semi").select("query_id", "id")
    return retrieval.restrict(wide.withColumn("score", -F.col("rank")), allowed, K).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def _entities(t: Tables):
    return t.part.select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 2 == 0, "Project").otherwise("Ward").alias("entity_type"), F.col("p_name").alias("canonical_key"), F.array("p_name", "p_brand").alias("names"))


def _asked(t: Tables):
    """The search set of orders, ids divisible by 50: questions that name their parts."""
    named = t.lineitem.where("l_orderkey % 50 = 0").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return named.select(F.col("l_orderkey").alias("query_id"), F.col("p_name").alias("n"), "l_linenumber").groupBy("query_id").agg(F.concat_ws(" so sánh ", F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))), lambda x: x["n"])).alias("query"))


_ENT = f"q as (select l_orderkey as query_id, string_agg(p_name, ' so sánh ' order by l_linenumber, p_name) as query from lineitem join part on l_partkey = p_partkey where l_orderkey % 50 = 0 group by 1), nm as (select p_partkey as entity_id, case when p_partkey % 2 = 0 then 'Project' else 'Ward' end as entity_type, p_name as canonical_key, trim(regexp_replace({_FLAT.format('unnest([p_name, p_brand])')}, '[-_]+', ' ', 'g')) as f from part), h as (select query_id, entity_id, entity_type, canonical_key, max(length(f)) as n from nm join q on contains(' ' || {_FLAT.format('query')} || ' ', f) where len(regexp_split_to_array(f, '\\s+')) >= 2 group by all), en as (select *, row_number() over (partition by query_id order by n desc, canonical_key, entity_id) as rank from h)"


@query(f"with {_ENT} select query_id, canonical_key, entity_type, rank from en where rank <= 5")
def entity_match_theta(t: Tables):
    return retrieval.match_entities(_entities(t), _asked(t)).select("query_id", "canonical_key", "entity_type", F.col("rank").cast("long").alias("rank"))


def _intent_sql(flat: str) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains({flat}, {chr(39)}{h}{chr(39)})' for h in hints)} then '{name}'" for name, hints in retrieval.INTENT_HINTS) + " else 'general' end"


@query(f"with {_ENT}, p as (select query_id, count(*) as n, min(canonical_key) as one from en where rank <= 5 and entity_type = 'Project' group by 1) select q.query_id, {_intent_sql(_FLAT.format('query'))} as intent, case when n is null then 'discovery' else 'targeted' end as mode, case when n = 1 then one end as project from q left join p using (query_id)")
def query_router(t: Tables):
    asked = _asked(t)
    return retrieval.route(asked, retrieval.match_entities(_entities(t), asked)).select("query_id", "intent", "mode", "project")


@query(f"with {_BM25}, {_VEC}, l as (select query_id, id, 0.6::double / (60 + rank) as s, 'bm25' as b from bm where rank <= {WIDE} union all select query_id, id, 1.0::double / (60 + rank), 'vector' from ve where rank <= {WIDE}), f as (select query_id, id, sum(s) as score, string_agg(b, '+' order by b) as retriever from l group by all), r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from f) select query_id, id, round(score, 6) as score, retriever, rank from r where rank <= {K}")
def hybrid_r1(t: Tables):
    fused = retrieval.fuse([("bm25", retrieval.bm25_index(_index(t), _questions(t), WIDE)), ("vector", _vectors(t, WIDE))], retrieval.HYBRID_WEIGHTS, K)
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), "retriever", F.col("rank").cast("long").alias("rank"))


#: Questions about the documents as a knowledge base: sources are projects, languages are wards, facts are every third document.
_NAMED = "case item_id % 4 when 0 then ' nằm ở source src' || (item_id % 20) when 1 then ' so sánh source src' || (item_id % 20) || ' và source src' || ((item_id + 7) % 20) when 2 then ' language ' || (['en', 'fr', 'de', 'es'])[(item_id // 4) % 4 + 1] else '' end"
_KB = f"""q as (select item_id as query_id, text || {_NAMED} as query, case when item_id % 4 = 0 then 'src' || (item_id % 20) end as held from benchmark),
kd as (select d.doc_id as id, source as project, lang, doc_id % 3 = 0 as facts, e.embedding from documents d left join embeddings e on e.vec_id = d.doc_id),
qv as (select item_id as query_id, embedding from benchmark join embeddings on vec_id = item_id % 20)"""
_KVEC = "kv as (select query_id, id, project, list_cosine_similarity(qv.embedding::double[], kd.embedding::double[]) as score from kd, qv where kd.embedding is not null)"
_KENT = f"""nm as (select distinct 'p:' || source as entity_id, 'Project' as entity_type, source as canonical_key, 'source ' || source as f from documents where source is not null union select distinct 'w:' || lang, 'Ward', lang, 'language ' || lang from documents where lang is not null),
en as (select query_id, entity_id, entity_type, canonical_key, row_number() over (partition by query_id order by length(f) desc, canonical_key, entity_id) as rank from nm join q on contains(' ' || {_FLAT.format('query')} || ' ', f)),
rt as (select q.query_id, {_intent_sql(_FLAT.format('query'))} as intent, n, case when n = 1 then one end as project, allowed from q left join (select query_id, count(*) as n, min(canonical_key) as one, list(canonical_key) as allowed from en where rank <= 5 and entity_type = 'Project' group by 1) using (query_id))"""
_KGRAPH = """ed as (select distinct 'p:' || source as p, 'w:' || lang as w from documents where source is not null and lang is not null),
rc as (select query_id, entity_id as p, 0 as depth, entity_id as path from en where rank <= 5 and entity_type = 'Project' union all
  select query_id, p, 1, w || ' --IN_LANG--> ' || p from en join ed on w = entity_id where rank <= 5 union all
  select query_id, b.p, 2, a.p || ' --IN_LANG--> ' || a.w || ' --IN_LANG--> ' || b.p from en join ed a on a.p = entity_id join ed b on b.w = a.w and b.p <> a.p where rank <= 5),
rp as (select query_id, p, arg_min(depth, struct_pack(depth, path)) as depth, arg_min(path, struct_pack(depth, path)) as path from rc group by all),
rk as (select *, row_number() over (partition by query_id order by depth, p) as i from rp),
gr as (select query_id, id, 1.0::double / (1 + depth) as score, path, project, row_number() over (partition by query_id order by depth, id) as rank from rk join kd on 'p:' || project = p where i <= 10 and facts)"""


def _held_bm(project: str, name: str = "bw", k: int = WIDE) -> str:
    """BM25 of questions that a project may hold: three times as many are looked at then."""
    return f"{name} as (select * from (select bm.query_id, id, score, row_number() over (partition by bm.query_id order by rank) as rank from bm join kd using (id) join {project} using (query_id) where (held is null and rank <= {k}) or (rank <= {retrieval.OVERFETCH * k} and kd.project = held)) where rank <= {k})"


def _held_vec(project: str, name: str = "vw") -> str:
    return f"{name} as (select * from (select query_id, id, score, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from kv join {project} using (query_id) where held is null or kv.project = held) where rank <= {WIDE})"


def _fused(lists: list[tuple[str, str]], name: str, weights: str = "") -> str:
    """Fused ranks of (branch, table); a table may have paths. ``weights`` joins a table w (query_id, branch, weight)."""
    rows = " union all ".join(f"select query_id, id, rank, '{b}' as branch, {i} as no, {'path' if b == 'graph' else 'null::varchar'} as path from {t}" for i, (b, t) in enumerate(lists))
    return f"{name} as (select query_id, id, sum(weight / (60 + rank)) as score, string_agg(branch, '+' order by branch) as retriever, arg_min(path, no) filter (path is not null) as path, row_number() over (partition by query_id order by round(sum(weight / (60 + rank)), 12) desc, id) as rank from ({rows}) join {weights} group by query_id, id)"


def _constant(weights: dict[str, float], name: str) -> str:
    return f"{name} as (select * from (values {', '.join(f'({chr(39)}{b}{chr(39)}, {w}::double)' for b, w in weights.items())}) v(branch, weight))"


_PLAIN = f"np as (select query_id, null::varchar as held from q), {_held_bm('np', 'bp')}, {_held_vec('np', 'vp')}"
_R1 = f"with {_DOCS}, {_KB}, {_BM}, {_FTS}, {_KVEC}, {_constant({'bm25': 0.6, 'vector': 1.0}, 'hw')}, hp as (select query_id, held from q), {_held_bm('hp')}, {_held_bm('hp', 'b1', K)}, {_held_vec('hp')}, {_fused([('bm25', 'bw'), ('vector', 'vw')], 'hy', 'hw using (branch)')}, fr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from fs join kd using (id) join hp using (query_id) where score > 0 and (held is null or project = held))"


def _kb_questions(t: Tables):
    n = F.col("item_id")
    place = F.concat(F.lit(" nằm ở source src"), (n % 20).cast("string"))
    two = F.concat(F.lit(" so sánh source src"), (n % 20).cast("string"), F.lit(" và source src"), ((n + 7) % 20).cast("string"))
    lang = F.concat(F.lit(" language "), F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), F.expr("cast((item_id div 4) % 4 + 1 as int)")))
    text = F.concat("text", F.when(n % 4 == 0, place).when(n % 4 == 1, two).when(n % 4 == 2, lang).otherwise(F.lit("")))
    e = t.embeddings.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("query_embedding"))
    asked = t.benchmark.select(n.alias("query_id"), text.alias("query"), (n % 20).alias("_v"), F.when(n % 4 == 0, F.concat(F.lit("src"), (n % 20).cast("string"))).alias("project"))
    return materialize(asked.join(e, "_v").drop("_v"), "questions")


def _kb_graph(t: Tables):
    d = t.documents
    project, ward = F.concat(F.lit("p:"), "source"), F.concat(F.lit("w:"), "lang")
    row = lambda id_, kind, key, name: d.where(F.col(key).isNotNull()).select(id_.alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(key).alias("canonical_key"), F.array(F.concat(F.lit(name), key)).alias("names")).distinct()
    edges = d.where("source is not null and lang is not null").select(project.alias("src"), ward.alias("dst"), F.lit("IN_LANG").alias("edge_type")).distinct()
    return row(project, "Project", "source", "source ").unionByName(row(ward, "Ward", "lang", "language ")), edges


def _kb_shown(df, *more):
    return df.select(*more, "query_id", "id", F.round("score", 6).alias("score"), "retriever", F.col("rank").cast("long").alias("rank"), "path")


@query(_R1 + f" select 'fts' as mode, query_id, id, round(score, 6) as score, 'fts' as retriever, rank, null::varchar as path from fr where rank <= {K} union all select 'bm25', query_id, id, round(score, 6), 'bm25', rank, null from b1 where rank <= {K} union all select 'vector', query_id, id, round(score, 6), 'vector', rank, null from vw where rank <= {K} union all select 'hybrid', query_id, id, round_even(round(score, 12), 6), retriever, rank, null from hy where rank <= {K}")
def retrieve_r1(t: Tables):
    asked, out = _kb_questions(t), None
    for mode in ("fts", "bm25", "vector", "hybrid"):
        one = _kb_shown(retrieval.retrieve_r1(_index(t), asked, K, mode), F.lit(mode).alias("mode"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {_KB}, {_KENT}, {_KGRAPH} select query_id, id, round(score, 6) as score, 'graph' as retriever, rank, path from gr where rank <= {K}")
def retrieve_r2(t: Tables):
    entities, edges = _kb_graph(t)
    return _kb_shown(retrieval.retrieve_r2(_index(t).chunks, entities, edges, _kb_questions(t), K).withColumn("retriever", F.lit("graph")))


def _weight_case(branch: str) -> str:
    arms = " ".join(f"when intent = '{i}' then {w[branch]}" for i, w in retrieval.INTENT_WEIGHTS.items())
    return f"(case when n is null then {retrieval.DISCOVERY_WEIGHTS[branch]} {arms} end)::double"


def _allowed(table: str, name: str) -> str:
    return f"{name} as (select query_id, id, row_number() over (partition by query_id order by rank) as rank{', path' if table == 'gw' else ''} from {table} join kd using (id) join rt using (query_id) where allowed is null or list_contains(allowed, kd.project))"


_R3 = f"with {_DOCS}, {_KB}, {_BM}, {_KVEC}, {_KENT}, {_KGRAPH}, rh as (select query_id, project as held from rt), {_held_bm('rh')}, {_held_vec('rh')}, gw as (select query_id, id, rank, path from gr where rank <= {WIDE}), {_allowed('bw', 'ba')}, {_allowed('vw', 'va')}, {_allowed('gw', 'ga')}, rw as (" + " union all ".join(f"select query_id, '{b}' as branch, {_weight_case(b)} as weight from rt" for b in ("bm25", "vector", "graph")) + f"), {_fused([('bm25', 'ba'), ('vector', 'va'), ('graph', 'ga')], 'r3', 'rw using (query_id, branch)')}, {_PLAIN}, {_constant(retrieval.DEFAULT_WEIGHTS, 'dw')}, {_fused([('bm25', 'bp'), ('vector', 'vp'), ('graph', 'gw')], 'r3f', 'dw using (branch)')}"


@query(_R3 + f" select 'router' as mode, query_id, id, round_even(round(score, 12), 6) as score, retriever, rank, path from r3 where rank <= {K} union all select 'fixed', query_id, id, round_even(round(score, 12), 6), retriever, rank, path from r3f where rank <= {K}")
def retrieve_r3(t: Tables):
    entities, edges = _kb_graph(t)
    run = lambda mode, router: _kb_shown(retrieval.retrieve_r3(_index(t), entities, edges, _kb_questions(t), K, use_router=router), F.lit(mode).alias("mode"))
    return run("router", True).unionByName(run("fixed", False))


#: What questions should find: cards of the sources or the language that they name; those that name a language expect no project.
_GOLD = """go as (select query_id, case when query_id % 4 = 0 then ['src' || (query_id % 20)] when query_id % 4 = 1 then ['src' || (query_id % 20), 'src' || ((query_id + 7) % 20)] else []::varchar[] end as groups, case query_id % 4 when 0 then 'fact' when 1 then 'compare' else 'location' end as query_type from q where query_id % 4 < 3),
gx as (select go.query_id, groups, query_type, list(id) as items from go join kd on facts and (list_contains(groups, project) or (len(groups) = 0 and lang = (['en', 'fr', 'de', 'es'])[(go.query_id // 4) % 4 + 1])) group by all)"""
_CONFIGS = ("R1-fts", "R1-bm25", "R1-vector", "R1-hybrid", "R2-graph", "R3-fixed", "R3-router")
_MEANS = {"group_precision": "project_precision", "item_precision": "listing_precision", "item_precision_normalised": "listing_precision_norm", "recall": "listing_recall", "hit": "hit", "mrr": "mrr"}
_EVAL = f""", hw as (select * from (values ('bm25', 0.6::double), ('vector', 1.0::double)) v(branch, weight)), {_fused([('bm25', 'bp'), ('vector', 'vp')], 'hy', 'hw using (branch)')}, {_FTS}, fr as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from fs where score > 0), {_GOLD},
al as (select config, query_id, id, rank from ({' union all '.join(f"select '{c}' as config, query_id, id, rank from {t}" for c, t in zip(_CONFIGS, ('fr', 'bp', 'vp', 'hy', 'gr', 'r3f', 'r3')))}) where rank <= {K}),
cq as (select config, gx.* from gx, (select unnest({list(_CONFIGS)}) as config)),
es as (select config, query_id, query_type, len(groups) > 0 as has, len(items) as n_items, count(al.id) as n, count(al.id) filter (list_contains(groups, kd.project)) as n_group, count(distinct al.id) as n_found, count(distinct al.id) filter (list_contains(items, al.id)) as n_right, min(rank) filter (list_contains(groups, kd.project)) as first from cq left join al using (config, query_id) left join kd on kd.id = al.id group by all),
ms as (select config, query_type, case when has then coalesce(n_group / nullif(n, 0)::double, 0) end as project_precision, coalesce(n_right / nullif(n_found, 0)::double, 0) as listing_precision, coalesce(n_right / nullif(n_found, 0)::double / least(1.0::double, n_items / nullif(n_found, 0)::double), 0) as listing_precision_norm, n_right / n_items::double as listing_recall, case when has then (first is not null)::int::double end as hit, case when has then coalesce(1.0::double / first, 0) end as mrr from es)"""


def _gold(t: Tables):
    n = F.col("item_id")
    src = lambda x: F.concat(F.lit("src"), x.cast("string"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), F.expr("cast((item_id div 4) % 4 + 1 as int)"))
    asked = t.benchmark.where("item_id % 4 < 3").select(n.alias("query_id"), F.when(n % 4 == 0, F.array(src(n % 20))).when(n % 4 == 1, F.array(src(n % 20), src((n + 7) % 20))).otherwise(F.array().cast("array<string>")).alias("groups"), F.when(n % 4 == 2, lang).alias("_lang"), F.when(n % 4 == 0, "fact").when(n % 4 == 1, "compare").otherwise("location").alias("query_type"))
    cards = _index(t).chunks.where("chunk_type = 'facts'").select("id", "project", "lang")
    named = asked.join(cards, F.array_contains("groups", F.col("project")) | ((F.size("groups") == 0) & (F.col("lang") == F.col("_lang"))))
    return named.groupBy("query_id", "groups", "query_type").agg(F.collect_list("id").alias("items"))


def _runs(t: Tables):
    """Results of all configurations, each run once for all questions."""
    asked, (entities, edges), held = _kb_questions(t).withColumn("project", F.lit(None).cast("string")), _kb_graph(t), _index(t)
    found = {f"R1-{m}": retrieval.retrieve_r1(held, asked, K, m) for m in ("fts", "bm25", "vector", "hybrid")}
    found["R2-graph"] = retrieval.retrieve_r2(held.chunks, entities, edges, asked, K)
    found["R3-fixed"] = retrieval.retrieve_r3(held, entities, edges, asked, K, use_router=False)
    found["R3-router"] = retrieval.retrieve_r3(held, entities, edges, asked, K)
    out = None
    for config in _CONFIGS:
        one = found[config].select(F.lit(config).alias("config"), "query_id", F.col("id").alias("item"), "rank")
        out = one if out is None else out.unionByName(one)
    out = materialize(out, "runs")
    return out.join(held.chunks.select(F.col("id").alias("item"), F.col("project").alias("group")), "item")


@query(_R3 + _EVAL + " select config, coalesce(query_type, 'overall') as level, count(*) as n, " + ", ".join(f"round(coalesce(avg({m}), 0), 6) as {m}" for m in _MEANS.values()) + ", count(mrr) as mrr_n from ms group by grouping sets ((config), (config, query_type))")
def evaluate_configs(t: Tables):
    """All configurations against all gold questions, overall and by type; a question without results scores 0."""
    gold = _gold(t)
    scored = evaluation.score_configs(_runs(t), gold.drop("query_type"), _CONFIGS).join(gold.select("query_id", "query_type"), "query_id")
    return evaluation.mean_scores(scored, _MEANS)


SWEEP_GRID = tuple({"vector": 1.0, "bm25": b, "graph": g} for b in (0.3, 0.6) for g in (0.3, 0.6, 0.9))
DISCOVERY_GRID = tuple(dict(zip(("vector", "bm25", "graph"), x)) for x in ((1.0, 0.6, 0.3), (1.0, 0.3, 0.9), (1.0, 0.3, 1.5), (1.0, 0.1, 2.0), (0.6, 0.1, 2.0), (1.0, 0.0, 3.0)))
_GRIDS = [(g, i, w) for g, grid in (("standard", SWEEP_GRID), ("discovery", DISCOVERY_GRID)) for i, w in enumerate(grid)]
_SWEEP = f""", {_GOLD}, g as (select * from (values {', '.join(f"('{g}', {i}, '{b}', {x}::double)" for g, i, w in _GRIDS for b, x in w.items())}) v(grid, no, branch, weight)),
u as (select query_id, id, rank, 'bm25' as branch from bp union all select query_id, id, rank, 'vector' from vp union all select query_id, id, rank, 'graph' from gw),
s as (select grid, no, query_id, id, row_number() over (partition by grid, no, query_id order by round(sum(weight / (60 + rank)), 12) desc, id) as rank from u join g using (branch) group by grid, no, query_id, id),
m as (select grid, no, gx.query_id, len(groups) > 0 as has, count(*) filter (list_contains(groups, project)) / count(*)::double as p, coalesce(1.0::double / min(rank) filter (list_contains(groups, project)), 0) as mrr, count(*) filter (list_contains(items, s.id)) / len(items)::double as recall, count(*) filter (list_contains(items, s.id)) / count(*)::double as lp from s join gx using (query_id) join kd using (id) where rank <= {K} group by grid, no, gx.query_id, groups, items),
a as (select grid, no, round(avg(p) filter (has), 6) as project_precision, round(avg(mrr) filter (has), 6) as mrr, round(avg(lp), 6) as listing_precision, round(avg(recall), 6) as listing_recall from m group by all)"""


@query(_R3 + _SWEEP + " select *, row_number() over (partition by grid order by project_precision desc, mrr desc, no) as place, no = arg_max(no, struct_pack(a := listing_precision, b := listing_recall, c := -no)) over (partition by grid) as chosen from a")
def sweep_grids(t: Tables):
    """Both grids of R3's weights over branches that are searched once, in order of project precision, then reciprocal rank; and the one chosen by listing precision, then recall."""
    from pyspark.sql.window import Window

    asked, (entities, edges), held = _kb_questions(t).withColumn("project", F.lit(None).cast("string")), _kb_graph(t), _index(t)
    branches = {"bm25": retrieval._branch("bm25", held, asked, WIDE), "vector": retrieval._branch("vector", held, asked, WIDE), "graph": retrieval.retrieve_r2(held.chunks, entities, edges, asked, WIDE)}
    grid = t.spark.createDataFrame([(g, i, b, x) for g, i, w in _GRIDS for b, x in w.items()], "grid string, no int, branch string, weight double")
    rows = None
    for b, df in branches.items():
        one = df.select("query_id", "id", "rank", F.lit(b).alias("branch"))
        rows = one if rows is None else rows.unionByName(one)
    score = F.round(F.sum(F.col("weight") / (retrieval.RRF_K + F.col("rank"))), 12).alias("score")
    top = retrieval.ranked(rows.join(F.broadcast(grid), "branch").groupBy("grid", "no", "query_id", "id").agg(score), K, by=("grid", "no", "query_id"))
    gold = _gold(t).drop("query_type")
    top = materialize(top, "sweep-top")
    named = top.join(held.chunks.select("id", F.col("project").alias("group")), "id").select(F.concat_ws(":", "grid", "no").alias("config"), "query_id", F.col("id").alias("item"), "group", "rank")
    scored = evaluation.score_configs(named, gold, [f"{g}:{i}" for g, i, _ in _GRIDS])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    out = scored.groupBy("config").agg(mean("group_precision", "project_precision"), mean("mrr", "mrr"), mean("item_precision", "listing_precision"), mean("recall", "listing_recall"))
    out = out.select(F.split("config", ":")[0].alias("grid"), F.split("config", ":")[1].cast("int").alias("no"), "project_precision", "mrr", "listing_precision", "listing_recall")
    w = Window.partitionBy("grid")
    best = F.max_by("no", F.struct("listing_precision", "listing_recall", -F.col("no"))).over(w)
    return out.withColumn("place", F.row_number().over(w.orderBy(F.desc("project_precision"), F.desc("mrr"), "no")).cast("long")).withColumn("chosen", F.col("no") == best)


_NEAR = "e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier), adj as (select src as a, dst as b from e union all select dst, src from e), st as (select s_suppkey as query_id, 's' || s_suppkey as a from supplier), one as (select query_id, st.a as start, adj.b as node, 1 as depth from st join adj using (a)), two as (select query_id, start, adj.b as node, 2 as depth from one join adj on adj.a = node where adj.b <> start), mn as (select query_id, node, min(depth) as depth from (select * from one union all select * from two) group by all), gr as (select query_id, node as id, 1.0::double / (1 + depth) as score, row_number() over (partition by query_id order by depth, node) as rank from mn)"


@query(f"with {_NEAR} select query_id, id, round(score, 6) as score, rank from gr where rank <= {K}")
def graph_retrieve(t: Tables):
    """The nearest nodes of every supplier; hubs are cut before they are joined."""
    from pyspark.sql.window import Window

    from loomspark.operators import graph
    from loomspark.plans.facts_graph import _places

    edges = _places(t)
    starts = t.supplier.select(F.expr("'s' || s_suppkey").alias("start"), F.col("s_suppkey").alias("query_id"))
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    near = graph.nearest(edges, starts.select("start"), every, K).join(starts, "start")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "node")).cast("long")
    return near.select("query_id", F.col("node").alias("id"), F.round(1 / (1 + F.col("depth")), 6).alias("score"), rank.alias("rank"))


@query(f"with {_LISTS}, w(query_id, branch, weight) as (select distinct user_id, b, case b when 'vector' then 1.0 when 'bm25' then case when user_id % 2 = 0 then 0.6 else 0.3 end else case when user_id % 2 = 0 then 0.3 else 0.9 end end::double from events, (values ('vector'), ('bm25'), ('graph')) v(b)), u as (select query_id, id, rank, 'bm25' as branch from la union all select query_id, id, rank, 'vector' from lb union all select query_id, id, rank, 'graph' from la where id % 3 = 0), f as (select u.query_id, id, sum(weight / (60 + rank)) as score, string_agg(u.branch, '+' order by u.branch) as retriever from u join w on u.query_id = w.query_id and u.branch = w.branch group by all), r as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from f) select query_id, id, round(score, 6) as score, retriever, rank from r where rank <= {K}")
def fused_r3(t: Tables):
    a, b = _lists(t)
    users = t.events.select(F.col("user_id").alias("query_id")).distinct()
    of = lambda w: F.create_map(*[x for n, v in w.items() for x in (F.lit(n), F.lit(v))])
    weights = users.select("query_id", F.explode(F.when(F.col("query_id") % 2 == 0, of(retrieval.INTENT_WEIGHTS["fact"])).otherwise(of(retrieval.DISCOVERY_WEIGHTS))).alias("branch", "weight"))
    fused = retrieval.fuse([("bm25", a), ("vector", b), ("graph", a.where("id % 3 = 0"))], weights, K)
    return fused.select("query_id", "id", F.round("score", 6).alias("score"), "retriever", F.col("rank").cast("long").alias("rank"))
