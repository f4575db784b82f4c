"""Text functions and parsers over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import parse, text
from loomspark.operators import evaluation, retrieval
from loomspark.plans.registry import Tables, collector

QUERIES, ORACLE_SQL, query = collector()

#: The text functions in SQL, from which oracles are put together.
FLAT = "replace(strip_accents(lower({0})), 'đ', 'd')"
SYLLABLES = "list_filter(regexp_extract_all(" + FLAT + ", '[a-z0-9]+'), lambda t: length(t) <= 60)"
TERMS = "(select list_concat(s, list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || '_' || s[i + 1])) from (select " + SYLLABLES + " as s))"


@query(f"select doc_id, array_to_string({SYLLABLES.format('text')}, ' ') as tokens from documents")
def deaccent_tokens(t: Tables):
    return t.documents.select("doc_id", F.array_join(text.syllables(F.col("text")), " ").alias("tokens"))


@query(f"with s as (select doc_id, {SYLLABLES.format('text')} as s from documents), w as (select doc_id, unnest(list_concat(s, list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || '_' || s[i + 1]))) as term from s) select doc_id as id, term, count(*) as tf from w group by all")
def term_frequency(t: Tables):
    return retrieval.term_frequency(t.documents, "doc_id", "text")


@query("""
with s as (select page_id, coalesce(nullif(str_split(url, '/')[4], ''), '') as seg from pages),
k as (select page_id, list_filter(str_split(translate(seg, '_', '-'), '-'), lambda x: x <> '') as toks from s)
select page_id, array_to_string(toks, '|') as tokens, cast(len(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+'))) as bigint) as n_numbers from k
""")
def url_tokens(t: Tables):
    segment = F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(4)), F.lit(""))
    tokens = F.filter(F.split(F.translate(segment, "_", "-"), "-"), lambda x: x != "")
    return t.pages.select("page_id", F.array_join(tokens, "|").alias("tokens"), F.size(F.filter(tokens, lambda x: x.rlike("^[0-9]+$"))).cast("long").alias("n_numbers"))


#: Addresses made from keys of orders, so that every branch of the address parser is taken.
_ADDRESS = "concat('https://x.vn/ban-', {kind}, '-duong-', o_orderkey, {mark}, 'nhan-chinh', {code}, {slug}, '/p')"
_PARTS = {
    "kind": "case when o_orderkey % 3 = 0 then 'can-ho' else 'nha' end",
    "mark": "case o_orderkey % 5 when 0 then '-phuong-' when 1 then '-xa-' when 2 then '-quan-' when 3 then '-thi-tran-' else '-duong-' end",
    "code": "case when o_orderkey % 4 = 0 then '' else concat('-', cast(o_orderkey % 90 as string)) end",
    "slug": "case o_orderkey % 6 when 0 then '' when 1 then '-can-ho' else concat('-the-diamond-', cast(o_custkey % 50 as string), 'a') end",
}
ADDRESS = _ADDRESS.format(**_PARTS)
_TAIL = """
with a as (select o_orderkey, str_split({address}, '/')[4] as seg from orders),
m as (select o_orderkey, case when regexp_matches(seg, '-(phuong|xa|thi-tran)-') then regexp_extract(seg, '^.*-(?:phuong|xa|thi-tran)-(.*)$', 1)
  when regexp_matches(seg, '-(quan|huyen|thi-xa|thanh-pho)-') then regexp_extract(seg, '^.*-(?:quan|huyen|thi-xa|thanh-pho)-(.*)$', 1) else '' end as tail from a),
k as (select o_orderkey, list_filter(str_split(replace(tail, '_', '-'), '-'), lambda x: x <> '') as toks from m),
d as (select *, list_filter(range(1, len(toks) + 1), lambda i: regexp_full_match(toks[i], '[0-9]+')) as ds from k),
r as (select *, case when len(ds) > 0 then toks[ds[len(ds)] + 1 : len(toks)] else [] end as rest,
  case when len(ds) = 0 then toks[1:2] when ds[1] = 1 then toks[1:1] else toks[1 : ds[1] - 1] end as w from d)
select o_orderkey, case when len(list_filter(rest, lambda x: not list_contains(['nha','dat','ban','cho','thue','can','ho','chung','cu'], x))) > 0 then array_to_string(rest, '-') end as project,
  nullif(array_to_string(list_filter(w, lambda x: not list_contains(['nha','dat','ban','cho','thue','can','ho','chung','cu'], x)), '-'), '') as ward from r
"""


@query(_TAIL.format(address=ADDRESS.replace("as string", "as varchar")))
def url_tail_tokens(t: Tables):
    tail = parse.url_tail(F.expr(ADDRESS))
    return t.orders.select("o_orderkey", parse.project_slug(tail).alias("project"), parse.ward(tail).alias("ward"))


def _hint_sql(column: str) -> str:
    cases = " ".join(f"when {' or '.join(f"contains(f, '{h}')" for h in hints)} then '{name}'" for name, hints in retrieval.INTENT_HINTS)
    return f"with q as (select conv_id, turn, {FLAT.format(column)} as f from conversations) select conv_id, turn, case {cases} else 'general' end as intent from q"


@query(_hint_sql("text || case conv_id % 5 when 0 then ' so sánh' when 1 then ' thuộc quận nào' when 2 then ' cập nhật' when 3 then ' diện tích' else '' end"))
def intent_classify(t: Tables):
    asked = F.expr("text || case conv_id % 5 when 0 then ' so sánh' when 1 then ' thuộc quận nào' when 2 then ' cập nhật' when 3 then ' diện tích' else '' end")
    return t.conversations.select("conv_id", "turn", retrieval.intent(asked).alias("intent"))


_KEYS = {"license": "license", "licence": "license", "the ": "article", "token": "secret", "mail": "contact", "und": "german"}


@query(
    "with d as (select doc_id, text, lower(text) as l from documents), k(kw, v, i) as (values "
    + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(_KEYS.items()))
    + "), h as (select doc_id, v, arg_min(trim(substr(text, greatest(strpos(l, kw) - 30, 1), least(strpos(l, kw) - 1 + length(kw) + 30, length(text)) - greatest(strpos(l, kw) - 31, 0)), ' '), i) as snip from d, k where contains(l, kw) group by doc_id, v) "
    "select d.doc_id, coalesce(string_agg(v || ':' || snip, ';' order by v), '') as found from d left join h using (doc_id) group by d.doc_id"
)
def keyword_dictionary(t: Tables):
    found = text.keyword_values(F.col("text"), _KEYS)
    return t.documents.select("doc_id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["value"], x["snippet"])), ";").alias("found"))


@query("select page_id, sha256(regexp_replace(regexp_replace(html, 'Sentry\\.onLoad.*', ' ', 's'), 'function\\s*\\(\\s*\\)\\s*\\{.*', ' ', 's')) as plain_hash from (select page_id, html || case when page_id % 3 = 0 then 'Sentry.onLoad(1)\nx' when page_id % 3 = 1 then 'function () { a }' else '' end as html from pages)")
def boilerplate_strip(t: Tables):
    page = F.expr(r"html || case when page_id % 3 = 0 then 'Sentry.onLoad(1)\nx' when page_id % 3 = 1 then 'function () { a }' else '' end")
    return t.pages.select("page_id", F.sha2(text.strip_boilerplate(page), 256).alias("plain_hash"))


@query("""
with n as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) as tok from documents),
v as (select doc_id, regexp_replace(replace(tok, ',', '.'), '\\.0$', '') as v from n)
select doc_id, count(*) as n, max(case when contains(v, '.') then regexp_replace(regexp_replace(v, '0+$', ''), '\\.$', '') else v end) as top from v group by doc_id
""")
def number_extract_normalize(t: Tables):
    tokens = F.explode(F.regexp_extract_all("text", F.lit(evaluation.NUMBER), F.lit(0)))
    return t.documents.select("doc_id", tokens.alias("tok")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(text.number(F.col("tok"))).alias("top"))


@query("""
select o_orderkey, case when p >= 1e9 then regexp_replace(regexp_replace(printf('%.2f', p / 1e9), '0+$', ''), '\\.$', '') || ' tỷ' else printf('%.0f', p / 1e6) || ' triệu' end as label
from (select o_orderkey, round(o_totalprice) * 30000 + 1000 as p from orders)
""")
def format_price(t: Tables):
    return t.orders.select("o_orderkey", text.price_label(F.round("o_totalprice") * 30000 + 1000).alias("label"))


@query("select doc_id, sha256(concat_ws('|', cast(doc_id as varchar), source, lang)) as fact_key, substr(sha256(text), 1, 32) as prefix from documents")
def content_keys(t: Tables):
    return t.documents.select("doc_id", text.sha_key(F.col("doc_id").cast("string"), "source", "lang").alias("fact_key"), F.substring(F.sha2("text", 256), 1, 32).alias("prefix"))


@query("select doc_id, cast(greatest(1, length(text) // 4) as integer) as tokens, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as integer) as words from documents")
def length_estimates(t: Tables):
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.words(F.col("text")).alias("words"))


@query("select c_custkey, array_to_string(list_filter(regexp_split_to_array(replace(replace(strip_accents(lower(c_name || '. Đường ' || c_mktsegment)), 'đ', 'd'), '.', ' '), '\\s+'), lambda x: x <> ''), '-') as slug from customer")
def key_slug(t: Tables):
    return t.customer.select("c_custkey", text.slug(F.expr("c_name || '. Đường ' || c_mktsegment")).alias("slug"))


@query()
def phone_mask(t: Tables):
    """Rows only: the pattern needs look-behind. Tested against a plain version."""
    return t.documents.select("doc_id", text.mask_phones(F.concat("text", F.lit(" 0901 234 567."))).alias("masked"))


@query()
def normalized_text(t: Tables):
    """Rows only: NFC and entities have no SQL."""
    return t.documents.select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("digest"))


@query()
def price_parse(t: Tables):
    """Rows only: prices in Vietnamese sentences made from orders; the parser is tested case by case."""
    title = F.concat(F.lit("Bán nhà giá "), F.expr("cast(o_orderkey % 40 + 1 as string)"), F.expr("case o_orderkey % 3 when 0 then ' tỷ' when 1 then ' tỷ 5' else '00 triệu' end"))
    return t.orders.select("o_orderkey", parse.price(title, F.lit("hỗ trợ vay 2 tỷ"), F.lit(None).cast("double")).alias("p")).select("o_orderkey", "p.*")
