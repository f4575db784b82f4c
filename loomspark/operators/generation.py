"""Context for a brief, its prompt, text made from a template, and the parts of an answer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import let, price_label
from loomspark.scratch import materialize

#: What predicates, values, channels and personas are called, and sizes.
PREDICATES = {
    "total_price_vnd": "Giá", "price_per_m2_vnd": "Giá/m²", "area_m2": "Diện tích", "bedrooms": "Phòng ngủ", "bathrooms": "Phòng tắm", "legal_status": "Pháp lý", "amenity": "Tiện ích",
    "property_type": "Loại hình", "building": "Tòa", "district": "Quận/huyện", "city": "Tỉnh/thành", "ward": "Phường/xã", "project": "Dự án",
}
PRICES = ("total_price_vnd", "price_per_m2_vnd")
VALUES = {
    "so_hong": "sổ hồng", "so_do": "sổ đỏ", "so_rieng": "sổ riêng", "so_hong_rieng": "sổ hồng riêng", "hdmb": "hợp đồng mua bán", "cong_chung": "công chứng", "vi_bang": "vi bằng", "giay_to_tay": "giấy tờ tay",
    "chinh_chu": "chính chủ", "ho_boi": "hồ bơi", "gym": "phòng gym", "cong_vien": "công viên", "truong_hoc": "trường học", "sieu_thi": "siêu thị", "ttmt": "trung tâm thương mại", "thang_may": "thang máy",
    "an_ninh": "an ninh 24/7", "bai_do_xe": "bãi đỗ xe", "ham_de_xe": "hầm để xe", "san_vuon": "sân vườn", "ban_cong": "ban công", "view_song": "view sông", "noi_that": "nội thất",
}
#: (name, least and most words, rules) of each channel.
CHANNELS = {
    "description": ("mô tả bất động sản", 180, 260, ("Mở đầu bằng vị trí và loại hình", "Nêu diện tích, số phòng, mức giá nếu có trong dữ kiện", "Kết bằng lời mời xem nhà")),
    "facebook": ("bài đăng Facebook", 80, 140, ("Chia dòng ngắn dễ đọc", "Tối đa 5 emoji", "Kết bằng 3–5 hashtag")),
    "email": ("email chăm sóc khách hàng", 120, 200, ("Có dòng tiêu đề email", "Xưng hô lịch sự", "Chỉ một lời kêu gọi hành động")),
    "landing_seo": ("nội dung landing page chuẩn SEO", 250, 400, ("Có tiêu đề H1 và ít nhất hai mục H2", "Đưa từ khóa chính vào 100 từ đầu", "Không nhồi từ khóa")),
}
PERSONAS = {
    "young_family": "gia đình trẻ, quan tâm trường học, an ninh, không gian sinh hoạt",
    "investor": "nhà đầu tư, quan tâm khả năng cho thuê, pháp lý, thanh khoản",
    "first_home": "người mua nhà lần đầu, quan tâm ngân sách, thanh toán, thủ tục",
}
MAX_FACTS, SNIPPET, MAX_PATHS, TEMPLATE_LINES = 24, 500, 3, 6
USES_RETRIEVAL = {"A": False, "B": True, "C": False, "D": True}
USES_ADAPTER = {"A": False, "B": False, "C": True, "D": True}
DEFAULT_FORBIDDEN, DEFAULT_TONE = "cam kết lợi nhuận, chắc chắn sinh lời", "tin cậy, rõ ràng, không thổi phồng"
NO_CONTEXT = "Không có dữ kiện truy xuất kèm theo. Chỉ viết dựa trên yêu cầu tóm tắt bên dưới, tuyệt đối không bịa số liệu cụ thể."
HEADLINE, CALL, TITLE_LINE = "Bất động sản phù hợp nhu cầu của bạn", "Liên hệ để được tư vấn và xem thực tế.", "Tiêu đề gợi ý:"


def label(names: dict[str, str], value: Column) -> Column:
    """What a value is called; itself where it has no name."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def fact_line(predicate: Column, value_text: Column, value_num: Column, valid_to: Column, source_url: Column) -> Column:
    value = F.when(predicate.isin(*PRICES) & (F.coalesce(value_num, F.lit(0.0)) != 0), price_label(value_num)).otherwise(label(VALUES, value_text))
    validity = F.when(F.coalesce(valid_to.cast("string"), F.lit("")) != "", F.concat(F.lit(" [hiệu lực đến "), valid_to.cast("string"), F.lit("]"))).otherwise(F.lit(""))
    source = F.when(F.coalesce(source_url, F.lit("")) != "", F.concat(F.lit(" (nguồn: "), source_url, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("- "), label(PREDICATES, predicate), F.lit(": "), value, validity, source)


def fact_payload(predicate: Column, value_text: Column) -> Column:
    """A fact as a claim is held against it."""
    return F.concat(label(PREDICATES, predicate), F.lit(": "), label(VALUES, value_text))


def snippet(text: Column, source_url: Column) -> Column:
    cut = F.translate(F.substring(text, 1, SNIPPET), "\n", " ")
    return F.concat(F.lit("- Trích tin đăng: "), cut, F.lit(" (nguồn: "), F.coalesce(source_url, F.lit("")), F.lit(")"))


def _lines(rows: DataFrame, order: Sequence[str], line: Column, name: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy("query_id").agg(F.transform(held, lambda x: x["line"]).alias(name))


def contexts(results: DataFrame, chunks: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_ids, context): a block of fact lines, snippets of the first ``k`` results and their first paths, for each question.

    Results are (query_id, id, rank, path), chunks (id, listing, text, source_url), facts (fact_id, listing,
    predicate, value_text, value_num, valid_to, source_url). Facts are those of the results' listings, as many as
    min(24, max(4 k, 8)), by predicate and id. Results are of a stated set of questions: they are written first, so
    that they are found once and no text or fact of another chunk travels to them.
    """
    results = materialize(results, "context-results")
    found = materialize(results.where(F.col("rank") <= k).join(chunks, "id"), "context-found")
    budget = min(MAX_FACTS, max(4 * k, 8))
    of = found.select("query_id", "listing").distinct().join(facts, "listing")
    first = of.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("predicate", "fact_id"))).where(F.col("i") <= budget)
    line = fact_line(*[F.col(c) for c in ("predicate", "value_text", "value_num", "valid_to", "source_url")])
    ids = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "fact_id"))), lambda x: x["fact_id"]).alias("fact_ids"))
    told = _lines(first, ["i"], line, "facts").join(ids, "query_id")
    shown = _lines(found, ["rank"], snippet(F.col("text"), F.col("source_url")), "snippets")
    paths = results.where("path is not null").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("i") <= MAX_PATHS)
    ways = _lines(paths, ["i"], F.concat(F.lit("- Quan hệ trong knowledge graph: "), "path"), "paths")
    none = F.array().cast("array<string>")
    parts = shown.join(told, "query_id", "left").join(ways, "query_id", "left")
    return parts.select("query_id", "fact_ids", F.array_join(F.concat(*[F.coalesce(c, none) for c in ("facts", "snippets", "paths")]), "\n").alias("context"))


def prompt(channel: Column, persona: Column, brief: Column, context: Column, forbidden: Column | None = None, tone: Column | None = None) -> Column:
    """What is asked of a writer; a null or empty context says that there is none."""
    pick = lambda i: label({c: str(spec[i]) for c, spec in CHANNELS.items()}, channel)
    length = label({c: f"{low}–{high} từ" for c, (_, low, high, _) in CHANNELS.items()}, channel)
    rules = label({c: "; ".join(r) for c, (*_, r) in CHANNELS.items()}, channel)
    either = lambda given, usual: F.coalesce(F.nullif(given, F.lit("")), F.lit(usual)) if given is not None else F.lit(usual)
    told = F.concat(F.lit("Dữ kiện được truy xuất (chỉ dùng những dòng này làm thông tin thực tế):\n"), context)
    return F.concat_ws(
        "\n", F.concat(F.lit("Nhiệm vụ: viết "), pick(0), F.lit(".")), F.concat(F.lit("Độ dài: "), length, F.lit(".")), F.concat(F.lit("Yêu cầu định dạng: "), rules, F.lit(".")),
        F.concat(F.lit("Khách hàng mục tiêu: "), label(PERSONAS, persona), F.lit(".")), F.concat(F.lit("Giọng thương hiệu: "), either(tone, DEFAULT_TONE), F.lit(".")),
        F.concat(F.lit("Từ cấm dùng: "), either(forbidden, DEFAULT_FORBIDDEN), F.lit(".")), F.lit(""), F.concat(F.lit("Yêu cầu cụ thể: "), brief), F.lit(""),
        F.when(F.coalesce(context, F.lit("")) != "", told).otherwise(F.lit(NO_CONTEXT)),
    )


def fingerprint(system: Column, user: Column) -> Column:
    return F.substring(F.sha2(F.concat(system, F.lit("\n---\n"), user), 256), 1, 32)


def from_template(user: Column) -> Column:
    """An answer put together from the prompt's own lines: its first lines of facts, else its first five."""

    def of(lines: Column) -> Column:
        facts = F.slice(F.filter(lines, lambda x: x.startswith("-")), 1, TEMPLATE_LINES)
        title = F.get(F.filter(lines, lambda x: x.startswith(TITLE_LINE)), 0)
        headline = F.coalesce(F.nullif(F.trim(F.replace(title, F.lit(TITLE_LINE), F.lit(""))), F.lit("")), F.lit(HEADLINE))
        body = F.array_join(F.when(F.size(facts) > 0, facts).otherwise(F.slice(lines, 1, 5)), "\n")
        return F.concat(F.lit("HEADLINE: "), headline, F.lit("\nBODY:\n"), body, F.lit(f"\nCTA: {CALL}"))

    return let(F.filter(F.transform(F.split(user, "\n"), lambda x: F.trim(x)), lambda x: x != ""), of)


def parsed(answer: Column) -> Column:
    """struct(headline, body, cta) of an answer; one without a body is all body."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = strip(F.regexp_extract(answer, r"(?s)BODY\s*:\s*(.*?)(?=\nCTA\s*:|\z)", 1))
    line = lambda name: strip(F.regexp_extract(answer, name + r"\s*:\s*([^\n]+)", 1))
    return F.struct(line("HEADLINE").alias("headline"), F.when(body != "", body).otherwise(strip(answer)).alias("body"), line("CTA").alias("cta"))


def resolve_adapter(config: str, loadable: Sequence[str], configured: str | None = None, named: str | None = None) -> str | None:
    """The adapter of a configuration: none for those without one, else the named one, the configured one, or the only one that can be loaded."""
    if not USES_ADAPTER[config]:
        return None
    name = named or configured or (loadable[0] if len(loadable) == 1 else None)
    if name is None or name not in loadable:
        raise FileNotFoundError(f"configuration {config} needs an adapter; loadable: {', '.join(loadable) or 'none'}")
    return name


def available(requested: Sequence[str], loadable: Sequence[str], configured: str | None = None) -> tuple[list[str], dict[str, str]]:
    """Configurations that can run, and why each of the others cannot."""
    runnable, skipped = [], {}
    for config in requested:
        if config not in USES_ADAPTER:
            skipped[config] = "unknown configuration"
            continue
        try:
            resolve_adapter(config, loadable, configured)
            runnable.append(config)
        except FileNotFoundError as e:
            skipped[config] = str(e)
    return runnable, skipped


def runs(briefs: DataFrame, held: DataFrame, configs: Sequence[str], system: str, adapters: dict[str, str | None] | None = None) -> DataFrame:
    """Records of all ``configs`` for each brief (query_id, brief, channel, persona), from the template; one pass for each configuration.

    ``held`` is :func:`contexts`; only configurations that retrieve see it, all are held against its facts.
    """
    rows = briefs.join(held, "query_id", "left")

    def of(config: str) -> DataFrame:
        adapter = (adapters or {}).get(config) or ""
        context = F.col("context") if USES_RETRIEVAL[config] else F.lit(None).cast("string")
        one = rows.withColumn("user", prompt(F.col("channel"), F.col("persona"), F.col("brief"), context)).withColumn("answer", from_template(F.col("user")))
        return one.select(
            F.lit(config).alias("config"), F.lit(f"template-v1+{adapter}" if adapter else "template-v1").alias("model_name"), "query_id", "channel", "persona", "brief",
            fingerprint(F.lit(system), F.col("user")).alias("prompt_hash"), "answer", parsed(F.col("answer")).alias("p"), F.col("fact_ids").alias("reference_fact_ids"),
        ).select("*", "p.*").drop("p")

    return reduce(DataFrame.unionByName, [of(c) for c in configs])


def reference_facts(records: DataFrame, facts: DataFrame, id_: str = "id") -> DataFrame:
    """(id, fact_id, ...): the facts that a record is checked against again: those it was held against, else those of its context."""
    none = F.array().cast("array<bigint>")
    given = F.when(F.size(F.coalesce("reference_fact_ids", none)) > 0, F.col("reference_fact_ids")).otherwise(F.coalesce("context_fact_ids", none))
    return records.select(F.col(id_), F.explode(F.array_distinct(given)).alias("fact_id")).join(facts, "fact_id")


def export_markdown(item: dict[str, Column]) -> Column:
    """An approved version as a page with a trace of where it comes from; ``item`` names its columns."""
    dash = lambda c: F.coalesce(F.nullif(item[c], F.lit("")), F.lit("—"))
    some = lambda c, made: F.when(F.coalesce(item[c], F.lit("")) != "", made).otherwise(F.lit(""))
    return F.concat(
        F.concat_ws(
            "\n", F.concat(F.lit("# "), F.coalesce(F.nullif(item["headline"], F.lit("")), item["title"])), F.lit(""), item["body"], F.lit(""), some("cta", F.concat(F.lit("**"), item["cta"], F.lit("**"))), F.lit(""), F.lit("---"), F.lit(""),
            F.lit("<!-- Truy vết (không đăng kèm) -->"), F.concat(F.lit("- Nội dung: `"), item["id"].cast("string"), F.lit("` · phiên bản "), item["version_no"].cast("string"), F.lit(" · trạng thái "), item["status"]),
            F.concat(F.lit("- Kênh: "), item["channel"], F.lit(" · persona: "), item["persona"], F.lit(" · dự án: "), dash("project")),
            F.concat(F.lit("- Sinh bằng: cấu hình "), dash("config"), F.lit(" · model `"), dash("model_name"), F.lit("`"), some("adapter", F.concat(F.lit(" · adapter `"), item["adapter"], F.lit("`")))),
            F.concat(F.lit("- Prompt version: "), dash("prompt_version"), some("generation_id", F.concat(F.lit(" · bản sinh gốc `"), item["generation_id"], F.lit("`")))),
            F.concat(F.lit("- Người biên tập sửa tay: "), F.when(item["edited"], "có").otherwise("không")), F.concat(F.lit("- Claim chưa có căn cứ: "), item["n_unsupported"].cast("string"), F.lit("/"), item["n_claims"].cast("string")),
        ), F.lit("\n"),
    )
