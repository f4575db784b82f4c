"""From raw listings to clean records, resolved projects, clusters, facts and graph candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import parse, text
from loomspark.functions.text import let
from loomspark.operators import dedup, graph, ingest

#: Fixed values.
PARSER_VERSION, ALIAS_CONFIDENCE, MIN_PROJECT_TOKENS, MAX_NAME_TOKENS, MAX_WARD_TOKENS = "reparse_v2", 0.75, 2, 8, 4


def admit(raw: DataFrame, index: DataFrame, key: str = "source_listing_id") -> DataFrame:
    """Raw records with their provenance row and the error_code of the first broken rule; a seller's name is never kept."""
    idx = index.select(key, *[F.col(c).alias(f"src_{c}") for c in index.columns if c != key], F.lit(True).alias("_src"))
    rows = raw.drop("seller_display_name").join(idx, key, "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [("invalid_json", F.col("_bad")), ("missing_source_listing_id", blank(key)), ("no_source_row", F.col("_src").isNull()), ("missing_provenance", blank("src_canonical_url") | blank("src_content_hash"))]
    return ingest.with_error(rows, rules).drop("_src")


def reparse(admitted: DataFrame) -> DataFrame:
    """Clean records of admitted ones: texts normalised once, then all fields from them."""
    base = admitted.withColumns({"title_clean": text.normalize(F.col("title")), "description_clean": text.normalize(F.col("description")), "_tail": parse.url_tail(F.col("src_canonical_url"))})
    body = F.concat_ws("\n", "title_clean", "description_clean")
    rows = base.withColumns({
        "property_type": F.coalesce("property_type", F.lit("")), "_rooms": F.col("bedrooms"), "_baths": F.col("bathrooms"), "_area": F.col("area_m2"),
        "price": parse.price(F.col("title_clean"), F.col("description_clean"), F.col("total_price_vnd")),
        "project_slug": parse.project_slug(F.col("_tail")), "ward": parse.ward(F.col("_tail")), "building_code": parse.building(body),
        "district": parse.district(body), "city": parse.city(body), "legal": text.keyword_values(body, parse.LEGAL), "amenities": text.keyword_values(body, parse.AMENITIES),
    })
    rows = rows.withColumns({"bedrooms": parse.rooms(F.col("_rooms")), "bathrooms": parse.rooms(F.col("_baths")), "area_m2": parse.area(F.col("_area"))})
    lost = lambda raw, now, name: F.when((F.coalesce(F.col(raw).try_cast("double"), F.lit(0.0)) != 0) & F.col(now).isNull(), name)
    outliers = F.concat_ws(";", lost("_rooms", "bedrooms", "bedrooms"), lost("_baths", "bathrooms", "bathrooms"), lost("_area", "area_m2", "area_m2"))
    place = F.when(F.col("district").isNotNull() | F.col("city").isNotNull(), "from_text").when(F.col("ward").isNotNull(), "ward_from_url").otherwise("missing")
    return rows.select(
        "source_listing_id", F.col("src_id").alias("source_row_id"), F.col("src_canonical_url").alias("canonical_url"), F.col("src_content_hash").alias("content_hash"),
        F.col("src_first_seen_at").alias("valid_from"), F.when(F.col("src_status") == "EXPIRED", F.col("src_last_seen_at")).otherwise("").alias("valid_to"),
        F.lit(PARSER_VERSION).alias("parser_version"), "property_type", "project_slug", F.lit(None).cast("string").alias("project_name"),
        parse.project_confidence(F.col("project_slug"), body).alias("project_confidence"), "building_code", parse.unit_type(F.col("property_type"), F.col("bedrooms")).alias("unit_type_key"),
        "ward", "district", "city", "area_m2", "bedrooms", "bathrooms", F.col("price.total").alias("total_price_vnd"), F.col("price.per_m2").alias("price_per_m2_vnd"),
        F.col("price.confidence").alias("price_confidence"), F.col("price.evidence").alias("price_evidence"), "legal", "amenities", "title_clean", "description_clean",
        F.length("description_clean").alias("description_len"), parse.tier(F.col("property_type"), F.col("project_slug"), F.length("description_clean")).alias("tier"),
        F.struct(
            F.when(F.col("project_slug").isNotNull(), "from_url").otherwise("missing").alias("project"), F.when(F.col("price.flag") != "", F.col("price.flag")).otherwise("missing").alias("price"),
            F.when(F.size("legal") > 0, "from_text").otherwise("missing").alias("legal"), place.alias("location"), F.lit("seller_dropped_phone_masked").alias("pii"), outliers.alias("outliers"),
        ).alias("field_flags"), "_tail",
    )


def contract(clean: DataFrame) -> DataFrame:
    """error_code of records without any text, then of those without any place."""
    empty = (F.col("title_clean") == "") & (F.col("description_clean") == "")
    nowhere = F.col("project_slug").isNull() & F.col("ward").isNull() & F.col("district").isNull() & F.col("city").isNull()
    return ingest.with_error(clean, [("empty_content", empty), ("no_project_no_location", nowhere)])


def ward_names(clean: DataFrame) -> DataFrame:
    """Wards that are sure: what stands before the area number of an address."""
    first = F.array_position(F.transform("_tail", lambda x: x.rlike("^[0-9]+$")), True).cast("int")
    name = F.array_join(F.slice("_tail", 1, F.when(first == 1, 1).otherwise(F.greatest(first - 1, F.lit(0)))), "-")
    return clean.where(first > 0).select(name.alias("ward_name")).where("ward_name <> ''").distinct()


def display_name(slug: Column, body: Column) -> Column:
    """The first words of the text that give the slug without accents, as written there. Only a window of the slug's own length can."""
    words = F.regexp_extract_all(body, F.lit("[0-9A-Za-zÀ-ỹĐđ]+"), F.lit(0))
    n = F.size(F.split(slug, "-"))

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")), lambda x: F.replace(text.deaccent(x), F.lit(" "), F.lit("-")) == slug), 0)

    return F.when(n.between(MIN_PROJECT_TOKENS, MAX_NAME_TOKENS), let(words, windows))


def resolve(clean: DataFrame) -> DataFrame:
    """Projects by number in the address, else by the longest sure ward before a name that the text confirms. Tier and flags follow."""
    body = F.concat_ws(" ", "title_clean", "description_clean")
    split = F.expr(f"transform(sequence(1, least(size(_tail), {MAX_WARD_TOKENS})), i -> struct(i as n, array_join(slice(_tail, 1, i), '-') as ward, array_join(slice(_tail, i + 1, size(_tail)), '-') as rest, size(_tail) - i as left))")
    open_ = clean.where(F.col("project_slug").isNull() & (F.size("_tail") > 0)).select("source_row_id", F.explode(split).alias("s"))
    best = open_.join(ward_names(clean), F.col("s.ward") == F.col("ward_name")).groupBy("source_row_id").agg(F.max_by("s", "s.n").alias("s"))
    found = clean.join(best, "source_row_id", "left").withColumn("_candidate", F.when(F.col("s.left") >= MIN_PROJECT_TOKENS, F.col("s.rest")))
    found = found.withColumn("_name", display_name(F.coalesce("project_slug", "_candidate"), body))
    coded, listed = F.col("project_slug").isNotNull(), F.col("_candidate").isNotNull() & F.col("_name").isNotNull()
    slug = F.when(coded, F.col("project_slug")).when(listed, F.col("_candidate"))
    source = F.when(coded & F.col("_name").isNotNull(), "url_code_confirmed").when(coded, "url_code").when(listed, "ward_dictionary").otherwise("missing")
    out = {
        "project_slug": slug, "project_name": F.when(coded, F.coalesce("_name", parse.slug_name(F.col("project_slug")))).when(listed, F.col("_name")),
        "project_confidence": F.when(~coded & listed, ALIAS_CONFIDENCE).otherwise(F.col("project_confidence")), "ward": F.coalesce(F.when(~coded, F.col("s.ward")), F.col("ward")),
        "field_flags": F.col("field_flags").withField("project", source), "tier": parse.tier(F.col("property_type"), slug, F.col("description_len")),
    }
    return found.withColumns(out).drop("s", "_candidate", "_name")


def near_clusters(clean: DataFrame, most: int = dedup.MAX_BITS) -> DataFrame:
    """Clean records with their cluster: equal content hashes and SimHashes within ``most`` bits; the smallest key, as a string, names it."""
    sig = dedup.simhash_exact(clean, "source_listing_id", "description_clean").where("simhash <> ''").select("id", F.conv("simhash", 16, -10).cast("long").alias("simhash"))
    near = dedup.near_pairs(sig, bits=64, most=most).select("a", "b")
    first = clean.groupBy("content_hash").agg(F.min("source_listing_id").alias("a"))
    same = clean.join(first, "content_hash").where("source_listing_id <> a").select("a", F.col("source_listing_id").alias("b"))
    found = dedup.clusters(clean.select(F.col("source_listing_id").alias("id"), F.col("description_len").alias("length")), near.unionByName(same))
    return clean.join(found.withColumnRenamed("id", "source_listing_id"), "source_listing_id")


def build_facts(clean: DataFrame) -> DataFrame:
    """A fact for each value of a record, with confidence, evidence, review flag and provenance."""
    kind = "struct<predicate: string, value_text: string, value_num: double, unit: string, confidence: double, evidence: string, needs_review: boolean>"

    def fact(predicate: str, value: Column, num: Column | None = None, unit: str = "", confidence: Column | float = 1.0, evidence: Column | str = "", review: Column | bool = False) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        one = F.struct(F.lit(predicate), value.cast("string"), (F.lit(None) if num is None else num).cast("double"), F.lit(unit), as_col(confidence), as_col(evidence), as_col(review)).cast(kind)
        return F.when(value.isNotNull() & (value.cast("string") != "") & ((num if num is not None else F.lit(1)) != 0), one)

    c = F.col
    crawled = lambda name: F.lit(f"crawler:{name}")
    parsed = F.when(c("price_confidence") == "parsed", 0.95).otherwise(0.8)
    address, head = F.concat(F.lit("canonical_url:"), "canonical_url"), F.substring("title_clean", 1, 200)
    single = F.array(
        fact("property_type", c("property_type"), confidence=0.95, evidence=crawled("property_type")),
        *[fact(n, c(n), c(n), unit, 0.9, crawled(n)) for n, unit in (("area_m2", "m2"), ("bedrooms", "phòng"), ("bathrooms", "phòng"))],
        fact("total_price_vnd", c("total_price_vnd").cast("long"), c("total_price_vnd"), "VND", parsed, c("price_evidence"), parsed < 0.85),
        fact("price_per_m2_vnd", c("price_per_m2_vnd").cast("long"), c("price_per_m2_vnd"), "VND/m2", 0.8, c("price_evidence"), True),
        fact("project", c("project_slug"), confidence=c("project_confidence"), evidence=F.when(c("project_name").isNotNull(), F.concat_ws(" · ", "project_name", "canonical_url")).otherwise(address), review=c("project_confidence") < 0.7),
        fact("building", c("building_code"), confidence=0.7, evidence=head, review=True),
        fact("ward", c("ward"), confidence=0.9, evidence=address), fact("district", c("district"), confidence=0.8, evidence=head), fact("city", c("city"), confidence=0.8, evidence=head),
    )
    many = lambda column, predicate, confidence, review: F.transform(column, lambda x: F.struct(F.lit(predicate), x["value"], F.lit(None).cast("double"), F.lit(""), F.lit(confidence), x["snippet"], F.lit(review)).cast(kind))
    every = F.concat(F.array_compact(single), many("legal", "legal_status", 0.8, False), many("amenities", "amenity", 0.7, True))
    rows = clean.select("source_row_id", "source_listing_id", "canonical_url", "content_hash", "parser_version", "valid_from", "valid_to", F.posexplode(every).alias("fact_no", "f"))
    return rows.select("*", "f.*", text.sha_key("source_listing_id", "f.predicate", "f.value_text").alias("fact_key")).drop("f")


def graph_candidates(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge candidates of records that have a project: buildings, unit types, ward, district, city and amenities, missing links skipped."""
    c = F.col
    node = lambda kind, key, name, attributes: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("entity_type"), key.alias("canonical_key"), name.alias("name"), attributes.alias("attributes")))
    own = clean.where(c("project_slug").isNotNull())
    building = F.concat_ws("::", "project_slug", F.col("building_code"))
    building, unit = F.when(c("building_code").isNotNull(), building), F.when(c("unit_type_key").isNotNull(), F.concat_ws("::", "project_slug", "unit_type_key"))
    district, city = F.when(c("district").isNotNull(), text.slug(c("district"))), F.when(c("city").isNotNull(), text.slug(c("city")))
    of = lambda *pairs: F.to_json(F.struct(*[v.alias(k) for k, v in pairs]))
    none = F.lit("{}")
    nodes = F.array_compact(F.array(
        node("Project", c("project_slug"), F.coalesce("project_name", parse.slug_name(c("project_slug"))), of(("property_type", c("property_type")))),
        node("Building", building, F.concat(F.lit("Tòa "), "building_code"), of(("project_slug", c("project_slug")))),
        node("UnitType", unit, c("unit_type_key"), of(("project_slug", c("project_slug")), ("bedrooms", c("bedrooms")))),
        node("District", district, c("district"), none), node("City", city, c("city"), none), node("Ward", c("ward"), parse.slug_name(c("ward")), none),
    ))
    amenity = F.transform("amenities", lambda x: F.struct(F.lit("Amenity").alias("entity_type"), x["value"].alias("canonical_key"), x["value"].alias("name"), none.alias("attributes")))
    id_ = lambda kind, key: F.concat(F.lit(f"{kind}:"), key)
    edge = lambda src, dst, kind: F.when(src.isNotNull() & dst.isNotNull(), F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type")))
    p, b, u, w, d, t = id_("Project", c("project_slug")), id_("Building", building), id_("UnitType", unit), id_("Ward", c("ward")), id_("District", district), id_("City", city)
    above_ward = F.when(c("ward").isNotNull(), F.coalesce(d, t))
    edges = F.array_compact(F.array(
        edge(b, p, "PART_OF"), edge(p, u, "HAS_UNIT_TYPE"), edge(b, u, "HAS_UNIT_TYPE"), edge(p, F.coalesce(w, d, t), "LOCATED_IN"), edge(w, above_ward, "LOCATED_IN"), edge(d, t, "LOCATED_IN"),
    ))
    has = F.transform("amenities", lambda x: F.struct(p.alias("src"), id_("Amenity", x["value"]).alias("dst"), F.lit("HAS_AMENITY").alias("edge_type")))
    node_rows = own.select(F.col("source_listing_id").alias("listing_id"), F.explode(F.concat(nodes, amenity)).alias("n")).select("n.*", "listing_id")
    edge_rows = own.select(F.col("source_listing_id").alias("listing_id"), "valid_from", "valid_to", F.explode(F.concat(edges, has)).alias("e")).select("e.*", "listing_id", "valid_from", "valid_to")
    return node_rows, edge_rows


def build_graph(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph_candidates(clean)
    return graph.nodes(nodes), graph.edges(edges)


def run(raw: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """All stages: quarantine, clean, facts, nodes and edges, as DataFrames that nothing has run yet."""
    admitted = admit(raw, index)
    parsed = contract(reparse(ingest.accepted(admitted)))
    clean = near_clusters(resolve(ingest.accepted(parsed)))
    rejected = ingest.quarantined(admitted, F.coalesce("source_listing_id", F.lit("")), F.col("_line")).unionByName(
        ingest.quarantined(parsed, F.col("source_listing_id"), F.to_json(F.struct("canonical_url", "content_hash")))
    )
    nodes, edges = build_graph(clean)
    return {"quarantine": rejected, "clean": clean.drop("_tail"), "facts": build_facts(clean), "nodes": nodes, "edges": edges}
