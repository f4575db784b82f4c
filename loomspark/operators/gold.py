"""Questions with known answers, made from clean rows by templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import sha_key, two_decimals
from loomspark.operators.evaluation import AREA_TOLERANCE, PER_TYPE
from loomspark.scratch import materialize

MIN_ANSWERS = 3


def grouped(rows: DataFrame, keys: list[str], id_: str, project: str | None, kind: str, question: Column, quota: int = PER_TYPE, least: int = MIN_ANSWERS) -> DataFrame:
    """(query_type, query_key, question, expected_ids, expected_projects): a question for each of the ``quota`` largest groups with ``least`` answers."""
    projects = F.array_sort(F.collect_set(project)) if project else F.array().cast("array<string>")
    # The largest groups are known before any group's ids are gathered.
    first = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), *keys).limit(quota)
    held = rows.join(F.broadcast(first.select(*[F.col(k).alias(f"_{k}") for k in keys])), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    answers = held.groupBy(*keys).agg(F.array_sort(F.collect_list(id_)).alias("expected_ids"), projects.alias("expected_projects"))
    return answers.select(F.lit(kind).alias("query_type"), sha_key(F.lit(kind), question, length=32).alias("query_key"), question.alias("question"), "expected_ids", "expected_projects")


def near_anchor(rows: DataFrame, keys: list[str], id_: str, value: str, tolerance: float = AREA_TOLERANCE) -> DataFrame:
    """Rows within the tolerance of their group's row with the smallest id, whose value they get as ``anchor``."""
    anchors = rows.groupBy(*keys).agg(F.min_by(value, id_).alias("anchor"))
    return rows.join(anchors, keys).where(F.abs(F.col(value) - F.col("anchor")) <= tolerance * F.col("anchor"))


def ward_label(found: Column, ward: Column) -> Column:
    """A ward's name as its rows write it, capitals only at the words' beginnings if they write all in capitals; else made from its key."""
    made = F.initcap(F.replace(ward, F.lit("-"), F.lit(" ")))
    return F.when(F.coalesce(found, F.lit("")) == "", made).when((found == F.upper(found)) & (found != F.lower(found)), F.initcap(found)).otherwise(found)


def price_text(value: Column) -> Column:
    return F.replace(F.concat(two_decimals(value / 1e9), F.lit(" tỷ")), F.lit(".00"), F.lit(""))


def expected_projects(project: Column, entities: Column) -> Column:
    """The question's project and the keys among its entities: those in lower case without blanks."""
    keys = F.filter(entities, lambda e: ~e.contains(" ") & (e == F.lower(e)) & (e != F.upper(e)))
    return F.array_sort(F.array_distinct(F.concat(F.when(project.isNotNull(), F.array(project)).otherwise(F.array().cast("array<string>")), keys)))


def located(rows: DataFrame, quota: int = PER_TYPE) -> DataFrame:
    """Questions for the wards, with their district, that most rows lie in: (id, ward, district, ward_name); numbers and very short keys are no wards."""
    good = rows.where((F.length("ward") >= 3) & ~F.col("ward").rlike("^[0-9]+$")).withColumn("district", F.coalesce("district", F.lit("")))
    names = good.groupBy("ward", "district").agg(F.min_by("ward_name", F.when(F.coalesce(F.col("ward_name"), F.lit("")) != "", F.col("id"))).alias("found"))
    place = F.concat(ward_label(F.col("found"), F.col("ward")), F.when(F.col("district") != "", F.concat(F.lit(", "), "district")).otherwise(F.lit("")))
    asked = F.concat(F.lit("Đang rao bán những bất động sản nào ở "), "place", F.lit("?"))
    placed = good.drop("ward_name").join(names.select("ward", "district", place.alias("place")), ["ward", "district"])
    return grouped(placed, ["ward", "district", "place"], "id", "project" if "project" in rows.columns else None, "hard_location", asked, quota)


def standard(rows: DataFrame, buildings: DataFrame, quota: int = PER_TYPE, version: str = "v1") -> DataFrame:
    """(query_type, query_key, question, project, expected_ids, expected_entities, expected_projects): six kinds of questions that name projects.

    ``rows`` are those of the test split: (id, project, name, price, bedrooms, ward, district, city, building);
    ``buildings`` (project, buildings), sorted names. Of each kind, the first ``quota`` projects that have what it
    asks for, by falling number of rows, then key; of a project's rows, the one with the smallest id that has it.
    """
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != (F.lit("") if dict(rows.dtypes)[c] == "string" else F.lit(0)))
    first = lambda value, when: F.min_by(value, F.when(when, F.col("id")))
    placed, whole = has("ward") | has("district"), has("district") & has("city")
    facts = rows.groupBy("project").agg(
        F.count("*").alias("n"), first("name", has("name")).alias("name"), first("bedrooms", has("price") & has("bedrooms")).alias("rooms"), F.count_if(has("price")).alias("n_priced"),
        first(F.struct("ward", "district"), placed).alias("at"), first(F.struct("district", "city"), whole).alias("within"), first("city", has("city")).alias("city"),
    ).join(buildings, "project", "left").withColumn("name", F.coalesce("name", F.initcap(F.replace("project", F.lit("-"), F.lit(" ")))))
    facts = materialize(facts, "gold-projects")  # read once for each kind
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    name, project = F.col("name"), F.col("project")
    none = F.lit(None).cast("int")

    def chosen(kind: str, question: Column, entities: Column, only: Column, of: str = "all", rooms: Column = none) -> DataFrame:
        top = facts.where(only).orderBy(F.desc("n"), "project").limit(quota)
        return top.select(F.lit(kind).alias("query_type"), question.alias("question"), "project", entities.alias("expected_entities"), F.array("project").alias("_of"), F.lit(of).alias("_rows"), rooms.cast("int").alias("_rooms"))

    place = F.coalesce(F.nullif("at.district", F.lit("")), F.initcap(F.replace("at.ward", F.lit("-"), F.lit(" "))))
    held = F.size(F.coalesce("buildings", F.array().cast("array<string>"))) > 0
    two = F.when(held, text("Dự án ", name, " có những tòa nào và mỗi tòa có loại căn gì?")).otherwise(text("Dự án ", name, " thuộc quận nào của tỉnh/thành nào?"))
    two_entities = F.when(held, F.concat(F.array("project"), F.col("buildings"))).otherwise(F.array("project", "within.district", "within.city"))
    asked = [
        chosen("fact", text("Căn ", F.col("rooms").cast("string"), " phòng ngủ tại dự án ", name, " giá bao nhiêu?"), F.array("project"), F.col("rooms").isNotNull(), "rooms", F.col("rooms")),
        chosen("one_hop", text("Dự án ", name, " nằm ở khu vực nào?"), F.array(project, place), F.col("at").isNotNull()),
        chosen("two_hop", two, two_entities, held | F.col("within").isNotNull()),
        chosen("temporal", text("Thông tin giá của dự án ", name, " được ghi nhận vào thời điểm nào và còn hiệu lực không?"), F.array("project"), F.col("n_priced") > 0, "priced"),
    ]
    asked[2] = asked[2].join(facts.select("project", held.alias("_held")), "project").withColumn("_rows", F.when(F.col("_held"), "building").otherwise("all")).drop("_held").select(asked[0].columns)
    # Neighbours in a city's order of projects are compared.
    w = Window.partitionBy("city").orderBy(F.desc("n"), "project")
    ordered = facts.where("city is not null").withColumn("_pair", F.expr("(row_number() over (partition by city order by n desc, project) - 1) div 2")).withColumn("_i", F.row_number().over(w) % 2)
    left = ordered.where("_i = 1").select("city", "_pair", F.col("project").alias("a"), F.col("name").alias("an"), F.col("n").alias("ac"))
    right = ordered.where("_i = 0").select("city", "_pair", F.col("project").alias("b"), F.col("name").alias("bn"), F.col("n").alias("bc"))
    both = left.join(right, ["city", "_pair"]).where("ac >= 2 or bc >= 2").orderBy("city", "_pair").limit(quota)
    compared = text("So sánh giá và diện tích căn hộ giữa dự án ", F.col("an"), " và dự án ", F.col("bn"), " tại ", F.col("city"), ".")
    asked.append(both.select(F.lit("compare").alias("query_type"), compared.alias("question"), F.col("a").alias("project"), F.array("a", "b").alias("expected_entities"), F.array("a", "b").alias("_of"), F.lit("all").alias("_rows"), none.alias("_rooms")))
    # The smallest number of rooms that has several prices.
    by_rooms = rows.where(has("price") & has("bedrooms")).groupBy("project", "bedrooms").agg(F.count_distinct(F.bround("price")).alias("k"), F.array_join(F.array_sort(F.collect_set(price_text(F.col("price")))), ", ").alias("prices")).where("k > 1")
    clash = by_rooms.groupBy("project").agg(F.min_by(F.struct("bedrooms", "prices"), "bedrooms").alias("c"))
    most = facts.select("project", "n", "name").join(clash, "project").orderBy(F.desc("n"), "project").limit(quota)
    conflict = text("Căn ", F.col("c.bedrooms").cast("string"), " phòng ngủ tại dự án ", name, " đang được rao ở nhiều mức giá (", F.col("c.prices"), ") — dữ liệu nào là nguồn nào?")
    asked.append(most.select(F.lit("conflict").alias("query_type"), conflict.alias("question"), "project", F.array("project").alias("expected_entities"), F.array("project").alias("_of"), F.lit("rooms").alias("_rows"), F.col("c.bedrooms").cast("int").alias("_rooms")))
    every = asked[0]
    for one in asked[1:]:
        every = every.unionByName(one)
    # A few dozen questions meet the rows of their projects.
    wanted = every.withColumn("_project", F.explode("_of"))
    r = rows.select("id", F.col("project").alias("_project"), has("price").alias("_priced"), F.col("bedrooms").alias("_b"), has("building").alias("_built"))
    match = F.when(F.col("_rows") == "rooms", F.col("_priced") & (F.col("_b") == F.col("_rooms"))).when(F.col("_rows") == "priced", F.col("_priced")).when(F.col("_rows") == "building", F.col("_built")).otherwise(True)
    ids = wanted.select("query_type", "question", "_project", "_rows", "_rooms").join(r, "_project").where(match).groupBy("query_type", "question").agg(F.array_sort(F.collect_list("id")).alias("expected_ids"))
    return every.join(ids, ["query_type", "question"], "left").select(
        "query_type", sha_key(F.lit(version), "query_type", "question", length=32).alias("query_key"), "question", "project",
        F.coalesce("expected_ids", F.array().cast(f"array<{dict(rows.dtypes)['id']}>")).alias("expected_ids"), "expected_entities", expected_projects(F.col("project"), F.col("expected_entities")).alias("expected_projects"),
    )


def counts(questions: DataFrame) -> DataFrame:
    """(measure, key, n): questions by type, by difficulty, and those that wait for a review."""
    by = lambda c: questions.groupBy(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    return by("query_type").unionByName(by("difficulty")).unionByName(by("needs_review"))
