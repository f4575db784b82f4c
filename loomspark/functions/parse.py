"""Parsers of listing fields: prices, addresses in URLs, buildings, keywords, places, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import deaccent, evidence, fold, let

#: Fixed values.
TY = r"(?iu)(\d{1,4}(?:[.,]\d{1,3})?)\s*(?:tỷ|tỉ|ty)(?:\s*(\d{1,3})(?!\s*(?:m|tr|%|,|\.|\d|phòng|pn|ngủ|wc|tầng|lầu|triệu|nghìn|tỷ|tỉ)))?"
TRIEU = r"(?iuU)(\d{2,5}(?:[.,]\d{1,2})?)\s*(?:triệu|tr)\b(?!\s*/)"
PER_M2 = r"(?iu)(\d{1,4}(?:[.,]\d{1,2})?)\s*(?:triệu|tr)\s*/\s*m"
TOTAL_RANGE, PER_M2_RANGE = (100_000_000, 1_000_000_000_000), (1_000_000, 1_000_000_000)
NOT_PRICE_BEFORE = ("vốn", "cọc", "trả trước", "vay", "hỗ trợ", "chiết khấu", " ck ", "thuế", "phí", "lãi", "tặng", "giảm", "tiết kiệm", "lợi nhuận", "doanh thu")
NOT_PRICE_AFTER = ("vốn", "cọc", "lợi nhuận", "lãi")
PRICE_BEFORE = ("giá", "bán", "chỉ")
FAR, NEAR, AFTER = 25, 10, 15
WARD_TAIL, DISTRICT_TAIL = r"^.*-(?:phuong|xa|thi-tran)-(.*)$", r"^.*-(?:quan|huyen|thi-xa|thanh-pho)-(.*)$"
SLUG_STOP = ("nha", "dat", "ban", "cho", "thue", "can", "ho", "chung", "cu")
BUILDING = r"(?U)\b(?:tòa|toà|block|tháp|tower)\s+([A-Za-z]{0,3}\d{1,2}|[A-Ha-h])\b"
BUILDING_STOP = ("nha", "chung", "can", "van", "cao", "the", "ho")
DISTRICT_NUMBER = r"(?iuU)\b(?:quận|q\.)\s*(\d{1,2})\b"
DISTRICT_NAME = r"(?U)\b(?:[Qq]uận|[Hh]uyện)\s+[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+){0,2}"
LEGAL = {
    "sổ hồng": "so_hong", "sổ đỏ": "so_do", "sổ riêng": "so_rieng", "sổ hồng riêng": "so_hong_rieng", "hđmb": "hdmb",
    "hợp đồng mua bán": "hdmb", "công chứng": "cong_chung", "vi bằng": "vi_bang", "giấy tờ tay": "giay_to_tay", "chính chủ": "chinh_chu",
}
AMENITIES = {
    "hồ bơi": "ho_boi", "bể bơi": "ho_boi", "gym": "gym", "công viên": "cong_vien", "trường học": "truong_hoc", "siêu thị": "sieu_thi",
    "trung tâm thương mại": "ttmt", "thang máy": "thang_may", "an ninh": "an_ninh", "bãi đỗ xe": "bai_do_xe", "hầm để xe": "ham_de_xe",
    "sân vườn": "san_vuon", "ban công": "ban_cong", "view sông": "view_song", "nội thất": "noi_that",
}
CITIES = {
    "ho chi minh": "TP. Hồ Chí Minh", "tphcm": "TP. Hồ Chí Minh", "tp hcm": "TP. Hồ Chí Minh", "hcm": "TP. Hồ Chí Minh", "ha noi": "Hà Nội",
    "da nang": "Đà Nẵng", "binh duong": "Bình Dương", "dong nai": "Đồng Nai", "hai phong": "Hải Phòng", "can tho": "Cần Thơ",
    "khanh hoa": "Khánh Hòa", "nha trang": "Khánh Hòa", "vung tau": "Bà Rịa - Vũng Tàu", "ba ria": "Bà Rịa - Vũng Tàu", "long an": "Long An",
    "quang ninh": "Quảng Ninh", "lam dong": "Lâm Đồng", "da lat": "Lâm Đồng", "hung yen": "Hưng Yên", "bac ninh": "Bắc Ninh",
    "thanh hoa": "Thanh Hóa", "nghe an": "Nghệ An", "hue": "Thừa Thiên Huế", "binh thuan": "Bình Thuận", "phan thiet": "Bình Thuận",
    "kien giang": "Kiên Giang", "phu quoc": "Kiên Giang",
}
TIER_B = ("villa", "street_house", "private_house", "shophouse", "condotel")
TIER_C = ("land", "project_land", "warehouse", "resort", "other")
TIER_B_CHARS, MAX_ROOMS, AREA = 300, 20, (5.0, 10_000.0)


def _hits(text: Column, pattern: str, *groups: int) -> Column:
    """Matches with their places and groups."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    columns = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    rows = F.arrays_zip(whole.alias("m"), F.split(text, pattern, -1).alias("gap"), *columns)
    kind = "struct<start: int, end: int, " + ", ".join(f"g{g}: string" for g in groups) + ">"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(a.alias("start"), b.alias("end"), *[x[f"g{g}"].alias(f"g{g}") for g in groups])
        return b, F.when(x["m"].isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(one))

    return fold(rows, F.lit(0), kind, step)["out"]


def _num(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit(".")).cast("double")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def _is_price(text: Column, x: Column) -> Column:
    low = F.lower(text)
    before = lambda n: F.substring(low, F.greatest(x["start"] - n, F.lit(0)) + 1, F.least(x["start"], F.lit(n)))
    after = F.substring(low, x["end"] + 1, F.lit(AFTER))
    return ~_any(after, NOT_PRICE_AFTER) & (_any(before(NEAR), PRICE_BEFORE) | ~_any(before(FAR), NOT_PRICE_BEFORE))


def _valued(text: Column, hits: Column, value, low: float, high: float, context: bool) -> Column:
    rows = F.transform(hits, lambda x: F.struct(value(x).alias("value"), evidence(text, x["start"], x["end"]).alias("evidence"), x["start"].alias("start"), x["end"].alias("end")))
    rows = F.filter(rows, lambda x: x["value"].between(low, high))
    return F.filter(rows, lambda x: _is_price(text, x)) if context else rows


def total_prices(text: Column) -> Column:
    """Candidates (value, evidence, ...) in billions; in millions only if there are none."""

    def billions(x: Column) -> Column:
        tail = F.coalesce(x["g2"], F.lit(""))
        scale = F.element_at(F.array(F.lit(100), F.lit(10), F.lit(1)), F.greatest(F.length(tail), F.lit(1)))
        more = F.when((tail != "") & ~x["g1"].rlike("[.,]"), F.coalesce(tail.try_cast("int"), F.lit(0)) * scale * 1e6).otherwise(0.0)
        return _num(x["g1"]) * 1e9 + more

    first = _valued(text, _hits(text, TY, 1, 2), billions, *TOTAL_RANGE, True)
    then = _valued(text, _hits(text, TRIEU, 1), lambda x: _num(x["g1"]) * 1e6, *TOTAL_RANGE, True)
    return let(first, lambda f: F.when(F.size(f) > 0, f).otherwise(then))


def per_m2_prices(text: Column) -> Column:
    return _valued(text, _hits(text, PER_M2, 1), lambda x: _num(x["g1"]) * 1e6, *PER_M2_RANGE, False)


def _only(candidates: Column) -> Column:
    """The first candidate if all agree once rounded, else null."""
    return let(candidates, lambda c: F.when(F.size(F.array_distinct(F.transform(c, lambda x: F.bround(x["value"])))) == 1, F.get(c, 0)))


def price(title: Column, description: Column, raw: Column) -> Column:
    """struct(total, per_m2, confidence, evidence, flag): from the title, else the description; several prices give none."""
    found = F.struct(total_prices(title).alias("t"), total_prices(description).alias("d"), per_m2_prices(F.concat_ws(" ", title, description)).alias("m"))
    picked = let(found, lambda x: F.struct(_only(x["t"]).alias("a"), _only(x["d"]).alias("b"), _only(x["m"]).alias("m"), (F.size(x["t"]) > 0).alias("any_t"), (F.size(x["d"]) > 0).alias("any_d")))

    def result(x: Column) -> Column:
        total = F.coalesce(x["a"]["value"], x["b"]["value"])
        unclear = x["any_t"] & x["a"].isNull() | x["any_d"] & x["b"].isNull()
        flag = F.when(x["a"].isNotNull(), "from_title").when(x["b"].isNotNull(), "from_description").when(unclear, "price_ambiguous").otherwise("")
        near = F.coalesce(F.abs(raw - total) < 1_000_000, F.lit(False))
        sure = F.when(total.isNull() & x["m"].isNull(), "missing").when(near, "parsed").otherwise("reparsed")
        return F.struct(total.alias("total"), x["m"]["value"].alias("per_m2"), sure.alias("confidence"), F.coalesce(x["a"]["evidence"], x["b"]["evidence"], x["m"]["evidence"], F.lit("")).alias("evidence"), flag.alias("flag"))

    return let(picked, result)


def url_tail(url: Column) -> Column:
    """Tokens of the address segment after its last ward marker, else its last district marker."""
    segment = F.coalesce(F.try_element_at(F.split(url, "/"), F.lit(4)), F.lit(""))
    tail = F.when(segment.rlike(WARD_TAIL), F.regexp_extract(segment, WARD_TAIL, 1)).when(segment.rlike(DISTRICT_TAIL), F.regexp_extract(segment, DISTRICT_TAIL, 1)).otherwise("")
    return F.filter(F.split(F.translate(tail, "_", "-"), "-"), lambda x: x != "")


def _digit(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def project_slug(tail: Column) -> Column:
    """Tokens after the last number; null without a number, or if only common words follow."""
    last = F.array_position(F.reverse(F.transform(tail, _digit)), True)
    rest = F.when(last > 0, F.slice(tail, F.size(tail) - last.cast("int") + 2, F.greatest(last.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.exists(rest, lambda x: ~x.isin(*SLUG_STOP)), F.array_join(rest, "-"))


def ward(tail: Column) -> Column:
    """The number if that comes first, else the tokens before the first number, else two tokens; without common words."""
    first = F.array_position(F.transform(tail, _digit), True).cast("int")
    taken = F.slice(tail, 1, F.when(first == 0, 2).when(first == 1, 1).otherwise(F.greatest(first - 1, F.lit(0))))
    return F.nullif(F.array_join(F.filter(taken, lambda x: ~x.isin(*SLUG_STOP)), "-"), F.lit(""))


def project_confidence(slug: Column, text: Column) -> Column:
    tokens = F.filter(F.split(slug, "-"), lambda x: F.length(x) > 1)
    hit = let(deaccent(text), lambda flat: F.size(F.filter(tokens, lambda x: flat.contains(x))))
    return F.when(slug.isNull() | (F.size(tokens) == 0), 0.0).when(hit * 10 >= F.size(tokens) * 6, 0.95).otherwise(0.6)


def slug_name(slug: Column) -> Column:
    return F.initcap(F.translate(slug, "-", " "))


def building(text: Column) -> Column:
    codes = F.transform(F.regexp_extract_all(text, F.lit(BUILDING), F.lit(1)), F.upper)
    return F.get(F.filter(codes, lambda x: ~deaccent(x).isin(*BUILDING_STOP)), 0)


def district(text: Column) -> Column:
    n = F.regexp_extract(text, DISTRICT_NUMBER, 1).try_cast("int")
    return F.when(n.isNotNull(), F.concat(F.lit("Quận "), n.cast("string"))).otherwise(F.nullif(F.trim(F.regexp_extract(text, DISTRICT_NAME, 0)), F.lit("")))


def city(text: Column) -> Column:
    """The city whose alias stands first as whole words; the earlier alias of the list among equals."""
    def first(flat: Column) -> Column:
        at = [F.struct(F.regexp_instr(flat, F.lit(rf"(?<![a-z0-9]){alias}(?![a-z0-9])")).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (alias, name) in enumerate(CITIES.items())]
        return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["name"]

    return let(deaccent(text), first)


def rooms(value: Column) -> Column:
    n = value.try_cast("int")
    return F.when(n.between(1, MAX_ROOMS), n)


def area(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when(x.between(*AREA), x)


def unit_type(kind: Column, bedrooms: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")) == "", None).when(F.coalesce(bedrooms, F.lit(0)) != 0, F.concat(kind, F.lit("-"), bedrooms.cast("string"), F.lit("pn"))).otherwise(kind)


def tier(kind: Column, slug: Column, chars: Column) -> Column:
    return F.when(F.coalesce(slug, F.lit("")) != "", "A").when(kind.isin(*TIER_C), "C").when(kind.isin(*TIER_B) | (chars >= TIER_B_CHARS), "B").otherwise("C")
