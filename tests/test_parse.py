import pytest
from pyspark.sql import functions as F

from loomspark.functions import parse, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


PRICES = [
    ("bán gấp 7 tỷ 250", 7.25e9), ("chỉ 920 triệu", 9.2e8), ("nhà 12,35 tỷ", 1.235e10), ("6.4 TỶ bớt lộc", 6.4e9), ("8 tỷ 3", 8.3e9), ("2 tỷ 3 phòng ngủ, 1 bếp", 2e9),
    ("7 tỷ, hàng xóm 9 tỷ", None), ("vốn ban đầu 300 triệu", None), ("", None), ("tặng 50 triệu, giá bán 6 tỷ", 6e9), ("liên hệ để biết giá", None),
]


def test_prices(spark):
    rows = spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(PRICES)], "i int, t string, d string")
    got = {r["i"]: r["p"]["total"] for r in rows.select("i", parse.price(F.col("t"), F.col("d"), F.lit(None).cast("double")).alias("p")).collect()}
    assert [got[i] for i in range(len(PRICES))] == [pytest.approx(v) if v else None for _, v in PRICES]
    p = one(spark, parse.price(F.col("t"), F.col("d"), F.lit(4.9e9)), t="Bán căn hộ", d="giá 4,9 tỷ, 70 triệu/m2")
    assert (p["total"], p["per_m2"], p["confidence"], p["flag"]) == (4.9e9, 7e7, "parsed", "from_description")


URLS = [
    ("https://b.vn/ban-can-ho-duong-a-phuong-nhan-chinh-55-the-diamond/p1", "the-diamond", "nhan-chinh"), ("https://b.vn/ban-nha-phuong-12-77-can-ho/p", None, "12"),
    ("https://b.vn/ban-nha-phuong-me-tri-the-matrix/p", None, "me-tri"), ("https://b.vn/ban-nha-quan-7-riviera/p", "riviera", "7"), ("https://b.vn/x", None, None), ("short", None, None),
]


def test_addresses(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "i int, u string")
    got = {r["i"]: (r["p"], r["w"]) for r in rows.select("i", parse.project_slug(parse.url_tail(F.col("u"))).alias("p"), parse.ward(parse.url_tail(F.col("u"))).alias("w")).collect()}
    assert [got[i] for i in range(len(URLS))] == [(p, w) for _, p, w in URLS]


def test_places_and_buildings(spark):
    assert one(spark, parse.city(F.col("t")), t="cho thuê căn hộ") is None
    assert one(spark, parse.city(F.col("t")), t="căn hộ ở Huế, gần Hà Nội") == "Thừa Thiên Huế"
    assert one(spark, parse.district(F.col("t")), t="ở quận 07 gần chợ") == "Quận 7"
    assert one(spark, parse.building(F.col("t")), t="tòa s3 và block B2") == "S3"
    assert one(spark, parse.building(F.col("t")), t="tòa nhà chung cư") is None
    assert one(spark, parse.project_confidence(F.lit("the-diamond"), F.col("t")), t="The Diamond") == 0.95


def test_rooms_and_tiers(spark):
    rows = spark.createDataFrame([("3",), ("20",), ("21",), ("92",), ("0",), (None,), ("x",), ("3.0",)], "v string").select(parse.rooms(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == [3, 20, None, None, None, None, None, None]
    tiers = spark.createDataFrame([("villa", "p", 1), ("land", None, 999), ("villa", None, 1), ("apartment", None, 300), ("apartment", None, 299)], "k string, s string, n int")
    assert [r["t"] for r in tiers.select(parse.tier(F.col("k"), F.col("s"), F.col("n")).alias("t")).collect()] == ["A", "C", "B", "B", "C"]


def test_text_functions(spark):
    assert one(spark, text.deaccent(F.col("t")), t="Đường Nguyễn Huệ ớ") == "duong nguyen hue o"
    assert one(spark, text.terms(F.col("t")), t="Hồ bơi A") == ["ho", "boi", "a", "ho_boi", "boi_a"] and one(spark, text.terms(F.col("t")), t="một") == ["mot"] and one(spark, text.terms(F.col("t")), t="") == []
    assert one(spark, text.mask_phones(F.col("t")), t="gọi 0772 011 234. mã 012 hoặc +84 901234567") == f"gọi {text.PHONE_HIDDEN}. mã 012 hoặc {text.PHONE_HIDDEN}"
    assert one(spark, text.normalize(F.col("t")), t=" a&amp;b \t c\r d \nSentry.onLoad(x\ny ") == "a&b c\nd"
    assert one(spark, text.price_label(F.col("v")), v=4.9e9) == "4.9 tỷ" and one(spark, text.price_label(F.col("v")), v=8.5e8) == "850 triệu"
    assert [one(spark, text.number(F.col("t")), t=x) for x in ("7,50", "12.0", "100", "3.10")] == ["7.5", "12", "100", "3.1"]
