import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.operators import blocks, cleaning, dedup, embed, evaluation, facts, generation, graph, index, ingest, reports, retrieval, workflow
from loomspark.operators.components import connected_components
from loomspark.sources import files
from loomspark.streaming import micro_batch

RAW = "source_listing_id string, title string, description string, property_type string, bedrooms int, bathrooms int, area_m2 double, total_price_vnd double, seller_display_name string"
LONG = "Căn hộ The Diamond tòa S3 ở phường Nhân Chính, quận 7, Hà Nội. Có hồ bơi và gym. Sổ hồng. Giá 4,9 tỷ. Gọi 0772 011 234. " * 4


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    base = {"description": LONG, "property_type": "apartment", "bedrooms": 2, "bathrooms": 92, "area_m2": 70.0, "total_price_vnd": 4.9e9, "seller_display_name": "Secret Name"}
    rows = [{"source_listing_id": "1", "title": "Bán căn hộ", **base}, {"source_listing_id": "2", "title": "Bán căn hộ đẹp", **base}, {"source_listing_id": "3", "title": "", "description": ""}, {"title": "x"}, {"source_listing_id": "9", "title": "x"}, {"source_listing_id": "8", "title": "x"}]
    (folder / "listings.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\nnot json\n")
    url = "https://b.vn/ban-can-ho-phuong-nhan-chinh-55-the-diamond/p"
    head = "id,source,source_listing_id,canonical_url,first_seen_at,last_seen_at,last_detail_crawled_at,status,summary_hash,content_hash"
    lines = [f"r1,s,1,old,2024,2025,,ACTIVE,,h0", f"r1,s,1,{url},2024,2025,,EXPIRED,,h1", f"r2,s,2,{url},2024,2025,,ACTIVE,,h1", "r3,s,3,https://b.vn/x,2024,2025,,ACTIVE,,h3", "r8,s,8,,2024,2025,,ACTIVE,,h8"]
    (folder / "source_listing_1.csv").write_text("id\n")
    (folder / "source_listing_2.csv").write_text("\n".join([head, *lines]) + "\n")
    return folder


def test_clean_pipeline(spark, landing):
    jsonl, csv = files.find_sources(spark, str(landing))
    assert csv.endswith("_2.csv")
    out = cleaning.run(files.read_jsonl(spark, jsonl, RAW), files.read_csv_index(spark, csv, "source_listing_id"))
    assert sorted(r["error_code"] for r in out["quarantine"].collect()) == ["empty_content", "invalid_json", "missing_provenance", "missing_source_listing_id", "no_source_row"]
    clean = {r["source_listing_id"]: r for r in out["clean"].collect()}
    assert set(clean) == {"1", "2"}
    one = clean["1"]
    assert (one["project_slug"], one["project_name"], one["ward"], one["district"], one["city"], one["building_code"], one["tier"]) == ("the-diamond", "The Diamond", "nhan-chinh", "Quận 7", "Hà Nội", "S3", "A")
    assert (one["bathrooms"], one["field_flags"]["outliers"], one["valid_to"], one["total_price_vnd"], one["price_confidence"]) == (None, "bathrooms", "2025", 4.9e9, "parsed")
    assert one["cluster_id"] == clean["2"]["cluster_id"] == "1" and one["cluster_size"] == 2 and "Secret" not in str(clean) and "0772" not in str(clean)
    facts_ = out["facts"].collect()
    assert {r["predicate"] for r in facts_} == {"property_type", "area_m2", "bedrooms", "total_price_vnd", "project", "building", "ward", "district", "city", "legal_status", "amenity"}
    assert len({(r["source_listing_id"], r["fact_key"]) for r in facts_}) == len(facts_)
    nodes = {(r["entity_type"], r["canonical_key"]): r["support"] for r in out["nodes"].collect()}
    assert nodes["Project", "the-diamond"] == 2 and nodes["Amenity", "ho_boi"] == 2 and nodes["City", "ha-noi"] == 2
    edges = {(r["src"], r["dst"], r["edge_type"]): (r["support"], r["evidence_id"]) for r in out["edges"].collect()}
    assert edges["Ward:nhan-chinh", "District:quan-7", "LOCATED_IN"] == (2, "1") and edges["Building:the-diamond::S3", "Project:the-diamond", "PART_OF"] == (2, "1")


def test_missing_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.find_sources(spark, str(tmp_path))
    assert files.read_card(spark, f"{tmp_path}/card.json", "a int").count() == 0
    (tmp_path / "card.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert files.read_card(spark, f"{tmp_path}/card.json", "a int").first()["a"] == 1 and files.read_card(spark, f"{tmp_path}/bad.json", "a int").count() == 0
    assert files.fingerprints(spark, f"{tmp_path}/card.json").first()["fingerprint"] == __import__("hashlib").sha256(b'{"a": 1}').hexdigest()[:16]
    assert "| a |" in files.markdown("t", spark.createDataFrame([(1,)], "a int"))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(60)) and len(got) == 101
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_is_the_majority_of_digests(spark):
    import hashlib

    def plain(t):
        w = t.split()
        grams = w if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        v = [sum(1 if int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") >> b & 1 else -1 for g in grams) for b in range(64)]
        return f"{sum(1 << b for b in range(64) if v[b] > 0):016x}" if grams else ""

    texts = ["a b c d e f", "one two", "", "x y z"]
    got = {r["id"]: r["simhash"] for r in dedup.simhash_exact(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    assert [got[i] for i in range(4)] == [plain(t) for t in texts]


def test_near_duplicates_of_six_bits_equal_brute_force(spark, tmp_path):
    from loomspark.plans import catalogue

    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(400)] for _ in range(6)]
    texts = ["", "!!", "..."]
    for words in base:
        texts += [" ".join(words)] * 2
        for k in (1, 2, 3, 5, 8, 12, 20):
            edited = list(words)
            for at in rng.sample(range(400), k):
                edited[at] = "edited"
            texts.append(" ".join(edited))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sig = {r["id"]: int(r["simhash"], 16) for r in dedup.simhash_exact(docs, "doc_id", "text").collect() if r["simhash"]}
    far = {(a, b): (sig[a] ^ sig[b]).bit_count() for a in sig for b in sig if a < b}
    near = {p for p, d in far.items() if d <= 6}
    assert {3, 4, 5, 6} & {far[p] for p in near}
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    pairs = catalogue.QUERIES["hamming_pairs_exact"](spark, str(tmp_path)).collect()
    assert all(far[r["a"], r["b"]] == r["distance"] for r in pairs)
    # Equal signatures are met once, at the first of them.
    first = {h: min(i for i in sig if sig[i] == h) for h in sig.values()}
    assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a, b in near if (a == first[sig[a]] and b == first[sig[b]]) or (sig[a] == sig[b] and a == first[sig[a]])}
    found = catalogue.QUERIES["near_dup_clusters_exact"](spark, str(tmp_path)).collect()
    assert {r["id"]: r["cluster_id"] for r in found} == dict(enumerate(root))


def test_sentence_packing_equals_a_plain_loop(spark):
    import re

    def plain(t):
        t = t.strip()
        if not t:
            return []
        if len(t) <= 700:
            return [t]
        out, now = [], ""
        for s in (x.strip() for x in re.split(r"(?<=[.!?…])\s+|\n+", t)):
            if not s:
                continue
            if now and len(now) + len(s) + 1 > 700:
                out.append(now.strip())
                now = f"{now[-120:]} {s}"
            else:
                now = f"{now} {s}".strip()
        if now.strip():
            out.append(now.strip())
        return [c for c in out if len(c) >= 60] or [t[:700]]

    rng = random.Random(0)
    texts = ["", "short.", "x" * 900] + [" ".join("word" * rng.randint(1, 9) + rng.choice(["", ".", "!", ".\n"]) for _ in range(rng.randint(1, 300))) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", facts.pack_sentences(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == dict(enumerate(map(plain, texts)))


def test_sentence_packing_is_no_fold_of_expressions(spark):
    """Its state was copied for each sentence. White space is Java's, as in the fold: no separators \\x1c to \\x1f."""
    rows = [(1, "\xa0\x1cone.\x1ctwo.\u2003\u2028"), (2, None), (3, " \n\u3000"), (4, "\u2003" + "a" * 650 + ".\xa0b. " + "c" * 80 + ".\x1f\n\n\xa0 d")]
    df = spark.createDataFrame(rows, "i int, t string").select("i", facts.pack_sentences(F.col("t")).alias("c"))
    first = "a" * 650 + ".\xa0b."
    second = first[-120:] + " " + "c" * 80 + ".\x1f d"
    assert {r["i"]: r["c"] for r in df.collect()} == {1: ["\x1cone.\x1ctwo."], 2: [], 3: [], 4: [first, second]}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_statistics_with_known_answers(spark):
    d = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate([1, 2, 3, 4])], "k string, i int, d double")
    p = evaluation.exact_permutation(d, ["k"]).first()
    assert (p["p_value"], p["patterns"]) == (0.125, 16)
    low, high = evaluation.bootstrap_interval(d, ["k"], n=500).select("low", "high").first()
    assert 1 <= low < 2.5 < high <= 4
    s = evaluation.paired_summary(spark.createDataFrame([("k", 1.0, 0.5), ("k", 1.0, 1.0), ("k", 0.5, 1.0)], "k string, a double, b double"), ["k"], "a", "b").first()
    assert (s["wins"], s["losses"], s["ties"], s["mean_diff"]) == (1, 1, 1, 0) and s["dz"] == 0


def test_sampled_permutation_and_bootstrap(spark):
    rng = random.Random(3)
    rows = [("few", i, float(x)) for i, x in enumerate([1, 2, 3, 4])] + [("few", 9, None), ("one", 0, 2.0), ("none", 0, None)]
    rows += [("same", i, float((-1) ** i)) for i in range(20)] + [("far", i, rng.gauss(3, 1)) for i in range(40)] + [("near", i, rng.gauss(0.2, 1)) for i in range(40)]
    d = spark.createDataFrame(rows, "k string, i int, d double")
    got = {r["k"]: r for r in evaluation.permutation_test(d, ["k"]).collect()}
    assert set(got) == {"few", "one", "same", "far", "near"}
    assert (got["few"]["method"], got["few"]["n"], got["few"]["p_value"]) == ("exact", 4, 0.125)
    assert (got["same"]["method"], got["same"]["p_value"]) == ("monte_carlo", 1.0)
    assert got["far"]["patterns"] == 20_000 and got["far"]["p_value"] == round(1 / 20_001, 5)
    near = [x for k, _, x in rows if k == "near"]
    plain = sum(abs(sum(rng.choice((-1, 1)) * x for x in near)) >= abs(sum(near)) - 1e-9 for _ in range(20_000)) / 20_000
    assert abs(got["near"]["p_value"] - plain) < 0.02
    spans = {r["k"]: (r["low"], r["high"]) for r in evaluation.bootstrap_interval(d, ["k"]).collect()}
    means = sorted(sum(rng.choices(near, k=40)) / 40 for _ in range(10_000))
    assert spans["one"] == (None, None) and all(abs(x - means[at]) < 0.05 for x, at in zip(spans["near"], (250, 9750), strict=True))


def test_draws_are_those_of_spark_s_hash(spark):
    rng = random.Random(8)
    rows = [("a", i, rng.gauss(0.1, 1)) for i in range(37)] + [("b", i, float(i % 3)) for i in range(9000)] + [("b", 9001, None)]
    d = spark.createDataFrame(rows, "k string, i int, d double")
    whole = d.where("d is not null").groupBy("k").agg(F.expr("array_sort(collect_list(struct(i, d))).d").alias("d")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19))))
    signs = F.aggregate(F.transform("d", lambda x, i: F.when(F.xxhash64(F.lit(42), "draw", i).bitwiseAND(F.lit(1)) == 1, -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x)
    picks = F.aggregate(F.sequence(F.lit(0), F.size("d") - 1), F.lit(0.0), lambda s, p: s + F.get("d", F.pmod(F.xxhash64(F.lit(7), "draw", p), F.size("d")).cast("int")))
    plain = {(r["k"], r["draw"]): (r["s"], r["p"]) for r in whole.select("k", "draw", (signs / F.size("d")).alias("s"), (picks / F.size("d")).alias("p")).collect()}
    for flips, seed, at in ((True, 42, 0), (False, 7, 1)):
        drawn = evaluation._draws(d, ["k"], 20, seed, flips)
        assert "xxhash64" not in drawn._jdf.queryExecution().executedPlan().toString()
        got = {(r["k"], r["_draw"]): r["m"] for r in drawn.collect()}
        assert set(got) == set(plain) and all(math.isclose(got[x], plain[x][at], abs_tol=1e-12) for x in plain)


def test_statistics_queries_take_every_customer(spark, tmp_path):
    from loomspark.plans import catalogue

    spark.range(60).selectExpr("id as c_custkey", "cast(id % 3 + 4 as int) as c_nationkey", "cast(id * 1000 as double) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.QUERIES["permutation_test"](spark, str(tmp_path)).collect()
    assert {(r["c_nationkey"], r["n"], r["method"]) for r in got} == {(4, 20, "monte_carlo"), (5, 20, "monte_carlo"), (6, 20, "monte_carlo")}
    rows = catalogue.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()
    assert {r["c_nationkey"] for r in rows} == {4, 5, 6} and all(r["low"] < 28 < r["high"] for r in rows)


def test_numbers_that_facts_support(spark):
    fact = "struct<text: string, value_text: string, value_num: double, valid_from: string, valid_to: string>"
    row = spark.createDataFrame([([("Giá: 4900", "4900", 4.9e9, "2024-01-05", None), (None, None, 0.0, None, "2025")],)], f"f array<{fact}>")
    assert set(row.select(evaluation.allowed_of_facts(F.col("f")).alias("a")).first()["a"]) == {"4900", "2024", "01", "05", "4900000000", "4.9", "2025"}


def test_two_decimals_follow_the_binary_value(spark):
    rng = random.Random(1)
    values = [1.615, 2.675, 1.005, 0.125, 0.375, 1.0, 1023.995, 4.9, 0.0039, 5000.125, 1.125] + [round(rng.uniform(0, 1000), 3) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(text.two_decimals(F.col("v")).alias("t"), "v").collect()
    assert all(r["t"] == f"{r['v']:.2f}" for r in got if 2.0**-8 <= r["v"] < 1024)


def test_scores_without_expected_groups(spark):
    results = spark.createDataFrame([("a", 1, 10, "g", 1), ("a", 1, 11, "h", 2), ("a", 2, 10, "g", 1)], "config string, query_id int, item int, `group` string, rank int")
    expected = spark.createDataFrame([(1, [11, 12], ["h"]), (2, [10], []), (3, [5], ["g"])], "query_id int, items array<int>, groups array<string>")
    got = {r["query_id"]: r for r in evaluation.score_configs(results, expected, ["a"]).collect()}
    assert (got[1]["group_precision"], got[1]["mrr"], got[1]["hit"], got[1]["recall"]) == (0.5, 0.5, 1.0, 0.5)
    assert (got[2]["group_precision"], got[2]["mrr"], got[2]["hit"], got[2]["recall"]) == (None, None, None, 1.0)
    assert (got[3]["group_precision"], got[3]["mrr"], got[3]["hit"], got[3]["item_precision"]) == (0.0, 0.0, 0.0, 0.0)


def test_every_near_signature_is_met(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for k in range(120):
        x = rng.choice(base)
        for bit in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << bit
        rows.append((10 + k, x))
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    got = {(r["a"], r["b"]) for r in dedup.near_pairs(spark.createDataFrame(signed, "id long, simhash long"), 64, 6).collect()}
    near = {(a, b) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 6}
    same = {(min(i for i, y in rows if y == x), b) for b, x in rows} - {(b, b) for b, _ in rows}
    first = {x: min(i for i, y in rows if y == x) for _, x in rows}
    assert got == {(a, b) for a, b in near if a == first[dict(rows)[a]] and b == first[dict(rows)[b]]} | same
    assert all(len(dedup.tables(64, 6, n)) >= 7 for n in (1, 10**4, 10**9)) and len(dedup.tables(64, 6, 10**9)) == 210


def test_signatures_meet_without_a_broadcast(spark):
    rows = spark.range(300).selectExpr("id", "xxhash64(id) as simhash")
    plan = dedup.near_pairs(rows, 64, 6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [band" in plan and "BroadcastHashJoin [band" not in plan


def test_signatures_are_taken_once_and_by_rows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["một", "hai", "Ba", "4", "x" * 61, "năm"]) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", None, "!", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for rows in (docs, docs.unionByName(docs.limit(9).withColumn("text", F.lit("other words stand here")))):
        got, plain = ({r["id"]: r["simhash"] for r in f(rows, "id", "text").collect()} for f in (dedup.simhash_md5, dedup.simhash_native))
        assert got == plain and not {30, 31, 32} & set(got) and len(got) > 20
    plan = dedup.near_pairs(dedup.simhash_md5(docs, "id", "text"), most=2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_hubs_are_cut_before_they_are_joined(spark):
    edges = spark.createDataFrame([(f"s{i:03d}", "hub", "IN") for i in range(60)] + [("s000", "s050", "NEAR"), ("s050", "far", "NEAR")], "src string, dst string, edge_type string")
    nodes = sorted({f"s{i:03d}" for i in range(60)} | {"far"})
    got = graph.nearest(edges, spark.createDataFrame([("s000",), ("s059",), ("hub",)], "start string"), spark.createDataFrame([(n,) for n in nodes], "node string"), 3).collect()
    assert sorted((r["start"], r["depth"], r["node"]) for r in got) == [("hub", 1, "s000"), ("hub", 1, "s001"), ("hub", 1, "s002"), ("s000", 1, "s050"), ("s000", 2, "far"), ("s000", 2, "s001"), ("s059", 2, "s000"), ("s059", 2, "s001"), ("s059", 2, "s002")]
    assert {r["path"] for r in got if r["start"] == "s059" and r["node"] == "s001"} == {"s059 --IN--> hub --IN--> s001"}


def test_questions_held_to_projects(spark):
    rows = spark.createDataFrame([(i, f"w{i % 3} common", f"p{i % 2}", [1.0, float(i)]) for i in range(40)], "id long, flat string, project string, embedding array<double>")
    asked = spark.createDataFrame([(1, ["common", "w1"], "p1", [1.0, 0.0]), (2, ["common"], None, [1.0, 0.0]), (3, ["none"], "p0", None)], "query_id long, tokens array<string>, project string, query_embedding array<double>")
    best = retrieval.ranked(blocks.token_scores(rows, asked, 3), 3).collect()
    assert sorted((r["query_id"], r["id"], r["score"]) for r in best) == [(1, 1, 1.0), (1, 7, 1.0), (1, 13, 1.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    near = retrieval.ranked(blocks.vector_scores(rows, asked, 2), 2).collect()
    assert sorted((r["query_id"], r["id"]) for r in near if r["query_id"] < 3) == [(1, 1), (1, 3), (2, 0), (2, 1)]


def test_ranks_of_one_hot_key(spark):
    rows = spark.createDataFrame([("a", v) for v in range(1000)] * 2 + [("b", 5), (None, 7), (None, 9)], "k string, v int")
    got = {r["k"]: (r["low"], r["median"], r["p90"], r["high"]) for r in evaluation.nearest_rank(rows.repartition(7), "v", ["k"]).collect()}
    assert got == {"a": (0, 500, 900, 999), "b": (5, 5, 5, 5), None: (7, 9, 9, 9)}


def test_hashed_vectors(spark):
    import hashlib

    def plain(t, dim):
        words = t.lower().split()
        v = [0.0] * dim
        for token in words + [" ".join(words[i : i + 3]) for i in range(max(0, len(words) - 2))]:
            n = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
            v[n % dim] += 1 if n >= 1 << 63 else -1
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / size for x in v]

    texts = ["A b c d", "one", "", None, "căn hộ hai phòng ngủ"]
    got = {r["id"]: r["embedding"] for r in embed.embed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 16).collect()}
    assert all(got[i] == pytest.approx(plain(t or "", 16)) for i, t in enumerate(texts))


def test_adapters_and_configurations():
    assert generation.resolve_adapter("A", []) is None and generation.resolve_adapter("C", ["x"]) == "x" and generation.resolve_adapter("D", ["x", "y"], configured="y") == "y"
    for given in ([], ["x", "y"]):
        with pytest.raises(FileNotFoundError):
            generation.resolve_adapter("C", given)
    runnable, skipped = generation.available(("A", "B", "C", "Z"), [])
    assert runnable == ["A", "B"] and set(skipped) == {"C", "Z"}


def test_reports_of_odd_tables(spark):
    rows = spark.createDataFrame([("x", None, []), (None, 1, [1]), ("x", 2, None)], "a string, b int, c array<int>")
    assert {r["field"]: (r["n"], r["pct"]) for r in reports.coverage(rows, ("a", "b"), ("c",)).collect()} == {"a": (2, 66.7), "b": (2, 66.7), "c": (1, 33.3)}
    assert {(r["measure"], r["key"]): r["n"] for r in reports.distributions(rows.limit(0), ("a",), "s").collect()} == {}
    assert [r["pct"] for r in reports.coverage(rows.limit(0), ("a",)).collect()] == [0.0]
    assert reports.by_key(rows, "b", 2).count() == 1 and reports.conditions(rows, a="x", b=None).count() == 2
    left, gone = reports.cascade({"t": rows.withColumn("tenant_id", F.when(F.col("b") == 1, "u"))}, "u")
    assert left["t"].count() == 2 and gone.first()["deleted"] == 1
    page = reports.page("T", reports.distributions(rows, ("a",), "s").withColumn("pct", F.lit(None).cast("double")))
    assert page.startswith("# T\n\n## s") and "| a | x | 2 |" in page


def test_claims(spark):
    body = "Căn hộ giá 4.9 tỷ rất đẹp. Diện tích 80 m2 rộng rãi. Cam kết lợi nhuận 10 phần trăm. Xin chào. Xem https://x.vn/123 nhé các bạn."
    row = spark.createDataFrame([(body, ["giá 4,90 tỷ", "10"])], "b string, f array<string>").select(evaluation.claims(F.col("b"), evaluation.allowed_numbers(F.col("f"))).alias("c"))
    assert [c["status"] for c in row.first()["c"]] == ["supported", "unsupported", "forbidden"]
    s = row.select(evaluation.claim_summary(F.col("c")).alias("s")).first()["s"]
    assert (s["n_claims"], s["n_unsupported"], s["n_forbidden"]) == (3, 2, 1) and math.isclose(s["unsupported_rate"], 0.6667)


def test_bm25_prefers_rare_terms_and_is_never_negative(spark):
    docs = spark.createDataFrame([(1, "common common"), (2, "common rare"), (3, "common other"), (4, "")], "i long, t string")
    held = index.build(docs.withColumnsRenamed({"i": "id", "t": "text"}))
    got = retrieval.bm25_index(held, spark.createDataFrame([(0, "rare common rare")], "query_id long, query string"), 10).orderBy("rank").collect()
    assert (held.n_docs, held.avgdl) == (4, 3.0)
    assert [r["id"] for r in got][0] == 2 and all(r["score"] > 0 for r in got) and 4 not in [r["id"] for r in got]


def test_searches_deal_out_no_postings(spark):
    """Postings, counts and BM25 come from the texts where they lie, and a task gives its best k alone."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "đ" * 61, "é à"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    held = index.build(docs)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan(held.postings) and "Exchange hash" not in plan(retrieval.term_frequency(held.chunks.select("id", "text"), "id", "text"))
    plain = {}
    for i, t in enumerate(texts):
        w = [] if t is None or len(t) > 60 else t.replace("é", "e").replace("à", "a").split()
        plain[i] = w + [f"{a}_{b}" for a, b in zip(w, w[1:])]
    assert {(r["id"], r["term"]): (r["tf"], r["dl"]) for r in held.postings.collect()} == {(i, x): (t.count(x), len(t)) for i, t in plain.items() for x in t}
    df = {x: sum(x in t for t in plain.values()) for t in plain.values() for x in t}
    assert {r["term"]: r["df"] for r in index.document_frequency(held).collect()} == df
    assert {r["id"]: r["n_terms"] for r in index.term_numbers(held).collect()} == {i: len(set(t)) for i, t in plain.items()}
    mean = sum(map(len, plain.values())) / sum(map(bool, plain.values()))
    assert (held.n_docs, held.avgdl) == (303, mean)
    score = lambda q, t: sum(math.log(1 + (303 - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * max(len(t), 1) / mean)) for x in q if x in t)
    asked = {1: ["a", "b", "c", "a_b", "b_c"], 2: ["e", "a", "e_a"], 3: ["zz"]}
    got = retrieval.bm25_index(held, spark.createDataFrame([(1, "a b c"), (2, "e a"), (3, "zz"), (4, None)], "query_id long, query string"), 5).collect()
    for q, own in asked.items():
        best = sorted(((-round(score(own, t), 9), i) for i, t in plain.items() if score(own, t) > 0))[:5]
        assert [(-round(r["score"], 9), r["id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best
    wide = blocks.term_scores(held.texts, spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>"), 5, held.facts, 1.5, 0.75)
    assert wide.count() <= 5 * wide.rdd.getNumPartitions() < 100


def test_tokens_of_a_batch_equal_a_plain_loop():
    """Found on the bytes of all texts at once, without a Python string for each; slices, nulls, texts without a gap, long tokens and neighbours of none."""
    import inspect
    from collections import Counter

    import pyarrow as pa
    from loomspark.operators import tokens

    rng = random.Random(5)
    bits = ["a", "b7", "xy", " ", "_", "é", "đ", "A", "\n", "z" * 60, "z" * 61, "😀", "word ", "word "]
    texts = [None, "", "ab", "ab", "ab cd ", " ab", "y" * 70, "a " + "y" * 70 + " b"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "b"]
    for column in (pa.array(texts), pa.array(["x y", *texts, "x"]).slice(1, len(texts)), pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None, "", "é"])):
        plain = [text.flat_tokens(t) for t in column.to_pylist()]
        found, number = tokens.split(column)
        assert found.to_pylist() == [t for own in plain for t in own] and number.tolist() == [len(own) for own in plain]
        words, (row, word, tf), (of, left, right, twice), dl = tokens.counted(column)
        w = words.to_pylist()
        assert dict(zip(zip(row.tolist(), [w[i] for i in word]), tf.tolist())) == dict(Counter((i, t) for i, own in enumerate(plain) for t in own))
        assert dict(zip(zip(of.tolist(), [w[i] for i in left], [w[i] for i in right]), twice.tolist())) == dict(Counter((i, a, b) for i, own in enumerate(plain) for a, b in zip(own, own[1:])))
        assert dl.tolist() == [max(2 * len(own) - 1, 0) for own in plain]
    assert [len(t) for t in tokens.split(pa.array(texts), None)[0].to_pylist()] == [len(t) for x in texts for t in text._TOKEN.findall(x or "")]
    for f in (blocks._term_batch, blocks._token_batch, blocks.term_counts, index.postings, index.term_numbers):
        assert "to_pylist" not in inspect.getsource(f)


def test_words_hold_tokens_however_many_hits(monkeypatch):
    """Across blocks of hits, words that are remembered or forgotten, and ends of words."""
    ahocorasick = pytest.importorskip("ahocorasick")
    import pyarrow as pa

    monkeypatch.setattr(blocks, "HITS", 7)
    monkeypatch.setattr(blocks, "KNOWN", 60)
    tokens = ["a", "ab", "b", "abab", "c", "zz"]
    found = ahocorasick.Automaton()
    for i, t in enumerate(tokens):
        found.add_word(t, i)
    found.make_automaton()
    rng, within = random.Random(2), blocks._Within(found, len(tokens))
    for _ in range(20):
        words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(25)} | {"ab" * 50, "d"})
        rng.shuffle(words)
        at = within.of(pa.array(words, pa.large_string()))
        assert [within.tokens[within.first[i] : within.first[i + 1]].tolist() for i in at] == [[i for i, t in enumerate(tokens) if t in w] for w in words]
        assert len(within.words) <= 60


def test_repeated_ids_are_counted_together(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a")], "id long, text string")
    assert {(r["id"], r["term"]): r["tf"] for r in retrieval.term_frequency(rows, "id", "text").collect()} == {(1, "a"): 2, (1, "b"): 1, (1, "c"): 1, (1, "a_b"): 1, (1, "a_c"): 1, (2, "a"): 1}
    assert {r["term"]: r["df"] for r in index.document_frequency(index.build(rows)).collect()} == {"a": 2, "b": 1, "c": 1, "a_b": 1, "a_c": 1}


def test_long_expected_lists_are_not_joined_to_results(spark):
    """Before, each result carried the whole list of expected items."""
    expected = spark.createDataFrame([(1, ["g"], list(range(500))), (2, [], [7])], "query_id long, groups array<string>, items array<long>")
    found = spark.createDataFrame([("c", 1, 3, "g", 1), ("c", 1, 900, "h", 2), ("c", 2, 8, "g", 1)], "config string, query_id long, item long, group string, rank int")
    scored = evaluation.score_configs(found, expected, ["c", "d"])
    got = {(r["config"], r["query_id"]): (r["group_precision"], r["item_precision"], r["recall"], r["mrr"]) for r in scored.collect()}
    assert got == {("c", 1): (0.5, 0.5, 0.002, 1.0), ("c", 2): (None, 0.0, 0.0, None), ("d", 1): (0.0, 0.0, 0.0, 0.0), ("d", 2): (None, 0.0, 0.0, None)}
    assert "array_contains(items" not in scored._jdf.queryExecution().executedPlan().toString()


def test_a_sweep_looks_events_up_before_its_grid(spark, tmp_path):
    from loomspark.plans import catalogue

    spark.range(40).selectExpr("id as event_id", "id % 4 as user_id", "'purchase' as event_type", "timestamp_seconds(id) as ts", "cast(id as double) as value").write.parquet(f"{tmp_path}/events.parquet")
    plan = catalogue.QUERIES["weight_sweep"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_upsert_and_reconcile(spark):
    old = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u2")], "k int, h string, u string")
    new = spark.createDataFrame([(2, "c", "n2"), (3, "d", "n3")], "k int, h string, u string")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], ["h"], ["h"]).collect())) == [(1, "a", "u1"), (2, "c", "u2"), (3, "d", "n3")]
    assert sorted(map(tuple, ingest.changes(old, new, ["k"], ["h"]).collect())) == [(1, "delete"), (2, "update"), (3, "insert")]


def test_traversal_keeps_simple_paths(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("c", "a", "Z")], "src string, dst string, edge_type string")
    got = {tuple(r["nodes"]) for r in graph.traverse(edges, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "b", "c"), ("a", "c", "b")}


def test_workflow_refuses(spark):
    log = [(1, "submit", "w", None), (2, "approve", "w", None), (3, "reject", "r", ""), (4, "reject", "r", "why"), (5, "edit", "w", None), (6, "submit", "w", None), (7, "approve", "r", None), (8, "edit", "w", None)]
    df = spark.createDataFrame([(9, n, a, who, "w", note) for n, a, who, note in log], "item int, n int, action string, actor string, author string, note string")
    got = workflow.judged(df, "item", "n").orderBy("n").collect()
    assert [r["refused"] for r in got] == [None, "self_review", "no_note", None, None, None, None, "no_transition"] and got[-1]["after"] == "approved"


def test_streams_equal_batches(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "a", float(i)) for i in range(9)], "event_id long, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    check = lambda df: ingest.with_error(df, [("small", F.col("value") < 2)])
    for _ in range(2):  # the second run finds nothing new
        q = micro_batch.ingest(stream, check, f"{tmp_path}/rows", f"{tmp_path}/errors", f"{tmp_path}/cp", "event_id").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 7 and spark.read.parquet(f"{tmp_path}/errors").count() == 2
    q = micro_batch.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, micro_batch.windowed_counts(events).collect()))


def test_adapter_folders(spark, tmp_path):
    assert files.adapters(spark, f"{tmp_path}/none").count() == 0 and files.adapters(spark, str(tmp_path)).count() == 0
    for name, held in {
        "good": {files.CARD: '{"base_model": "b", "dataset_version": "v", "lora": {"r": 8}, "training": {"n": 1}}', files.CONFIG: "{}", files.WEIGHTS[1]: "weights"},
        "bare": {files.CONFIG: '{"base_model_name_or_path": "c"}', files.WEIGHTS[0]: "w0", files.WEIGHTS[1]: "w1"},
        "odd": {files.CARD: "{", files.CONFIG: '{"x": 1}', "other.txt": "x"}, "trial": {files.CARD: '{"base_model": "b", "smoke": true}'},
    }.items():
        (tmp_path / name).mkdir()
        for file, text_ in held.items():
            (tmp_path / name / file).write_text(text_)
    got = {r["name"]: r for r in files.adapters(spark, str(tmp_path)).collect()}
    digest = lambda t: __import__("hashlib").sha256(t).hexdigest()[:16]
    assert (got["good"]["loadable"], got["good"]["base_model"], got["good"]["problems"], got["good"]["fingerprint"]) == (True, "b", [], digest(b"weights"))
    assert (got["bare"]["loadable"], got["bare"]["base_model"], got["bare"]["fingerprint"], len(got["bare"]["problems"])) == (True, "c", digest(b"w0"), 1)
    assert not got["odd"]["loadable"] and not got["odd"]["has_card"] and "no base model" in got["odd"]["problems"]
    assert "made from trial data" in got["trial"]["problems"] and not got["trial"]["loadable"]


def test_chat_samples_are_read(spark, tmp_path):
    lines = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"messages": []}, {"x": 1}]
    (tmp_path / "s.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    got = files.read_chat(spark, f"{tmp_path}/s.jsonl").collect()
    assert [(r["n_messages"], r["answer"]) for r in got] == [(2, "a")]


def test_index_is_built_anew_after_a_release(spark, tmp_path):
    from loomspark import scratch
    from loomspark.plans import catalogue

    spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = scratch._written[:]
    scratch._written.clear()
    assert catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).count() == 1
    scratch.release(spark, keep=("index-",))
    assert catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).count() == 1 and scratch._written
    scratch.release(spark)
    assert not scratch._written and catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).count() == 1
    scratch._written.extend(held)


def _prose(rng, n, words):
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40))) for _ in range(n)]


def test_many_questions_read_the_texts_once_by_bm25(spark, monkeypatch):
    """Bounds from some of the texts change no result; copies of a question are searched for once. Before, each thousand questions read all texts again."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts, asked = _prose(rng, 400, words), _prose(rng, 30, words) * 40
    held = index.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3))
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = retrieval.bm25_index(held, queries, 5)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(blocks, "MANY", 10)
    monkeypatch.setattr(blocks, "SOME", 2)
    bounded, every = retrieval.bm25_index(held, queries, 5).collect(), retrieval.bm25_index(held, queries.where("query_id < 30"), None).where("rank <= 5").collect()
    plain = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in every}
    for rows in (got.collect(), bounded):
        assert len(rows) == 40 * len(plain) and all(plain[r["query_id"] % 30, r["rank"]] == (r["id"], pytest.approx(r["score"], abs=1e-8)) for r in rows)


def _run(batch, asked, with_, edge, texts, k):
    import pyarrow as pa

    table = pa.table({"id": pa.array(range(len(texts))), "flat": texts, "project": pa.nulls(len(texts), pa.string())})
    told = type("Told", (), {"value": (asked, with_, edge)})
    return [r for b in batch(told, k)(iter(table.to_batches(max_chunksize=70))) for r in b.to_pylist()]


def test_many_questions_read_the_texts_once_by_tokens(spark, monkeypatch):
    """As by BM25, with the ties of shares; and frequent tokens no longer lead to every text."""
    pytest.importorskip("ahocorasick")
    import numpy as np

    rng = random.Random(7)
    words = [a + b for a in ("", "b", "st", "q") for b in ("an", "on", "in", "er", "ou", "ath", "a1", "zz", "k", "lo")]
    texts, asked = _prose(rng, 500, words), [t for t in _prose(rng, 60, words) if t][:40] * 30
    tokens = [list(dict.fromkeys(x for x in q.split() if len(x) > 1)) for q in asked[:40]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, flat string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = retrieval.token_fraction(rows, queries, 5)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    plain = {}
    for q, own in enumerate(tokens):
        found = sorted((-sum(t in x for t in own) / len(own), i) for i, x in enumerate(texts) if any(t in x for t in own))[:5]
        plain |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(found)}
    monkeypatch.setattr(blocks, "MANY", 10)
    monkeypatch.setattr(blocks, "SOME", 2)
    for one in (got.collect(), retrieval.token_fraction(rows, queries, 5).collect()):
        assert len(one) == 30 * len(plain) and all(plain[r["query_id"] % 40, r["rank"]] == (r["id"], r["score"]) for r in one)

    monkeypatch.setattr(blocks, "ROWS", 10)
    monkeypatch.setattr(blocks, "STEP", 2)
    names = list(dict.fromkeys(t for own in tokens for t in own))
    first, term = np.cumsum([0, *map(len, tokens)]), np.array([names.index(t) for own in tokens for t in own], np.int32)
    asked_ = blocks._Asked([[i] for i in range(40)], [None] * 40, first, term, np.ones(len(term)), np.diff(first).astype(float), -np.array([len(t) for t in names]), 1.0)
    held = []
    real = blocks._Sums
    monkeypatch.setattr(blocks, "_Sums", lambda *a: held.append(real(*a)) or held[-1])
    edge = np.array([plain[q, 5][1] if (q, 5) in plain else -np.inf for q in range(40)])
    for at in (None, edge):
        best = _run(blocks._token_batch, asked_, names, at, texts, 5)
        assert {(r["query_id"], r["id"]): r["score"] for r in best} == {(q, d): s for (q, _), (d, s) in plain.items()}
        assert len(held[-1].lead_of) < 0.7 * len(term)
