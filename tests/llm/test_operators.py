"""Operators on small tables with nulls, repeats, ties, very long texts and clashing names, against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import capdedup, jaccard, langid, licenses, linehtml, mixing, packing, pii, quality, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, size string, k string, shard string, w string, spans string, lang_pred string, _h string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * 8) for i, t, lang, s in rows], SCHEMA)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(0)
    base = prose(rng, 120)
    near = [base.replace(base.split()[k], "changed", 1) for k in (3, 50, 90)]
    texts = [None, "", " \n\t ", "one", "one two", "One TWO", base, base, *near, prose(rng, 4000), "   word", "mail a.b@c.de and +1 (374) 555-3953", "é" * 300]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(25)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for i, t in enumerate(texts)]
    return [*out, (None, base, "en", "a"), (None, None, None, None), out[7], out[9]]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_equals_all_pairs(spark, rows, empty):
    named = [r for r in rows[:-4]]
    for width, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, named), width, percent).collect()}
        assert got == jaccard.brute_force([(i, t) for i, t, *_ in named], width, percent)
    every = jaccard.jaccard_components(documents(spark, rows), 3, 90).collect()
    assert len(every) == len(rows) and {r["component_id"] for r in every if r["doc_id"] is None} == {6, None}
    kept = [r["doc_id"] for r in jaccard.one_of_each(documents(spark, rows)).collect()]
    assert kept.count(6) == 1 and 7 not in kept and 8 not in kept and {0, 1, 2, 3}.issubset(kept)
    assert jaccard.jaccard_components(empty).count() == 0


def test_one_of_rows_that_share_ids(spark, empty):
    a, b = prose(random.Random(8), 40), prose(random.Random(9), 40)
    rows = [(1, a, None, None), (5, a + " more", None, None), (5, b, None, None), (7, b, None, None), (5, b, None, None), (None, a, None, None), (None, None, None, None), (9, "", None, None), (9, prose(random.Random(10), 40), None, None), (None, prose(random.Random(11), 30), None, None)]
    kept = jaccard.one_of_each(documents(spark, rows).withColumn("_jaccard_id", F.lit("x")).withColumn("row", F.lit("y")))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("1", a), ("5", b), ("None", rows[-1][1]), ("9", rows[-2][1]), ("None", "None"), ("9", "")])
    assert kept.columns == [*empty.columns, "_jaccard_id", "row"] and jaccard.one_of_each(empty).count() == 0


def test_jaccard_chain_and_hot_passage(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(12):  # each links to the next, ends do not
        chain.append(" ".join(words))
        words[i * 15] = f"c{i}"
    hot = "this very common line stands in every text of the table"
    texts = chain + [f"{hot} {prose(rng, 8)}" for _ in range(40)] + [hot] * 3
    named = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, [(i, t, None, None) for i, t in named]), 3, 90).collect()}
    assert got == jaccard.brute_force(named, 3, 90)


def test_mix_meets_its_targets(spark, rows, empty):
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, _, s in rows:
        n = len(re.findall(mixing.WORD, t or ""))
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    aim = dict(zip(order, mixing.targets([size[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["_taken"] <= 3 * r["_size"] and r["_source_size"] == size[r["source"]] and r["_target"] == pytest.approx(float(aim[r["source"]]))
        taken[r["source"]] += r["_taken"]
    assert all(abs(taken[s] - aim[s]) <= 3 * mixing.BLOCK_WORDS for s in order)
    key = lambda rs: sorted((str(r["doc_id"]), r["_size"], r["_taken"]) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(3)).collect())
    again = mixing.taken_texts(mixing.mix(docs))
    assert sum(len(re.findall(mixing.WORD, r["text"])) for r in again.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0
    few = mixing.taken_texts(mixing.mix(docs.withColumn("_times_taken", F.lit(1)).withColumn("a.b", F.lit("x"))))
    assert few.columns == [*docs.columns, "_times_taken", "a.b"] and few.count() == again.count()


def test_mix_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 40)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    rng = random.Random(15)
    docs = documents(spark, [(i, prose(rng, rng.randint(1, 60)), None, rng.choice("aab")) for i in range(200)])
    got = mixing.mix(docs).collect()
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["_taken"] for r in mine) - mine[0]["_target"]) <= 3 * mixing.BLOCK_WORDS and all(r["_taken"] <= 3 * r["_size"] for r in mine)


def test_quality_counts_and_bands(spark, rows, empty):
    got = quality.rate(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    rng = random.Random(2)
    docs = [(i, prose(rng, 150), "en", "a") for i in range(60)] + [(99, " ".join("".join(rng.choice("qxzj#%") for _ in range(5)) for _ in range(150)), "en", "a")]
    kept = {r["doc_id"]: r["kept"] for r in quality.rate(documents(spark, docs)).collect()}
    assert not kept[99] and sum(kept.values()) >= 59
    assert quality.rate(empty).count() == 0


def test_quality_keeps_every_gram(spark, rows):
    docs = documents(spark, [*rows, (500, "xyz", "rare", "a"), (501, "xyz", "rare", "a")])
    texts = {}
    for r in docs.collect():
        if r["text"]:
            texts.setdefault(r["lang"], []).append(r["text"])
    plain = {}
    for lang, mine in texts.items():
        table = quality.plain_table(sorted(set(mine)))
        plain |= {(lang, t): math.exp(e) for t, e in zip(mine, -quality._sums(mine, table) / quality._lengths(mine), strict=True)}
    text_of = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    whole = {str(r["doc_id"]) + str(r["n_words"]): r for r in quality.rate(docs).collect()}
    # The same verdicts and perplexities however many parts the model has.
    for r in quality.rate(docs, part_grams=300).collect():
        same = whole[str(r["doc_id"]) + str(r["n_words"])]
        assert r["kept"] == same["kept"] and (r["perplexity"] is None) == (same["perplexity"] is None)
        assert r["perplexity"] is None or r["perplexity"] == pytest.approx(same["perplexity"], rel=1e-9)
        if r["doc_id"] is not None and text_of[r["doc_id"]][1]:
            assert r["perplexity"] == pytest.approx(plain[text_of[r["doc_id"]]], rel=1e-5)
    assert len(quality.parts(quality.estimate(docs)[0], 300)) > 3


def test_language_of_held_out_rows(spark, empty):
    rng = random.Random(3)
    of = {"en": "the and of that this with from have".split(), "de": "der die und das nicht mit sich auf".split(), "fr": "le la les des est pour dans une".split()}
    docs = [(i, prose(rng, rng.randint(3, 60), of[lang]), lang, None) for i in range(120) for lang in [list(of)[i % 3]]]
    got = langid.identify(documents(spark, [*docs, (500, None, "en", None), (None, "12", None, None), docs[0]])).collect()
    truth = {i: lang for i, _, lang, _ in docs}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 10 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (500, None)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(documents(spark, [(1, "text", None, None)])).collect()} == {"und"}


def test_packing_places_every_piece(spark, rows, empty):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    got = packing.pack(documents(spark, rows), path, capacity=64, rounds=1, generations=2, n_islands=2).collect()
    ids = packing.Ids(path, 2)
    whole = sorted((str(i), len(ids.encode(t or ""))) for i, t, *_ in rows)
    by, at = {}, {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        at[str(r["doc_id"])] = at.get(str(r["doc_id"]), 0) + r["length"]
    assert sum(n for _, n in whole) == sum(r["length"] for r in got)
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 64
    assert len(by) <= 1.1 * sum(n for _, n in whole) / 64 + 1
    assert packing.pack(empty, path).count() == 0


LUHN = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and LUHN(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), pii.KINDS.index(kind), m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_ones(spark, rows, empty):
    rng = random.Random(4)
    texts = [t for _, t, *_ in rows] + ["4603252225223569 x 4111 1111 1111 1111", "a@b c@d.e@f.g..h@i-j.k", "1.2.3.4.5.6.7.8 001.002.3.999 255.255.255.255", "+1 (374) 555-3953 +123", "\U0001f389 a@b.cd", "1" * 30_000, "a" * 30_000 + "@", "+1" + " " * 5000]
    texts += ["".join(rng.choice(["a", "1", "4", ".", "@", "-", "+", " ", "(", "12", "255", "é"]) for _ in range(60)) for _ in range(400)]
    docs = [(i, t, None, None) for i, t in enumerate(texts)]
    for r in pii.report(documents(spark, docs)).collect():
        spans = plain_spans(texts[r["doc_id"]] or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in spans) for k in pii.KINDS]
        assert {x for x in line.split(",") if x} <= set(r["spans"].split(","))
    assert pii.report(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(5)
    docs = [(i, f"{prose(rng, 6)} telefon: +1 (374) 555-{1000 + i} {prose(rng, 6)}", None, None) for i in range(20)]
    docs += [(50, "telefon: 0374-555-3953 und mehr", None, None), (51, "the year 2024 and 12345678 alone", None, None), (None, "telefon: 0374-555-3953 und mehr", None, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, docs)).collect()}
    assert got[50] == got[None] == "phone:9:22" and got[51] == ""
    keys = [f'{prose(rng, 5)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(rng, 5)}' for i in range(8)] + ['x token = "abc12345" y', f"{hashlib.sha1(b'z').hexdigest()} alone"]
    spans = {r["doc_id"]: (r["spans"], r["n_spans"]) for r in pii.report(documents(spark, [(100 + i, t, None, None) for i, t in enumerate(keys)])).collect()}
    assert all(spans[100 + i] == (f"secret:{(a := t.index(chr(34)) + 1)}:{a + 40}", 1) for i, t in enumerate(keys[:8]))
    assert spans[108] == ("secret:11:19", 1) and spans[109] == ("", 0)
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.masked(documents(spark, docs)).collect()}
    assert masked[50] == ("telefon: [PHONE] und mehr", 25) and len(masked) == len(docs)


def test_very_many_matches_in_a_text(spark):
    text = " ".join(f"a{i}@b.cd {4000 + i}" for i in range(20_000))
    (row,) = pii.report(documents(spark, [(1, text, None, None)])).collect()
    masked = pii.masked(documents(spark, [(1, text, None, None)])).first()
    assert masked["text"] == re.sub(r"a\d+@b\.cd", "[EMAIL]", text) and masked["n_chars"] == len(masked["text"])
    assert row["n_email"] == 20_000 and row["base_sha256"] == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a\d+@b\.cd", text)).encode()).hexdigest()


def test_overlapping_spans_are_masked_once(spark):
    df = spark.createDataFrame([("ab 1.2.3.4 cd",)], "text string")
    span = "struct<start: int, rank: int, end: int, kind: string, value: string>"
    spans = F.expr(f"cast(array(named_struct('start', 3, 'rank', 1, 'end', 10, 'kind', 'ip', 'value', ''), named_struct('start', 5, 'rank', 2, 'end', 12, 'kind', 'card', 'value', '')) as array<{span}>)")
    assert df.select(pii.mask(F.col("text"), spans)).first()[0] == "ab [IP]d"


def test_pages_to_archives_and_back(spark):
    schema = "page_id long, url string, html string, first string, name string, content string"
    rows = [(3, "u", "same", "x", "x", "x"), (1, "v", "same", "x", "x", "x"), (2, None, None, "x", "x", "x"), (5, "w", "", "x", "x", "x"), (None, "n", "same", "x", "x", "x"), (9, "é\n", "é" * 5000, "x", "x", "x"), (1, "v", "same", "x", "x", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, schema)).collect()
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    assert found == sorted([(3, "revisit", 1, 4), (1, "response", None, 4), (2, "response", None, 0), (5, "revisit", 2, 0), (None, "revisit", 1, 4), (9, "response", None, 10000), (1, "response", None, 4)], key=str)
    assert all(r["payload_digest"] == warc.digest(("é" * 5000).encode()) for r in got if r["page_id"] == 9)
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_pages_and_notices_of_odd_rows(spark, rows, empty):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a&nbsp;b</p>", "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    got = linehtml.extract_pages(pages).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "", 0), ("1", "", 0), ("None", "a b", 3)]
    assert linehtml.extract_pages(pages.limit(0)).count() == 0
    scanned = licenses.scan_documents(documents(spark, rows))
    assert scanned.count() == len(rows) and scanned.where("size(notices) > 0").count() == 0 and licenses.scan_documents(empty).count() == 0


def test_near_vectors_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    group = base[0] + 0.05 * rng.standard_normal((30, 32))
    v = [x.tolist() for x in np.vstack([base, group, base[:3], 2 * base[3:5]])]
    odd = [None, [], [0.0] * 32, [1.0, None] + [0.0] * 30, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0] * 5]
    table = spark.createDataFrame([(i, x, 1, "x") for i, x in enumerate(v + odd)] + [(0, v[0], 1, "x")], "vec_id long, embedding array<float>, label int, nid string")
    got = capdedup.near_vectors(table).collect()
    f = np.array([np.float32(x) for x in v] + [np.float32(v[0])], float)
    ids = [*range(len(v)), 0]
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    root = list(ids)
    for _ in ids:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
    want = sorted((i, int(near[k].sum()) - 1, root[k], i == root[k]) for k, i in enumerate(ids)) + [(len(v) + i, 0, len(v) + i, True) for i in range(len(odd))]
    have = sorted(tuple(r) for r in got)
    missed = sum(a[1] for a in want) - sum(b[1] for b in have)
    assert 0 <= missed <= 0.1 * sum(a[1] for a in want) and [x[0] for x in have] == [x[0] for x in want]
    assert all(b[1] <= a[1] for a, b in zip(want, have)) and [b[2:] for b in have] == [a[2:] for a in want]
    assert capdedup.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_of_every_dimension(spark):
    rng = np.random.default_rng(4)
    rows, groups = [], []
    for dim, n in ((32, 20), (8, 6), (3, 4), (1, 2)):
        first = len(rows)
        base = rng.standard_normal(dim)
        rows += [(base * (k + 1)).tolist() for k in range(n)]
        groups += [first] * n
    rows.append((-np.array(rows[-1])).tolist())
    groups.append(len(rows) - 1)
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in capdedup.near_vectors(table).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == groups
    assert [got[i]["n_links"] for i in range(len(rows))] == [groups.count(g) - 1 for g in groups]


def test_jaccard_near_copies_of_many_kinds(spark):
    """Copies of a few texts with edits at random places: similarities on both sides of the threshold, prefixes that differ."""
    rng = random.Random(7)
    texts = []
    for size in (20, 45, 60):
        base = prose(rng, size).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[f"e{rng.randrange(5)}"], [], [w[k], f"n{rng.randrange(9)}"]])
            texts.append(" ".join(w))
    named = list(enumerate(texts))
    for width, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, [(i, t, None, None) for i, t in named]), width, percent).collect()}
        assert got == jaccard.brute_force(named, width, percent)
