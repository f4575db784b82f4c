"""The pipeline's stages on a small folder, each held against a plain version of its decision."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from loomspark.llm import jaccard, mixing, packing  # noqa: E402
from loomspark.llm.queries import tokenizer_path  # noqa: E402

WORDS = {"en": "the and of that this with from have".split(), "de": "der die und das nicht mit sich auf".split()}


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, prose(lang, 60), lang, rng.choice(["a", "b"])) for i in range(30) for lang in [("en", "de")[i % 2]]]
    rows += [(40, rows[0][1], "en", "a"), (41, rows[1][1] + " end", "de", "b"), (42, None, "en", "a"), (43, "12 34", "en", None), (44, prose("en", 30) + " mail x.y@z.org or +1 (374) 555-3953", "en", "b")]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert {r["doc_id"] for r in seen["language"]} == {r[0] for r in rows} - {42, 43}
    roots = {root for _, root in jaccard.brute_force([(r["doc_id"], r["text"]) for r in seen["language"]]).values()}
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted(roots) and not {40, 41} & roots
    before, after = ({r["doc_id"]: r["text"] for r in seen[n]} for n in ("near_duplicates", "personal_data"))
    assert after[44].endswith("mail [EMAIL] or [PHONE]") and {i for i in after if after[i] != before[i]} == {44} and all(r["n_chars"] == len(r["text"]) for r in seen["personal_data"])
    size, took = {}, {}
    for n, out in (("personal_data", size), ("mixture", took)):
        for r in seen[n]:
            out[r["source"]] = out.get(r["source"], 0) + len(r["text"].split())
    aim = mixing.targets([size[s] for s in sorted(size)], [1, 2])
    assert all(abs(took[s] - t) <= 2 * mixing.BLOCK_WORDS for s, t in zip(sorted(size), aim))
    ids = packing.Ids(tokenizer_path(), 2)
    assert sum(r["length"] for r in seen["packed"]) == sum(len(ids.encode(r["text"])) for r in seen["mixture"])
    assert pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text, clashing names and an empty table, through every stage."""
    rng = random.Random(1)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))
    names = ["lang_pred", "score", "_size", "_taken", "row", "key", "_key", "_id", "_spans", "component", "a.b"]
    rows = [(i, prose(lang, 40), lang, rng.choice(["a", None])) for i in range(12) for lang in [("en", "de")[i % 2]]]
    rows += [(None, prose("en", 30), None, None), (None, None, None, None), (20, "", "en", "a"), (21, prose("de", 60_000), "de", "a"), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    table = spark.createDataFrame([(*r, len(r[1] or ""), *[f"{n} {r[0]}" for n in names]) for r in rows], schema)
    for n, docs in enumerate((table, table.limit(0), table.where("doc_id is null"))):
        for k, (name, stage) in enumerate(pipeline.STAGES):
            before, out = docs, stage(spark, docs, str(tmp_path))
            if k < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                out.write.parquet(f"{tmp_path}/{n}-{name}")
                docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
                assert all(r[f"{c}"] == f"{c} {r['doc_id']}" for r in docs.collect() for c in names)
            if n == 1:
                assert out.count() == 0
            elif name == "near_duplicates" and n == 0:
                assert sorted(str(r["doc_id"]) for r in docs.collect()) == sorted([*map(str, range(12)), "21", "None"])
        if n == 0:
            ids = packing.Ids(tokenizer_path(), 2)
            assert sum(r["length"] for r in out.collect()) == sum(len(ids.encode(r["text"])) for r in before.collect())
    # Each stage also takes rows that a stage before it would have dropped.
    for name, stage in pipeline.STAGES:
        assert stage(spark, table, str(tmp_path)).count() > 0
