"""The registered queries and the pipeline's stages on the smallest tables."""

import random

import pytest

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_stages_keep_clean_rows_and_drop_planted_ones(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    prose = lambda n: " ".join("".join(rng.choice("aeinrstl") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    base, passage = prose(150), prose(70)
    near = base.split()
    near[75] = "changed"
    planted = [(10_000, base), (10_001, base.replace(" ", "  ")), (10_002, " ".join(near)), (10_003, prose(80) + " " + passage), (10_004, passage + " " + prose(90)), (10_005, prose(100))]
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in planted], table.schema)
    docs, seen = table.union(extra), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "best_fit_packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {name: {i for i in rows if i >= 10_000} for name, rows in seen.items()}
    assert ids["quality_classifier"] == {i for i, _ in planted}
    assert ids["exact_dedup"] == {10_001, 10_002, 10_003, 10_004, 10_005}  # the longest copy stays
    assert ids["ngram_jaccard_join"] == ids["substring_dedup"] == {10_001, 10_003, 10_004, 10_005}
    assert passage not in seen["substring_dedup"][10_004] and seen["substring_dedup"][10_005] == planted[5][1]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(seen["substring_dedup"])


def test_pipeline_result(spark):
    import corpus_pipeline as pipeline

    assert [s for s, _ in pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    out = pipeline.run(spark, SMALL)
    assert out.count() > 100 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup"])
def test_oracle_columns(spark, name):
    import __spark_entry__ as entry

    assert set(entry.queries()[name](spark, SMALL).columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
    assert name in entry.oracle_sql()
