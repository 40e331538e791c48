import corpus_pipeline as cp
from pyspark.sql import functions as F

from terralode.llm.decontaminate import words_of
from tests.llm.test_neardup import groups
from tests.llm.test_substrings import brute


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10_000, "12 34 !!", "en", "s", 8), (10_001, None, None, "s", None)], docs.schema)
    rows = {r.doc_id: r for r in docs.union(junk).collect()}
    out = docs.union(junk)
    stages = dict(cp.STAGES)

    out = spark.createDataFrame(stages["language ID"](spark, out, sf_dir).collect(), docs.schema)
    assert {r.doc_id for r in out.collect()} == set(rows) - {10_000, 10_001}

    kept = groups([(i, rows[i].text) for i in sorted(rows) if i < 10_000], 5, 4, 5)
    out = spark.createDataFrame(stages["near duplicates"](spark, out, sf_dir).collect(), docs.schema)
    assert {r.doc_id for r in out.collect()} == {i for i, c in kept.items() if i == c}

    want = {i: (t, n, gone) for i, t, n, gone in brute([(r.doc_id, r.text) for r in out.collect()], 50)}
    out = spark.createDataFrame(stages["repeated passages"](spark, out, sf_dir).collect(), docs.schema)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, (_, n, gone) in want.items() if not gone or gone < n}
    assert all(r.text == (want[i][0] if want[i][2] else rows[i].text) and r.n_chars == len(r.text) for i, r in got.items())

    tests = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    planted = {i for i, r in got.items() if any(f" {t} " in f" {' '.join(words_of(r.text))} " for t in tests)}
    out = spark.createDataFrame(stages["decontamination"](spark, out, sf_dir).collect(), docs.schema)
    left = {r.doc_id for r in out.collect()}
    assert planted and not planted & left and left == set(got) - planted

    packed = stages["packing"](spark, out, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    whole = cp.run(spark, sf_dir)
    assert whole.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_columns_and_names(spark, sf_dir):
    assert [name for name, _ in cp.STAGES] == ["language ID", "near duplicates", "repeated passages", "decontamination", "packing"]
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, none, sf_dir)
        assert out.columns == cp.COLUMNS and out.collect() == []
