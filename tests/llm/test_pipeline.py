"""The pipeline on a small fixture: what each stage must drop and keep, and the packed ids of what is left."""

import random

import corpus_pipeline


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 30)
    shared = "\n".join(prose(rng, 20) for _ in range(3))
    clean = [prose(rng, 80) for _ in range(6)]
    near = clean[0].split()
    near[40] = "other"
    texts = [*clean, clean[1], " ".join(near), clean[2] + " x " + item + " y", " | ".join(prose(rng, 1) for _ in range(60)), "short", None, prose(rng, 60) + "\n" + shared, prose(rng, 70) + "\n" + shared]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        assert k == 4 or docs.columns == columns
        out[name] = {r.doc_id: r for r in docs.collect()}
    assert set(out["quality_rules"]) == {*range(9), 12, 13}
    assert out["line_dedup"][12].text == texts[12] and out["line_dedup"][13].text == texts[13].split("\n")[0]
    assert set(out["ngram_jaccard_join"]) == {*range(6), 8, 12, 13}
    assert set(out["benchmark_decontamination"]) == {*range(6), 12, 13}
    assert set(out["packing"]) == {*range(6), 12, 13}
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in run} == set(out["packing"])
    assert all(f(spark, docs_empty(spark, columns, tmp_path), str(tmp_path)).count() == 0 for _, f in corpus_pipeline.STAGES)


def docs_empty(spark, columns, tmp_path):
    return spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
