import random

import corpus_pipeline


def test_stages_hand_on_documents(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: ". ".join(" ".join(["the", *rng.choices(words, k=7)]) for _ in range(n)) + "."
    rows = [(i, text(12), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(10)] + [(200 + i, "%%% " + " ".join(w.upper() + "!!" for w in rng.choices(words, k=50)), "en", "s0", 1) for i in range(10)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 0:
            assert not ids & set(range(200, 210)) and set(range(60)) <= ids
        if k == 1:
            assert not ids & set(range(100, 110)) and set(range(60)) <= ids
    assert {"bucket", "batch", "place", "text"} <= set(docs.columns) and docs.count() >= 50
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == docs.columns


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
