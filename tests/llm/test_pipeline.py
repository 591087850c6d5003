"""The pipeline's stages on a small corpus with known cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    test = words(15)
    rows, labels = [], []
    for i in range(200):
        w = words(60)
        if i % 10 == 3:
            w[20] = "idiot"
        rows.append([i, " ".join(w)])
        labels.append((i, int(i % 10 == 3)))
    copies, near, leaks = range(200, 206), range(206, 212), range(212, 216)
    for i in copies:
        rows.append([i, rows[0][1].replace(" ", "  ")])
    for i in near:
        rows.append([i, rows[1][1] + f" extra{i}"])
    for i in leaks:
        rows.append([i, " ".join(words(30) + test + words(30))])
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(test))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left, now = {r[0] for r in rows}, docs
    gone = [{i for i in range(200) if i % 10 == 3}, set(copies), set(near), set(leaks)]
    for no, ((_, stage), out) in enumerate(zip(corpus_pipeline.STAGES[:4], gone, strict=True)):
        made = stage(spark, now, folder)
        assert made.columns == docs.columns
        made.write.parquet(f"{folder}/stage{no}")
        now = spark.read.parquet(f"{folder}/stage{no}")
        left -= out
        assert {r.doc_id for r in now.select("doc_id").collect()} == left
    mixed = corpus_pipeline.STAGES[4][1](spark, now, folder).collect()
    assert {r.doc_id for r in mixed} <= left and max(r["copy"] for r in mixed) <= 3
    taken = sum(len(r.text.split()) for r in mixed)
    total = sum(len(t.split()) for i, t in rows if i in left)
    assert abs(taken - total) <= 4 * 100
