"""The pipeline's stages one after another, over tables with nulls, repeats, long texts and clashing columns."""

import random

import corpus_pipeline
from rookery.llm import ngram_join

from .test_operators import frame, grams, words


def tables(spark, path, docs, labels, bench):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(120):
        w = words(rng, rng.randint(30, 90), 300).split()
        if i % 4 == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if i % 4 == 1 else 1, 0))
    item = words(rng, 30, 5000)
    near = rows[0][1].split()
    near[5] = "changed"
    rows += [(500, " ".join(near)), (501, rows[0][1]), (502, rows[2][1] + " " + item), (503, rows[3][1] + " mail me a.b@c.org"), (504, None), (505, ""), (None, words(rng, 50, 300)), (2, rows[2][1]), (506, words(rng, 30_000, 50_000))]
    d = str(tmp_path / "t")
    tables(spark, d, frame(spark, rows), labels, [(1, item), (2, None)])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if n < 4:
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    quality, near_, clean, pii, mixed = seen
    ids = lambda x: [r.doc_id for r in x]
    good = [i for i in range(120) if i % 4 != 1]
    assert sum(i in ids(quality) for i in good) > 85 and sum(i in ids(quality) for i in range(1, 120, 4)) < 3
    kept = [r.text for r in near_ if r.text]
    assert all(len(grams(a) & grams(b)) < 0.5 * len(grams(a) | grams(b)) for i, a in enumerate(kept) for b in kept[:i])
    assert ids(near_).count(2) == 1 and not {500, 501} <= set(ids(near_))
    assert set(ids(near_)) - set(ids(clean)) <= {502} and 502 not in ids(clean)
    assert ids(pii).count(503) == ids(clean).count(503) and not [r for r in pii if "@c.org" in (r.text or "")]
    assert {r.epoch for r in mixed} <= {1, 2, 3, 4} and set(ids(mixed)) <= set(ids(pii))
    assert corpus_pipeline.run(spark, d).count() == len(mixed)


def test_no_documents(spark, tmp_path):
    d = str(tmp_path / "t")
    tables(spark, d, frame(spark, [(1, "x")]).limit(0), [], [])
    assert corpus_pipeline.run(spark, d).count() == 0
    assert ngram_join.keep_one(spark.read.parquet(f"{d}/documents.parquet")).count() == 0
