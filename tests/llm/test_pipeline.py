"""The stages against brute force on their own inputs; only the network of the first one is taken as it is."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corymb.llm import bytecnn, mixing
from tests.llm.test_operators import DOCS, brute_components, brute_decontamination, words


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    item = words(rng, 30, 900)
    rows = []
    for i in range(80):
        w = words(rng, rng.randrange(20, 80), 900)
        if i % 9 == 0:
            w[5:5] = item[3:25]
        rows.append((i, " ".join(w), "en", f"s{i % 3}" if i % 7 else None, 5))
    rows += [(100 + i, rows[i][1], "en", "s1", 5) for i in range(10)] + [(200, None, "en", "s1", 0), (201, "12 34", None, "s1", 0), (202, "", None, "s2", 0)]
    d = spark.createDataFrame(rows, DOCS)
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    docs, seen = d, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept = [tuple(r) for r in out.collect()]
        if name != "hilbert_sharding":
            assert out.columns == docs.columns
        before = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            model = bytecnn.fit(docs)
            ok = {r["doc_id"] for r in bytecnn.identify(docs, model).collect() if r["lang_pred"] != "und" and r["lang_score"] >= 0.35}
            assert {r[0] for r in kept} == ok and not ok & {200, 201, 202} and len(ok) == 90
        if name == "ngram_jaccard_join":
            assert sorted(r[0] for r in kept) == sorted(i for i, _, c in brute_components(before) if i == c)
        if name == "decontamination":
            bad = {r[0] for r in brute_decontamination(before, [(1, " ".join(item))]) if r[5]}
            assert sorted(r[0] for r in kept) == sorted(r[0] for r in before if r[0] not in bad) and bad
        if name == "source_mixing":
            assert set(kept) <= set(before) and max(Counter(kept).values()) == 2
            size = lambda rows, source: sum(len((r[1] or "").split()) for r in rows if r[3] == source)  # noqa: E731, B023
            target = {r["source"]: r["target"] for r in mixing.mix(docs, mixing.word_count(F.col("text"))).collect()}
            longest = max(len((r[1] or "").split()) for r in before)
            assert all(abs(size(kept, source) - t) <= longest for source, t in target.items()) and len(target) == 4
        if name == "hilbert_sharding":
            assert sorted(r[:5] for r in kept) == sorted(before)
            count = [sum(r[5] == s for r in kept) for s in range(24)]
            assert max(count) - min(count) <= 1
        seen.append(len(kept))
        docs = spark.createDataFrame(kept, out.schema)
    assert corpus_pipeline.run(spark, sf).count() == seen[-1]


def test_clashing_columns_survive(spark):
    d = spark.createDataFrame([(1, "ab cd ef", "en", "s", 8, "mine")], DOCS + ", repeats string")
    out = corpus_pipeline.mixture(spark, d, "")
    assert out.columns == d.columns and all(r["repeats"] == "mine" for r in out.collect())


def test_rows_that_share_an_id(spark):
    a, b, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60)), " ".join(["x"] + [f"w{i}" for i in range(1, 60)])
    rows = [(1, a, "en", "s", 0)] * 3 + [(1, b, "en", "s", 0), (2, b, "en", "s", 0), (2, near, "en", "s", 0), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (None, a, "en", "s", 0), (4, "", "en", "s", 0)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()
    by = Counter((r["doc_id"], r["text"]) for r in kept)
    assert by[(1, a)] + by[(2, near)] == 1 and by[(1, b)] == 1 and by[(2, b)] == 0  # one of each group
    assert by[(3, None)] == 2 and by[(None, a)] == 1 and by[(4, "")] == 1 and sum(by.values()) == 6


def test_without_labels_all_documents_stay(spark):
    d = spark.createDataFrame([(1, "ab cd", None, "s", 5), (2, None, None, "s", 0)], DOCS)
    assert corpus_pipeline.language(spark, d, "").count() == 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_without_rows(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame([], DOCS + ", shard string, n_hit int")
    out = stage(spark, d, f"file://{tmp_path}")
    assert out.count() == 0 and set(d.columns) <= set(out.columns)


def test_very_long_texts_pass_whole(spark, tmp_path):
    rng = random.Random(5)
    item = words(rng, 20, 900)
    long = words(rng, 60_000, 4000)
    rows = [(i, " ".join(long[:-1] + [f"end{i}"]), "en", "s", 0) for i in range(2)] + [(5, " ".join(words(rng, 300, 900) + item), "en", "s", 0), (6, " ".join(words(rng, 3000, 900)), "en", "t", 0)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"] for r in out} == {0, 6} and all(r["text"] == rows[0][1] for r in out if r["doc_id"] == 0)
