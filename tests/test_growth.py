"""What must not grow with the tables: memory of a task, rows and bytes that leave it, passes over its input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import naive_bleu

from tessera.functions import text
from tessera.functions.masking import uniforms
from tessera.operators import likelihood, moments, neighbours, ngrams
from tessera.operators.kmeans import closest, plus_plus
from tessera.plans import evaluate, generate
from tessera.queries import QUERIES


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<float>")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def batch(ids, x, extra=None):
    return pa.record_batch({"id": pa.array(ids, pa.int64()), "vector": pa.array(list(x), pa.list_(pa.float32())), "extra": pa.array(np.zeros(len(ids)) if extra is None else extra, pa.float64())})


def test_only_the_best_leave_a_task(spark):
    rng = np.random.default_rng(1)
    found = neighbours.nearest(vectors(spark, rng.normal(size=(20, 4))), vectors(spark, rng.normal(size=(90, 4))).repartition(6), 2, "l2")
    assert "Window" not in plan(found)
    assert found.groupBy("id").count().where("count <> 2").count() == 0


def test_a_task_of_nearest_has_bounded_memory():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(14_000, 32)).astype(np.float32)
    parts = [batch(np.arange(lo, lo + 1000), x[lo : lo + 1000]) for lo in range(0, len(x), 1000)]
    tracemalloc.start()
    scan = neighbours._Nearest(parts[:4], 3, "l2")
    for part in parts[4:]:
        scan.add(part)
    rows = pa.Table.from_batches(scan.out())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.num_rows == 12_000
    # all scores of a batch would be 330 MB
    assert peak < 120e6
    own = np.round(neighbours.likeness(x[:5].astype(float), x[4000:].astype(float), "l2"), 9)
    assert np.array_equal(np.asarray(rows["neighbour"])[:15].reshape(5, 3), 4000 + np.argsort(-own, axis=1, kind="stable")[:, :3])


def test_equal_rows_go_by_id(spark):
    x = np.ones((50, 3)) * 7
    x[::5] += 0.5
    df = vectors(spark, x)
    found = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, df.repartition(4), 3, "l2").collect()}
    assert [found[1, k] for k in (1, 2, 3)] == [1, 2, 3] and [found[10, k] for k in (1, 2, 3)] == [0, 5, 10]


def test_vectors_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 6)) + 1000).astype(np.float32)
    x[-1] = 1e6
    exact = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(vectors(spark, x), vectors(spark, x), 3, "l2").collect()}
    order = np.argsort(np.round(exact, 9), axis=1, kind="stable")[:, :3]
    assert all(got[i, k + 1] == order[i, k] for i in range(60) for k in range(3))


def test_realism_of_equal_vectors_is_exact(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 8)) * 40).astype(np.float32)
    x[20:25] = x[3]
    refs = vectors(spark, x).withColumn("radius", F.when(F.col("id") < 20, 2.0).when(F.col("id") < 25, 0.0).otherwise(1e-7))
    rows = {r["id"]: r for r in neighbours.covered(vectors(spark, np.vstack([x[:4], x[:4] + 500])), refs).collect()}
    far = np.sqrt(((x[:4].astype(float)[:, None] + 500 - x[None, :20].astype(float)) ** 2).sum(2))
    for i in range(4):
        assert rows[i]["inside"] and rows[i]["realism"] == pytest.approx(2.0 / 1e-5)
        assert not rows[4 + i]["inside"] and rows[4 + i]["realism"] == pytest.approx((2.0 / (far[i] + 1e-5)).max(), rel=1e-5)
    alone = {r["id"]: (r["inside"], r["realism"]) for r in neighbours.covered(vectors(spark, x[:4]), refs.where("radius = 0")).collect()}
    assert alone == {0: (False, 0.0), 1: (False, 0.0), 2: (False, 0.0), 3: (True, 0.0)}
    none = neighbours.covered(vectors(spark, x[:2]), refs.limit(0)).collect()
    assert [(r["inside"], r["realism"]) for r in none] == [(False, 0.0)] * 2


def test_thresholds_share_neighbours(spark, sf, monkeypatch):
    calls, nearest = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a, **b: calls.append(1) or nearest(*a, **b))
    assert QUERIES["knn_precision_recall"](spark, sf).count() == 2
    assert len(calls) == 2


def test_ngrams_travel_as_arrays(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 60))) for _ in range(40)]
    texts += [texts[0] + " x", "a a a a a a", "a a a a a a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    monkeypatch.setattr(ngrams, "RANGE", 50, raising=False)
    row = ngrams.self_bleu(df).agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("bleu")) / F.sum("copies")).alias("b")).first()
    assert row["n"] == len(texts) and row["b"] == pytest.approx(naive_bleu(texts), abs=1e-9)
    own = df.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    made = ngrams._matches(own, 2000)
    assert made.count() == len(set(texts)) and "Generate" not in plan(made)


def test_numbers_come_back():
    for x in ([], [0], [0, 255, 256], [2**64 - 1, 0, 7]):
        assert ngrams._numbers(ngrams._bytes(np.array(x, np.uint64))).tolist() == x


def test_likelihood_with_rare_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(30)], 20)) if i % 7 else ["", None, " \t\n", "w1\x0bw1\u00a0w2"][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = likelihood.unigram_counts(df.where("doc_id % 2 = 1"))
    want = {r["doc_id"]: (r["n_words"], r["nll"]) for r in likelihood.mean_nll(df, counts).collect()}
    n = {r["word"]: r["n"] for r in counts.collect()}
    size = sum(n.values()) + len(n)
    for i, t in rows:
        own = [w.decode() for w in (t or "").encode().split()]
        assert (i in want) == bool(own)
        if own:
            assert want[i] == (len(own), pytest.approx(np.mean([-np.log((n.get(w, 0) + 1) / size) for w in own]), abs=1e-6))
    monkeypatch.setattr(likelihood, "COMMON", 5)
    few = likelihood.mean_nll(df, counts)
    assert {r["doc_id"]: (r["n_words"], pytest.approx(r["nll"], abs=2e-6)) for r in few.collect()} == want
    # before they meet the counts, words are not rows of a shuffle by text and word
    assert "Generate" not in plan(few)


def test_masks_are_those_of_the_column(spark):
    texts = ["", " a\tb  c\x0bd\u00a0e ", None, " ".join(f"w{i}" for i in range(1200)), "x"]
    df = spark.createDataFrame([(10**12 * i - 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = generate.variations(df)
    assert "md5" not in plan(made)
    got = {(r["doc_id"], r["var_idx"]): r["text"] for r in made.collect()}
    for v in (1, 2):
        key = F.concat(F.col("doc_id").cast("string"), F.lit(f"/{v}"))
        assert {r[0]: r[1] for r in df.select("doc_id", text.masked(F.col("text"), key, 0.25)).collect()} == {k: t for (k, n), t in got.items() if n == v}
    assert {r[0]: r[1] for r in df.select("doc_id", text.normalised(F.col("text"))).collect()} == {k: t for (k, n), t in got.items() if n == 0}


def test_uniforms(spark):
    keys, counts = [b"42|7", b"42|" + b"k" * 60, b"42|" + b"k" * 48, b"x"], [1101, 12, 120, 0]
    rows = [(k.decode(), n) for k, c in zip(keys, counts, strict=True) for n in range(c)]
    want = [r[0] for r in spark.createDataFrame(rows, "k string, n long").coalesce(1).select(text.hash_uniform(F.col("k"), F.col("n"))).collect()]
    assert uniforms(keys, np.array(counts)).tolist() == want


def test_kmeans_side_by_side_is_as_good_as_mllib(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 600)] * 4 + rng.normal(size=(600, 6)) * 0.3
    p, q = vectors(spark, x[:300]), vectors(spark, x[300:])

    def cost():
        found = evaluate.clustered(p, q, 12, share=1.0, restarts=3)[0].toPandas()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        own = u[np.where(found["side"] == "p", 0, 300) + found["id"]]
        assert len(found) == 600
        return sum(((own[found["label"] == k] - own[found["label"] == k].mean(0)) ** 2).sum() for k in set(found["label"]))

    by_mllib = cost()
    monkeypatch.setattr(evaluate, "MLLIB_PAIRS", 0, raising=False)
    monkeypatch.setattr("pyspark.ml.clustering.KMeans.fit", None)
    assert cost() <= by_mllib * 1.1


def test_closest_and_starts():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 5))
    label, far = closest(x, x[:700])
    apart = ((x[:, None] - x[None, :700]) ** 2).sum(2)
    assert np.array_equal(label, apart.argmin(1)) and np.allclose(far, apart.min(1), atol=1e-9)
    assert plus_plus(np.ones((5, 2)), np.ones(5), 3, 1).shape == (3, 2)


def test_sinkhorn_rounds_are_dealt_to_the_cores(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = (rng.normal(size=(n, 3)).astype(np.float32) for n in (160, 140))
    want = moments.sinkhorn_divergence(x.astype(float), y.astype(float), rounds=12)
    assert moments.sinkhorn_divergence(x.astype(float), y.astype(float), rounds=12, spark=spark) == pytest.approx(want, abs=1e-9)
    given = []
    monkeypatch.setattr(evaluate, "LOCAL_PAIRS", 100, raising=False)
    monkeypatch.setattr(evaluate, "sinkhorn_divergence", lambda a, b, spark=None: given.append((len(a), len(b), spark)) or 0.0)
    evaluate.sampled_sinkhorn(vectors(spark, x), vectors(spark, y))
    assert given == [(160, 140, spark)]
