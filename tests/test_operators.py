"""Operators against plain Python or numpy, and in different partitionings."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.models import embedded, generated, logit_bias
from tessera.operators import choice, divergence, likelihood, moments, neighbours, ngrams, ranking, sampling, votes
from tessera.plans import evaluate, generate, refine
from tessera.queries import QUERIES

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def vectors(spark, x, start=0, step=1):
    return spark.createDataFrame([(start + step * i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<float>")


@few
@given(st.lists(st.integers(-3, 3), max_size=40))
def test_ranks(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(3)
    got = {r["id"]: r["pos"] for r in ranking.ranked(df, "v", "id").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1)}


@few
@given(st.lists(st.floats(-5, 5).map(lambda x: round(x, 3)), min_size=1, max_size=30))
def test_percentile(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    assert ranking.percentile(ranking.ranked(df, "v", "id"), "v", 0.1) == pytest.approx(np.percentile(values, 10))


def test_smallest_takes_both_ways(spark, monkeypatch):
    df = spark.range(3000).withColumn("h", F.md5(F.col("id").cast("string")))
    want = {r["id"] for r in ranking.smallest(df, 700, F.col("h"), "id").collect()}
    monkeypatch.setattr(ranking, "SMALL", 10)
    assert {r["id"] for r in ranking.smallest(df, 700, F.col("h"), "id").collect()} == want and len(want) == 700
    assert ranking.smallest(df, 5000, F.col("h"), "id").count() == 3000


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("label"))
    for f in (lambda d: sampling.fixed_sample(d, 50), lambda d: sampling.stratified_sample(d, "label", 60), lambda d: sampling.balanced_sample(d, "label", 7), lambda d: sampling.validation_split(d, 5)[1]):
        assert {r["doc_id"] for r in f(df.repartition(1)).collect()} == {r["doc_id"] for r in f(df.repartition(7)).collect()}
    assert sampling.stratified_sample(df.limit(0), "label", 60).count() == 0


def test_equal_depth_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "doc_id long, nll double")
    binned = likelihood.equal_depth_bins(df, "nll", "doc_id", 3)
    assert sorted(Counter(r["bin"] for r in binned.collect()).items()) == [(0, 2), (1, 2), (2, 3)]
    assert sorted(r["doc_id"] for r in likelihood.representatives(binned, "nll").collect()) == [0, 2, 5]


def test_refinement_keeps_most(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 12))) for i in range(200)], "doc_id long, text string")
    kept = refine.refinement_filter(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))
    assert 90 <= kept.count() <= 100
    assert refine.refinement_filter(docs.limit(0), docs.limit(0)).count() == 0


@pytest.mark.parametrize("mode", neighbours.MODES)
def test_nearest(spark, mode):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(13, 5)).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32)
    got = neighbours.nearest(vectors(spark, a), vectors(spark, b).repartition(3), 3, mode, block=4).collect()
    score = neighbours.likeness(a.astype(float), b.astype(float), mode)
    for i in range(13):
        assert [r["neighbour"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == list(np.argsort(-score[i])[:3])


def test_precision_and_recall(spark):
    p, q = vectors(spark, [[1, 0], [0, 1], [0, -1]]), vectors(spark, [[1, 0.01], [-1, 0]])
    row = neighbours.threshold_precision_recall(p, q).first()
    assert (row["precision"], row["recall"]) == (0.5, pytest.approx(1 / 3))
    radius = {r["id"]: r["radius"] for r in neighbours.radii(p, 1).collect()}
    assert radius[0] == pytest.approx(math.sqrt(2))
    inside = {r["id"]: r["inside"] for r in neighbours.covered(q, p.join(neighbours.radii(p, 1), "id")).collect()}
    assert inside == {0: True, 1: True}


def test_votes(spark):
    public = vectors(spark, [[0, 0], [5, 5], [9, 9]]).withColumn("pos", F.col("id"))
    found = {r["slot"]: r["votes"] for r in neighbours.votes(public, vectors(spark, [[0, 1], [1, 0], [9, 8]])).collect()}
    assert found == {0: 2, 1: 0, 2: 1}


def hist(spark, p, q):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, q, strict=True))], "bin long, p double, q double")


def test_divergences(spark):
    row = divergence.kl_tv_w1(hist(spark, [0.5, 0.5, 0, 0], [0.25] * 4)).first()
    assert row["kl"] == pytest.approx(0.6931468198722176, abs=1e-9)
    assert row["tv"] == pytest.approx(0.49999999) and row["wass"] == pytest.approx(0.249999995)
    assert divergence.frontier_integral(hist(spark, [0.5, 0.5], [0.5, 0.5])).first()["frontier"] == 0
    same = divergence.mauve(divergence.divergence_curve(hist(spark, [0.5, 0.5], [0.5, 0.5]))).first()["mauve"]
    apart = divergence.mauve(divergence.divergence_curve(hist(spark, [1, 0], [0, 1]))).first()["mauve"]
    assert same == pytest.approx(1, abs=1e-6) and apart < 0.05


@few
@given(st.lists(st.integers(1, 9), min_size=2, max_size=6), st.randoms())
def test_divergence_ranges(spark, counts, r):
    other = counts[:]
    r.shuffle(other)
    row = divergence.kl_tv_w1(hist(spark, np.array(counts) / sum(counts), np.array(other) / sum(other))).first()
    assert row["kl"] >= -1e-12 and -1e-12 <= row["tv"] <= 1 + 1e-12 and row["wass"] == pytest.approx(0)


def test_moments_and_distances(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)).astype(np.float32), (rng.normal(size=(50, 4)) * 2 + 1).astype(np.float32)
    both = evaluate.sides(vectors(spark, x), vectors(spark, y)).repartition(5)
    got = moments.gathered(both)
    assert got["p"][0] == 60 and np.allclose(got["q"][2], np.cov(y.T.astype(float)), atol=1e-6)
    rows = {(r["side"], r["i"], r["j"]): r["cov"] for r in moments.moments(both).collect()}
    assert rows["p", 1, 2] == pytest.approx(np.cov(x.T.astype(float))[1, 2], abs=1e-6)
    a, b = np.cov(x.T.astype(float)), np.cov(y.T.astype(float))
    trace = np.sqrt(np.clip(np.linalg.eigvals(a @ b).real, 0, None)).sum()
    want = ((x.mean(0, dtype=float) - y.mean(0, dtype=float)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * trace
    assert evaluate.frechet_distance(vectors(spark, x), vectors(spark, y)) == pytest.approx(want, abs=1e-6)
    assert moments.frechet(got["p"][1], got["p"][2], got["p"][1], got["p"][2]) == pytest.approx(0, abs=1e-8)
    assert moments.axes_needed(np.diag([8.0, 1.5, 0.4, 0.1])) == 2
    assert moments.sinkhorn_divergence(x.astype(float), x.astype(float)) == pytest.approx(0, abs=1e-9)
    assert moments.sinkhorn_divergence(x.astype(float), x.astype(float) + 3) == pytest.approx(18, rel=0.05)


def test_sinkhorn_takes_all_vectors(spark):
    rng = np.random.default_rng(9)
    x, y = (rng.normal(size=(n, 3)).astype(np.float32) for n in (560, 540))
    want = moments.sinkhorn_divergence(x.astype(float), y.astype(float))
    assert evaluate.sampled_sinkhorn(vectors(spark, x), vectors(spark, y)) == pytest.approx(want, abs=1e-9)
    assert moments.sinkhorn_divergence(x.astype(float), y.astype(float), cells=1000) == pytest.approx(want, abs=1e-9)


def test_mauve_query_fits_in_full(spark, sf, monkeypatch):
    from pyspark.ml.clustering import KMeans

    made, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: made.append((self.getK(), self.getSeed(), self.getMaxIter())) or fit(self, rows))
    assert 0 <= QUERIES["mauve_kmeans"](spark, sf).first()["mauve"] <= 1
    assert made == [(25, 25 + r, 500) for r in range(5)]


def naive_bleu(texts):
    total = []
    for own in texts:
        hyp, refs = own.split(), [t.split() for t in texts if t != own]
        grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        logs, first = 0.0, 1
        for n in range(1, 5):
            mine = grams(hyp, n)
            most = Counter()
            for r in refs:
                most |= grams(r, n)
            hit = sum(min(c, most[g]) for g, c in mine.items())
            first = hit if n == 1 else first
            logs += 0.25 * math.log((hit or 0.1) / max(1, sum(mine.values())))
        near = min((len(r) for r in refs), key=lambda k: (abs(k - len(hyp)), k))
        brevity = 1 if len(hyp) > near else 0 if not hyp else math.exp(1 - near / len(hyp))
        total.append(brevity * math.exp(logs) if first else 0.0)
    return sum(total) / len(total)


@few
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9).map(" ".join), min_size=2, max_size=9).filter(lambda t: len(set(t)) > 1))
def test_self_bleu(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    row = ngrams.self_bleu(df).agg(F.sum("copies").alias("n"), (F.sum(F.col("copies") * F.col("bleu")) / F.sum("copies")).alias("b")).first()
    assert row["n"] == len(texts) and row["b"] == pytest.approx(naive_bleu(texts), abs=1e-9)


def test_diversity(spark):
    row = ngrams.ngram_diversity(spark.createDataFrame([("a b a b",), ("",), (None,), ("x",)], "text string")).first()
    assert (row["distinct_grams"], row["total_grams"]) == (2, 3)
    assert ngrams.ngram_diversity(spark.createDataFrame([], "text string")).first()["diversity"] == 0


@pytest.mark.parametrize(("labels", "want"), [(["POSITIVE", "NEGATIVE", "POSITIVE"], "POSITIVE"), (["POSITIVE", "NEGATIVE"], "NEGATIVE"), (["NEGATIVE", "POSITIVE"], "POSITIVE"), (["ERROR", "ERROR"], "ERROR"), (["POSITIVE", "NEGATIVE", "ERROR"], "NEGATIVE")])
def test_majority(spark, labels, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "doc_id long, chunk_no int, label string")
    assert votes.majority(df).first()["label"] == want


def test_confident_and_match_rate(spark):
    df = spark.createDataFrame([(1, 0, "NEGATIVE", 0.9), (1, 1, "POSITIVE", 0.95), (1, 2, "ERROR", 1.0)], "doc_id long, chunk_no int, label string, score double")
    assert votes.confident(df).first()["label"] == "POSITIVE"
    pairs = spark.createDataFrame([("A", "A"), ("A", "ERROR"), ("B", "A")], "x string, y string")
    row = votes.match_rate(pairs, "x", "y").first()
    assert (row["total_pairs"], row["match_count"], float(row["match_rate"])) == (2, 1, 50.0)
    assert float(votes.match_rate(pairs.limit(0), "x", "y").first()["match_rate"]) == 0.0


def test_choice(spark):
    assert choice.sigma(100, 4.0) == pytest.approx(0.8913117694660917)
    assert choice.sigma(100, None) == choice.sigma(100, 0) == choice.sigma(100, math.inf) == 0
    rows = [(1, 1, 0.9, "negative", 0.9, "positive"), (1, 2, 0.2, "positive", 0.6, "positive"), (2, 1, 0.1, "negative", 0.9, None), (2, 2, 0.3, "negative", 0.9, None)]
    df = spark.createDataFrame(rows, "doc_id long, cand int, similarity double, label string, confidence double, target string")
    assert {r["doc_id"]: r["cand"] for r in choice.chosen(df, "doc_id").collect()} == {1: 2, 2: 2}


def test_variation_labels_follow_their_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "positive" if i % 2 else "negative") for i in range(40)], "doc_id long, text string, label1 string")
    made = generate.synthesis(docs, 20, copies=3).collect()
    assert len(made) == 60
    assert all(r["label1"] == ("positive" if r["doc_id"] % 2 else "negative") for r in made)
    assert all(r["text"].startswith("Keep positive" if r["doc_id"] % 2 else "Keep negative") for r in made)


def test_models(spark):
    df = spark.createDataFrame([("a b", 3), ("", 1)], "prompt string, max_tokens int")
    assert [r["generation"] for r in generated(df).collect()] == ["a b", ""]
    rows = embedded(spark.createDataFrame([("a b",), (None,)], "text string"), 8).collect()
    assert np.linalg.norm(rows[0]["vector"]) == pytest.approx(1) and not any(rows[1]["vector"])


def test_logit_bias():
    assert logit_bias([[1, 2], [3]], [[3], [4, 5], [6]]) == {1: 7, 2: 7, 3: -100, 6: -100}


def test_average_row(spark):
    runs = spark.createDataFrame([(0, 0.5), (1, 0.25)], "run int, fid double")
    assert {r["run"]: r["fid"] for r in evaluate.averaged(runs).collect()} == {"0": 0.5, "1": 0.25, "avg": 0.375}
