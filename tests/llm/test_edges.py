"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.decontaminate import contaminated
from tessera.llm.fingerprint import edit_probes, fingerprints
from tessera.llm.html_text import extract
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.line_quality import line_quality
from tessera.llm.near_dup import near_duplicates
from tessera.llm.piece_codec import piece_codec
from tessera.llm.queries import fold
from tessera.llm.secret_scan import secret_spans, span_digests
from tessera.llm.suffix_tree import suffix_tree_scores
from tessera.llm.toxicity import toxicity

SHARED = "A line that several documents have in common"
TEXTS = [
    (None, "A text without an id, and a few more words in it."),
    (1, None),
    (2, ""),
    (3, " \t\n \x0b\r "),
    (4, "one"),
    (5, "two words"),
    (5, "two words"),
    (6, f"{SHARED}\nits own line\n{SHARED.upper()} "),
    (7, f"first\n  {SHARED}"),
    (8, SHARED),
    (9, "é日本😀 ﬁ ​\x00 ▁▁ ÄÖ " * 50),
    (10, "word " * 60_000),
    (11, "x" * 200_000),
    (12, "\n" * 5_000),
    (-13, "a negative id"),
]
CLASHING = "score held_out predicted key n component words place seed id component_id h f drops kept shard salt row spans range guest gone found lang source n_chars item_id label copies".split()
ITEM = "the quick brown fox jumps over the lazy dog and runs away from here at once"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1), (5, 1, 0), (6, 0, 1), (7, 1, 0), (8, 0, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("text", "label", "score", "held_out")})


MODEL = public_tokenizers.path("piece_bpe_32k.model")
BY_ROW = {
    "suffix_tree": lambda d, _: suffix_tree_scores(d, fold(7, 2)),
    "near_duplicates": lambda d, _: near_duplicates(d),
    "dedup_lines": lambda d, _: dedup_lines(d),
    "dedup_lines_carry": lambda d, _: dedup_lines(d, carry=True),
    "secrets": lambda d, _: span_digests(secret_spans(d)),
    "codec": lambda d, _: piece_codec(d, MODEL),
    "quality": lambda d, labels: line_quality(d, labels, fold(5, 0)),
    "quality_carry": lambda d, labels: line_quality(d, labels, fold(5, 0), carry=True),
    "fingerprints": lambda d, _: fingerprints(d),
    "edit_probes": lambda d, _: edit_probes(d),
    "toxicity": lambda d, labels: toxicity(d, labels, fold(4, 2)),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_one_row_for_each(docs, labels, name):
    rows = BY_ROW[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    for r in rows:
        if "score" in r.asDict() and name != "suffix_tree":
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_table(docs, labels, name):
    assert BY_ROW[name](docs.limit(0), labels).collect() == []
    assert BY_ROW[name](docs.where("doc_id > 100"), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_without_labels_all_rows_score_alike(docs, labels, name):
    rows = BY_ROW[name](docs, labels.limit(0)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)


def test_contaminated(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short"), (None, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit(7))
    assert contaminated(docs, bench).collect() == []
    more = docs.unionByName(frame(docs.sparkSession, [(20, f"before {ITEM.upper()} after"), (20, ITEM), (21, "word " * 30_000 + ITEM), (None, ITEM)]))
    for limit in (0, 1000):
        found = {(r["doc_id"], r["item_id"]) for r in contaminated(more, bench, broadcast_seeds=limit).collect()}
        assert found == {(d, i) for d in (20, 21, None) for i in (1, None)}
    assert contaminated(docs, bench.limit(0)).collect() == [] and contaminated(docs.limit(0), bench).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "http://a.b/x", "<p>Text &amp; more</p>"), (3, "http://a.b/x", "<p>Text &amp; more</p>"), (None, "no url", "plain"), (4, "HTTP://A.B", "<div>" * 3000 + "deep" + "</div>" * 9), (5, "http://c.d", "<p>" + "long " * 100_000 + "</p>"), (6, "http://c.d", "<script>var a = '<p>no</p>'"), (7, "http://c.d", "<a href='x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("y") for c in ("host", "text", "roles", "salt", "wrapper", "n_chars")})
    for limit in (0, 1 << 20):
        got = extract(pages, broadcast_bytes=limit).collect()
        assert len(got) == len(rows)
        texts = {r["page_id"]: r["text"] for r in got}
        assert texts == {1: "", 2: "", 3: "Text & more", None: "plain", 4: "deep", 5: ("long " * 100_000).strip(), 6: "", 7: ""}
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(pages.limit(0)).collect() == []


def test_stages(spark, docs, labels, tmp_path):
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for source in (docs, docs.limit(0)):
        now, before = source, source.count()
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns
            after = now.count()
            assert after <= before
            before = after


def test_what_edges_give(docs, labels):
    near = {(r["doc_id"]): r for r in near_duplicates(docs).collect()}
    assert near[1]["n_shingles"] == near[2]["n_shingles"] == near[3]["n_shingles"] == 0 and near[1]["kept"] and near[2]["kept"]
    assert near[4]["n_shingles"] == near[5]["n_shingles"] == 1 and near[5]["kept"]
    lines = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert (lines[1]["n_lines"], lines[2]["n_lines"], lines[3]["n_lines"], lines[12]["n_lines"]) == (1, 1, 2, 5001)
    assert lines[6]["kept"] == "its own line" and lines[7]["kept"] == "first" and lines[8]["kept"] == SHARED
    scores = {r["doc_id"]: r for r in suffix_tree_scores(docs, fold(7, 2)).collect()}
    assert scores[1]["n_tokens"] == scores[2]["n_tokens"] == scores[3]["n_tokens"] == 1
    assert scores[1]["score"] == scores[2]["score"]
    codes = {r["doc_id"]: r for r in piece_codec(docs, MODEL).collect()}
    assert codes[1]["ids"] == codes[2]["ids"] == [1, 2] and codes[1]["decoded"] == ""
    prints = fingerprints(docs).collect()
    assert len({r["fingerprint"] for r in prints if r["doc_id"] in (1, 2)}) == 1
