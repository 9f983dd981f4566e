"""The library's queries by name; each takes the session and the folder of the tables.

Private rows are those with an even id, generated ones those with an odd id. Models are stand-ins
that work by hash, so that every result can be checked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import models, oracle
from tessera.functions import redact, text
from tessera.functions.vectors import unit
from tessera.operators import choice, divergence, likelihood, moments, neighbours, ngrams, ranking, sampling, votes
from tessera.operators.ranking import ranked
from tessera.plans import evaluate, generate, refine
from tessera.session import private, samples, synthetic, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# --- data preparation


@_query
def class_counts(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("label1").agg(F.count("*").alias("n"))


@_query
def class_index(spark, sf_dir):
    """Positions of each class in lists of a thousand, so that no list grows with the class."""
    ranks = ranked(samples(spark, sf_dir).select("label1", "doc_id"), "label1", "doc_id")
    first = ranks.groupBy("label1").agg(F.min("pos").alias("first"))
    rows = ranks.join(F.broadcast(first), "label1").withColumn("part", F.expr("(pos - first) div 1000"))
    return rows.groupBy("label1", "part").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("doc_ids"))


@_query
def fixed_sample(spark, sf_dir):
    return sampling.fixed_sample(_docs(spark, sf_dir).select("doc_id"), 100)


@_query
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(samples(spark, sf_dir).select("doc_id", "label1"), "label1", 200)


@_query
def balanced_class_sample(spark, sf_dir):
    return sampling.balanced_sample(samples(spark, sf_dir).select("doc_id", "label1"), "label1", 20)


@_query
def one_class_subsample(spark, sf_dir):
    """Rows of one class by both labels, then a sample of them."""
    rows = samples(spark, sf_dir).where("label1 = 'positive' and label2 = 'plain'").select("doc_id", "label1", "label2")
    return sampling.fixed_sample(rows, 50)


@_query
def quota_by_class(spark, sf_dir):
    return sampling.quotas(samples(spark, sf_dir), "label1", 1000)


@_query
def eval_subsample(spark, sf_dir):
    """A sample of each side for each of three runs."""
    docs = _docs(spark, sf_dir).select("doc_id")
    parts = [sampling.fixed_sample(half(docs), 80, run).select(F.lit(run).alias("run"), F.lit(name).alias("side"), "doc_id") for run in range(3) for name, half in (("private", private), ("synthetic", synthetic))]
    return reduce(DataFrame.union, parts)


@_query
def validation_split(spark, sf_dir):
    train, held = sampling.validation_split(_docs(spark, sf_dir).select("doc_id"), 5)
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("validation")))


@_query
def target_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).alias("n_words"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("n_split"), text.target_words(F.col("text")).alias("target"))


@_query
def label_codec(spark, sf_dir):
    coded = samples(spark, sf_dir).select("doc_id", text.composite_label(F.lit("sd"), F.col("label1"), text.target_words(F.col("text"))).alias("composite"))
    return coded.select("doc_id", "composite", text.label_field(F.col("composite")).alias("sentiment"))


@_query
def token_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 100")


@_query
def prefix_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(~F.col("text").startswith("Business Category: ")).select("doc_id", F.length("text").alias("size"))


@_query
def whitespace_normalise(spark, sf_dir):
    """Texts as the sink writes them: white space as single spaces, empty ones dropped."""
    return _docs(spark, sf_dir).select("doc_id", text.normalised(F.col("text")).alias("text")).where("text <> ''")


@_query
def lm_encoding(spark, sf_dir):
    ids = F.transform(text.words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % 30_000)
    full, labels = text.encoded(ids, 512)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(full, " ").alias("input_ids"), F.array_join(labels, " ").alias("labels"))


@_query
def seed_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.truncated(F.col("text")).alias("seed"))


# --- generation


@_query
def length_budget(spark, sf_dir):
    return generate.length_budget(_docs(spark, sf_dir))


@_query
def token_mask_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.masked(F.col("text"), F.col("doc_id"), 0.25).alias("masked"))


@_query
def keyword_lookup(spark, sf_dir):
    """A keyword by hash from a list: names of nations."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("number"), F.col("n_name").alias("keyword"))
    rows = samples(spark, sf_dir).select("doc_id", "label1", F.floor(text.hash_uniform(F.lit("keyword"), F.col("doc_id")) * 25).alias("number"))
    return rows.join(names, "number").select("doc_id", "label1", "keyword")


@_query
def style_lookup(spark, sf_dir):
    """A style by hash and the prompt of each of two kinds of variation."""
    styles = F.array(*map(F.lit, ("plainly", "formally", "briefly", "warmly")))
    rows = _docs(spark, sf_dir).select("doc_id", F.get(styles, F.floor(text.hash_uniform(F.lit("style"), F.col("doc_id")) * 4).cast("int")).alias("style"), F.explode(F.array(F.lit("rephrase"), F.lit("fill"))).alias("kind"))
    return rows.select("doc_id", "kind", "style", F.when(F.col("kind") == "rephrase", F.concat(F.lit("Rewrite this "), "style", F.lit(":"))).otherwise(F.concat(F.lit("Fill in each _ "), "style", F.lit(":"))).alias("prompt"))


@_query
def variants_union(spark, sf_dir):
    return generate.variations(_docs(spark, sf_dir)).select("doc_id", "var_idx", F.md5("text").alias("text_md5"))


@_query
def feature_mean(spark, sf_dir):
    """Mean vectors over five variations of each position."""
    rows = _vectors(spark, sf_dir).select(F.expr("id div 5").alias("position"), F.posexplode("vector").alias("i", "x"))
    return rows.groupBy("position", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def _targets(spark, sf_dir):
    return samples(spark, sf_dir).select("doc_id", F.when(F.col("label1") != "unknown", F.col("label1")).alias("target"))


@_query
def dp_candidate_choice(spark, sf_dir):
    found = choice.chosen(generate.candidates(_targets(spark, sf_dir)), "doc_id")
    return found.select("doc_id", "cand", "label", "target", "score")


@_query
def dp_candidate_choice_noisy(spark, sf_dir):
    """With noise for epsilon = 4 and a hundred rows."""
    found = choice.chosen(generate.candidates(_targets(spark, sf_dir)), "doc_id", choice.sigma(100, 4.0))
    return found.select("doc_id", "cand", "label", "target", "score")


@_query
def two_attempt_choice(spark, sf_dir):
    return generate.abstraction(_targets(spark, sf_dir)).select("doc_id", "attempt", "cand", "label", "target", "score")


@_query
def preservation_rate(spark, sf_dir):
    held = F.col("target").isNull() | ((F.col("agree") == 1) & (F.col("confidence") >= choice.MIN_CONFIDENCE))
    return generate.abstraction(_targets(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.avg(held.cast("double")), 6).alias("rate"))


@_query
def sentiment_guard(spark, sf_dir):
    """The best of four attempts."""
    rows = generate.candidates(_targets(spark, sf_dir).fillna("positive", ["target"]), 4)
    return generate.guarded(rows).select("doc_id", "cand", "label", "confidence", "target")


@_query
def nonempty_fallback(spark, sf_dir):
    made = F.when(text.hash_uniform(F.lit("empty"), F.col("doc_id")) < 0.2, " ").otherwise(F.concat(F.lit("# "), "text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.nonempty(made, F.col("text"))).alias("text_md5"))


@_query
def think_strip(spark, sf_dir):
    made = F.concat(F.lit("<think>one\ntwo</think>\n \""), "text", F.lit("\"\nThis rewrite keeps the meaning."))
    return _docs(spark, sf_dir).select("doc_id", text.without_thinking(made).alias("text"))


@_query
def punctuation_collapse(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.collapsed_marks(F.replace("text", F.lit(" "), F.lit("!?"))).alias("text"))


@_query
def chat_messages(spark, sf_dir):
    """The turns of a chat that asks for another wording of each text."""
    turns = models.messages("You rewrite texts.", F.concat(F.lit("Rewrite: "), "text"))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(turns).alias("turn", "m"))
    return rows.select("doc_id", "turn", "m.role", F.md5("m.content").alias("content_md5"))


@_query
def chat_single(spark, sf_dir):
    """The same for models that take one message only."""
    turns = models.single_message("You rewrite texts.", F.concat(F.lit("Rewrite: "), "text"))
    return _docs(spark, sf_dir).select("doc_id", F.explode(turns).alias("m")).select("doc_id", "m.role", F.md5("m.content").alias("content_md5"))


@_query
def positional_select(spark, sf_dir):
    """Every tenth row by place in the order of ids."""
    docs = _docs(spark, sf_dir)
    return ranking.at_positions(docs.select("doc_id"), docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("pos")), "doc_id")


@_query
def head_rows(spark, sf_dir):
    """At most 100 rows, the first ones by id."""
    return _docs(spark, sf_dir).select("doc_id").orderBy("doc_id").limit(100)


@_query
def label_vocabulary(spark, sf_dir):
    return samples(spark, sf_dir).select("label1").distinct()


@_query
def char_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.first_characters(F.col("text")).alias("text"))


@_query
def redact_spans_full(spark, sf_dir):
    """A span of five characters as a model might find it, then all patterns."""
    spans = F.array(F.struct(F.lit(0).alias("start"), F.least(F.length("text"), F.lit(5)).alias("end"), F.lit("per").alias("label")))
    return _docs(spark, sf_dir).where("text <> ''").select("doc_id", redact.fully_redacted(F.col("text"), spans).alias("text"))


@_query
def word_count_rows(spark, sf_dir):
    """Words asked for, words made and the difference, for each text."""
    rows = generate.length_budget(_docs(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).cast("long").alias("gen")), "doc_id")
    return rows.select("doc_id", "target", "gen", (F.col("gen") - F.col("target")).alias("diff"))


@_query
def knn_radius_clamped(spark, sf_dir):
    return neighbours.radii(private(_vectors(spark, sf_dir), "id"), clamp=0.9).select("id", F.round("radius", 6).alias("radius"))


@_query
def generate_echo(spark, sf_dir):
    """Generation end to end with the model that repeats its prompt."""
    return generate.synthesis(samples(spark, sf_dir), 100)


@_query
def word_count_log(spark, sf_dir):
    """Words asked for and words made, and the spread of the difference."""
    rows = generate.length_budget(_docs(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).alias("made")), "doc_id")
    diff = F.col("made") - F.col("target")
    return rows.agg(F.round(F.avg(F.abs(diff)), 6).alias("mean_abs"), F.round(F.stddev_pop(F.abs(diff)), 6).alias("std_abs"), F.round(F.avg(diff), 6).alias("mean_diff"), F.round(F.stddev_pop(diff), 6).alias("std_diff"))


# --- refinement


@_query
def word_chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.word_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", text.token_count(F.col("chunk")).alias("n_words"), F.md5("chunk").alias("chunk_md5"))


@_query
def char_chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.char_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("size"), F.md5("chunk").alias("chunk_md5"))


@_query
def fixed_chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.fixed_chunks(text.words(F.col("text")))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.size("chunk").alias("n_words"), F.md5(F.array_join("chunk", " ")).alias("chunk_md5"))


@_query
def redact_email_phone(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", redact.replaced(F.col("text"), redact.PATTERNS[:2]).alias("text"))


@_query
def redact_full(spark, sf_dir):
    return refine.redacted_texts(_docs(spark, sf_dir))


@_query
def pii_doc_hits(spark, sf_dir):
    """Texts of which any chunk of words holds personal data."""
    hit = F.exists(F.coalesce(text.word_chunks(F.col("text")), F.array().cast("array<string>")), redact.has_personal_data)
    hit = F.when(redact.may_have_personal_data(F.col("text")), hit).otherwise(False)
    return _docs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(hit).alias("successful_extractions"))


@_query
def unigram_nll(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return likelihood.mean_nll(private(docs), likelihood.unigram_counts(synthetic(docs)))


def _bins(spark, sf_dir):
    return likelihood.equal_depth_bins(unigram_nll(spark, sf_dir), "nll", "doc_id")


@_query
def nll_bins(spark, sf_dir):
    return _bins(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"), F.min("nll").alias("lo"), F.max("nll").alias("hi"))


@_query
def nll_representatives(spark, sf_dir):
    return likelihood.representatives(_bins(spark, sf_dir), "nll").select("bin", "doc_id", "nll")


@_query
def max_abs_diff(spark, sf_dir):
    """The greatest distance in likelihood from each generated text to any private representative."""
    docs = _docs(spark, sf_dir)
    counts = likelihood.unigram_counts(synthetic(docs))
    bins = likelihood.equal_depth_bins(likelihood.mean_nll(private(docs), counts), "nll", "doc_id")
    return refine.farthest_likelihood(likelihood.mean_nll(synthetic(docs), counts), likelihood.representatives(bins, "nll")).select("doc_id", "score")


@_query
def refinement_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return refine.refinement_filter(private(docs), synthetic(docs))


@_query
def max_similarity_order(spark, sf_dir):
    """Generated vectors by rising similarity to their nearest private one."""
    v = _vectors(spark, sf_dir)
    best = neighbours.nearest(synthetic(v, "id"), private(v, "id")).select("id", F.round("score", 6).alias("similarity"))
    return ranked(best, "similarity", "id")


# --- evaluation


@_query
def knn_cosine_top1(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return neighbours.nearest(synthetic(v, "id"), private(v, "id")).select("id", "neighbour", F.round("score", 6).alias("score"))


@_query
def knn_l2_top3(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return neighbours.nearest(private(v, "id"), synthetic(v, "id"), 3, "l2").select("id", "rank", "neighbour", F.round("score", 6).alias("score"))


@_query
def knn_precision_recall(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = neighbours.precision_recall_at(private(v, "id"), synthetic(v, "id"), (0.07, 0.6))
    return found.select("threshold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_query
def knn_radius(spark, sf_dir):
    return neighbours.radii(private(_vectors(spark, sf_dir), "id")).select("id", F.round("radius", 6).alias("radius"))


@_query
def manifold_precision_recall(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    p, q = private(v, "id"), synthetic(v, "id")
    share = lambda rows, refs, name: neighbours.covered(rows, refs.join(neighbours.radii(refs), "id")).agg(F.round(F.avg(F.col("inside").cast("double")), 6).alias(name))
    return share(q, p, "precision").join(share(p, q, "recall"))


@_query
def manifold_realism(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    refs = private(v, "id")
    return neighbours.covered(synthetic(v, "id"), refs.join(neighbours.radii(refs), "id")).select("id", "inside", F.round("realism", 4).alias("realism"))


def _histogram_votes(spark, sf_dir):
    """Each private vector votes for its nearest generated one."""
    v = _vectors(spark, sf_dir)
    public = ranked(synthetic(v, "id").select("id", "vector"), "id").withColumn("pos", F.col("pos") - 1)
    return neighbours.votes(public, private(v, "id"))


@_query
def dp_hist_clean(spark, sf_dir):
    return _histogram_votes(spark, sf_dir)


@_query
def dp_hist_noisy(spark, sf_dir):
    noisy = F.col("votes") + text.hash_gaussian(42, F.col("slot")) * F.lit(1.5)
    return _histogram_votes(spark, sf_dir).select("slot", F.round(F.greatest(noisy, F.lit(0.5)) - 0.5, 6).alias("votes"))


def _histogram(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return divergence.histogram(private(v, "id"), synthetic(v, "id"), 10)


@_query
def cluster_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir).select("bin", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@_query
def kl_tv_w1(spark, sf_dir):
    return _rounded(divergence.kl_tv_w1(_histogram(spark, sf_dir)), "kl", "tv", "wass")


@_query
def divergence_curve(spark, sf_dir):
    return _rounded(divergence.divergence_curve(_histogram(spark, sf_dir)), "x", "y")


@_query
def mauve_from_bins(spark, sf_dir):
    return _rounded(divergence.mauve(divergence.divergence_curve(_histogram(spark, sf_dir))), "mauve")


@_query
def frontier_integral(spark, sf_dir):
    return _rounded(divergence.frontier_integral(_histogram(spark, sf_dir)), "frontier")


@_query
def fid_moments(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(moments.moments(evaluate.sides(private(v, "id"), synthetic(v, "id")).select("side", "vector")), "mean_i", "cov")


@_query
def fid_score(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return spark.createDataFrame([(evaluate.frechet_distance(private(v, "id"), synthetic(v, "id")),)], "fid double")


@_query
def pca_dims(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(unit(F.col("vector")).alias("vector"))
    return spark.createDataFrame([(evaluate.principal_axes(v),)], "axes int")


@_query
def mauve_kmeans(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "vector")
    groups, buckets = evaluate.clustered(private(v, "id"), synthetic(v, "id"))
    return divergence.mauve(divergence.divergence_curve(divergence.histogram(groups.where("side = 'p'"), groups.where("side = 'q'"), buckets)))


@_query
def sinkhorn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return spark.createDataFrame([(evaluate.sampled_sinkhorn(private(v, "id"), synthetic(v, "id")),)], "sinkhorn_loss double")


@_query
def metric_average(spark, sf_dir):
    """Sizes of samples in five runs, and their average row."""
    docs = _docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).alias("n"))
    runs = [sampling.fixed_sample(docs, 100, run).agg(F.bround(F.avg("n"), 4).alias("mean_words"), F.bround(F.stddev_pop("n"), 4).alias("std_words")).select(F.lit(run).alias("run"), "*") for run in range(5)]
    return evaluate.averaged(reduce(DataFrame.union, runs))


@_query
def bigram_diversity(spark, sf_dir):
    return _rounded(ngrams.ngram_diversity(_docs(spark, sf_dir)), "diversity")


@_query
def self_bleu(spark, sf_dir):
    scores = ngrams.self_bleu(synthetic(_docs(spark, sf_dir)))
    return scores.agg(F.sum("copies").alias("n_texts"), F.round(F.sum(F.col("copies") * F.col("bleu")) / F.sum("copies"), 6).alias("self_bleu"))


@_query
def sentiment_vote(spark, sf_dir):
    return votes.majority(votes.chunk_labels(_docs(spark, sf_dir)))


@_query
def sentiment_confidence(spark, sf_dir):
    return votes.confident(votes.chunk_labels(_docs(spark, sf_dir)))


@_query
def sentiment_match_rate(spark, sf_dir):
    """Private and generated rows side by side by place, and how often their labels agree."""
    labels = votes.majority(votes.chunk_labels(_docs(spark, sf_dir)))
    return votes.match_rate(votes.paired(private(labels), synthetic(labels)), "a_label", "b_label")


@_query
def label_normalise(spark, sf_dir):
    raw = F.concat(F.lit(" label_"), F.col("quality") + F.col("toxic"))
    rows = table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw"), F.col("quality").cast("string").alias("bit"))
    return rows.select("doc_id", text.sentiment_name(F.col("raw")).alias("name"), text.binary_sentiment(F.col("raw")).alias("sentiment"), text.sentiment_bit(F.col("bit")).alias("bit"), text.tone_prefix(text.sentiment_bit(F.col("bit"))).alias("prefix"))


@_query
def unknown_labels(spark, sf_dir):
    return samples(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("label1") == "unknown").alias("unknown"))


@_query
def perplexity(spark, sf_dir):
    """exp of the mean loss of a word over private texts."""
    rows = unigram_nll(spark, sf_dir)
    return rows.agg(F.sum("n_words").alias("n_words"), F.round(F.exp(F.sum(F.col("nll") * F.col("n_words")) / F.sum("n_words")), 4).alias("perplexity"))


@_query
def next_token_accuracy(spark, sf_dir):
    """Private words foretold by the most common next word in generated texts."""

    def pairs(docs):
        two = text.bound(text.words(F.col("text")), lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("word"), b.alias("next"))))
        return docs.select(F.explode(two).alias("t")).select("t.*").where("next is not null").groupBy("word", "next").agg(F.count("*").alias("n"))

    docs = _docs(spark, sf_dir)
    model = pairs(synthetic(docs)).groupBy("word").agg(F.max(F.struct("n", "next")).alias("best")).select("word", F.col("best.next").alias("foretold"))
    found = pairs(private(docs)).join(model, "word", "left")
    return found.agg(F.sum("n").alias("n_tokens"), F.round(F.sum(F.when(F.col("next") == F.col("foretold"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))


SQL: dict[str, str] = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
