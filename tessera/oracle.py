"""DuckDB SQL for the library's queries, over the tables by name."""

from __future__ import annotations

from tessera.functions.redact import CURRENCY, DETECTORS, PATTERNS


def _w(t: str = "text") -> str:
    return f"regexp_extract_all(coalesce({t}, ''), '[^\\x20\\x09-\\x0D]+')"


def _u(*parts: str) -> str:
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def _gauss(seed: int, key: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_u(f"'{seed}'", key, "'u'")}, 1e-12))) * cos(2 * pi() * {_u(f"'{seed}'", key, "'v'")}))"


def _order(seed: int, key: str = "doc_id") -> str:
    return f"md5('{seed}|' || {key}), {key}"


def _replaced(t: str, rules) -> str:
    for pattern, new in rules:
        t = f"regexp_replace({t}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return t


_SAMPLES = """samples AS (
  SELECT d.doc_id, d.text, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END AS label1,
    CASE l.toxic WHEN 1 THEN 'toxic' WHEN 0 THEN 'plain' ELSE 'unknown' END AS label2
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_TARGET = f"greatest(1, round_even(len({_w()}) * 0.8, 0))::BIGINT"
_QUOTAS = f"{_SAMPLES}, quotas AS (SELECT label1, count(*) AS n, round_even({{size}} * count(*) / (SELECT count(*) FROM samples), 0)::BIGINT AS quota FROM samples GROUP BY label1)"
_BUDGET = f"""budget AS (
  SELECT doc_id, text, greatest(len(string_split(coalesce(text, ''), ' ')) + trunc({_gauss(42, 'doc_id')} * 2.5), 25)::BIGINT AS target FROM documents)"""


def _candidates(attempt: int, source: str, number: int = 5) -> str:
    u = lambda what: f"round({_u(f"'{what}{attempt}'", 'doc_id', 'cand')}, 6)"
    return f"""SELECT doc_id, target, cand, {u('similarity')} AS similarity, CASE WHEN {u('label')} < 0.5 THEN 'negative' ELSE 'positive' END AS label,
      (500000 + floor({_u(f"'confidence{attempt}'", 'doc_id', 'cand')} * 500000)) / 1000000::DOUBLE AS confidence FROM {source}, range(1, {number + 1}) r(cand)"""


def _chosen(attempt: int, noise: float = 0.0) -> str:
    rank = "score" if not noise else f"CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + {noise!r} * {_gauss(42, "doc_id || '|' || cand")}"
    return f"""(WITH rated AS (
      SELECT *, CASE WHEN target IS NULL THEN 0.5 WHEN label = target THEN 1.0 ELSE 0.0 END AS agree FROM ({_candidates(attempt, 'targets')})
    ), scored AS (
      SELECT *, round(0.75::DOUBLE * similarity + 0.25::DOUBLE * agree - CASE WHEN target IS NULL THEN 0 ELSE 0.15::DOUBLE * (1 - agree) END, 9) AS score, agree = 1 AND confidence >= 0.55 AS valid FROM rated
    ), pool AS (
      SELECT * FROM (SELECT *, bool_or(valid) OVER (PARTITION BY doc_id) AS any_valid FROM scored) WHERE valid OR NOT any_valid
    ), ends AS (SELECT *, min(score) OVER (PARTITION BY doc_id) AS lo, max(score) OVER (PARTITION BY doc_id) AS hi FROM pool)
    SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {rank} DESC, cand) = 1)"""


_TARGETS = f"{_SAMPLES}, targets AS (SELECT doc_id, CASE WHEN label1 <> 'unknown' THEN label1 END AS target FROM samples)"
_ATTEMPTS = f"""{_TARGETS}, one AS {_chosen(1)}, two AS {_chosen(2)}, pairs AS (
  SELECT one.*, two.cand AS b_cand, two.label AS b_label, two.score AS b_score, two.agree AS b_agree, two.confidence AS b_confidence,
    one.target IS NOT NULL AND NOT (one.agree = 1 AND one.confidence >= 0.55)
      AND ((two.agree = 1 AND two.confidence >= one.confidence) OR two.similarity > one.similarity) AS take
  FROM one JOIN two USING (doc_id)
), attempts AS (
  SELECT doc_id, CASE WHEN take THEN 2 ELSE 1 END AS attempt, CASE WHEN take THEN b_cand ELSE cand END AS cand, CASE WHEN take THEN b_label ELSE label END AS label,
    target, CASE WHEN take THEN b_score ELSE score END AS score, CASE WHEN take THEN b_agree ELSE agree END AS agree, CASE WHEN take THEN b_confidence ELSE confidence END AS confidence FROM pairs)"""


def _masked(key: str, share: float) -> str:
    return f"array_to_string(list_transform(list_zip({_w()}, range(len({_w()}))), lambda x: CASE WHEN {_u("'42'", key, 'x[2]')} < {share} THEN '_' ELSE x[1] END), ' ')"


_CHUNKS = """chunks AS (
  SELECT doc_id, k AS chunk_no, substr(text, k * 400 + 1, 512) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 512 THEN 1 ELSE 1 + ceil((length(text) - 512) / 400)::BIGINT END)) AS k FROM documents WHERE length(text) > 0))"""
_LABELS = f"""{_CHUNKS}, labelled AS (
  SELECT doc_id, chunk_no, CASE WHEN u < 0.45 THEN 'NEGATIVE' WHEN u < 0.9 THEN 'POSITIVE' WHEN u < 0.97 THEN 'NEUTRAL' ELSE 'ERROR' END AS label, score
  FROM (SELECT *, {_u("'label'", 'chunk')} AS u, (500000 + floor({_u("'score'", 'chunk')} * 500000)) / 1000000::DOUBLE AS score FROM chunks))"""
_MAJORITY = f"""{_LABELS}, tally AS (SELECT doc_id, label, count(*) AS n FROM labelled WHERE label <> 'ERROR' GROUP BY ALL
), ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC) AS second FROM tally
), final AS (SELECT doc_id, arg_max(label, chunk_no) FILTER (label <> 'ERROR') AS label FROM labelled GROUP BY doc_id
), majority AS (
  SELECT f.doc_id, coalesce(CASE WHEN r.n = r.second THEN f.label ELSE r.label END, 'ERROR') AS label
  FROM final f LEFT JOIN ranks r ON r.doc_id = f.doc_id AND r.r = 1)"""

_COUNTS = f"counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({_w()}) AS word FROM documents WHERE doc_id % 2 = 1) GROUP BY word), total AS (SELECT sum(n) AS total, count(*) AS kinds FROM counts)"


def _nll(side: int) -> str:
    return f"""(SELECT doc_id, sum(times)::BIGINT AS n_words, round(sum(times * -ln((coalesce(n, 0) + 1) / (total + kinds))) / sum(times), 6) AS nll
      FROM (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest({_w()}) AS word FROM documents WHERE doc_id % 2 = {side}) GROUP BY ALL)
      LEFT JOIN counts USING (word), total GROUP BY doc_id)"""


_BINS = f"""{_COUNTS}, nll AS {_nll(0)}, placed AS (SELECT *, row_number() OVER (ORDER BY nll, doc_id) AS pos, count(*) OVER () AS n FROM nll
), binned AS (SELECT *, least((pos - 1) // (n // least(250, n)), least(250, n) - 1) AS bin FROM placed
), means AS (SELECT *, avg(nll) OVER (PARTITION BY bin) AS mean FROM binned
), reps AS (SELECT bin, doc_id, nll FROM means QUALIFY row_number() OVER (PARTITION BY bin ORDER BY round(abs(nll - mean), 9), pos) = 1)"""
_SCORES = f"""{_BINS}, scores AS (
  SELECT doc_id, nll, round(greatest(abs(nll - lo), abs(nll - hi)), 6) AS score FROM {_nll(1)}, (SELECT min(nll) AS lo, max(nll) AS hi FROM reps))"""

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings), p AS (SELECT * FROM v WHERE id % 2 = 0), q AS (SELECT * FROM v WHERE id % 2 = 1)"
_COS = "round(list_cosine_similarity(a.vector, b.vector), 9)"
_DIST2 = "round(list_distance(a.vector, b.vector) * list_distance(a.vector, b.vector), 9)"


def _top(a: str, b: str, k: int, mode: str) -> str:
    score = {"cosine": _COS, "l2": f"-{_DIST2}"}[mode]
    return f"""(SELECT id, rank, neighbour, score FROM (SELECT a.id, b.id AS neighbour, {score} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {score} DESC, b.id) AS rank
      FROM {a} a, {b} b) WHERE rank <= {k})"""


def _radii(side: str) -> str:
    return f"(SELECT id, round(sqrt(-score), 9) AS radius FROM {_top(side, side, 4, 'l2')} WHERE rank = 4)"


def _inside(rows: str, refs: str) -> str:
    apart = "round(list_distance(a.vector, b.vector), 9)"
    return f"(SELECT a.id, bool_or({apart} <= r.radius) AS inside, max(r.radius / ({apart} + 1e-5)) AS realism FROM {rows} a, {refs} b JOIN {_radii(refs)} r ON r.id = b.id GROUP BY a.id)"


_HIST = f"""{_V}, hist AS (
  SELECT bin, coalesce(np, 0) / (SELECT count(*) FROM p) AS p, coalesce(nq, 0) / (SELECT count(*) FROM q) AS q FROM range(10) b(bin)
  LEFT JOIN (SELECT label AS bin, count(*) AS np FROM p GROUP BY label) USING (bin) LEFT JOIN (SELECT label AS bin, count(*) AS nq FROM q GROUP BY label) USING (bin))"""
_CURVE = f"""{_HIST}, mixed AS (
  SELECT step, p, q, w * p + (1 - w) * q AS r FROM hist, (SELECT k + 1 AS step, 1e-6::DOUBLE + k * ((1 - 2e-6::DOUBLE) / 24) AS w FROM range(25) t(k))
), curve AS (
  SELECT step, exp(-5 * sum(CASE WHEN q <> 0 THEN q * ln(q / r) ELSE 0 END)) AS x, exp(-5 * sum(CASE WHEN p <> 0 THEN p * ln(p / r) ELSE 0 END)) AS y FROM mixed GROUP BY step
  UNION ALL SELECT 0, 1.0, 0.0 UNION ALL SELECT 26, 0.0, 1.0)"""


def _words_chunked(size: int, step: int, table: str) -> str:
    return f"""{table} AS (
  SELECT doc_id, chunk_no, w[chunk_no * {step} + 1 : chunk_no * {step} + {size}] AS chunk
  FROM (SELECT doc_id, w, unnest(range(0, ((len(w) + {step - 1}) // {step})::BIGINT)) AS chunk_no FROM (SELECT doc_id, {_w()} AS w FROM documents) WHERE len(w) > 0))"""


_GRAMS = f"""texts AS (SELECT text, count(*) AS copies, any_value({_w()}) AS w FROM documents WHERE doc_id % 2 = 1 GROUP BY text
), sized AS (SELECT *, len(w) AS size, row_number() OVER () AS t FROM texts
), grams AS (SELECT t, k AS n, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS gram FROM sized, range(1, 5) r(k)
), counts AS (SELECT t, n, gram, count(*) AS c FROM grams GROUP BY ALL
), ranks AS (SELECT *, row_number() OVER (PARTITION BY n, gram ORDER BY c DESC, t) AS r FROM counts
), tops AS (SELECT n, gram, max(c) FILTER (r = 1) AS most, max(t) FILTER (r = 1) AS owner, coalesce(max(c) FILTER (r = 2), 0) AS next FROM ranks GROUP BY ALL
), found AS (SELECT t, n, sum(least(c, CASE WHEN t = owner THEN next ELSE most END)) AS m FROM counts JOIN tops USING (n, gram) GROUP BY ALL
), near AS (
  SELECT a.size, arg_min(b.size, abs(a.size - b.size) * 1000000 + b.size) AS closest FROM (SELECT DISTINCT size FROM sized) a,
    (SELECT size, count(*) AS k FROM sized GROUP BY size) b WHERE a.size <> b.size OR b.k > 1 GROUP BY a.size
), bleu AS (
  SELECT s.t, any_value(copies) AS copies, CASE WHEN coalesce(max(m) FILTER (k = 1), 0) = 0 THEN 0 ELSE
    CASE WHEN any_value(s.size) > any_value(closest) THEN 1 ELSE exp(1 - any_value(closest) / any_value(s.size)) END
    * exp(sum(ln(CASE WHEN coalesce(m, 0) = 0 THEN 0.1 ELSE m END / greatest(1, s.size - k + 1))) / 4) END AS bleu
  FROM sized s CROSS JOIN range(1, 5) r(k) LEFT JOIN found f ON f.t = s.t AND f.n = k JOIN near ON near.size = s.size GROUP BY s.t)"""


def _pairs(side: int) -> str:
    return f"(SELECT w[i] AS word, w[i + 1] AS next, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_w()} AS w FROM documents WHERE doc_id % 2 = {side})) GROUP BY ALL)"


def _sample(source: str, size: int, seed: int, columns: str = "doc_id") -> str:
    return f"SELECT {columns} FROM {source} ORDER BY {_order(seed)} LIMIT {size}"


_STYLE = f"(['plainly', 'formally', 'briefly', 'warmly'])[floor({_u("'style'", 'doc_id')} * 4)::INT + 1]"

SQL: dict[str, str] = {
    "class_counts": f"WITH {_SAMPLES} SELECT label1, count(*) AS n FROM samples GROUP BY label1",
    "class_index": f"WITH {_SAMPLES} SELECT label1, part, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM (SELECT *, (row_number() OVER (PARTITION BY label1 ORDER BY doc_id) - 1) // 1000 AS part FROM samples) GROUP BY label1, part",
    "fixed_sample": _sample("documents", 100, 123),
    "stratified_sample": f"WITH {_QUOTAS.format(size=200)} SELECT doc_id, label1 FROM (SELECT *, row_number() OVER (PARTITION BY label1 ORDER BY {_order(123)}) AS r FROM samples) JOIN quotas USING (label1) WHERE r <= quota",
    "balanced_class_sample": f"WITH {_SAMPLES} SELECT doc_id, label1 FROM samples QUALIFY row_number() OVER (PARTITION BY label1 ORDER BY {_order(123)}) <= 20",
    "one_class_subsample": f"WITH {_SAMPLES} {_sample("(SELECT * FROM samples WHERE label1 = 'positive' AND label2 = 'plain')", 50, 123, 'doc_id, label1, label2')}",
    "quota_by_class": f"WITH {_QUOTAS.format(size=1000)} SELECT * FROM quotas",
    "eval_subsample": " UNION ALL ".join(f"SELECT * FROM ({_sample(f'(SELECT * FROM documents WHERE doc_id % 2 = {k})', 80, run, f"{run} AS run, '{name}' AS side, doc_id")})" for run in range(3) for k, name in enumerate(("private", "synthetic"))),
    "validation_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_order(42)}) <= ceil(count(*) OVER () * 5 / 100) THEN 'validation' ELSE 'train' END AS part FROM documents",
    "target_words": f"SELECT doc_id, len({_w()}) AS n_words, len(string_split(coalesce(text, ''), ' ')) AS n_split, {_TARGET} AS target FROM documents",
    "label_codec": f"WITH {_SAMPLES} SELECT doc_id, 'sd' || chr(9) || label1 || chr(9) || {_TARGET} AS composite, label1 AS sentiment FROM samples",
    "token_filter": f"SELECT doc_id, len({_w()}) AS n_tokens FROM documents WHERE len({_w()}) > 100",
    "prefix_filter": "SELECT doc_id, length(text)::INT AS size FROM documents WHERE NOT starts_with(text, 'Business Category: ')",
    "whitespace_normalise": f"SELECT doc_id, array_to_string({_w()}, ' ') AS text FROM documents WHERE len({_w()}) > 0",
    "lm_encoding": f"""SELECT doc_id, array_to_string(ids || list_transform(range(512 - len(ids)), lambda x: 0), ' ') AS input_ids, array_to_string(ids || list_transform(range(512 - len(ids)), lambda x: -100), ' ') AS labels
      FROM (SELECT doc_id, list_transform({_w()}[1:512], lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT % 30000) AS ids FROM documents)""",
    "seed_truncate": f"SELECT doc_id, array_to_string({_w()}[1:300], ' ') AS seed FROM documents",
    "length_budget": f"WITH {_BUDGET} SELECT doc_id, target, least(trunc(target * 1.2::DOUBLE)::BIGINT, 1200) AS max_tokens, round_even(target * 0.85::DOUBLE, 0)::BIGINT AS min_words, round_even(target * 1.15::DOUBLE, 0)::BIGINT AS max_words FROM budget",
    "token_mask_hash": f"SELECT doc_id, {_masked('doc_id', 0.25)} AS masked FROM documents",
    "keyword_lookup": f"WITH {_SAMPLES} SELECT doc_id, label1, n_name AS keyword FROM samples JOIN nation ON n_nationkey = floor({_u("'keyword'", 'doc_id')} * 25)",
    "style_lookup": f"SELECT doc_id, kind, {_STYLE} AS style, CASE kind WHEN 'rephrase' THEN 'Rewrite this ' ELSE 'Fill in each _ ' END || {_STYLE} || ':' AS prompt FROM documents, (VALUES ('rephrase'), ('fill')) k(kind)",
    "variants_union": f"SELECT doc_id, v::INT AS var_idx, md5({_masked("doc_id || '/' || v", 0.25)}) AS text_md5 FROM documents, (VALUES (1), (2)) t(v) UNION ALL SELECT doc_id, 0, md5(array_to_string({_w()}, ' ')) FROM documents",
    "feature_mean": "SELECT position, i, round(avg(x), 6) AS mean FROM (SELECT vec_id // 5 AS position, unnest(range(len(embedding))) ::INT AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL",
    "dp_candidate_choice": f"WITH {_TARGETS} SELECT doc_id, cand::INT AS cand, label, target, score FROM {_chosen(1)}",
    "dp_candidate_choice_noisy": f"WITH {_TARGETS} SELECT doc_id, cand::INT AS cand, label, target, score FROM {_chosen(1, 0.8913117694660917)}",
    "two_attempt_choice": f"WITH {_ATTEMPTS} SELECT doc_id, attempt, cand::INT AS cand, label, target, score FROM attempts",
    "preservation_rate": f"WITH {_ATTEMPTS} SELECT count(*) AS n, round(avg(CASE WHEN target IS NULL OR (agree = 1 AND confidence >= 0.55) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM attempts",
    "sentiment_guard": f"""WITH {_SAMPLES}, targets AS (SELECT doc_id, CASE WHEN label1 = 'unknown' THEN 'positive' ELSE label1 END AS target FROM samples)
      SELECT doc_id, cand::INT AS cand, label, confidence, target FROM ({_candidates(1, 'targets', 4)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY label = target DESC, confidence DESC, cand) = 1""",
    "nonempty_fallback": f"SELECT doc_id, md5(CASE WHEN {_u("'empty'", 'doc_id')} < 0.2 THEN text ELSE '# ' || text END) AS text_md5 FROM documents",
    "think_strip": "SELECT doc_id, trim(trim(string_split(chr(10) || ' \"' || text || '\"' || chr(10) || 'This rewrite keeps the meaning.', 'This rewrite')[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\"') AS text FROM documents",
    "punctuation_collapse": "SELECT doc_id, regexp_replace(replace(text, ' ', '!?'), '([.?!,]){2,}', '\\1', 'g') AS text FROM documents",
    "chat_messages": "SELECT doc_id, 0 AS turn, 'system' AS role, md5('You rewrite texts.') AS content_md5 FROM documents UNION ALL SELECT doc_id, 1, 'user', md5('Rewrite: ' || text) FROM documents",
    "chat_single": "SELECT doc_id, 'user' AS role, md5('You rewrite texts.' || chr(10) || chr(10) || 'Rewrite: ' || text) AS content_md5 FROM documents",
    "positional_select": "SELECT pos, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 0)",
    "head_rows": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100",
    "label_vocabulary": f"WITH {_SAMPLES} SELECT DISTINCT label1 FROM samples",
    "char_truncate": "SELECT doc_id, substr(coalesce(text, ''), 1, 1000) AS text FROM documents",
    "redact_spans_full": f"SELECT doc_id, {_replaced("('[PER]' || substr(text, 6))", (*PATTERNS, *CURRENCY))} AS text FROM documents WHERE text <> ''",
    "word_count_rows": f"WITH {_BUDGET} SELECT doc_id, target, len({_w()}) AS gen, len({_w()}) - target AS diff FROM budget",
    "knn_radius_clamped": f"WITH {_V}, r AS (SELECT * FROM {_radii('p')}) SELECT id, round(CASE WHEN radius > (SELECT quantile_cont(radius, 0.9) FROM r) THEN 0 ELSE radius END, 6) AS radius FROM r",
    "word_count_log": f"WITH {_BUDGET}, d AS (SELECT len({_w()}) - target AS d FROM budget) SELECT round(avg(abs(d)), 6) AS mean_abs, round(stddev_pop(abs(d)), 6) AS std_abs, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS std_diff FROM d",
    "word_chunks": f"WITH {_words_chunked(100, 80, 'c')} SELECT doc_id, chunk_no::INT AS chunk_no, len(chunk) AS n_words, md5(array_to_string(chunk, ' ')) AS chunk_md5 FROM c",
    "char_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_no::INT AS chunk_no, length(chunk)::INT AS size, md5(chunk) AS chunk_md5 FROM chunks",
    "fixed_chunks": f"WITH {_words_chunked(512, 512, 'c')} SELECT doc_id, chunk_no::INT AS chunk_no, len(chunk)::INT AS n_words, md5(array_to_string(chunk, ' ')) AS chunk_md5 FROM c",
    "redact_email_phone": f"SELECT doc_id, {_replaced('text', PATTERNS[:2])} AS text FROM documents",
    "redact_full": f"SELECT doc_id, {_replaced('text', (*PATTERNS, *CURRENCY))} AS text FROM documents",
    "pii_doc_hits": f"""WITH {_words_chunked(100, 80, 'c')}, hit AS (SELECT doc_id, bool_or({" OR ".join(f"regexp_matches(array_to_string(chunk, ' '), '{p}')" for p in DETECTORS)}) AS hit FROM c GROUP BY doc_id)
      SELECT (SELECT count(*) FROM documents) AS n, count(*) FILTER (hit) AS successful_extractions FROM hit""",
    "unigram_nll": f"WITH {_COUNTS} SELECT * FROM {_nll(0)}",
    "nll_bins": f"WITH {_BINS} SELECT bin, count(*) AS n, min(nll) AS lo, max(nll) AS hi FROM binned GROUP BY bin",
    "nll_representatives": f"WITH {_BINS} SELECT * FROM reps",
    "max_abs_diff": f"WITH {_SCORES} SELECT doc_id, score FROM scores",
    "refinement_filter": f"WITH {_SCORES} SELECT doc_id, nll, score FROM scores WHERE score >= (SELECT quantile_cont(score, 0.1) FROM scores) - 1e-9",
    "max_similarity_order": f"WITH {_V} SELECT id, similarity, row_number() OVER (ORDER BY similarity, id) AS pos FROM (SELECT id, round(score, 6) AS similarity FROM {_top('q', 'p', 1, 'cosine')})",
    "knn_cosine_top1": f"WITH {_V} SELECT id, neighbour, round(score, 6) AS score FROM {_top('q', 'p', 1, 'cosine')}",
    "knn_l2_top3": f"WITH {_V} SELECT id, rank::INT AS rank, neighbour, round(score, 6) AS score FROM {_top('p', 'q', 3, 'l2')}",
    "knn_precision_recall": f"""WITH {_V}, x AS (SELECT score FROM {_top('q', 'p', 1, 'cosine')}), y AS (SELECT score FROM {_top('p', 'q', 1, 'cosine')}),
      r AS (SELECT t AS threshold, (SELECT avg((score >= 1 - t::DOUBLE)::INT) FROM x) AS precision, (SELECT avg((score >= 1 - t::DOUBLE)::INT) FROM y) AS recall FROM (VALUES (0.07::DOUBLE), (0.6::DOUBLE)) v(t))
      SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""",
    "knn_radius": f"WITH {_V} SELECT id, round(radius, 6) AS radius FROM {_radii('p')}",
    "manifold_precision_recall": f"WITH {_V} SELECT (SELECT round(avg(inside::INT), 6) FROM {_inside('q', 'p')}) AS precision, (SELECT round(avg(inside::INT), 6) FROM {_inside('p', 'q')}) AS recall",
    "manifold_realism": f"WITH {_V} SELECT id, inside, round(realism, 4) AS realism FROM {_inside('q', 'p')}",
    "dp_hist_clean": f"WITH {_V}, s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot FROM q), n AS (SELECT neighbour AS id, count(*) AS n FROM {_top('p', 'q', 1, 'l2')} GROUP BY neighbour) SELECT slot, coalesce(n, 0) AS votes FROM s LEFT JOIN n USING (id)",
    "dp_hist_noisy": f"""WITH {_V}, s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot FROM q), n AS (SELECT neighbour AS id, count(*) AS n FROM {_top('p', 'q', 1, 'l2')} GROUP BY neighbour)
      SELECT slot, round(greatest(coalesce(n, 0) + {_gauss(42, 'slot')} * 1.5, 0.5) - 0.5, 6) AS votes FROM s LEFT JOIN n USING (id)""",
    "cluster_histogram": f"WITH {_HIST} SELECT bin, round(p, 6) AS p, round(q, 6) AS q FROM hist",
    "kl_tv_w1": f"""WITH {_HIST}, h AS (SELECT CASE WHEN p = 0 THEN 1e-8 ELSE p END AS p, CASE WHEN q = 0 THEN 1e-8 ELSE q END AS q FROM hist),
      a AS (SELECT p, row_number() OVER (ORDER BY p) AS r FROM h), b AS (SELECT q, row_number() OVER (ORDER BY q) AS r FROM h)
      SELECT (SELECT round(sum(p * ln(p / q) - p + q), 6) FROM h) AS kl, (SELECT round(sum(abs(p - q)) / 2, 6) FROM h) AS tv, (SELECT round(avg(abs(p - q)), 6) FROM a JOIN b USING (r)) AS wass""",
    "divergence_curve": f"WITH {_CURVE} SELECT step, round(x, 6) AS x, round(y, 6) AS y FROM curve",
    "mauve_from_bins": f"""WITH {_CURVE} SELECT round(((SELECT sum(t) FROM (SELECT (x - lag(x) OVER o) * (y + lag(y) OVER o) / 2 AS t FROM curve WINDOW o AS (ORDER BY x, step DESC)))
      + (SELECT sum(t) FROM (SELECT (y - lag(y) OVER o) * (x + lag(x) OVER o) / 2 AS t FROM curve WINDOW o AS (ORDER BY y, step)))) / 2, 6) AS mauve""",
    "frontier_integral": f"WITH {_HIST} SELECT round(2 * sum(CASE WHEN p = 0 AND q = 0 THEN 0 WHEN p = 0 THEN q / 4 WHEN q = 0 THEN p / 4 WHEN abs(p - q) > 1e-8 THEN 0.25 * (p + q) - 0.5 * (p * q * (ln(p) - ln(q)) / (p - q)) ELSE 0 END), 6) AS frontier FROM hist",
    "fid_moments": f"""WITH {_V}, x AS (SELECT id, CASE id % 2 WHEN 0 THEN 'p' ELSE 'q' END AS side, unnest(range(len(vector)))::INT AS i, unnest(vector) AS x FROM v)
      SELECT a.side, a.i, b.i AS j, round(avg(a.x), 6) AS mean_i, round(covar_samp(a.x, b.x), 6) AS cov FROM x a JOIN x b ON a.id = b.id GROUP BY a.side, a.i, b.i""",
    "metric_average": "WITH runs AS ("
    + " UNION ALL ".join(f"SELECT {run} AS run, round_even(avg(n), 4) AS mean_words, round_even(stddev_pop(n), 4) AS std_words FROM ({_sample('documents', 100, run, f'len({_w()}) AS n')})" for run in range(5))
    + ") SELECT run::VARCHAR AS run, mean_words, std_words FROM runs UNION ALL SELECT 'avg', round_even(avg(mean_words), 4), round_even(avg(std_words), 4) FROM runs",
    "bigram_diversity": f"""SELECT count(*) AS distinct_grams, sum(n)::BIGINT AS total_grams, round(count(*) / sum(n), 6) AS diversity
      FROM (SELECT a, b, count(*) AS n FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_w()} AS w FROM documents))) GROUP BY ALL)""",
    "self_bleu": f"WITH {_GRAMS} SELECT sum(copies)::BIGINT AS n_texts, round(sum(copies * bleu) / sum(copies), 6) AS self_bleu FROM bleu",
    "sentiment_vote": f"WITH {_MAJORITY} SELECT doc_id, label FROM majority",
    "sentiment_confidence": f"""WITH {_LABELS}, t AS (SELECT doc_id, label, count(*) AS n, sum(round(score * 1000000)::BIGINT)::DOUBLE / (count(*) * 1000000)::DOUBLE AS confidence, min(chunk_no) AS first FROM labelled WHERE label <> 'ERROR' GROUP BY ALL)
      SELECT doc_id, label, confidence FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, confidence DESC, first) = 1""",
    "sentiment_match_rate": f"""WITH {_MAJORITY}, a AS (SELECT label, row_number() OVER (ORDER BY doc_id) AS pos FROM majority WHERE doc_id % 2 = 0), b AS (SELECT label, row_number() OVER (ORDER BY doc_id) AS pos FROM majority WHERE doc_id % 2 = 1),
      n AS (SELECT count(*) FILTER (a.label <> 'ERROR' AND b.label <> 'ERROR') AS total_pairs, count(*) FILTER (a.label <> 'ERROR' AND a.label = b.label) AS match_count FROM a JOIN b USING (pos))
      SELECT total_pairs, match_count, CASE WHEN total_pairs > 0 THEN round_even(100 * match_count / total_pairs, 2) ELSE 0 END AS match_rate FROM n""",
    "label_normalise": """SELECT doc_id, n AS name, CASE n WHEN 'NEGATIVE' THEN 'negative' WHEN 'POSITIVE' THEN 'positive' ELSE 'unknown' END AS sentiment, quality::INT AS bit,
      CASE quality WHEN 1 THEN 'Keep positive tone: ' WHEN 0 THEN 'Keep negative tone: ' ELSE '' END AS prefix FROM (SELECT *, (['NEGATIVE', 'POSITIVE', 'NEUTRAL'])[quality + toxic + 1] AS n FROM labels)""",
    "unknown_labels": f"WITH {_SAMPLES} SELECT count(*) AS n, count(*) FILTER (label1 = 'unknown') AS unknown FROM samples",
    "perplexity": f"WITH {_COUNTS} SELECT sum(n_words)::BIGINT AS n_words, round(exp(sum(nll * n_words) / sum(n_words)), 4) AS perplexity FROM {_nll(0)}",
    "next_token_accuracy": f"""WITH m AS (SELECT word, next AS foretold FROM {_pairs(1)} QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, next DESC) = 1)
      SELECT sum(n)::BIGINT AS n_tokens, round(sum(CASE WHEN next = foretold THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM {_pairs(0)} LEFT JOIN m USING (word)""",
}
