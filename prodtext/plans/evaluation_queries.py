"""Registered generated-text evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prodtext.functions.text import metric_normalize, syllable_estimate
from prodtext.functions.text import WS
from prodtext.operators import metrics as M
from prodtext.operators import render as R
from prodtext.operators.spans import round_cols
from prodtext.plans.registry import register
from prodtext.session import cut_lineage
from prodtext.sources.fixtures import duck_with, register_fixtures


def _fx(spark, sf_dir):
    register_fixtures(spark, sf_dir, ["candidates"])
    return spark.table("candidates")


def extracted(spark, sf_dir):
    return R.extract_description(_fx(spark, sf_dir))


def scored(spark, sf_dir):
    # extracted candidates feed the text side, the reference side and the n-gram join
    return M.score_candidates(cut_lineage(extracted(spark, sf_dir)))


def WORDS(x):
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def SENTS(x):
    return (f"len(list_filter(string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: regexp_replace(s, '{WS}', '', 'g') <> ''))")


def SYLL(x):
    return f"greatest(1, len(regexp_extract_all(lower({x}), '[aeiouy]+')))"


EVAL_CTES = f"""
ext AS (
  SELECT prompt_id, sample_id, reference,
    regexp_matches(split_part(raw, '<|PAD|>', 1), '<DESCR_START>([^\\n]*)<DESCR_END>') AS valid,
    CASE WHEN regexp_matches(split_part(raw, '<|PAD|>', 1), '<DESCR_START>([^\\n]*)<DESCR_END>')
      THEN replace(replace(regexp_extract(split_part(raw, '<|PAD|>', 1), '<DESCR_START>([^\\n]*)<DESCR_END>', 1),
           '<h2>', '<h4>'), '</h2>', '</h4>') END AS description
  FROM candidates),
tr AS (
  SELECT prompt_id, sample_id, reference,
         array_to_string({WORDS('description')}[1:len({WORDS('reference')})], ' ') AS text
  FROM ext WHERE valid),
nm AS (
  SELECT *, regexp_replace(lower(regexp_replace(replace(replace(replace(text, '<h2>', ''), '</h2>', ''), '<br>', ''),
            '^{WS}+|{WS}+\\z', '', 'g')), '{WS}{WS}+', ' ', 'g') AS norm FROM tr),
rd0 AS (
  SELECT *, CAST(len({WORDS('norm')}) AS DOUBLE) AS w, CAST({SENTS('norm')} AS DOUBLE) AS s,
         CAST({SYLL('norm')} AS DOUBLE) AS y, {WORDS('norm')}[1:100] AS w100 FROM nm),
rd1 AS (
  SELECT *, CAST(len(w100) AS DOUBLE) AS n100,
         CAST({SENTS("array_to_string(w100, ' ')")} AS DOUBLE) AS s100,
         CAST(len(list_filter(w100, lambda x: NOT regexp_matches(substr(x, 1, 1), '\\p{{Lu}}')
              AND {SYLL('x')} > 2)) AS DOUBLE) AS cw FROM rd0),
rd AS (
  SELECT prompt_id, sample_id, text, norm,
    CASE WHEN w > 0 AND s > 0 THEN 206.835 - 1.015 * (w / s) - 84.6 * (y / w) END AS flesch,
    CASE WHEN w > 0 AND s > 0 THEN 0.05888 * (length(norm) / w * 100) - 0.269 * (s / w * 100) - 15.8 END AS coleman,
    CASE WHEN w > 0 AND s > 0 AND s100 > 0 THEN 0.4 * ((n100 / s100) + 100 * (cw / n100)) END AS gunning
  FROM rd1),
hpos AS (SELECT prompt_id, sample_id, text, unnest(range(1, greatest(length(text), 1) + 1)) AS i FROM tr),
hg AS (SELECT prompt_id, sample_id, n, substring(text, i, n) AS gram, count(*) AS cnt
       FROM hpos, (VALUES (1), (2), (3), (4)) AS nn(n) WHERE length(substring(text, i, n)) = n GROUP BY ALL),
refs AS (SELECT DISTINCT prompt_id, reference FROM candidates),
rpos AS (SELECT prompt_id, reference, unnest(range(1, greatest(length(reference), 1) + 1)) AS i FROM refs),
rg AS (SELECT prompt_id, n, substring(reference, i, n) AS gram, count(*) AS rcnt
       FROM rpos, (VALUES (1), (2), (3), (4)) AS nn(n) WHERE length(substring(reference, i, n)) = n GROUP BY ALL),
clip AS (
  SELECT h.prompt_id, h.sample_id,
    sum(CASE WHEN h.n = 1 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m1,
    sum(CASE WHEN h.n = 2 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m2,
    sum(CASE WHEN h.n = 3 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m3,
    sum(CASE WHEN h.n = 4 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m4
  FROM hg h LEFT JOIN rg r ON h.prompt_id = r.prompt_id AND h.n = r.n AND h.gram = r.gram GROUP BY 1, 2),
bg0 AS (
  SELECT t.prompt_id, t.sample_id, CAST(length(t.text) AS DOUBLE) AS c, CAST(length(t.reference) AS DOUBLE) AS r,
         coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4
  FROM tr t LEFT JOIN clip k ON t.prompt_id = k.prompt_id AND t.sample_id = k.sample_id),
bg AS (
  SELECT prompt_id, sample_id,
    CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 AND m4 > 0 THEN
      (CASE WHEN c > r THEN 1.0 WHEN c = 0 THEN 0.0 ELSE exp(1 - r / c) END)
      * exp((ln(m1 / greatest(1, greatest(0, c)))
           + ln(m2 / greatest(1, greatest(0, c - 1)))
           + ln(m3 / greatest(1, greatest(0, c - 2)))
           + ln(m4 / greatest(1, greatest(0, c - 3)))) / 4)
    ELSE 0.0 END AS bleu,
    CASE WHEN greatest(greatest(0, c) + greatest(0, c - 1) + greatest(0, c - 2) + greatest(0, c - 3),
                       greatest(0, r) + greatest(0, r - 1) + greatest(0, r - 2) + greatest(0, r - 3)) > 0
      THEN (m1 + m2 + m3 + m4) / greatest(greatest(0, c) + greatest(0, c - 1) + greatest(0, c - 2) + greatest(0, c - 3),
                       greatest(0, r) + greatest(0, r - 1) + greatest(0, r - 2) + greatest(0, r - 3))
      ELSE 0.0 END AS gleu
  FROM bg0),
sc AS (SELECT d.prompt_id, d.sample_id, d.flesch, d.coleman, d.gunning, b.bleu, b.gleu
       FROM rd d JOIN bg b ON d.prompt_id = b.prompt_id AND d.sample_id = b.sample_id),
per_prompt AS (
  SELECT prompt_id,
    CASE WHEN ok THEN bleu_mean END AS bleu_mean, CASE WHEN ok THEN bleu_std END AS bleu_std,
    CASE WHEN ok THEN gleu_mean END AS gleu_mean, CASE WHEN ok THEN gleu_std END AS gleu_std,
    CASE WHEN ok THEN flesch_mean END AS flesch_mean, CASE WHEN ok THEN flesch_std END AS flesch_std,
    CASE WHEN ok THEN coleman_mean END AS coleman_mean, CASE WHEN ok THEN coleman_std END AS coleman_std,
    CASE WHEN ok THEN gunning_mean END AS gunning_mean, CASE WHEN ok THEN gunning_std END AS gunning_std
  FROM (
    SELECT prompt_id, avg(bleu) AS bleu_mean, stddev_samp(bleu) AS bleu_std, avg(gleu) AS gleu_mean,
      stddev_samp(gleu) AS gleu_std, avg(flesch) AS flesch_mean, stddev_samp(flesch) AS flesch_std,
      avg(coleman) AS coleman_mean, stddev_samp(coleman) AS coleman_std, avg(gunning) AS gunning_mean,
      stddev_samp(gunning) AS gunning_std,
      count(bleu) >= 2 AND count(gleu) >= 2 AND count(flesch) >= 2 AND count(coleman) >= 2
        AND count(gunning) >= 2 AS ok
    FROM sc GROUP BY prompt_id) x)"""

W = duck_with(["candidates"]) + "," + EVAL_CTES + "\n"
MS_COLS = [f"{m}_{s}" for m in M.METRICS for s in ("mean", "std")]


def r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@register("extract_description", W + "SELECT prompt_id, sample_id, valid, description FROM ext")
def q_extract_description(spark, sf_dir):
    return extracted(spark, sf_dir).select("prompt_id", "sample_id", "valid", "description")


@register("first_valid_candidate", W + """
SELECT prompt_id, arg_min(sample_id, sample_id) AS sample_id, arg_min(description, sample_id) AS description
FROM ext WHERE valid GROUP BY prompt_id""")
def q_first_valid_candidate(spark, sf_dir):
    return M.first_valid_candidate(extracted(spark, sf_dir)).select("prompt_id", "sample_id", "description")


@register("invalid_candidate_count", W + """
SELECT CAST(count_if(NOT valid) AS BIGINT) AS invalid, CAST(count(*) AS BIGINT) AS total FROM ext""")
def q_invalid_candidate_count(spark, sf_dir):
    return M.invalid_candidate_count(extracted(spark, sf_dir))


@register("truncate_to_ref", W + "SELECT prompt_id, sample_id, text FROM tr")
def q_truncate_to_ref(spark, sf_dir):
    e = extracted(spark, sf_dir).where("valid")
    return M.truncate_to_ref(e).select("prompt_id", "sample_id", "text")


@register("metric_normalize", W + "SELECT prompt_id, sample_id, norm FROM nm")
def q_metric_normalize(spark, sf_dir):
    e = M.truncate_to_ref(extracted(spark, sf_dir).where("valid"))
    return e.select("prompt_id", "sample_id", metric_normalize(F.col("text")).alias("norm"))


@register("syllable_estimate", W + "SELECT prompt_id, sample_id, CAST(y AS BIGINT) AS syllables FROM rd0")
def q_syllable_estimate(spark, sf_dir):
    e = M.truncate_to_ref(extracted(spark, sf_dir).where("valid"))
    return e.select("prompt_id", "sample_id", syllable_estimate(metric_normalize(F.col("text"))).cast("bigint").alias("syllables"))


for _m in ("flesch", "coleman", "gunning", "bleu", "gleu"):
    def _mk(m):
        def q(spark, sf_dir):
            return round_cols(scored(spark, sf_dir).select("prompt_id", "sample_id", m), [m])
        q.__name__ = f"q_{m}"
        return q
    register(_m, W + f"SELECT prompt_id, sample_id, round({_m}, 6) AS {_m} FROM sc")(_mk(_m))


@register("candidate_mean_std", W + f"SELECT prompt_id, {r6(MS_COLS)} FROM per_prompt")
def q_candidate_mean_std(spark, sf_dir):
    return round_cols(M.candidate_mean_std(scored(spark, sf_dir)), MS_COLS)


@register("corpus_metric_mean", W + f"SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in MS_COLS)} FROM per_prompt")
def q_corpus_metric_mean(spark, sf_dir):
    return round_cols(M.corpus_metric_mean(M.candidate_mean_std(scored(spark, sf_dir)), MS_COLS), MS_COLS)


@register("metric_histogram", W + """
SELECT CAST(least(greatest(floor((bleu_mean - 0.0) / 0.1), 0), 9) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n
FROM per_prompt WHERE bleu_mean IS NOT NULL GROUP BY 1""")
def q_metric_histogram(spark, sf_dir):
    return M.metric_histogram(M.candidate_mean_std(scored(spark, sf_dir)), "bleu_mean", 0.0, 1.0, 10)


@register("evaluate_candidates", W + f"""
SELECT p.prompt_id, f.description AS review, {r6(['p.' + c for c in MS_COLS]).replace('AS p.', 'AS ')}
FROM per_prompt p JOIN (SELECT prompt_id, arg_min(description, sample_id) AS description FROM ext WHERE valid
                        GROUP BY prompt_id) f ON p.prompt_id = f.prompt_id""")
def q_evaluate_candidates(spark, sf_dir):
    e = cut_lineage(extracted(spark, sf_dir))
    first = M.first_valid_candidate(e).select("prompt_id", F.col("description").alias("review"))
    per = round_cols(M.candidate_mean_std(M.score_candidates(e)), MS_COLS)
    return per.join(first, "prompt_id")


BLEU_WORD_CTES = f"""
wt AS (SELECT prompt_id, sample_id, {WORDS('text')} AS w FROM tr),
wr AS (SELECT DISTINCT prompt_id, {WORDS('reference')} AS w FROM candidates),
whpos AS (SELECT prompt_id, sample_id, w, unnest(range(1, greatest(len(w), 1) + 1)) AS i FROM wt),
whg AS (SELECT prompt_id, sample_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS cnt
        FROM whpos, (VALUES (1), (2), (3), (4)) AS nn(n) WHERE i + n - 1 <= len(w) GROUP BY ALL),
wrpos AS (SELECT prompt_id, w, unnest(range(1, greatest(len(w), 1) + 1)) AS i FROM wr),
wrg AS (SELECT prompt_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS rcnt
        FROM wrpos, (VALUES (1), (2), (3), (4)) AS nn(n) WHERE i + n - 1 <= len(w) GROUP BY ALL),
wclip AS (
  SELECT h.prompt_id, h.sample_id,
    sum(CASE WHEN h.n = 1 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m1,
    sum(CASE WHEN h.n = 2 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m2,
    sum(CASE WHEN h.n = 3 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m3,
    sum(CASE WHEN h.n = 4 THEN least(h.cnt, coalesce(r.rcnt, 0)) END) AS m4
  FROM whg h LEFT JOIN wrg r ON h.prompt_id = r.prompt_id AND h.n = r.n AND h.gram = r.gram GROUP BY 1, 2),
wb0 AS (
  SELECT t.prompt_id, t.sample_id, CAST(len(t.w) AS DOUBLE) AS c, CAST(len(r.w) AS DOUBLE) AS r,
         coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4
  FROM wt t JOIN wr r ON t.prompt_id = r.prompt_id
  LEFT JOIN wclip k ON t.prompt_id = k.prompt_id AND t.sample_id = k.sample_id)"""


@register("bleu_word", W + "," + BLEU_WORD_CTES + """
SELECT prompt_id, sample_id, round(
    CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 AND m4 > 0 THEN
      (CASE WHEN c > r THEN 1.0 WHEN c = 0 THEN 0.0 ELSE exp(1 - r / c) END)
      * exp((ln(m1 / greatest(1, greatest(0, c))) + ln(m2 / greatest(1, greatest(0, c - 1)))
           + ln(m3 / greatest(1, greatest(0, c - 2))) + ln(m4 / greatest(1, greatest(0, c - 3)))) / 4)
    ELSE 0.0 END, 6) AS bleu_word
FROM wb0""")
def q_bleu_word(spark, sf_dir):
    e = cut_lineage(extracted(spark, sf_dir))
    v = M.truncate_to_ref(e.where("valid"))
    refs = e.select("prompt_id", "reference").dropDuplicates(["prompt_id"])
    b = M.bleu_gleu(v, refs, level="word").select("prompt_id", "sample_id", F.col("bleu").alias("bleu_word"))
    return round_cols(b, ["bleu_word"])
