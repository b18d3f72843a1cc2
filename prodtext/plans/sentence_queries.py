"""Registered queries of learned sentence boundaries (T1), over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from prodtext.functions.text import SEP
from prodtext.operators import sentences as SN
from prodtext.plans.registry import register

_WS = r"\x20\x09-\x0D"


def _core(token: str) -> str:
    return rf"regexp_replace({token}, '\A[^\p{{L}}\p{{N}}]+', '')"


def _type(token: str) -> str:
    return rf"lower(regexp_replace({_core(token)}, '[^\p{{L}}\p{{N}}]+\z', ''))"


def _dotted(token: str) -> str:
    return rf"regexp_matches({_core(token)}, '[\p{{L}}\p{{N}}]\.[^\p{{L}}\p{{N}}.]*\z')"


def _loglik(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


_LEARN = rf"""
WITH tok AS MATERIALIZED (
  SELECT doc_id, k, token, {_type('token')} AS word, {_dotted('token')} AS dot,
         regexp_matches({_core('token')}, '[\p{{L}}\p{{N}}][!?][^\p{{L}}\p{{N}}]*\z') AS loud
  FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS k
        FROM (SELECT doc_id, string_split_regex(text, '[{_WS}]+') AS t FROM documents) x) y WHERE token <> ''),
types AS MATERIALIZED (
  SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE dot) AS BIGINT) AS n_dot FROM tok WHERE regexp_matches(word, '\p{{L}}') GROUP BY word),
chance AS (SELECT sum(n_dot)::DOUBLE / sum(n) AS p FROM types),
scored AS (
  SELECT word, n, n_dot, length(replace(word, '.', '')) AS size, length(word) - length(replace(word, '.', '')) AS inner_dots, (n - n_dot)::DOUBLE AS bare,
         2 * (n_dot * (ln({SN._LIKELY}::DOUBLE) - ln(p)) + (n - n_dot) * (ln({1 - SN._LIKELY!r}::DOUBLE) - ln(1 - p))) AS ratio
  FROM types, chance WHERE n_dot > 0 AND p > 0 AND p < 1),
abbr AS MATERIALIZED (
  SELECT word, n, n_dot, ratio * exp(-size) * (inner_dots + 1) * pow(size::DOUBLE, -bare) AS score
  FROM scored WHERE ratio * exp(-size) * (inner_dots + 1) * pow(size::DOUBLE, -bare) >= {SN.ABBREVIATION_FROM}),
followed AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM tok),
starts AS (
  SELECT after AS word, count(*)::DOUBLE AS s FROM followed
  WHERE (dot OR loud) AND NOT (dot AND word IN (SELECT word FROM abbr)) AND regexp_matches(after, '\p{{L}}') GROUP BY after),
sums AS (SELECT (SELECT sum(s) FROM starts)::DOUBLE AS b, (SELECT sum(n) FROM types)::DOUBLE AS n),
begun AS (
  SELECT starts.word, types.n AS c, s, greatest(types.n - s, 0)::DOUBLE AS r, b, sums.n AS n FROM starts JOIN types ON types.word = starts.word CROSS JOIN sums),
ratios AS (
  SELECT word, c, s, 2 * ({_loglik('s', 'b', '(s / b)')} + CASE WHEN n > b THEN {_loglik('r', '(n - b)', '(r / (n - b))')} ELSE 0 END
                          - {_loglik('s', 'b', '(c / n)')} - {_loglik('r', '(n - b)', '(c / n)')}) AS ratio, s / b > c / n AS more FROM begun),
starters AS MATERIALIZED (SELECT word, c AS n, CAST(s AS BIGINT) AS n_start, ratio FROM ratios WHERE ratio >= {SN.STARTER_FROM} AND more)"""

_SPLIT = rf""",
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([{_WS}]+)', '\1{SEP}\2', 'g'), '{SEP}') AS p FROM documents) x),
nexts AS (
  SELECT *, regexp_extract(piece, '[^{_WS}]+\z') AS tail, regexp_extract(nx, '\A[{_WS}]*([^{_WS}]+)', 1) AS head
  FROM (SELECT *, lead(piece) OVER (PARTITION BY doc_id ORDER BY k) AS nx FROM pieces) x),
decided AS (
  SELECT *, nx IS NOT NULL AND {_dotted('tail')} AND {_type('tail')} IN (SELECT word FROM abbr)
            AND NOT ({_type('head')} IN (SELECT word FROM starters) AND substring({_core('head')}, 1, 1) <> lower(substring({_core('head')}, 1, 1))) AS goes_on FROM nexts),
numbered AS (
  SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g
  FROM (SELECT *, coalesce(lag(goes_on) OVER (PARTITION BY doc_id ORDER BY k), false) AS before FROM decided) x),
whole AS (SELECT doc_id, g, regexp_replace(string_agg(piece, '' ORDER BY k), '\A[{_WS}]+|[{_WS}]+\z', '', 'g') AS sentence FROM numbered GROUP BY doc_id, g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) AS INT) AS sent_ord, sentence FROM whole WHERE sentence <> ''"""


def _learned(spark):
    docs = spark.table("documents").select("doc_id", "text")
    types = SN.token_types(docs)
    abbreviations = SN.learn_abbreviations(types)
    return docs, abbreviations, SN.learn_starters(docs, types, abbreviations)


def _tables(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")


@register("learned_abbreviations", _LEARN + " SELECT word, n, n_dot, round(score, 4) AS score FROM abbr")
def q_learned_abbreviations(spark, sf_dir):
    _tables(spark, sf_dir)
    found = SN.learn_abbreviations(SN.token_types(spark.table("documents")))
    return found.withColumn("score", F.round("score", 4))


@register("learned_starters", _LEARN + " SELECT word, n, n_start, round(ratio, 4) AS ratio FROM starters")
def q_learned_starters(spark, sf_dir):
    _tables(spark, sf_dir)
    return _learned(spark)[2].withColumn("ratio", F.round("ratio", 4))


@register("learned_sentences", _LEARN + _SPLIT)
def q_learned_sentences(spark, sf_dir):
    _tables(spark, sf_dir)
    split = SN.split_learned(*(lambda d, a, s: (d, "doc_id", a, s))(*_learned(spark)))
    return split.select("doc_id", F.posexplode("sentences").alias("pos", "sentence")).select("doc_id", (F.col("pos") + 1).cast("int").alias("sent_ord"), "sentence")
