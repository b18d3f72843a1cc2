"""Registered cleaning queries over extracted candidate descriptions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from prodtext.functions.stopwords import STOPWORDS_EN
from prodtext.functions.text import WS
from prodtext.operators import clean as CL
from prodtext.operators import metrics as M
from prodtext.operators.spans import round_cols
from prodtext.plans import sqlparts as Q
from prodtext.plans.evaluation_queries import EVAL_CTES, WORDS, extracted
from prodtext.plans.registry import register
from prodtext.session import cut_lineage
from prodtext.sources.fixtures import duck_with

KEYS = ["prompt_id", "sample_id"]
BLACKLIST_DEMO = ["tion", "eau"]


def reviews(spark, sf_dir):
    return extracted(spark, sf_dir).where("valid").select(*KEYS, F.col("description").alias("text"))


def long_form(df, col="sentences"):
    return df.select(*KEYS, F.posexplode(col).alias("sent_ord", "sentence")).withColumn(
        "sent_ord", (F.col("sent_ord") + 1).cast("int"))


STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS_EN) + "]"
CLEAN_CTES = f"""
rv AS (SELECT prompt_id, sample_id, description AS text FROM ext WHERE valid),
sp0 AS (
  SELECT prompt_id, sample_id,
    unnest(string_split(regexp_replace(replace(replace(text, '</h2>  <br>', '</h2> <br> '), '..', '.'),
           '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))) AS piece,
    unnest(generate_series(1, len(string_split(regexp_replace(replace(replace(text, '</h2>  <br>', '</h2> <br> '),
           '..', '.'), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))))) AS k
  FROM rv),
sp1 AS (SELECT prompt_id, sample_id, k, regexp_replace(piece, '^{WS}+|{WS}+\\z', '', 'g') AS p FROM sp0),
sents AS (
  SELECT prompt_id, sample_id,
    CAST(row_number() OVER (PARTITION BY prompt_id, sample_id ORDER BY k) AS INT) AS sent_ord,
    substring(p, 1, length(p) - 1) AS sentence
  FROM sp1 WHERE p <> ''),
dd0 AS (SELECT prompt_id, sample_id, sentence, min(sent_ord) AS first_ord FROM sents GROUP BY 1, 2, 3),
dds AS (SELECT prompt_id, sample_id, sentence,
          CAST(row_number() OVER (PARTITION BY prompt_id, sample_id ORDER BY first_ord) AS INT) AS sent_ord FROM dd0),
titled AS (
  SELECT prompt_id, sample_id, sent_ord,
    CASE WHEN {Q.is_title(f"array_to_string(list_filter({WORDS('sentence')}, lambda w: NOT list_contains({STOP_SQL}, lower(w))), ' ')")}
         THEN chr(10) || chr(10) || '#### ' || sentence || chr(10) || chr(10) ELSE sentence END AS sentence
  FROM dds)"""

W = duck_with(["candidates"]) + "," + EVAL_CTES + "," + CLEAN_CTES + "\n"


@register("sentence_split", W + "SELECT prompt_id, sample_id, sent_ord, sentence FROM sents")
def q_sentence_split(spark, sf_dir):
    return long_form(CL.sentence_split(reviews(spark, sf_dir)))


@register("sentence_split_dot", W + """
SELECT prompt_id, sample_id, CAST(row_number() OVER (PARTITION BY prompt_id, sample_id ORDER BY k) AS INT) AS sent_ord,
       piece AS sentence
FROM (SELECT prompt_id, sample_id, unnest(string_split(text, '.')) AS piece,
             unnest(generate_series(1, len(string_split(text, '.')))) AS k FROM rv) x
WHERE piece <> ''""")
def q_sentence_split_dot(spark, sf_dir):
    return long_form(CL.sentence_split_dot(reviews(spark, sf_dir)))


@register("dedupe_sentences", W + "SELECT prompt_id, sample_id, sent_ord, sentence FROM dds")
def q_dedupe_sentences(spark, sf_dir):
    return long_form(CL.dedupe_sentences(CL.sentence_split(reviews(spark, sf_dir))))


@register("title_detect", W + "SELECT prompt_id, sample_id, sent_ord, sentence FROM titled")
def q_title_detect(spark, sf_dir):
    return long_form(CL.title_detect(CL.dedupe_sentences(CL.sentence_split(reviews(spark, sf_dir)))))


@register("title_detect_blank", W + f"""
, parts AS (
  SELECT prompt_id, sample_id, unnest(string_split(text, '.')) AS s,
         unnest(generate_series(1, len(string_split(text, '.')))) AS k FROM rv),
lagged AS (SELECT *, lag(s) OVER (PARTITION BY prompt_id, sample_id ORDER BY k) AS prev FROM parts)
SELECT prompt_id, sample_id,
       CAST(row_number() OVER (PARTITION BY prompt_id, sample_id ORDER BY k) AS INT) AS sent_ord,
       CASE WHEN prev = '' AND {Q.is_title('s')} THEN chr(10) || chr(10) || '####' || s || chr(10) || chr(10)
            ELSE s END AS sentence
FROM lagged WHERE s <> ''""".replace("\n, parts", ", parts", 1))
def q_title_detect_blank(spark, sf_dir):
    r = reviews(spark, sf_dir).withColumn("sentences", F.split("text", r"\.", -1))
    return long_form(CL.title_detect_blank(r))


@register("sentence_blacklist", W + f"""
SELECT prompt_id, sample_id, CAST(row_number() OVER (PARTITION BY prompt_id, sample_id ORDER BY sent_ord) AS INT) AS sent_ord,
       sentence
FROM dds WHERE NOT ({' OR '.join(f"contains(lower(sentence), '{p}')" for p in BLACKLIST_DEMO)})""")
def q_sentence_blacklist(spark, sf_dir):
    s = CL.dedupe_sentences(CL.sentence_split(reviews(spark, sf_dir)))
    return long_form(CL.sentence_blacklist(s, BLACKLIST_DEMO))


def _titled(spark, sf_dir):
    return CL.title_detect(CL.dedupe_sentences(CL.sentence_split(CL.dealt_out(reviews(spark, sf_dir), KEYS))))


# The ratio in SQL.  Pairs whose common characters allow more than 0.9; the cells where two
# characters of a pair are equal, as runs along diagonals (once all, once without the
# characters that a second text of 200 or more holds too often to start a block); then the longest
# block of a segment, widened by equal characters, and the same left and right of it.
RATIO_CTES = """
nd_s AS MATERIALIZED (
  SELECT prompt_id, sample_id, sent_ord - 1 AS i, sentence AS s, length(sentence) AS n FROM titled WHERE NOT contains(sentence, '#')),
nd_ch AS MATERIALIZED (
  SELECT prompt_id, sample_id, i, k, substring(s, k + 1, 1) AS ch FROM nd_s, unnest(generate_series(0, n - 1)) AS q(k)),
nd_c AS MATERIALIZED (SELECT prompt_id, sample_id, i, ch, count(*) AS c FROM nd_ch GROUP BY ALL),
nd_common AS (
  SELECT a.prompt_id, a.sample_id, a.i, b.i AS j, sum(least(a.c, b.c)) AS common
  FROM nd_c a JOIN nd_c b ON a.prompt_id = b.prompt_id AND a.sample_id = b.sample_id AND a.ch = b.ch AND a.i < b.i GROUP BY ALL),
nd_pair AS MATERIALIZED (
  SELECT row_number() OVER () AS pid, c.prompt_id, c.sample_id, c.i, c.j, a.n AS la, b.n AS lb
  FROM nd_common c JOIN nd_s a ON a.prompt_id = c.prompt_id AND a.sample_id = c.sample_id AND a.i = c.i
  JOIN nd_s b ON b.prompt_id = c.prompt_id AND b.sample_id = c.sample_id AND b.i = c.j
  WHERE 2.0::DOUBLE * c.common / (a.n + b.n) > 0.9::DOUBLE),
nd_cell AS MATERIALIZED (
  SELECT p.pid, x.k AS x, y.k AS y, x.k - y.k AS d, NOT (p.lb >= 200 AND often.c > p.lb // 100 + 1) AS seed
  FROM nd_pair p
  JOIN nd_ch x ON x.prompt_id = p.prompt_id AND x.sample_id = p.sample_id AND x.i = p.i
  JOIN nd_ch y ON y.prompt_id = p.prompt_id AND y.sample_id = p.sample_id AND y.i = p.j AND y.ch = x.ch
  JOIN nd_c often ON often.prompt_id = p.prompt_id AND often.sample_id = p.sample_id AND often.i = p.j AND often.ch = x.ch),
nd_run AS MATERIALIZED (
  SELECT pid, d, min(x) AS x0, count(*) AS len FROM (
    SELECT pid, d, x, x - row_number() OVER (PARTITION BY pid, d ORDER BY x) AS g FROM nd_cell) t GROUP BY pid, d, g),
nd_seed AS MATERIALIZED (
  SELECT pid, d, min(x) AS x0, count(*) AS len FROM (
    SELECT pid, d, x, x - row_number() OVER (PARTITION BY pid, d ORDER BY x) AS g FROM nd_cell WHERE seed) t GROUP BY pid, d, g),
nd_seg AS (
  SELECT pid, 0::BIGINT AS alo, la::BIGINT AS ahi, 0::BIGINT AS blo, lb::BIGINT AS bhi, 0::BIGINT AS got FROM nd_pair
  UNION ALL
  SELECT h.pid, CASE WHEN v.side = 0 THEN h.alo ELSE least(r.x0 + r.len, h.ahi, h.bhi + r.d) END,
    CASE WHEN v.side = 0 THEN greatest(r.x0, h.alo, h.blo + r.d) ELSE h.ahi END,
    CASE WHEN v.side = 0 THEN h.blo ELSE least(r.x0 + r.len, h.ahi, h.bhi + r.d) - r.d END,
    CASE WHEN v.side = 0 THEN greatest(r.x0, h.alo, h.blo + r.d) - r.d ELSE h.bhi END,
    CASE WHEN v.side = 0 THEN least(r.x0 + r.len, h.ahi, h.bhi + r.d) - greatest(r.x0, h.alo, h.blo + r.d) ELSE 0 END
  FROM (
    SELECT g.pid, g.alo, g.ahi, g.blo, g.bhi, coalesce(g.best.x, g.alo) AS bx, coalesce(g.best.d, g.alo - g.blo) AS bd
    FROM (
      SELECT s.pid, s.alo, s.ahi, s.blo, s.bhi,
        arg_max(struct_pack(x := greatest(t.x0, s.alo, s.blo + t.d), d := t.d),
                (least(t.x0 + t.len, s.ahi, s.bhi + t.d) - greatest(t.x0, s.alo, s.blo + t.d)) * 10000000000
                - greatest(t.x0, s.alo, s.blo + t.d) * 100000 - (greatest(t.x0, s.alo, s.blo + t.d) - t.d)) AS best
      FROM nd_seg s LEFT JOIN nd_seed t
        ON t.pid = s.pid AND least(t.x0 + t.len, s.ahi, s.bhi + t.d) > greatest(t.x0, s.alo, s.blo + t.d)
      WHERE s.alo < s.ahi AND s.blo < s.bhi GROUP BY s.pid, s.alo, s.ahi, s.blo, s.bhi) g) h
  JOIN nd_run r ON r.pid = h.pid AND r.d = h.bd AND r.x0 <= h.bx AND h.bx < r.x0 + r.len,
  (VALUES (0), (1)) AS v(side)),
nd_ratio AS MATERIALIZED (
  SELECT p.prompt_id, p.sample_id, p.i, p.j, 2.0::DOUBLE * m.got / (p.la + p.lb) AS ratio
  FROM nd_pair p JOIN (SELECT pid, sum(got) AS got FROM nd_seg GROUP BY pid) m ON m.pid = p.pid)"""

# titled sentences without those that an earlier one resembles, joined, headings deduplicated
CLEANED_CTES = """
nd_kept AS (
  SELECT t.* FROM titled t WHERE NOT EXISTS (
    SELECT 1 FROM nd_ratio r WHERE r.prompt_id = t.prompt_id AND r.sample_id = t.sample_id AND r.j = t.sent_ord - 1 AND r.ratio > 0.9::DOUBLE)),
nd_lag AS (SELECT *, lag(sentence) OVER (PARTITION BY prompt_id, sample_id ORDER BY sent_ord) AS prev FROM nd_kept),
nd_text AS (
  SELECT prompt_id, sample_id,
    string_agg(CASE WHEN prev IS NOT NULL AND NOT contains(prev, '#') THEN '. ' || sentence ELSE sentence END, '' ORDER BY sent_ord) || '.' AS text
  FROM nd_lag GROUP BY 1, 2),
nd_head AS (SELECT *, regexp_extract_all(text, '<h2> ([^\\n]*?) </h2>', 1) AS heads FROM nd_text),
nd_clean AS MATERIALIZED (
  SELECT prompt_id, sample_id,
    CASE WHEN len(heads) >= 2 THEN list_reduce(
      flatten(list_transform(range(0, len(heads) - 1), lambda a: heads[a + 2:len(heads)])),
      lambda acc, b: replace(replace(acc, '<br><h2> ' || b || ' </h2>', ''), '   ', ' '), text) ELSE text END AS clean
  FROM nd_head)"""
WR = W.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + "," + RATIO_CTES + "\n"
WC = WR.rstrip() + "," + CLEANED_CTES + "\n"


@register("similarity_ratio", WR + "SELECT prompt_id, sample_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(ratio, 6) AS ratio FROM nd_ratio")
def q_similarity_ratio(spark, sf_dir):
    """Exact ratio of every same-review pair whose common characters allow more than 0.9."""
    sent = CL.explode_sentences(_titled(spark, sf_dir), KEYS)
    pairs = CL.near_dup_pairs(sent, KEYS, scored_only=True)
    return round_cols(pairs, ["ratio"])


@register("near_dup_sentences", WR + """
SELECT prompt_id, sample_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(ratio, 6) AS ratio FROM nd_ratio WHERE ratio > 0.9::DOUBLE""")
def q_near_dup_sentences(spark, sf_dir):
    sent = CL.explode_sentences(_titled(spark, sf_dir), KEYS)
    return round_cols(CL.near_dup_pairs(sent, KEYS), ["ratio"])


@register("clean_review", WC + """
SELECT r.prompt_id, r.sample_id, c.clean FROM rv r LEFT JOIN nd_clean c ON c.prompt_id = r.prompt_id AND c.sample_id = r.sample_id""")
def q_clean_review(spark, sf_dir):
    return CL.clean_review(reviews(spark, sf_dir), KEYS).select(*KEYS, "clean")


@register("heading_dedupe", W + """,
hd AS (SELECT prompt_id, string_agg('<br><h2> S' || CAST(sample_id AS VARCHAR) || ' </h2>   ' || text, ''
                                    ORDER BY sample_id) AS text FROM rv GROUP BY 1),
hh AS (SELECT prompt_id, text, regexp_extract_all(text, '<h2> ([^\\n]*?) </h2>', 1) AS heads FROM hd)
SELECT prompt_id,
  CASE WHEN len(heads) >= 2 THEN list_reduce(
         flatten(list_transform(range(0, len(heads) - 1), lambda a: heads[a + 2:len(heads)])),
         lambda acc, b: replace(replace(acc, '<br><h2> ' || b || ' </h2>', ''), '   ', ' '), text)
       ELSE text END AS text
FROM hh""")
def q_heading_dedupe(spark, sf_dir):
    r = reviews(spark, sf_dir)
    doc = r.groupBy("prompt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "sample_id", F.concat(F.lit("<br><h2> S"), F.col("sample_id").cast("string"), F.lit(" </h2>   "),
                              F.col("text")).alias("t")))), lambda x: x["t"]), "").alias("text"))
    return doc.select("prompt_id", CL.heading_dedupe_expr(F.col("text")).alias("text"))


@register("clean_review_join", W + """,
lagged AS (SELECT *, lag(sentence) OVER (PARTITION BY prompt_id, sample_id ORDER BY sent_ord) AS prev FROM titled),
joined AS (
  SELECT prompt_id, sample_id,
         string_agg(CASE WHEN prev IS NULL THEN sentence WHEN NOT contains(prev, '#') THEN '. ' || sentence
                         ELSE sentence END, '' ORDER BY sent_ord) || '.' AS text
  FROM lagged GROUP BY 1, 2)
SELECT r.prompt_id, r.sample_id, j.text FROM rv r
LEFT JOIN joined j ON r.prompt_id = j.prompt_id AND r.sample_id = j.sample_id""")
def q_clean_review_join(spark, sf_dir):
    """W7 alone: re-join the title-wrapped sentences (no near-duplicate step)."""
    return _titled(spark, sf_dir).select(*KEYS, CL.join_sentences_expr(F.col("sentences")).alias("text"))


# the scoring of the cleaned texts: the raw scoring's steps, from its truncated text on
_SCORING = EVAL_CTES[EVAL_CTES.index("hpos AS"):EVAL_CTES.index("sc AS")].rstrip().rstrip(",")
for _name in ("hpos", "hg", "refs", "rpos", "rg", "clip", "bg0", "bg", "tr"):
    _SCORING = re.sub(rf"\b{_name}\b", f"c_{_name}", _SCORING)
CLEAN_SCORE_CTES = f"""
c_text AS (
  SELECT e.prompt_id, e.sample_id, e.reference, coalesce(c.clean, e.description) AS clean
  FROM ext e LEFT JOIN nd_clean c ON c.prompt_id = e.prompt_id AND c.sample_id = e.sample_id WHERE e.valid),
c_tr AS MATERIALIZED (
  SELECT prompt_id, sample_id, reference, array_to_string({WORDS('clean')}[1:len({WORDS('reference')})], ' ') AS text FROM c_text),
{_SCORING},
c_per AS (
  SELECT prompt_id, avg(bleu) AS bleu_clean_mean, stddev_samp(bleu) AS bleu_clean_std, avg(gleu) AS gleu_clean_mean,
         stddev_samp(gleu) AS gleu_clean_std, count(bleu) >= 2 AS ok FROM c_bg GROUP BY prompt_id),
c_first AS (
  SELECT t.prompt_id, arg_min(e.description, e.sample_id) AS review, arg_min(t.clean, t.sample_id) AS review_clean
  FROM c_text t JOIN ext e ON e.prompt_id = t.prompt_id AND e.sample_id = t.sample_id GROUP BY 1)"""
RAW_MS = [f"{m}_{s}" for m in M.METRICS for s in ("mean", "std")]
CLEAN_MS = ["bleu_clean_mean", "bleu_clean_std", "gleu_clean_mean", "gleu_clean_std"]


@register("evaluate_candidates_clean", WC.rstrip() + "," + CLEAN_SCORE_CTES + f"""
SELECT p.prompt_id, f.review, f.review_clean, {", ".join(f"round(p.{c}, 6) AS {c}" for c in RAW_MS)},
  {", ".join(f"round(CASE WHEN c.ok AND p.bleu_mean IS NOT NULL THEN c.{c} END, 6) AS {c}" for c in CLEAN_MS)}
FROM per_prompt p JOIN c_per c ON c.prompt_id = p.prompt_id JOIN c_first f ON f.prompt_id = p.prompt_id""")
def q_evaluate_candidates_clean(spark, sf_dir):
    """T18 with the cleaned columns: BLEU/GLEU of the truncated cleaned review (falls back to
    raw), and the first valid sample's review as it is and cleaned."""
    e = cut_lineage(extracted(spark, sf_dir).drop("raw"))
    c = CL.clean_review(e.where("valid").select(*KEYS, F.col("description").alias("text")), KEYS)
    # feeds the scoring and the first sample's columns
    c = cut_lineage(c.select(*KEYS, F.coalesce("clean", "text").alias("clean_text")))
    v = e.where("valid").join(c, KEYS)
    first = M.first_valid_candidate(v).select("prompt_id", F.col("description").alias("review"), F.col("clean_text").alias("review_clean"))
    v = M.truncate_to_ref(v, "clean_text", "reference", "text")
    refs = e.select("prompt_id", "reference").dropDuplicates(["prompt_id"])
    bg = M.bleu_gleu(v, refs).withColumnRenamed("bleu", "bleu_clean").withColumnRenamed("gleu", "gleu_clean")
    raw = M.score_candidates(e)
    out = M.candidate_mean_std(raw.join(bg, KEYS), M.METRICS + ["bleu_clean", "gleu_clean"])
    return round_cols(out, [c for c in out.columns if c != "prompt_id"]).join(first, "prompt_id")
