"""Registered review -> alignment -> storyboard queries, plus structured-facts and JSON sources
(T6, T7, T9, T10, R9, J6, W1-W5, W9, W10, T19, T20, S3, S13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prodtext.functions import constants as K
from prodtext.functions.text import WS
from prodtext.operators import align as AL
from prodtext.operators import catalog as CA
from prodtext.operators import render as R
from prodtext.operators import storyboard as SB
from prodtext.operators.spans import round_cols
from prodtext.plans import catalog_queries as CQ
from prodtext.plans import sqlparts as Q
from prodtext.plans.registry import register
from prodtext.session import cut_lineage
from prodtext.sources.fixtures import duck_with, register_fixtures

INTRO_SQL = f"'{K.INTRO[0]}' || title || '{K.INTRO[1]}'"
TEXT_THRESHOLD = 0.25
VEC_THRESHOLD = 0.25  # driver vectors: 0.5 is almost never exceeded (see README)


def _fx(spark, sf_dir, names):
    register_fixtures(spark, sf_dir, names)
    return {n: spark.table(n) for n in names}


def paragraphs(spark, sf_dir):
    return AL.parse_review_paragraphs(_fx(spark, sf_dir, ["reviews"])["reviews"])


def product_features(spark, sf_dir):
    f = CQ._fx(spark, sf_dir)
    return R.extract_features(CQ.category_prompts(f))


def text_alignment(spark, sf_dir):
    # sentences are made from the reviews twice, which are dealt out by product once
    sents = AL.paragraph_sentences(paragraphs(spark, sf_dir))
    feats = cut_lineage(R.feature_sentences(product_features(spark, sf_dir)))
    pairs = AL.text_pairs(sents, feats, TEXT_THRESHOLD)
    return AL.align_features(sents, pairs)


def vector_alignment(spark, sf_dir, threshold=VEC_THRESHOLD):
    f = _fx(spark, sf_dir, ["sentence_vectors", "feature_vectors"])
    pairs = AL.embedding_pairs(f["sentence_vectors"], f["feature_vectors"], threshold)
    sents = f["sentence_vectors"].select("product_id", "para_ord", "sent_ord")
    return AL.align_features(sents, pairs)


# ---------------------------------------------------------------- DuckDB side
PARA_CTES = f"""
rl AS (SELECT product_id, unnest(string_split(review, chr(10))) AS line,
              unnest(generate_series(0, len(string_split(review, chr(10))) - 1)) AS ln FROM reviews),
rl1 AS (SELECT *, regexp_matches(line, '^{WS}*(#|<h2>|<h4>)') AS is_h FROM rl WHERE ln > 0),
rl2 AS (SELECT *, sum(CAST(is_h AS INT)) OVER (PARTITION BY product_id ORDER BY ln
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS para_ord,
               regexp_replace(replace(replace(replace(replace(replace(line, '#', ''), '<h2>', ''), '</h2>', ''),
                 '<h4>', ''), '</h4>', ''), '^{WS}+|{WS}+\\z', '', 'g') AS clean FROM rl1),
paras AS (
  SELECT product_id, CAST(para_ord AS INT) AS para_ord,
         arg_min(CASE WHEN is_h THEN clean END, CASE WHEN is_h THEN ln END) AS para_title,
         coalesce(string_agg(CASE WHEN NOT is_h AND clean <> '' THEN clean END, ' ' ORDER BY ln), '') AS para_text
  FROM rl2 WHERE para_ord > 0 GROUP BY 1, 2)"""

VEC_CTES = f"""
epairs AS (
  SELECT s.product_id, s.para_ord, s.sent_ord, f.feature,
         list_cosine_similarity(CAST(s.vec AS DOUBLE[]), CAST(f.vec AS DOUBLE[])) AS sim
  FROM sentence_vectors s JOIN feature_vectors f ON s.product_id = f.product_id),
ehits AS (SELECT * FROM epairs WHERE sim > {VEC_THRESHOLD}),
efirst AS (SELECT product_id, para_ord, feature, min(sent_ord) AS sent_ord FROM ehits GROUP BY 1, 2, 3),
eper AS (SELECT product_id, para_ord, sent_ord, string_agg(feature, ',' ORDER BY feature) AS features
         FROM efirst GROUP BY 1, 2, 3),
ealign AS (
  SELECT s.product_id, s.para_ord, s.sent_ord, coalesce(e.features, '') AS features
  FROM sentence_vectors s LEFT JOIN eper e
    ON s.product_id = e.product_id AND s.para_ord = e.para_ord AND s.sent_ord = e.sent_ord)"""

FEAT_CTES = f"""
feats0 AS (
  SELECT product_id, group_ord,
         unnest(string_split(regexp_extract(input, '<FEAT_START>([^\\n]*?)<FEAT_END>', 1), '<NEXT_FEAT>')) AS raw,
         unnest(generate_series(1, len(string_split(regexp_extract(input, '<FEAT_START>([^\\n]*?)<FEAT_END>', 1),
                '<NEXT_FEAT>')))) AS feat_ord
  FROM cat_prompts),
feats AS (
  SELECT product_id, group_ord, CAST(feat_ord AS INT) AS feat_ord,
         array_to_string(list_filter(regexp_split_to_array(raw, '{WS}+'), lambda w: w <> ''), ' ') AS feature
  FROM feats0),
feats1 AS (SELECT * FROM feats WHERE feature <> '')"""



TEXT_CTES = f"""
sents AS (
  SELECT product_id, para_ord, para_title,
         CAST(row_number() OVER (PARTITION BY product_id, para_ord ORDER BY k) AS INT) AS sent_ord, piece AS sentence
  FROM (SELECT product_id, para_ord, para_title, unnest(string_split(para_text, '.')) AS piece,
               unnest(generate_series(1, len(string_split(para_text, '.')))) AS k FROM paras) x
  WHERE piece <> ''),
fs AS (SELECT DISTINCT product_id, feature, 'this product has ' || feature || '.' AS feature_sentence FROM feats1),
stok AS (
  SELECT product_id, para_ord, sent_ord, token, count(*) AS c FROM (
    SELECT product_id, para_ord, sent_ord,
           unnest(list_filter(regexp_split_to_array(lower(sentence), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS token
    FROM sents WHERE product_id IN (SELECT product_id FROM fs)) x GROUP BY 1, 2, 3, 4),
ftok AS (
  SELECT product_id, feature, token, count(*) AS c FROM (
    SELECT product_id, feature,
           unnest(list_filter(regexp_split_to_array(lower(feature_sentence), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS token
    FROM fs) x GROUP BY 1, 2, 3),
sn AS (SELECT product_id, para_ord, sent_ord, sqrt(sum(c * c)) AS sn FROM stok GROUP BY 1, 2, 3),
fn AS (SELECT product_id, feature, sqrt(sum(c * c)) AS fn FROM ftok GROUP BY 1, 2),
dots AS (
  SELECT s.product_id, s.para_ord, s.sent_ord, f.feature, sum(s.c * f.c) AS dot
  FROM stok s JOIN ftok f ON s.product_id = f.product_id AND s.token = f.token GROUP BY 1, 2, 3, 4),
tpairs AS (
  SELECT d.product_id, d.para_ord, d.sent_ord, d.feature
  FROM dots d JOIN sn ON d.product_id = sn.product_id AND d.para_ord = sn.para_ord AND d.sent_ord = sn.sent_ord
  JOIN fn ON d.product_id = fn.product_id AND d.feature = fn.feature
  WHERE d.dot / (sn.sn * fn.fn) > {TEXT_THRESHOLD}),
tfirst AS (SELECT product_id, para_ord, feature, min(sent_ord) AS sent_ord FROM tpairs GROUP BY 1, 2, 3),
tfeat AS (
  SELECT product_id, para_ord, sent_ord, feature,
         row_number() OVER (PARTITION BY product_id, para_ord, sent_ord ORDER BY feature) AS fi FROM tfirst),
talign AS (
  SELECT s.product_id, s.para_ord, s.sent_ord, s.para_title, s.sentence,
         coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM tfeat t
                   WHERE t.product_id = s.product_id AND t.para_ord = s.para_ord AND t.sent_ord = s.sent_ord), '') AS features
  FROM sents s),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, para_ord ORDER BY sent_ord, fi) AS rnk FROM tfeat) x
  WHERE rnk <= 7),
story AS (
  SELECT s.product_id, CAST(row_number() OVER (PARTITION BY s.product_id ORDER BY s.para_ord, s.sent_ord) - 1 AS INT) AS slide_no,
         s.para_title AS title,
         coalesce((SELECT string_agg(c.feature, ' | ' ORDER BY c.rnk) FROM capped c
                   WHERE c.product_id = s.product_id AND c.para_ord = s.para_ord AND c.sent_ord <= s.sent_ord), '') AS captions,
         (SELECT CAST(count(*) AS INT) FROM capped c
          WHERE c.product_id = s.product_id AND c.para_ord = s.para_ord AND c.sent_ord <= s.sent_ord) AS n_captions,
         s.sentence AS narration
  FROM sents s),
intro AS (
  SELECT product_id, CAST(-1 AS INT) AS slide_no,
         {INTRO_SQL} AS narration
  FROM catalog WHERE product_id IN (SELECT product_id FROM reviews)),
allslides AS (SELECT product_id, slide_no, narration FROM intro UNION ALL SELECT product_id, slide_no, narration FROM story),
timeline AS (
  SELECT product_id, slide_no, length(narration) / 15.0 AS duration_s,
         coalesce(sum(length(narration)) OVER (PARTITION BY product_id ORDER BY slide_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0 AS start_s,
         sum(length(narration)) OVER (PARTITION BY product_id) / 15.0 + 3.0 AS music_s
  FROM allslides)"""

_SW = CQ._w(CQ.CAT_FIX + ["reviews"], extra=Q.CATEGORY_CTES + "," + FEAT_CTES + "," + PARA_CTES + "," + TEXT_CTES)

@register("parse_review_paragraphs", duck_with(["reviews"]) + "," + PARA_CTES + """
SELECT product_id, para_ord, para_title, para_text FROM paras""")
def q_parse_review_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir)


_CW = CQ._w(extra=Q.CATEGORY_CTES + "," + FEAT_CTES)


@register("extract_features", _CW + "SELECT product_id, group_ord, feat_ord, feature FROM feats1")
def q_extract_features(spark, sf_dir):
    return product_features(spark, sf_dir)


@register("feature_sentences", _CW + """
SELECT DISTINCT product_id, 'this product has ' || feature || '.' AS feature_sentence FROM feats1""")
def q_feature_sentences(spark, sf_dir):
    return R.feature_sentences(product_features(spark, sf_dir)).select("product_id", "feature_sentence")


@register("extract_title", CQ._w(extra=Q.CATEGORY_CTES + "," + Q.OVERVIEW_CTES) + """
SELECT product_id, regexp_extract(input, '<NAME_START> ([^\\n]*)<NAME_END>', 1) AS title FROM overview""")
def q_extract_title(spark, sf_dir):
    f = CQ._fx(spark, sf_dir)
    return R.extract_title(CQ.overview_prompts(f)).select("product_id", "title")


@register("assemble_review", CQ._w(extra=Q.CATEGORY_CTES + "," + Q.OVERVIEW_CTES) + """,
secs0 AS (SELECT c.product_id, c.group_ord, c.category, string_split(d.text, chr(10)) AS lines,
                 row_number() OVER (PARTITION BY c.product_id ORDER BY c.group_ord) - 1 AS r,
                 count(*) OVER (PARTITION BY c.product_id) AS n
          FROM cat_prompts c JOIN documents d ON c.product_id = CAST(d.doc_id AS VARCHAR)),
secs AS (SELECT product_id, group_ord, category,
                (SELECT string_agg(x.line, chr(10) ORDER BY x.k)
                 FROM (SELECT unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS k) x WHERE x.k % n = r) AS text
         FROM secs0),
ttl AS (SELECT product_id, regexp_extract(input, '<NAME_START> ([^\\n]*)<NAME_END>', 1) AS title FROM overview
        WHERE product_id IN (SELECT product_id FROM secs))
SELECT t.product_id, '# ' || t.title || chr(10) || chr(10) || coalesce(b.body, '') AS review
FROM ttl t LEFT JOIN (
  SELECT product_id, string_agg('<h2> ' || upper(category) || '</h2> ' || chr(10) || chr(10) || text || chr(10) || chr(10), ''
                                ORDER BY group_ord) AS body
  FROM secs GROUP BY 1) b ON t.product_id = b.product_id""")
def q_assemble_review(spark, sf_dir):
    f = CQ._fx(spark, sf_dir)
    docs = spark.table("documents").select(F.col("doc_id").cast("string").alias("product_id"), "text")
    prompts = CQ.category_prompts(f).select("product_id", "group_ord", "category")
    each = Window.partitionBy("product_id")
    prompts = prompts.withColumn("r", F.row_number().over(each.orderBy("group_ord")) - 1).withColumn("n", F.count(F.lit(1)).over(each))
    # every line of the text goes to one of the product's sections, in turn
    lines = F.filter(F.split("text", "\n", -1), lambda x, k: k % F.col("n") == F.col("r"))
    secs = prompts.join(CA.shuffled(docs), "product_id").select("product_id", "group_ord", "category",
                                                   F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("text"))
    titles = R.extract_title(CQ.overview_prompts(f)).select("product_id", "title").join(
        CA.shuffled(secs.select("product_id").distinct()), "product_id", "left_semi")
    return R.assemble_review(titles, secs)


@register("embedding_pairs", duck_with(["sentence_vectors", "feature_vectors"]) + "," + VEC_CTES + """
SELECT product_id, para_ord, sent_ord, feature, round(sim, 4) AS sim FROM ehits""")
def q_embedding_pairs(spark, sf_dir):
    f = _fx(spark, sf_dir, ["sentence_vectors", "feature_vectors"])
    return round_cols(AL.embedding_pairs(f["sentence_vectors"], f["feature_vectors"], VEC_THRESHOLD), ["sim"], 4)


@register("align_features", duck_with(["sentence_vectors", "feature_vectors"]) + "," + VEC_CTES + """
SELECT product_id, para_ord, sent_ord, features FROM ealign""")
def q_align_features(spark, sf_dir):
    a = vector_alignment(spark, sf_dir)
    return a.select("product_id", "para_ord", "sent_ord", F.array_join("features", ",").alias("features"))


@register("align_features_default", duck_with(["sentence_vectors", "feature_vectors"]) + ","
          + VEC_CTES.replace(f"sim > {VEC_THRESHOLD}", f"sim > {K.COSINE_THRESHOLD}") + """
SELECT product_id, para_ord, sent_ord, features FROM ealign""")
def q_align_features_default(spark, sf_dir):
    """The alignment at the operator's own threshold."""
    a = vector_alignment(spark, sf_dir, K.COSINE_THRESHOLD)
    return a.select("product_id", "para_ord", "sent_ord", F.array_join("features", ",").alias("features"))


@register("unmatched_sentences", duck_with(["sentence_vectors", "feature_vectors"]) + "," + VEC_CTES + """
SELECT product_id, para_ord, sent_ord,
       CAST(sum(CASE WHEN features = '' THEN 1 ELSE 0 END) OVER (PARTITION BY product_id ORDER BY para_ord, sent_ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS unmatched_no
FROM ealign""")
def q_unmatched_sentences(spark, sf_dir):
    u = AL.unmatched_sentences(vector_alignment(spark, sf_dir))
    return u.select("product_id", "para_ord", "sent_ord", F.col("unmatched_no").cast("bigint").alias("unmatched_no"))


@register("text_alignment", _SW + "SELECT product_id, para_ord, sent_ord, sentence, features FROM talign")
def q_text_alignment(spark, sf_dir):
    a = text_alignment(spark, sf_dir)
    return a.select("product_id", "para_ord", "sent_ord", "sentence", F.array_join("features", ",").alias("features"))


def _story(spark, sf_dir):
    return SB.storyboard(text_alignment(spark, sf_dir))


@register("storyboard", _SW + "SELECT product_id, slide_no, title, captions, narration FROM story")
def q_storyboard(spark, sf_dir):
    s = _story(spark, sf_dir)
    return s.select("product_id", "slide_no", "title", F.array_join("captions", " | ").alias("captions"), "narration")


@register("storyboard_captions", _SW + "SELECT product_id, slide_no, n_captions, captions FROM story")
def q_storyboard_captions(spark, sf_dir):
    s = _story(spark, sf_dir)
    return s.select("product_id", "slide_no", F.size("captions").cast("int").alias("n_captions"),
                    F.array_join("captions", " | ").alias("captions"))


def _models(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog", "reviews"])
    return SB.brand_model(f["catalog"]).join(CA.shuffled(f["reviews"].select("product_id")), "product_id", "left_semi")


@register("storyboard_intro", duck_with(["catalog", "reviews"]) + f"""
SELECT product_id, CAST(-1 AS INT) AS slide_no, title,
       {INTRO_SQL} AS narration
FROM catalog WHERE product_id IN (SELECT product_id FROM reviews)""")
def q_storyboard_intro(spark, sf_dir):
    return SB.storyboard_intro(_models(spark, sf_dir)).select("product_id", "slide_no", "title", "narration")


@register("slide_timeline", _SW + """
SELECT product_id, slide_no, round(duration_s, 6) AS duration_s, round(start_s, 6) AS start_s,
       round(music_s, 6) AS music_s FROM timeline""")
def q_slide_timeline(spark, sf_dir):
    slides = cut_lineage(_story(spark, sf_dir)).select("product_id", "slide_no", "title", "captions", "narration")
    allv = SB.storyboard_intro(_models(spark, sf_dir)).unionByName(slides)
    t = SB.slide_timeline(allv)
    return round_cols(t.select("product_id", "slide_no", "duration_s", "start_s", "music_s"),
                      ["duration_s", "start_s", "music_s"])


@register("brand_model", duck_with(["catalog"]) + "SELECT product_id, brand, title AS model FROM catalog")
def q_brand_model(spark, sf_dir):
    return SB.brand_model(_fx(spark, sf_dir, ["catalog"])["catalog"])


@register("json_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_json_props(spark, sf_dir):
    from prodtext.sources.tables import read_table
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k INT").getField("k").alias("k"))
