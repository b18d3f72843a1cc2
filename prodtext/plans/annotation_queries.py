"""Registered annotation and extraction-quality queries (N*, J4, J5, A5-A9, X1-X3, O5, N11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prodtext.operators import annotate as A
from prodtext.operators import spans as S
from prodtext.plans import sqlparts as Q
from prodtext.plans.registry import register
from prodtext.session import cut_lineage
from prodtext.sources.fixtures import duck_with, register_fixtures

# Predictions standing in for a tagger's output: every matching branch occurs
# (exact, other label, partial right, partial left, touching, enclosing, two on one gold).
PRED_SQL = """
SELECT doc_id, start_pos AS {s}, end_pos AS {e}, label FROM (
  SELECT doc_id, {s} AS start_pos, {e} AS end_pos, label FROM gold_spans WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, {e}, {e} + 3, label FROM gold_spans WHERE doc_id % 5 = 0 AND span_ord % 2 = 1
  UNION ALL SELECT doc_id, {s}, {e}, CASE WHEN label = 'ATTR' THEN 'PROD' ELSE 'ATTR' END
            FROM gold_spans WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, {s} + 1, {e} + 2, label FROM gold_spans WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, {s}, {e}, label FROM gold_spans WHERE doc_id % 5 = 2 AND span_ord = 1
  UNION ALL SELECT doc_id, CASE WHEN {s} >= 2 THEN {s} - 2 ELSE 0 END, {s} + 1, label
            FROM gold_spans WHERE doc_id % 5 = 3
  UNION ALL SELECT doc_id, {s} - 1, {e} + 1, label FROM gold_spans WHERE doc_id % 5 = 4 AND {s} >= 1
) x"""


def pred_sql(engine: str) -> str:
    q = "`" if engine == "spark" else '"'
    return PRED_SQL.format(s=f"{q}start{q}", e=f"{q}end{q}")


def _fx(spark, sf_dir):
    register_fixtures(spark, sf_dir, ["tagged"])
    return spark.table("tagged")


def text_of(tagged):
    return A.strip_tags(tagged).select("doc_id", "text")


def gold_of(tagged, materialize: bool = False, with_entity: bool = True):
    g = A.gold_spans(A.entity_positions(tagged))
    if not with_entity:
        g = g.drop("entity")
    # gold spans feed several joins; a reliable checkpoint keeps them from being re-derived.
    return cut_lineage(g) if materialize else g


def folds_of(tagged):
    return S.kfold_assign(tagged.select("doc_id"))


def fixture_predictions(spark, gold):
    p = spark.sql(pred_sql("spark").replace("gold_spans", "{gold_spans}"), gold_spans=gold)
    w = Window.partitionBy("doc_id").orderBy("start", "end", "label")
    return p.withColumn("pred_ord", F.row_number().over(w))


def surfaces(spans, text):
    if "entity" in spans.columns:
        return spans.select("doc_id", *(["fold"] if "fold" in spans.columns else []), "label",
                            F.col("entity").alias("surface"))
    return spans.join(text, "doc_id").select(
        "doc_id", "label", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"))


# ---------------------------------------------------------------- DuckDB side
STRIP = ("replace(replace(replace(replace(replace(replace(tagged_text, '>.', '> .'), '>,', '> ,'), "
         "'<prod>', ''), '</prod>', ''), '<attr>', ''), '</attr>', '')")
FOLD = f"CAST({Q.bucket(42, 'doc_id')} % 10 AS INT)"
ANN_CTES = f"""
stripped AS (SELECT doc_id, {STRIP} AS text FROM tagged),
ents0 AS (
  SELECT doc_id, 1 AS tag_ord, 'PROD' AS label,
         unnest(regexp_extract_all(tagged_text, '<prod>([^\\n]+?)</prod>', 1)) AS entity,
         unnest(generate_series(1, len(regexp_extract_all(tagged_text, '<prod>([^\\n]+?)</prod>', 1)))) AS ent_ord
  FROM tagged
  UNION ALL
  SELECT doc_id, 2, 'ATTR', unnest(regexp_extract_all(tagged_text, '<attr>([^\\n]+?)</attr>', 1)),
         unnest(generate_series(1, len(regexp_extract_all(tagged_text, '<attr>([^\\n]+?)</attr>', 1))))
  FROM tagged),
ents AS (SELECT DISTINCT doc_id, tag_ord, label, entity FROM ents0),
pieces AS (
  SELECT e.doc_id, e.tag_ord, e.label, e.entity,
         unnest(string_split(s.text, e.entity)) AS piece,
         unnest(generate_series(0, len(string_split(s.text, e.entity)) - 1)) AS k,
         len(string_split(s.text, e.entity)) AS n
  FROM ents e JOIN stripped s ON e.doc_id = s.doc_id),
pos AS (
  SELECT doc_id, tag_ord, label, entity,
         CAST(sum(length(piece)) OVER (PARTITION BY doc_id, tag_ord, entity ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + k * length(entity) AS INT) AS start, k, n
  FROM pieces),
positions AS (SELECT doc_id, tag_ord, label, entity, start, CAST(start + length(entity) AS INT) AS "end"
              FROM pos WHERE k < n - 1),
gold_spans AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN label = 'ATTR' THEN 1 ELSE 2 END,
         start, "end") AS INT) AS span_ord, start, "end", label
  FROM (SELECT DISTINCT doc_id, start, "end", label FROM positions) x),
folds AS (SELECT doc_id, {FOLD} AS fold FROM tagged),
surf_gold AS (SELECT g.doc_id, g.label, substring(s.text, g.start + 1, g."end" - g.start) AS surface
              FROM gold_spans g JOIN stripped s ON g.doc_id = s.doc_id)"""

PRED_CTES = f"""
pred0 AS ({pred_sql('duckdb')}),
pred AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label) AS pred_ord FROM pred0)"""


def match_ctes(pred: str) -> str:
    return f"""
pairs AS (
  SELECT p.doc_id, p.pred_ord, g.span_ord, g.start AS g0, g."end" AS g1, g.label AS g_label
  FROM {pred} p JOIN gold_spans g ON p.doc_id = g.doc_id
  WHERE (g.start <= p."end" AND p."end" <= g."end") OR (g.start <= p.start AND p.start <= g."end")),
firsthit AS (SELECT doc_id, pred_ord, arg_min(span_ord, span_ord) AS gold_ord, arg_min(g0, span_ord) AS g0,
                    arg_min(g1, span_ord) AS g1, arg_min(g_label, span_ord) AS g_label
             FROM pairs GROUP BY 1, 2),
matches AS (
  SELECT p.doc_id, p.pred_ord, p.start, p."end", p.label, f.gold_ord, f.g0 AS gold_start, f.g1 AS gold_end,
         f.g_label AS gold_label,
         coalesce(p.start = f.g0 AND p."end" = f.g1, false) AS exact,
         coalesce(p.start = f.g0 AND p."end" = f.g1 AND p.label = f.g_label, false) AS perfect,
         f.gold_ord IS NOT NULL AND NOT coalesce(p.start = f.g0 AND p."end" = f.g1, false) AS partial,
         coalesce(p.label <> f.g_label, false) AS misclassified
  FROM {pred} p LEFT JOIN firsthit f ON p.doc_id = f.doc_id AND p.pred_ord = f.pred_ord),
hits AS (
  SELECT doc_id, gold_start AS start, gold_end AS "end",
         min(CASE WHEN label = 'ATTR' THEN 1 WHEN label = 'PROD' THEN 2 END) AS hit_rank
  FROM matches WHERE gold_ord IS NOT NULL AND label IN ('ATTR', 'PROD') GROUP BY 1, 2, 3),
missed AS (
  SELECT g.doc_id, g.start, g."end", g.label FROM
    (SELECT DISTINCT doc_id, start, "end", label, CASE WHEN label = 'ATTR' THEN 1 ELSE 2 END AS rnk FROM gold_spans) g
  LEFT JOIN hits h ON g.doc_id = h.doc_id AND g.start = h.start AND g."end" = h."end"
  WHERE h.hit_rank IS NULL OR h.hit_rank > g.rnk),
span_m AS (
  SELECT fold, tag, sum(correct2) AS correct2, sum(perfect) AS perfect, sum(partial) AS partial,
         sum(misclassified) AS misclassified, sum(total_t) AS total_t, sum(total_r) AS total_r, sum(missed) AS missed
  FROM (
    SELECT f.fold, m.label AS tag, count_if(exact) AS correct2, count_if(perfect) AS perfect,
           count_if(partial) AS partial, count_if(misclassified) AS misclassified, count(*) AS total_t,
           0 AS total_r, 0 AS missed
    FROM matches m JOIN folds f ON m.doc_id = f.doc_id WHERE m.label IN ('ATTR', 'PROD') GROUP BY 1, 2
    UNION ALL
    SELECT f.fold, g.label, 0, 0, 0, 0, 0, count(*), 0 FROM gold_spans g JOIN folds f ON g.doc_id = f.doc_id GROUP BY 1, 2
    UNION ALL
    SELECT f.fold, x.label, 0, 0, 0, 0, 0, 0, count(*) FROM missed x JOIN folds f ON x.doc_id = f.doc_id GROUP BY 1, 2
  ) u GROUP BY 1, 2),
surf_pred AS (SELECT p.doc_id, p.label, substring(s.text, p.start + 1, p."end" - p.start) AS surface
              FROM {pred} p JOIN stripped s ON p.doc_id = s.doc_id),
r_set AS (SELECT DISTINCT doc_id, label, lower(surface) AS s FROM surf_gold),
t_set0 AS (SELECT DISTINCT doc_id, label, lower(surface) AS s FROM surf_pred WHERE doc_id IN (SELECT doc_id FROM folds)),
t_set AS (SELECT * FROM t_set0 WHERE label = 'ATTR'
          UNION ALL SELECT * FROM t_set0 WHERE label = 'PROD'
            AND doc_id IN (SELECT doc_id FROM surf_gold WHERE label = 'PROD')),
set_j AS (
  SELECT coalesce(r.doc_id, t.doc_id) AS doc_id, coalesce(r.label, t.label) AS label,
         r.s IS NOT NULL AS in_r, t.s IS NOT NULL AS in_t
  FROM r_set r FULL OUTER JOIN t_set t ON r.doc_id = t.doc_id AND r.label = t.label AND r.s = t.s),
set_m AS (
  SELECT f.fold, j.label AS tag, count_if(in_r AND in_t) AS correct, count_if(in_r AND NOT in_t) AS missed_init,
         count_if(in_t AND NOT in_r) AS FT_init, count_if(in_t) AS total_t_set, count_if(in_r) AS total_r_set
  FROM set_j j JOIN folds f ON j.doc_id = f.doc_id GROUP BY 1, 2),
grid AS (SELECT DISTINCT fold, unnest(['ATTR', 'PROD']) AS tag FROM folds),
fold_metrics AS (
  SELECT g.fold, g.tag,
    CAST(coalesce(s.correct, 0) AS BIGINT) AS correct, CAST(coalesce(s.missed_init, 0) AS BIGINT) AS missed_init,
    CAST(coalesce(s.FT_init, 0) AS BIGINT) AS FT_init, CAST(coalesce(p.correct2, 0) AS BIGINT) AS correct2,
    CAST(coalesce(p.perfect, 0) AS BIGINT) AS perfect, CAST(coalesce(p.partial, 0) AS BIGINT) AS partial,
    CAST(coalesce(p.missed, 0) AS BIGINT) AS missed,
    CAST(coalesce(p.total_t, 0) - coalesce(p.correct2, 0) - coalesce(p.partial, 0) AS BIGINT) AS FT,
    CAST(coalesce(p.misclassified, 0) AS BIGINT) AS misclassified, CAST(coalesce(p.total_t, 0) AS BIGINT) AS total_t,
    CAST(coalesce(p.total_r, 0) AS BIGINT) AS total_r, CAST(coalesce(s.total_t_set, 0) AS BIGINT) AS total_t_set,
    CAST(coalesce(s.total_r_set, 0) AS BIGINT) AS total_r_set
  FROM grid g LEFT JOIN set_m s ON g.fold = s.fold AND g.tag = s.tag
  LEFT JOIN span_m p ON g.fold = p.fold AND g.tag = p.tag),
rates AS (
  SELECT fold, tag,
    correct / nullif(total_t_set, 0) AS correct, FT_init / nullif(total_t_set, 0) AS FT_init,
    missed_init / nullif(total_r_set, 0) AS missed_init, correct2 / nullif(total_t, 0) AS correct2,
    partial / nullif(total_t, 0) AS partial, perfect / nullif(total_t, 0) AS perfect, FT / nullif(total_t, 0) AS FT,
    misclassified / nullif(total_t, 0) AS misclassified, missed / nullif(total_r, 0) AS missed,
    CAST(total_t AS DOUBLE) AS total_t, CAST(total_r AS DOUBLE) AS total_r,
    CAST(total_t_set AS DOUBLE) AS total_t_set, CAST(total_r_set AS DOUBLE) AS total_r_set
  FROM fold_metrics),
rates2 AS (SELECT *, correct + partial AS correct_plus_partial, correct2 + partial AS correct2_plus_partial FROM rates),
mean_std AS (
  SELECT tag, metric, avg(value) AS mean, stddev_samp(value) AS std FROM (
    UNPIVOT rates2 ON {", ".join(S.RATE_COLS)} INTO NAME metric VALUE value) u
  GROUP BY 1, 2)"""


def W(extra: str) -> str:
    return duck_with(["tagged"]) + "," + extra


# ---------------------------------------------------------------- registrations
@register("strip_tags", W(ANN_CTES) + "SELECT doc_id, text FROM stripped")
def q_strip_tags(spark, sf_dir):
    return text_of(_fx(spark, sf_dir))


@register("tagged_entities", W(ANN_CTES) + "SELECT doc_id, label, CAST(ent_ord AS INT) AS ent_ord, entity FROM ents0")
def q_tagged_entities(spark, sf_dir):
    return A.tagged_entities(_fx(spark, sf_dir)).select("doc_id", "label", "ent_ord", "entity")


@register("entity_positions", W(ANN_CTES) + 'SELECT doc_id, label, entity, start, "end" FROM positions')
def q_entity_positions(spark, sf_dir):
    return A.entity_positions(_fx(spark, sf_dir)).select("doc_id", "label", "entity", "start", "end")


@register("gold_spans", W(ANN_CTES) + 'SELECT doc_id, span_ord, start, "end", label FROM gold_spans')
def q_gold_spans(spark, sf_dir):
    return gold_of(_fx(spark, sf_dir), with_entity=False)


@register("gold_table", W(ANN_CTES) + """
SELECT s.doc_id AS id, s.text AS Description,
  coalesce(string_agg(CASE WHEN g.label = 'ATTR' THEN substring(s.text, g.start + 1, g."end" - g.start) END, ' | ' ORDER BY g.span_ord), '') AS attributes,
  coalesce(string_agg(CASE WHEN g.label = 'PROD' THEN substring(s.text, g.start + 1, g."end" - g.start) END, ' | ' ORDER BY g.span_ord), '') AS product,
  coalesce(string_agg(CASE WHEN g.label = 'ATTR' THEN CAST(g.start AS VARCHAR) || ':' || CAST(g."end" AS VARCHAR) || ':' || g.label END, ' | ' ORDER BY g.span_ord), '') AS attributes_pos,
  coalesce(string_agg(CASE WHEN g.label = 'PROD' THEN CAST(g.start AS VARCHAR) || ':' || CAST(g."end" AS VARCHAR) || ':' || g.label END, ' | ' ORDER BY g.span_ord), '') AS product_pos
FROM stripped s LEFT JOIN gold_spans g ON s.doc_id = g.doc_id GROUP BY s.doc_id, s.text""")
def q_gold_table(spark, sf_dir):
    t = _fx(spark, sf_dir)
    g = A.gold_table(text_of(t), gold_of(t))

    def pos(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.start.cast("string"), x.end.cast("string"), x.label)), " | ")
    return g.select("id", "Description",
                    F.coalesce(F.array_join("Attributes", " | "), F.lit("")).alias("attributes"),
                    F.coalesce(F.array_join("Product", " | "), F.lit("")).alias("product"),
                    F.coalesce(pos(F.col("Attributes_pos")), F.lit("")).alias("attributes_pos"),
                    F.coalesce(pos(F.col("Product_pos")), F.lit("")).alias("product_pos"))


@register("kfold_assign", W(ANN_CTES) + "SELECT doc_id, fold FROM folds")
def q_kfold_assign(spark, sf_dir):
    return folds_of(_fx(spark, sf_dir))


@register("span_match", W(ANN_CTES + "," + PRED_CTES + "," + match_ctes("pred")) + """
SELECT doc_id, CAST(pred_ord AS INT) AS pred_ord, start, "end", label, gold_ord, exact, perfect, partial, misclassified
FROM matches""")
def q_span_match(spark, sf_dir):
    t = _fx(spark, sf_dir)
    gold = gold_of(t, True)
    m = S.span_match(fixture_predictions(spark, gold), gold)
    return m.select("doc_id", F.col("pred_ord").cast("int").alias("pred_ord"), "start", "end", "label", "gold_ord",
                    "exact", "perfect", "partial", "misclassified")


@register("missed_spans", W(ANN_CTES + "," + PRED_CTES + "," + match_ctes("pred")) + """
SELECT doc_id, start, "end", label FROM missed""")
def q_missed_spans(spark, sf_dir):
    t = _fx(spark, sf_dir)
    gold = gold_of(t, True)
    return S.missed_spans(S.span_match(fixture_predictions(spark, gold), gold), gold)


def fixture_fold_metrics(spark, sf_dir):
    t = _fx(spark, sf_dir)
    text, gold, folds = cut_lineage(text_of(t)), gold_of(t, True), folds_of(t)
    pred = fixture_predictions(spark, gold)
    m = S.span_match(pred, gold)
    sm = S.span_metrics(m, gold, folds)
    em = S.entity_set_metrics(surfaces(gold, text), surfaces(pred, text), folds)
    return S.fold_metrics(em, sm, folds)


_FM = W(ANN_CTES + "," + PRED_CTES + "," + match_ctes("pred"))


@register("span_metrics", _FM + """
SELECT fold, tag, correct2, perfect, partial, FT, misclassified, missed, total_t, total_r FROM fold_metrics""")
def q_span_metrics(spark, sf_dir):
    return fixture_fold_metrics(spark, sf_dir).select(
        "fold", "tag", "correct2", "perfect", "partial", "FT", "misclassified", "missed", "total_t", "total_r")


@register("entity_set_metrics", _FM + """
SELECT fold, tag, correct, missed_init, FT_init, total_t_set, total_r_set FROM fold_metrics""")
def q_entity_set_metrics(spark, sf_dir):
    return fixture_fold_metrics(spark, sf_dir).select(
        "fold", "tag", "correct", "missed_init", "FT_init", "total_t_set", "total_r_set")


RATE_SEL = ", ".join(f"round({c}, 6) AS {c}" for c in S.RATE_COLS)


@register("fold_rates", _FM + f"SELECT fold, tag, {RATE_SEL} FROM rates2")
def q_fold_rates(spark, sf_dir):
    return S.round_cols(S.fold_rates(fixture_fold_metrics(spark, sf_dir)), S.RATE_COLS)


@register("tag_mean_std", _FM + "SELECT tag, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM mean_std")
def q_tag_mean_std(spark, sf_dir):
    return S.round_cols(S.tag_mean_std(S.fold_rates(fixture_fold_metrics(spark, sf_dir))), ["mean", "std"])


# ---------------------------------------------------------------- dictionary extractor, k-fold
GAZ_CTES = """
dict AS (
  SELECT lower(substring(s.text, g.start + 1, g."end" - g.start)) AS surface_lc, g.label,
         list_sort(list(DISTINCT f.fold)) AS folds,
         max(len(string_split(lower(substring(s.text, g.start + 1, g."end" - g.start)), ' '))) AS n_tokens
  FROM gold_spans g JOIN stripped s ON g.doc_id = s.doc_id JOIN folds f ON f.doc_id = g.doc_id GROUP BY 1, 2),
toks0 AS (SELECT s.doc_id, f.fold, unnest(string_split(s.text, ' ')) AS tok,
                 unnest(generate_series(0, len(string_split(s.text, ' ')) - 1)) AS i
          FROM stripped s JOIN folds f ON s.doc_id = f.doc_id),
toks AS (SELECT *, coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                tok || ' ' || lead(tok, 1) OVER (PARTITION BY doc_id ORDER BY i) AS g2,
                tok || ' ' || lead(tok, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' '
                    || lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g3
         FROM toks0),
grams AS (SELECT doc_id, fold, start, 1 AS n, tok AS gram FROM toks
          UNION ALL SELECT doc_id, fold, start, 2, g2 FROM toks WHERE (SELECT max(n_tokens) FROM dict) >= 2
          UNION ALL SELECT doc_id, fold, start, 3, g3 FROM toks WHERE (SELECT max(n_tokens) FROM dict) >= 3),
cand AS (
  SELECT g.doc_id, g.fold, g.start, g.n, g.gram, min(d.label) AS label
  FROM grams g JOIN dict d ON lower(g.gram) = d.surface_lc
  WHERE g.gram IS NOT NULL AND g.gram <> '' AND list_filter(d.folds, lambda x: x <> g.fold) <> []
  GROUP BY 1, 2, 3, 4, 5),
cand2 AS (SELECT *, start + length(gram) AS "end",
                 max(start + length(gram)) OVER (PARTITION BY doc_id ORDER BY start, start + length(gram) DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM cand),
gaz AS (SELECT doc_id, fold, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", label, gram AS entity
        FROM cand2 WHERE prev_end IS NULL OR prev_end < "end"),
gpred AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label) AS pred_ord FROM gaz)"""


def in_folds(rows, folds):
    """``rows`` joined with ``folds`` by id, without a shuffle of ``rows``: the fold follows from the id,
    and only ids that come more than once are joined, for the number of rows that they make."""
    often = cut_lineage(folds.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").withColumnRenamed("count", "_n"))
    out = S.kfold_assign(rows.where("doc_id IS NOT NULL"))
    if often.isEmpty():
        return out
    n = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long"))))
    return out.join(often, "doc_id", "left").withColumn("_n", n).drop("_n")


def gazetteer_predictions(t, gold=None, text=None):
    text = text if text is not None else text_of(t)
    folds = folds_of(t)
    gold = gold if gold is not None else gold_of(t)
    tf = in_folds(text, folds)
    d = A.gazetteer_train(gold, folds)
    return A.gazetteer_predict(tf, d)


@register("gazetteer_train", W(ANN_CTES + "," + GAZ_CTES) + """
SELECT surface_lc, label, array_to_string(folds, ',') AS folds, CAST(n_tokens AS INT) AS n_tokens FROM dict""")
def q_gazetteer_train(spark, sf_dir):
    t = _fx(spark, sf_dir)
    d = A.gazetteer_train(gold_of(t), folds_of(t))
    return d.select("surface_lc", "label", F.array_join(F.transform("folds", lambda x: x.cast("string")), ",").alias("folds"),
                    F.col("n_tokens").cast("int").alias("n_tokens"))


@register("gazetteer_predict", W(ANN_CTES + "," + GAZ_CTES) + """
SELECT doc_id, fold, start, "end", label, entity FROM gaz""")
def q_gazetteer_predict(spark, sf_dir):
    return gazetteer_predictions(_fx(spark, sf_dir)).select("doc_id", "fold", "start", "end", "label", "entity")


@register("kfold_extraction_quality",
          W(ANN_CTES + "," + GAZ_CTES + "," + match_ctes("gpred").replace("mean_std", "mean_std")) + """
SELECT tag, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM mean_std""")
def q_kfold_extraction_quality(spark, sf_dir):
    t = _fx(spark, sf_dir)
    folds = folds_of(t)
    text = text_of(t)
    # gold spans and predictions carry their document's fold: no fold joins downstream
    gold = cut_lineage(gold_of(t).join(folds, "doc_id"))
    pred = cut_lineage(gazetteer_predictions(t, gold.drop("fold"), text))
    pred = pred.withColumn("pred_ord", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("start", "end", "label")))
    m = S.span_match(pred, gold)
    sm = S.span_metrics(m, gold, folds)
    em = S.entity_set_metrics(surfaces(gold, text), surfaces(pred, text), folds)
    fm = S.fold_metrics(em, sm, folds)
    return S.round_cols(S.tag_mean_std(S.fold_rates(fm)), ["mean", "std"])
