"""Registered corpus queries: dedupe, split, dictionary attributes, training records,
record file round trip and sequence packing (A1, A4, A13, A15, O3-O5, N8-N10, R10, S6-S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prodtext.functions import constants as K
from prodtext.functions.text import WS
from prodtext.operators import annotate as A
from prodtext.operators import corpus as CO
from prodtext.operators import render as R
from prodtext.plans import sqlparts as Q
from prodtext.plans.annotation_queries import ANN_CTES, gold_of
from prodtext.plans.registry import register
from prodtext.session import cut_lineage, scratch_path, shuffles_freed
from prodtext.sources import sinks as SK
from prodtext.sources.fixtures import duck_with, register_fixtures


def _fx(spark, sf_dir):
    register_fixtures(spark, sf_dir, ["descriptions", "tagged"])
    return spark.table("descriptions"), spark.table("tagged")


def deduped(desc):
    return CO.dedupe_descriptions(desc)


def described_attrs(spark, desc, tagged):
    """Dictionary learned from the tagged corpus, applied to every description."""
    d = A.gazetteer_train(gold_of(tagged), fold_col=None)
    text = desc.where(F.col("description").isNotNull()).select("doc_id", F.col("description").alias("text"))
    return A.attr_list(A.gazetteer_predict(text, d, fold_col=None))


def records(spark, sf_dir, fill: bool = True):
    """Deduplicated descriptions with split and attributes; ``fill``: no attribute is an empty list."""
    desc, tagged = _fx(spark, sf_dir)
    # written, so that the shuffles of texts which find the attributes end before those of the records begin
    attrs = cut_lineage(described_attrs(spark, desc, tagged))
    d = CO.split_train_valid_test(deduped(desc)).join(attrs, "doc_id", "left")
    return d.withColumn("att_list", F.coalesce("att_list", F.array().cast("array<string>"))) if fill else d


# ---------------------------------------------------------------- DuckDB side
DEDUP = f"""
dd0 AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY {Q.bucket(42, 'doc_id')}, doc_id) AS rn
        FROM descriptions),
dd AS (SELECT doc_id, name, description FROM dd0 WHERE rn = 1),
sp AS (SELECT *, CASE WHEN {Q.bucket(42, 'doc_id')} % 10000 < 9000 THEN 'train'
                      WHEN {Q.bucket(42, 'doc_id')} % 10000 < 9800 THEN 'valid' ELSE 'test' END AS split FROM dd)"""

GAZ_ALL = """
dict AS (
  SELECT lower(substring(s.text, g.start + 1, g."end" - g.start)) AS surface_lc, g.label,
         max(len(string_split(lower(substring(s.text, g.start + 1, g."end" - g.start)), ' '))) AS n_tokens
  FROM gold_spans g JOIN stripped s ON g.doc_id = s.doc_id GROUP BY 1, 2),
dtoks0 AS (SELECT doc_id, unnest(string_split(description, ' ')) AS tok,
                  unnest(generate_series(0, len(string_split(description, ' ')) - 1)) AS i
           FROM descriptions WHERE description IS NOT NULL),
dtoks AS (SELECT *, coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                 tok || ' ' || lead(tok, 1) OVER (PARTITION BY doc_id ORDER BY i) AS g2,
                 tok || ' ' || lead(tok, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' '
                    || lead(tok, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g3
          FROM dtoks0),
dgrams AS (SELECT doc_id, start, 1 AS n, tok AS gram FROM dtoks
           UNION ALL SELECT doc_id, start, 2, g2 FROM dtoks WHERE (SELECT max(n_tokens) FROM dict) >= 2
           UNION ALL SELECT doc_id, start, 3, g3 FROM dtoks WHERE (SELECT max(n_tokens) FROM dict) >= 3),
dcand AS (SELECT g.doc_id, g.start, g.n, g.gram, min(d.label) AS label
          FROM dgrams g JOIN dict d ON lower(g.gram) = d.surface_lc
          WHERE g.gram IS NOT NULL AND g.gram <> '' GROUP BY 1, 2, 3, 4),
dcand2 AS (SELECT *, max(start + length(gram)) OVER (PARTITION BY doc_id ORDER BY start, start + length(gram) DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM dcand),
dpred AS (SELECT doc_id, label, gram AS entity FROM dcand2 WHERE prev_end IS NULL OR prev_end < start + length(gram)),
attrs AS (
  SELECT doc_id, string_agg(DISTINCT a, ' <NEXT_FEAT> ' ORDER BY a) AS attributes
  FROM (SELECT doc_id, CASE WHEN starts_with(entity, '(') OR starts_with(entity, ')')
                            THEN replace(entity, '(', '') ELSE entity END AS a
        FROM dpred WHERE label = 'ATTR') x GROUP BY 1),
recs AS (
  SELECT s.doc_id, s.split,
         '<OVERV_START> <NAME_START> ' || s.name || ' <NAME_END> <FEAT_START> ' || coalesce(a.attributes, '')
         || ' <FEAT_END> <DESCR_START> ' || s.description || ' <DESCR_END> <OVERV_END>' AS record
  FROM sp s LEFT JOIN attrs a ON s.doc_id = a.doc_id
  WHERE s.name IS NOT NULL AND s.description IS NOT NULL),
flat AS (SELECT replace(record, chr(10), '') AS record FROM recs),
parsed AS (
  SELECT split_part(record, ' <DESCR_START>', 1) AS originalInput,
    CASE WHEN regexp_matches(split_part(record, ' <DESCR_START>', 1), '<FEAT_START> ([^\\n]*?) <FEAT_END>')
      THEN replace(replace(replace(regexp_extract(split_part(record, ' <DESCR_START>', 1), '<FEAT_START> ([^\\n]*?) <FEAT_END>', 1),
           '<NEXT_FEAT>', '<br>'), 'br><h2>', ''), '</li><li>', '') END AS input,
    CASE WHEN regexp_matches(split_part(record, ' <DESCR_START>', 1), '<NAME_START> ([^\\n]*?) <NAME_END>')
      THEN regexp_extract(split_part(record, ' <DESCR_START>', 1), '<NAME_START> ([^\\n]*?) <NAME_END>', 1) END AS title,
    CASE WHEN regexp_matches(record, '<DESCR_START> ([^\\n]*?) <DESCR_END>')
      THEN regexp_extract(record, '<DESCR_START> ([^\\n]*?) <DESCR_END>', 1) END AS Description
  FROM flat)"""


def W(extra: str) -> str:
    return duck_with(["descriptions", "tagged"]) + "," + extra


ALL_CTES = ANN_CTES + "," + DEDUP + "," + GAZ_ALL


@register("dedupe_descriptions", W(DEDUP) + "SELECT doc_id, name, description FROM dd")
def q_dedupe_descriptions(spark, sf_dir):
    return deduped(_fx(spark, sf_dir)[0])


@register("dedupe_docs_ordered", duck_with(["descriptions"]) + """
SELECT min(doc_id) AS doc_id, description AS text FROM descriptions GROUP BY description""")
def q_dedupe_docs_ordered(spark, sf_dir):
    desc = _fx(spark, sf_dir)[0]
    return CO.dedupe_ordered(desc.select("doc_id", F.col("description").alias("text")))


@register("seeded_order", duck_with(["descriptions"]) + f"""
SELECT doc_id, {Q.bucket(42, 'doc_id')} AS shuffle_key FROM descriptions""")
def q_seeded_order(spark, sf_dir):
    return CO.seeded_order(_fx(spark, sf_dir)[0]).select("doc_id", "shuffle_key")


@register("split_train_valid_test", W(DEDUP) + "SELECT doc_id, split FROM sp")
def q_split(spark, sf_dir):
    return CO.split_train_valid_test(deduped(_fx(spark, sf_dir)[0])).select("doc_id", "split")


RANKED = f"""
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY {Q.bucket(42, 'doc_id')}, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM dd)"""


@register("split_exact", W(DEDUP + "," + RANKED) + """
SELECT doc_id, CASE WHEN r < n * 9 // 10 THEN 'train' WHEN r < n * 9 // 10 + (n - n * 9 // 10) * 8 // 10 THEN 'valid' ELSE 'test' END AS split FROM ranked""")
def q_split_exact(spark, sf_dir):
    return CO.split_exact(cut_lineage(deduped(_fx(spark, sf_dir)[0]).select("doc_id")))


@register("kfold_exact", W(DEDUP + "," + RANKED) + """
SELECT doc_id, CAST(CASE WHEN r < (n % 10) * (n // 10 + 1) THEN r // (n // 10 + 1) ELSE (r - n % 10) // greatest(n // 10, 1) END AS INT) AS fold FROM ranked""")
def q_kfold_exact(spark, sf_dir):
    return CO.kfold_exact(cut_lineage(deduped(_fx(spark, sf_dir)[0]).select("doc_id")))


@register("sample_exact", W(DEDUP + "," + RANKED) + "SELECT doc_id FROM ranked WHERE r < 100")
def q_sample_exact(spark, sf_dir):
    return CO.sample_exact(cut_lineage(deduped(_fx(spark, sf_dir)[0]).select("doc_id")), 100)


@register("split_counts", W(DEDUP) + "SELECT split, count(*) AS n FROM sp GROUP BY split")
def q_split_counts(spark, sf_dir):
    return CO.split_counts(CO.split_train_valid_test(deduped(_fx(spark, sf_dir)[0])))


@register("attr_list", W(ALL_CTES) + "SELECT doc_id, attributes FROM attrs")
def q_attr_list(spark, sf_dir):
    desc, tagged = _fx(spark, sf_dir)
    a = described_attrs(spark, desc, tagged)
    return a.select("doc_id", F.array_join("att_list", f" {K.NEXT_FEAT} ").alias("attributes"))


@register("render_training_record", W(ALL_CTES) + "SELECT doc_id, split, record FROM recs")
def q_render_training_record(spark, sf_dir):
    return R.render_training_record(records(spark, sf_dir)).select("doc_id", "split", "record")


@register("training_skip_count", W(ALL_CTES) + """
SELECT s.split, CAST(count_if(s.name IS NULL OR s.description IS NULL OR a.attributes IS NULL) AS BIGINT) AS skipped,
       CAST(count(*) AS BIGINT) AS total FROM sp s LEFT JOIN attrs a ON a.doc_id = s.doc_id GROUP BY s.split""")
def q_training_skip_count(spark, sf_dir):
    """Documents without any attribute keep a null list here, and are skipped like those
    without name or text."""
    return R.training_skip_count(records(spark, sf_dir, fill=False), by=["split"])


def _record_files(spark, sf_dir) -> str:
    """Write the rendered records as text (S9) into the shared checkpoint folder."""
    path = scratch_path(spark, "records")
    rendered = R.render_training_record(records(spark, sf_dir))
    with shuffles_freed(spark):
        SK.write_records(rendered, path, compression="gzip")
    return path


@register("parse_training_record", W(ALL_CTES) + "SELECT originalInput, input, title, Description FROM parsed")
def q_parse_training_record(spark, sf_dir):
    path = _record_files(spark, sf_dir)
    return CO.parse_training_record(CO.read_records(spark, path)).drop("reject_reason")


@register("pack_sequences", W(ALL_CTES) + f""",
toks AS (SELECT record, list_filter(regexp_split_to_array(record, '{WS}+'), lambda w: w <> '') AS t
         FROM recs),
tr AS (SELECT record, t[1:768] AS t FROM toks)
SELECT CAST(len(t) AS INT) AS n_tokens,
       array_to_string(list_concat(t, list_transform(range(768 - len(t)), lambda i: '<|PAD|>')), ' ') AS tokens,
       CAST(len(t) AS BIGINT) AS mask_sum FROM tr""")
def q_pack_sequences(spark, sf_dir):
    path = _record_files(spark, sf_dir)
    p = CO.pack_sequences(CO.read_model_inputs(spark, path))
    return p.select(F.size(F.filter("attention_mask", lambda m: m == 1)).cast("int").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("mask_sum"))
