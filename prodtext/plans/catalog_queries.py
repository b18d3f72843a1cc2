"""Registered catalog -> prompt queries (P*, R*), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from prodtext.operators import catalog as C
from prodtext.operators import render as R
from prodtext.plans import sqlparts as Q
from prodtext.plans.registry import register
from prodtext.sources.fixtures import DROP_COLUMNS, duck_with, register_fixtures

CAT_FIX = ["catalog", "specs_long", "features", "rules", "whitelist", "blacklist", "groups"]


def _fx(spark, sf_dir, names=CAT_FIX):
    register_fixtures(spark, sf_dir, names)
    return {n: spark.table(n) for n in names}


def _w(names=CAT_FIX, extra: str = "") -> str:
    w = duck_with(names)
    return w + ("," + extra if extra else "")


# ---- P1 / J9: semi join with ids that lineitem data derives (returned parts) ----------------
@register("select_by_id", _w(["catalog"]) + """
SELECT product_id, title, brand, schema FROM catalog
WHERE product_id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')""")
def q_select_by_id(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog"])
    ids = spark.table("lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").cast("string").alias("product_id"))
    return C.select_by_id(f["catalog"], ids).select("product_id", "title", "brand", "schema")


@register("select_by_schema", _w(["catalog"]) + """
SELECT product_id, title, brand, schema FROM catalog WHERE schema = 'medium'""")
def q_select_by_schema(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog"])
    return C.select_by_schema(f["catalog"], "medium").select("product_id", "title", "brand", "schema")


@register("select_by_schema_limit", _w(["catalog"]) + """
SELECT product_id, title, brand, schema FROM catalog WHERE schema = 'medium' ORDER BY product_id LIMIT 25""")
def q_select_by_schema_limit(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog"])
    return C.select_by_schema(f["catalog"], "medium", 25).select("product_id", "title", "brand", "schema")


@register("sample_products", _w(["catalog"]) + f"""
SELECT product_id, title, brand, schema FROM catalog WHERE schema = 'standard'
ORDER BY {Q.bucket(42, 'product_id')}, product_id LIMIT 20""")
def q_sample_products(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog"])
    return C.sample_products(f["catalog"], 20, "standard").select("product_id", "title", "brand", "schema")


@register("drop_blacklisted", _w(["catalog"]) + "SELECT product_id, title, brand, schema FROM catalog")
def q_drop_blacklisted(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog"])
    return C.drop_blacklisted(f["catalog"], DROP_COLUMNS)


@register("spec_filter", _w(["specs_long"]) + f"""
SELECT product_id, spec_ord, spec_key, spec_value FROM specs_long WHERE {Q.SPEC_FILTER}""")
def q_spec_filter(spark, sf_dir):
    f = _fx(spark, sf_dir, ["specs_long"])
    return C.spec_filter(f["specs_long"])


@register("spec_filter_map", _w(["specs_long"]) + f"""
SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY spec_ord) AS INT) AS spec_ord, spec_key, spec_value
FROM specs_long WHERE {Q.SPEC_FILTER}""")
def q_spec_filter_map(spark, sf_dir):
    """The filter on specs held as a map, in insertion order."""
    specs = _fx(spark, sf_dir, ["specs_long"])["specs_long"]
    entries = F.transform(F.array_sort(F.collect_list(F.struct("spec_ord", "spec_key", "spec_value"))), lambda x: F.struct(x["spec_key"], x["spec_value"]))
    maps = specs.groupBy("product_id").agg(F.map_from_entries(entries).alias("specs"))
    return C.specs_from_map(C.spec_filter_map(maps))


@register("spec_whitelist", _w() + f"""
SELECT s.product_id, CAST(w.ord AS INT) AS spec_ord, s.spec_key, s.spec_value
FROM specs_long s JOIN catalog c ON s.product_id = c.product_id
JOIN whitelist w ON w.schema = c.schema AND w.spec_key = s.spec_key""")
def q_spec_whitelist(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return C.spec_whitelist(f["specs_long"], f["catalog"], f["whitelist"]).drop("schema")


@register("features_lookup", _w() + """,
look AS (
  SELECT schema, category, split_part(path, 'specs.', 2) AS spec_key,
         arg_max(name, feat_ord) AS name, min(feat_ord) AS feat_ord
  FROM features WHERE visible GROUP BY 1, 2, 3)
SELECT s.product_id, l.category, l.spec_key, l.name, s.spec_value
FROM specs_long s JOIN catalog c ON s.product_id = c.product_id
JOIN look l ON l.schema = c.schema AND l.spec_key = s.spec_key""")
def q_features_lookup(spark, sf_dir):
    f = _fx(spark, sf_dir)
    look = C.features_lookup(f["features"])
    return (f["specs_long"].join(C.shuffled(f["catalog"].select("product_id", "schema")), "product_id")
            .join(look, ["schema", "spec_key"])
            .select("product_id", "category", "spec_key", "name", "spec_value"))


@register("spec_project_nullfill", _w() + """,
look AS (SELECT DISTINCT schema, split_part(path, 'specs.', 2) AS spec_key FROM features WHERE visible)
SELECT c.product_id, l.spec_key, s.spec_value
FROM catalog c JOIN look l ON l.schema = c.schema
LEFT JOIN specs_long s ON s.product_id = c.product_id AND s.spec_key = l.spec_key""")
def q_spec_project_nullfill(spark, sf_dir):
    f = _fx(spark, sf_dir)
    wanted = C.features_lookup(f["features"]).groupBy("schema", "spec_key").agg(F.min("feat_ord").alias("feat_ord"))
    return C.spec_project_nullfill(f["catalog"], f["specs_long"], wanted).select("product_id", "spec_key", "spec_value")


@register("spec_blacklist", _w() + """
SELECT s.product_id, s.spec_ord, s.spec_key, s.spec_value
FROM specs_long s JOIN catalog c ON s.product_id = c.product_id
WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.schema = c.schema AND b.spec_key = s.spec_key)""")
def q_spec_blacklist(spark, sf_dir):
    f = _fx(spark, sf_dir)
    s = f["specs_long"].join(C.shuffled(f["catalog"].select("product_id", "schema")), "product_id")
    return C.spec_blacklist(s, f["blacklist"]).select("product_id", "spec_ord", "spec_key", "spec_value")


@register("spec_drop_null", _w(["specs_long"]) + """
SELECT product_id, spec_ord, spec_key, spec_value FROM specs_long WHERE spec_value IS NOT NULL""")
def q_spec_drop_null(spark, sf_dir):
    return C.spec_drop_null(_fx(spark, sf_dir, ["specs_long"])["specs_long"])


@register("rejected_products", _w(["catalog", "specs_long"]) + """
SELECT product_id, 'missing specs' AS reason FROM catalog
WHERE product_id NOT IN (SELECT product_id FROM specs_long)""")
def q_rejected_products(spark, sf_dir):
    f = _fx(spark, sf_dir, ["catalog", "specs_long"])
    return C.rejected_products(f["catalog"], f["specs_long"])


@register("category_blacklist", _w(CAT_FIX + ["category_blacklist"]) + """,
look AS (SELECT DISTINCT schema, category, split_part(path, 'specs.', 2) AS spec_key FROM features WHERE visible)
SELECT s.product_id, l.category, s.spec_key, s.spec_value
FROM specs_long s JOIN catalog c ON s.product_id = c.product_id
JOIN look l ON l.schema = c.schema AND l.spec_key = s.spec_key
WHERE l.category NOT IN (SELECT category FROM category_blacklist)""")
def q_category_blacklist(spark, sf_dir):
    f = _fx(spark, sf_dir, CAT_FIX + ["category_blacklist"])
    look = C.category_blacklist(C.features_lookup(f["features"]), f["category_blacklist"])
    return (f["specs_long"].join(C.shuffled(f["catalog"].select("product_id", "schema")), "product_id")
            .join(look, ["schema", "spec_key"]).select("product_id", "category", "spec_key", "spec_value"))


# ---- Category path ----------------------------------------------------------------------------
def category_specs(f):
    return C.specs_by_category(f["catalog"], f["specs_long"], f["features"], f["groups"], f["blacklist"])


CARRY = ("schema", "title")
SPEC_COLS = ["product_id", "group_ord", "spec_ord", "spec_key", "spec_value"]


def category_fields(f):
    smp = C.spec_sample(C.version_merge(category_specs(f), carry=CARRY), carry=CARRY)
    return R.render_field(smp, f["catalog"], f["rules"])


def category_prompts(f):
    return R.render_prompt_category(f["catalog"], category_fields(f), f["groups"])


def overview_fields(f):
    prods = C.with_specs(f["catalog"], f["specs_long"])
    wl = C.spec_whitelist(C.spec_filter(f["specs_long"]), prods, f["whitelist"])
    return prods, R.render_field(wl, f["catalog"], f["rules"])


def overview_prompts(f):
    prods, fields = overview_fields(f)
    return R.render_prompt_overview(prods, fields)


@register("specs_by_category", _w(extra=Q.CATEGORY_CTES) + """
SELECT product_id, group_ord, spec_ord, spec_key, spec_value FROM bycat""")
def q_specs_by_category(spark, sf_dir):
    return category_specs(_fx(spark, sf_dir)).select(*SPEC_COLS)


@register("version_merge", _w(extra=Q.CATEGORY_CTES) + """
SELECT product_id, group_ord, spec_ord, spec_key, spec_value FROM vm""")
def q_version_merge(spark, sf_dir):
    return C.version_merge(category_specs(_fx(spark, sf_dir))).select(*SPEC_COLS)


@register("spec_sample10", _w(extra=Q.CATEGORY_CTES) + """
SELECT product_id, group_ord, spec_ord, spec_key, spec_value FROM smp""")
def q_spec_sample10(spark, sf_dir):
    return C.spec_sample(C.version_merge(category_specs(_fx(spark, sf_dir)))).select(*SPEC_COLS)


@register("spec_sample10_titled", _w(["specs_long"]) + f""",
s AS (SELECT product_id, spec_key, spec_value,
             row_number() OVER (PARTITION BY product_id ORDER BY {Q.bucket(42, 'product_id', 'spec_key')}, spec_key) AS rnk
      FROM specs_long WHERE {Q.SPEC_FILTER})
SELECT product_id, CAST(rnk AS INT) AS spec_ord, {Q.title("replace(spec_key, '_', ' ')")} AS spec_key, spec_value
FROM s WHERE rnk <= 10""")
def q_spec_sample10_titled(spark, sf_dir):
    f = _fx(spark, sf_dir, ["specs_long"])
    return C.spec_sample(C.spec_filter(f["specs_long"]), part_cols=("product_id",), titled=True)


@register("render_field", _w(extra=Q.OVERVIEW_CTES) + """
SELECT product_id, spec_ord, spec_key, field FROM ov_fld""")
def q_render_field(spark, sf_dir):
    _, fields = overview_fields(_fx(spark, sf_dir))
    return fields.select("product_id", "spec_ord", "spec_key", "field")


@register("render_prompt_overview", _w(extra=Q.OVERVIEW_CTES) + "SELECT product_id, input FROM overview")
def q_render_prompt_overview(spark, sf_dir):
    return overview_prompts(_fx(spark, sf_dir))


_NULL_CTES = Q.OVERVIEW_CTES.replace("string_agg(field,", "string_agg(coalesce(field, 'not stated'),").replace(
    "FROM ov_fld WHERE spec_value IS NOT NULL GROUP BY 1", "FROM ov_fld GROUP BY 1")


@register("render_prompt_overview_nulls", _w(extra=_NULL_CTES) + "SELECT product_id, input FROM overview")
def q_render_prompt_overview_nulls(spark, sf_dir):
    """Null specs stay in the prompt, as a text of their own."""
    prods, fields = overview_fields(_fx(spark, sf_dir))
    return R.render_prompt_overview(prods, fields, null_text="not stated")


@register("render_prompt_category", _w(extra=Q.CATEGORY_CTES) + """
SELECT product_id, group_ord, category, input FROM cat_prompts""")
def q_render_prompt_category(spark, sf_dir):
    return category_prompts(_fx(spark, sf_dir))


@register("category_label", _w(extra=Q.CATEGORY_CTES) + """
SELECT product_id, group_ord, category FROM cat_prompts""")
def q_category_label(spark, sf_dir):
    return category_prompts(_fx(spark, sf_dir)).select("product_id", "group_ord", "category")


@register("complete_input", _w(extra=Q.CATEGORY_CTES + "," + Q.OVERVIEW_CTES) + """
SELECT product_id, CAST(0 AS INT) AS group_ord, 'General Overview' AS category, input FROM overview
UNION ALL SELECT product_id, group_ord, category, input FROM cat_prompts""")
def q_complete_input(spark, sf_dir):
    f = _fx(spark, sf_dir)
    return R.complete_input(overview_prompts(f), category_prompts(f))
