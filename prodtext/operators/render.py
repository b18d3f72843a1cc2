"""Rendering: spec fields, tagged prompts, training records and review assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodtext.functions import constants as K
from prodtext.functions.text import ordered_join, replace_all, title_case, word_array
from prodtext.operators.catalog import shuffled


# ---- R4 / J2 -------------------------------------------------------------------------------
def field_expr(value, key, rule_found, parameter_name, to_upper):
    """First comma part; rule -> optional upper + ' ' + parameter_name (null -> value only);
    no rule -> value + ' ' + Title(key with _ -> space)."""
    v = F.split_part(value, F.lit(","), F.lit(1))
    with_rule = F.concat(F.when(to_upper, F.upper(v)).otherwise(v),
                         F.when(parameter_name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), parameter_name)))
    fallback = F.concat(v, F.lit(" "), title_case(F.replace(key, F.lit("_"), F.lit(" "))))
    return F.when(rule_found, with_rule).otherwise(fallback)


def render_field(specs: DataFrame, catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``field`` to long specs (needs product schema for the rule lookup)."""
    r = rules.select("schema", "spec_key", "parameter_name", "to_upper", F.lit(True).alias("rule_found"))
    s = specs if "schema" in specs.columns else specs.join(shuffled(catalog.select("product_id", "schema")), "product_id")
    s = s.join(r, ["schema", "spec_key"], "left")
    return s.withColumn("field", field_expr(F.col("spec_value"), F.col("spec_key"),
                                            F.coalesce(F.col("rule_found"), F.lit(False)),
                                            F.col("parameter_name"), F.col("to_upper"))) \
            .drop("parameter_name", "to_upper", "rule_found")


def _prompt(name, feats):
    return F.concat(F.lit(f"{K.OVERV_START} {K.NAME_START} "), name, F.lit(f" {K.NAME_END} {K.FEAT_START} "),
                    feats, F.lit(f" {K.FEAT_END}"))


def _collect_fields(fields: DataFrame, keys) -> DataFrame:
    return fields.groupBy(*keys).agg(
        ordered_join(F.collect_list(F.struct("spec_ord", "field")), "field", f" {K.NEXT_FEAT} ").alias("feats"))


# ---- R6 ------------------------------------------------------------------------------------
def render_prompt_overview(catalog: DataFrame, fields: DataFrame, null_text: str | None = None) -> DataFrame:
    """Overview prompt per product: name = UPPER(title) + ' ' + UPPER(schema); every product of
    ``catalog`` gets one (no fields -> empty feature list, two spaces kept)."""
    f = fields if null_text is not None else fields.where(F.col("spec_value").isNotNull())
    if null_text is not None:
        f = f.withColumn("field", F.coalesce("field", F.lit(null_text)))
    agg = _collect_fields(f, ["product_id"])
    name = F.concat(F.upper("title"), F.lit(" "), F.upper("schema"))
    return (catalog.join(shuffled(agg), "product_id", "left")
            .select("product_id",
                    replace_all(_prompt(name, F.coalesce("feats", F.lit(""))), K.OVERVIEW_REPLACEMENTS).alias("input")))


# ---- R5 / R8 -------------------------------------------------------------------------------
def category_label(groups: DataFrame) -> DataFrame:
    """group_ord -> ' & '.join(categories in list order)."""
    return groups.groupBy("group_ord").agg(
        ordered_join(F.collect_list(F.struct("cat_ord", "category")), "category", " & ").alias("category"))


def render_prompt_category(catalog: DataFrame, fields: DataFrame, groups: DataFrame) -> DataFrame:
    """Prompt per (product, group); groups whose spec list is empty are omitted.  When the
    fields carry title and schema they are grouped along (no catalog re-join)."""
    f = fields.where(F.col("spec_value").isNotNull())
    if "title" in f.columns and "schema" in f.columns:
        agg = _collect_fields(f, ["product_id", "group_ord", "title", "schema"])
    else:
        agg = _collect_fields(f, ["product_id", "group_ord"]).join(
            shuffled(catalog.select("product_id", "title", "schema")), "product_id")
    name = F.upper(F.concat("title", F.lit(" "), "schema"))
    labels = category_label(groups)
    return (agg.join(labels, "group_ord")
            .select("product_id", F.col("group_ord").cast("int").alias("group_ord"), "category",
                    replace_all(_prompt(name, F.col("feats")), K.CATEGORY_REPLACEMENTS).alias("input")))


# ---- R7 / X4 -------------------------------------------------------------------------------
def complete_input(overview: DataFrame, category_prompts: DataFrame) -> DataFrame:
    """'General Overview' first (group_ord 0), then the category groups in order."""
    ov = overview.select("product_id", F.lit(0).cast("int").alias("group_ord"),
                         F.lit("General Overview").alias("category"), "input")
    return ov.unionByName(category_prompts.select("product_id", "group_ord", "category", "input"))


# ---- R9 ------------------------------------------------------------------------------------
def feature_sentences(features: DataFrame, key_cols=("product_id",), feature_col: str = "feature") -> DataFrame:
    """feature -> 'this product has <feature>.'; distinct by sentence (per key)."""
    pre, post = K.FEATURE_TEMPLATE
    s = F.concat(F.lit(pre), F.col(feature_col), F.lit(post))
    return features.select(*key_cols, feature_col, s.alias("feature_sentence")).dropDuplicates(
        list(key_cols) + ["feature_sentence"])


# ---- R10 / C7 ------------------------------------------------------------------------------
def training_record_expr(name, attrs_joined, description):
    return F.concat(F.lit(f"{K.OVERV_START} {K.NAME_START} "), name, F.lit(f" {K.NAME_END} {K.FEAT_START} "),
                    attrs_joined, F.lit(f" {K.FEAT_END} {K.DESCR_START} "), description,
                    F.lit(f" {K.DESCR_END} {K.OVERV_END}"))


def render_training_record(df: DataFrame, name="name", description="description",
                           attrs="att_list") -> DataFrame:
    """One record string per row; rows with a null name/description/attribute list are skipped
    (``training_skip_count`` counts them)."""
    ok = F.col(name).isNotNull() & F.col(description).isNotNull() & F.col(attrs).isNotNull()
    return df.where(ok).withColumn("record", training_record_expr(
        F.col(name), F.array_join(F.col(attrs), f" {K.NEXT_FEAT} "), F.col(description)))


def training_skip_count(df: DataFrame, name="name", description="description", attrs="att_list", by=()) -> DataFrame:
    """Rows that ``render_training_record`` skips and all rows, for each value of ``by``."""
    bad = F.col(name).isNull() | F.col(description).isNull() | F.col(attrs).isNull()
    return df.groupBy(*by).agg(F.count_if(bad).cast("bigint").alias("skipped"), F.count(F.lit(1)).cast("bigint").alias("total"))


# ---- T7 ------------------------------------------------------------------------------------
def extract_features(prompts: DataFrame, key_cols=("product_id",)) -> DataFrame:
    """Flat feature list from the prompts' FEAT block: split on <NEXT_FEAT>, whitespace-normalise,
    drop empty slots.  Output (keys..., group_ord, feat_ord, feature)."""
    # the pattern's '.' stops at a newline only, Java's at more line ends
    block = F.regexp_extract("input", f"{K.FEAT_START}([^\n]*?){K.FEAT_END}", 1)
    parts = F.split(block, K.NEXT_FEAT)
    cols = list(key_cols) + (["group_ord"] if "group_ord" in prompts.columns else [])
    ex = prompts.select(*cols, F.posexplode(parts).alias("pos", "raw"))
    norm = F.array_join(word_array("raw"), " ")
    return (ex.select(*cols, (F.col("pos") + 1).cast("int").alias("feat_ord"), norm.alias("feature"))
            .where(F.col("feature") != ""))


# ---- T8 ------------------------------------------------------------------------------------
def extract_description(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Cut at the pad marker, take DESCR_START..DESCR_END (greedy), headings h2 -> h4;
    null when the tags are absent."""
    cut = F.split_part(F.col(raw), F.lit(K.PAD), F.lit(1))
    # '.' in the source pattern stops at a newline only, hence [^\n] (Java's '.' stops at more).
    pat = f"{K.DESCR_START}([^\n]*){K.DESCR_END}"
    body = F.regexp_extract(cut, pat, 1)
    ok = cut.rlike(pat)
    d = replace_all(body, [("<h2>", "<h4>"), ("</h2>", "</h4>")])
    return df.withColumn("description", F.when(ok, d)).withColumn("valid", ok)


# ---- T9 ------------------------------------------------------------------------------------
def extract_title(df: DataFrame, col: str = "input") -> DataFrame:
    pat = f"{K.NAME_START} ([^\n]*){K.NAME_END}"
    return df.withColumn("title", F.when(F.col(col).rlike(pat), F.regexp_extract(col, pat, 1)))


# ---- T10 / C13 -----------------------------------------------------------------------------
def assemble_review(title: DataFrame, sections: DataFrame) -> DataFrame:
    """'# '+title+'\\n\\n' then per section (in order) '<h2> '+UPPER(cat)+'</h2> \\n\\n'+text+'\\n\\n'.
    ``title``: (product_id, title); ``sections``: (product_id, group_ord, category, text)."""
    piece = F.concat(F.lit("<h2> "), F.upper("category"), F.lit("</h2> \n\n"), F.col("text"), F.lit("\n\n"))
    body = sections.where(F.col("text").isNotNull()).groupBy("product_id").agg(
        ordered_join(F.collect_list(F.struct("group_ord", piece.alias("p"))), "p", "").alias("body"))
    return title.join(shuffled(body), "product_id", "left").select(
        "product_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("review"))
