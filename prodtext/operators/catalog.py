"""Catalog selection, spec filtering and per-category spec assembly.

Specs are kept in long form ``(product_id, spec_ord, spec_key, spec_value)``:
ordinals carry the order the prompt depends on, and Spark maps reject
duplicate keys.  The planner broadcasts a dimension (features, rules, lists) while its size
allows.  Products and their specs grow with the data, and the planner's guess of them is far
too low (exploded rows count as one, Parquet sizes are compressed), so they always meet in a
sort-merge join: no table of products passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodtext.functions.constants import MAX_SPECS
from prodtext.functions.text import hash_bucket, title_case
from prodtext.session import cut_lineage


def shuffled(products: DataFrame) -> DataFrame:
    """A side of a join by product that is never broadcast, whatever size the planner guesses."""
    return products.hint("merge")


# ---- P1 / J9 -------------------------------------------------------------------------------
def select_by_id(catalog: DataFrame, ids) -> DataFrame:
    """One id (string) -> equality filter pushed to the scan; a DataFrame of ids -> semi join."""
    if isinstance(ids, DataFrame):
        return catalog.join(shuffled(ids.select("product_id").distinct()), "product_id", "left_semi")
    return catalog.where(F.col("product_id") == F.lit(ids))


# ---- P2 / O1 -------------------------------------------------------------------------------
def select_by_schema(catalog: DataFrame, schema: str, limit: int | None = None) -> DataFrame:
    out = catalog.where(F.col("schema") == F.lit(schema))
    if limit is not None:
        # The source's $limit has no order; we define one so results are reproducible.
        out = out.orderBy("product_id").limit(int(limit))
    return out


# ---- P3 / O2 -------------------------------------------------------------------------------
def sample_products(catalog: DataFrame, arg, schema: str, seed: int = 42) -> DataFrame:
    """Id-or-count dispatch: an existing id -> that product (schema not checked);
    an integer n -> n products of ``schema`` in seeded-hash order; None -> empty."""
    if arg is None:
        return catalog.limit(0)
    if isinstance(arg, int):
        ranked = catalog.where(F.col("schema") == F.lit(schema)).withColumn(
            "sample_key", hash_bucket(seed, "product_id"))
        # TakeOrderedAndProject: each partition keeps its own top-n, no global sort.
        return ranked.orderBy("sample_key", "product_id").limit(int(arg)).drop("sample_key")
    return select_by_id(catalog, str(arg))


# ---- P4 ------------------------------------------------------------------------------------
def drop_blacklisted(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)  # names absent from df are ignored


# ---- P5 ------------------------------------------------------------------------------------
def spec_filter(specs: DataFrame, no_value: str = "No", banned_key_part: str = "package") -> DataFrame:
    """Keep value != 'No' (nulls survive) and keys not containing 'package'."""
    v, k = F.col("spec_value"), F.col("spec_key")
    return specs.where(~v.eqNullSafe(F.lit(no_value)) & ~F.contains(k, F.lit(banned_key_part)))


def spec_filter_map(df: DataFrame, col: str = "specs", no_value: str = "No",
                    banned_key_part: str = "package") -> DataFrame:
    """Same filter for a ``map<string,string>`` column."""
    return df.withColumn(col, F.map_filter(
        col, lambda k, v: ~v.eqNullSafe(F.lit(no_value)) & ~F.contains(k, F.lit(banned_key_part))))


def specs_from_map(df: DataFrame, id_col: str = "product_id", col: str = "specs") -> DataFrame:
    """map column -> long form with insertion-order ordinals."""
    return df.select(id_col, F.posexplode(col).alias("pos", "spec_key", "spec_value")).select(
        id_col, (F.col("pos") + 1).alias("spec_ord"), "spec_key", "spec_value")


# ---- P6 ------------------------------------------------------------------------------------
def spec_whitelist(specs: DataFrame, catalog: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Ordered whitelist: missing keys skipped, null values kept, order = list order."""
    wl = whitelist.select("schema", "spec_key", F.col("ord").alias("wl_ord"))
    return (specs.join(shuffled(catalog.select("product_id", "schema")), "product_id")
            .join(wl, ["schema", "spec_key"])
            .select("product_id", F.col("wl_ord").cast("int").alias("spec_ord"), "spec_key",
                    "spec_value", "schema"))


# ---- P8 ------------------------------------------------------------------------------------
def features_lookup(features: DataFrame) -> DataFrame:
    """(schema, category) -> spec keys of visible features; on duplicate keys the last name wins.
    Output keeps the first position of each key for ordering."""
    f = features.where(F.col("visible")).withColumn("spec_key", F.split_part("path", F.lit("specs."), F.lit(2)))
    return f.groupBy("schema", "category", "spec_key").agg(
        F.max_by("name", "feat_ord").alias("name"), F.min("feat_ord").alias("feat_ord"))


# ---- P7 ------------------------------------------------------------------------------------
def spec_project_nullfill(catalog: DataFrame, specs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted key (per schema, bounded literal) for every product; missing -> null."""
    w = wanted.select("schema", "spec_key", "feat_ord")
    grid = catalog.select("product_id", "schema").join(w, "schema")
    return grid.join(shuffled(specs.select("product_id", "spec_key", "spec_value")), ["product_id", "spec_key"], "left")


# ---- P9 / J8 -------------------------------------------------------------------------------
def spec_blacklist(specs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Drop keys blacklisted for the row's schema; schemas without a list keep everything."""
    return specs.join(blacklist.select("schema", "spec_key"), ["schema", "spec_key"], "left_anti")


# ---- P10 -----------------------------------------------------------------------------------
def spec_drop_null(specs: DataFrame) -> DataFrame:
    return specs.where(F.col("spec_value").isNotNull())


# ---- P11 -----------------------------------------------------------------------------------
def rejected_products(catalog: DataFrame, specs: DataFrame) -> DataFrame:
    """Products without any spec record, with the reason (the source skips and prints them)."""
    return (catalog.join(shuffled(specs.select("product_id").distinct()), "product_id", "left_anti")
            .select("product_id", F.lit("missing specs").alias("reason")))


def with_specs(catalog: DataFrame, specs: DataFrame) -> DataFrame:
    return catalog.join(shuffled(specs.select("product_id").distinct()), "product_id", "left_semi")


# ---- P15 -----------------------------------------------------------------------------------
def category_blacklist(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    return df.join(blacklist.select("category"), "category", "left_anti")


# ---- R1 / J1 -------------------------------------------------------------------------------
def specs_by_category(catalog: DataFrame, specs: DataFrame, features: DataFrame, groups: DataFrame,
                      blacklist: DataFrame) -> DataFrame:
    """Specs of each product for each category group.

    Keys are the union of the group's categories' visible feature keys (minus the schema
    blacklist), a key keeps its first position (category order, then feature order), the
    'No'/'package' filter applies, and missing keys are null-filled (dropped later by R2).
    """
    look = features_lookup(features)
    look = look.join(blacklist.select("schema", "spec_key"), ["schema", "spec_key"], "left_anti")
    wanted = (groups.join(look, "category")
              .groupBy("schema", "group_ord", "spec_key")
              .agg(F.min(F.struct("cat_ord", "feat_ord")).alias("pos")))
    w = Window.partitionBy("schema", "group_ord").orderBy("pos")
    # written out, its size is known: the planner's guess multiplies the joined tables' sizes, and a
    # catalog below that guess would be broadcast in its place
    wanted = cut_lineage(wanted.withColumn("key_ord", F.row_number().over(w)).drop("pos"))
    grid = catalog.select("product_id", "schema", "title").join(wanted, "schema")
    out = grid.join(shuffled(specs.select("product_id", "spec_key", "spec_value")), ["product_id", "spec_key"], "left")
    out = out.where(~F.col("spec_value").eqNullSafe(F.lit("No")) & ~F.contains("spec_key", F.lit("package")))
    # schema and title ride along so later steps need no catalog re-join
    return out.select("product_id", "group_ord", F.col("key_ord").cast("int").alias("spec_ord"), "spec_key",
                      "spec_value", "schema", "title")


# ---- R2 ------------------------------------------------------------------------------------
def version_merge(specs: DataFrame, part_cols=("product_id", "group_ord"), carry=()) -> DataFrame:
    """Drop nulls; key X plus X_version=v -> key 'X v' (value of X, placed last); drop every
    key containing 'version'.  Implements the intended result for every key order.
    ``carry``: product attributes passed through unchanged (avoids re-joining the catalog)."""
    keys = list(part_cols)
    carry = list(carry)
    s = specs.where(F.col("spec_value").isNotNull())
    is_ver = F.contains("spec_key", F.lit("version"))
    ver = (s.where(is_ver)
           .select(*keys, F.split_part("spec_key", F.lit("_version"), F.lit(1)).alias("spec_key"),
                   F.col("spec_value").alias("version_value"), F.col("spec_ord").alias("version_ord")))
    # several *version* keys may name the same base key: the first one renames it.
    ver = ver.groupBy(*keys, "spec_key").agg(
        F.min_by("version_value", "version_ord").alias("version_value"),
        F.min("version_ord").alias("version_ord"))
    base = s.where(~is_ver).join(shuffled(ver), keys + ["spec_key"], "left")
    max_ord = F.lit(1000000)
    return base.select(
        *keys, *carry,
        F.when(F.col("version_value").isNull(), F.col("spec_ord"))
         .otherwise(max_ord + F.col("version_ord")).cast("int").alias("spec_ord"),
        F.when(F.col("version_value").isNull(), F.col("spec_key"))
         .otherwise(F.concat_ws(" ", "spec_key", "version_value")).alias("spec_key"),
        "spec_value")


# ---- R3 ------------------------------------------------------------------------------------
def spec_sample(specs: DataFrame, part_cols=("product_id", "group_ord"), n: int = MAX_SPECS,
                seed: int = 42, titled: bool = False, carry=()) -> DataFrame:
    """Keep at most n specs per group in seeded pseudo-random order (spec_ord = new rank).  Rows are
    dealt out by group before they are sorted: the planner's own limit of a group's rows sorts
    all that a task explodes from its products."""
    keys = list(part_cols)
    carry = list(carry)
    w = Window.partitionBy(*keys).orderBy("rnd", "spec_key")
    out = (specs.repartition(*keys).withColumn("rnd", hash_bucket(seed, *keys, "spec_key"))
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))
    key = title_case(F.replace("spec_key", F.lit("_"), F.lit(" "))) if titled else F.col("spec_key")
    return out.select(*keys, *carry, F.col("rank").cast("int").alias("spec_ord"), key.alias("spec_key"),
                      "spec_value")
