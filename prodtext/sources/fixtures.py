"""Input views derived from the driver tables.

Each fixture is written once as SQL that runs on Spark and on DuckDB; the
few spots where the dialects differ go through ``Dialect`` one-for-one
equivalents.  Literal dimension tables (features, rules, lists) are small
``VALUES`` lists about the hardware parts of the ``part`` table, made up for
these fixtures so that every case of the operators occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prodtext.sources.tables import register_tables


@dataclass(frozen=True)
class Dialect:
    name: str

    def ords(self, n: int) -> str:
        return (f"explode(sequence(1, {n}))" if self.name == "spark"
                else f"unnest(generate_series(1, {n}))")

    def str_type(self) -> str:
        return "STRING" if self.name == "spark" else "VARCHAR"

    def first_words(self, n: int) -> tuple[str, str]:
        """The first ``n`` space-separated words of ``text`` as w1, w2, ...: their columns and the rows
        that hold them.  Spark's split_part cuts the whole text, each time it is used; the split
        is done once and stops behind word ``n``."""
        if self.name == "spark":
            return ", ".join(f"get(ws, {i}) AS w{i + 1}" for i in range(n)), f"(SELECT doc_id, text, split(text, ' ', {n + 1}) AS ws FROM documents)"
        return ", ".join(f"split_part(text, ' ', {i}) AS w{i}" for i in range(1, n + 1)), "documents"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(cols, rows) -> str:
    body = ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


# --------------------------------------------------------------------------------------------
# Literal dimensions.  Schemas are lower(p_type) of the part table; one has no features.
SCHEMAS_WITH_FEATURES = ["economy", "large", "medium", "promo", "standard"]
SCHEMAS_WITH_RULES = ["medium", "promo"]
SCHEMAS_WITH_BLACKLIST = ["medium", "large"]
ALL_SCHEMAS = ["economy", "large", "medium", "promo", "small", "standard"]

FEATURE_ROWS = [  # (category, visible, key, display name)
    ("Build", True, "grip_class", "Grip class"),
    ("Build", True, "bore", "Bore"),
    ("Build", True, "thread_count", "Threads"),
    ("Build", True, "load_rating", "Load rating"),
    ("Build", True, "edge_angle", "Edge angle"),
    ("Build", True, "coat_layers", "Coat layers"),
    ("Build", True, "torque_limit", "Torque limit"),
    ("Build", True, "length_class", "Length class"),
    ("Build", True, "batch_grade", "Batch grade"),
    ("Build", True, "seal_kind", "Seal"),
    ("Handling", True, "grip_class", "Handling grade"),
    ("Handling", True, "tool_list", "Tools"),
    ("Handling", True, "reusable", "Reusable"),
    ("Handling", True, "magnetic", "Magnetic"),
    ("Handling", False, "part_code", "Part code"),
    ("Fit", True, "gauge", "Gauge"),
    ("Fit", True, "gauge_version", "Gauge revision"),
    ("Fit", True, "coupling_version", "Coupling revision"),
    ("Fit", True, "package_depth", "Depth when packed"),
    ("Finish", True, "finish", "Finish"),
    ("Finish", True, "rust-proof", "Rust-proof"),
    ("Finish", True, "stackable", "Stackable"),
    ("Finish", True, "stackable", "Can be stacked"),
    ("Paperwork", True, "price_band", "Price band"),
    ("Paperwork", True, "part_code", "Code on the invoice"),
]

RULE_ROWS = [  # (key, parameter_name, to_upper): null, empty and plain names, both cases
    ("grip_class", "grip", True),
    ("bore", None, False),
    ("finish", "coat", True),
    ("tool_list", None, False),
    ("load_rating", "", False),
    ("magnetic", "magnetic body", False),
    ("reusable", None, False),
    ("stackable", "Stacks", False),
    ("price_band", "band", True),
]

WHITELIST_KEYS = ["bore", "thread_count", "grip_class", "load_rating", "finish", "magnetic", "tool_list",
                  "rust-proof", "stackable", "price_band", "reusable", "no_such_key", "gauge"]

BLACKLIST_KEYS = ["finish", "stackable", ""]

DROP_COLUMNS = ["stock_code", "page_name", "no_such_column"]

CATEGORY_BLACKLIST = ["Paperwork", "Freight"]

GROUPS = [["Build", "Handling"], ["Fit", "Paperwork"], ["Finish", "Spares"], ["Spares"]]


def features_sql(d: Dialect) -> str:
    rows, o = [], 0
    for s in SCHEMAS_WITH_FEATURES:
        for cat, vis, key, name in FEATURE_ROWS:
            o += 1
            rows.append((o, s, cat, vis, "specs." + key, name))
    return values_sql(["feat_ord", "schema", "category", "visible", "path", "name"], rows)


def rules_sql(d: Dialect) -> str:
    rows = [(s, k, p, u) for s in SCHEMAS_WITH_RULES for k, p, u in RULE_ROWS]
    return values_sql(["schema", "spec_key", "parameter_name", "to_upper"], rows)


def whitelist_sql(d: Dialect) -> str:
    rows = [(s, i + 1, k) for s in ALL_SCHEMAS for i, k in enumerate(WHITELIST_KEYS)]
    return values_sql(["schema", "ord", "spec_key"], rows)


def blacklist_sql(d: Dialect) -> str:
    rows = [(s, k) for s in SCHEMAS_WITH_BLACKLIST for k in BLACKLIST_KEYS]
    return values_sql(["schema", "spec_key"], rows)


def groups_sql(d: Dialect) -> str:
    rows = [(g + 1, c + 1, cat) for g, grp in enumerate(GROUPS) for c, cat in enumerate(grp)]
    return values_sql(["group_ord", "cat_ord", "category"], rows)


def category_blacklist_sql(d: Dialect) -> str:
    return values_sql(["category"], [(c,) for c in CATEGORY_BLACKLIST])


# --------------------------------------------------------------------------------------------
# Catalog derived from `part`.
def catalog_sql(d: Dialect) -> str:
    s = d.str_type()
    return f"""
SELECT CAST(p_partkey AS {s}) AS product_id, p_name AS title, p_brand AS brand,
       lower(p_type) AS schema, 'P' || CAST(p_partkey AS {s}) AS stock_code,
       replace(p_name, ' ', '-') AS page_name
FROM part"""


SPEC_KEYS = ["grip_class", "bore", "finish", "thread_count", "load_rating", "magnetic", "tool_list", "rust-proof",
             "stackable", "gauge", "gauge_version", "package_depth", "coupling_version", "price_band", "reusable",
             "part_code", "edge_angle", "coat_layers", "torque_limit", "length_class", "batch_grade", "seal_kind"]


def specs_long_sql(d: Dialect) -> str:
    """Up to 22 specs a product: lists with commas, nulls, 'No', inch marks, versions before
    and behind their base key; one product in fifty has none."""
    s = d.str_type()
    key_case = " ".join(f"WHEN {i + 1} THEN '{k}'" for i, k in enumerate(SPEC_KEYS))
    return f"""
SELECT product_id,
       CAST(CASE WHEN k = 10 AND pk % 2 = 1 THEN 11 WHEN k = 11 AND pk % 2 = 1 THEN 10
                 ELSE k END AS INT) AS spec_ord,
       CASE k {key_case} END AS spec_key,
       CASE k
         WHEN 1 THEN CASE pk % 3 WHEN 0 THEN 'Grade A, tested' WHEN 1 THEN 'grade b' ELSE 'Grade C' END
         WHEN 2 THEN CAST(sz AS {s}) || '"'
         WHEN 3 THEN CASE pk % 4 WHEN 0 THEN 'Zinc' WHEN 1 THEN 'matte black' WHEN 2 THEN 'Brass' ELSE 'No' END
         WHEN 4 THEN CAST(8 + (pk % 5) * 4 AS {s})
         WHEN 5 THEN CAST(sz AS {s}) || ' kN, static'
         WHEN 6 THEN CASE WHEN pk % 2 = 0 THEN 'Yes' ELSE 'No' END
         WHEN 7 THEN CASE WHEN pk % 7 = 0 THEN NULL ELSE 'Hex, Slot, Square' END
         WHEN 8 THEN CASE WHEN pk % 4 = 0 THEN NULL ELSE 'Yes ' || CAST(pk % 4 AS {s}) || ' years' END
         WHEN 9 THEN CASE WHEN pk % 3 = 0 THEN 'No' ELSE 'Yes' END
         WHEN 10 THEN CAST(pk % 4 + 1 AS {s})
         WHEN 11 THEN CASE WHEN pk % 2 = 0 THEN 'rev A' ELSE 'rev B' END
         WHEN 12 THEN CAST(sz AS {s}) || ' cm'
         WHEN 13 THEN 'rev C'
         WHEN 14 THEN CASE WHEN price < 905 THEN 'low' WHEN price < 950 THEN 'middle' ELSE 'Streaming: high' END
         WHEN 15 THEN CASE WHEN pk % 5 = 0 THEN 'No' ELSE 'Yes' END
         WHEN 16 THEN nm
         WHEN 17 THEN CAST(15 * (pk % 6 + 1) AS {s}) || ' deg'
         WHEN 18 THEN CAST(pk % 3 + 1 AS {s})
         WHEN 19 THEN CAST(sz * 2 AS {s}) || ' Nm'
         WHEN 20 THEN CASE WHEN sz < 25 THEN 'short' ELSE 'long' END
         WHEN 21 THEN 'batch ' || CAST(pk % 9 AS {s})
         ELSE CASE pk % 3 WHEN 0 THEN 'rubber' WHEN 1 THEN 'felt, waxed' ELSE 'cork' END
       END AS spec_value
FROM (
  SELECT CAST(p_partkey AS {s}) AS product_id, p_partkey AS pk, p_size AS sz, p_name AS nm, p_retailprice AS price,
         {d.ords(len(SPEC_KEYS))} AS k
  FROM part
  WHERE p_partkey % 50 <> 7
) x
WHERE NOT (k BETWEEN 13 AND 16 AND pk % 3 = 0) AND NOT (k > 5 AND pk % 10 = 4)"""


# --------------------------------------------------------------------------------------------
# Corpus views derived from `documents`.
def _chr(d: Dialect, n: int) -> str:
    return f"chr({n})" if d.name == "duckdb" else f"char({n})"


def descriptions_sql(d: Dialect) -> str:
    """Whole texts; some without name or text, some with carriage returns and no-break spaces."""
    return f"""
SELECT doc_id, CASE WHEN doc_id % 97 = 13 THEN NULL ELSE source END AS name,
       CASE WHEN doc_id % 89 = 5 THEN NULL
            WHEN doc_id % 11 = 3 THEN replace(text, '. ', '.' || {_chr(d, 13)} || 'so' || {_chr(d, 160)} || 'far ')
            ELSE text END AS description
FROM documents"""


def tagged_sql(d: Dialect) -> str:
    """Every document.  Those of at least 13 space-separated words have word 3 tagged <prod>,
    words 6-7 and 12 tagged <attr>; variants by doc_id put punctuation right after a tag,
    regex characters or a carriage return inside an entity, an untagged repeat of the product
    word, or no tags.  Shorter documents have no tags."""
    w, rows = d.first_words(12)
    prefix = " || ' ' || ".join(f"w{i}" for i in range(1, 13))
    return f"""
SELECT doc_id,
  CASE WHEN doc_id % 10 = 9 OR length(text) - length(replace(text, ' ', '')) < 12 THEN text ELSE
    w1 || ' ' || w2 || ' <prod>' || w3 || '</prod>' || (CASE WHEN doc_id % 5 = 3 THEN '. ' ELSE ' ' END)
    || w4 || ' ' || w5 || ' <attr>' || w6 || (CASE WHEN doc_id % 17 = 2 THEN {_chr(d, 13)} ELSE ' ' END) || w7 || '</attr>'
    || (CASE WHEN doc_id % 3 = 2 THEN ', ' ELSE ' ' END)
    || w8 || ' ' || w9 || ' ' || w10 || ' ' || w11 || ' <attr>'
    || (CASE WHEN doc_id % 6 = 0 THEN '(' || w12 || '+1.5)' ELSE w12 END) || '</attr>'
    || substr(text, length({prefix}) + 1)
    || (CASE WHEN doc_id % 4 = 1 THEN ' ' || w3 ELSE '' END)
  END AS tagged_text
FROM (SELECT doc_id, text, {w} FROM {rows} WHERE text IS NOT NULL) x"""


# --------------------------------------------------------------------------------------------
# Generated candidates from `conversations`: reference = user turn, candidates = the next
# assistant turn rendered three ways (whole text each time); some have no tags, some are
# empty, some prompts keep fewer than two valid samples, one sample carries a pad marker.
# One sample holds its sentences twice, the second time each with a word more, so that its
# near-duplicates lie on both sides of the threshold; another holds no-break spaces.
def candidates_sql(d: Dialect) -> str:
    nl = "chr(10)" if d.name == "duckdb" else "char(10)"
    return f"""
SELECT prompt_id, CAST(sample_id AS INT) AS sample_id,
  CASE
    WHEN sample_id = 3 AND prompt_id % 7 = 0 THEN a_text
    WHEN sample_id = 2 AND (prompt_id % 11 = 0 OR prompt_id % 7 = 0) THEN ''
    WHEN sample_id = 1 THEN 'Prompt <DESCR_START>' || replace(a_text, {nl}, ' ')
         || '<DESCR_END><|PAD|><DESCR_START> tail<DESCR_END>'
    WHEN sample_id = 2 THEN '<DESCR_START><h2> Overview </h2>  <br>' || replace(a_text, {nl}, ' ') || ' '
         || replace(replace(a_text, {nl}, ' '), '. ', ' indeed. ') || '<DESCR_END>'
    ELSE '<DESCR_START>' || replace(replace(a_text, {nl}, ' '), '. ', '.. ') || ' '
         || replace(replace(a_text, {nl}, ' '), ' the ', {_chr(d, 160)} || 'the' || {_chr(d, 160)}) || '<DESCR_END>'
  END AS raw,
  reference
FROM (
  SELECT u.conv_id * 1000 + u.turn AS prompt_id, u.text AS reference, a.text AS a_text,
         {d.ords(3)} AS sample_id
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
) x"""


# --------------------------------------------------------------------------------------------
# Reviews (one per document, product_id = doc_id): title line, an overview section with a
# decimal number, and every text line as its own '<h4> Details </h4>' section (blank lines kept).
def reviews_sql(d: Dialect) -> str:
    nl = "chr(10)" if d.name == "duckdb" else "char(10)"
    s = d.str_type()
    return f"""
SELECT CAST(doc_id AS {s}) AS product_id,
  '# ' || source || {nl} || {nl} || '<h2> OVERVIEW</h2> ' || {nl} || {nl} || 'Display size 6.5 inch. '
  || replace(text, {nl}, {nl} || {nl} || '<h4> Details </h4>' || {nl}) AS review
FROM documents"""


# Vectors from `embeddings`: even ids are sentences, odd ids are features; the label is the product.
def sentence_vectors_sql(d: Dialect) -> str:
    return f"""
SELECT CAST(label AS {d.str_type()}) AS product_id, CAST(CAST(floor(vec_id / 20) AS BIGINT) % 5 AS INT) AS para_ord,
       CAST(vec_id AS INT) AS sent_ord, embedding AS vec
FROM embeddings WHERE vec_id % 2 = 0"""


def feature_vectors_sql(d: Dialect) -> str:
    s = d.str_type()
    return f"""
SELECT CAST(label AS {s}) AS product_id, 'f' || CAST(vec_id AS {s}) AS feature, embedding AS vec
FROM embeddings WHERE vec_id % 2 = 1"""


FIXTURES = {
    "features": features_sql,
    "rules": rules_sql,
    "whitelist": whitelist_sql,
    "blacklist": blacklist_sql,
    "groups": groups_sql,
    "category_blacklist": category_blacklist_sql,
    "catalog": catalog_sql,
    "specs_long": specs_long_sql,
    "descriptions": descriptions_sql,
    "tagged": tagged_sql,
    "candidates": candidates_sql,
    "reviews": reviews_sql,
    "sentence_vectors": sentence_vectors_sql,
    "feature_vectors": feature_vectors_sql,
}
DEPENDS: dict[str, list[str]] = {}


def _closure(names) -> list[str]:
    order = list(FIXTURES)
    need: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(DEPENDS.get(n, []))
    return [n for n in order if n in need]


def register_fixtures(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register driver tables and the requested fixture views (with their dependencies).
    Views are lazy plans; they are (re)registered only when the session or sf_dir changes."""
    known = getattr(spark, "_prodtext_views", None)  # kept by the session object itself
    if known is None or known[0] != sf_dir or not spark.catalog.tableExists("part"):
        register_tables(spark, sf_dir)
        known = spark._prodtext_views = (sf_dir, set())
    for n in _closure(names or list(FIXTURES)):
        if n not in known[1]:
            spark.sql(FIXTURES[n](SPARK)).createOrReplaceTempView(n)
            known[1].add(n)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_fixtures(spark, sf_dir, [name])
    return spark.table(name)


def duck_with(names) -> str:
    """``WITH`` clause defining the fixture views (and dependencies) for DuckDB."""
    parts = [f"{n} AS ({FIXTURES[n](DUCK)})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
