"""DuckDB SQL fragments for the oracle queries (same semantics as the Spark operators)."""

from __future__ import annotations

from prodtext.functions.text import ISTITLE_BROKEN, ISTITLE_CASED


def title(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|\P{{L}}+)', 1), "
            rf"lambda c: upper(c[1:1]) || lower(c[2:])), '')")


def is_title(x: str) -> str:
    return f"(regexp_matches({x}, '{ISTITLE_CASED}') AND NOT regexp_matches({x}, '{ISTITLE_BROKEN}'))"


def bucket(seed, *keys: str) -> str:
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"


def field(v: str, k: str, rule_found: str, pname: str, upper_flag: str) -> str:
    v1 = f"split_part({v}, ',', 1)"
    return (f"CASE WHEN {rule_found} THEN (CASE WHEN {upper_flag} THEN upper({v1}) ELSE {v1} END) || "
            f"(CASE WHEN {pname} IS NULL THEN '' ELSE ' ' || {pname} END) "
            f"ELSE {v1} || ' ' || {title(f'replace({k}, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} END")


SPEC_FILTER = "NOT (spec_value IS NOT DISTINCT FROM 'No') AND NOT contains(spec_key, 'package')"

# Category path: features lookup -> group keys -> null-filled product specs -> version merge -> sample.
CATEGORY_CTES = f"""
look AS (
  SELECT schema, category, split_part(path, 'specs.', 2) AS spec_key,
         arg_max(name, feat_ord) AS name, min(feat_ord) AS feat_ord
  FROM features WHERE visible GROUP BY 1, 2, 3),
look_nb AS (
  SELECT l.* FROM look l
  WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.schema = l.schema AND b.spec_key = l.spec_key)),
wanted0 AS (
  SELECT l.schema, g.group_ord, l.spec_key, min(g.cat_ord * 100000 + l.feat_ord) AS pos
  FROM groups g JOIN look_nb l ON g.category = l.category GROUP BY 1, 2, 3),
wanted AS (
  SELECT *, row_number() OVER (PARTITION BY schema, group_ord ORDER BY pos) AS key_ord FROM wanted0),
bycat AS (
  SELECT c.product_id, w.group_ord, CAST(w.key_ord AS INT) AS spec_ord, w.spec_key, s.spec_value
  FROM catalog c JOIN wanted w ON c.schema = w.schema
  LEFT JOIN specs_long s ON s.product_id = c.product_id AND s.spec_key = w.spec_key
  WHERE NOT (s.spec_value IS NOT DISTINCT FROM 'No') AND NOT contains(w.spec_key, 'package')),
vm_s AS (SELECT * FROM bycat WHERE spec_value IS NOT NULL),
vm_v AS (
  SELECT product_id, group_ord, split_part(spec_key, '_version', 1) AS spec_key,
         arg_min(spec_value, spec_ord) AS version_value, min(spec_ord) AS version_ord
  FROM vm_s WHERE contains(spec_key, 'version') GROUP BY 1, 2, 3),
vm AS (
  SELECT b.product_id, b.group_ord,
         CAST(CASE WHEN v.version_value IS NULL THEN b.spec_ord ELSE 1000000 + v.version_ord END AS INT) AS spec_ord,
         CASE WHEN v.version_value IS NULL THEN b.spec_key ELSE b.spec_key || ' ' || v.version_value END AS spec_key,
         b.spec_value
  FROM vm_s b LEFT JOIN vm_v v
    ON b.product_id = v.product_id AND b.group_ord = v.group_ord AND b.spec_key = v.spec_key
  WHERE NOT contains(b.spec_key, 'version')),
smp0 AS (
  SELECT product_id, group_ord, spec_key, spec_value,
         row_number() OVER (PARTITION BY product_id, group_ord
                            ORDER BY {bucket(42, 'product_id', 'group_ord', 'spec_key')}, spec_key) AS rnk
  FROM vm),
smp AS (SELECT product_id, group_ord, CAST(rnk AS INT) AS spec_ord, spec_key, spec_value FROM smp0 WHERE rnk <= 10),
cat_fld AS (
  SELECT s.*, c.schema, {field('s.spec_value', 's.spec_key', 'r.spec_key IS NOT NULL', 'r.parameter_name', 'r.to_upper')} AS field
  FROM smp s JOIN catalog c ON s.product_id = c.product_id
  LEFT JOIN rules r ON r.schema = c.schema AND r.spec_key = s.spec_key),
labels AS (SELECT group_ord, string_agg(category, ' & ' ORDER BY cat_ord) AS category FROM groups GROUP BY 1),
cat_prompts AS (
  SELECT a.product_id, CAST(a.group_ord AS INT) AS group_ord, l.category,
         replace(replace(replace('<OVERV_START> <NAME_START> ' || upper(c.title || ' ' || c.schema)
           || ' <NAME_END> <FEAT_START> ' || a.feats || ' <FEAT_END>', 'Yes ', ''), '"', ' inch'), 'Streaming: ', '') AS input
  FROM (SELECT product_id, group_ord, string_agg(field, ' <NEXT_FEAT> ' ORDER BY spec_ord) AS feats
        FROM cat_fld WHERE spec_value IS NOT NULL GROUP BY 1, 2) a
  JOIN catalog c ON a.product_id = c.product_id JOIN labels l ON l.group_ord = a.group_ord)"""

OVERVIEW_CTES = f"""
wl AS (
  SELECT s.product_id, c.schema, CAST(w.ord AS INT) AS spec_ord, s.spec_key, s.spec_value
  FROM specs_long s JOIN catalog c ON s.product_id = c.product_id
  JOIN whitelist w ON w.schema = c.schema AND w.spec_key = s.spec_key
  WHERE NOT (s.spec_value IS NOT DISTINCT FROM 'No') AND NOT contains(s.spec_key, 'package')),
ov_fld AS (
  SELECT wl.*, {field('wl.spec_value', 'wl.spec_key', 'r.spec_key IS NOT NULL', 'r.parameter_name', 'r.to_upper')} AS field
  FROM wl LEFT JOIN rules r ON r.schema = wl.schema AND r.spec_key = wl.spec_key),
ov_agg AS (
  SELECT product_id, string_agg(field, ' <NEXT_FEAT> ' ORDER BY spec_ord) AS feats
  FROM ov_fld WHERE spec_value IS NOT NULL GROUP BY 1),
overview AS (
  SELECT c.product_id,
         replace(replace('<OVERV_START> <NAME_START> ' || upper(c.title) || ' ' || upper(c.schema)
           || ' <NAME_END> <FEAT_START> ' || coalesce(a.feats, '') || ' <FEAT_END>', 'Yes ', ''), '"', ' Inch') AS input
  FROM catalog c LEFT JOIN ov_agg a ON a.product_id = c.product_id
  WHERE c.product_id IN (SELECT product_id FROM specs_long))"""
