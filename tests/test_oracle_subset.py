"""Spark queries vs their DuckDB oracles on sf0.001 (a representative subset; the full set
runs with tools/check_oracle.py)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from prodtext.sources.tables import TABLES

SUBSET = ["complete_input", "spec_sample10", "version_merge", "entity_positions", "span_metrics",
          "render_training_record", "bleu", "candidate_mean_std", "title_detect", "align_features",
          "parse_review_paragraphs", "json_props", "similarity_ratio", "clean_review",
          "gazetteer_predict", "assemble_review", "line_list_file", "json_array_file", "embedding_pairs"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = E.queries()[name](spark, sf_dir)
    cols = df.columns
    srows = Counter(tuple(repr(_norm(r[c])) for c in sorted(cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = Counter(tuple(repr(_norm(r[i])) for i in order) for r in res.fetchall())
    assert sorted(cols) == sorted(dcols)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
