"""Plan checks: small dimensions are broadcast by the planner's own choice, filters reach the
scan, Python only in the similarity and vector steps."""

from pathlib import Path

import __spark_entry__ as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dims_broadcast_and_pushdown(spark, sf_dir):
    p = plan(E.queries()["render_prompt_category"](spark, sf_dir))
    assert "BroadcastHashJoin" in p
    p2 = plan(E.queries()["select_by_schema"](spark, sf_dir))
    assert "PushedFilters" in p2


def test_no_broadcast_hints():
    root = Path(E.__file__).parent / "prodtext"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "broadcast(" not in f.read_text(), f


def test_python_only_where_expected(spark, sf_dir):
    for name in ["complete_input", "kfold_extraction_quality", "evaluate_candidates", "storyboard"]:
        p = plan(E.queries()[name](spark, sf_dir))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
    assert "ArrowEvalPython" in plan(E.queries()["clean_review"](spark, sf_dir))


def test_tagged_reads_every_document(spark, sf_dir):
    from prodtext.sources.fixtures import fixture
    assert fixture(spark, sf_dir, "tagged").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").count()


def test_category_blacklist_and_sample_bite(spark, sf_dir):
    q = E.queries()
    assert 0 < q["category_blacklist"](spark, sf_dir).count() < q["features_lookup"](spark, sf_dir).count()
    assert 0 < q["spec_sample10"](spark, sf_dir).count() < q["version_merge"](spark, sf_dir).count()
