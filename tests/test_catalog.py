"""C2 'No' filter, C3 version merge, C4 field rendering, P6 whitelist order, R1 category union."""

from pyspark.sql import functions as F

from prodtext.operators import catalog as C
from prodtext.operators import render as R


def specs(spark, rows):
    return spark.createDataFrame(rows, "product_id string, spec_ord int, spec_key string, spec_value string")


def test_spec_filter_keeps_nulls(spark):
    df = specs(spark, [("p", 1, "a", "No"), ("p", 2, "b", None), ("p", 3, "package_x", "1"), ("p", 4, "c", "no")])
    assert sorted(r.spec_key for r in C.spec_filter(df).collect()) == ["b", "c"]


def _merge(spark, rows):
    df = specs(spark, rows).withColumn("group_ord", F.lit(1))
    out = C.version_merge(df).orderBy("spec_ord").collect()
    return [(r.spec_key, r.spec_value) for r in out]


def test_version_merge_both_orders(spark):
    a = _merge(spark, [("p", 1, "hdmi", "3"), ("p", 2, "hdmi_version", "2.0"), ("p", 3, "usb_version", "3.0"),
                       ("p", 4, "x", None), ("p", 5, "y", "v")])
    b = _merge(spark, [("p", 1, "hdmi_version", "2.0"), ("p", 2, "hdmi", "3"), ("p", 3, "y", "v")])
    assert a == [("y", "v"), ("hdmi 2.0", "3")]
    assert b == [("y", "v"), ("hdmi 2.0", "3")]


def test_render_field_rules(spark):
    cat = spark.createDataFrame([("p", "t", "s")], "product_id string, title string, schema string")
    rules = spark.createDataFrame([("s", "a", None, False), ("s", "b", "", False), ("s", "c", "Hz", True)],
                                  "schema string, spec_key string, parameter_name string, to_upper boolean")
    df = specs(spark, [("p", 1, "a", "Yes"), ("p", 2, "b", "7, x"), ("p", 3, "c", "fast"), ("p", 4, "wi-fi_x", "on")])
    got = {r.spec_key: r.field for r in R.render_field(df, cat, rules).collect()}
    assert got == {"a": "Yes", "b": "7 ", "c": "FAST Hz", "wi-fi_x": "on " + "wi-fi x".title()}


def test_whitelist_order_and_missing(spark):
    cat = spark.createDataFrame([("p", "s")], "product_id string, schema string")
    wl = spark.createDataFrame([("s", 1, "z"), ("s", 2, "missing"), ("s", 3, "a")], "schema string, ord int, spec_key string")
    df = specs(spark, [("p", 1, "a", "1"), ("p", 2, "z", None), ("p", 3, "q", "2")])
    out = C.spec_whitelist(df, cat, wl).orderBy("spec_ord").collect()
    assert [(r.spec_key, r.spec_value) for r in out] == [("z", None), ("a", "1")]


def test_sample_is_seeded_and_capped(spark):
    df = specs(spark, [("p", i, f"k{i}", "v") for i in range(15)]).withColumn("group_ord", F.lit(1))
    a = [r.spec_key for r in C.spec_sample(df).orderBy("spec_ord").collect()]
    b = [r.spec_key for r in C.spec_sample(df).orderBy("spec_ord").collect()]
    assert a == b and len(a) == 10 and len(set(a)) == 10


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_are_never_broadcast(spark):
    """Rows of products and specs are few in the planner's guess and many in fact."""
    cat = spark.createDataFrame([("p", "t", "s"), ("q", "u", "s"), (None, "v", "s")], "product_id string, title string, schema string")
    df = specs(spark, [("p", 1, "a", "1"), ("p", 2, "b", None)])
    wl = spark.createDataFrame([("s", 1, "a", 1)], "schema string, ord int, spec_key string, feat_ord int")
    some, rejected, filled = C.with_specs(cat, df), C.rejected_products(cat, df), C.spec_project_nullfill(cat, df, wl)
    listed = C.spec_whitelist(df, cat, wl)
    assert [r.title for r in some.collect()] == ["t"]
    assert sorted(r.product_id or "" for r in rejected.collect()) == ["", "q"]
    assert sorted((r.product_id or "", r.spec_value) for r in filled.collect()) == [("", None), ("p", "1"), ("q", None)]
    assert [r.spec_value for r in listed.collect()] == ["1"]
    for frame in (some, rejected, filled, listed):
        assert "SortMergeJoin" in _plan(frame)
    for frame in (some, rejected):
        assert "Broadcast" not in _plan(frame)


def test_catalog_is_not_broadcast_for_its_keys(spark):
    """The wanted keys are few, whatever the planner guesses of their joins; products are many."""
    from prodtext.sources import fixtures as FX
    features, groups, blacklist = (spark.sql(FX.FIXTURES[n](FX.SPARK)) for n in ("features", "groups", "blacklist"))
    cat = spark.range(2000).selectExpr("if(id % 9 = 0, NULL, cast(id as string)) AS product_id", "'t' AS title", "if(id % 2 = 0, 'medium', NULL) AS schema")
    out = C.specs_by_category(cat, specs(spark, [("2", 1, "bore", "7"), ("2", 2, "gauge", "No"), (None, 1, "bore", "1")]), features, groups, blacklist)

    def broadcasts(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        return [node.toString()] * node.nodeName().startswith("BroadcastExchange") + [x for k in kids for x in broadcasts(k)]

    found = broadcasts(out._jdf.queryExecution().executedPlan().initialPlan())
    assert found and not any("Range" in x for x in found)
    got = {(r.spec_key, r.spec_value) for r in out.where("product_id = '2'").collect()}
    assert ("bore", "7") in got and "gauge" not in {k for k, _ in got}
    assert out.where("product_id IS NULL AND spec_value IS NOT NULL").isEmpty()


def test_sample_sorts_behind_the_shuffle_only(spark):
    """A task that explodes products holds none of their specs for a sort."""
    df = specs(spark, [("p", i, f"k{i}", "v") for i in range(15)] + [(None, 1, "a", "v"), ("q", 1, "a", None)])
    out = C.spec_sample(df, part_cols=("product_id",))
    assert sorted((r.product_id or "", r.spec_ord) for r in out.collect()) == [("", 1)] + [("p", i + 1) for i in range(10)] + [("q", 1)]
    plan = _plan(C.spec_sample(df, part_cols=("product_id",)))
    assert "Exchange" in plan and "Sort" not in plan[plan.index("Exchange"):]
