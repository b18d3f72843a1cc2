"""Round trip render -> write -> read -> parse; split/fold invariants; packing."""

import random
import re
import uuid


from prodtext.operators import corpus as CO
from prodtext.operators import render as R
from prodtext.session import ensure_checkpoint_dir
from prodtext.sources import sinks as SK


def test_record_round_trip(spark):
    rows = [(1, "n1", "line one\nline two", ["a", "b (c)"]), (2, "n2", "plain", []), (3, None, "x", ["q"])]
    df = spark.createDataFrame(rows, "doc_id long, name string, description string, att_list array<string>")
    recs = R.render_training_record(df)
    assert recs.count() == 2
    assert R.training_skip_count(df).first().skipped == 1
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    SK.write_records(recs, path)
    parsed = {r.title: r for r in CO.parse_training_record(CO.read_records(spark, path)).collect()}
    assert parsed["n1"].Description == "line oneline two"
    assert parsed["n1"].input == "a <br> b (c)"
    assert parsed["n2"].input == ""
    assert parsed["n2"].reject_reason is None


def test_split_partitions_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    s = CO.split_train_valid_test(docs)
    assert s.count() == docs.count()
    assert set(r.split for r in s.select("split").distinct().collect()) <= {"train", "valid", "test"}


def test_pack_sequences(spark):
    df = spark.createDataFrame([("a b  c",)], "text string")
    r = CO.pack_sequences(df, max_len=5).first()
    assert r.tokens == ["a", "b", "c", "<|PAD|>", "<|PAD|>"] and r.attention_mask == [1, 1, 1, 0, 0]


def test_line_ends_and_digest_dedupe(spark):
    """A carriage return, NEL or line separator inside a part does not end it."""
    rec = "<OVERV_START> <NAME_START> n\x85m <NAME_END> <FEAT_START> a\rb <FEAT_END> <DESCR_START> one\rtwo\u2028three <DESCR_END>"
    r = CO.parse_training_record(spark.createDataFrame([(rec,)], "record string")).first()
    assert (r.title, r.input, r.Description, r.reject_reason) == ("n\x85m", "a\rb", "one\rtwo\u2028three", None)
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None), (4, "d", None), (5, "e", "y")], "doc_id long, name string, description string")
    got = CO.dedupe_descriptions(df).collect()
    assert sorted(str(r.description) for r in got) == ["None", "x", "y"]


def test_dedupe_repeated_and_null_ids(spark):
    rows = [(1, "A"), (1, "A"), (2, "A"), (None, "B"), (None, "B"), (None, "C"), (3, "C"), (4, None), (5, None), (None, None), (1, "D")]
    df = spark.createDataFrame(rows, "doc_id long, description string")
    got = [tuple(r) for r in CO.dedupe_descriptions(df).collect()]
    assert sorted(t or "" for _, t in got) == ["", "A", "B", "C", "D"] and set(got) <= set(rows)
    got = {tuple(r) for r in CO.dedupe_ordered(df, by="description").collect()}
    assert got == {(1, "A"), (None, "B"), (3, "C"), (4, None), (1, "D")}


def test_exact_sizes(spark):
    for n in (0, 1, 7, 10, 95, 1000):
        df = spark.range(n).withColumnRenamed("id", "doc_id")
        split = {r["split"]: r["count"] for r in CO.split_exact(df).groupBy("split").count().collect()}
        train = n * 9 // 10
        valid = (n - train) * 8 // 10
        assert split == {k: v for k, v in (("train", train), ("valid", valid), ("test", n - train - valid)) if v}
    folds = [r["count"] for r in CO.kfold_exact(df.limit(995)).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [100] * 5 + [99] * 5
    assert CO.sample_exact(df, 37).count() == 37 and CO.sample_exact(df, 5000).count() == 1000
    assert CO.kfold_exact(df).orderBy("doc_id").collect() == CO.kfold_exact(df.repartition(7)).orderBy("doc_id").collect()


def test_exact_order_at_equal_hashes(spark):
    """Passes of few bits over many rows, repeated keys and null: the order is that of (hash, key)."""
    ids = [None, None, *[i % 150 for i in range(400)]]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    from prodtext.functions.text import hash_bucket
    order = sorted(((r.h, r.doc_id is not None, r.doc_id or 0) for r in df.withColumn("h", hash_bucket(42, "doc_id")).collect()))
    for rank, cut in zip((0, 5, 200, 401, 402), CO.rank_cuts(df, [0, 5, 200, 401, 402])):
        assert cut == ((order[rank][0], order[rank][2] if order[rank][1] else None) if rank < len(order) else None)


def test_parsed_parts_are_those_of_the_patterns(spark):
    """Plain search finds what the non-greedy patterns find, with newlines and without."""
    rnd = random.Random(3)
    bits = ["<NAME_START> ", " <NAME_END>", " <FEAT_START> ", " <FEAT_END>", " <DESCR_START> ", " <DESCR_END>", "a", "é😀 ", " ", "\n", "\r", "<NEXT_FEAT>", "br><h2>", "<DESCR_START>"]
    records = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    rows = CO.parse_training_record(spark.createDataFrame(list(enumerate(records)), "i int, record string").orderBy("i")).collect()
    assert len(rows) == len(records)

    def hit(tag, text):
        found = re.search(f"<{tag}_START> ([^\n]*?) <{tag}_END>", text)
        return found and found.group(1)

    for record, r in zip(records, rows):
        orig = record.split(" <DESCR_START>", 1)[0]
        feats = hit("FEAT", orig)
        want = (orig, feats and feats.replace("<NEXT_FEAT>", "<br>").replace("br><h2>", "").replace("</li><li>", ""), hit("NAME", orig), hit("DESCR", record))
        assert (r.originalInput, r.input, r.title, r.Description) == want, record


def test_blank_records_are_found_without_rewriting_the_text(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a b <OVERV_END>  \n\t  <OVERV_END>c　 <OVERV_END>\n", encoding="utf-8")
    found = CO.read_records(spark, str(tmp_path))
    assert sorted(r.record for r in found.collect()) == ["a b", "c　"]
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
