"""One large quoted file is read by many tasks, with the rows that a reader of whole files gives."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from prodtext.sources import readers as RD
from prodtext.sources import splittable as SP

PARTS = ["a", "b,c", '"', '""', "\n", "\n\n", "\\", '\\"', "null", "[", "]", " ", "\r\n", "é😀", "word " * 9, ", ", ""]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(PARTS, k=rnd.randrange(6))) for _ in range(n)]


@pytest.fixture
def small_splits(spark):
    """Splits of 512 bytes: thousands of borders fall into quotes, escapes and line ends."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_csv_file_in_many_tasks(spark, tmp_path, small_splits):
    want = {}
    for f, end in (("one", "\n"), ("two", "\r\n")):
        rows = [(f"{f}{i}", t) for i, t in enumerate(texts(700, f))]
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end)
            w.writerow(["", "name", "description"])
            w.writerows([(i, *r) for i, r in enumerate(rows)])
        want |= dict(rows)
    path = str(tmp_path)
    assert SP.file_rows(spark, path).select("file", "split").distinct().count() > 40
    got = [tuple(r) for r in RD.read_descriptions_csv(spark, path).collect()]
    assert len(got) == len(want) and dict(got) == want
    ords = SP.read_csv_records(spark, path).groupBy("file").agg(F.min("ord"), F.max("ord"), F.count("*")).collect()
    assert [tuple(r)[1:] for r in ords] == [(1, 701, 701)] * 2


def test_csv_null_and_empty(spark, tmp_path):
    (tmp_path / "x.csv").write_text(',name,description\n0,a,\n1,b,""\n\n2,,"x\n\ny"\n3,d, e ')
    got = sorted((tuple(r) for r in RD.read_descriptions_csv(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("a", None), ("b", ""), (None, "x\n\ny"), ("d", " e ")], key=str)


def test_json_array_in_many_tasks(spark, tmp_path, small_splits):
    rnd = random.Random(5)
    values = [None if rnd.random() < 0.1 else t for t in texts(900, 7)]
    for name, kw in (("flat", {}), ("lines", {"indent": 1}), ("unicode", {"ensure_ascii": False, "separators": (",", ":")})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(values, **kw), encoding="utf-8")
        assert SP.file_rows(spark, str(path), '"').select("split").distinct().count() > 10
        got = [tuple(r) for r in RD.read_json_string_array(spark, str(path)).orderBy("doc_ord").collect()]
        assert got == list(enumerate(values, 1))


def test_json_small_arrays(spark, tmp_path):
    for name, text, want in (("empty", "[]", []), ("blank", " [ ] \n", []), ("one", '[""]', [""]), ("plain", '[1, true, null, "x"]', ["1", "true", None, "x"]), ("nulls", "[null,null]", [None, None])):
        (tmp_path / name).write_text(text)
        assert [r.text for r in RD.read_json_string_array(spark, str(tmp_path / name)).orderBy("doc_ord").collect()] == want


def test_line_numbers_in_many_tasks(spark, tmp_path, small_splits):
    lines = [random.Random(i).choice(["", "a", "b" * 70, 'say "x']) for i in range(2000)]
    (tmp_path / "list.txt").write_text("\n".join(lines) + "\n")
    got = [(r.ord, r.value) for r in RD.read_line_list(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == list(enumerate(lines, 1))


def test_file_is_shuffled_once(spark, tmp_path):
    """The splits' sums and both sorts of records come from one exchange of the lines."""
    (tmp_path / "x.csv").write_text("name\na\n")
    records = SP.read_csv_records(spark, str(tmp_path))
    records.collect()
    plan = records._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("Scan text") > 0 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ReusedExchange" in plan
