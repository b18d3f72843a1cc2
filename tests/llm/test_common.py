"""Shared folder, shipped values, files and names."""

import os
import subprocess
import sys

import pytest

from prodtext.llm import common as C
from prodtext.llm.toxicity import Machine


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, folder, master="spark://host:7077"):
        self.sparkContext, self.conf = _Context(master), self
        self.folder = folder

    def get(self, key, default=None):
        return self.folder or default


def test_shared_folder_is_the_clusters():
    assert C.shared_dir(_Session("/shared/x")) == "/shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.shared_dir(_Session(None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.shared_dir(_Session(None, "local-cluster[3,2,1000]"))


def test_shipped_values_need_no_package_in_the_task(spark):
    import numpy as np

    get = C.ship(spark, Machine(10, 2, np.arange(3), np.ones(3)))
    assert get() is get() and get().bits == 10
    sent = C.cloudpickle.dumps(Machine(10, 2, np.arange(3), np.ones(3)))
    code = "import pickle, sys; m = pickle.load(sys.stdin.buffer); print(type(m).__name__, len(m.slots), m.score('a b'))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], input=sent, cwd="/", env=env, capture_output=True)
    assert out.stdout.startswith(b"Machine 3 0.5"), out.stderr[-500:]


def test_cut_and_gathered(spark, documents):
    assert (C.files_for(0), C.files_for(C.ROWS_PER_FILE)) == (1, 2)
    many = C.cut(documents.repartition(9))
    assert len(C.cut(many, rows=many.count()).inputFiles()) == 1
    assert C.gathered(many).exceptAll(documents).count() == 0
    memory = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert C.gathered(memory).count() == 1


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, Row_No int, row_no_ int")
    assert C.free_name(df, "row_no") == "row_no__" and C.free_name(df, "b") == "b"
