"""Checkpoint folder resolution: the cluster's setting wins; only a local session may do without."""

import pytest

from prodtext import session as S


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if self.value else default


class _Ctx:
    def __init__(self, master):
        self.dir, self.master = None, master

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, value, master="spark://host:7077"):
        self.conf, self.sparkContext = _Conf(value), _Ctx(master)


def test_cluster_setting_is_used():
    s = _Spark("/shared/ckpt")
    assert S.ensure_checkpoint_dir(s) == "/shared/ckpt"
    assert s.sparkContext.dir == "/shared/ckpt"


def test_unset_on_a_cluster_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            S.ensure_checkpoint_dir(_Spark(None, master))


def test_unset_locally_creates_one_scratch_folder(monkeypatch):
    monkeypatch.setattr(S, "delete_at_end", lambda spark, path: None)
    s = _Spark(None, "local[8]")
    first = S.ensure_checkpoint_dir(s)
    assert S.ensure_checkpoint_dir(s) == first == s.sparkContext.dir


def test_written_tables_leave_no_shuffle_files(spark):
    """What a cut table was made with is deleted once it is written."""
    import time

    from prodtext.session import cut_lineage

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName().split("_")[1] for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    before, conf = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    assert cut_lineage(spark.range(1000).repartition(4, "id")).count() == 1000
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert len(left) <= 1  # the count's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == conf
