"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A rollup is a folder of committed batches.  A batch is a table of signed rows for each
(source, lang, version): documents, tokens and bytes, each the sum of the batch's inserts less
its deletes; a revised count enters as a delete of the old row and an insert of the new one.
Totals are the sums over all committed batches, so a batch is never read again once it is
added up, and a delete needs no look at other documents.

A commit is idempotent: a batch id that is committed already changes nothing, and one whose
writing broke off has no _SUCCESS file, is not counted and is written anew.

Defined results: null source and null lang are groups of their own; null text has no tokens;
repeated rows count each; groups whose documents come to 0 leave the totals; no batch gives
an empty total; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodtext.llm.common import ship

KEYS = ["source", "lang", "version"]
MEASURES = ["documents", "tokens", "bytes"]
SCHEMA = "source string, lang string, version string, documents bigint, tokens bigint, bytes bigint"
PIECE = 1 << 18  # characters encoded at once


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces that end between a letter or mark and a following blank, where the
    tokenizer's pattern always parts them; white space longer than a piece stays whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Vocabularies:
    """Vocabulary files as a broadcast value.  The encoders are made once in a worker process and
    stay with the value: made anew for each task, they would fill its memory."""

    def __init__(self, files: dict[str, bytes], pattern: str):
        self.files, self.pattern, self.made = files, pattern, None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def coders(self) -> dict:
        if self.made is None:
            import base64

            import tiktoken

            self.made = {}
            for v, lines in self.files.items():
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
                self.made[v] = tiktoken.Encoding(v, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.made


def token_counts(docs: DataFrame, tokenizers: dict[str, str], pattern: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and, for each version, tokens_<version>: the number of tokens of the
    whole text.  ``tokenizers`` maps versions to vocabulary files (base64 token and rank on
    each line); they are read here and sent to the tasks, some MB each."""
    shared = ship(docs.sparkSession, Vocabularies({v: open(p, "rb").read() for v, p in tokenizers.items()}, pattern))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders = shared().coders()
        for texts in batches:
            counts = {v: [] for v in coders}
            for text in texts:
                text = (text.as_py() or "").encode("utf-8", "replace").decode()
                for v, coder in coders.items():
                    counts[v].append(sum(len(coder.encode_ordinary(p)) for p in pieces(text)))
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts.values()], [f"tokens_{v}" for v in counts])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, ", ".join(f"tokens_{v} bigint" for v in tokenizers))
    return docs.select(*keep, udf(F.col("text")).alias("t")).select(*keep, "t.*")


def signed(rows: DataFrame, versions: list[str], sign: int) -> DataFrame:
    """Rows with source, lang, bytes and tokens_<version> as inserts (1) or deletes (-1)."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"tokens_{v}").alias("tokens")) for v in versions]))
    return (rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "bytes", each.alias("v"))
            .select("source", "lang", "v.version", F.lit(sign).cast("long").alias("documents"), (F.col("v.tokens") * sign).alias("tokens"), (F.col("bytes") * sign).alias("bytes")))


class Rollup:
    """Committed batches in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(x[len("batch="):] for x in found if x.startswith("batch=") and self._done(x[len("batch="):]))

    def _done(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; false, and no work, if that batch is committed."""
        if self._done(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        # a row for each source, language and version: one small file
        sums.where(" OR ".join(f"{m} <> 0" for m in MEASURES)).repartition(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """Sums of all committed batches; groups without documents are left out."""
        paths = [f"{self.path}/batch={b}" for b in self.committed()]
        deltas = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return deltas.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).where("documents <> 0")
