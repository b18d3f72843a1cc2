"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed in segments, as search engines do: each segment is one row of
a stored table and holds, for some hundred documents, the sorted list of (term, position)
postings of the test terms.  Documents lie behind each other with a gap, so one position
names a document and a place in it.  A test item is searched by windows of consecutive
words.  For each window the offset-adjusted posting lists are intersected from its rarest
term in the whole corpus on: the rarest list gives the candidate starts, and each further term
keeps those starts whose word stands where it should (exact), or within ``slop`` words of
there (proximity).

Only terms of the test set are indexed, as no other list is ever read.  The test set goes to
every task and is bounded by ``max_test_words``; a larger one is searched in blocks of items,
numbered by a running sum of their words, each with an index of its own terms, and the results are
joined by a row id that is written once.

Defined results: null and empty texts have no words and are clean; items without words match
nothing; items of one id count once; an item with null id marks words but is not listed;
repeated rows are documents of their own; empty tables give an empty or a clean result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodtext.llm.common import cut, gathered, ship

#: every byte of [\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing, ends a word
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: the same words, before lower-casing
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEGMENT_WORDS = 1 << 17  # some hundred KB of postings: segments also travel in batches


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The windows of a block of test items: ``term`` and ``offset`` are matrices with a row for
    each window, terms from the rarest to the most frequent, unused places -1."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        rows = [(i, s, min(width, len(t))) for i, t in enumerate(texts) if t for s in range(max(1, len(t) - width + 1))]
        self.item = np.array([r[0] for r in rows], dtype=np.int32)
        self.length = np.array([r[2] for r in rows], dtype=np.int64)
        self.term = np.full((len(rows), width), -1, dtype=np.int64)
        for k, (i, s, n) in enumerate(rows):
            self.term[k, :n] = texts[i][s:s + n]
        self.offset = np.tile(np.arange(width, dtype=np.int64), (len(rows), 1))

    def by_rarity(self, frequency: np.ndarray) -> Windows:
        rank = np.where(self.term < 0, np.iinfo(np.int64).max, frequency[self.term] if len(frequency) else 0)
        order = np.argsort(rank, axis=1, kind="stable")
        self.term, self.offset = np.take_along_axis(self.term, order, 1), np.take_along_axis(self.offset, order, 1)
        return self


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Store the segments of (row, doc_id, text) as a table: rows and doc_ids, the documents'
    first positions and lengths, and the postings: terms, their counts, and positions."""
    shared = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared()

        def segment(rows, doc_ids, lengths, terms):
            lengths = np.array(lengths, dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])).astype(np.int64)
            held = [(t >= 0).nonzero()[0] for t in terms]
            at = np.concatenate([h + s for h, s in zip(held, starts)]) if held else np.empty(0, np.int64)
            term = np.concatenate([t[h] for t, h in zip(terms, held)]) if held else np.empty(0, np.int32)
            order = np.argsort(term, kind="stable")  # by term, then position
            found, counts = np.unique(term, return_counts=True)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [one(rows, pa.int64()), one(doc_ids, id_type), one(starts, pa.int64()), one(lengths, pa.int64()), one(found, pa.int32()), one(counts, pa.int32()),
                 pa.array([at[order].astype("<i8" if len(at) and at.max() >= 2**31 else "<i4").tobytes()], pa.binary())], names)

        rows, doc_ids, lengths, terms, total = [], [], [], [], 0
        for b in batches:
            id_type = b.column(1).type
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = words_of(text.as_py() or b"")
                rows.append(row)
                doc_ids.append(doc_id)
                lengths.append(len(words))
                terms.append(np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words)))
                total += len(words) + gap
                if total >= segment_words:
                    yield segment(rows, doc_ids, lengths, terms)
                    rows, doc_ids, lengths, terms, total = [], [], [], [], 0
        if rows:
            yield segment(rows, doc_ids, lengths, terms)

    names = ["rows", "doc_ids", "starts", "lengths", "terms", "counts", "positions"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"rows array<bigint>, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>, terms array<int>, counts array<int>, positions binary"
    return cut(gathered(docs.select("row", "doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, out), "postings")


def _members(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, wanted)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _near(keys: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    at = np.searchsorted(keys, wanted - slop)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= wanted + slop) if len(keys) else np.zeros(len(wanted), bool)


def intersect(win: Windows, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int = 0, block: int = 1 << 20):
    """(window, start) of all matches in a segment: lists are intersected from the rarest term
    on, as many windows at once as their rarest lists hold ``block`` positions."""
    if not len(terms) or not len(win.item):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    far = 1 << 40
    keys = np.repeat(terms.astype(np.int64) * far, counts) + positions  # sorted: term-major, then position
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = np.minimum(np.searchsorted(terms, win.term[:, 0]), len(terms) - 1)
    n = np.where(terms[at] == win.term[:, 0], counts[at], 0).astype(np.int64)
    out_w, out_s = [], []
    alive = np.flatnonzero(n)
    cuts = np.flatnonzero(np.diff(np.cumsum(n[alive]) // block)) + 1
    for group in np.split(alive, cuts):
        w = np.repeat(group, n[group])
        nth = np.arange(len(w)) - np.repeat(np.cumsum(n[group]) - n[group], n[group])
        start = positions[first[at[w]] + nth] - win.offset[w, 0]
        for k in range(1, win.term.shape[1]):
            used = win.term[w, k] >= 0
            wanted = win.term[w, k] * far + start + win.offset[w, k]
            good = ~used | (_near(keys, wanted, slop) if slop else _members(keys, wanted))
            w, start = w[good], start[good]
            if not len(w):
                break
        out_w.append(w)
        out_s.append(start)
    return (np.concatenate(out_w), np.concatenate(out_s)) if out_w else (np.empty(0, np.int64), np.empty(0, np.int64))


def search(index: DataFrame, win: Windows, slop: int = 2) -> DataFrame:
    """One row per document: row, doc_id, n_words, spans (start, stop of the words in exact
    matches, merged), items (ids matched exactly, sorted as text) and near_items (ids
    matched within ``slop`` words, exact ones included).  ``slop`` 0 leaves proximity out."""
    shared = ship(index.sparkSession, win)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def spans_of(start, stop):
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.maximum.accumulate(stop[order])
        new = np.concatenate(([True], start[1:] > stop[:-1]))
        return [{"start": int(a), "stop": int(z)} for a, z in zip(start[new], np.concatenate((stop[:-1][new[1:]], stop[-1:])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = shared()
        for b in batches:
            for i in range(b.num_rows):
                seg = b.slice(i, 1).to_pylist()[0]
                terms, counts = np.array(seg["terms"], dtype=np.int64), np.array(seg["counts"], dtype=np.int64)
                raw = seg["positions"]
                positions = np.frombuffer(raw, "<i8" if len(raw) == 8 * counts.sum() else "<i4").astype(np.int64)
                starts, lengths = np.array(seg["starts"], dtype=np.int64), np.array(seg["lengths"], dtype=np.int64)
                n = len(starts)
                spans, items, near = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                for width, into in ((slop, near), (0, items)):
                    if into is near and not slop:
                        continue
                    w, s = intersect(win, terms, counts, positions, width)
                    doc = np.searchsorted(starts, s + (width if into is near else 0), side="right") - 1
                    for d in np.unique(doc):
                        mine = doc == d
                        into[d] = sorted({win.names[i] for i in win.item[w[mine]].tolist()} - {None})
                        if into is items:
                            spans[d] = spans_of(s[mine] - starts[d], s[mine] - starts[d] + win.length[w[mine]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg["rows"], pa.int64()), pa.array(seg["doc_ids"], b.column("doc_ids").type.value_type), pa.array(lengths),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                    ["row", "doc_id", "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(run, f"row bigint, doc_id {kind}, n_words bigint, spans array<struct<start: bigint, stop: bigint>>, items array<string>, near_items array<string>")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Results of several item blocks as one row per document; touching spans are merged."""
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merge = ("aggregate(array_sort(flatten(collect_list(spans))), cast(array() AS array<struct<start: bigint, stop: bigint>>), (a, s) -> "
             "if(size(a) > 0 AND a[size(a) - 1].stop >= s.start, concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start AS start, greatest(a[size(a) - 1].stop, s.stop) AS stop))), concat(a, array(s))))")
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy("row", "doc_id", "n_words").agg(F.expr(merge).alias("spans"), joined("items"), joined("near_items"))


def _blocks(benchmark: DataFrame, max_test_words: int) -> tuple[DataFrame, list[int]]:
    """The distinct items as a stored table (block, id, text), and the blocks in order.  A block is
    a run of items, ordered by (id, text), that begins inside one stretch of ``max_test_words`` words,
    so it has that many and one item's more at most.  Items are sorted in range partitions; a word's
    number is its place there plus the words of the partitions ahead."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).distinct()
    held = cut(items.repartitionByRange("i", "t").withColumn("words", F.coalesce(F.regexp_count("t", F.lit(_WORD)), F.lit(0)).cast("long"))
               .withColumn("part", F.spark_partition_id()), "items")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = held.groupBy("part").agg(F.sum("words").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("i", "t").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    out = cut(held.join(before, "part").select(F.floor(start / max_test_words).cast("long").alias("block"), "i", "t"), "item-blocks")
    return out, sorted(r[0] for r in out.select("block").distinct().collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 2, max_test_words: int = 1_000_000, row: str | None = None) -> DataFrame:
    """The result of ``search`` for all items of (item_id, text) against all documents.

    The driver holds the windows of one block of items at a time.  With several blocks the documents
    are written once with their row ids, which all blocks' results are joined by, and each block's
    result is written before the next block is made.  ``row`` names a column that has written ids."""
    rows = docs.withColumn("row", F.col(row) if row else F.monotonically_increasing_id()).select("row", "doc_id", "text")
    items, blocks = _blocks(benchmark, max_test_words)
    several = len(blocks) > 1
    if several and not row:
        rows = cut(gathered(rows), "numbered")
    parts = []
    for block in blocks or [0]:
        texts = items.where(F.col("block") == block).select("i", F.col("t").cast("binary").alias("t")).orderBy("i", "t").toLocalIterator()
        win = Windows([(r["i"], words_of(bytes(r["t"] or b""))) for r in texts], width)
        index = build_index(rows, win.vocabulary, gap=width + 2 * slop + 1)
        total = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n")).collect()  # vocabulary of the block
        frequency = np.zeros(len(win.vocabulary), dtype=np.int64)
        for term, n in total:
            frequency[term] = n
        found = search(index, win.by_rarity(frequency), slop)
        parts.append(cut(found, "found") if several else found)
    return _merged(parts)
