"""N-gram Jaccard join by T-occurrence search.

A text's set holds the 64-bit hashes of its word shingles.  Two sets of similarity t share at least
t of the elements of either, so a document's partners occur at least T = ceil(t * n) times in the
inverted lists of its n shingles.

1. The inverted index is made in buckets of the hash range.  A task gathers the postings of up to
   ``FLUSH`` shingles and sends each bucket one sorted run; a shingle that occurs more than once in it
   is sent once with its count, so a shingle of a third of all documents is one entry for each
   flush.  What comes back to a flush are its shingles that any other document has too.
2. A document with fewer than T shared shingles has no partner.  Of the others, equal sets
   become one, and its shingles are ordered by the length of their lists.  Any partner is in one of
   the n - T + 1 shortest lists; documents that meet there, directly or by others, are
   a cluster, and only members of a cluster are compared.
3. A cluster is searched in one task by DivideSkip: of a document's lists in the cluster, the
   short ones are merged and occurrences counted; what has at least T - L is looked up in the L
   long ones by binary search; the overlap then decides exactly.  A large cluster is dealt into cells
   by size class (partners differ by one class at most) and hash, and each pair of cells is a task.
   Pairs are counted, and only a spanning forest of them leaves the task.

Defined results: null, empty and blank texts have no shingle and link with nothing; a text of fewer
words is one shingle; repeated rows are rows of one set; component_id is the smallest non-null
doc_id of the component (null if it has none); n_links counts the other rows linked with a row, those
of equal sets included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prodtext.llm.common import cut, gathered
from prodtext.llm.simhash import SLICE, _word_slices, components

FLUSH = 1 << 20        # postings that a task gathers before it sends them
BUCKET = 1 << 20       # aim for the postings of a bucket
CELL = 1 << 20         # aim for the shingles of a cell of a cluster
PROBES = 1 << 22       # binary searches of long lists that are made at once
WORDS_HELD = 100_000   # words whose hash a task remembers; a word that is not is hashed again
LONG_LIST = 0.1        # weight of the longest list's logarithm in the number of long lists


class Shingler:
    """Distinct shingle hashes of a text: a word's XXH64, combined by odd multipliers."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.factors = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), 7) | 1) for i in range(width)]

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = digest(w, 42)
                if len(w) <= 32:
                    if len(known) >= WORDS_HELD:
                        known.clear()
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def _combined(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes) - width + 1
        total = np.full(n, width, np.uint64)
        for i, factor in enumerate(self.factors[:width]):
            total += hashes[i:i + n] * factor
            total ^= total >> np.uint64(31)
        return total * np.uint64(0x9E3779B97F4A7C15)

    def of(self, text: bytes) -> np.ndarray:
        """Sorted and distinct."""
        parts, carry = [], np.empty(0, np.uint64)
        for words in _word_slices(text.lower()):  # of bytes: A-Z only
            hashes = np.concatenate((carry, self._hashes(words)))
            if len(hashes) >= self.width:
                parts.append(np.unique(self._combined(hashes, self.width)))
                hashes = hashes[len(hashes) - self.width + 1:]
            carry = hashes
        if not parts:
            return self._combined(carry, len(carry)) if len(carry) else carry
        return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _bytes(a: np.ndarray, kind: str) -> bytes:
    return a.astype(kind).tobytes()


def _named(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A shingle's name is its bucket, the first ``bits`` bits of its hash (16 at most), and its last 48
    bits: as a bucket holds about ``BUCKET`` postings, these tell its shingles apart at any number of buckets."""
    top = hashes >> np.uint64(64 - min(bits, 16)) if bits else np.zeros_like(hashes)
    return top << np.uint64(48) | hashes & np.uint64((1 << 48) - 1)


def _low(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _whole(low: bytes, bucket: int, bits: int) -> np.ndarray:
    """Names of which a bucket was sent the last 48 bits."""
    out = np.zeros((len(low) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64((bucket >> max(0, bits - 16)) << 48)


def _flush_schema(id_type: T.DataType) -> T.StructType:
    """A flush's documents (kind 0), or postings (kind 1: of a bucket; kind 2: back to their flush)."""
    return T.StructType([T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("flush", T.LongType()),
                         T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(c, T.BinaryType()) for c in ("sizes", "keys", "once", "doc", "often", "count")]])


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def _postings(width: int, bits: int, schema: pa.Schema):
    """(doc_id, text) to flushes.  A flush's row keeps the documents (ids, sizes, set keys) and the
    postings of shingles that occur in it more than once; the others go to buckets with their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, n_flushes = Shingler(width), 0
        ids, sets, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_flushes
            number = (TaskContext.get().partitionId() << 30) + n_flushes
            n_flushes += 1
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            hashes, doc = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
            buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            hashes = _named(hashes, bits)
            order = np.lexsort((hashes, buckets)) if bits > 16 else np.argsort(hashes, kind="stable")
            hashes, doc, buckets = hashes[order], doc[order], buckets[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))[:len(hashes)]
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate((first, [len(hashes)])))
            many = np.repeat(count > 1, count)
            rows = [{"part": number, "kind": 0, "flush": number, "ids": list(ids), "sizes": _bytes(sizes, "<i8"),
                     "keys": b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "often": _bytes(hashes[many], "<u8"), "doc": _bytes(doc[many], "<u2")}]
            once, once_doc, often, count = hashes[~many], doc[~many], hashes[first][count > 1], count[count > 1]
            once_in, often_in = buckets[~many], buckets[first][np.diff(np.concatenate((first, [len(hashes)]))) > 1]
            used = np.unique(buckets)
            a, z = np.searchsorted(once_in, np.append(used, 1 << bits)), np.searchsorted(often_in, np.append(used, 1 << bits))
            rows += [{"part": int(b), "kind": 1, "flush": number, "once": _low(once[a[i]:a[i + 1]]), "doc": _bytes(once_doc[a[i]:a[i + 1]], "<u2"),
                      "often": _low(often[z[i]:z[i + 1]]), "count": _bytes(count[z[i]:z[i + 1]], "<u4")} for i, b in enumerate(used)]
            ids.clear(), sets.clear()
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[at:at + 64], schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = shingler.of(text.as_py() or b"")
                ids.append(doc_id)
                sets.append(found)
                held += len(found)
                if held >= FLUSH or len(ids) == 1 << 16:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of a sorted stream, gathered while the key stays the same."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shared(bits: int, schema: pa.Schema):
    """Postings sorted by bucket, to those of shingles that occur more than once, back to their
    flush with the length of the list.  Rows of flushes pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(held: list[dict]) -> Iterator[pa.RecordBatch]:
            get = lambda row, column, kind: np.frombuffer(row[column] or b"", kind)
            once, often = ([_whole(r[c], r["part"], bits) for r in held] for c in ("once", "often"))
            hashes = np.concatenate(once + often)
            count = np.concatenate([np.ones(sum(map(len, once)), np.int64), *[get(r, "count", "<u4") for r in held]])
            order = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
            total = np.empty(len(hashes), np.int64)
            total[order] = np.repeat(np.add.reduceat(count[order], first), np.diff(np.concatenate((first, [len(hashes)]))))
            at, rows = 0, []
            starts = np.cumsum([0, *map(len, once)])
            at_often = starts[-1]
            for r, a, z, start in zip(held, once, often, starts):
                df, df_often = total[start:start + len(a)], total[at_often:at_often + len(z)]
                at_often += len(z)
                more = df > 1
                if more.any() or len(z):
                    rows.append({"part": r["flush"], "kind": 2, "flush": r["flush"], "once": a[more].tobytes(), "doc": get(r, "doc", "<u2")[more].tobytes(),
                                 "often": z.tobytes(), "count": _bytes(np.minimum(np.concatenate((df[more], df_often)), 2**32 - 1), "<u4")})
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[at:at + 64], schema)

        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    yield pa.RecordBatch.from_pylist([row], schema)
                    continue
                if held and held[0]["part"] != row["part"]:
                    yield from bucket(held)
                    held = []
                held.append(row)
        if held:
            yield from bucket(held)

    return run


DOC_FIELDS = [T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
              T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("short", T.IntegerType())]


def _documents(percent: int, schema: pa.Schema):
    """A flush's row and the shared postings that came back to it, to one row per document.  ``key``
    names the set of a document that can have partners (null: it cannot); the first document of a
    key in the flush brings ``terms``, the shared shingles by length of list, and ``short``, how many of
    them belong to the n - T + 1 shortest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, "part"):
            head, rest = held[0], held[1:]
            get = lambda row, column, kind: np.frombuffer(row[column] or b"", kind)
            sizes = get(head, "sizes", "<i8")
            many, many_doc = get(head, "often", "<u8"), get(head, "doc", "<u2")
            often, often_df = np.concatenate([np.empty(0, np.uint64), *[get(r, "often", "<u8") for r in rest]]), [np.empty(0, np.uint32)]
            once, once_doc, once_df = [], [], []
            for r in rest:
                a, df = get(r, "once", "<u8"), get(r, "count", "<u4")
                once.append(a), once_doc.append(get(r, "doc", "<u2")), once_df.append(df[:len(a)]), often_df.append(df[len(a):])
            order = np.argsort(often)
            often, often_df = often[order], np.concatenate(often_df)[order]
            hashes = np.concatenate([many, *once])
            doc = np.concatenate([many_doc, *once_doc]).astype(np.int64)
            df = np.concatenate([often_df[np.searchsorted(often, many)], *once_df])
            order = np.lexsort((hashes, df, doc))
            hashes, doc = hashes[order].view(np.int64), doc[order]
            start = np.searchsorted(doc, np.arange(len(sizes) + 1))
            shared, need = np.diff(start), -(-percent * sizes // 100)
            seen: set[bytes] = set()
            for at in range(0, len(sizes), 512):
                rows = []
                for i in range(at, min(at + 512, len(sizes))):
                    row = {"doc_id": head["ids"][i], "row": (head["flush"] << 16) + i, "n": int(sizes[i])}
                    if sizes[i] and shared[i] >= need[i]:
                        row["key"] = head["keys"][16 * i:16 * i + 16]
                        if row["key"] not in seen:
                            seen.add(row["key"])
                            row["terms"], row["short"] = hashes[start[i]:start[i + 1]], int(shared[i] - need[i] + 1)
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def divide_skip(terms: list[np.ndarray], sizes: np.ndarray, percent: int, sides: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its partners before it) of sets whose similarity is at least ``percent``.  ``sides``:
    documents of side 2 are compared with all, of 0 and 1 with the other side only."""
    ends = np.cumsum([0, *map(len, terms)])
    flat, owner = np.concatenate([np.empty(0, np.int64), *terms]), np.repeat(np.arange(len(terms)), np.diff(ends))
    order = np.argsort(flat, kind="stable")  # list after list, each in order of document
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))[:len(flat)])
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(flat))))
    lists = number * len(terms) + owner  # sorted: a document in a list is found by binary search
    place = np.empty(len(flat), np.int64)
    place[order] = np.arange(len(flat))
    for i in range(len(terms)):
        need = -(-percent * int(sizes[i]) // 100)
        z = place[ends[i]:ends[i + 1]]  # a list's part before this document
        a = first[number[z]]
        some = z > a
        a, z = a[some], z[some]
        if len(a) < need:
            continue
        by_length = np.argsort(z - a, kind="stable")
        a, z = a[by_length], z[by_length]
        n_long = min(int(need / (LONG_LIST * math.log2(max(2, int(z[-1] - a[-1]))) + 1)), need - 1)
        n_short = len(a) - n_long
        size = (z - a)[:n_short]
        merged = np.sort(owner[np.repeat(a[:n_short] - np.cumsum(size) + size, size) + np.arange(size.sum())], kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        count = np.diff(np.append(starts, len(merged)))
        found, count = merged[starts][count >= need - n_long], count[count >= need - n_long]
        other = (sizes[found] * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes[found]) & ((sides[found] == 2) | (sides[found] != sides[i]))
        found, count = found[other], count[other]
        if len(found):
            step = max(1, PROBES // len(found))
            for at in range(n_short, len(a), step):
                probe = number[a[at:at + step], None] * len(terms) + found
                where = np.minimum(np.searchsorted(lists, probe), len(lists) - 1)
                count = count + (lists[where] == probe).sum(axis=0)
        found = found[100 * count >= percent * (sizes[found] + sizes[i] - count)]
        if len(found):
            yield i, found


def _search(percent: int, schema: pa.Schema):
    """Members of tasks (cluster cells), sorted by task, to links: (rep, other) of a spanning forest
    and (rep, null, n_links), the rows linked with a member in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, "task"):
            reps = [r["rep"] for r in held]
            terms = [np.sort(np.array(r["terms"], dtype=np.int64)) for r in held]
            sizes, copies = np.array([r["n"] for r in held]), np.array([r["copies"] for r in held])
            sides = np.array([r["side"] for r in held])
            links, parent = np.zeros(len(held), np.int64), list(range(len(held)))

            def top(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            rows = []
            del held
            for i, found in divide_skip(terms, sizes, percent, sides):
                links[i] += copies[found].sum()
                links[found] += copies[i]
                for j in found.tolist():
                    x, y = top(i), top(j)
                    if x != y:
                        parent[x] = y
                        rows.append({"rep": reps[i], "other": reps[j]})
            rows += [{"rep": reps[i], "links": int(links[i])} for i in np.flatnonzero(links)]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[at:at + 4096], schema)

    return run


def _tasks(members: DataFrame, percent: int, cell: int) -> DataFrame:
    """Deal members (root, rep, n, copies, terms) into tasks: a small cluster is one; a large one is cut
    into cells, and each pair of cells that can hold partners is one."""
    weight = members.groupBy("root").agg(F.sum(F.size("terms")).alias("weight"))
    members = members.join(cut(weight, "jaccard-weights", rows=0), "root")
    small = members.where(F.col("weight") <= cell).select(F.concat(F.lit("c"), F.col("root").cast("string")).alias("task"), "rep", "n", "copies", F.lit(2).alias("side"), "terms")
    large = members.where(F.col("weight") > cell).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    parts = large.groupBy("root", "class").agg(F.ceil(F.sum(F.size("terms")) / F.lit(cell)).cast("int").alias("parts"))
    parts = cut(parts, "jaccard-parts", rows=0)
    near = F.array(*[F.struct((F.col("class") + d).alias("class")) for d in (-1, 0, 1)])
    pairs = (parts.select("root", "class", "parts", F.explode(near).alias("o")).select("root", "class", "parts", F.col("o.class").alias("other"))
             .join(parts.select("root", F.col("class").alias("other"), F.col("parts").alias("other_parts")), ["root", "other"]))
    dealt = (large.join(pairs, ["root", "class"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
             .withColumn("other_sub", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1))))
    mine, other = F.struct("class", "sub"), F.struct(F.col("other").alias("class"), F.col("other_sub").alias("sub"))
    name = lambda s: F.concat_ws(".", s["class"].cast("string"), s["sub"].cast("string"))
    dealt = dealt.withColumn("mine", mine).withColumn("theirs", other)
    task = F.concat_ws("|", F.col("root").cast("string"), name(F.least("mine", "theirs")), name(F.greatest("mine", "theirs")))
    side = F.when(F.col("mine") == F.col("theirs"), 2).when(F.col("mine") < F.col("theirs"), 0).otherwise(1)
    return small.unionByName(dealt.select(task.alias("task"), "rep", "n", "copies", side.alias("side"), "terms"))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.  Documents link when
    100 * intersection >= percent * union of their sets of ``width``-word shingles."""
    texts = gathered(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (n_bytes // (6 * BUCKET)).bit_length()  # 2^bits buckets; about 6 bytes a word
    id_type = docs.schema["doc_id"].dataType
    flushes = _flush_schema(id_type)
    sent = texts.mapInArrow(_postings(width, bits, _arrow(flushes)), flushes)
    back = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_shared(bits, _arrow(flushes)), flushes)
    schema = T.StructType([T.StructField("doc_id", id_type), *DOC_FIELDS])
    rows = cut(back.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_documents(percent, _arrow(schema)), schema), "jaccard-rows")

    able = rows.where("key IS NOT NULL")
    sets = able.groupBy("key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                                   F.first("terms", ignorenulls=True).alias("terms"), F.first("short", ignorenulls=True).alias("short"))
    sets = cut(sets, "jaccard-sets")
    n_sets = sets.count()
    short = cut(sets.select("rep", F.explode(F.slice("terms", 1, F.col("short"))).alias("term")), "jaccard-short")
    lists = short.groupBy("term").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    meet = short.join(lists, "term").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    clusters = components(meet, n_sets)
    clusters = cut(clusters.union(clusters.select("root", "root")).distinct(), "jaccard-clusters", rows=n_sets)
    members = cut(sets.join(clusters, sets["rep"] == clusters["node"]).select("root", "rep", "n", "copies", "terms"), "jaccard-members")
    out = T.StructType([T.StructField("rep", T.LongType()), T.StructField("other", T.LongType()), T.StructField("links", T.LongType())])
    found = _tasks(members, percent, cell).repartition("task").sortWithinPartitions("task").mapInArrow(_search(percent, _arrow(out)), out)
    found = cut(found, "jaccard-links")
    linked = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), n_sets)
    known = (sets.select("key", "rep", "least", "copies").join(roots, F.col("rep") == F.col("node"), "left").join(linked, "rep", "left")
             .select("key", F.coalesce("root", "rep").alias("root"), "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    known = cut(known, "jaccard-known", rows=n_sets)
    firsts = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(known.join(firsts, "root").select("key", "component_id", "n_links"), "jaccard-named", rows=n_sets)
    alone = rows.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("key IS NOT NULL").join(known, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(alone)
