"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints within 3 bits differ in at most one bit in one of their 32-bit
halves (in general: in distance // 2 bits).  Each half is covered by anchors: 31 bits by the
perfect Hamming code, whose covering radius is 1, and the last bit by itself.  A fingerprint
is at home at the nearest anchor, and is replicated to every anchor within covering radius
plus threshold: those within 2 bits (1 + 15), and the home anchor with the last bit turned.
So any two fingerprints that differ in one bit of a half meet at the home anchor of
either, and only members of an anchor are compared, on all 64 bits.  There are 2^27 anchors
for each half, so an anchor's members stay few at any size.

Equal fingerprints are one row from the start, so a large group of copies costs nothing.
Members of an anchor that link are handed on as a star, not as pairs.  Stars are joined into
components by large-star and small-star steps until nothing changes.

Defined results: null and empty texts have fingerprint zero and link like any other;
component_id is the smallest non-null doc_id of the component (null if it has none);
repeated rows are rows of one group; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodtext.llm.common import cut, files_for, gathered

SLICE = 4 << 20  # bytes of a text that are split into words at once


def _word_slices(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some MB at a time.  bytes.split() cuts at \\x20 and \\x09-\\x0D."""
    if len(data) <= SLICE:
        yield data.split()
        return
    rest = b""
    for at in range(0, len(data), SLICE):
        part = rest + data[at:at + SLICE]
        words = part.split()
        rest = b""
        if words and at + SLICE < len(data) and not part[-1:].isspace():
            rest = words.pop()
        yield words


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of all word shingles, as unsigned 64 bits."""
    counts, total, carry = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(hashes: np.ndarray) -> None:
        nonlocal total
        total += len(hashes)
        counts[:] += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for words in _word_slices(text.lower()):  # of bytes: A-Z only
        words = carry + words
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(words) - shingle + 1
            add(np.fromiter((digest(line[a:z], seed) for a, z in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), np.uint64, n))
            carry = words[n:]
        else:
            carry = words
    if not total and carry:
        add(np.array([digest(b" ".join(carry), seed)], dtype=np.uint64))
    bits = (counts * 2 > total).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed long, ``fp``."""

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    udf = F.arrow_udf(_typed(prints), "long")
    return docs.select(*keep, udf(F.col("text").cast("binary")).alias("fp"))


def _typed(f):
    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return f


def _parity(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(mask))) % 2


def halves(fp: Column) -> Column:
    """array<struct<x, top, s, half>>: 31 bits, the last bit and the syndrome of each half."""
    lists = []
    for half in (0, 1):
        x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0x7FFFFFFF))
        top = F.shiftrightunsigned(fp, 32 * half + 31).bitwiseAND(F.lit(1))
        syndrome = sum((_parity(x, sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) * (1 << j) for j in range(5)), F.lit(0)).cast("int")
        lists.append(F.struct(x.alias("x"), top.alias("top"), syndrome.alias("s"), F.lit(half).alias("half")))
    return F.array(*lists)


def _anchor_rows(nodes: DataFrame) -> DataFrame:
    """(anchor, home, fp): every anchor that a fingerprint is replicated to."""
    one = "shiftleft(1L, {} - 1)"
    home = f"if(h.s = 0, h.x, h.x ^ {one.format('h.s')})"
    key = "(({0}) * 4L + {1} * 2L + h.half)"
    near = (f"transform(filter(sequence(1, 31), i -> h.s > 0 AND i < (i ^ h.s)), "
            f"i -> struct({key.format('h.x ^ ' + one.format('i') + ' ^ ' + one.format('(i ^ h.s)'), 'h.top')} AS anchor, false AS home))")
    own = f"array(struct({key.format(home, 'h.top')} AS anchor, true AS home), struct({key.format(home, '(1L - h.top)')} AS anchor, false AS home))"
    return (nodes.select("fp", F.explode(halves(F.col("fp"))).alias("h"))
            .select("fp", F.explode(F.expr(f"concat({own}, {near})")).alias("a")).select("a.anchor", "a.home", "fp"))


def _stars(max_distance: int):
    """mapInArrow function over members sorted by anchor: (a, b) with b the smallest
    fingerprint of a's linked members at this anchor."""

    def small(fp, home, group, size):
        """Groups of up to 64 members: every member against those that follow it, all groups
        at once, then the smallest index of each linked set."""
        label = np.arange(len(fp))
        left, right = [], []
        last = np.repeat(np.concatenate((np.flatnonzero(np.diff(group)), [len(fp) - 1])), size[np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))])
        i = np.arange(len(fp))
        for step in range(1, int(size.max(initial=1))):
            i = i[i + step <= last[i]]
            if not len(i):
                break
            j = i + step
            hit = (home[i] | home[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_distance)
            left.append(i[hit])
            right.append(j[hit])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        while len(a):
            before = label.copy()
            np.minimum.at(label, b, label[a])
            np.minimum.at(label, a, label[b])
            label = label[label]
            if (label == before).all():
                break
        moved = label != np.arange(len(fp))
        return fp[moved], fp[label[moved]]

    def large(fp):
        """One large group: each member reached is compared with those not yet reached."""
        out_a, out_b, rest = [], [], fp
        while len(rest):
            seed, rest, front = rest[0], rest[1:], [rest[0]]
            while front and len(rest):
                near = np.bitwise_count(rest ^ front.pop()) <= max_distance
                if near.any():
                    got, rest = rest[near], rest[~near]
                    front.extend(got)
                    out_a.append(got)
                    out_b.append(np.full(len(got), seed))
        empty = np.empty(0, fp.dtype)
        return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])

    def links(anchor, home, fp):
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate((at, [len(fp)])))
        useful = (size > 1) & np.logical_or.reduceat(home, at)
        of = np.cumsum(new) - 1
        few = (useful & (size <= 64))[of]
        if few.any():
            yield small(fp[few], home[few], of[few], size[of][few])
        for g in np.flatnonzero(useful & (size > 64)):
            yield large(fp[at[g]:at[g] + size[g]])

    def batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [b.column("anchor").to_numpy(), b.column("home").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            ready = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last anchor may go on
            if ready:
                for a, z in links(*(x[:ready] for x in held)):
                    yield batch(a, z)
                held = [x[ready:] for x in held]
        if held is not None and len(held[0]):
            for a, z in links(*held):
                yield batch(a, z)

    return run


def components(edges: DataFrame, nodes: int, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of (a, b) by large-star and small-star steps; the
    root is the smallest node.  ``nodes``, about how many there are, sets the number of files.  Neighbour lists are never gathered: each step is a minimum per
    node, joined back to its edges."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().repartition(files_for(nodes)), "cc-edges")
    n_edges, state = edges.count(), None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        larger = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))  # large star
        larger = larger.where("a <> b").distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        small = larger.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").distinct(), "cc-edges", rows=n_edges)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3, seed: int = 42, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id and kept (true for one row of
    each component: of the smallest doc_id).  ``row`` names a column of unique row ids, which
    is returned too; without it, rows are told apart by an id given while reading."""
    if max_distance > 3:
        raise ValueError("anchors of radius 1 on halves serve distances up to 3")
    rows = gathered(docs.withColumn("row", F.col(row) if row else F.monotonically_increasing_id()).select("row", "doc_id", "text"))
    prints = cut(with_fingerprints(rows, ["row", "doc_id"], shingle, seed), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    n_rows = prints.count()
    nodes = cut(nodes, "simhash-nodes", rows=n_rows)
    members = _anchor_rows(nodes).repartition("anchor").sortWithinPartitions("anchor", "fp")
    roots = components(members.mapInArrow(_stars(max_distance), "a long, b long"), n_rows)
    grouped = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots", rows=n_rows)
    firsts = grouped.groupBy("root").agg(F.min("first").alias("of_all"))
    named = cut(grouped.join(firsts, "root").select("fp", F.col("of_all.doc_id").alias("component_id"), F.col("of_all.row").alias("keep_row")), "simhash-named", rows=n_rows)
    return prints.join(named, "fp").select("row", "doc_id", "fp", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))
