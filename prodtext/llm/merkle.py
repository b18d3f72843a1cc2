"""Merkle dataset manifest with nested-interval labels.

Every value of ``tree`` has a binary tree over its rows' hashes, in order, and the roots of these
trees are the leaves of one more tree.  A node is labelled by its level and by the interval
[lo, hi) of leaf ranks that it covers.  The children of a node divide its interval, so a node's
sibling is what is left of the parent's interval without its own.

Ranks come from one sort: places inside the partitions of a range exchange, plus the rows ahead.
Levels are made and stored in bands of ``band`` levels: a bucket of a band holds at most 2^band
neighbouring nodes and all nodes above them in the band, and its root is a node of the
next band.  Ancestors are attached from the top band down, by joins of a bucket with the
node of the band above whose interval contains it, so an upper path is carried by buckets and
only the last join hands it to rows.  Nothing is gathered beyond the 2^band nodes of a bucket.

Defined results: null values are hashed as ``-``; rows of a null tree form a tree of their own,
first of all; rows are ordered by ``order`` (null first), rows of equal order by their hash, so
repeated rows are leaves beside each other; an empty table gives an empty result; other columns
are ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodtext.llm.common import cut, gathered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    """Lower-case hex sha256 of the values, each with its length before it."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` in (tree, order) from 0 in each tree, and ``leaves``, the tree's rows."""
    placed = cut(rows.orderBy("tree", *order).withColumn("place", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("chunk", F.shiftright("place", 33))
    whole = Window.partitionBy("tree")
    chunks = placed.groupBy("tree", "chunk").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    chunks = (chunks.withColumn("ahead", F.coalesce(F.sum("n").over(whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("leaves", F.sum("n").over(whole)).drop("n"))
    return (placed.join(cut(chunks, "merkle-chunks", rows=0), ["tree", "chunk"])
            .withColumn("rank", F.col("place") - F.col("first") + F.col("ahead")).drop("place", "chunk", "first", "ahead"))


def _parents(nodes: Column) -> Column:
    two = lambda i: F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) + 1) / 2).cast("int") - 1), lambda i: F.sha2(two(i), 256))


def _band(ranked: DataFrame, number: int, band: int) -> DataFrame:
    """Buckets of a band: tree, leaves, bucket, members (rank, digest, item) and levels, the
    digests of each level of the band from its members up."""
    depth = F.when(F.col("leaves") <= 1, 0).otherwise(F.length(F.bin(F.col("leaves") - 1)))
    buckets = (ranked.groupBy("tree", "leaves", F.shiftright("rank", band).alias("bucket"))
               .agg(F.array_sort(F.collect_list(F.struct("rank", "digest", "item"))).alias("members"))
               .withColumn("steps", F.least(F.lit(band), depth - band * number)))
    first = F.array(F.transform("members", lambda m: m["digest"]))
    up = F.aggregate(F.sequence(F.lit(1), F.col("steps")), first, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    return buckets.withColumn("levels", F.when(F.col("steps") > 0, up).otherwise(first))


def _root_of() -> Column:
    return F.element_at("levels", -1)[0]


def build(ranked: DataFrame, band: int = 8) -> list[DataFrame]:
    """The bands of all trees, lowest first, as written tables.  ``ranked`` has tree, rank, leaves,
    digest and item, whatever is to be carried with a leaf."""
    bands = [cut(_band(ranked, 0, band), "merkle-band")]
    most = bands[0].agg(F.max("leaves")).first()[0] or 1
    for number in range(1, math.ceil(max(most - 1, 1).bit_length() / band)):
        below = bands[-1].select("tree", "leaves", F.col("bucket").alias("rank"), _root_of().alias("digest"), F.lit(None).cast("int").alias("item"))
        bands.append(cut(_band(below.where(F.col("leaves") > (1 << band * number)), number, band), "merkle-band"))
    return bands


def nodes(bands: list[DataFrame], band: int = 8) -> DataFrame:
    """All nodes with their labels: tree, level, lo, hi, digest."""
    out = None
    for number, buckets in enumerate(bands):
        rows = (buckets.select("tree", "leaves", "bucket", F.posexplode("levels").alias("l", "digests"))
                .select("tree", "leaves", "bucket", "l", F.posexplode("digests").alias("i", "digest")))
        level = F.col("l") + band * number
        lo = F.expr(f"shiftleft(shiftleft(bucket, {band} - l) + i, l + {band * number})")
        hi = F.least(lo + F.expr(f"shiftleft(1L, l + {band * number})"), F.col("leaves"))
        rows = rows.select("tree", level.alias("level"), lo.alias("lo"), hi.alias("hi"), "digest")
        if number:  # the members of an upper band are the roots of the one below
            rows = rows.where(F.col("level") > band * number)
        out = rows if out is None else out.unionByName(rows)
    return out


def _own_path(number: int, band: int) -> Column:
    """Of member ``m`` of a bucket: for each level of the band its sibling, the part of the parent's
    interval that is not its own: struct(left, digest), digest null where nothing is left."""
    return F.expr(f"""
      if(steps > 0, transform(transform(sequence(0, steps - 1), l -> named_struct('l', l, 'up', l + {band * number},
            'lo', shiftleft(shiftright(m.rank, l), l + {band * number}), 'parent', shiftleft(shiftright(m.rank, l + 1), l + 1 + {band * number}))),
        s -> named_struct('left', s.lo > s.parent, 'digest', CASE
          WHEN s.lo > s.parent THEN get(levels[s.l], int(shiftright(s.parent, s.up) - shiftleft(bucket, {band} - s.l)))
          WHEN least(s.lo + shiftleft(1L, s.up), leaves) < least(s.parent + shiftleft(1L, s.up + 1), leaves)
          THEN get(levels[s.l], int(shiftright(s.lo, s.up) + 1 - shiftleft(bucket, {band} - s.l))) END)),
        array())""").cast("array<struct<left:boolean,digest:string>>")


def paths(bands: list[DataFrame], above: DataFrame, band: int = 8) -> DataFrame:
    """(tree, rank, item, digest, path, upper): the siblings of each leaf level by level, then those
    of its tree.  ``above`` has one row for each tree: tree, path, and upper, carried as it is."""
    inside = above.select("tree", F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), "path", "upper")
    for number in reversed(range(len(bands))):
        width = band * (number + 1)
        buckets = bands[number].withColumn("at", F.shiftleft("bucket", width))
        top = F.col("leaves") <= F.lit(1 << width)  # the only bucket of its tree in this band: its path is the tree's
        found = buckets.where(top).join(above.select("tree", "path", "upper"), "tree")
        if number < len(bands) - 1:
            held = inside.select("tree", F.col("lo").alias("at"), "hi", "path", "upper")
            low = buckets.where(~top).join(held, ["tree", "at"])  # containment: the node of the band above that starts here
            found = found.unionByName(low.where(F.least(F.col("at") + F.lit(1 << width), F.col("leaves")) <= F.col("hi")).drop("hi"))
        rows = found.select("tree", "leaves", "upper", "path", "bucket", "steps", "levels", F.explode("members").alias("m"))
        path = F.concat(_own_path(number, band), F.col("path"))
        if not number:
            return rows.select("tree", "m.rank", "m.item", "m.digest", path.alias("path"), "upper")
        lo = F.shiftleft("m.rank", band * number)
        inside = cut(rows.select("tree", lo.alias("lo"), F.least(lo + F.lit(1 << band * number), F.col("leaves")).alias("hi"), path.alias("path"), "upper"), "merkle-inside")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    def up(done, s):
        one = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(one, done)).otherwise(F.concat(done, one)), 256)
    return F.aggregate(path, start, up)


def siblings_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)  # nulls are left out


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id",
                    presented: dict[str, Column] | None = None, band: int = 8) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(checked, bands, top): one row per document with leaf, subroot, root, path (its siblings,
    level by level up to the root), proof_sha256, folded_root and verified; and the bands of the
    trees and of the tree of their roots, whose labelled nodes ``nodes`` lists.

    ``presented`` gives values that a verifier is shown in place of the table's; ``folded_root`` is
    made from them and from the stored siblings."""
    presented = presented or {}
    shown = [presented.get(f, F.col(f)) for f in fields]
    same = F.lit(True)
    for f, v in presented.items():
        same = same & v.eqNullSafe(F.col(f))
    key = F.when(F.col(tree).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))  # null sorts first
    rows = gathered(docs).select(key.alias("tree"), F.col(order).alias("id"), leaf_hash([F.col(f) for f in fields]).alias("digest"),
                                 F.when(~same, leaf_hash(shown)).alias("shown"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows, "merkle-leaves")
    ranked = _ranked(rows, [F.col("id").asc_nulls_first(), "digest", "row"])
    bands = build(ranked.select("tree", "rank", "leaves", "digest", F.struct("id", "shown").alias("item")), band)
    subroots = None
    for number, buckets in enumerate(bands):
        one = buckets.where((F.col("leaves") <= F.lit(1 << band * (number + 1))) & (F.col("leaves") > F.lit(1 << band * number if number else 0)))
        one = one.select("tree", _root_of().alias("digest"))
        subroots = one if subroots is None else subroots.unionByName(one)
    heads = _ranked(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
    top = build(heads.select("tree", "rank", "leaves", "digest", F.col("of").alias("item")), band)
    root = top[-1].select("tree", F.array().cast("array<struct<left:boolean,digest:string>>").alias("path"), _root_of().alias("upper"))
    above = cut(paths(top, root, band).select(F.col("item").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("upper").alias("root")).alias("upper")), "merkle-above")
    found = paths(bands, above, band)
    checked = (found.select(F.col("item.id").alias(order), F.col("digest").alias("leaf"), "upper.subroot", "upper.root", "path",
                            siblings_hash(F.col("path")).alias("proof_sha256"), fold(F.coalesce("item.shown", "digest"), F.col("path")).alias("folded_root"))
               .withColumn("verified", F.col("folded_root") == F.col("root")))
    return checked, bands, top
