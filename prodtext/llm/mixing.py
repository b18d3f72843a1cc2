"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source is cut into shards of about ``shard_tokens`` words.  A shard's documents, in
seeded order, lie end to end on a ring, and the ring is read in blocks of ``block_tokens``
words from a seeded block on.  The blocks of the whole mix are apportioned to sources, and
each source's blocks to its shards, by the highest quotients w/1, w/3, w/5 ...  A shard
then takes the words under its quota of blocks; a ring may be read twice at most, so the last block
of a run can be a part of one.  A source whose target is at most a block takes one block; the
others share the blocks of their targets, none more than its own target rounded up.

Only DataFrame operations are used.  Blocks are never rows: a document's share of its
shard's run follows from its place on the ring.

Defined results: null text has size 0; null source is a source of its own, after all
others; rows of size 0 take 0; repeated rows are separate rows; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodtext.llm.common import cut, gathered, md5_long, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2),
                   max_epochs: int = 2) -> DataFrame:
    """(source, size) rows to one row per source: src (rank by code point, null last),
    source_size, weight, target.  Targets share ``share`` of all words by weight; none exceeds
    ``max_epochs`` times its source, and what is cut off is shared again by weight.

    Filling stops at the level L with sum(min(weight * L, cap)) = total, so the sources that
    stop are those with the smallest cap per weight: two running sums find them.
    """
    num, den = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    src = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("src", F.row_number().over(by_name))
           .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                              ((F.col("src") - 1) % len(weights) + 1).cast("int")).cast("long"))
           .withColumn("cap", F.col("source_size") * max_epochs)
           .withColumn("all_size", F.sum("source_size").over(everything)))
    src = (src.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
           # weight * L, with L the level if this source and all later ones were uncapped
           .withColumn("level_num", F.col("all_size") * num - F.col("spent") * den)
           .withColumn("open", F.col("weight") * F.col("level_num") <= F.col("cap") * den * F.col("weight_left")))
    # all sources behind the first open one are open too, at its level
    first = F.min_by(F.struct("level_num", "weight_left"), F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("src"))))
    src = src.withColumn("first", first.over(everything))
    target = F.when(F.col("first").isNotNull() & (F.col("cap") * den * F.col("first.weight_left") > F.col("weight") * F.col("first.level_num")),
                    (F.col("weight") * F.col("first.level_num")).cast("double") / (F.col("first.weight_left") * den).cast("double"))
    return src.select("source", "src", "source_size", "weight", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], weight: str, seats: str, cap: str) -> DataFrame:
    """Add ``quota``: ``seats`` (the same in all rows of a group) go one by one to the party
    with the highest quotient weight/(2k-1), never past ``cap``; ties go to the lower party.

    Rounding weight/d gives at most the seats for d = total/(seats - p/2) and at least the
    seats for d = total/(seats + p/2), p parties.  So only the quotients between these two
    are ranked, about 2p of them, however many seats there are.
    """
    whole = Window.partitionBy(*group)
    w, n = F.col(weight).cast("double"), F.col("_n")
    rounded = lambda d: F.greatest(F.lit(0), F.floor(w / F.col("_total") * d + 0.5))
    p = (parties.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_total", F.sum(F.col(weight).cast("double")).over(whole))
         .withColumn("_lo", F.when(F.col("_total") > 0, F.least(F.col(cap), rounded(F.col(seats) - n / 2))).otherwise(0).cast("long"))
         .withColumn("_hi", F.when(F.col("_total") > 0, F.least(F.col(cap), rounded(F.col(seats) + n / 2) + 1)).otherwise(0).cast("long"))
         .withColumn("_left", F.col(seats) - F.sum("_lo").over(whole)))
    ranked = (p.where("_hi > _lo").withColumn("_k", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
              .withColumn("_rank", F.row_number().over(whole.orderBy((w / (2 * F.col("_k") - 1)).desc(), *party, "_k"))))
    won = ranked.where("_rank <= _left").groupBy(*group, *party).agg(F.count(F.lit(1)).alias("_won"))
    return (p.join(won, [*group, *party], "left")
            .withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0)))
            .drop("_n", "_total", "_lo", "_hi", "_left", "_won"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_epochs: int = 2,
                block_tokens: int = 16, shard_tokens: int = 32768, max_shards: int = 65536, seed: int = 7,
                carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shard and
    pieces, the word ranges (start, length) that the mix takes, in ring order; a whole second
    reading is a second range.  ``carry`` names further input columns to keep."""
    # renamed inside, as the columns that the mix adds could clash with those carried along
    kept = [F.col(c).alias(f"in_{c}") for c in carry]
    sizes = cut(gathered(docs).select(*kept, "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, share, max_epochs)
    blocks = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = F.col("target") > block_tokens
    sources = (targets.withColumn("one", F.lit(1)).withColumn("shared", F.when(wide, F.col("target")).otherwise(0.0))
               .withColumn("seats", F.round(F.sum("shared").over(blocks) / block_tokens).cast("long"))
               .withColumn("cap_blocks", F.ceil(F.col("shared") / block_tokens).cast("long")))
    sources = cut(sainte_lague(sources, ["one"], ["src"], "shared", "seats", "cap_blocks")
                  .select("source", "src", "source_size", "target", F.when(wide, F.col("quota")).otherwise((F.col("target") > 0).cast("long")).alias("source_blocks"),
                          F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens))).cast("long").alias("n_shards")),
                  "mix-sources", rows=0)  # one row per source
    placed = (sizes.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("of")
              .withColumn("shard", md5_long(F.lit(seed), F.lit("shard"), F.col("doc_id")) % F.col("n_shards")))
    cells = (placed.groupBy("src", "shard").agg(F.sum("size").alias("ring"), F.first("source_blocks").alias("source_blocks"))
             .withColumn("cap_blocks", F.ceil(F.col("ring") * max_epochs / block_tokens).cast("long")))
    cells = (sainte_lague(cells, ["src"], ["shard"], "ring", "source_blocks", "cap_blocks")
             .select("src", "shard", "ring", F.col("quota").alias("blocks"),
                     (md5_long(F.lit(seed), F.lit("start"), F.col("src"), F.col("shard"))
                      % F.greatest(F.lit(1), F.ceil(F.col("ring") / block_tokens)) * block_tokens).cast("long").alias("start")))
    cells = cut(cells, "mix-cells", rows=sizes.count())
    order = Window.partitionBy("src", "shard").orderBy(md5_long(F.lit(seed), F.lit("place"), F.col("doc_id")), F.col("doc_id").asc_nulls_first(), "size")
    lying = (placed.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
             .join(cells, ["src", "shard"]).withColumn("stop", F.col("start") + F.least(F.col("blocks") * block_tokens, F.col("ring") * max_epochs)))

    def piece(turn: int) -> Column:
        here = F.col("at") + F.col("ring") * turn
        begin = F.greatest(F.col("start"), here)
        return F.struct((begin - here).cast("long").alias("start"), (F.least(F.col("stop"), here + F.col("size")) - begin).cast("long").alias("length"))

    pieces = F.filter(F.array(*[piece(t) for t in range(max_epochs + 1)]), lambda x: x["length"] > 0)
    return (lying.withColumn("pieces", pieces)
            .withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["length"]))
            .select(*[F.col(f"in_{c}") for c in carry], "doc_id", "source", "size", "source_size", "target", "taken", "shard", "pieces"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each taken range becomes a row.  A range
    that covers the whole document keeps its text as it is; a shorter one keeps the words of
    the range and the white space between them, and ``n_chars``, if there, follows.  Rows
    without words are not taken: there is nothing in them to weigh.  Rows are told apart by an
    id that is written once with them, so ``docs`` need not be read the same way each time."""
    columns = docs.columns
    numbered = cut(gathered(docs).select(*[F.col(c).alias(f"in_{c}") for c in columns], F.monotonically_increasing_id().alias("mix_row")), "mix-rows")
    small = numbered.select("mix_row", F.col("in_doc_id").alias("doc_id"), F.col("in_source").alias("source"), F.col("in_text").alias("text"))
    mix = cut(mix_sources(small, carry=["mix_row"], **options).where("taken > 0").select(F.col("in_mix_row").alias("mix_row"), "size", "pieces"), "mix-pieces", rows=numbered.count())
    words = F.regexp_extract_all(F.col("in_text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("p.start") + 1).cast("int"), F.col("p.length").cast("int")), "")
    rows = (numbered.join(mix, "mix_row").withColumn("p", F.explode("pieces"))
            .withColumn("new_text", F.when(F.col("p.length") == F.col("size"), F.col("in_text")).otherwise(part)))
    out = {c: F.col(f"in_{c}") for c in columns}
    out["text"] = F.col("new_text")
    if "n_chars" in columns:
        out["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) for c in columns])
