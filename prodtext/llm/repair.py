"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation is to read ``(s?(ua)+)?`` in its roles' initials.  Each row is kept (0), given
another role (3) or deleted (4, the only way for blank and duplicate rows); a truncated row that
stays costs 3 more; user and assistant rows without text can be inserted anywhere (3).  The
cheapest edits win, and of these the ones whose initials come first in ASCII order.

The lattice has four states: nothing yet, after s, after u, after a.  Each state's survivor is a leaf of
a tree of back pointers whose nodes count their references; a node that no survivor needs is freed,
and once all survivors share an ancestor the edits up to it are final and leave the tree.  Equal
costs are settled by comparing the two unresolved paths from their common ancestor on.  (Both
cover the same rows and end in a row's edit, so neither is the beginning of the other, and
what follows cannot turn their order.)  A survivor that costs more than another one plus the
most that changing over can cost can never win and is given up; without that the path that
deletes every row would keep the tree from ever being resolved.

Rows are sorted by range, so a long conversation lies in several partitions, its segments.  A
segment is searched from each state it may be entered in; its costs and the order of its paths,
4 by 4, are all that the choice among the segments of a conversation needs.  With its
first and last state known, each segment is then resolved by itself.  So no task holds a conversation.

Defined results: rows are taken by turn (null first), then role, text and place in the input;
null role or text counts as one space; a row of empty role cannot be kept as it is; a null conv_id is one conversation; the first fault of blank,
duplicate, truncated counts; a conversation of which no row is present has zeros, no edits and
the hash of the empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prodtext.llm.common import cut, gathered

NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: states that inserted rows lead through, from each state; back to the start of a circle never pays
INSERTS = {NONE: [(), (USER,), (USER, ASSISTANT)], SYSTEM: [(), (USER,), (USER, ASSISTANT)], USER: [(), (ASSISTANT,)], ASSISTANT: [(), (USER,)]}
ENDING = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
#: CHANGE[q][p]: what the rest of a path costs at most more from q than from p
CHANGE = {NONE: {SYSTEM: 0, USER: 3, ASSISTANT: 0}, SYSTEM: {NONE: 6, USER: 3, ASSISTANT: 6},
          USER: {NONE: 7, SYSTEM: 3, ASSISTANT: 3}, ASSISTANT: {NONE: 4, SYSTEM: 0, USER: 3}}
FAULTS = ("", "blank", "duplicate", "truncated")


@functools.cache
def moves(state: int, initial: str, fault: int) -> list[tuple]:
    """(state after, letters, inserted states, cost) of all edits of a row, with rows inserted before it."""
    out = []
    for inserted in INSERTS[state]:
        at, cost, letters = inserted[-1] if inserted else state, INSERT * len(inserted), "I" * len(inserted)
        out.append((at, letters + "D", inserted, cost + DELETE))
        if fault in (1, 2):
            continue
        cost += CUT_SHORT if fault == 3 else 0
        if (at, initial) in NEXT:
            out.append((NEXT[at, initial], letters + "K", inserted, cost))
        out += [(to, letters + "R", inserted, cost + REROLE) for (was, role), to in NEXT.items() if was == at and role in "ua" and role != initial]
    return out


class Node:
    """An edit in the tree of back pointers.  ``children`` are its references, besides a survivor's."""
    __slots__ = ("parent", "children", "state", "letters", "inserted", "row")

    def __init__(self, parent, state, letters="", inserted=(), row=None):
        self.parent, self.children, self.state, self.letters, self.inserted, self.row = parent, 0, state, letters, inserted, row


class Survivors:
    def __init__(self, state: int):
        self.root = Node(None, state)
        self.at: dict[int, tuple[int, Node]] = {state: (0, self.root)}

    @staticmethod
    def before(a: Node, letters_a: str, b: Node, letters_b: str) -> bool:
        """Does path a, then letters_a, come before path b, then letters_b?  Both are of one length in rows."""
        while a is not b:
            letters_a, letters_b, a, b = a.letters, b.letters, a.parent, b.parent
        return letters_a < letters_b

    def step(self, initial: str, fault: int, row=None) -> None:
        best: dict[int, tuple] = {}
        for state, (so_far, node) in self.at.items():
            for to, letters, inserted, cost in moves(state, initial, fault):
                cost += so_far
                old = best.get(to)
                if old is None or cost < old[0] or cost == old[0] and self.before(node, letters, old[1], old[2]):
                    best[to] = (cost, node, letters, inserted)
        alive = {p: x for p, x in best.items() if not any(y[0] + CHANGE[q][p] < x[0] for q, y in best.items() if q != p)}
        was, self.at = self.at, {}
        for state, (cost, node, letters, inserted) in alive.items():
            node.children += 1
            self.at[state] = (cost, Node(node, state, letters, inserted, row))
        for _, node in was.values():
            while not node.children and node is not self.root:  # no survivor needs it
                node = node.parent
                node.children -= 1

    def settled(self) -> list[Node]:
        """Edits that all survivors share; they leave the tree."""
        if self.root.children != 1:
            return []
        path, node = [], next(iter(self.at.values()))[1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = []
        for node in reversed(path):
            if self.root.children != 1:
                break
            out.append(node)
            node.parent, self.root = None, node
        return out

    def rest(self, state: int) -> list[Node]:
        path, node = [], self.at[state][1]
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def order(self) -> list[int]:
        """States by the order of their paths."""
        def compare(a: int, b: int) -> int:
            x, y = self.at[a][1], self.at[b][1]
            return 0 if x is y else -1 if self.before(x, "", y, "") else 1
        return sorted(self.at, key=functools.cmp_to_key(compare))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """Rows, each with whether the first ``keys`` columns differ from the row before."""
    last = object()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[:keys] != last, row
            last = row[:keys]


SUMMARY = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]


def _summaries(schema: pa.Schema):
    """Rows of (chunk, conv_id, turn, initial, fault, present), sorted, to one row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, seen = [], None, object()

        def close():
            for entry, paths in now["paths"].items():
                for rank, state in enumerate(paths.order()):
                    now["cost"][4 * entry + state], now["rank"][4 * entry + state] = paths.at[state][0], rank
            del now["paths"]
            done.append(now)

        for new, (chunk, conv, turn, initial, fault, present) in _runs(batches, 2):
            if new:
                if now:
                    close()
                # only the first conversation of a chunk can have begun in another one
                entries = range(4) if chunk != seen else (NONE,)
                seen = chunk
                now = {"chunk": chunk, "conv_id": conv, "cost": [-1] * 16, "rank": [-1] * 16, "paths": {e: Survivors(e) for e in entries},
                       "first": None, "last": None, "low": None, "high": None, **dict.fromkeys(SUMMARY, 0)}
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
            if not present:
                continue
            if now["first"] is None:
                now["first"] = initial
            elif now["last"] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["last"] = initial
            now["n"] += 1
            if fault:
                now[FAULTS[fault]] += 1
            if turn is not None:
                now["turns"] += turn != now["high"]
                now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            for paths in now["paths"].values():
                paths.step(initial, fault)
                paths.settled()
        if now:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def _choices(schema: pa.Schema):
    """Segments of a conversation, in order, to their first and last state and, with the last
    segment, the conversation's report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chunks, came, at, total = [], [], [], {}, {}

        def close():
            ends = {q: cost + INSERT * len(ENDING[q]) for q, (cost, _) in at.items()}
            state = min(ends, key=lambda q: (ends[q], at[q][1]))
            tail, cost, rows = "".join(ROLE[s][0] for s in ENDING[state]), ends[state], []
            for chunk, back in zip(reversed(chunks), reversed(came)):
                rows.append({"conv_id": total["conv_id"], "chunk": chunk, "entry": back[state], "leave": state, "tail": tail if not rows else ""})
                state = back[state]
            gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
            rows[0] |= {"gaps": gaps, "cost": cost} | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}
            out.extend(rows)

        for b in batches:
            for r in b.to_pylist():
                if not total or total["conv_id"] != r["conv_id"]:
                    if total:
                        close()
                    chunks, came, at = [], [], {NONE: (0, 0)}
                    total = {"conv_id": r["conv_id"], "last": None, "low": None, "high": None, **dict.fromkeys(SUMMARY, 0)}
                best = {}
                for q, (cost, rank) in at.items():
                    for to in range(4):
                        c, k = r["cost"][4 * q + to], r["rank"][4 * q + to]
                        if c >= 0 and (to not in best or (cost + c, rank, k) < best[to][:3]):
                            best[to] = (cost + c, rank, k, q)
                order = sorted(best, key=lambda to: best[to][1:3])
                at = {to: (best[to][0], order.index(to)) for to in best}
                chunks.append(r["chunk"])
                came.append({to: x[3] for to, x in best.items()})
                joined = total["last"] is not None and r["first"] is not None
                for k in SUMMARY:
                    total[k] += r[k]
                total["illegal"] += joined and total["last"] + r["first"] not in ("su", "ua", "au")
                total["last"] = r["last"] if r["last"] is not None else total["last"]
                if r["low"] is not None:
                    total["turns"] -= r["low"] == total["high"]
                    total["low"], total["high"] = r["low"] if total["low"] is None else total["low"], r["high"]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if total:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _edits(schema: pa.Schema):
    """Rows of a segment, the first one with its states, to edits: every row, and inserted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, seq, paths, key, ending = [], 0, 0, None, (None, None), None

        def emit(nodes: list[Node]):
            nonlocal seq, held
            for node in nodes:
                edit = node.letters[-1]
                rows = [("I", ROLE[s], "") for s in node.inserted]
                role, text = node.row
                rows.append((edit, role if edit != "R" else ROLE[node.state], text if edit != "D" else None))
                for edit, role, text in rows:
                    out.append({"chunk": key[0], "conv_id": key[1], "seq": seq, "edit": edit, "role": role, "text": text})
                    seq += 1
                    held += len(text or "") + 40

        def close():
            nonlocal seq
            leave, tail = ending
            emit(paths.rest(leave))
            for initial in tail:
                out.append({"chunk": key[0], "conv_id": key[1], "seq": seq, "edit": "I", "role": "user" if initial == "u" else "assistant", "text": ""})
                seq += 1

        for new, (chunk, conv, _, initial, fault, present, role, text, entry, leave, tail) in _runs(batches, 2):
            if new:
                if paths:
                    close()
                key, paths, ending, seq = (chunk, conv), Survivors(entry), (leave, tail), 0
                continue
            if present:
                paths.step(initial, fault, (role, text))
                emit(paths.settled())
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if paths:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _digests(schema: pa.Schema):
    """Edits of a conversation, in order, to its audit and the hash of its repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, audit, sha, rows = [], None, None, None, 0
        for new, (conv, edit, role, text) in _runs(batches, 1):
            if new:
                if sha:
                    out.append({"conv_id": key, "audit": audit.decode(), "repaired_sha256": sha.hexdigest()})
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                key, audit, sha, rows = conv, bytearray(), hashlib.sha256(), 0
            audit += edit.encode()
            if edit != "D":
                sha.update(("\n" if rows else "").encode() + f"{role}:{text}".encode())
                rows += 1
        if sha:
            out.append({"conv_id": key, "audit": audit.decode(), "repaired_sha256": sha.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _map(df: DataFrame, kernel, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    schema = T.StructType([T.StructField(*f) for f in fields])
    return df.mapInArrow(kernel(pa.schema([(n, to_arrow_type(t)) for n, t in fields])), schema)


def fault_of(text: Column, repeated: Column) -> Column:
    """Index in FAULTS of a row's first fault."""
    return (F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 1).when(repeated, 2)
            .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0))


def repair_conversations(turns: DataFrame, present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, edits) of rows (conv_id, turn, role, text).  The report has one row per conversation:
    gaps, blank, duplicate, truncated, illegal, cost.  Edits are in order of chunk and seq: the edit's
    initial and the row after it (role, text; no text where it is deleted); an inserted row has
    empty text.  ``present`` names a boolean column: rows where it is not true only name their conversation."""
    id_type, turn_type = turns.schema["conv_id"].dataType, turns.schema["turn"].dataType
    rows = gathered(turns).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                  (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
                                  F.monotonically_increasing_id().alias("row"))
    rows = cut(rows, "repair-rows")
    firsts = (rows.where("present").groupBy("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min(F.struct("turn", "row")).alias("first"))
              .select(F.col("first.row").alias("row"), F.lit(True).alias("is_first")))
    known = rows.join(firsts, "row", "left").withColumn("fault", fault_of(F.col("text"), F.col("is_first").isNull()))
    ordered = (known.orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row")
               .withColumn("place", F.monotonically_increasing_id())
               .select(F.shiftright("place", 33).alias("chunk"), "place", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "present", "role", "text"))
    ordered = cut(ordered, "repair-ordered")

    ints, long = T.ArrayType(T.LongType()), T.LongType()
    counts = [(k, long) for k in SUMMARY]
    short = ordered.select("place", "chunk", "conv_id", "turn", "initial", "fault", "present").repartition("chunk").sortWithinPartitions("chunk", "place").drop("place")
    segments = _map(short, _summaries, [("chunk", long), ("conv_id", id_type), ("cost", ints), ("rank", ints), ("first", T.StringType()), ("last", T.StringType()),
                                        ("low", turn_type), ("high", turn_type), *counts])
    choices = _map(segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk"), _choices,
                   [("conv_id", id_type), ("chunk", long), ("entry", T.IntegerType()), ("leave", T.IntegerType()), ("tail", T.StringType()),
                    *[(k, long) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]])
    choices = cut(choices, "repair-choices")
    heads = choices.select("chunk", F.lit(-1).cast("long").alias("place"), "conv_id", "entry", "leave", "tail")
    stream = (ordered.unionByName(heads, allowMissingColumns=True).repartition("chunk", "conv_id").sortWithinPartitions("chunk", F.col("conv_id").asc_nulls_first(), "place")
              .select("chunk", "conv_id", "turn", "initial", "fault", "present", "role", "text", "entry", "leave", "tail"))
    edits = _map(stream, _edits, [("chunk", long), ("conv_id", id_type), ("seq", long), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())])
    report = choices.where("cost IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return report, cut(edits, "repair-edits")


def digest(report: DataFrame, edits: DataFrame) -> DataFrame:
    """The report with audit (initials of all edits) and repaired_sha256 (``role:text`` of the repaired rows, newline-joined)."""
    sorted_edits = (edits.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk", "seq")
                    .select("conv_id", "edit", "role", "text"))
    found = _map(sorted_edits, _digests, [("conv_id", report.schema["conv_id"].dataType), ("audit", T.StringType()), ("repaired_sha256", T.StringType())])
    found = found.withColumnRenamed("conv_id", "of")
    return (report.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
            .withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))


def damage(turns: DataFrame) -> DataFrame:
    """Rows as the repair is tried on: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0: ``present`` is
    false), emptied (1), loses its ``.!?`` (2), is repeated (3) or given to the user (4)."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    what = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return (turns.select("conv_id", "turn", F.when(what == 4, "user").otherwise(role).alias("role"),
                         F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                         (what != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(what == 3, 2).otherwise(1))).alias("copy")).drop("copy"))
