"""Repair against every possible edit of short conversations, segments, edge tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from prodtext.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """Cheapest edits of (turn, role, text) rows, by trying all of them."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    fault, best = faults(rows), None
    legal = re.compile(r"(s?(ua)+)?")
    inserted = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    per_row = []
    for (_, role, text), f in zip(rows, fault):
        edits = [("D", 4, None)]
        if f not in ("blank", "duplicate"):
            extra = 3 if f == "truncated" else 0
            edits += [("K", extra, (role, text)), ("R", 3 + extra, ("user", text)), ("R", 3 + extra, ("assistant", text))]
        per_row.append(edits)
    for chosen in itertools.product(*per_row):
        for gaps in itertools.product(inserted, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, roles in enumerate(gaps):
                cost, audit, out = cost + 3 * len(roles), audit + "I" * len(roles), out + [(r, "") for r in roles]
                if i < len(chosen):
                    edit, c, row = chosen[i]
                    cost, audit = cost + c, audit + edit
                    out += [row] if row else []
            if best is not None and (cost, audit) > best[:2] or not legal.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                continue
            best = min(best or (10**9, "", ""), (cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(turns, present=None):
    got = R.digest(*R.repair_conversations(turns, present)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def random_rows(rng, n):
    texts = ["Fine.", "Also fine!", "cut short", " \t", "", "cut . short", "Yes? \n", "No."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]
    return [(rng.choice([0, 1, 2, 3, 5, None]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_against_all_edits(spark):
    rng = random.Random(12)
    convs = {i: random_rows(rng, rng.choice([1, 2, 2, 3, 3])) for i in range(150)}
    turns = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    assert repaired(turns) == {c: plain(rows) for c, rows in convs.items()}


def whole_lattice(rows):
    """All states' best (cost, audit, lines) row by row, with whole strings."""
    at = {0: (0, "", ())}
    for (_, role, text), f in zip(rows, faults(rows)):
        new = {}
        for q, (cost, audit, lines) in at.items():
            for to, letters, inserted, c in R.moves(q, role[:1], R.FAULTS.index(f)):
                more = tuple(f"{R.ROLE[s]}:" for s in inserted)
                more += () if letters[-1] == "D" else (f"{role if letters[-1] == 'K' else R.ROLE[to]}:{text}",)
                new[to] = min(new.get(to, (10**9,)), (cost + c, audit + letters, lines + more))
        at = new
    ends = [(cost + 3 * len(R.ENDING[q]), audit + "I" * len(R.ENDING[q]), lines + tuple(f"{R.ROLE[s]}:" for s in R.ENDING[q])) for q, (cost, audit, lines) in at.items()]
    cost, audit, lines = min(ends)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def long_rows(rng, n):
    rows = []
    for i in range(n):
        role = rng.choice(["system", "user", "assistant", "tool"] if rng.random() < 0.3 else ["user", "assistant"][i % 2:][:1])
        rows.append((i, role, rng.choice([f"Text {i}.", f"Text {i}.", f"cut {i}", "Same.", ""])))
    return rows


def test_segments_of_long_conversations(spark):
    """Without merging of small partitions, each conversation lies in many segments."""
    rng = random.Random(5)
    convs = {i: long_rows(rng, n) for i, n in enumerate([400, 3, 900, 1, 250])}
    turns = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], SCHEMA)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        report, edits = R.repair_conversations(turns)
        assert edits.groupBy("conv_id").agg(F.countDistinct("chunk").alias("n")).agg(F.max("n")).first()[0] > 5
        got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in R.digest(report, edits).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == {c: whole_lattice(rows) for c, rows in convs.items()}


@pytest.mark.parametrize("kind", ["random", "deleting", "users", "blank"])
def test_tree_stays_small_and_entries_agree(kind):
    """Survivors coalesce whatever the rows: the unresolved window is bounded."""
    rng = random.Random(kind)
    pick = {"random": lambda i: (rng.choice("suao"), rng.choice([0, 0, 0, 1, 2, 3])), "deleting": lambda i: ("o", 3), "users": lambda i: ("u", i % 2 * 3), "blank": lambda i: ("u", 1)}[kind]
    for entry in range(4):
        paths, widest, n = R.Survivors(entry), 0, 0
        for i in range(3000):
            paths.step(*pick(i), None)
            n += len(paths.settled())
            widest = max(widest, i + 1 - n)
        assert widest < 60
        assert n + len(paths.rest(next(iter(paths.at)))) == 3000


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes." * 100_000), (2, 0, "user", None), (None, 0, "user", "Null conv."), (None, 1, "assistant", "Ok."),
            (3, 0, "user", "Twice."), (3, 0, "user", "Twice."), (4, None, "user", "A."), (4, None, "assistant", "B.")]
    turns = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "chunk", "place", "Cost", "fault", "initial", "entry"):
        turns = turns.withColumn(c, F.lit("clash"))
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert repaired(turns) == {c: plain(r) for c, r in by.items()}
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}


def test_rows_that_only_name_their_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", False), (2, 0, "user", "Hi.", True), (2, 5, "assistant", "Ho.", False), (2, 1, "assistant", "Ho.", None)], SCHEMA + ", here boolean")
    got = repaired(turns, "here")
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][-3:-1] == (3, "KI")


def test_damage(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    import zlib
    want = []
    for r in turns.collect():
        what = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", r.text) if what == 2 else r.text
        want += [(r.conv_id, r.turn, "user" if what == 4 else r.role, text, what != 0)] * (2 if what == 3 else 1)
    assert sorted(map(tuple, R.damage(turns).collect())) == sorted(want)
