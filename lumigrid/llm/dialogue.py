"""Repair of a conversation's structure: the cheapest edits that give turns of the form (system)? (user assistant)+.

Rows are dealt out by conversation and sorted inside each partition. A task reads them as a stream, cuts conversations into
stretches of at most DEPTH turns, and gathers stretches of many conversations into one batch for DuckDB: a recursive query
advances one turn of all of them at a time and keeps, for each stretch, state in which it was entered and state of the
grammar, the least cost and its audit. Stretches after a conversation's first are entered in every state, so they run side
by side, and joining them needs no more than a look at four states. Memory is a batch of turns and the open audit; the hash
of the repaired text runs along for each state, so a conversation of any length passes once.

States: 0 nothing said, 1 system, 2 user (an answer is due), 3 assistant. 0 and 3 may end.

Defined results: nulls in conv_id, turn (in the damage key), role and text are one space; null turns come first; rows of
one turn are ordered by role and text, so copies stand together; a null conv_id is one conversation; roles with other
initials than s, u and a, empty ones included, are never kept; very long texts pass as they are; an empty table gives an
empty result; a conversation without rows has zeros, an empty audit and the hash of the empty text. Only the four columns
are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Turns of a stretch, and turns and characters of a batch.
DEPTH, TURNS, CHARS = 128, 8192, 16_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Where each initial leads from each state, and what may be inserted or given as a role.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
#: What a conversation that ends in a state still needs.
ENDING = {0: "", 1: "II", 2: "I", 3: ""}


def moves() -> list[tuple[int, int, str, str, int, str | None]]:
    """(from, to, edit, letters, cost, initial) of one turn: up to two insertions, then what happens to the turn. Three or
    more would come back to a state."""
    out = []
    for src in range(4):
        state = src
        for k in range(3):
            out.append((src, state, "D", "I" * k + "D", k * INSERT + DELETE, None))
            out.append((src, GRAMMAR[state, WANTED[state]], "R", "I" * k + "R", k * INSERT + REROLE, None))
            out += [(src, dst, "K", "I" * k + "K", k * INSERT + KEEP, i) for (at, i), dst in GRAMMAR.items() if at == state]
            state = GRAMMAR[state, WANTED[state]]
    return out


ADVANCE = """
WITH RECURSIVE reached AS (
  SELECT stretch, 0 AS i, state AS entry, state, {'cost': 0, 'audit': ''} AS best FROM entries
  UNION ALL
  SELECT r.stretch, r.i + 1, r.entry, m.dst, min({'cost': r.best.cost + m.cost + CASE WHEN m.edit = 'D' THEN 0 ELSE t.cut END, 'audit': r.best.audit || m.letters})
  FROM reached r JOIN turns t ON t.stretch = r.stretch AND t.i = r.i JOIN moves m ON m.src = r.state
  WHERE m.edit = 'D' OR (NOT t.must AND (m.edit = 'R' OR m.initial = t.initial))
  GROUP BY r.stretch, r.i, r.entry, m.dst)
SELECT r.stretch, r.entry, r.state, r.best.cost AS cost, r.best.audit AS audit FROM reached r JOIN lengths n ON n.stretch = r.stretch AND n.n = r.i
"""


@dataclass
class Path:
    """A way through a conversation so far: its cost, the audit beyond what all ways share, and the hash of what it says."""

    cost: int = 0
    audit: str = ""
    said: object = field(default_factory=hashlib.sha256)
    first: str = ""  # the first role's initial; empty: nothing said

    def say(self, role: str, text: str) -> None:
        self.said.update((("\n" if self.first else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = self.first or role[:1] or " "


def replayed(path: Path, state: int, letters: str, turns: list[tuple[str, str]]) -> tuple[Path, int]:
    """path after these edits of turns (role, text), and the state it ends in."""
    out, rest = Path(path.cost, path.audit, path.said.copy(), path.first), iter(turns)
    for edit in letters:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else WANTED[state]
        out.say(role if edit == "K" else ROLE[initial], text)
        state = GRAMMAR[state, initial]
    return out, state


@dataclass
class Open:
    """A conversation whose turns are still read: what is counted, the ways to each state, and the stretches that wait."""

    key: object
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    initial: str | None = None
    least: int | None = None
    most: int | None = None
    turns: int = 0
    ways: dict[int, Path] = field(default_factory=lambda: {0: Path()})
    settled: list[str] = field(default_factory=list)
    stretches: list[list[tuple]] = field(default_factory=list)

    def take(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault:
            self.counts[fault - 1] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None and turn != self.most:  # turns come in order, nulls first
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        if not self.stretches or len(self.stretches[-1]) == DEPTH:
            self.stretches.append([])
        self.stretches[-1].append((initial, fault in (1, 2), int(fault == 3), role, text))

    def joined(self, got: list[dict[int, dict[int, tuple[int, str]]]], ended: bool) -> None:
        """Takes the stretches' results (by entry and state: cost and audit) in their order."""
        for k, (stretch, by) in enumerate(zip(self.stretches, got, strict=True)):
            best: dict[int, tuple[int, str, int, str]] = {}
            for entry, path in self.ways.items():
                for state, (cost, letters) in by[entry].items():
                    way = (path.cost + cost, path.audit + letters, entry, letters)
                    if state not in best or way[:2] < best[state][:2]:
                        best[state] = way
            if ended and k == len(got) - 1:  # only the one way that ends the conversation is said
                state = min(best, key=lambda s: (best[s][0] + INSERT * len(ENDING[s]), best[s][1] + ENDING[s]))
                best = {state: best[state]}
            turns, ways = [x[3:] for x in stretch], {}
            for state, (cost, audit, entry, letters) in best.items():
                path, _ = replayed(self.ways[entry], entry, letters, turns)
                path.cost, path.audit = cost, audit
                ways[state] = path
            shared = os.path.commonprefix([p.audit for p in ways.values()])
            self.settled.append(shared)
            for p in ways.values():
                p.audit = p.audit[len(shared) :]
            self.ways = ways
        self.stretches = []

    def result(self) -> tuple:
        state = min(self.ways, key=lambda s: (self.ways[s].cost + INSERT * len(ENDING[s]), self.ways[s].audit + ENDING[s]))
        path, _ = replayed(self.ways[state], state, ENDING[state], [])
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.counts, self.illegal, path.cost + INSERT * len(ENDING[state]), "".join([*self.settled, path.audit, ENDING[state]]), path.said.hexdigest(), path.first == "s")


def advanced(db, stretches: list[tuple[list[tuple], bool]]) -> list[dict[int, dict[int, tuple[int, str]]]]:
    """For each stretch (turns, whether it begins its conversation) its least cost and audit by entry and state."""
    at = [(k, i, *t[:3]) for k, (turns, _) in enumerate(stretches) for i, t in enumerate(turns)]
    columns = dict(zip(("stretch", "i", "initial", "must", "cut"), zip(*at, strict=True), strict=True))
    entries = [(k, s) for k, (_, begins) in enumerate(stretches) for s in ((0,) if begins else range(4))]
    tables = {
        "turns": pa.table(columns), "entries": pa.table({"stretch": [k for k, _ in entries], "state": [s for _, s in entries]}),
        "lengths": pa.table({"stretch": list(range(len(stretches))), "n": [len(t) for t, _ in stretches]}),
    }
    for name, table in tables.items():
        db.register(name, table)
    out: list[dict] = [{} for _ in stretches]
    for stretch, entry, state, cost, audit in db.execute(ADVANCE).fetchall():
        out[stretch].setdefault(entry, {})[state] = (cost, audit)
    for name in tables:
        db.unregister(name)
    return out


def _stream(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(config={"threads": 1})
    db.execute("CREATE TABLE moves (src INT, dst INT, edit VARCHAR, letters VARCHAR, cost INT, initial VARCHAR)")
    db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    waiting: list[Open] = []
    turns = chars = 0

    def flushed(ended: bool) -> pa.RecordBatch:
        """Joins what waits; all but the last conversation, and that too if ended, are complete."""
        each = [(c, s, k == 0 and not c.settled) for c in waiting for k, s in enumerate(c.stretches)]
        got = iter(advanced(db, [(s, begins) for _, s, begins in each]) if each else [])
        done = waiting if ended else waiting[:-1]
        for c in waiting:
            c.joined([next(got) for _ in c.stretches], ended or c is not waiting[-1])
        rows = [c.result() for c in done]
        waiting[:] = [] if ended else waiting[-1:]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for b in batches:
        for key, turn, role, text, fault in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if not waiting or waiting[-1].key != key:
                waiting.append(Open(key))
            if fault < 0:  # the row itself is gone
                continue
            waiting[-1].take(turn, role, text, fault)
            turns, chars = turns + 1, chars + len(text)
            if turns >= TURNS or chars >= CHARS:
                yield flushed(False)
                turns = chars = 0
    if waiting:
        yield flushed(True)


def _last(text: Column) -> Column:
    """text without the word breaks at its end."""
    return F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, has_system (whether a system turn
    stays) of turns (conv_id, turn, role, text); rows with present = false, if there is that column, only name their
    conversation."""
    there = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"), *[F.when(there, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")], there.alias("present"))
    dealt = rows.repartition("conv_id")  # the window and the sort below stay inside these partitions
    order = F.col("turn").asc_nulls_first()
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(order)) > 1
    end = F.col("end")
    fault = F.when(~F.col("present"), -1).when(end == "", 1).when(F.col("again"), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    judged = dealt.withColumn("again", again).withColumn("end", _last(F.col("text"))).select("conv_id", "turn", "role", "text", fault.alias("fault"), "again")
    sorted_ = judged.sortWithinPartitions("conv_id", order, "role", "text", "again")  # the first of equal rows comes first
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType)] + T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, has_system boolean").fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _stream((b for bs in ([first], batches) for b in bs), names, first.schema.field(0).type)

    return sorted_.mapInArrow(run, schema)


def repaired(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired turns from the audits of report(), numbered from 0."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.where("present") if "present" in turns.columns else turns
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)
    each = reports.where("audit <> ''").select("conv_id", "has_system", F.posexplode(F.split("audit", "")).alias("k", "edit"))
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    counted = each.withColumn("i", F.coalesce(F.count_if(F.col("edit") != "I").over(before), F.lit(0))).withColumn("place", F.coalesce(F.count_if(F.col("edit") != "D").over(before), F.lit(0)))
    kept = counted.where("edit <> 'D'").withColumn("i", F.when(F.col("edit") != "I", F.col("i")))
    a, b = kept.alias("a"), numbered.alias("b")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.i") == F.col("b.i")), "left")
    turn = F.when((F.col("place") - F.col("has_system").cast("int")) % 2 == 0, "user").otherwise("assistant")
    role = F.when(F.col("edit") == "K", F.col("b.role")).otherwise(turn)
    return both.select(F.col("a.conv_id").alias("conv_id"), "place", "edit", role.alias("role"), F.coalesce("b.text", F.lit("")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of conversations with seeded faults: of twenty turns one is lost, one emptied,
    one without its sentence ends, one twice and one from the user. A lost turn stays as a row that isn't present."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    which = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    faulty = conversations.select(
        "conv_id", "turn", F.when(which == 4, "user").otherwise(role).alias("role"), F.when(which == 1, "").when(which == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.array_repeat(F.lit(True), F.when(which == 0, 0).when(which == 3, 2).otherwise(1)).alias("copies"),
    )
    return faulty.select("conv_id", "turn", "role", "text", F.explode_outer("copies").alias("present")).withColumn("present", F.coalesce("present", F.lit(False)))


def digest(conversations: DataFrame) -> DataFrame:
    return report(damaged(conversations)).drop("has_system")
