"""Repair of conversations: the cheapest edits that make their roles ``(s?(ua)+)?``, a system turn at most, then user and assistant in turn.

Edits of a turn: Keep costs 0, Rerole to user or assistant 1, Delete 2; a user or assistant turn without text is Inserted anywhere for 5. Blank turns
and repetitions must be deleted; a truncated turn that stays adds 5. Among equally cheap repairs the one whose edits' initials, read in order, come first
in ASCII is taken; it tells all roles, since each place of the result has only one possible role once the first is known.

The dynamic programme runs over the turns that stay. ``best`` holds, for each role of the last turn that stays (and for none yet), the least cost less what
deleting all turns up to it would have cost: a running minimum, so that the gap to the next turn that stays is priced by a prefix sum of
deletions, and the pair of roles tells how many turns stand inserted in it. In a gap deletions come before insertions, as D comes before I. A
state carries its edits and the digest of its repaired text so far, so one pass in order of turns is enough: a conversation, however long, streams
through one task with a few bytes for each turn that is not settled yet (a digest of its whole text has to be taken in order anyway).

Defined cases: a null role or text is one space; a turn without a role can be rerolled, not kept; null turns come first; turns of one number are ordered by role, then by text; repeated rows are
repetitions; a null conv_id is a conversation; rows marked absent only make their conversation known; an empty table gives no rows; further columns
are not read.
"""

import os
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
INSERTS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
AT_END = {"": 0, "s": 2, "u": 1, "a": 0}
NAMES = {"u": b"user", "a": b"assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SETTLE = 4096  # edits after which what all states share is put aside


class State:
    """A repair up to the last turn that stays: cost less the deletion of all turns up to it, edits, number of turns read, digest so far."""

    __slots__ = ("cost", "edits", "read", "digest")

    def __init__(self, cost: int, edits: str, read: int, digest):
        self.cost, self.edits, self.read, self.digest = cost, edits, read, digest

    def upto(self, read: int) -> str:
        return self.edits + "D" * (read - self.read)

    def before(self, other: "State") -> bool:
        read = max(self.read, other.read)
        return self.cost < other.cost or self.cost == other.cost and self.upto(read) < other.upto(read)


def inserted(last: str, n: int) -> list[bytes]:
    """The n turns that stand inserted after a turn of role ``last``."""
    first = "a" if last == "u" else "u"
    return [NAMES[r] + b":" for r in (first, "a" if first == "u" else "u")[:n]]


class Conversation:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.read, self.settled = conv_id, 0, []
        self.best = {"": State(0, "", 0, sha256())}
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.turns: list = [None, None, 0]  # least, greatest, how many different

    def add(self, turn: int | None, initial: str, role: bytes, text: bytes, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        self.last = initial
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        before, self.read = self.read, self.read + 1
        if fault in (BLANK, DUPLICATE):
            return
        new = {}
        for r in "sua":
            keep = initial == r
            if not keep and r == "s":
                continue
            found = None
            for last, state in self.best.items():
                n = INSERTS.get((last, r))
                if n is None:
                    continue
                cost = state.cost + 5 * n - (2 if keep else 1) + 5 * (fault == TRUNCATED)
                if found is None or cost <= found[0]:
                    edits = state.upto(before) + "I" * n
                    if found is None or (cost, edits) < found[:2]:
                        found = cost, edits, last, n, state
            if found:
                cost, edits, last, n, state = found
                digest = state.digest.copy()
                digest.update(b"\n" * (last != "") + b"".join(x + b"\n" for x in inserted(last, n)) + (role if keep else NAMES[r]) + b":" + text)
                new[r] = State(cost, edits + ("K" if keep else "R"), self.read, digest)
        for r, state in new.items():
            if r not in self.best or state.before(self.best[r]):
                self.best[r] = state
        if self.read % SETTLE == 0:
            self.put_aside()

    def put_aside(self) -> None:
        """Drops states that can no longer be best: from an assistant's turn all goes on that goes on from the start or a system turn, but for keeping a
        system turn, which deleting it makes up for (2), and a user's turn is an insertion (5) away. What all others share is settled."""
        reach = min((s.cost + (2 if r == "a" else 7) for r, s in self.best.items() if r in ("a", "u")), default=None)
        if reach is not None:
            self.best = {r: s for r, s in self.best.items() if r in ("a", "u") or s.cost <= reach}
        shared = len(os.path.commonprefix([s.edits for s in self.best.values()]))
        if shared:
            self.settled.append(next(iter(self.best.values())).edits[:shared])
            for s in self.best.values():
                s.edits = s.edits[shared:]

    def close(self) -> tuple:
        ends = [(s.cost + 2 * self.read + 5 * AT_END[r], s.upto(self.read) + "I" * AT_END[r], r) for r, s in self.best.items()]
        cost, edits, r = min(ends)
        digest = self.best[r].digest
        for x in inserted(r, AT_END[r]):
            digest.update(b"\n" + x)
        least, most, n = self.turns
        gaps = most - least + 1 - n if n else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, cost, "".join(self.settled) + edits, digest.hexdigest()


def judged(df: DataFrame, present: Column, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, initial, role, text, fault (null: absent), in order within partitions that hold whole conversations: one shuffle by conv_id, the window needs none of its own."""
    c = lambda name: F.col(f"`{name}`")
    rows = df.select(
        c(conv_id).cast("long").alias("conv_id"), c(turn).cast("long").alias("turn"), F.coalesce(c(role), F.lit(" ")).alias("role"),
        F.coalesce(c(text), F.lit(" ")).alias("text"), F.coalesce(present, F.lit(True)).alias("present"),
    ).repartition("conv_id")
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(end == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    rows = rows.withColumn("seen", seen).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", "text", F.when(F.col("present"), fault).cast("int").alias("fault"), "seen")
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "seen").drop("seen")


def values(batch: pa.RecordBatch, raw: tuple[str, ...]) -> Iterator[tuple]:
    return zip(*[(c.cast(pa.binary()) if n in raw else c).to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)], strict=True)


def repair(df: DataFrame, present: Column | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """REPORT: of each conversation its faults before, and the cheapest repair: cost, edits and the SHA-256 of its ``role:text`` lines.

    gaps: turn numbers missing between the least and the greatest; illegal: neighbours whose roles' initials are not su, ua or au; present: rows that
    are there (default: all)."""
    rows = judged(df, F.lit(True) if present is None else present, conv_id, turn, role, text)
    names = [f.split()[0] for f in REPORT.split(", ")]
    schema = pa.schema([(n, pa.int64() if n not in ("audit", "repaired_sha256") else pa.string()) for n in names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, turn, initial, role, text, fault in values(batch, ("role", "text")):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.close())
                    now = Conversation(conv)
                if fault is not None:
                    now.add(turn, initial, role, text, fault)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)
                done = []
        if now is not None:
            done.append(now.close())
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)

    return rows.mapInArrow(stream, REPORT)


def repaired_turns(df: DataFrame, report: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """TURNS: the conversations as ``report`` (of repair, settled) repairs them: place from 0, and the edit (K, R or I) each turn comes from.

    A conversation's edits come first in its stream; nothing but them is held."""
    c = lambda name: F.col(f"`{name}`")
    rows = df.select(c(conv_id).cast("long").alias("conv_id"), F.lit(1).alias("kind"), c(turn).cast("long").alias("turn"), F.coalesce(c(role), F.lit(" ")).alias("role"), F.coalesce(c(text), F.lit(" ")).alias("text"))
    edits = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = rows.unionByName(edits).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, last = "", 0, 0, ""
        for batch in batches:
            out = []

            def put(conv, edit, role, text, initial):
                nonlocal place, last
                out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
                place, last = place + 1, initial

            def insert(conv):
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    at += 1
                    put(conv, "I", "assistant" if last == "u" else "user", "", "a" if last == "u" else "u")

            for conv, kind, _, role, text in values(batch, ()):
                if kind == 0:
                    audit, at, place, last = text, 0, 0, ""
                elif audit[at] == "D":
                    at += 1
                else:
                    edit, at = audit[at], at + 1
                    to = role if edit == "K" else "assistant" if last == "u" else "user"
                    put(conv, edit, to, text, to[:1])
                insert(conv)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))

    return rows.mapInArrow(stream, TURNS)
