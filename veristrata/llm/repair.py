"""Conversation structure repair: an error-correcting Earley parser over roles, with delete, rerole and insert productions."""

from __future__ import annotations

import hashlib
import heapq
import os.path
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The weighted grammar: nonterminal, what it derives (initials of roles are terminals). Talk is `(s?(ua)+)?`.
#: It is left linear, so that every chart item begins at the first row and a chart is as long as its conversation.
GRAMMAR: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Talk", ()),
    ("Talk", ("Turns",)),
    ("Turns", ("Asked", "a")),
    ("Asked", ("u",)),
    ("Asked", ("Opened", "u")),
    ("Asked", ("Turns", "u")),
    ("Opened", ("s",)),
)
#: What the error productions cost, and the roles that they can make of a row or of nothing.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Faults of a row, the first that applies.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3


@dataclass(slots=True)
class Best:
    """The cheapest derivation of a chart item: its cost, the edits since what all items share, and the digest of the repaired rows."""

    cost: int
    audit: str
    digest: object
    rows: int = 0

    def key(self) -> tuple[int, str]:
        return self.cost, self.audit

    def then(self, cost: int, edit: str) -> tuple[int, str]:
        return self.cost + cost, self.audit + edit

    def said(self, cost: int, edit: str, role: str, text: str) -> Best:
        digest = self.digest.copy()
        digest.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        return Best(*self.then(cost, edit), digest, self.rows + 1)


class Parser:
    """The chart of one conversation, column by column.

    An item (rule, dot) stands for a dotted production that derives the rows so far; it keeps the least (cost, audit).
    For equal rows and equal cost no audit begins another, as each letter but I takes one row and I costs something: so
    a lesser audit stays lesser whatever follows both, and keeping one derivation an item is exact. Columns that are
    done are dropped; what all items share of their audits is set aside, so an item's own part stays short.
    """

    def __init__(self):
        self.waiting: dict[str, list[tuple[int, int]]] = {}  # items of the first column by the nonterminal they need
        self.shared: list[str] = []
        start = Best(0, "", hashlib.sha256())
        first = {(k, 0): start for k, _ in self._predicted("Talk")}
        for item in first:
            need = self._next(item)
            if need and len(need) > 1:
                self.waiting.setdefault(need, []).append(item)
        self.column = self._settled(first)

    @staticmethod
    def _predicted(goal: str):
        """The rules that a derivation of goal can begin with."""
        seen, todo = set(), [goal]
        while todo:
            name = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            for k, (head, body) in enumerate(GRAMMAR):
                if head == name:
                    yield k, body
                    if body and len(body[0]) > 1:
                        todo.append(body[0])

    @staticmethod
    def _next(item: tuple[int, int]) -> str | None:
        body = GRAMMAR[item[0]][1]
        return body[item[1]] if item[1] < len(body) else None

    def _settled(self, column: dict) -> dict:
        """Complete, and insert missing roles, until no item gets cheaper; in order of (cost, audit), so each is settled once."""
        queue = [(b.cost, b.audit, item) for item, b in column.items()]
        heapq.heapify(queue)
        done = set()

        def offer(item, key, make):
            if item not in done and (item not in column or key < column[item].key()):
                column[item] = make()
                heapq.heappush(queue, (*key, item))

        while queue:
            cost, audit, item = heapq.heappop(queue)
            best = column[item]
            if item in done or (cost, audit) != best.key():
                continue
            done.add(item)
            need = self._next(item)
            if need is None:  # completer
                for rule, dot in self.waiting.get(GRAMMAR[item[0]][0], ()):
                    offer((rule, dot + 1), best.key(), lambda best=best: best)
            elif need in ROLES:  # insert production
                offer((item[0], item[1] + 1), best.then(INSERT, "I"), lambda best=best, need=need: best.said(INSERT, "I", ROLES[need], ""))
        return column

    def row(self, role: str, text: str, fault: int) -> None:
        """Scan one row: keep, rerole or delete it, from every item that waits for a role (or has all it needs)."""
        after: dict[tuple[int, int], tuple] = {}

        def offer(item, key, *how):
            if item not in after or key < after[item][0]:
                after[item] = key, *how

        extra = TRUNCATED if fault == CUT else 0
        for item, best in self.column.items():
            need = self._next(item)
            ended = need is None and GRAMMAR[item[0]][0] == "Talk"
            if ended or need is not None and len(need) == 1:
                offer(item, best.then(DELETE, "D"), best, DELETE, "D", None)
            if need is None or len(need) > 1 or fault in (BLANK, DUPLICATE):
                continue
            ahead = (item[0], item[1] + 1)
            if role[:1] == need:
                offer(ahead, best.then(extra, "K"), best, extra, "K", role)
            elif need in ROLES:
                offer(ahead, best.then(REROLE + extra, "R"), best, REROLE + extra, "R", ROLES[need])
        column = {item: Best(*best.then(cost, edit), best.digest, best.rows) if said is None else best.said(cost, edit, said, text) for item, (_, best, cost, edit, said) in after.items()}
        self.column = self._settled(column)
        common = os.path.commonprefix([b.audit for b in self.column.values()])
        if len(common) > 64:
            self.shared.append(common)
            for b in {id(b): b for b in self.column.values()}.values():
                b.audit = b.audit[len(common) :]

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest derivation of Talk over all rows."""
        best = min((b for item, b in self.column.items() if self._next(item) is None and GRAMMAR[item[0]][0] == "Talk"), key=Best.key)
        return best.cost, "".join(self.shared) + best.audit, best.digest.hexdigest()


# ---------------------------------------------------------------- rows

_SPACE = r"[\x20\x09-\x0D]"


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of `conv_id:turn` sets, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. A null id or
    turn counts as one space in that string, a null role or text is one space.
    """
    how = F.crc32(F.concat_ws(":", _plain("conv_id"), _plain("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _plain("role").alias("role"), _plain("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def faults(rows: DataFrame) -> DataFrame:
    """rows with `fault`: 1 blank, 2 duplicate (its role and text came earlier in the conversation), 3 truncated, else 0.

    Rows are dealt by conversation once; duplicates are found by sorting each conversation's rows by role and digest
    of the text. Within a turn rows go by role, then text; equal rows are alike.
    """
    from pyspark.sql import Window

    said = F.regexp_replace("text", rf"{_SPACE}+\z", "")
    dealt = rows.repartition("conv_id").withColumn("digest", F.sha2("text", 256))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(said == "", BLANK).when(nth > 1, DUPLICATE).when(~F.substring(said, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return dealt.withColumn("fault", fault).drop("digest")


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): its faults, and its cheapest repair.

    Columns are those of SCHEMA: gaps in its turns, rows by their first fault, neighbours whose roles may not follow one
    another, the cost and the edits (K, R, D, I) of the cheapest repair, and a digest of the repaired rows. Nulls come
    first by turn; conversations of null id are one. Roles count by their first character; an empty or unknown one can
    only be reroled or deleted. A conversation streams through its task in order, sorted and spilled by Spark: what is
    held is one row, a chart column of seven items at most with a running digest each, and the audit. An empty table
    gives an empty result; other columns are left out.
    """
    ordered = faults(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _plain("role").alias("role"), _plain("text").alias("text")))
    ordered = ordered.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)

    def run(batches):
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])
        held: list[tuple] = []
        now = None
        for b in batches:
            for conv, turn, role, text, fault in zip(*(b.column(k).to_pylist() for k in range(5))):
                if now is None or now.conv != conv:
                    if now is not None:
                        held.append(now.report())
                    now = _Conversation(conv)
                now.row(turn, role, text, fault)
                if len(held) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
        if now is not None:
            held.append(now.report())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return map_batches(ordered.select("conv_id", "turn", "role", "text", "fault"), run, SCHEMA)


class _Conversation:
    """Running counts of one conversation, and its parser."""

    def __init__(self, conv: int | None):
        self.conv, self.parser = conv, Parser()
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.faults[fault] += 1
        self.parser.row(role, text, fault)

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, *self.parser.end())


def repaired(conversations: DataFrame) -> DataFrame:
    """repair() of the damaged rows, with a row for every conversation that there was: of those without rows all is zero or empty."""
    found = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
