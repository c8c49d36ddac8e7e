"""Repair of conversation structure: a generalised LR parse over the role grammar with weighted edits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import own_columns, written

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
SPACE = r"\x20\x09-\x0D"
#: Rows that one parse takes at once; longer runs of a conversation are joined from such parts.
PART_ROWS = 256

# The role grammar: C -> empty | T | s T and T -> u a | T u a. Its LR automaton has the states
# 0 start, 1 behind s, 2 behind u, 3 behind T, 4 behind s T, 6 behind T u; 5 and 7 reduce at once.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # state: symbols that T replaces
GOTO = {0: 3, 1: 4}
ACCEPT = (0, 3, 4)


class Stack(NamedTuple):
    """A state on top of the stack below it; equal stacks are one value, and tails are shared."""

    state: int
    below: Stack | None = None


START = Stack(0)


@lru_cache(maxsize=None)
def shifted(stack: Stack, symbol: str) -> Stack | None:
    """The stack after a symbol and all reductions; None where the grammar does not take it."""
    state = SHIFT.get((stack.state, symbol))
    if state is None:
        return None
    top = Stack(state, stack)
    if state in REDUCE:
        for _ in range(REDUCE[state]):
            top = top.below
        top = Stack(GOTO[top.state], top)
    return top


def _stacks() -> list[Stack]:
    """All stacks that the role grammar can reach; T is left-recursive, so there are few."""
    found = [START]
    for stack in found:
        for symbol in ROLES:
            after = shifted(stack, symbol)
            if after is not None and after not in found:
                found.append(after)
    return found


STACKS = _stacks()

#: The tops of all live stacks, each with the cheapest (cost, audit) that leads there.
Tops = dict[Stack, tuple[int, str]]


def _offer(tops: Tops, stack: Stack | None, cost: int, audit: str) -> bool:
    """Merges a way to a top: the least (cost, audit) stays. Ways to one top at one place of the
    input never prolong each other at the same cost, so later edits keep their order."""
    if stack is None:
        return False
    best = tops.get(stack)
    if best is None or (cost, audit) < best:
        tops[stack] = cost, audit
        return True
    return False


def _insert(tops: Tops) -> None:
    waiting = list(tops)
    while waiting:
        stack = waiting.pop()
        cost, audit = tops[stack]
        for symbol in "ua":
            after = shifted(stack, symbol)
            if _offer(tops, after, cost + INSERT, audit + "I"):
                waiting.append(after)


@lru_cache(maxsize=1 << 14)
def parse(rows: str, entry: Stack) -> Tops:
    """The tops behind ``rows`` from one stack; inserts before each row and at the end are tried.

    ``rows`` has two characters a row: its role initial (``-`` for any other) and ``x`` for a row
    that must go, ``t`` for a truncated one, ``.`` for a sound one.
    """
    tops: Tops = {entry: (0, "")}
    _insert(tops)
    for k in range(0, len(rows), 2):
        role, fault = rows[k], rows[k + 1]
        after: Tops = {}
        extra = TRUNCATED if fault == "t" else 0
        for stack, (cost, audit) in tops.items():
            _offer(after, stack, cost + DELETE, audit + "D")
            if fault != "x":
                _offer(after, shifted(stack, role), cost + extra, audit + "K")
                for symbol in "ua":
                    _offer(after, shifted(stack, symbol), cost + REROLE + extra, audit + "R")
        _insert(after)
        tops = after
    return tops


#: Ways through a stretch of rows: for each entry stack the tops behind it.
Ways = dict[Stack, Tops]


def _joined(first: Ways, second: Ways) -> Ways:
    ways: Ways = {}
    for entry, tops in first.items():
        ways[entry] = {}
        for stack, (cost, audit) in tops.items():
            for after, (more, rest) in second.get(stack, {}).items():
                _offer(ways[entry], after, cost + more, audit + rest)
    return ways


def all_ways(rows: str, entries: list[Stack]) -> Ways:
    """Ways through any number of rows: parts are parsed apart and joined in pairs."""
    step = 2 * PART_ROWS
    parts = [rows[k : k + step] for k in range(0, len(rows), step)] or [""]
    ways = [{e: parse(p, e) for e in (entries if k == 0 else STACKS)} for k, p in enumerate(parts)]
    while len(ways) > 1:
        ways = [_joined(*ways[k : k + 2]) if k + 1 < len(ways) else ways[k] for k in range(0, len(ways), 2)]
    return ways[0]


def cheapest(tops: Tops) -> tuple[int, str]:
    """The least (cost, audit) among the tops at which a conversation may end."""
    return min(best for stack, best in tops.items() if stack.state in ACCEPT)


class Rebuild:
    """Applies an audit to the rows of a conversation, one after the other.

    ``write`` takes (edit, role, text) of each repaired row. Roles alternate, so an edit that sets a role
    makes a user unless one came last.
    """

    def __init__(self, audit: str, write: Callable[[str, str, str], None]):
        self.edits, self.write, self.last = iter(audit), write, ""
        self.edit = next(self.edits, None)

    def _put(self, role: str, text: str) -> None:
        self.last = role[:1]
        self.write(self.edit, role, text)
        self.edit = next(self.edits, None)

    def _next_role(self) -> str:
        return ROLES["a" if self.last == "u" else "u"]

    def inserts(self) -> None:
        while self.edit == "I":
            self._put(self._next_role(), "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        if self.edit == "D":
            self.edit = next(self.edits, None)
        else:
            self._put(role if self.edit == "K" else self._next_role(), text)


def _plain(rows: DataFrame) -> DataFrame:
    rows = own_columns(rows, "conv_id", "turn", "role", "text")
    return rows.fillna(" ", ["role", "text"])


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with the fixed damage: rows go, lose their text or full stops, come
    twice or turn to users, by the CRC-32 of ``conv_id:turn`` modulo 20. Nulls in that key, in roles and in
    texts are one space; ``conv_id`` and ``turn`` themselves stay null."""
    key = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    rows = _plain(conversations).withColumn("_kind", F.crc32(key.cast("binary")) % 20).where("_kind != 0")
    kind = F.col("_kind")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def marked(rows: DataFrame) -> DataFrame:
    """Rows without their text: ``conv_id, turn, role, digest, n, fault`` with equal rows of a turn counted.

    ``fault`` is of the first of the ``n``: blank, duplicate (an equal role and text stands earlier in the
    conversation), truncated or none; the others are duplicates unless they are blank.
    """
    last = F.regexp_extract(F.col("text"), rf"([^{SPACE}])[{SPACE}]*\z", 1)
    own = F.when(~F.col("text").rlike(rf"[^{SPACE}]"), "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    found = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), own.alias("fault"))
    found = found.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = found.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
    firsts = firsts.agg(F.min(place).alias("_first"), F.count("*").alias("_turns")).where("_turns > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    joined = found.join(firsts, same, "left")
    later = F.col("_first").isNotNull() & ~place.eqNullSafe(F.col("_first"))
    fault = F.when(later & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault"))
    return joined.select("conv_id", "turn", "role", "digest", "n", fault.alias("fault"))


_WAY = pa.struct([("entry", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
STRETCH_COLUMNS = """conv_id long, stretch long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long,
    last_turn long, first_role string, last_role string"""
STRETCH_SCHEMA = f"{STRETCH_COLUMNS}, ways array<struct<entry:int,after:int,cost:long,audit:string>>"
RESULT_SCHEMA = """conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
    repaired_sha256 string"""
TURN_SCHEMA = "conv_id long, position long, edit string, role string, text string"
_LEGAL = {"su", "ua", "au"}


class _Stretch:
    """What a task gathers about its rows of one conversation: counts, turns, and one code a row."""

    def __init__(self, conv):
        self.conv, self.codes = conv, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, n: int, fault: str) -> None:
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.counts["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        again = "blank" if fault == "blank" else "duplicate"
        if fault != "none":
            self.counts[fault] += 1
        if n > 1:
            self.counts[again] += n - 1
        code = {"blank": "x", "duplicate": "x", "truncated": "t", "none": "."}[fault]
        role_code = initial if initial in ROLES else "-"
        self.codes.append(role_code + code)
        self.codes.append((role_code + "x") * (n - 1))

    def row(self, stretch: int, whole: bool) -> dict:
        ways = all_ways("".join(self.codes), [START] if whole else STACKS)
        listed = [
            {"entry": STACKS.index(e), "after": STACKS.index(a), "cost": cost, "audit": audit}
            for e, tops in ways.items()
            for a, (cost, audit) in tops.items()
        ]
        ends = {k: getattr(self, k) for k in ("first_turn", "last_turn", "first_role", "last_role")}
        return {"conv_id": self.conv, "stretch": stretch, **self.counts, **ends, "ways": listed}


def _fields(ddl: str, **kinds: pa.DataType) -> pa.Schema:
    """Arrow fields for columns of longs and strings, and those given by name."""
    pairs = (c.split() for c in ddl.split(","))
    plain = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds.get(name) or plain[kind]) for name, kind in pairs])


def stretches(rows: DataFrame) -> DataFrame:
    """One row for each conversation and task that holds rows of it, from rows as ``marked`` gives them.

    Rows are sorted over ranges of (conversation, turn), so a hot conversation lies in many tasks.
    A task knows where a conversation begins and ends unless it is the first or last one it
    holds; for those it gives the ways from every stack.
    """
    parts = ["conv_id", "turn", "role", "digest"]
    rows = rows.select(*parts, "n", "fault").repartitionByRange(*parts).sortWithinPartitions(*parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        schema = _fields(STRETCH_COLUMNS + ", ways list", ways=pa.list_(_WAY))
        current, first = None, True
        for batch in batches:
            done = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault")]
            for conv, turn, role, n, fault in zip(*columns):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.row(partition, whole=not first))
                        first = False
                    current = _Stretch(conv)
                current.add(turn, role, n, fault)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row(partition, whole=False)], schema=schema)

    return rows.mapInArrow(run, STRETCH_SCHEMA)


class _Conversation:
    """A conversation as its stretches arrive in order, and then its rows."""

    def __init__(self, conv, write: Callable[[str, str, str], None]):
        self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.conv, self.turns, self.rebuild, self.write = conv, 0, None, write
        self.first_turn = self.last_turn = self.last_role = None
        self.tops: Tops = {START: (0, "")}

    def stretch(self, facts: dict) -> None:
        for k in self.total:
            self.total[k] += facts[k]
        if self.last_role is not None and self.last_role + facts["first_role"] not in _LEGAL:
            self.total["illegal"] += 1
        self.last_role = facts["last_role"]
        self.turns += facts["turns"]
        if facts["first_turn"] is not None:
            self.turns -= facts["first_turn"] == self.last_turn
            self.first_turn = facts["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = facts["last_turn"]
        ways: Ways = {}
        for w in facts["ways"]:
            ways.setdefault(STACKS[w["entry"]], {})[STACKS[w["after"]]] = w["cost"], w["audit"]
        self.tops = _joined({START: self.tops}, ways)[START]

    def _parsed(self) -> Rebuild:
        if self.rebuild is None:
            # without rows there is nothing to repair, and the empty conversation is legal
            self.cost, self.audit = cheapest(self.tops)
            self.rebuild, self.tops = Rebuild(self.audit, self.write), {}
        return self.rebuild

    def row(self, role: str, text: str) -> None:
        self._parsed().row(role, text)

    def finished(self) -> dict:
        self._parsed().inserts()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, **self.total, "cost": self.cost, "audit": self.audit}


def _stream(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conversation: a row for its id (kind 0), its stretches in order (1), its rows in order (2)."""
    found = stretches(written(marked(rows)))
    facts = F.struct(*[c for c in found.columns if c not in ("conv_id", "stretch")]).alias("facts")
    heads = found.select("conv_id", F.lit(1).alias("kind"), "stretch", facts)
    roster = own_columns(conversations, "conv_id").distinct().withColumn("kind", F.lit(0))
    texts = rows.withColumn("kind", F.lit(2)).withColumn("digest", _digest(F.col("text")))
    stream = roster.unionByName(heads, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    order = ["conv_id", "kind", "stretch", "turn", "role", "digest"]
    stream = stream.repartition("conv_id").sortWithinPartitions(*order)
    return stream.select("conv_id", "kind", "facts", "role", "text")


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable[[object], _Conversation]) -> Iterator[_Conversation | None]:
    """Each conversation when it is complete; None now and then, when a caller may hand on what it holds."""
    current = None
    for batch in batches:
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            for conv, kind, facts, role, text in zip(*[c.to_pylist() for c in part.columns]):
                if kind == 0:
                    if current is not None:
                        yield current
                    current = begin(conv)
                elif kind == 1:
                    current.stretch(facts)
                else:
                    current.row(role, text)
            yield None
    if current is not None:
        yield current


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text of every conversation.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read. ``rows`` are the
    same columns after some damage, by default as they are; nulls in role and text count as one
    space. Ids that ``rows`` lacks get zeros, an empty audit and the hash of no bytes. Rows are taken
    by turn, null turns first, rows of one turn by role and the SHA-256 of their text. A role counts by
    its first character; a row with none or another than s, u and a cannot be kept. A null
    ``conv_id`` is a conversation of its own. An empty table gives no rows.

    A conversation may hold any share of the rows: it is parsed in stretches by many tasks, and
    what they find is joined. Only the SHA-256 of its repaired text, which has to see the bytes in
    order, reads its rows in one task, row by row, with one byte a row of the audit in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, done = _fields(RESULT_SCHEMA), []

        def begin(conv) -> _Conversation:
            sha = hashlib.sha256()
            lines = 0

            def write(edit: str, role: str, text: str) -> None:
                nonlocal lines
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1

            found = _Conversation(conv, write)
            found.sha = sha
            return found

        for conversation in _walk(batches, begin):
            if conversation is not None:
                done.append(conversation.finished() | {"repaired_sha256": conversation.sha.hexdigest()})
            elif done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return _stream(conversations, _plain(conversations if rows is None else rows)).mapInArrow(run, RESULT_SCHEMA)


def repaired_turns(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, position, edit, role, text``, in positions from 0.

    Inputs and their cases are those of ``repair``; conversations that end up empty have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = _fields(TURN_SCHEMA), []

        def begin(conv) -> _Conversation:
            position = 0

            def write(edit: str, role: str, text: str) -> None:
                nonlocal position
                out.append({"conv_id": conv, "position": position, "edit": edit, "role": role, "text": text})
                position += 1

            return _Conversation(conv, write)

        for conversation in _walk(batches, begin):
            if conversation is not None:
                conversation.finished()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()

    return _stream(conversations, _plain(conversations if rows is None else rows)).mapInArrow(run, TURN_SCHEMA)
