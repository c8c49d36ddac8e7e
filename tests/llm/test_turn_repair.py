"""The repair against a shortest-path search over plain role strings."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from taskloom.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit) of rows (initial, fault) over the pattern's own automaton, by exhaustive recursion."""

    @functools.cache
    def best(at, state, inserted):
        found = []
        if at == len(rows) and state in ("", "a"):
            found.append((0, ""))
        ways = [(3, "I", NEXT[state].get(r), at, inserted + 1) for r in "ua"] if inserted < 3 else []
        if at < len(rows):
            initial, fault = rows[at]
            ways.append((4, "D", state, at + 1, 0))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                ways.append((extra, "K", NEXT[state].get(initial), at + 1, 0))
                ways += [(3 + extra, "R", NEXT[state].get(r), at + 1, 0) for r in "ua"]
        for cost, edit, after, row, n in ways:
            if after is not None:
                rest = best(row, after, n)
                if rest is not None:
                    found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    for at in range(len(rows), -1, -1):  # from the end, so the recursion stays shallow
        for state in NEXT:
            best(at, state, 0)
    return best(0, "", 0)


def brute(given, damage=True):
    found = {}
    for conv in {r[0] for r in given}:
        rows = []
        for c, turn, role, text in given:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20 if damage else 9
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        codes, seen = [], set()
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
            seen.add((role, text))
            codes.append((role[:1] or "-", fault))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit = cheapest(tuple(codes))
        out, left = [], list(rows)
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if out and out[-1][0].startswith("u") else "user"
            out.append((role, text))
        assert PATTERN.fullmatch("".join(r[:1] for r, _ in out))
        faults = [f for _, f in codes]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
            out,
        )
    return found


def check(spark, given, damage=True):
    conversations = spark.createDataFrame([(*r, "clash") for r in given], SCHEMA + ", fault string")
    rows = turn_repair.damaged(conversations) if damage else None
    got = [tuple(r) for r in turn_repair.repair(conversations, rows).collect()]
    expected = brute(given, damage)
    assert {r[0]: r[1:] for r in got} == {k: v[:-1] for k, v in expected.items()} and len(got) == len(expected)
    return conversations, rows, expected


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Ünï. \n", "é"]
    rows = []
    for conv in conversations:
        at = rng.randrange(3)
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[at % 2]
            text = f"Line {rng.randrange(40)}." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv, rng.choice([at, at, at, None]), role, text))
            at += rng.choice([1, 1, 1, 0, 3])
    rng.shuffle(rows)
    return rows


def test_repair_equals_search(spark):
    given = random_rows(1, [*range(120), None], 12) + [(900, 0, "user", "x" * 100_000 + "."), (901, None, None, None)]
    check(spark, given)
    check(spark, random_rows(2, range(60), 9), damage=False)


def test_long_conversation_is_parsed_in_stretches(spark):
    """One conversation holds most rows: tasks parse their stretches of it and parts of them."""
    rng = random.Random(3)
    given = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Line {t}", "Why?"])) for t in range(1500)]
    given += random_rows(4, range(6, 12), 20) + random_rows(5, range(3), 20)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        conversations, _, _ = check(spark, given, damage=False)
        rows = turn_repair.marked(conversations.fillna(" ", ["role", "text"]))
        assert turn_repair.stretches(rows).where("conv_id = 5").count() > 1
    finally:
        spark.conf.set(name, before)


def test_repaired_turns_are_the_repaired_text(spark):
    given = random_rows(6, range(30), 8)
    conversations, rows, expected = check(spark, given)
    found = {}
    for r in turn_repair.repaired_turns(conversations, rows).orderBy("conv_id", "position").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {k: v[-1] for k, v in expected.items() if v[-1]}


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    given = [(gone, 0, "user", "Hello.")]
    conversations, rows, _ = check(spark, given)
    assert turn_repair.repair(conversations, rows).first()["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(empty, turn_repair.damaged(empty)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_parts_join_to_the_whole(seed, monkeypatch):
    """Joining parts gives the (cost, audit) of one parse, from every stack."""
    rng = random.Random(seed)
    codes = [rng.choice("suua-a") + rng.choice("x...t") for _ in range(60)]
    whole = {e: turn_repair.parse("".join(codes), e) for e in turn_repair.STACKS}
    monkeypatch.setattr(turn_repair, "PART_ROWS", 7)
    assert turn_repair.all_ways("".join(codes), turn_repair.STACKS) == whole
    plain = tuple((c[0], {"x": "blank", "t": "truncated", ".": "none"}[c[1]]) for c in codes)
    assert turn_repair.cheapest(whole[turn_repair.START]) == cheapest(plain)


def test_automaton_takes_the_role_pattern():
    for n in range(7):
        for k in range(3**n):
            word = "".join("sua"[k // 3**i % 3] for i in range(n))
            stack = turn_repair.START
            for symbol in word:
                stack = stack and turn_repair.shifted(stack, symbol)
            assert (stack is not None and stack.state in turn_repair.ACCEPT) == bool(PATTERN.fullmatch(word))
    assert len(turn_repair.STACKS) == 8
