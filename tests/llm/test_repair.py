"""op11: the parser against every possible edit, and the query's counts against a plain reading of the rows."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest

from veristrata.llm import repair
from veristrata.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TALK = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """The least (cost, audit) and its rows by trying all edits, with up to two inserted turns between any two rows."""
    best = None
    choices = []
    for role, text, fault in rows:
        extra = 3 if fault == repair.CUT else 0
        own = [(4, "D", [])]
        if fault not in (repair.BLANK, repair.DUPLICATE):
            own += [(extra, "K", [(role, text)]), (3 + extra, "R", [("user", text)]), (3 + extra, "R", [("assistant", text)])]
        choices.append(own)
    inserts = [(0, "", [])] + [(3 * n, "I" * n, list(x)) for n in (1, 2) for x in itertools.product([("user", ""), ("assistant", "")], repeat=n)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        cost = sum(g[0] for g in gaps)
        if best is not None and cost > best[0]:
            continue
        for picked in itertools.product(*choices):
            edits = [gaps[0]] + [e for pair in zip(picked, gaps[1:]) for e in pair]
            key = sum(e[0] for e in edits), "".join(e[1] for e in edits)
            if best is not None and key >= best[:2]:
                continue
            out = [r for e in edits for r in e[2]]
            if TALK.fullmatch("".join(r[0][:1] or "?" for r in out)):
                best = (*key, out)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_the_parser_finds_the_cheapest_edits(n):
    kinds = [("user", repair.SOUND), ("assistant", repair.SOUND), ("system", repair.SOUND), ("tool", repair.SOUND), ("", repair.CUT), ("user", repair.CUT), ("assistant", repair.CUT), ("user", repair.BLANK), ("assistant", repair.DUPLICATE)]
    kinds = kinds if n < 3 else kinds[:3] + kinds[5:8]
    for picked in itertools.product(kinds, repeat=n):
        rows = [(role, f"t{k}", fault) for k, (role, fault) in enumerate(picked)]
        parser = repair.Parser()
        for r in rows:
            parser.row(*r)
        cost, audit, out = every_repair(rows)
        text = "\n".join(f"{role}:{t}" for role, t in out)
        assert parser.end() == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def cheapest(rows):
    """The same by dynamic programming over whole strings: a second opinion for long conversations."""
    moves = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                for r, role in (("u", "user"), ("a", "assistant")):
                    if (state, r) in moves:
                        put(states, moves[state, r], (cost + 3, audit + "I", out + [f"{role}:"]))
        return states

    now = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        extra = 3 if fault == repair.CUT else 0
        for state, (cost, audit, out) in now.items():
            put(after, state, (cost + 4, audit + "D", out))
            if fault in (repair.BLANK, repair.DUPLICATE):
                continue
            if (state, role[:1]) in moves:
                put(after, moves[state, role[:1]], (cost + extra, audit + "K", out + [f"{role}:{text}"]))
            for r, name in (("u", "user"), ("a", "assistant")):
                if (state, r) in moves:
                    put(after, moves[state, r], (cost + 3 + extra, audit + "R", out + [f"{name}:{text}"]))
        now = inserted(after)
    cost, audit, out = min(v for state, v in now.items() if state in ("", "a"))
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain(rows):
    """The contract's row of each conversation, from all rows in memory."""
    talks, ids = defaultdict(list), set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        talks[conv] += [(turn, role, text)] * (2 if how == 3 else 1)
    out = []
    for conv in ids:
        seen, faulty = set(), []
        said = sorted(talks[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for turn, role, text in said:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faulty.append((role, text, repair.BLANK if not words else repair.DUPLICATE if (role, text) in seen else repair.CUT if words[-1] not in ".!?" else repair.SOUND))
            seen.add((role, text))
        turns = {r[0] for r in said} - {None}
        kinds = [f for _, _, f in faulty]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, kinds.count(repair.BLANK), kinds.count(repair.DUPLICATE), kinds.count(repair.CUT), illegal, *cheapest(faulty)))
    return sorted(out, key=str)


def test_query_equals_a_plain_reading(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, DATA).collect()), key=str)
    assert got == plain(rows)
    assert {letter for r in got for letter in r[7]} == set("KRDI")


SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def test_odd_rows(spark):
    """Nulls in any column, ties, repeats, empty and long texts, unknown and empty roles, clashing columns."""
    texts = ["", " \t\n", "a.", "b", None, "é!", "x" * 100_000 + "?"]
    roles = ["user", "assistant", "system", "tool", "", None, "ünknown"]
    rows = [(c, t, roles[k % 7], texts[(k * 3 + k // 7) % 7], "own") for k, (c, t) in enumerate(itertools.product([None, 1, 2, 3, 4], [None, 0, 0, 1, 2, 2, 5, 9, 9]))]
    rows += rows[:9] + [(k, 0, "user", "gone.", "own") for k in range(40, 140)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, repair.repaired(df).collect()), key=str)
    assert got == plain([r[:4] for r in rows])
    nothing = hashlib.sha256(b"").hexdigest()
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", nothing) for r in got)  # all rows dropped
    assert repair.repaired(df.limit(0)).collect() == []


def test_a_long_conversation_streams():
    """What a chart holds does not grow with the conversation, but for the audit."""
    parser, rows = repair.Parser(), []
    for k in range(3000):
        rows.append((["user", "assistant", "tool"][k * 7 % 3], f"t{k}.", [repair.SOUND, repair.CUT, repair.BLANK, repair.DUPLICATE][k * k % 4]))
        parser.row(*rows[-1])
        assert len(parser.column) <= 8 and all(len(b.audit) < 200 for b in parser.column.values())
    assert parser.end() == cheapest(rows)
