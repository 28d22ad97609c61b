"""Repair of conversations against a search over all edits."""

import functools
import hashlib
import re
import zlib
from itertools import groupby, product

from hypothesis import given, settings, strategies as st

from drivespan.llm import registry, turn_grammar as tg, turns

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text, h != 0)] * (2 if h == 3 else 1)
    return out


def best(faults):
    """The least (cost, audit) of turns (initial, must go, truncated), by trying all edits."""

    @functools.cache
    def go(i, state):
        found = []
        if i == len(faults):
            if state in ("", "ua"):
                found.append((0, ""))
        else:
            initial, gone, short = faults[i]
            found.append((3, "D", i + 1, state))
            for to, after in () if gone else NEXT[state].items():
                if to == initial:
                    found.append((short, "K", i + 1, after))
                if to in "ua":
                    found.append((2 + short, "R", i + 1, after))
        return found

    @functools.cache
    def least(i, state, inserted):
        """inserted: turns put in since the last row; three never pay."""
        out = []
        for x in go(i, state):
            if len(x) == 2:
                out.append(x)
            else:
                c, a = least(x[2], x[3], 0)
                out.append((x[0] + c, x[1] + a))
        if inserted < 3:
            for to, after in NEXT[state].items():
                if to in "ua":
                    c, a = least(i, after, inserted + 1)
                    out.append((2 + c, "I" + a))
        return min(out, default=(10**9, ""))

    return least(0, "", 0)


def expected(rows):
    """By conversation, from damaged rows (conv, turn, role, text, kept)."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, own in groupby(sorted(rows, key=key), key):
        own = list(own)
        conv, live = own[0][0], [r for r in own if r[4]]
        live.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, counts, faults = set(), [0, 0, 0], []
        for _, _, role, text, _ in live:
            bare = text.strip(WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            faults.append((role[:1], fault < 2, fault == 2))
        at = [r[1] for r in live if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:], strict=False))
        cost, audit = best(tuple(faults))
        said, state, todo = [], "", iter(live)
        for e in audit:
            role, text = ("", "") if e == "I" else next(todo)[2:4]
            if e != "D":
                role = role if e == "K" else "assistant" if state == "u" else "user"
                said.append(f"{role}:{text}")
                state = NEXT[state][role[0]]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = registry.op13_turns(spark, sf_dir)
    assert got(out) == expected(damaged(rows)) and out.count() == len({r[0] for r in rows})


def test_odd_tables(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, None, "system", "S."), (1, 9, None, None), (1, 9, "user", " \n"),
        (2, None, None, None), (2, None, None, None), (None, 3, "user", "What?"), (None, 4, "assistant", "x" * 300000), (None, 4, "assistant", "y"),
        (3, 5, "", "."), (3, 6, "User", "A!"), (3, 7, "tool", "b"), (4, 2, "assistant", "A."), (4, 1, "assistant", "A."), (4, 3, "system", "!"), (4, 3, "assistant", "é"),
        *((c, t, ("user", "assistant")[t % 2], f"{t % 3} ok.") for c in range(5, 40) for t in range(c % 7)), *((50, t, "user", "again") for t in range(40)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as digest", "'x' as head", "0 as n")
    assert got(turns.repair(turns.damage(df))) == expected(damaged(rows))
    plain = [(*(" " if k > 1 and x is None else x for k, x in enumerate(r)), True) for r in rows]
    for size, rounds in ((3, 8), (1, 1), (64, 0)):
        assert got(turns.repair(df.repartition(5), size, rounds)) == expected(plain)
    assert turns.repair(turns.damage(df.limit(0))).count() == 0
    gone = df.limit(1).selectExpr("conv_id", "turn", "role", "text", "false as kept")
    assert got(turns.repair(gone)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_long_conversation(spark):
    """Its stretches lie in several tasks; the answer is that of one pass over all turns."""
    df = spark.range(30000).selectExpr("7L as conv_id", "id as turn", "element_at(array('user','assistant','system','tool'), cast(1 + crc32(cast(id as string)) % 23 % 4 as int)) as role", "concat('t', id % 9000, if(id % 5 = 0, '', '.')) as text")
    cut = turns.stretches(turns.faults(df.withColumn("kept", turns.F.lit(True))), 1000)
    assert cut.count() >= 30
    row = turns.repair(df, 1000).collect()[0]
    seen, symbols = set(), []
    for r in df.orderBy("turn").collect():
        symbols.append("d" if (r.role, r.text) in seen else (x if r.text[-1] == "." else x.upper()) if (x := r.role[0] if r.role[0] in "sua" else "x") else "")
        seen.add((r.role, r.text))
    live = tg.follow([(0, ""), None, None, None], (tg.Grammar().moves[c] for c in symbols))
    assert (row.cost, row.audit) == tg.cheapest(live) and row.duplicate == symbols.count("d")


@settings(max_examples=150, deadline=None)
@given(st.text(tg.SYMBOLS, max_size=12), st.lists(st.text(tg.SYMBOLS, max_size=12), max_size=4), st.integers(0, 12))
def test_grammar_gives_the_least_edits(symbols, others, at):
    grammar = tg.Grammar()
    for _ in range(6):
        grammar = grammar.grown(list(grammar.pairs(dict.fromkeys([symbols, *others], 2)).items()))
    want = best(tuple((c.lower(), c == "d", c.isupper()) for c in symbols))
    a, b = (tg.read(tg.written(grammar.matrix(x))) for x in (symbols[:at], symbols[at:]))
    assert tg.cheapest(tg.follow([(0, ""), None, None, None], [a, b])) == want
    assert tg.cheapest(grammar.matrix(symbols)[tg.START]) == want


def test_rules_replace_what_is_frequent():
    grammar = tg.Grammar()
    for _ in range(4):
        grammar = grammar.grown(list(grammar.pairs({"suauauaua": 5, "uaua": 3}).items()))
    assert len(grammar.compressed("suauauaua")) < 5 and grammar.spans[grammar.rules[-1][1]] > 2
    assert all(tg.flat(("a", ("b", ("c", "d")))) == "abcd" for _ in product("x"))
