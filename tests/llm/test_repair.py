import hashlib
import itertools
import random
import re
import zlib

import pytest

from emberline.llm import queries, repair

GRAMMAR = re.compile("(s?(ua)+)?")


def brute(turns, marks):
    """Cost and least audit over all edit strings, by trying every one with at most a few insertions."""
    best = None

    def go(i, inserted, cost, audit, initials, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(turns) and GRAMMAR.fullmatch(initials):
            best = min(best, (cost, audit, out), key=lambda b: b[:2]) if best else (cost, audit, out)
        if inserted < 2:
            for name in ("user", "assistant"):
                go(i, inserted + 1, cost + 3, audit + "I", initials + name[0], [*out, (name, "")])
        if i == len(turns):
            return
        go(i + 1, 0, cost + 4, audit + "D", initials, out)
        if marks[i] in ("blank", "duplicate"):
            return
        extra = 3 if marks[i] else 0
        role, text = turns[i]
        if role[:1] in ("s", "u", "a"):
            go(i + 1, 0, cost + extra, audit + "K", initials + role[0], [*out, turns[i]])
        for name in ("user", "assistant"):
            go(i + 1, 0, cost + 3 + extra, audit + "R", initials + name[0], [*out, (name, text)])

    go(0, 0, 0, "", "", [])
    return best


def test_layers_against_all_edit_strings():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(60):
            turns = [(rng.choice(["user", "assistant", "system", "tool", "s2", ""]), rng.choice(["a.", "b", "c!", "", "d."])) for _ in range(n)]
            marks = repair.faults(turns)
            cost, audit, out = repair.trace(turns, marks)
            assert (cost, audit, out) == brute(turns, marks), turns
            assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in out))


def test_all_roles_of_three_turns():
    for roles in itertools.product(["user", "assistant", "system", "x"], repeat=3):
        turns = [(r, f"{i}.") for i, r in enumerate(roles)]
        assert repair.trace(turns, ["", "", ""]) == brute(turns, ["", "", ""])


def test_faults():
    turns = [("user", "hi."), ("user", "hi."), ("assistant", "hi."), ("user", " \t\n\x0b\x0c\r"), ("user", "cut "), ("user", "ok?\n"), ("user", "nbsp. ")]
    assert repair.faults(turns) == ["", "duplicate", "", "blank", "truncated", "", "truncated"]


def test_long_conversation_takes_small_columns():
    turns = [(r, f"{i}.") for i, r in enumerate(["user", "user", "system", "assistant"] * 5000)]
    columns = repair.layers([r[0] for r, _ in turns], [""] * len(turns))
    assert max(c.bit_length() for _, c in columns) <= 64
    cost, audit, out = repair.trace(turns, [""] * len(turns))
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in out)) and cost == sum({"K": 0, "D": 4}.get(x, 3) for x in audit)


def plain(rows):
    """The contract, one conversation after the other, with the edits found by a table of least (cost, audit) per state."""
    convs = {}
    for conv, turn, role, text in rows:
        at = convs.setdefault(conv, [])
        known = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        at += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        pairs = [t[1:] for t in turns]
        marks = repair.faults(pairs)
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
        best = {0: (0, "", ())}

        def relax(table, state, value):
            if state not in table or value[:2] < table[state][:2]:
                table[state] = value

        def insertions(table):
            for _ in range(4):
                for q, (c, a, o) in list(table.items()):
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if x in step[q]:
                            relax(table, step[q][x], (c + 3, a + "I", (*o, (name, ""))))

        insertions(best)
        for (role, text), mark in zip(pairs, marks, strict=True):
            new = {}
            for q, (c, a, o) in best.items():
                relax(new, q, (c + 4, a + "D", o))
                if mark not in ("blank", "duplicate"):
                    extra = 3 if mark else 0
                    if role[:1] in step[q]:
                        relax(new, step[q][role[:1]], (c + extra, a + "K", (*o, (role, text))))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if x in step[q]:
                            relax(new, step[q][x], (c + 3 + extra, a + "R", (*o, (name, text))))
            insertions(new)
            best = new
        cost, audit, out = min(best[q] for q in (0, 3) if q in best)
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))  # noqa: B905
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, sha


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(df, rows):
    assert df.columns == NAMES
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    same(queries.op11_conversation_repair(spark, sf), rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["Yes.", "No", None, "", "Why? ", "é.\n", "x" * 50_000])) for c in range(150) for t in rng.sample([None, 0, 1, 2, 3, 5, 9], rng.randrange(1, 6))]
    rows += [(None, 1, "user", "q?"), (None, None, None, None), rows[0], rows[0], (7000, 1, "user", "one."), *((9000, t, "user", f"{t}.") for t in range(3000))]
    wide = [(*r, 1, "a", 5, [1]) for r in rows]
    df = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, cost int, audit string, kind int, repaired array<int>")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    same(queries.op11_conversation_repair(spark, str(tmp_path)), rows)
    out = repair.repair(df)
    assert out.columns == ["conv_id", *NAMES[1:-1], "repaired"]
    assert out.count() == len({r[0] for r in rows})
    assert repair.repair(df.where("false")).count() == 0


def test_conversation_of_dropped_rows(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "q?")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("roles,cost,audit", [("ua", 0, "KK"), ("sua", 0, "KKK"), ("u", 3, "KI"), ("a", 3, "IK"), ("uua", 3, "KIKK"), ("x", 4, "D"), ("", 0, "")])
def test_known_audits(roles, cost, audit):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    turns = [(names[r], f"{i}.") for i, r in enumerate(roles)]
    assert repair.trace(turns, [""] * len(turns))[:2] == (cost, audit)
