from emberline.llm import preference

TURNS = "array<struct<role:string,text:string>>"


def brute(pair_id, chosen, rejected):
    chosen, rejected = chosen or [], rejected or []
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda t: f"<|{t[0] or ''}|>\n{t[1] or ''}\n<|end|>\n"
    out = [pair_id, n, "".join(map(show, chosen[:n]))]
    for side in (chosen, rejected):
        text, spans = "", []
        for t in side[n:]:
            begin = len(text) + len(f"<|{t[0] or ''}|>\n")
            text += show(t)
            if t[0] == "assistant":
                spans.append((begin, len(text)))
        out += [text, [int(t[0] == "assistant") for t in side[n:]], spans]
    return out


def test_against_brute_force(spark):
    u, a, b, s = ("user", "hi"), ("assistant", "yes ✓"), ("assistant", "no"), ("system", "be kind")
    pairs = [
        (1, [s, u, a], [s, u, b]), (2, [u, a], [u, a]), (3, [u, a], [u]), (4, [], [u]), (5, None, [a, b]), (6, [(None, None), a], [(None, None), b]), (7, [(None, "x")], [("user", "x")]),
        (None, [u], [u]), (1, [s, u, a], [s, u, b]), (8, [u, a] * 300 + [a], [u, a] * 300 + [b, u]), (9, [u, ("assistant", "x" * 100_000)], [u, ("assistant", "y" * 100_000)]), (10, [u, ("assistant", None)], [u, ("assistant", "")]),
    ]
    rows = preference.format_pairs(spark.createDataFrame([(*p, "extra") for p in pairs], f"pair_id long, chosen {TURNS}, rejected {TURNS}, prompt string")).collect()
    got = [[r.pair_id, r.n_common, r.prompt, r.chosen_completion, list(r.chosen_mask), [tuple(x) for x in r.chosen_spans], r.rejected_completion, list(r.rejected_mask), [tuple(x) for x in r.rejected_spans]] for r in rows]
    assert sorted(got, key=repr) == sorted((brute(*p) for p in pairs), key=repr)
    for r in rows:
        for x in r.chosen_spans:
            assert r.chosen_completion[x.start : x.end].endswith("\n<|end|>\n")


def test_conversations_and_corrupted_answers(spark):
    turns = [(1, 1, "assistant", "b c d"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "only"), (3, 0, "assistant", "one"), (None, 0, "user", "x"), (4, None, None, None), (4, 1, "assistant", None), (5, 0, "assistant", "x y"), (5, 1, "user", "end")]
    rows = preference.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv: [tuple(t) for t in r.turns] for r in rows.collect()}
    assert got[1] == [("user", "a"), ("user", "a"), ("assistant", "b c d")] and got[4] == [(None, None), ("assistant", None)] and set(got) == {1, 2, 3, 4, 5}
    pairs = {r.pair_id: r for r in preference.with_corrupted(rows).collect()}
    assert set(pairs) == {1, 5}
    assert pairs[1].rejected[-1].text == "d c b" and pairs[5].rejected[0].text == "y x" and pairs[5].rejected[1] == pairs[5].chosen[1]


def test_the_plan_has_no_python(spark, sf):
    from emberline.llm import queries

    df = queries.op1_preference_formatting(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert df.count() > 0


def test_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.with_corrupted(preference.conversations(empty))).count() == 0
