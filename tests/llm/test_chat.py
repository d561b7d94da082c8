from chronomesh.llm import chat

SCHEMA = "pair_id long, turn long, role string, text string, k int, prompt string"


def brute(chosen, rejected):
    def talks(rows):
        out = {}
        for p, *t in {r[:4] for r in rows if r[0] is not None}:
            out.setdefault(p, []).append(tuple(t))
        null_first = lambda t: tuple((x is not None, x) for x in t)
        return {p: sorted(ts, key=null_first) for p, ts in out.items()}

    def render(turns):
        text, spans = "", []
        for _, role, said in turns:
            text += f"<|{role or ''}|>\n"
            start = len(text)
            text += f"{said or ''}<|end|>"
            if role == "assistant":
                spans.append(f"{start}:{len(text)}")
            text += "\n"
        return text, ",".join(spans)

    good, bad, out = talks(chosen), talks(rejected), []
    for p in good.keys() | bad.keys():
        a, b = good.get(p, []), bad.get(p, [])
        k = 0
        while k < min(len(a), len(b)) and a[k][1:] == b[k][1:]:
            k += 1
        out.append((p, k, render(a[:k])[0], *render(a[k:]), *render(b[k:])))
    return sorted(map(repr, out))


CHOSEN = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi é"), (1, 2, "assistant", "hello"), (1, 3, "user", "more"), (1, 4, "assistant", "fine"),
    (2, 0, "user", "same"), (2, 1, "assistant", "reply"), (3, 0, "user", "only chosen"), (4, None, None, None), (4, 1, "assistant", None),
    (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "nobody"), (6, 0, "user", "x" * 50_000), (6, 1, "assistant", ""),
]
REJECTED = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi é"), (1, 2, "assistant", "go away"), (2, 0, "user", "same"), (2, 1, "assistant", "reply"),
    (4, None, None, None), (4, 1, "assistant", ""), (5, 0, "user", "a"), (6, 0, "user", "x" * 50_000), (6, 1, "assistant", "漢字"), (7, 0, "assistant", "only rejected"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)


def test_pairs_equal_brute_force(spark):
    got = chat.preference_pairs(frame(spark, CHOSEN), frame(spark, REJECTED)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(CHOSEN, REJECTED)


def test_masks_cover_what_the_assistant_says(spark):
    row = next(r for r in chat.preference_pairs(frame(spark, CHOSEN), frame(spark, REJECTED)).collect() if r.pair_id == 1)
    spans = [tuple(map(int, s.split(":"))) for s in row.chosen_mask.split(",")]
    assert [row.chosen[a:b] for a, b in spans] == ["hello<|end|>", "fine<|end|>"]
    assert row.n_prompt_turns == 2 and row.prompt.endswith("hi é<|end|>\n")


def test_empty_tables_and_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.preference_pairs(none, none).collect() == []
    out = chat.preference_pairs(frame(spark, CHOSEN), none)
    assert {r.n_prompt_turns for r in out.collect()} == {0}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_pair_that_holds_most_turns(spark):
    chosen = [(1, i, "assistant" if i % 2 else "user", f"turn {i % 7}") for i in range(4000)] * 2 + [(2, 0, "user", "other")]
    rejected = [(1, i, "assistant" if i % 2 else "user", f"turn {i % 7}" if i != 2500 else "else") for i in range(4000)]
    got = chat.preference_pairs(frame(spark, chosen), frame(spark, rejected))
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(chosen, rejected)
