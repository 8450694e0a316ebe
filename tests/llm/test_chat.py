from demandspark.llm import chat


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_pairs(spark):
    same = [("system", "be kind"), ("user", "hi <|assistant|>"), ("assistant", "hello")]
    chosen = {1: [*same, ("user", "more"), ("assistant", "yes")], 2: [("user", "a")], 3: [("user", "a"), ("assistant", "b")], 4: [("user", None), (None, "x")], 6: same}
    rejected = {1: [*same, ("user", "more"), ("assistant", "no")], 2: [("assistant", "a")], 3: [("user", "a")], 5: [("user", "z")], 4: [("user", ""), ("user", "y" * 100_000)], 6: same}
    df = lambda s: spark.createDataFrame([(k, i, r, t) for k, v in s.items() for i, (r, t) in enumerate(v)] + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS c")
    got = {r["pair_id"]: r for r in chat.format_preferences(df(chosen), df(rejected)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    fixed = [("system", "be kind"), ("user", "hi < |assistant|>"), ("assistant", "hello"), ("user", "more")]
    assert got[1]["prompt"] == render(fixed) and got[1]["n_prompt_turns"] == 4
    span = got[1]["chosen_spans"][0]
    assert got[1]["chosen"][span["a"] : span["b"]] == "yes<|end|>\n" and got[1]["usable"]
    assert got[2]["prompt"] == "" and got[2]["chosen_spans"] == [] and len(got[2]["rejected_spans"]) == 1
    assert got[3]["n_prompt_turns"] == 1 and got[3]["rejected"] == "" and not got[3]["usable"]
    assert got[4]["n_prompt_turns"] == 1 and got[4]["chosen"] == render([("user", "x")])
    assert not got[5]["usable"] and not got[6]["usable"] and got[6]["n_prompt_turns"] == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_preferences(none, none).count() == 0
