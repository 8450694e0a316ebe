"""Registered queries against their SQL, and the pipeline against its operators."""

import pytest

import corpus_pipeline
from checks.compare import compare, duck
from demandspark.llm import near_dup
from demandspark.llm.queries import ORACLES, QUERIES, preference_pairs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    line = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert line.startswith("ok"), line


def test_preference_pairs_render_every_turn(spark):
    line = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b")]  # no reply
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "thanks")]  # a turn after the last reply
    rows += [(3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, None, "user", "late")]  # a null number
    rows += [(4, None, "assistant", "b"), (4, 0, "user", "a"), (4, 1, None, None)]  # the only reply has none
    rows += [(None, 0, "user", "x")]
    got = {r["pair_id"]: r for r in preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["prompt"] == line("user", "a") + line("user", "b") and got[1]["n_prompt_turns"] == 2
    assert got[1]["chosen"] == got[1]["rejected"] == "" and not got[1]["usable"]
    for k, prompt, rest in [(2, line("user", "a"), line("user", "thanks")), (3, line("user", "a"), line("user", "late")), (4, line("user", "a") + line("user", ""), "")]:
        assert got[k]["prompt"] == prompt and got[k]["usable"], k
        assert got[k]["chosen"] == line("assistant", "b") + rest and got[k]["rejected"] == line("assistant", "a") + rest, k


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, ids = docs, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
        ids.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    assert ids[3] <= ids[2] <= ids[1] <= ids[0]
    assert near_dup.near_duplicates(kept).filter("NOT kept").count() == 0
    mixed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in mixed.collect()} == ids[3]
