from demandspark.llm import line_dedup


def brute(rows):
    """Rows (doc_id, text) with later windows cut, walking the documents in order."""
    seen, out = {}, {}
    order = sorted({(i is None, i or 0, i, t) for i, t in rows if t is not None}, key=lambda x: x[:2] + (x[3],))
    for _, _, i, t in order:
        lines, cut = t.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if any(x.strip(" ") for x in window) and seen.setdefault(window, (i, t, k)) != (i, t, k):
                cut |= {k, k + 1, k + 2}
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in cut)
    return sorted((str(i), str(None if t is None else out[i, t])) for i, t in rows)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS at", "2 AS covered", "3 AS doc_key", "4 AS x", "5 AS _cut_id", "6 AS cut_key", "7 AS gone", "8 AS _gone", "9 AS OWN_KEY")
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    return sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())


def test_equals_a_walk_in_order(spark):
    passage = "\n".join(f"passage line {i}" for i in range(6))
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "a\nb"), (23, "a\nb\nc"), (24, "a\nb\nc"), (24, "a\nb\nc"), (25, "\n\n\n\n"), (26, "\n\n\n\nx")]
    rows += [(27, "r\nr\nr\nr\nr"), (28, "\n".join(f"l{i % 50}" for i in range(5000))), (None, passage)]
    assert run(spark, rows) == brute(rows)


def test_short_texts_repeat_as_a_whole(spark):
    long = "word " * 60
    rows = [(1, long), (2, long), (3, f"{long}\nb"), (4, f"{long}\nb"), (5, f"b\n{long}"), (6, f"{long}\nb\nc"), (7, long), (None, long)]
    rows += [(8, " \n"), (9, " \n"), (10, ""), (11, ""), (12, f"{long}\n"), (13, None), (14, "x"), (14, "x")]
    got = run(spark, rows)
    assert got == sorted((str(i), "" if i in (2, 4, 7, None) else str(t)) for i, t in rows)


def test_empty_table(spark):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string").collect() or [(1, None)]) == [("1", "None")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    passage = "\n".join(f"line {i} of the passage" for i in range(40_000))
    rows = [(1, passage), (2, passage + "\nown"), (3, "head\n" + passage)]
    got = dict(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {1: passage, 2: "own", 3: "head"}
