from collections import Counter
import re

import pytest

from demandspark.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + min(10, len(w))]), set()).add(str(item))
    out = Counter()
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= names
        out[doc, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.fixture
def items(spark, words):
    rows = [(i, " ".join(words[20 * i : 20 * i + 10 + 3 * i])) for i in range(9)]
    rows += [(20, "short item"), (21, "single"), (22, None), (23, ""), (24, "!?"), (None, "no id here"), (3, rows[3][1])]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("chunk", [1_000_000, 25])
def test_equals_brute_force(spark, words, items, documents, chunk, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_WORDS", chunk)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for i in range(9):
        rows.append((200 + i, "x y, " + items[0][i][1].upper().replace(" ", " - ") + " z " + " ".join(words[: 5 * i])))
        rows.append((300 + i, " ".join(words[20 * i : 20 * i + 9]) + " end"))
    rows += [(400, "a short ITEM and single"), (401, "short\x00item é single")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS items", "2 AS spans", "3 AS `row`")
    got = decontam.find_contamination(df, items[1]).collect()
    known = [x for x in items[0] if x[0] is not None]
    assert Counter((r["doc_id"], r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), tuple(r["items"])) for r in got) == brute(rows, known)
    kept = decontam.remove_contaminated(df, items[1])
    assert kept.columns == df.columns
    clean = Counter(d for (d, _, n, _), c in brute(rows, known).items() for _ in range(c) if not n)
    assert Counter(r["doc_id"] for r in kept.collect()) == clean


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.95])
def test_share_does_not_depend_on_the_chunks(spark, words, items, share, monkeypatch):
    parts = [items[0][i][1] for i in range(9)]
    texts = [parts[0] + " " + parts[1] + " own words", parts[0] + " " + " ".join(words[500:510]) + " " + parts[8], parts[2], " ".join(words[600:640]), "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS items", "2 AS spans", "3 AS `row`", "4 AS _row", "5 AS n_words")
    known = [x for x in items[0] if x[0] is not None]
    want = Counter()
    for (i, n, hit, _), c in brute(rows, known).items():
        want[i] += c if hit <= share * n else 0
    for chunk in (1_000_000, 25, 1):
        monkeypatch.setattr(decontam, "CHUNK_WORDS", chunk)
        kept = decontam.remove_contaminated(df, items[1], max_share=share)
        assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == +want


def test_empty_tables(no_documents, documents, items):
    assert decontam.find_contamination(no_documents, items[1]).count() == 0
    assert decontam.find_contamination(documents, items[1].limit(0)).filter("size(items) > 0").count() == 0


def test_remove_spans():
    assert decontam.remove_spans("Keep this, drop THESE words! keep é", [(2, 5)]) == "Keep this, ! keep é"
    assert decontam.remove_spans(None, []) is None
