import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandspark.llm import token_align

public = pytest.importorskip("public_tokenizers")
PATHS = [public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def two():
    return token_align.TwoTokenizers(*PATHS)


@pytest.fixture(scope="module")
def plain():
    """Tokens of a whole text by the two libraries themselves: (ids, bytes) of A and of B."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = token_align._byte_of_letter()

    def of_piece(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    def tokens(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return x, [bytes(letters[c] for c in a.id_to_token(i)) for i in x], y, [of_piece(i) for i in y]

    return tokens


def plain_links(text, plain):
    """(A ids, B ids, links as id pairs, groups) from the owner of every byte."""
    a, a_bytes, b, b_bytes = plain(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    of_a = [k for k, x in enumerate(a_bytes) for _ in x]
    of_b = [k for k, x in enumerate(b_bytes) for _ in x]
    links = sorted(set(zip(of_a, of_b, strict=True)))
    groups, first = [], 0
    for end in range(1, len(whole) + 1):
        if end == len(whole) or (of_a[end] != of_a[end - 1] and of_b[end] != of_b[end - 1]):
            ids = lambda of, all_: ",".join(str(all_[k]) for k in sorted(set(of[first:end])))
            groups.append(ids(of_a, a) + "|" + ids(of_b, b))
            first = end
    return a, b, [(a[i], b[j]) for i, j in links], groups


def plain_rows(docs, plain):
    found = [(id_, plain_links(text, plain) if text else None) for id_, text in docs]
    counts = Counter(p for _, x in found if x for p in x[2])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter(
        (id_, 0, 0, 0, 0, 0, 0, "") if x is None else
        (id_, len(x[0]), len(x[1]), len(x[3]), len(x[2]), sum(counts[p] == most[p[1]] for p in x[2]), sum(counts[p] for p in x[2]),
         hashlib.sha256(";".join(x[3]).encode()).hexdigest())
        for id_, x in found)


@pytest.mark.parametrize("hot, hot_texts", [(1 << 19, 4096), (50, 2), (0, 0)])
def test_equals_the_libraries(spark, documents, plain, hot, hot_texts):
    odd = ["a  b\n\n c\t\td   e\n", "<|endoftext|>x <s> </s> <unk>", "don't we'll I'M", "日本語 テスト　です", "emoji 👩‍👩‍👧 x", "a\x1cb \x85 c",
           "  lead", "trail  ", "\n\nx", "under▁score ▁", "<0x41> x", "ﬁne ①", "\x00 zero", " "]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(odd)] + [(700 + i, "the same text") for i in range(30)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more).selectExpr("*", "1 AS pair", "2 AS copies", "3 AS digest", "4 AS n_a", "5 AS `key`", "6 AS best")
    got = token_align.align_tokenizers(docs, *PATHS, hot=hot, hot_texts=max(1, hot_texts))
    assert got.columns == ["doc_id", *token_align.MEASURES, "groups_sha256"]
    got = Counter(tuple(r) for r in got.collect())
    assert got == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()], plain)
    assert got[(509, 0, 0, 0, 0, 0, 0, "")] == 1


def test_empty_table(no_documents):
    assert token_align.align_tokenizers(no_documents, *PATHS).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  'sdtre.,!?aZé9½ª<|>_-"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
def test_parts_keep_tokens(two, plain, text):
    want = plain_links(text, plain)
    parts = two.parts(text)
    assert "".join(parts) == " " + text
    got = two.align(parts)
    if want is None:
        assert None in got
    else:
        assert ";".join(x[4] for x in got) == ";".join(want[3])
        pairs = [p for x in got for p in memoryview(x[5]).cast("q")]
        assert [(p >> 32, p & 0xFFFFFFFF) for p in pairs] == want[2]
        assert [sum(x[i] for x in got) for i in range(4)] == [len(want[0]), len(want[1]), len(want[3]), len(want[2])]


@pytest.mark.parametrize("entries, size", [(10, 10**9), (10**9, 3000)])
def test_memory_of_parts_is_bounded(monkeypatch, entries, size):
    monkeypatch.setattr(token_align, "_CACHE", entries)
    monkeypatch.setattr(token_align, "_CACHE_BYTES", size)
    aligner, want, got = token_align.Aligner(*PATHS), Counter(), Counter()
    for i in range(0, 200, 4):
        parts = [f" w{j}" for j in range(i, i + 6)] + [" often", " often"] + [" " + "x" * i]
        slots = aligner.slots(parts)
        for p, k in zip(parts, slots.tolist(), strict=True):
            alone = aligner.two.align([p])[0]
            assert (tuple(aligner.counts[k]), aligner.text[k], aligner.pairs[k]) == (alone[:4], *alone[4:])
            for pair in memoryview(alone[5]).cast("q"):
                want[pair] += i + 1
        np.add.at(aligner.times, slots, i + 1)
        if aligner.full():
            got.update(dict(zip(*(x.tolist() for x in aligner.counted()), strict=True)))
            aligner.forget()
            assert not aligner.full() and " often" in aligner.slot
            assert {p: aligner.two.align([p])[0][4] for p in aligner.slot} == {p: aligner.text[k] for p, k in aligner.slot.items()}
    got.update(dict(zip(*(x.tolist() for x in aligner.counted()), strict=True)))
    assert got == want and not len(aligner.counted()[0])


@pytest.mark.parametrize("entries", [40, 400_000])
def test_small_memory_gives_the_same_rows(spark, documents, plain, entries, monkeypatch):
    monkeypatch.setattr(token_align, "_CACHE", entries)
    docs = documents.filter("doc_id < 20").select("doc_id", "text")
    aligner = token_align.Aligner(*PATHS)
    monkeypatch.setattr(token_align, "_aligner", lambda *paths: aligner)
    got = Counter(tuple(r) for r in token_align.align_tokenizers(docs, *PATHS, hot=30).collect())
    assert got == plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()], plain)
