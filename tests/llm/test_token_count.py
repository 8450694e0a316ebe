from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandspark.llm import token_count

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pre():
    return token_count.PreTokens(PATH)


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_equals_the_library(spark, documents, library, hot):
    odd = ["a  b\n\n c\t\td   e", "<|endoftext|>x <|endoftext|>", "don't we'll I'M", "日本語 テスト　です", "emoji 👩‍👩‍👧 x", "a\x1cb \x85 c", "  lead", "trail  "]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more).selectExpr("*", "1 AS token", "2 AS pieces", "3 AS n_tokens")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(docs, PATH, hot=hot).collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), size(library, r["text"])) for r in docs.collect())


def test_empty_table(no_documents):
    assert token_count.count_tokens(no_documents, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  'sdtre.,!?aZé9½ª<|>_-"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_keep_pre_tokens(library, pre, text):
    parts = pre.frequencies(Counter(pre.units(text)))
    assert sum(size(library, p) * n for p, n in parts.items()) == size(library, text)
