import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import tokens

WORDS = tokens.vocabulary()


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    got = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got.encode_special_tokens = True
    return lambda texts: [e.ids for e in got.encode_batch(texts, add_special_tokens=False)]


PARTS = ["'s", "'re", "'", "''", " ", "  ", "\n", "\t", " ", "a", "S", "re", "ve", "l", "1", "²", "é", "漢", "!", "-", "\r\n", "'ll", "'d", "<|endoftext|>", "　", "\U0001f9ec", "\x1c", "​", "é"]


def test_equals_the_library(library):
    rnd = random.Random(1)
    texts = ["", *("".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(5000))]
    assert tokens.encode(pa.array(texts), WORDS).to_pylist() == library(texts)


def test_long_runs(library):
    texts = ["ab" * 20_000, "=" * 30_000, "x " * 20_000, " " * 3000, "'" * 999]
    assert tokens.encode(pa.array(texts), WORDS).to_pylist() == library(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_decoding_gives_the_text_back(texts):
    ids, at = tokens.encode_with_offsets(pa.array(texts, pa.string()), WORDS)
    words = WORDS.words()
    for text, row, offsets in zip(texts, ids.to_pylist(), at.to_pylist()):
        data = text.encode()
        assert b"".join(words[i] for i in row) == data
        assert all(data[o : o + len(words[i])] == words[i] for i, o in zip(row, offsets))


def test_scan_is_independent_of_blocks():
    import numpy as np

    classes = np.random.default_rng(1).integers(0, 11, 5000).astype(np.uint8)
    assert (tokens.scan(classes, 7) == tokens.scan(classes, 256)).all()


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "hello world", 0), (2, "hello world", 0)], "doc_id bigint, text string, ids int")
    assert sorted(map(tuple, ((r["doc_id"], tuple(r["ids"])) for r in tokens.token_ids(df).collect()))) == [(1, ()), (2, ()), (2, (31373, 995)), (2, (31373, 995))]
    assert tokens.token_ids(df.limit(0)).count() == 0
    assert sorted(r["text"] for r in tokens.decode(tokens.token_ids(df)).collect()) == ["", "", "hello world", "hello world"]
    assert sorted(r["n_tokens"] for r in tokens.token_counts(df).collect()) == [0, 0, 2, 2]
