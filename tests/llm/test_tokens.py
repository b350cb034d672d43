import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from decistrata.llm import tokens  # noqa: E402

RANKS = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODER = tokens.Encoder(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    offsets, flat = ENCODER.encode([text])
    assert offsets.tolist() == [0, len(flat)]
    return flat.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_as_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert REFERENCE.decode(ids(text)) == text


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "<|endoftext|>", "it's 12 Ünïcode 中文 👍🏽", "a" * 3000, "ab" * 2000, "中" * 900, "lower" * 300, " " * 999, "\x1c\x1d x\x85y", "１２３ ²½"])
def test_cases(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_long_and_matrix_agree():
    rng = random.Random(2)
    for _ in range(60):
        piece = "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 300))).encode()
        assert ENCODER._long(piece) == ENCODER._matrix([piece])[0]


def test_many_at_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc de.\n12é中") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    offsets, flat = ENCODER.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [REFERENCE.encode_ordinary(t) for t in texts]


def test_table(spark):
    rows = [(1, "Stock is low."), (2, ""), (3, None), (4, "Stock is low."), (None, "x"), (4, "Stock is low."), (5, "y" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as pieces")
    got = [(r["doc_id"], r["ids"]) for r in tokens.token_ids(df, chars=10).collect()]
    assert sorted(got, key=str) == sorted([(d, REFERENCE.encode_ordinary(t or "")) for d, t in rows], key=str)
    assert tokens.token_ids(df.limit(0)).count() == 0
