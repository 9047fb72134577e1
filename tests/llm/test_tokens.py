import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwise.llm import tokens as K

RANKS = K.rank_file()
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoding():
    return K.build_encoding(open(RANKS, "rb").read())


TEXTS = {1: None, 2: "", 3: " ", 4: "Hello  world", 5: "<|endoftext|> it's 12a", 6: "返金が🙂 é é \r\n\t", 7: "\x00￿", 8: "x" * 3000, 9: "Hello  world"}


def test_ids_are_those_of_the_public_library(spark, encoding):
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(K.DEFAULT_FOLDER, "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no json vocabulary")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    df = spark.createDataFrame([(k, v, [9]) for k, v in TEXTS.items()], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in K.encode(df, "doc_id", "text").collect()}
    assert got == {k: other.encode(v or "", add_special_tokens=False).ids for k, v in TEXTS.items()}
    assert {r.doc_id: r.n_tokens for r in K.count(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}


def test_round_trip(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "k int, text string")
    back = {r.k: (bytes(r.raw), r.text) for r in K.decode(K.encode(df, "k", "text"), "k", "ids").collect()}
    assert back == {k: ((v or "").encode(), v or "") for k, v in TEXTS.items()}
    odd = spark.createDataFrame([(1, None), (2, [99999999]), (3, [170])], "k int, ids array<int>")
    assert {r.k: (r.raw is None, r.text) for r in K.decode(odd, "k", "ids").collect()} == {1: (True, None), 2: (True, None), 3: (False, None)}
    assert K.encode(df.limit(0), "k", "text").count() == 0


ALPHABET = "ab1 .'\n\té返🙂 " + "日s"


@given(st.text(alphabet=ALPHABET, max_size=120), st.integers(1, 12))
@settings(max_examples=400, deadline=None)
def test_parts_encode_to_the_same_ids(text, size):
    enc = K.build_encoding(open(RANKS, "rb").read())
    parts = list(K.safe_parts(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_very_long_texts(encoding):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["don't", "x1y2", "返金", "a" * 50, "\n\n", "  "]) for _ in range(60_000))
    assert K.encode_text(encoding, text) == encoding.encode_ordinary(text)
    assert encoding.decode(K.encode_text(encoding, "z" * 70_000)) == "z" * 70_000
