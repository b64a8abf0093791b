import random
import string
from pathlib import Path

import pytest

from skylathe.llm import tokenizer as T
from skylathe.llm.tokenizer import Encoder, token_counts, token_ids

HERE = Path(T.TOKENIZERS)
pytestmark = pytest.mark.skipif(not (HERE / T.VOCABULARY).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return Encoder((HERE / T.VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(HERE / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rnd = random.Random(1)
    out = ["", " ", "a", "<|endoftext|> hi", "a" * 4000, " " * 300, "\n\n\t x\r\n", "日本語テキスト" * 20, "🔧✅🛩️", "Ünïcödé ßẞ", "don't I'LL we've", "1234567.89"]
    out += ["".join(rnd.choice(string.printable + "äöü€日") for _ in range(rnd.randint(1, 200))) for _ in range(500)]
    return out + ["".join(rnd.choice("abcent ") for _ in range(rnd.randint(1, 300))) for _ in range(500)]


def test_same_ids_as_the_public_library(encoder, reference):
    t = texts()
    assert encoder.encode_batch(t) == reference(t)


def test_small_tries_give_the_same(encoder, reference):
    e = Encoder((HERE / T.VOCABULARY).read_bytes())
    e.limit = 100
    t = texts()[:200]
    assert [e.encode_batch([x])[0] for x in t] == reference(t)


def test_bytes_round_trip(encoder):
    for t in texts():
        assert b"".join(encoder.vocabulary.bytes[i] for i in encoder.encode_batch([t])[0]) == t.encode()


def test_frames(spark):
    df = spark.createDataFrame([(1, "gasket", "k"), (2, None, "k"), (3, "", "k"), (1, "gasket", "k")], "doc_id bigint, text string, key string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in token_ids(df).collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])]
    assert token_ids(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert counts == {1: len(got[0][1]), 2: 0, 3: 0}
    assert token_ids(df.limit(0)).count() == 0
