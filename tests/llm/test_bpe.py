import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "'ll", "1", "23", "!!", "<|endoftext|>", " ", "x" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    vocabulary = bpe.vocabulary_of(PATH)
    pieces = list(bpe.encode(vocabulary, text))
    want = library.encode(text, add_special_tokens=False).ids
    assert [i for p in pieces for i in memoryview(p).cast("I")] == want
    assert "".join(bpe.decode(vocabulary, pieces)) == library.decode(want, skip_special_tokens=False)


def test_random_texts_match_the_library(library):
    rng = random.Random(5)
    for _ in range(300):
        same(library, "".join(rng.choices(PIECES, k=rng.randint(0, 60))))


def test_long_runs_stream_in_small_chunks(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    monkeypatch.setattr(bpe, "LONG", 20)
    bpe.vocabulary_of(PATH).words.clear()
    rng = random.Random(6)
    for _ in range(150):
        same(library, "".join(rng.choice(PIECES) * rng.choice([1, 1, 40, 100]) for _ in range(rng.randint(0, 12))))
    for unit in ("a", "ab", " ", "\n", " \n", "=-", "🙂"):
        for n in (63, 64, 65, 127, 129, 900):
            same(library, unit * n)
            same(library, "x" + unit * n + "y z")


def test_transducer_emits_before_the_end():
    vocabulary = bpe.vocabulary_of(PATH)
    stream = bpe.Transducer(vocabulary)
    early = sum(len(t) for _ in range(50) for t in stream.feed(b"etaoinshrdlu" * 100))
    assert early > 0 and len(stream.held) <= 6 * vocabulary.lookahead


def test_lookahead_of_a_chain():
    merges = [(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]
    assert bpe.sufficient_lookahead(merges) >= 4


def test_rows_nulls_and_repeats(spark, library):
    rows = [(1, "the cat"), (2, None), (3, ""), (4, "the cat"), (None, "x"), (5, "<|endoftext|>a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 AS n_tokens")
    out = {(r.doc_id): r for r in bpe.round_trip(df, PATH, keep_ids=True).collect()}
    assert len(out) == 6
    empty = hashlib.sha256(b"").hexdigest()
    for i in (2, 3):
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (0, empty, empty)
    assert out[1][1:] == out[4][1:]
    assert out[5].token_ids == library.encode("<|endoftext|>a", add_special_tokens=False).ids
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
