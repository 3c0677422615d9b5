"""Token operators against the public libraries they must agree with."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from foliolake.llm import bpe, token_counts

from .conftest import AWKWARD, SF, texts_of

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ALPHABETS = ["ab", "aAbB \n\t1.'s", "aé ñ　\x1c\x85\xa0 中文😀１²½ǅΣ", ["a", "<|endoftext|>", "<|", "|>", " ", "É", "'LL"]]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def made_up(seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(a) for _ in range(draw.randint(0, 200))) for a in ALPHABETS for _ in range(60)]


def test_bpe_equals_the_library(codec, library):
    texts = made_up(1)
    assert codec.encode(texts) == [bpe.pack(library.encode_ordinary(t)) for t in texts]


def test_both_merges_agree(codec):
    draw = random.Random(2)
    pieces = ["".join(draw.choice("abcdeth ") for _ in range(draw.randint(1, 60))).encode() for _ in range(500)]
    assert codec.pieces.merges.encode(pieces) == [bpe.pack(bpe.merge_piece(p, codec.ranks)) for p in pieces]


def test_long_piece(codec, library):
    text = "ab" * 10_000
    assert codec.encode([text]) == [bpe.pack(library.encode_ordinary(text))]


def test_cache_is_bounded():
    small = bpe.Codec(RANKS, P.PATTERN, cache_pieces=10)
    texts = made_up(3)
    first = small.encode(texts)
    assert small.encode(texts) == first
    assert len(small.pieces.older) < 10 * len(texts)


def test_bpe_query(spark, docs, library):
    from foliolake.llm.queries import queries
    got = {r["doc_id"]: r for r in queries()["op3_bpe_codec"](spark, SF).collect()}
    for key, text in texts_of(docs).items():
        packed = bpe.pack(library.encode_ordinary(text or ""))
        want = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert tuple(got[key])[1:] == want


def test_bpe_awkward_rows(spark, awkward, library):
    coded = bpe.encode(awkward, path=RANKS, pattern=P.PATTERN)
    assert coded.columns == ["doc_id", "token_ids"]
    got = sorted((str(r[0]), bytes(r[1])) for r in coded.collect())
    assert got == sorted((str(k), bpe.pack(library.encode_ordinary(t or ""))) for k, t, _ in AWKWARD)
    back = bpe.decode(coded, path=RANKS, pattern=P.PATTERN).collect()
    assert sorted((str(r[0]), bytes(r[1])) for r in back) == sorted((str(k), (t or "").encode()) for k, t, _ in AWKWARD)
    assert bpe.round_trip(awkward.limit(0), path=RANKS, pattern=P.PATTERN).count() == 0


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(WORDS), token_counts.TextCounter(WORDS, {})
    texts = made_up(4)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_do_not_depend_on_the_table(spark, awkward):
    library = Tokenizer.from_file(WORDS)
    want = sorted((str(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in AWKWARD)
    for entries in (0, 3, 1000):
        got = token_counts.count_tokens(awkward, path=WORDS, entries=entries, sample_texts=5, limit=100).collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(awkward.limit(0), path=WORDS).count() == 0


def test_counts_query(spark, docs):
    from foliolake.llm.queries import queries
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r["n_tokens"] for r in queries()["op9_token_counts"](spark, SF).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in texts_of(docs).items()}
