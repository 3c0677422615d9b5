"""SentencePiece codec against the public library."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from foliolake.llm import sentence_pieces

from .conftest import AWKWARD, SF, texts_of

MODEL = P.path("piece_bpe_32k.model")
ALPHABETS = ["ab", "aAbB \n\t1.'s", "aé ñ　\x1c\x85\xa0 中文😀１²½ǅΣ▁", "  ▁ a", ["</s>", "<0x41>", " ", "▁▁", "a", "\r", ";"]]


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.PieceCodec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made_up(seed, codec):
    draw = random.Random(seed)
    pieces = [p.replace("▁", " ") for p in codec.vocabulary.symbols]
    texts = ["".join(draw.choice(a) for _ in range(draw.randint(0, 120))) for a in ALPHABETS for _ in range(60)]
    return texts + ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 12))) for _ in range(600)]


def test_equals_the_library(codec, library):
    for text in made_up(1, codec):
        packed = codec.encode(text)
        assert list(sentence_pieces.unpack(packed)) == library.encode(text)
        assert codec.decode(packed) == library.decode(library.encode(text))


def test_whole_texts_as_one_unit(codec, library):
    # cutting a text into units is a shortcut only
    for text in made_up(2, codec)[::5]:
        if text:
            assert codec.units.encode("▁" + text.replace(" ", "▁")) == library.encode(text)


def test_decodes_any_ids(codec, library):
    draw = random.Random(3)
    for _ in range(1500):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(3, 32_000)]) for _ in range(draw.randint(0, 12))]
        assert codec.decode(sentence_pieces.pack(ids)) == library.decode(ids)


def test_table_holds_the_last_token_of_every_prefix(codec, library):
    unit = "▁internationalisierung"
    last = codec.units.last_tokens(unit)
    assert [codec.vocabulary.id_of[s] for s in last] == [library.encode(unit[1:n])[-1] if n > 1 else library.piece_to_id("▁")
                                                         for n in range(1, len(unit) + 1)]


def test_long_text_without_blanks(codec, library):
    text = "ab" * 50_000 + "é" * 20_000
    assert list(sentence_pieces.unpack(codec.encode(text))) == library.encode(text)


def test_cache_is_bounded(library):
    small = sentence_pieces.PieceCodec(MODEL, cache_units=10)
    for text in made_up(4, small)[:100]:
        assert list(sentence_pieces.unpack(small.encode(text))) == library.encode(text)
        assert len(small.units) <= 10 and len(small.units.older) <= 10


def test_query(spark, docs, library):
    from foliolake.llm.queries import queries
    got = {r["doc_id"]: r for r in queries()["op11_sentence_pieces"](spark, SF).collect()}
    texts = texts_of(docs)
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = library.encode(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(got[key])[1:] == want


def test_awkward_rows(spark, awkward, library):
    coded = sentence_pieces.encode(awkward, path=MODEL)
    assert coded.columns == ["doc_id", "token_ids"]
    want = sorted((str(k), sentence_pieces.pack(library.encode(t or ""))) for k, t, _ in AWKWARD)
    assert sorted((str(r[0]), bytes(r[1])) for r in coded.collect()) == want
    back = sentence_pieces.decode(coded, path=MODEL).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(k), t or "") for k, t, _ in AWKWARD)
    assert sentence_pieces.round_trip(awkward.limit(0), path=MODEL).count() == 0
