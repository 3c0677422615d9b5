"""Token alignment against the public libraries and a plain count of all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliolake.llm import alignment
from foliolake.llm.token_counts import byte_letters

from .conftest import AWKWARD, SF

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PATHS = {"path_a": JSON, "pattern_a": P.PATTERN, "path_b": MODEL}


class Plain:
    """Every link of every document, listed one by one."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
        self.a.encode_special_tokens = True
        self.byte_of = {c: b for b, c in byte_letters().items()}

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw_a = [bytes(self.byte_of[c] for c in self.a.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        at = dict(zip(cuts, range(len(cuts)), strict=True))
        out = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate([(a, ends_a), (b, ends_b)]):
            group = 0
            for i, e in zip(ids, ends, strict=True):
                out[group][side].append(i)
                group += e in at
        return out

    def rows(self, docs):
        """``[(key, text)]`` to the rows of ``link_counts``, as tuples led by the key as text."""
        grouped = [(k, self.groups(t)) for k, t in docs]
        links = [Counter((i, j) for a, b in g for i in a for j in b) for _, g in grouped]
        holds = Counter(p for c in links for p in c)
        best = defaultdict(int)
        for (i, _), n in holds.items():
            best[i] = max(best[i], n)
        out = []
        for (k, g), c in zip(grouped, links, strict=True):
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            out.append((str(k), sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                        sum(n for p, n in c.items() if holds[p] == best[p[0]]), sum(n * holds[p] for p, n in c.items()),
                        hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return sorted(out)


def rows_of(df):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in df.collect())


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_components_by_hand():
    a, b = alignment.components(np.array([2, 5, 6, 9]), np.array([3, 4, 6, 7, 8, 9]))
    assert a.tolist() == [0, 0, 0, 1] and b.tolist() == [0, 0, 0, 1, 1, 1]
    assert [x.tolist() for x in alignment.components(np.zeros(0, int), np.zeros(0, int))] == [[], []]


def test_a_long_component():
    # ends that never meet: one chain through all tokens
    a, b = np.arange(2, 200_001, 2), np.append(np.arange(1, 200_000, 2), 200_000)
    of_a, of_b = alignment.components(a, b)
    assert not of_a.any() and not of_b.any()


def test_pairs_of_a_wide_group_in_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    g = {"a": np.array([1, 2, 1, 3]), "b": np.array([5, 6, 5, 5, 9]), "group_a": np.array([0, 0, 0, 1]), "in_b": np.array([4, 1]),
         "doc_a": np.array([0, 0, 0, 0])}
    keys, times = alignment.Aligner.pairs(g)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == {
        1 << 16 | 5: 6, 1 << 16 | 6: 2, 2 << 16 | 5: 3, 2 << 16 | 6: 1, 3 << 16 | 9: 1}


def test_query(spark, docs, plain):
    from foliolake.llm.queries import queries
    assert rows_of(queries()["op12_alignment"](spark, SF)) == plain.rows([tuple(r) for r in docs.select("doc_id", "text").collect()])


def made_up():
    draw = random.Random(7)
    alphabets = ["abc ", "aé ñ　 中文😀１²½ǅΣ", ["the", " ", "ing", "\n", "1", "<|endoftext|>", "</s>"], " \n\t", "▁a"]
    return [(n, "".join(draw.choice(alphabets[n % 5]) for _ in range(draw.randint(0, 60)))) for n in range(200)]


@pytest.mark.parametrize("frequent", [0, 50, 10**6])
def test_tiers_agree(spark, plain, frequent):
    docs = made_up()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(alignment.link_counts(df, frequent=frequent, **PATHS)) == plain.rows(docs)


def test_awkward_rows(spark, awkward, plain):
    assert rows_of(alignment.link_counts(awkward, **PATHS)) == plain.rows([(k, t) for k, t, _ in AWKWARD])
    assert alignment.link_counts(awkward.limit(0), **PATHS).count() == 0


def test_aligned_tokens(spark, awkward, plain):
    got = alignment.align(awkward, **PATHS)
    assert got.columns == ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"]
    want = sorted((str(k), [a for a, _ in plain.groups(t)], [b for _, b in plain.groups(t)]) for k, t, _ in AWKWARD)

    def cut(ids, groups):
        out = defaultdict(list)
        for i, g in zip(ids, groups, strict=True):
            out[g].append(i)
        return [out[g] for g in sorted(out)]

    assert sorted((str(r[0]), cut(r["a_ids"], r["a_groups"]), cut(r["b_ids"], r["b_groups"])) for r in got.collect()) == want
