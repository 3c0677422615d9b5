"""Near-duplicates, components and vectors against all-pairs brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from foliolake.llm import lsh, simhash, stages
from foliolake.llm.groups import Union, components

from .conftest import AWKWARD, SF, texts_of


def clusters(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_union_finds_lowest():
    union = Union(6)
    union.link(np.array([5, 3, 1]), np.array([3, 4, 0]))
    assert union.all_roots().tolist() == [0, 0, 2, 3, 3, 3]


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(49, i) for i in range(49)],
    [(1, 2), (2, 1), (3, 3), (5, 4), (4, 6), (8, 7)], [],
])
def test_components(spark, links):
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == clusters({i for link in real for i in link}, real)


def plain_fingerprint(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [40, 131_072])
def test_simhash_query(spark, docs, monkeypatch, block):
    from foliolake.llm.queries import queries
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries()["op5_simhash"](spark, SF).collect()}
    prints = {k: plain_fingerprint(t, 4) for k, t in texts_of(docs).items()}
    ids = sorted(prints)
    want = clusters(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in ids}


def test_simhash_awkward_rows(spark, awkward):
    found = simhash.near_duplicates(simhash.fingerprints(awkward, words=4), radius=4, similarity=None)
    rows = Counter(tuple(r) for r in found.collect())
    assert sum(rows.values()) == len(AWKWARD)
    by_id = {r[0]: r for r in rows}
    assert by_id[9][2] == 1 and rows[by_id[1]] == 2  # equal texts, and a repeated row
    assert by_id[2][1:] == (0, 2) and by_id[3][1:] == (0, 2) and by_id[4][1:] == (0, 2)  # no words: one class
    assert simhash.near_duplicates(simhash.fingerprints(awkward.limit(0), sketches=True)).count() == 0


def test_stage_keeps_one_of_each(spark, docs):
    kept = {r["doc_id"] for r in stages.one_of_each(docs).collect()}
    texts = texts_of(docs)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: shingles(t) for k, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    for k in texts:
        best = max((alike(k, o) for o in texts if o != k), default=0)
        if k not in kept:
            assert best > 0.6  # sketches estimate the similarity
        elif best < 0.5:
            assert k in kept
    by_text = {}
    for k, t in texts.items():
        by_text.setdefault(t, []).append(k)
    for same in by_text.values():
        assert len(kept & set(same)) <= 1


def test_stage_keeps_clashing_columns_and_repeats_once(spark, awkward):
    kept = stages.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[9] == 0 and ids[None] == 2


@pytest.mark.parametrize("tile", [16, 1024])
def test_vectors_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(lsh, "TILE", tile)
    draw = np.random.default_rng(4)
    base = draw.standard_normal((30, 16))
    rows = []
    for i in range(300):
        v = base[i % 30] + draw.standard_normal(16) * draw.choice([0.0, 0.15, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None, 1.0], 1), (904, rows[0][1], None), (905, [], 1),
           (906, rows[0][1][:8], 0), (None, rows[0][1], 0), (907, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as rep", "3 as v")
    got = {r["vec_id"]: tuple(r)[1:] for r in lsh.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = [(a, b) for a, _, la in rows for b, _, lb in rows if a < b and la == lb and unit[a] @ unit[b] >= 0.93]
    degree, want = Counter(i for link in links for i in link), clusters(list(unit), links)
    found = sum(got[i][0] for i in unit)
    assert found >= 0.99 * sum(degree.values())
    assert all(got[i][0] <= degree[i] for i in unit)
    if found == sum(degree.values()):
        assert all(got[i] == (degree[i], want[i], want[i] == i) for i in unit)
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903, 904, 905, 906, 907)) and got[None] == (0, None, True)


def test_vector_query(spark):
    from foliolake.llm.queries import queries
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r["vec_id"]: r["n_links"] for r in queries()["op2_vector_dedup"](spark, SF).collect()}
    unit = {r["vec_id"]: (r["label"], np.array(r["embedding"], float) / np.linalg.norm(r["embedding"])) for r in rows}
    want = {a: sum(1 for b in unit if b != a and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.93) for a in unit}
    assert got == want
    assert lsh.near_vectors(spark.read.parquet(f"{SF}/embeddings.parquet").limit(0)).count() == 0


def words_of(draw, n):
    return [f"w{i}" for i in draw.integers(0, 10 ** 9, n)]


def shingle_set(words):
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("group", [3, 256])
def test_stage_counts_shingles_at_the_threshold(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    draw = np.random.default_rng(8)
    rows, sets, near, links = [], {}, Counter(), []
    for i in range(0, 600, 2):
        one = words_of(draw, int(draw.integers(60, 600)))
        other = list(one)
        for _ in range(len(one) // 50 + int(draw.integers(0, 3))):
            other[int(draw.integers(0, len(one)))] = f"new{draw.integers(0, 10 ** 9)}"
        sets[i], sets[i + 1] = shingle_set(one), shingle_set(other)
        rows += [(i, " ".join(one)), (i + 1, " ".join(other))]
        alike = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        near["at" if 0.8 <= alike < 0.85 else "below" if 0.7 <= alike < 0.8 else "else"] += 1
        if alike >= 0.8:
            links.append((i, i + 1))
    # a chain whose neighbours are alike and whose ends are not, and one group of many near copies of one text
    chain = words_of(draw, 200)
    for i in range(1000, 1006):
        chain = chain[:(i - 1000) * 15] + words_of(draw, 8) + chain[(i - 1000) * 15 + 8:]
        sets[i] = shingle_set(chain)
        rows.append((i, " ".join(chain)))
    base = words_of(draw, 100)
    for i in range(2000, 2020):
        copy = base[:5 * (i - 2000)] + [f"own{i}"] * (i % 3) + base[5 * (i - 2000) + i % 3:]
        sets[i] = shingle_set(copy)
        rows.append((i, " ".join(copy)))
    late = [i for i in sets if i >= 1000]
    links += [(a, b) for a in late for b in late if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert near["at"] >= 30 and near["below"] >= 30
    want = clusters(list(sets), links)
    kept = {r["doc_id"] for r in stages.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in sets if want[i] == i}
