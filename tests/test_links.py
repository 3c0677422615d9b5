"""Similarity joins, ranges, duplicates, graphs and entity links against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliolake.functions.similarity import indel, lcs_length, token_sort_ratio
from foliolake.operators import dedup, entities, graph, ranges
from foliolake.operators.similar import similar_pairs


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def strings(seed, n):
    rng, base, out = random.Random(seed), ["annual report of the board", "memo", "wire transfer log 2014", "ñandú día", "x"], set()
    while len(out) < n:
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            p = rng.randint(0, len(s))
            if rng.random() < 0.5:
                s.insert(p, rng.choice("abc 1é"))
            elif s and p < len(s):
                s.pop(p)
        if s:
            out.add("".join(s))
    return sorted(out)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = {}
    for i in ids:
        out.setdefault(find(i), set()).add(i)
    return {frozenset(s) for s in out.values()}


def test_lcs_and_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == lcs_table(a, b)
    assert indel("", "") == 1.0 and indel("abc", "abd") == pytest.approx(4 / 6)


def test_token_sort_ratio(spark):
    df = spark.createDataFrame([("lee  ann", "ann lee"), ("jon smith", "john smith")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(token_sort_ratio("a", "b")).collect()] == [1.0, round(2 * 9 / 19, 4)]


@pytest.mark.parametrize("t", [0.75, 0.85, 0.9, 1.0])
def test_similar_pairs_is_exact(spark, t):
    values = strings(3, 150)
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    got = {(r[0], r[1]) for r in similar_pairs(df, df, threshold=t, ordered=True).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if indel(values[i], values[j]) >= t}


def test_similar_pairs_refuses_low_thresholds(spark):
    df = spark.createDataFrame([(1, "a")], "id int, value string")
    with pytest.raises(ValueError):
        similar_pairs(df, df, threshold=0.5)


def test_title_links_equal_brute_force(spark):
    titles = strings(11, 90) + ["Memo", "memo ", "DOC-00123", "ABC123", "abcdef", "abcdefg", "abcdefgh", "abcdexgh"] + ["annual report of the board"] * 3
    recs = [(i, t, None, None) for i, t in enumerate(titles)]
    df = spark.createDataFrame(recs, "id int, title string, number_range string, content_hash string")
    got = {(r["id_1"], r["id_2"]): r["score"] for r in dedup.title_links(df).collect()}
    import re

    kept = {i: t.strip().lower() for i, t in enumerate(titles) if t.strip() and not re.match(r"^[A-Za-z]{1,10}[-_]?\d{3,}$", t.strip())}
    rep = {}
    for i in sorted(kept):
        rep.setdefault(kept[i], i)
    want = {(rep[t], i): 1.0 for i, t in kept.items() if rep[t] != i}
    for i, j in itertools.combinations(sorted(rep.values()), 2):
        if indel(kept[i], kept[j]) >= 0.9:
            want[i, j] = round(indel(kept[i], kept[j]), 4)
    assert got == want


def test_titles_meet_whatever_they_begin_with(spark):
    rest = "on the annual budget of the northern district and its many offices"
    heading = "minutes of the board of the northern district, sitting in public: "
    rows = [(1, f"a report {rest}"), (2, f"the report {rest}"), (3, heading + "money spent on roads and bridges in the past year"),
            (4, heading + "whether schools shall open again before the winter ends")]
    got = [tuple(r) for r in dedup.title_links(spark.createDataFrame(rows, "id int, title string")).collect()]
    assert got == [(1, 2, round(indel(rows[0][1], rows[1][1]), 4))]


def test_whole_first_line_is_the_title(spark):
    from foliolake.functions.text import first_line_title
    line = "x" * 500
    df = spark.createDataFrame([(line + "\nsecond",), (line,), ("",), ("\nrest",), (None,)], "text string")
    assert [r[0] for r in df.select(first_line_title("text")).collect()] == [line, line, "", "", None]


@pytest.mark.parametrize("t", [0.7, 0.85, 0.9])
def test_similar_pairs_of_long_and_short_values(spark, t):
    rng = random.Random(int(t * 100))
    values = set()
    for n in (1, 2, 3, 5, 9, 14, 20, 30, 34, 45, 80, 150, 260):
        for _ in range(3):
            base = "".join(rng.choice("abcdefghij é😀") for _ in range(n))
            values.add(base)
            for _ in range(4):
                other = list(base)
                for _ in range(rng.randint(1, max(1, n // 4))):
                    if rng.random() < 0.5 and other:
                        other.pop(rng.randrange(len(other)))
                    else:
                        other.insert(rng.randint(0, len(other)), rng.choice("abxyz "))
                values.add("".join(other))
    values = sorted(v for v in values if v)
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    got = {(r[0], r[1]) for r in similar_pairs(df, df, threshold=t, ordered=True).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if indel(values[i], values[j]) >= t}


def test_few_candidates_among_names(spark):
    from foliolake.operators.similar import candidates
    rng = random.Random(3)
    part = ["".join(rng.choice(c) for c in ("bcdfghjklmnprstvwz", "aeiou") * 3) for _ in range(300)]
    values = sorted({f"{rng.choice(part)} {rng.choice(part)}" for _ in range(1200)})
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    # measured: 2,339 of 713,415 pairs at either ratio
    for t in (0.85, 0.9):
        assert candidates(df, df, threshold=t, ordered=True).count() <= 0.005 * len(values) ** 2 / 2


def test_title_links_do_not_depend_on_other_titles(spark):
    pair = [(1, "report on the annual budget of the northern office"), (2, "report on the annual budgets of the northern office")]
    crowd = [(i, f"report number {i} of another {i % 7} kind") for i in range(10, 610)]
    schema = "id int, title string"
    alone, among = (dedup.title_links(spark.createDataFrame(rows, schema)) for rows in (pair, pair + crowd))
    assert [tuple(r) for r in alone.collect()] == [tuple(r) for r in among.filter("id_1 = 1").collect()] != []


def test_star_of_one_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("content_hash"))
    links = dedup.hash_links(df)
    # id 0 has the hot value too
    assert links.count() == 2700 and links.filter("id_1 = 0").select("id_2").distinct().count() == 2700


def test_ranges(spark):
    rng, data = random.Random(5), []
    for i in range(150):
        p, lo = rng.choice(["AB", "Z"]), rng.choice([5, rng.randint(0, 3_000_000), 1_048_570])
        data.append((i, p, lo, lo + rng.choice([0, 1, 10, 50_000, 2_000_000])))
    df = spark.createDataFrame(data, "doc_id int, prefix string, lo long, hi long")
    overlap = {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    links = {(r[0], r[1]) for r in ranges.overlap_links(df).select("id_1", "id_2").collect()}
    assert links <= overlap and len(links) < len(data)
    assert components(range(150), links) == components(range(150), overlap)
    counts = {r[0]: r[1] for r in ranges.overlap_counts(df).collect()}
    assert counts == {i: sum(i in p for p in overlap) for i in range(150)}
    chosen = df.filter("doc_id % 10 = 0")
    got = {tuple(r) for r in ranges.overlaps_of(df, chosen).collect()}
    assert got == {(a, b) for x, y in overlap for a, b in ((x, y), (y, x)) if a % 10 == 0}


@pytest.mark.parametrize("text, want", [
    ("AB00010-AB00013", ("AB", 10, 13)), ("AB13-AB10", ("AB", 10, 13)), ("AB7", ("AB", 7, 7)), ("AB1-CD2", None), ("ab1-ab2", None), ("", None),
    (" AB1 - AB3 ", ("AB", 1, 3)), ("AB1-x-AB9", ("AB", 1, 9)), ("12-13", None), (None, None),
])
def test_parse_range(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(ranges.parse_range("t")).collect()[0][0]
    assert (tuple(got) if got else None) == want


def test_hash_links_are_a_star_even_for_a_hot_group(spark):
    recs = [(i, "t", None, "h" if i % 3 else f"u{i}") for i in range(300)]
    df = spark.createDataFrame(recs, "id int, title string, number_range string, content_hash string")
    got = {(r["id_1"], r["id_2"]) for r in dedup.hash_links(df).collect()}
    hot = [i for i in range(300) if i % 3]
    assert got == {(hot[0], i) for i in hot[1:]}


def test_duplicate_links_precedence(spark):
    recs = [(1, "wire transfer log", "A1-A5", "h"), (2, "wire transfer log", "A2-A9", "h"), (3, "wire transfer lag", "A4", None), (4, "Other", "A6", None)]
    df = spark.createDataFrame(recs, "id int, title string, number_range string, content_hash string")
    got = {(r["id_1"], r["id_2"]): (r["signal"], r["score"]) for r in dedup.duplicate_links(df).collect()}
    assert got[1, 2] == (1, 1.0) and all(s in (2, 3) for p, (s, _) in got.items() if p != (1, 2))
    assert components([1, 2, 3, 4], got) == {frozenset([1, 2, 3, 4])}


@pytest.mark.parametrize("slice_rows", [2000, 3, 1])
def test_weighted_pairs_with_hot_group(spark, slice_rows):
    rng = random.Random(2)
    counts = {(0, i): rng.randint(1, 4) for i in range(25)} | {(g, rng.randint(0, 9)): rng.randint(1, 3) for g in range(1, 30) for _ in range(4)}
    df = spark.createDataFrame([(g, i, n) for (g, i), n in counts.items()], "g int, i int, n int")
    want = {}
    for (g, a), n in counts.items():
        for (h, b), m in counts.items():
            if g == h and a < b:
                want[a, b] = want.get((a, b), 0) + n * m
    got = graph.weighted_pairs(df, "g", "i", "n", slice_rows=slice_rows)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_mention_edges_equal_naive_pairing(spark):
    rng, rows = random.Random(4), []
    for d in range(20):
        rows += [(d, rng.choice(["PERSON", "ORG", "GPE"]), rng.choice(["Ann Lee", "ann lee", "Bo", "Acme", "Zed Co", f"Solo {d}", "a/b x"])) for _ in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, entity_type string, text string")
    keep = [(d, f"{t}:{x.lower()}") for d, t, x in rows if t != "GPE" and len(x) >= 3 and "/" not in x]
    want = {}
    for (d, a), (e, b) in itertools.product(keep, keep):
        if d == e and a < b:
            want[a, b] = want.get((a, b), 0) + 1
    got = {(r[0], r[1]): r[2] for r in graph.mention_edges(df).collect()}
    assert got == {p: w for p, w in want.items() if w >= 3}


def test_edges_after_limit(spark):
    edges = spark.createDataFrame([("a", "b", 9), ("a", "c", 8), ("b", "c", 7)], "source string, target string, weight int")
    nodes = spark.createDataFrame([("b",), ("c",)], "id string")
    assert graph.between(graph.top_edges(edges, 2), nodes).count() == 0 and graph.between(edges, nodes).count() == 1


NAMES = [("p1", "Ann Lee", ["A. Lee", "Lee Ann-Marie"], 0), ("p2", "Robert  Smith", [], 1), ("p3", "Jon", ["ann lee"], 2), ("p4", "Li", [], 3)]


def registry(spark):
    return entities.registry_names(spark.createDataFrame(NAMES, "person_id string, name string, aliases array<string>, ord long"))


def test_registry_last_entry_wins(spark):
    got = {r["name_key"]: (r["person_id"], r["is_alias"]) for r in registry(spark).collect()}
    assert got["ann lee"] == ("p3", True) and got["robert smith"] == ("p2", False) and got["a. lee"] == ("p1", True)


def test_fuzzy_links_equal_brute_force(spark):
    names = {r["name_key"]: (r["person_id"], tuple(r["first_at"])) for r in registry(spark).collect()}
    mentions = ["ANN  LEE", "Smith Robert", "Robert Smyth", "Rob Smith", "Robrt Smith", "A Lee", "zzz", "Jonn", "lee ann marie", "jo", "Li", "Lu"]
    df = spark.createDataFrame(list(enumerate(mentions)), "doc_id int, text string")

    def best(m, t):
        key = " ".join(m.lower().split())
        if key in names:
            return names[key][0]
        srt = " ".join(sorted(key.split()))
        scored = sorted((-indel(srt, " ".join(sorted(n.split()))), at, pid) for n, (pid, at) in names.items())
        return scored[0][2] if -scored[0][0] >= t else None

    got = {r["doc_id"]: r["person_id"] for r in entities.link_persons(df, registry(spark)).collect()}
    assert got == {i: best(m, 0.85) for i, m in enumerate(mentions)}


def test_match_confidence_tiers(spark):
    df = spark.createDataFrame([(1, "Robert Smith"), (2, "A. Lee"), (3, "Roberts Smith"), (4, "nobody"), (5, "Li")], "doc_id int, text string")
    got = {r["doc_id"]: (r["confidence"], r["match_type"]) for r in entities.score_mentions(df, registry(spark)).collect()}
    assert got == {1: (1.0, "exact"), 2: (0.95, "alias"), 3: (0.85, "fuzzy")}


def test_direct_scan(spark):
    docs = spark.createDataFrame([(1, "We met ROBERT SMITH and Jonah."), (2, "Li and lee ann-marieX"), (3, None), (4, "rob ann leexy")], "doc_id int, text string")
    names = registry(spark)
    got = {(r[0], r[2]) for r in entities.direct_scan(docs, names).collect()}
    keys = [r["name_key"] for r in names.collect() if len(r["name_key"]) >= 3]
    texts = {1: "we met robert smith and jonah.", 2: "li and lee ann-mariex", 4: "rob ann leexy"}
    assert got == {(d, k) for d, t in texts.items() for k in keys if k in t}


def test_direct_scan_does_not_carry_texts(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = entities.direct_scan(docs, registry(spark))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.split("\n") if "Generate explode(array_distinct(regexp_extract_all(_low" in line]
    # the list behind the generator names the input columns that are dropped: the second is the text
    assert len(made) == 2 and all("), [1], false, [piece" in line for line in made)


def test_link_confidence_caps_at_one(spark):
    every = {k: F.lit(True) for k in ["ner_match", "direct_scan", "title_mention", "bates_match", "metadata_match"]}
    row = spark.range(1).select(entities.link_confidence(every), entities.link_confidence({"bates_match": F.lit(True), "x": F.lit(True)})).collect()[0]
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(0.15)


def test_tagger_slices_long_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 7)], "doc_id int, text string")

    def load():
        return lambda texts: [[("PERSON", t, 0, len(t))] for t in texts]

    got = sorted(r["text"] for r in entities.tagged_entities(docs, load, slice_chars=5).collect())
    assert "".join(got) and sum(map(len, got)) == 14 and len(got) == 3
