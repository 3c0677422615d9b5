"""Conversation trie against a plain dictionary of all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliolake.llm import prefix_trie

from .conftest import CLASH, SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = sorted(c for c in members[p] if len(rebuilt[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def plain(rows):
    """Rows ``(conv_id, turn, role, text)`` to the nodes; equal turns must hold equal rows."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return nodes_of(rebuilt)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark):
    from foliolake.llm.queries import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op13_prefix_trie"](spark, SF)
    assert set(COLUMNS) <= set(got.columns)
    assert rows_of(got) == plain(rows)


SHARED = [("user", "hello"), ("assistant", "hé 😀"), ("user", "x"), ("user", ""), ("tool", "x"), ("user", "xx"), ("user", "xxx")]


def branching():
    """Copies, sequences that end inside others, long shared fronts, a turnless conversation."""
    out = {c: SHARED[:c % 8] for c in range(40)}
    out |= {100 + c: [*SHARED[:5 + c % 2], ("user", str(c % 7)), ("user", str(c))] for c in range(60)}
    out |= {300 + c: SHARED for c in range(30)}
    out |= {400 + c: [("user", str(n)) for n in range(20)] + [("user", str(c))] * (c % 3) for c in range(12)}
    return out


@pytest.mark.parametrize("container", [1, 5, 4096])
def test_containers_do_not_change_the_nodes(spark, container):
    rebuilt = branching()
    rows = [(c, n, r, t) for c, turns in rebuilt.items() for n, (r, t) in enumerate(turns)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    empty = spark.createDataFrame([(c,) for c, turns in rebuilt.items() if not turns], "conv_id long")
    lists = lists.unionByName(empty.withColumn("turns", F.array().cast(lists.schema["turns"].dataType)))
    assert rows_of(prefix_trie.trie(lists, container=container)) == nodes_of(rebuilt)


def test_awkward_rows(spark):
    rows = [(0, 2, "user", "b"), (0, None, "user", "first"), (0, 1, None, None), (0, 3, "user", "é" * 50_000), (1, 0, "user", "own"), (2, 5, "user", "y"),
            (2, 5, "user", "y"), (7, 0, "", ""), (107, 0, "user", "no first of the family"), (107, 1, "a", "b"), (107, 2, "a", "c"), (None, 0, "user", "lost"),
            (3, 0, "a:", "b"), (3, 1, "a", ":b"), (12, 0, "user", "x"), *[(15, n, "user", str(n)) for n in range(9)]]
    names = [c for c in CLASH if c not in ("t", "k")] + ["digest", "path", "n", "key", "parent", "top", "turns", "_h"]
    df = spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows],
                               "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names))
    for container in (1, 4096):
        assert rows_of(prefix_trie.conversation_trie(df, container=container)) == plain(rows)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_order_of_equal_turns_is_fixed(spark):
    rows = [(0, 1, "user", t) for t in "abcdef"]
    schema = "conv_id long, turn long, role string, text string"
    a = prefix_trie.turn_lists(spark.createDataFrame(rows, schema)).collect()
    b = prefix_trie.turn_lists(spark.createDataFrame(rows[::-1], schema)).collect()
    assert a == b


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    ids = [*range(-3, 40), 100, 1000]
    members = spark.createDataFrame([(b"a", c) for c in ids] + [(b"b", 5)], "digest binary, conv_id long")
    got = {bytes(r[0]): r[1] for r in prefix_trie.id_digests(members).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}
