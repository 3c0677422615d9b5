"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  A segment tree over the byte positions of the match
holds, for every pair of neighbouring live tokens, its rank and the byte where it begins; the root is the
leftmost pair of the lowest rank.  A merge changes at most three leaves, each in logarithmic time, so a
match of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Pieces a worker remembers in each of two generations.
CACHE_PIECES = 300_000

_NONE = 1 << 62
_POSITION = (1 << 32) - 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: always merge the leftmost neighbours of the lowest rank."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for at in range(size - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right

    def put(leaf: int, value: int) -> None:
        at = size + leaf
        tree[at] = value
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    end = list(range(1, n + 1))  # where the live token that begins here ends
    before = list(range(-1, n))  # where the live token in front begins
    while tree[1] < _NONE:
        i = tree[1] & _POSITION
        j = end[i]
        k = end[j]
        end[i] = k
        put(j, _NONE) if k < n else None
        rank = None
        if k < n:
            before[k] = i
            rank = get(piece[i:end[k]])
        put(i, _NONE if rank is None else rank << 32 | i)
        p = before[i]
        if p >= 0:
            rank = get(piece[p:k])
            put(p, _NONE if rank is None else rank << 32 | p)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class Merges:
    """The same merging for many short pieces at once: one segment tree per row of a matrix, updated in step."""

    #: Leaves of the trees that pieces are sorted into; longer pieces are merged one by one.
    LEAVES = (8, 16, 32)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = np.int64(max(ranks.values()) + 1)
        self.shift = int(self.none).bit_length()
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        # every way to put a token together from two tokens, sorted by the pair
        pairs = [(ranks[t[:c]] << self.shift | ranks[t[c:]], r) for t, r in ranks.items()
                 for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
        pairs.sort()
        self.pair, self.rank = np.array(pairs, np.int64).reshape(-1, 2).T.copy()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << self.shift | right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.rank[at], self.none)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        least = 2
        for leaves in self.LEAVES:
            chosen = np.flatnonzero((sizes >= least) & (sizes <= leaves + 1))
            least = leaves + 2
            for at in range(0, len(chosen), 20_000):
                some = chosen[at:at + 20_000]
                for i, packed in zip(some.tolist(), self._merge([pieces[i] for i in some.tolist()], sizes[some], leaves), strict=True):
                    out[i] = packed
        for i in np.flatnonzero((sizes < 2) | (sizes >= least)).tolist():
            out[i] = pack(merge_piece(pieces[i], self.ranks))
        return out

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, leaves: int) -> list[bytes]:
        rows, width, nodes = len(pieces), leaves + 1, 2 * leaves
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(rows, width)
        token = self.of_byte[raw]
        places = np.arange(width)
        bits = leaves.bit_length()
        none = int(self.none) << bits
        tree = np.full((rows, nodes), none, np.int64)
        paired = places[None, :-1] + 1 < sizes[:, None]
        first = self.rank_of(token[:, :-1], token[:, 1:])
        tree[:, leaves:] = np.where(paired & (first < self.none), first << bits | places[None, :-1], none)
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        live = places[None, :] < sizes[:, None]
        end = np.tile(np.arange(1, width + 2), (rows, 1))  # one more column: the place behind the last byte
        before = np.tile(np.arange(-1, width), (rows, 1))
        flat, token_at, end_at, before_at, live_at = tree.ravel(), token.ravel(), end.ravel(), before.ravel(), live.ravel()
        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            in_tree, in_bytes, in_ends = row * nodes, row * width, row * (width + 1)
            top = flat[in_tree + 1]
            i, new = top & (1 << bits) - 1, top >> bits
            j = end_at[in_ends + i]
            k = end_at[in_ends + j]
            end_at[in_ends + i] = k
            before_at[in_ends + k] = i
            token_at[in_bytes + i] = new
            live_at[in_bytes + j] = False
            p = before_at[in_ends + i]
            right, left = k < sizes[row], p >= 0
            own = np.full(len(row), none)
            own[right] = (self.rank_of(new[right], token_at[in_bytes[right] + k[right]]) << bits) | i[right]
            front = (self.rank_of(token_at[in_bytes[left] + p[left]], new[left]) << bits) | p[left]
            inner = j < leaves
            node = np.concatenate([in_tree + leaves + i, in_tree[left] + leaves + p[left], in_tree[inner] + leaves + j[inner]])
            base = np.concatenate([in_tree, in_tree[left], in_tree[inner]])
            flat[node] = np.minimum(np.concatenate([own, front, np.full(int(inner.sum()), none)]), none)
            node -= base
            for _ in range(bits - 1):
                node >>= 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])
            row = row[flat[in_tree + 1] < none]
        packed = token[live].astype("<u4").tobytes()
        stops = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]


class Pieces(dict):
    """Packed ids (little-endian unsigned 32 bits) by piece; bounded: two generations, the older one is dropped."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_PIECES):
        super().__init__()
        self.ranks, self.merges, self.limit, self.older = ranks, Merges(ranks), limit, {}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        return pack(merge_piece(raw, self.ranks) if rank is None else [rank])

    def learn(self, pieces: set[str]) -> None:
        """Work out all pieces that are not known, together; very long ones are not kept."""
        new = {}
        for piece in pieces:
            if piece not in self and len(piece) <= 64:
                packed = self.older.get(piece)
                raw = b"" if packed else piece.encode()
                rank = None if packed else self.ranks.get(raw)
                if packed or rank is not None:
                    self[piece] = packed or pack([rank])
                else:
                    new[piece] = raw
        self.update(zip(new, self.merges.encode(list(new.values())), strict=True))

    def age(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


def pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def latin_split(pattern: str) -> re.Pattern:
    r"""``pattern`` for texts of characters below U+0250, with ``\p{L}``, ``\p{N}`` and ``\s`` written out: the quick engine."""
    def members(name: str) -> str:
        has = regex.compile(name)
        return "".join(re.escape(chr(c)) for c in range(0x250) if has.match(chr(c)))

    letters, numbers, blanks = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    quick = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
    quick = quick.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
    quick = quick.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(quick.replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]"))


class Codec:
    def __init__(self, path: str, pattern: str, cache_pieces: int = CACHE_PIECES):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split, self.quick = regex.compile(pattern), latin_split(pattern)
        self.latin = re.compile("[\x00-ɏ]*")
        self.pieces = Pieces(self.ranks, cache_pieces)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        out = []
        for some in bounded(texts):
            parts = [(self.quick if self.latin.fullmatch(t) else self.split).findall(t) if t else [] for t in some]
            self.pieces.age()
            self.pieces.learn(set().union(*parts))
            out += [b"".join(map(self.pieces.__getitem__, p)) for p in parts]
        return out

    def decode(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        if sys.byteorder == "big":
            ids.byteswap()
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def bounded(texts: list[str | None], characters: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about so many characters; a longer text is a run of its own."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= characters:
            yield some
            some, size = [], 0
    if some:
        yield some


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per worker process; its piece cache lives as long as the worker."""
    return Codec(path, pattern)


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str, pattern: str) -> DataFrame:
    """Rows ``(key, token_ids binary)``: packed little-endian unsigned 32-bit ids of each whole text.

    Null and empty texts have no ids (an empty binary).  Repeated rows give repeated rows; other columns are left out.
    """
    def make():
        bpe = codec(path, pattern)
        return lambda b: [b.column(0), (bpe.encode(b.column(1).to_pylist()), pa.binary())]

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, token_ids binary", make)


def decode(df: DataFrame, *, key: str = "doc_id", path: str, pattern: str) -> DataFrame:
    """Rows ``(key, text_bytes binary)`` of what ``encode`` gave; null ids give null."""
    def make():
        bpe = codec(path, pattern)
        return lambda b: [b.column(0), ([None if t is None else bpe.decode(t) for t in b.column(1).to_pylist()], pa.binary())]

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, "token_ids"), f"`{key}` {kind}, text_bytes binary", make)


def round_trip(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str, pattern: str) -> DataFrame:
    """Rows ``(key, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, and its ids decoded again, in one pass.

    Null and empty texts: no tokens, digests of nothing.  One row per input row.
    """
    def make():
        bpe = codec(path, pattern)

        def work(batch):
            n, ids_sha, text_sha = [], [], []
            for packed in bpe.encode(batch.column(1).to_pylist()):
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            return [batch.column(0), (n, pa.int64()), (ids_sha, pa.string()), (text_sha, pa.string())]
        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)

