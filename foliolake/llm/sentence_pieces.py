"""SentencePiece (BPE model) encoding and decoding by a table of last tokens.

Every prefix of a text has exactly one token that its encoding ends with.  An automaton names the pieces that end
at each character; a piece is that token if it stays whole beside the last token of the prefix in front of it.
Whether two pieces stay whole side by side depends on the two alone, so it is worked out once per pair: the merges
that build either piece are replayed in order of their score, and no merge across the border may come first.
The ids are then read off backwards.  The work is linear in the text, however long it has no blank.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_format

from .bpe import bounded, pack
from .common import map_rows

#: Units of text a worker remembers in each of two generations, and tested pairs of pieces.
CACHE_UNITS, CACHE_PAIRS = 300_000, 1_000_000

#: The letter that the model writes for a blank.
BLANK = "▁"
#: Stands in the table for a character that is in no piece.
FOREIGN = -1


class Vocabulary:
    """Pieces, scores and the merges that build each piece, of a BPE model with neither text rules nor user symbols."""

    def __init__(self, path: str):
        model = model_format.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model_format.ModelProto.SentencePiece
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model_format.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError(f"{path}: only BPE models that leave the text as it is")
        if not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(
                p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: only models that write blanks as letters and have neither user nor unused pieces")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.of_byte = [self.unknown] * 256
        self.score: dict[str, float] = {}
        self.pieces: list[str] = []
        self.raw: list[bytes] = []
        self.is_byte: list[bool] = []
        surface = model.trainer_spec.unk_surface
        ids: dict[str, int] = {}
        for i, p in enumerate(model.pieces):
            self.is_byte.append(p.type == kinds.BYTE)
            self.pieces.append(p.piece)
            self.raw.append(p.piece.replace(BLANK, " ").encode())
            if p.type == kinds.BYTE:
                self.of_byte[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.raw[i] = surface.encode()
            elif p.type == kinds.CONTROL:
                self.raw[i] = b""
            else:
                self.score[p.piece] = p.score
                ids[p.piece] = i
        self.bytes_there = self.unknown not in self.of_byte
        # characters that are only met inside longer pieces are symbols too; they have no id of their own
        self.symbols = [*ids, *sorted(set("".join(ids)) - set(ids))]
        self.id_of = [ids.get(s, self.unknown) for s in self.symbols]
        #: per symbol that stays whole: (score, last part) and (score, first part) after each merge that builds it
        self.right: list[list[tuple[float, str]] | None] = []
        self.left: list[list[tuple[float, str]] | None] = []
        for symbol in self.symbols:
            steps = self.merges(symbol)
            whole = len(symbol) == len(steps) + 1
            self.right.append([(s, parts[-1]) for s, parts in steps] if whole else None)
            self.left.append([(s, parts[0]) for s, parts in steps] if whole else None)

    def merges(self, text: str) -> list[tuple[float, list[str]]]:
        """Every merge of a short text in its order: the score and the parts after it."""
        parts, steps, score = list(text), [], self.score
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return steps
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
            steps.append((best, parts))

    def stay_whole(self, a: int, b: int) -> bool:
        """Whether the symbols ``a`` and ``b`` side by side are encoded as ``a, b``.

        The merges inside ``a`` and inside ``b`` are replayed together, the higher score first and ``a`` (further left) on
        ties; the pair is broken when the parts beside the border would be merged before the next of them.
        """
        right, left, score = self.right[a], self.left[b], self.score
        x, y = self.symbols[a][-1], self.symbols[b][0]
        i = j = 0
        while True:
            of_a = right[i][0] if i < len(right) else None
            of_b = left[j][0] if j < len(left) else None
            across = score.get(x + y)
            if across is not None and (of_a is None or across > of_a) and (of_b is None or across >= of_b):
                return False
            if of_a is not None and (of_b is None or of_a >= of_b):
                x = right[i][1]
                i += 1
            elif of_b is not None:
                y = left[j][1]
                j += 1
            else:
                return True

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for n, symbol in enumerate(self.symbols):
            if self.right[n] is not None:
                found.add_word(symbol, (n, len(symbol)))
        found.make_automaton()
        return found

    def units(self) -> re.Pattern:
        """Parts of a text that no piece reaches across, as far as the pieces allow: a run of Latin letters, or of other
        characters, with the blanks in front; and characters in no piece that end lines or columns."""
        ends = "".join(c for c in "\n\t\r" if c not in self.symbols)
        end = f"|[{ends}]" if ends else ""
        latin = "A-Za-zÀ-ÖØ-öø-ɏ"
        if any(re.search(f"[^{BLANK}]{BLANK}", s) for s in self.symbols):
            return re.compile(f"[^{ends}]+{end}" if ends else r"(?s:.+)")
        if any(re.search(f"[{latin}][^{latin}]|[^{BLANK}{latin}][{latin}]", s) for s in self.symbols):
            return re.compile(f"{BLANK}*[^{BLANK}{ends}]+|{BLANK}+{end}")
        return re.compile(f"{BLANK}*(?:[{latin}]+|[^{BLANK}{ends}{latin}]+)|{BLANK}+{end}")


class Units(dict):
    """Packed ids by unit of text; bounded: two generations, the older one is dropped."""

    def __init__(self, vocabulary: Vocabulary, limit: int):
        super().__init__()
        self.vocabulary, self.limit, self.older = vocabulary, limit, {}
        self.find = vocabulary.automaton().iter
        self.whole: dict[int, bool] = {}

    def __missing__(self, unit: str) -> bytes:
        packed = self.older.get(unit)
        if packed is None:
            packed = pack(self.encode(unit))
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[unit] = packed
        return packed

    def last_tokens(self, unit: str) -> list[int]:
        """The symbol that the encoding of each prefix ends with; ``FOREIGN`` for a character in no piece."""
        last, whole, test = [FOREIGN] * len(unit), self.whole, self.vocabulary.stay_whole
        if len(whole) > CACHE_PAIRS:
            whole.clear()
        for end, (symbol, size) in self.find(unit):
            if last[end] < 0:
                start = end - size
                if start >= 0:
                    before = last[start]
                    if before >= 0:
                        pair = before << 20 | symbol
                        fits = whole.get(pair)
                        if fits is None:
                            fits = whole[pair] = test(before, symbol)
                        if not fits:
                            continue
                last[end] = symbol
        return last

    def encode(self, unit: str) -> list[int]:
        known, last = self.vocabulary, self.last_tokens(unit)
        ids: list[int] = []
        at = len(unit)
        while at:
            symbol = last[at - 1]
            token = known.unknown if symbol < 0 else known.id_of[symbol]
            at -= 1 if symbol < 0 else len(known.symbols[symbol])
            if token != known.unknown:
                ids.append(token)
            elif known.bytes_there:
                ids += [known.of_byte[b] for b in reversed(unit[at].encode())]
            elif not ids or ids[-1] != token:  # neighbours that are not known are one token
                ids.append(token)
        return ids[::-1]


class PieceCodec:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        self.vocabulary = Vocabulary(path)
        self.split = self.vocabulary.units()
        self.units = Units(self.vocabulary, cache_units)
        self.decimals = [b"%d" % i for i in range(len(self.vocabulary.pieces))]

    def encode(self, text: str | None) -> bytes:
        """Packed little-endian unsigned 32-bit ids; null counts as empty."""
        if not text:
            return b""
        written = self.vocabulary.prefix + text.replace(" ", BLANK)
        return b"".join(map(self.units.__getitem__, self.split.findall(written)))

    def decode(self, packed: bytes) -> str:
        """The text of the ids, without the blank put in front; bytes that are no character read U+FFFD each."""
        ids = unpack(packed)
        known = self.vocabulary
        raw = b"".join([known.raw[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        first = next((i for i in ids if known.raw[i]), None)
        drop = known.prefix and first is not None and not known.is_byte[first] and known.pieces[first].startswith(BLANK)
        return text[1:] if drop else text

    def _runs(self, ids: array):
        known, run = self.vocabulary, bytearray()
        for i in ids:
            if known.is_byte[i]:
                run += known.raw[i]
            else:
                yield one_by_one(bytes(run))
                run.clear()
                yield known.raw[i].decode()
        yield one_by_one(bytes(run))


def one_by_one(raw: bytes) -> str:
    """Like ``decode("utf-8", "replace")``, but every byte that begins no character is a U+FFFD of its own."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[:e.start].decode(), "�"]
            raw = raw[e.start + 1:]
    return "".join(out)


def unpack(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


@cache
def codec(path: str) -> PieceCodec:
    """One per worker process; its cache of units lives as long as the worker."""
    return PieceCodec(path)


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str) -> DataFrame:
    """Rows ``(key, token_ids binary)``: packed little-endian unsigned 32-bit ids of each whole text.

    Null and empty texts have no ids (an empty binary).  Repeated rows give repeated rows; other columns are left out.
    """
    def make():
        known = codec(path)
        return lambda b: [b.column(0), ([known.encode(t) for t in b.column(1).to_pylist()], pa.binary())]

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, token_ids binary", make)


def decode(df: DataFrame, *, key: str = "doc_id", path: str) -> DataFrame:
    """Rows ``(key, text)`` of what ``encode`` gave; null ids give null."""
    def make():
        known = codec(path)
        return lambda b: [b.column(0), ([None if t is None else known.decode(t) for t in b.column(1).to_pylist()], pa.string())]

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, "token_ids"), f"`{key}` {kind}, text string", make)


def round_trip(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str) -> DataFrame:
    """Rows ``(key, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, and its ids decoded again, in one pass.

    ``ids_sha256`` is of the decimal ids joined by commas.  Null and empty texts: no tokens, digests of nothing.  One row
    per input row.
    """
    def make():
        known = codec(path)
        decimal = known.decimals.__getitem__

        def work(batch):
            n, ids_sha, text_sha = [], [], []
            for some in bounded(batch.column(1).to_pylist()):
                for t in some:
                    packed = known.encode(t)
                    n.append(len(packed) // 4)
                    ids_sha.append(hashlib.sha256(b",".join(map(decimal, unpack(packed)))).hexdigest())
                    text_sha.append(hashlib.sha256(known.decode(packed).encode()).hexdigest())
            return [batch.column(0), (n, pa.int64()), (ids_sha, pa.string()), (text_sha, pa.string())]
        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
