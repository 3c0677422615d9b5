"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once.  Pre-tokens outside it are
encoded by the tokenizer's own model and remembered in a bounded cache of the worker.  Neither pre-tokens nor
texts are shuffled; only the sums of the table's own small sample are.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import bounded, latin_split
from .common import map_rows

#: Texts that the table of frequent pre-tokens is drawn from, and its entries.  Both change the speed only:
#: a pre-token outside the table is encoded when it is met.
SAMPLE_TEXTS, TABLE_ENTRIES = 1_000, 30_000
#: Pre-tokens a worker remembers in each of two generations.
CACHE_PIECES = 400_000


class Lengths(dict):
    """Token counts by pre-token, encoded at the first miss; bounded: two generations, the older one is dropped."""

    def __init__(self, model, to_units, frequent: dict[str, int], limit: int):
        super().__init__(frequent)
        self.model, self.to_units, self.frequent, self.limit, self.older = model, to_units, frequent, limit, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = len(self.model.tokenize(self.to_units(piece)))
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class TextCounter:
    """Pre-tokens of a text as the tokenizer file defines them, and their lengths."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = CACHE_PIECES):
        with open(path) as f:
            self.rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in self.rules["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        pattern = self.rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = latin_split(pattern)
        # letters that the tokenizer's own rules and Python's change alike; other texts take the tokenizer's
        self.plain = re.compile("[\t\n\r\x20-\x7e¡-įı-ɏ]*")
        letters = byte_letters()
        self.bytes_of = {letter: byte for byte, letter in letters.items()}
        self.lengths = Lengths(self.tokenizer.model, lambda piece: "".join([letters[b] for b in piece.encode()]), frequent, limit)

    def pieces(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.split.findall(text.lower())
        units = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        back = self.bytes_of
        return [bytes([back[c] for c in unit]).decode("utf-8", "surrogateescape") for unit, _ in units]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        n, lengths = 0, self.lengths
        parts = self.at_special.split(text) if "<|" in text else [text]
        for i, part in enumerate(parts):
            if i % 2:
                n += 1
            elif part:
                n += sum([lengths[p] for p in self.pieces(part)])
        return n


@cache
def counter(path: str) -> TextCounter:
    return TextCounter(path, {})


#: The table in use and the worker's cache on top of it.
_SHARED: dict[str, TextCounter] = {}


def frequent_pieces(df: DataFrame, key: str, text: str, path: str, sample_texts: int, entries: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample: at most ``entries`` of them reach the driver.

    The sample is spread over the table by the hash of the key: about ``sample_texts`` texts, at most twice as many.
    """
    share = min(1.0, sample_texts / max(1, df.count()))
    chosen = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = df.where(chosen & (F.length(text) > 0)).select(F.col(text).alias("t")).limit(2 * sample_texts)

    def pieces(batches):
        known = counter(path)
        for batch in batches:
            found = Counter()
            for t in batch.column(0).to_pylist():
                for i, part in enumerate(known.at_special.split(t)):
                    if i % 2 == 0:
                        found.update(known.pieces(part))
            kept = [(p, n, known.lengths[p]) for p, n in found.items() if len(p) <= 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.string()), pa.array([r[1] for r in kept], pa.int64()),
                                              pa.array([r[2] for r in kept], pa.int32())], ["p", "n", "tokens"])

    found = sample.mapInArrow(pieces, "p string, n long, tokens int")
    top = found.groupBy("p", "tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(entries)
    return {r["p"]: r["tokens"] for r in top.collect()}


def count_tokens(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str, limit: int = 2048,
                 sample_texts: int = SAMPLE_TEXTS, entries: int = TABLE_ENTRIES) -> DataFrame:
    """Rows ``(key, n_bytes, n_tokens, over_limit)`` of each whole text.

    Null and empty texts: 0 bytes, 0 tokens.  One row per input row; other columns are left out.  Special strings
    inside a text count as their one token, as is the tokenizer's default.
    """
    frequent = frequent_pieces(df, key, text, path, sample_texts, entries)
    held = df.sparkSession.sparkContext.broadcast(frequent)
    name = f"{path}#{uuid.uuid4().hex}"

    def make():
        known = _SHARED.get(name)
        if known is None:  # one table per worker at a time: an older query's is given up
            _SHARED.clear()
            known = _SHARED[name] = TextCounter(path, held.value)

        def work(batch):
            sizes, counts = [], []
            for some in bounded(batch.column(1).to_pylist()):
                sizes += [len(t.encode()) if t else 0 for t in some]
                counts += [known.count(t) for t in some]
            over = np.array(counts, np.int64) > limit
            return [batch.column(0), (sizes, pa.int64()), (counts, pa.int64()), (over, pa.bool_())]
        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, text), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", make)
