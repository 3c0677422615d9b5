"""Chunks are cut with each window and the length of a text worked out once; the hashing encoder counts as before."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliolake.operators import chunking, vectors


def test_window_and_length_stand_once(spark):
    df = spark.createDataFrame([("a sentence. " * 900,)], "t string")
    out = df.select(chunking.chunk_array(F.col("t")).alias("c"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("substring(") == 2  # the window and the chunk
    (chunks,) = out.first()
    assert [c["start"] for c in chunks][:2] == [0, chunks[0]["start"] + len(chunks[0]["body"]) + 1 - 800] and len(chunks) > 3


def test_hashing_encoder_counts_words():
    texts = ["the end of the line", "", None, "Größe x_y 1"]
    got = vectors.hashing_encoder(8)()(texts)
    for text, row in zip(texts, got):
        want = np.zeros(8, np.float32)
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            h = zlib.crc32(w.encode())
            want[h % 8] += 1.0 if (h >> 16) & 1 else -1.0
        norm = np.linalg.norm(want)
        assert np.array_equal(row, want / (norm if norm else 1)) and row.dtype == np.float32
