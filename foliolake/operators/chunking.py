"""Overlapping chunks for embedding: one expression per document, so chunking never shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.spans import span_array, unicode_pattern
from ..functions.text import clean_ocr, strip

_CHUNKS = "array<struct<start:int,body:string>>"


def _piece(text: Column, start: Column, end: Column) -> Column:
    return strip(F.substring(text, start + 1, end - start))


def _break_after(text: Column, start: Column, target: Column, size: int, minimum: int) -> Column:
    """Where to end a chunk: after the last section break in the final fifth, else after a sentence."""
    begin = F.greatest(start, target - size // 5)
    window = F.substring(text, begin + 1, target - begin)

    def last_end(part: Column, pattern: str) -> Column:
        ends = F.transform(span_array(part, unicode_pattern(pattern)), lambda s: begin + s["end"])
        return F.try_element_at(F.filter(ends, lambda e: e > start + minimum), F.lit(-1))

    # bound by a one-element array: the window is cut out of the text once, not for each pattern
    return F.element_at(F.transform(F.array(window), lambda w: F.coalesce(
        last_end(w, V.SECTION_BREAK), last_end(w, V.SENTENCE_END), target)), 1)


def chunk_array(text: Column, *, size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP,
                minimum: int = V.CHUNK_MIN_CHARS, boundaries: bool = True) -> Column:
    """Chunks of an already cleaned text as ``array<struct<start, body>>``.

    The walk is sequential by nature (each start depends on the end before it), so it is a fold over
    as many steps as the text can need; it ends at a short chunk, at no progress or near the end.
    """
    least_step = size - size // 5 - overlap if boundaries else size - overlap
    if least_step <= 0:
        raise ValueError("overlap leaves no room to advance")

    def step(state: Column, n: Column) -> Column:
        start, out = state["start"], state["out"]
        reach = F.least(start + size, n)
        end = F.when(reach < n, _break_after(text, start, reach, size, minimum)).otherwise(reach) if boundaries else reach

        def place(placed: Column) -> Column:
            # ``placed`` carries the end and body so that each is worked out once per step
            after = placed["end"] - overlap
            over = (after <= start) | (after >= n - minimum)
            kept = F.concat(out, F.array(F.struct(start.alias("start"), placed["body"].alias("body"))))
            nothing = F.length(placed["body"]) < minimum
            return F.struct(
                F.when(nothing | over, F.lit(-1)).otherwise(after).alias("start"),
                F.when(nothing, out).otherwise(kept).alias("out"),
            )

        ended = F.transform(F.array(end), lambda e: F.struct(e.alias("end"), _piece(text, start, e).alias("body")))
        return F.when(start < 0, state).otherwise(F.element_at(F.transform(ended, place), 1))

    begin = F.struct(F.lit(0).alias("start"), F.array().cast(_CHUNKS).alias("out"))

    def walk(n: Column) -> Column:
        # every step gets the length of the text, which is counted once
        steps = F.array_repeat(n, (n / F.lit(least_step)).cast("int") + 3)
        return F.aggregate(steps, begin, step, lambda s: s["out"])

    n = F.length(text)
    walked = F.element_at(F.transform(F.array(n), walk), 1)
    whole = F.array(F.struct(F.lit(0).alias("start"), strip(text).alias("body"))).cast(_CHUNKS)
    none = F.array().cast(_CHUNKS)
    return F.when(text.isNull() | (F.length(strip(text)) < minimum), none).when(n <= size, whole).otherwise(walked)


def chunk(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", title: str | None = None,
          size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP, minimum: int = V.CHUNK_MIN_CHARS,
          boundaries: bool = True) -> DataFrame:
    """``(doc_id, chunk_index, chunk_text, char_offset, token_count_est)``; a title goes in front of each chunk."""
    cols = [doc_id] + ([title] if title else [])
    cleaned = docs.select(*cols, clean_ocr(text).alias("_text"))
    chunks = cleaned.select(
        *cols,
        F.posexplode(chunk_array(F.col("_text"), size=size, overlap=overlap, minimum=minimum, boundaries=boundaries))
        .alias("chunk_index", "_chunk"),
    )
    body = F.col("_chunk.body")
    if title:
        body = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.col(title), F.lit("\n\n"), body)).otherwise(body)
    return chunks.select(doc_id, "chunk_index", body.alias("chunk_text"), F.col("_chunk.start").alias("char_offset")) \
        .withColumn("token_count_est", F.floor(F.length("chunk_text") / 4).cast("int"))
