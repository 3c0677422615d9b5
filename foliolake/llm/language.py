"""Language identification with string kernels.

The kernel of two texts counts the character 1-, 2- and 3-grams that both contain (blended spectrum, presence
only), divided by the root of both texts' own counts.  A bounded set of landmark texts spans the feature space
(Nyström); one ridge regression per language is fitted in it.  Texts are scored in batches: a presence matrix
times the landmarks' presence matrix gives the kernel values, then two small products give the scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_rows

#: Bounds of what is learned from, per language: training texts, and those of them that are landmarks.
TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 400, 40
#: Letters that are told apart (the most frequent ones of the landmarks); the others count as one.
LETTERS = 126
RIDGE = 1e-3
#: Texts in one matrix product.
BATCH = 64
UNKNOWN = "und"
#: A text is doubtful if no language's score is above the first and the best leads the next by less than the second.
LEAST_SCORE, LEAST_LEAD = 0.5, 0.1
#: Parts of the share of grams that the landmarks have of a usual text: below the first a text has no learned language,
#: below the second a doubtful one has none (a text in two learned languages is doubtful, but its grams are known).
LEAST_COVER, DOUBTFUL_COVER = 0.5, 0.9

_LETTER = regex.compile(r"\p{L}")


class Grams:
    """Distinct n-grams of a text as numbers, over an alphabet of at most ``LETTERS`` letters, a blank and 'other'."""

    def __init__(self, letters: list[str]):
        self.base = len(letters) + 2
        # 0: no letter, 1: a letter outside the alphabet
        self.code = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
        for i, letter in enumerate(letters):
            self.code[ord(letter)] = i + 2
        self.offsets = (0, self.base, self.base + self.base ** 2)
        self.size = self.base + self.base ** 2 + self.base ** 3
        self._last = np.zeros(self.size, np.int64)

    def of(self, text: str) -> np.ndarray:
        a = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        # runs of what is no letter count as one blank
        a = a[np.append(True, (a[1:] != 0) | (a[:-1] != 0))] if len(a) else a
        pairs = a[:-1] * self.base + a[1:]
        triples = pairs[:-1] * self.base + a[2:]
        grams = np.concatenate([a, pairs + self.offsets[1], triples + self.offsets[2]])
        order = np.arange(len(grams))
        self._last[grams] = order
        return grams[self._last[grams] == order]


@dataclass
class Model:
    languages: list[str]
    letters: list[str] = field(default_factory=list)
    landmarks: list[np.ndarray] = field(default_factory=list)
    root: np.ndarray | None = None  # inverse square root of the landmarks' kernel matrix
    weights: np.ndarray | None = None
    cover: float = 0.0  # share of a usual text's grams that the landmarks have


class Scorer:
    def __init__(self, model: Model):
        self.model, self.grams = model, Grams(model.letters)
        used = np.unique(np.concatenate(model.landmarks)) if model.landmarks else np.zeros(0, np.int64)
        self.column = np.full(self.grams.size, -1, np.int32)
        self.column[used] = np.arange(len(used))
        self.landmarks = np.zeros((len(used), len(model.landmarks)), np.float32)
        for i, grams in enumerate(model.landmarks):
            self.landmarks[self.column[grams], i] = 1
        self.own = np.sqrt(np.array([max(1, len(g)) for g in model.landmarks], np.float32))

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of each text with each landmark."""
        return self.measured(texts)[0]

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values, and the share of each text's grams that any landmark has."""
        seen, norm = np.zeros((len(texts), self.landmarks.shape[0]), np.float32), np.ones((len(texts), 1), np.float32)
        for i, text in enumerate(texts):
            grams = self.grams.of(text)
            at = self.column[grams]
            seen[i, at[at >= 0]] = 1
            norm[i] = np.sqrt(max(1, len(grams)))
        return seen @ self.landmarks / (norm * self.own), seen.sum(axis=1) / norm[:, 0] ** 2

    def known(self, texts: list[str | None]) -> list[bool]:
        """Whether a text has one of the learned languages; without a model, whether it has a letter."""
        out = [t is not None and _LETTER.search(t) is not None for t in texts]
        for at in range(0, len(texts) if self.model.weights is not None else 0, BATCH):
            kernel, cover = self.measured([t or "" for t in texts[at:at + BATCH]])
            # regression targets are -1 and 1
            values = ((kernel @ self.model.root @ self.model.weights).astype(np.float64) + 1) / 2
            ordered = np.sort(values, axis=1)
            lead = ordered[:, -1] - ordered[:, -2] if values.shape[1] > 1 else np.zeros(len(values))
            least = np.where((ordered[:, -1] > LEAST_SCORE) | (lead >= LEAST_LEAD), LEAST_COVER, DOUBTFUL_COVER)
            sure = cover >= least * self.model.cover
            out[at:at + BATCH] = [a and b for a, b in zip(out[at:at + BATCH], sure.tolist(), strict=True)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), BATCH):
            some = texts[at:at + BATCH]
            if self.model.weights is None:
                names += [UNKNOWN] * len(some)
                scores += [0.0] * len(some)
                continue
            values = self.kernel([t or "" for t in some]) @ self.model.root @ self.model.weights
            best = values.argmax(axis=1)
            for t, b, v in zip(some, best.tolist(), values[np.arange(len(some)), best].tolist(), strict=True):
                sure = t is not None and _LETTER.search(t) is not None
                names.append(self.model.languages[b] if sure else UNKNOWN)
                # regression targets are -1 and 1
                scores.append(round(min(1.0, max(0.0, (v + 1) / 2)), 6) if sure else 0.0)
        return names, scores


def training_texts(df: DataFrame, *, key: str, text: str, label: str, per_language: int) -> DataFrame:
    """Rows ``(text, lang, h)`` of a bounded sample of each language, picked by a hash of the id.

    Rows with a null id, text or label, and those of fold 1, are not learned from.
    """
    known = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    known = known.where("k is not null and lang is not null").where(fold_of(F.col("k")) != 1)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.select("text", "lang", F.lit(0).alias("h"))
    rate = F.create_map(*[F.lit(v) for y, n in sorted(counts.items()) for v in (y, int(min(1.0, per_language / n) * (1 << 20)) + 1)])
    chosen = known.where((F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < rate[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    return chosen.select("text", "lang", F.xxhash64("k", "text").alias("h")).limit(4 * per_language * len(counts))


def train(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang",
          per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """Fit the kernel model from about ``per_language`` texts of each language (a bounded sample, read one by one)."""
    rows = [(r["h"], r["lang"], r["text"]) for r in training_texts(
        df, key=key, text=text, label=label, per_language=per_language).toLocalIterator()]
    return fit(rows, landmarks)


def fit(rows: list[tuple[int, str, str]], landmarks: int) -> Model:
    """``rows``: (order, language, text)."""
    rows = sorted(rows)
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([])
    ranked = [[r[2] for r in rows if r[1] == lang] for lang in languages]
    chosen, others = [t for own in ranked for t in own[:landmarks]], [t for own in ranked for t in own[landmarks:]]
    letters = Counter(c for t in chosen for c in t.lower() if c.isalpha())
    model = Model(languages, [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]])
    grams = Grams(model.letters)
    model.landmarks = [grams.of(t) for t in chosen]
    scorer = Scorer(model)
    k = scorer.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    kept = values > 1e-6 * values.max()
    model.root = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    covers = [scorer.measured(others[at:at + BATCH])[1] for at in range(0, len(others), BATCH)]
    model.cover = float(np.median(np.concatenate(covers))) if covers else 0.0
    phi = np.concatenate([scorer.kernel([r[2] for r in rows[at:at + BATCH]]) @ model.root for at in range(0, len(rows), BATCH)]).astype(np.float64)
    target = np.where(np.array([r[1] for r in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # every language weighs alike
    share = sum(t[:, None] * 1.0 / max(1, t.sum()) for t in (target > 0).T) / len(languages)
    gram = phi.T @ (share * phi) + RIDGE * np.eye(phi.shape[1]) / phi.shape[1]
    model.weights = np.linalg.solve(gram, phi.T @ (share * target)).astype(np.float32)
    return model


def predict(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, held_out, lang_pred, score)`` of each whole text.

    Null texts and texts without a letter are ``und`` with score 0; a null id is not held out.  One row per input
    row; other columns are left out.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)

        def work(batch):
            names, scores = scorer.predict(batch.column(2).to_pylist())
            return [batch.column(0), batch.column(1), (names, pa.string()), (scores, pa.float64())]
        return work

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.coalesce(fold_of(F.col(key)) == 1, F.lit(False)).alias("h"), F.col(text))
    return map_rows(rows, f"`{key}` {kind}, held_out boolean, lang_pred string, score double", make)


def known_column(df: DataFrame, model: Model, text: str = "text") -> Column:
    """Whether the text has a learned language, as a column expression for filters that keep all other columns."""
    held = df.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    @F.arrow_udf("boolean")
    def is_known(texts: pa.Array) -> pa.Array:
        scorer = state.get("scorer") or state.setdefault("scorer", Scorer(held.value))
        return pa.array(scorer.known(texts.to_pylist()), pa.bool_())

    return is_known(F.col(text))
