"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from a logistic model of its words and word
beginnings; the document's score is their noisy-or, ``1 - prod(1 - p)``.  Only documents carry labels: the
gradient of the document's loss is passed down through the noisy-or, so the model finds out by itself which
sentences made a document toxic, and then points at them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import bounded
from .common import fold_of, map_rows

#: Bound of the training sample: labelled documents of each class.
TRAIN_PER_CLASS = 4_000
#: A word or word beginning must be in so many training documents to become a feature.
MIN_DOCUMENTS = 4
#: Least likelihood-ratio statistic of a feature against the label, and weight of the squared size of the weights.
LEAST_G2, RIDGE = 30.0, 1e-5
#: Lengths of the word beginnings that are features beside the whole word: endings change with inflection.
STEMS = (4, 5, 6)
#: Score from which a document counts as toxic, and probability from which a sentence is pointed at.
DOCUMENT_THRESHOLD, SENTENCE_THRESHOLD = 0.7, 0.5

_UNIT = re.compile(r"\w+|[.!?\n]+")
_WORD = re.compile(r"\w+")
_CACHE_WORDS = 400_000


def features_of(word: str) -> list[str]:
    """A lower-case word as features: itself, and its beginnings marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Word weights are summed over the features once per distinct word; the cache is bounded."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def weight(self, word: str) -> float:
        w = self.words.get(word)
        if w is None:
            get = self.model.weights.get
            w = sum([get(f, 0.0) for f in features_of(word)])
            if len(self.words) >= _CACHE_WORDS:
                self.words.clear()
            self.words[word] = w
        return w

    def evidence(self, words: list[str]) -> float:
        """Log odds of a sentence: each distinct word counts once, however often it is repeated."""
        weight = self.weight
        return self.model.bias + sum([weight(w) for w in dict.fromkeys(words)])

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences; a text without words scores 0."""
        miss, words = [], []
        for unit in _UNIT.findall((text or "").lower()):
            if unit[0] not in ".!?\n":
                words.append(unit)
            elif words:
                miss.append(self.evidence(words))
                words = []
        if words:
            miss.append(self.evidence(words))
        if not miss:
            return 0.0
        z = np.array(miss)
        # log(1 - sigmoid(z)) = -log(1 + e^z)
        return float(-np.expm1(-np.logaddexp(0.0, z).sum()))

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Offsets (code points, end exclusive) and probability of each sentence that has words."""
        out = []
        text = text or ""
        lower = text.lower() if len(text.lower()) == len(text) else text
        for m in re.finditer(r"[^.!?\n]+", lower):
            words = _WORD.findall(m.group())
            if words:
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-self.evidence(words))))))
        return out


def training_bags(df: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """Rows ``(text, label)`` of a bounded sample of the labelled documents of the learning folds.

    Ids are picked by a hash threshold per class, so no group is gathered anywhere; at most ``4 * per_class`` ids
    are broadcast.  Documents with a null id, text or label, and those of fold 1, are not learned from.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where("k is not null and y in (0, 1)").where(fold_of(F.col("k")) != 1)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, int(min(1.0, per_class / n) * (1 << 20)) + 1)]) if counts else F.lit(None)
    picked = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < rate[F.col("y")]) if counts else known
    picked = picked.groupBy("k").agg(F.max("y").alias("y")).limit(4 * per_class)
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("text")).where("text is not null")
    return texts.join(F.broadcast(picked), "k").select("text", "y")


def train(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
          per_class: int = TRAIN_PER_CLASS, rounds: int = 400) -> Model:
    """Fit the sentence model from document labels by full-batch gradient steps (Adam).

    The sample is turned into features on the executors; the driver holds the feature numbers of at most about
    ``2 * per_class`` documents.  Without documents of both classes every score is that of the bias, near 0.
    """
    bags = training_bags(df, labels, key=key, text=text, label=label, per_class=per_class)

    def sentences(batches):
        for batch in batches:
            rows = [["\n".join(" ".join(_WORD.findall(s)) for s in re.split(r"[.!?\n]+", t.lower()) if _WORD.search(s))]
                    for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), batch.column(1)], ["bag", "y"])

    rows = [(r["bag"], r["y"]) for r in bags.mapInArrow(sentences, "bag string, y int").toLocalIterator()]
    return fit(rows, rounds)


def telling(rows: list[tuple[str, int]], least: float = LEAST_G2) -> list[str]:
    """Features whose presence in a document goes with its label: likelihood ratio G2 of the two-by-two table."""
    spread = (Counter(), Counter())
    for bag, y in rows:
        spread[y].update({f for w in set(bag.split()) for f in features_of(w)})
    total = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    names = sorted(f for f in spread[0].keys() | spread[1].keys() if spread[0][f] + spread[1][f] >= MIN_DOCUMENTS)
    seen = np.array([[spread[0][f], spread[1][f]] for f in names], float).reshape(-1, 2)
    table = np.stack([seen, np.array(total) - seen], axis=1)  # feature, present or absent, label
    expected = table.sum(axis=2, keepdims=True) * table.sum(axis=1, keepdims=True) / max(1, sum(total))
    g2 = 2 * (table * np.log(np.maximum(table, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=(1, 2))
    return [f for f, g in zip(names, g2, strict=True) if g >= least]


def fit(rows: list[tuple[str, int]], rounds: int) -> Model:
    """``rows``: sentences of a document, one per line, words between blanks; and its label."""
    y = np.array([r[1] for r in rows])
    names = telling(rows) if len(set(y.tolist())) == 2 else []
    if not names:
        return Model({}, -20.0)
    number = {f: i for i, f in enumerate(names)}
    of_word: dict[str, list[int]] = {}
    feature, sentence, document, n = [], [], [], 0
    for d, (bag, _) in enumerate(rows):
        for line in bag.split("\n"):
            for w in dict.fromkeys(line.split()):
                ids = of_word.get(w)
                if ids is None:
                    ids = of_word[w] = [number[f] for f in features_of(w) if f in number]
                feature += ids
                sentence += [n] * len(ids)
            document.append(d)
            n += 1
    feature, sentence, document = (np.array(x, np.int64) for x in (feature, sentence, document))
    # without a telling word the longest document stays at one half, so no document is toxic for its length
    highest = math.log(math.log(2) / max(1, int(np.bincount(document).max())))
    theta, bias = np.zeros(len(names)), min(-6.0, highest)
    grown = np.zeros((2, len(names) + 1))
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())  # both classes weigh alike
    for step in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(sentence, theta[feature], n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        miss = np.exp(-np.bincount(document, np.logaddexp(0, z), len(y)))  # probability that no sentence is toxic
        # d loss / d z: p for a clean document, -p * miss / (1 - miss) for a toxic one
        pull = np.where(y == 1, -miss / np.maximum(1 - miss, 1e-9), 1.0) * share
        at = p * pull[document]
        slope = np.append(np.bincount(feature, at[sentence], len(theta)) + RIDGE * theta, at.sum())
        grown[0] = 0.9 * grown[0] + 0.1 * slope
        grown[1] = 0.99 * grown[1] + 0.01 * slope ** 2
        move = 0.1 * grown[0] / (1 - 0.9 ** step) / (np.sqrt(grown[1] / (1 - 0.99 ** step)) + 1e-9)
        theta, bias = theta - move[:-1], min(bias - move[-1], highest)
    return Model({f: float(theta[i]) for f, i in number.items()}, float(bias))


def score_documents(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, held_out, score, predicted, n_sentences)`` of each whole text.

    ``n_sentences``: sentences the model points at.  Null and empty texts score 0; a null id is not held out.
    One row per input row; other columns are left out.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = held.value.scorer()

        def work(batch):
            scores, offending = [], []
            for some in bounded(batch.column(2).to_pylist()):
                for t in some:
                    s = scorer.score(t)
                    scores.append(round(s, 9))
                    offending.append(sum(p >= SENTENCE_THRESHOLD for *_, p in scorer.sentences(t)) if s >= SENTENCE_THRESHOLD else 0)
            predicted = (np.array(scores) >= DOCUMENT_THRESHOLD).astype(np.int32)
            return [batch.column(0), batch.column(1), (scores, pa.float64()), (predicted, pa.int32()), (offending, pa.int64())]
        return work

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.coalesce(fold_of(F.col(key)) == 1, F.lit(False)).alias("h"), F.col(text))
    return map_rows(rows, f"`{key}` {kind}, held_out boolean, score double, predicted int, n_sentences long", make)


def offending_sentences(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, sentences array<struct<start, end, p>>)`` of the documents that score as toxic."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def make():
        scorer = held.value.scorer()

        def work(batch):
            out = []
            for t in batch.column(1).to_pylist():
                toxic = scorer.score(t) >= DOCUMENT_THRESHOLD
                found = [x for x in scorer.sentences(t) if x[2] >= SENTENCE_THRESHOLD] if toxic else []
                out.append([dict(zip(("start", "end", "p"), x, strict=True)) for x in found] if toxic else None)
            return [batch.column(0), (out, span)]
        return work

    spans = map_rows(df.select(key, text), f"`{key}` {kind}, sentences array<struct<start:bigint,end:bigint,p:double>>", make)
    return spans.where("sentences is not null")


def score_column(df: DataFrame, model: Model, text: str = "text") -> Column:
    """The score as a column expression, for filters that keep all other columns."""
    held = df.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    @F.arrow_udf("double")
    def toxic_score(texts: pa.Array) -> pa.Array:
        scorer = state.get("scorer") or state.setdefault("scorer", held.value.scorer())
        return pa.array([scorer.score(t) for t in texts.to_pylist()], pa.float64())

    return toxic_score(F.col(text))
