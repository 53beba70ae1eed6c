"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of being offensive, and a
noisy-or makes the document's: 1 - prod(1 - p). Only documents carry labels; the gradient of
the noisy-or tells which sentences to blame, so the model locates them too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
#: A sentence ends at a mark or line end, and after so many words at the latest.
SENTENCE_WORDS = 40
PREFIXES = (3, 4, 5, 6)
#: Most labelled documents of either class that are drawn for training, in the order of a hash of their ids.
TRAIN_DOCS = 2500
FOLDS = 5


def held_out(id_col: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def word_features(word: str) -> list[str]:
    """The word itself and its first letters: inflected forms share what they begin with."""
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


def _tokens(text: str) -> list[str]:
    """Words and marks where they stand in the text; each is lowered by itself, so that places do not move."""
    if text.isascii():
        return TOKEN.findall(text.lower())
    return [x.lower() for x in TOKEN.findall(text)]


def sentence_numbers(is_word: np.ndarray) -> np.ndarray:
    """Per word: the number of its sentence. Marks separate sentences; long ones are cut."""
    mark = np.cumsum(~is_word)[is_word]
    if len(mark) == 0:
        return mark
    start = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
    length = np.diff(np.r_[start, len(mark)])
    within = np.arange(len(mark)) - np.repeat(start, length)
    new = np.r_[True, mark[1:] != mark[:-1]] | (within % SENTENCE_WORDS == 0)
    return np.cumsum(new) - 1


@dataclass
class ToxicityModel:
    """Feature weights and bias; a sentence's logit is the bias plus its words' features' weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Weights by word, filled in as words are met and emptied when large; marks are NaN."""

    MOST_WORDS = 100_000

    def __init__(self, model: ToxicityModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        get = self.model.weights.get
        value = sum(get(f, 0.0) for f in word_features(token)) if token[0] not in ".!?\n" else np.nan
        self[token] = value
        return value

    def sentences(self, text: str | None) -> np.ndarray:
        """Probabilities of the text's sentences, in order."""
        if self.model.bias == -np.inf:
            return np.empty(0)
        if len(self) > self.MOST_WORDS:
            self.clear()
        tokens = _tokens(text or "")
        values = np.fromiter(map(self.__getitem__, tokens), dtype=np.float64, count=len(tokens))
        is_word = ~np.isnan(values)
        number = sentence_numbers(is_word)
        logits = np.bincount(number, weights=values[is_word]) if len(number) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(logits + self.model.bias, -60, 60)))

    def score(self, text: str | None) -> tuple[float, np.ndarray]:
        p = self.sentences(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()) + 0.0), p

    def spans(self, text: str, p: np.ndarray, least: float) -> list[dict]:
        """Character spans of the sentences with a probability of at least ``least``."""
        found = [(m.start(), m.end(), m[0][0] not in ".!?\n") for m in TOKEN.finditer(text)]
        words = [x for x in found if x[2]]
        number = sentence_numbers(np.array([x[2] for x in found], dtype=bool))
        out = []
        for k in np.flatnonzero(p >= least).tolist():
            at = np.flatnonzero(number == k)
            out.append({"start": words[at[0]][0], "end": words[at[-1]][1], "p": float(p[k])})
        return out


def fit(texts: list[str], labels: list[int], epochs: int = 100, rate: float = 0.15, shrink: float = 4e-4, least_docs: int = 3, caution: float = 0.8) -> ToxicityModel:
    """Adam on the log-loss of the noisy-or; clean documents have the share ``caution`` of the weight.

    ``shrink`` is an L1 penalty by soft thresholding, so that most features weigh nothing; else
    long documents gather noise. Features of fewer than ``least_docs`` documents are left out.
    Without documents of both classes the model scores everything 0.
    """
    y = np.asarray(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel()
    vocabulary: dict[str, int] = {}
    words, sentences, docs, n_sentences = [], [], [], 0
    for text in texts:
        tokens = _tokens(text)
        is_word = np.array([t[0] not in ".!?\n" for t in tokens], dtype=bool)
        number = sentence_numbers(is_word)
        ids = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t, w in zip(tokens, is_word, strict=True) if w), dtype=np.int64)
        count = int(number[-1]) + 1 if len(number) else 0
        words.append(ids)
        sentences.append(number + n_sentences)
        docs.append(count)
        n_sentences += count
    doc_of_sentence = np.repeat(np.arange(len(y)), docs)
    features: dict[str, int] = {}
    of_word, feature = [], []
    for word, i in vocabulary.items():
        for f in word_features(word):
            of_word.append(i)
            feature.append(features.setdefault(f, len(features)))
    of_word_a, feature_a = np.array(of_word, dtype=np.int64), np.array(feature, dtype=np.int64)
    in_docs = np.zeros(len(features), dtype=np.int64)
    starts = np.searchsorted(of_word_a, np.arange(len(vocabulary) + 1))
    for ids in words:
        own = np.unique(ids)
        at = np.concatenate([feature_a[starts[i] : starts[i + 1]] for i in own.tolist()]) if len(own) else feature_a[:0]
        in_docs[np.unique(at)] += 1
    kept = in_docs >= least_docs
    number = np.cumsum(kept) - 1
    some = kept[feature_a]
    of_word_a, feature_a = of_word_a[some], number[feature_a[some]]
    names = [f for f, i in features.items() if kept[i]]
    word, sentence = np.concatenate(words), np.concatenate(sentences)
    weight_of_doc = np.where(y > 0, (1 - caution) / y.sum(), caution / (1 - y).sum())
    w, b = np.zeros(len(names)), -8.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        by_word = np.bincount(of_word_a, weights=w[feature_a], minlength=len(vocabulary))
        z = np.bincount(sentence, weights=by_word[word], minlength=n_sentences) + b
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.bincount(doc_of_sentence, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        some_p = np.maximum(-np.expm1(none), 1e-9)
        # Gradient of the log-loss by a sentence's logit: p where the label is 0, else blame shared by p.
        blame = np.where(y > 0, -np.exp(none) / some_p, 1.0) * weight_of_doc
        dz = blame[doc_of_sentence] * p
        d_word = np.bincount(word, weights=dz[sentence], minlength=len(vocabulary))
        g = np.bincount(feature_a, weights=d_word[of_word_a], minlength=len(names))
        gb = float(dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.999**step
        pace = rate / (np.sqrt(v / down) + 1e-6)
        w -= pace * m / up
        w = np.sign(w) * np.maximum(np.abs(w) - pace * shrink, 0)
        b -= rate * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b))


def training_texts(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_per_class: int
) -> tuple[list[str], list[int]]:
    """At most so many labelled texts of each class, none of them held out."""
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("_y"))
        .where(~held_out(F.col("_id")))
    )
    drawn = [marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most_per_class) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most twice most_per_class narrow rows
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = sorted(texts.join(ids, "_id").groupBy("_id", "_y").agg(F.max("_text").alias("_text")).collect())
    return [r["_text"] for r in rows], [int(r["_y"]) for r in rows]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_per_class: int = TRAIN_DOCS,
) -> ToxicityModel:
    """Fits on at most ``most_per_class`` labelled documents of each class, whole texts, outside the held-out fifth.

    The sample's size is the bound on what reaches the driver. Null labels and ids are left out;
    of rows that repeat an id the text that sorts last counts.
    """
    return fit(*training_texts(docs, labels, id_col, text_col, label_col, most_per_class))


def score_column(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column, for filters."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.map(lambda t: scorer.score(t)[0])

    return score(text.cast("string"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, with all their columns; empty texts stay."""
    return docs.where(score_column(model, F.coalesce(F.col(text_col), F.lit(""))) < least)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, offending.

    ``offending`` has the character spans of the sentences with a probability of at least
    ``least``. A text is all that a score depends on; a null, empty or wordless one scores 0.
    Repeated rows and null ids are scored as they are (a null id is not held out), and other
    columns are ignored. An empty table gives no rows.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for batch in batches:
            scores, spans = [], []
            for text in batch["_text"]:
                s, p = scorer.score(text)
                scores.append(s)
                spans.append(scorer.spans(text, p, least) if len(p) and p.max() >= least else [])
            yield pd.DataFrame({
                "_id": batch["_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores,
                "predicted": [int(s >= 0.5) for s in scores], "offending": spans,
            })

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    kinds = "_id long, held_out boolean, score double, predicted int, offending array<struct<start: int, end: int, p: double>>"
    return slim.mapInPandas(score, kinds).withColumnRenamed("_id", id_col)
