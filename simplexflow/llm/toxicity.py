"""Toxicity by a gap-weighted subsequence kernel, Nystroem landmarks and a linear SVM.

The kernel compares two words by the three-letter subsequences they share; a subsequence that
spans n places weighs ``DECAY ** n``, up to ``SPAN`` places, so letters put between the letters of an
insult lower the value but do not hide it.  Words are lower-cased, bare of ASCII punctuation and
framed by start and end marks; runs of single letters are also read as one word.

Training (only rows of the labelled table that are given): a bounded sample of labelled documents
tells for each word in how many toxic and clean texts it stands; the words tied to toxic texts beyond
chance are positive, also with one character put in; frequent words of clean texts, and those that
the first round scores highest there, are negative.  Landmarks are drawn from both, the features are K_mm^(-1/2) k(x), and a
squared-hinge SVM is fitted on them.  Its decision is linear in the kernel, hence linear in the
subsequences: all landmarks fold into one weight table, exactly, and scoring a word costs a few
lookups per letter.  A document's features are the largest decision, and how many of its words lie
above zero; a logistic curve fitted on the sample turns them into a score.

Defined cases: a null or empty text has no word and gets the score of a text without suspect words;
repeated rows get equal scores; without labelled rows, or with one kind only, every score is the share
of toxic rows (0.5 if there are none); an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECAY = 0.5
SPAN = 8
#: Words scored once per worker and then kept (about 150 bytes each).
CACHED_WORDS = 1_000_000
PUNCTUATION = string.punctuation.encode()
SPELLED = re.compile(rb"(?:(?<=[ \t\n\x0b\x0c\r])|^)(?:[^ \t\n\x0b\x0c\r][ \t]){2,}[^ \t\n\x0b\x0c\r](?=[ \t\n\x0b\x0c\r]|$)")


def words_of(text: str | None) -> set[bytes]:
    """Distinct words as UTF-8; runs of three or more single letters count as one word too."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION)
    found = set(raw.split())
    found.update(m.group().translate(None, b" \t") for m in SPELLED.finditer(raw))
    return found


def codes(word: bytes) -> list[int]:
    """Letters as numbers below 64, with start and end marks; letters beyond a-z share buckets."""
    text = word.decode("utf-8", "replace")
    return [27, *((ord(c) - 96 if "a" <= c <= "z" else 29 + ord(c) % 35) for c in text), 28]


def _spans(n: int) -> list[tuple[int, int]]:
    """Offsets (j, k) of the second and third letter after the first."""
    return [(j, k) for k in range(2, min(SPAN, n)) for j in range(1, k)]


def _size(n: int) -> float:
    """Squared length of a word's subsequence vector if its letters differ; a fixed scale per length."""
    return sum(DECAY ** (2 * (k + 1)) * (n - k) for _, k in _spans(n))


def phi(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of one word, scaled by its length."""
    c = np.array(codes(word), dtype=np.int64)
    n = len(c)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    at, weight = [], []
    for j, k in _spans(n):
        at.append(c[:n - k] << 12 | c[j:n - k + j] << 6 | c[k:])
        weight.append(np.full(n - k, DECAY ** (k + 1)))
    return np.concatenate(at), np.concatenate(weight) / np.sqrt(_size(n))


def decide(words: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """SVM decisions; words of equal length are taken together."""
    out = np.full(len(words), bias)
    by_length: dict[int, list[int]] = {}
    made = [codes(w) for w in words]
    for i, c in enumerate(made):
        by_length.setdefault(len(c), []).append(i)
    for n, rows in by_length.items():
        if n < 3:
            continue
        step = max(1, 200_000 // n)
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            c = np.array([made[i] for i in part], dtype=np.int64)
            high, mid = c << 12, c << 6
            total = np.zeros(len(part))
            for j, k in _spans(n):
                total += DECAY ** (k + 1) * table[high[:, :n - k] | mid[:, j:n - k + j] | c[:, k:]].sum(axis=1)
            out[part] += total / np.sqrt(_size(n))
    return out


@dataclass
class Model:
    """``table`` and ``bias`` of the word decision; ``curve`` of the document score."""

    table: np.ndarray
    bias: float
    curve: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[1:] + self.curve[0], -30, 30)))


def fit_svm(positive: list[bytes], negative: list[bytes], landmarks: list[bytes], cost: float = 50.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weight table and bias of a squared-hinge SVM on Nystroem features, classes of equal weight."""
    words = positive + negative
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(negative)))
    maps = [phi(w) for w in landmarks]
    tables = np.zeros((len(landmarks), 1 << 18), dtype=np.float32)
    for t, (at, w) in zip(tables, maps):
        np.add.at(t, at, w)
    kernel = lambda some: np.column_stack([decide(some, t, 0.0) for t in tables])
    values, vectors = np.linalg.eigh(kernel(landmarks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.column_stack([kernel(words) @ root, np.ones(len(words))])
    w = np.zeros(z.shape[1])
    seen, t = w, 1.0
    lipschitz = 1e-3 + 2 * cost * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2
    for _ in range(steps):  # accelerated gradient
        slack = np.maximum(0, 1 - y * (z @ seen))
        gradient = 1e-3 * np.r_[seen[:-1], 0] - 2 * cost * z.T @ (weight * y * slack)
        new = seen - gradient / lipschitz
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    beta = root @ w[:-1]
    return (beta.astype(np.float32) @ tables).astype(np.float64), float(w[-1])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps; first value is the intercept."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        penal = ridge * np.r_[0, np.ones(z.shape[1] - 1)]
        change = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penal + 1e-9), z.T @ (y - p) - penal * b)
        b = b + change
        if np.abs(change).max() < 1e-9:
            break
    return b


class Scorer:
    """Decisions of words with a bounded cache, and features of texts."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.known: dict[bytes, float] = {}

    def features(self, texts: list[str | None], names: int = 0) -> Iterator[tuple]:
        """Largest decision, mean of the three largest, log of one plus the number above zero and above one; then the top words."""
        for lo in range(0, len(texts), 64):
            sets = [words_of(t) for t in texts[lo:lo + 64]]
            new = list({w for s in sets for w in s if w not in self.known})
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known = {}
                new = list(set().union(*sets))
            if new:
                self.known.update(zip(new, decide(new, self.table, self.bias).tolist()))
            for s in sets:
                values = np.fromiter(map(self.known.__getitem__, s), dtype=np.float64, count=len(s))
                if not len(values):
                    yield (-2.0, -2.0, 0.0, 0.0, 0.0, []) if names else (-2.0, -2.0, 0.0, 0.0, 0.0)
                    continue
                top = np.sort(values)[::-1][:3]
                above = int((values > 0).sum())
                row = (float(top[0]), float(top.mean()), float(np.log1p(above)), float(np.log1p((values > 0.8).sum())), above / len(values))
                if names:
                    row += (sorted(s, key=lambda w: (-self.known[w], w))[:names],)
                yield row


FEATURES = ("largest", "top", "above", "far", "portion")


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = [w.decode("utf-8", "replace") for w in words_of(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label] * len(words), pa.int64())], names=["word", "toxic"])


def _described(table: np.ndarray, bias: float, names: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table, bias)
        for batch in batches:
            rows = list(scorer.features(batch.column(1).to_pylist(), names))
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            words = [[w.decode("utf-8", "replace") for w in r[len(FEATURES)]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, pa.array(words, pa.list_(pa.string()))],
                                             names=["toxic", *FEATURES, "words"])

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = 4000,
          n_positive: int = 400, n_negative: int = 2500, n_landmarks: int = 240) -> Model:
    """``labels``: id and 0/1 of the rows to learn from.  At most ``per_class`` labelled documents of either kind
    (least hashes of their ids) are read; words and features of these alone reach the driver."""
    rows = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(toxic).cast("bigint").alias("toxic"))
    some = [rows.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    chosen = some[0].unionByName(some[1]).dropDuplicates(["id"])
    sample = F.broadcast(chosen).join(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id").select("toxic", "text").persist()
    try:
        per = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = per.get(1, 0), per.get(0, 0)
        if not n1 or not n0:
            share = n1 / (n0 + n1) if n0 + n1 else 0.5
            odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
            return Model(np.zeros(1 << 18), 0.0, np.r_[odds, np.zeros(len(FEATURES))])
        counts = sample.mapInArrow(_word_sets, "word string, toxic bigint").groupBy("word").agg(
            F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        expected = n1 * (F.col("c") + 0.5) / (n0 + 1)  # toxic texts with the word, were it as frequent as in clean ones
        tied = counts.withColumn("z", (F.col("t") - expected) / F.sqrt(expected + 1)).where("z > 4")
        positive = [r["word"].encode() for r in tied.orderBy(F.desc("z"), "word").limit(n_positive).select("word").collect()]
        frequent = counts.where((F.col("c") >= 2) & (F.col("t") < 1.5 * expected + 1)).orderBy(F.desc("c"), "word").limit(n_negative).select("word").collect()
        negative = [r["word"].encode() for r in frequent]
        if not positive or not negative:
            return Model(np.zeros(1 << 18), 0.0, np.r_[np.log(n1 / n0), np.zeros(len(FEATURES))])
        gapped = [w[:i] + x + w[i:] for w in positive if len(w) > 4 and w.isascii() for x in (b"0", b"x") for i in range(1, len(w))]
        known = set(positive)
        made = f"toxic bigint, {', '.join(f'{f} double' for f in FEATURES)}, words array<string>"
        for last in (False, True):
            landmarks = positive[:n_landmarks // 2] + negative[:n_landmarks // 4] + negative[-(n_landmarks // 4):]
            table, bias = fit_svm(positive + gapped, negative, list(dict.fromkeys(landmarks)))
            told = sample.mapInArrow(_described(table, bias, 3), made)
            if last:
                told = told.drop("words").toPandas()
            else:
                hard = told.where("toxic = 0").select(F.explode("words").alias("word")).distinct()
                extra = [r["word"].encode() for r in hard.collect()]
                negative = list(dict.fromkeys(negative + sorted(w for w in extra if w not in known)))
        x, y = told[list(FEATURES)].to_numpy(), told["toxic"].to_numpy(dtype=float)
        return Model(table, bias, fit_curve(x, y))
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            rows = np.array(list(scorer.features(batch.column(1).to_pylist()))).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, score double")


_held: list[tuple[bytes, Scorer]] = []


def _scorer(model: Model) -> Scorer:
    """One scorer per worker and model, so that its cache serves all tasks of the worker."""
    name = model.curve.tobytes() + np.float64(model.bias).tobytes()
    if not _held or _held[0][0] != name:
        _held[:] = [(name, Scorer(model.table, model.bias))]
    return _held[0][1]


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted``; only labels of rows not held out are read.

    A row without an id is not held out, and no label is its own.
    """
    model = train(docs, labels.where(in_training(F.col("doc_id"))), **options)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
