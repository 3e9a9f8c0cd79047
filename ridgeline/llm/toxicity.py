"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, hashed into a fixed number of vectors, so misspellings and inflections that
were never seen share most of their vectors with words that were. A span of SPAN words is the average of its words'
vectors; a linear softmax over two classes gives its probability, and a text scores as its most toxic span, so that a
few words in a long text count. Vectors and softmax are trained together by Adagrad. A label holds for a text: in each
round the spans of a toxic text that the present model finds most toxic stand for it, and all spans of the others are
negative; spans of toxic texts in between take no part. Last, softmax weights and bias are scaled together (temperature
and prior) on labelled texts kept from the vectors, as a text is a maximum of spans; scores are the softmax's own.

Training is one task's work on whole texts of a bounded number of labelled rows; the driver gets the model alone. An epoch
draws PICK spans of each kind at most, and no more than four hard negatives for a positive, from all spans of these texts;
what one epoch leaves out another may draw. Of sf0.1's held-out labels, 129 of 144 toxic texts are found with 18 of 1,200
others.

Null and empty text: the score of a span without words, which is that of the softmax's bias alone. Very long texts:
trained on and scored whole, span by span; very long words: all their n-grams count. Repeated rows: each scored, one
trained on. Ties: the score is a maximum, so none. Columns besides those named are dropped, so their names can't clash.
Rows without a key: scored, with a null key. Empty table: empty result. No labels of both classes: every score 0.
A label row with a null label or key, or whose document is missing, is ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import bounded, map_rows

BUCKETS, DIM, SPAN = 1 << 16, 8, 4
#: Bound of the training sample: labelled texts of each class. Their texts are trained on whole.
SAMPLE = 1500
#: Spans of each kind that an epoch draws from all of them; Adagrad's rates for vectors, softmax and bias, and what its sums start from.
PICK, SPEED, START = 12_000, (0.5, 0.02, 0.02), 1e-3
EDGES = "\"'()[]{}.,;:!?|*#$%&<>-_/\\~`+=^"


def words(text: str | None) -> list[str]:
    return [x for w in (text or "").lower().split() if (x := w.strip(EDGES))]


def grams(word: str) -> list[int]:
    """Buckets of the word's character 3- to 5-grams, with marks at both ends, and of the word."""
    marked = f"<{word}>"
    n = len(marked)
    raw = [marked[i : i + k] for k in (3, 4, 5) for i in range(n - k + 1)]
    raw.append(marked)
    return [_bucket(x) for x in raw]


def _bucket(x: str) -> int:
    h = crc32(x.encode("utf-8", "surrogatepass"))
    return (h ^ h >> 15) % BUCKETS


def spans_of(n: int) -> list[int]:
    """Where the spans of n words begin; each is followed by SPAN words, and neighbours overlap by half."""
    return list(range(0, max(1, n - SPAN // 2), SPAN // 2))


class Model:
    """Vectors start at zero, so an n-gram that training never met adds nothing."""

    def __init__(self, seed: int = 7) -> None:
        self.vectors = np.zeros((BUCKETS, DIM))
        self.weights = np.random.default_rng(seed).normal(0, 0.7, (DIM, 2))
        self.bias = np.array([1.0, -1.0])
        self.seen = [np.full_like(x, START) for x in (self.vectors, self.weights, self.bias)]

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def word_margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each word adds to the margin of class 1 over class 0: its average vector through the softmax's weights."""
        if not len(sizes):
            return np.zeros(0)
        values = (self.vectors @ (self.weights[:, 1] - self.weights[:, 0]))[flat]
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes

    def fit(self, texts: Iterable[list[str]], labels: list[int], rounds: int = 4, epochs: int = 4, batch: int = 256, seed: int = 7) -> Model:
        """Every fourth text is kept from the vectors and scales the softmax, so that a text's margin becomes a probability."""
        rng = np.random.default_rng(seed)
        vocabulary: dict[str, int] = {}
        rows, sizes = [], []
        for ws in texts:
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int32, len(ws))
            places = np.asarray(spans_of(len(ids)))[:, None] + np.arange(SPAN)
            rows.append(np.where(places < len(ids), np.append(ids, -1)[np.minimum(places, len(ids))], -1).astype(np.int32))
            sizes.append(len(rows[-1]))
        spans, owner, label = np.concatenate(rows), np.repeat(np.arange(len(labels)), sizes), np.asarray(labels)
        bags = [np.asarray(grams(w), np.int32) for w in vocabulary]
        sizes, flat = np.asarray([len(b) for b in bags]), np.concatenate(bags) if bags else np.zeros(0, np.int32)
        del rows, bags, vocabulary
        begins = np.cumsum(sizes) - sizes
        tuning = np.zeros(len(label), bool)
        for y in (0, 1):
            tuning[np.flatnonzero(label == y)[::4][: (label == y).sum() // 2]] = True
        mine = ~tuning[owner]
        negative = np.flatnonzero(mine & (label[owner] == 0))
        for turn in range(rounds):
            margin = self._margins(spans, flat, sizes)
            if turn == 0:
                positive = np.flatnonzero(mine & (label[owner] == 1))
            else:
                order = np.lexsort((-margin, owner))
                order = order[mine[order] & (label[owner[order]] == 1)]
                first = np.r_[True, owner[order][1:] != owner[order][:-1]]
                positive = order[first | (margin[order] > 1)]
            if not len(positive) or not len(negative):
                break
            hard = negative[np.argsort(-margin[negative], kind="stable")[: min(PICK, 4 * len(positive))]]
            for epoch in range(epochs):
                easy = rng.choice(negative, min(len(negative), PICK), replace=False)
                good = positive if len(positive) <= PICK else rng.choice(positive, PICK, replace=False)
                some = np.concatenate([good, np.union1d(hard, easy)])
                target = (np.arange(len(some)) < len(good)).astype(int)
                mix = rng.permutation(len(some))
                rate = 1 - (turn * epochs + epoch) / (rounds * epochs)
                for at in range(0, len(some), batch):
                    take = mix[at : at + batch]
                    self._step(spans[some[take]], target[take], flat, begins, sizes, rate)
        margin = self._margins(spans, flat, sizes)
        best = np.full(len(label), -np.inf)
        np.maximum.at(best, owner, margin)
        self._tune(best[tuning], label[tuning])
        self.seen = []  # only training needs it
        if not (np.isfinite(self.vectors).all() and np.isfinite(self.weights).all()):
            raise ArithmeticError("training diverged")
        return self

    def _margins(self, spans: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        word = np.append(self.word_margins(flat, sizes), 0.0)
        return word[spans].sum(axis=1) / np.maximum(1, (spans >= 0).sum(axis=1)) + self.bias[1] - self.bias[0]

    def _step(self, spans: np.ndarray, target: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rate: float) -> None:
        span, _ = np.nonzero(spans >= 0)
        word = spans[spans >= 0]
        count = np.bincount(span, minlength=len(spans))
        n = sizes[word]
        gram = flat[np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        of = np.repeat(span, n)
        share = np.repeat(1.0 / (count[span] * n), n)
        hidden = np.stack([np.bincount(of, self.vectors[gram, k] * share, len(spans)) for k in range(DIM)], axis=1)
        p = self.softmax(hidden @ self.weights + self.bias)
        p[np.arange(len(spans)), target] -= 1
        back = (p @ self.weights.T)[of] * share[:, None]
        met, where = np.unique(gram, return_inverse=True)  # the other vectors have no gradient
        pull = np.stack([np.bincount(where, back[:, k], len(met)) for k in range(DIM)], axis=1)
        for value, grad, seen, speed, rows in zip((self.vectors, self.weights, self.bias), (pull, hidden.T @ p, p.sum(axis=0)), self.seen, SPEED, (met, slice(None), slice(None))):
            seen[rows] += grad * grad
            value[rows] -= rate * speed * grad / np.sqrt(seen[rows])

    def _tune(self, margin: np.ndarray, label: np.ndarray) -> None:
        """Scales the softmax by a logistic regression of the label on the margin (Newton's method), which becomes its temperature and prior; toxic texts weigh half as much as the others together."""
        if len({*label.tolist()}) < 2:
            return
        x = np.stack([margin, np.ones(len(margin))], axis=1)
        weight = np.where(label == 1, 0.5 / (label == 1).sum(), 1 / (label == 0).sum())
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (weight * (p - label)) + 0.02 * np.array([w[0] - 1, 0])
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.02, 1e-6])
            w -= np.linalg.solve(hess, grad)
        if np.isfinite(w).all() and w[0] > 0:
            self.weights = self.weights * w[0]
            self.bias = np.array([0.0, w[0] * (self.bias[1] - self.bias[0]) + w[1]])


class Scorer:
    MEMO = 300_000

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}
        self.value = model.vectors @ (model.weights[:, 1] - model.weights[:, 0])
        self.edge = float(model.bias[1] - model.bias[0])

    def score(self, text: str | None) -> float:
        memo = self.memo
        ws = words(text)
        new = [w for w in dict.fromkeys(ws) if w not in memo]
        if new:
            if len(memo) >= self.MEMO:
                memo.clear()
                new = list(dict.fromkeys(ws))
            bags = [grams(w) for w in new]
            sizes = np.asarray([len(b) for b in bags])
            values = self.value[np.fromiter((x for b in bags for x in b), int)]
            memo.update(zip(new, (np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes).tolist()))
        margin = 0.0
        if ws:
            total = np.zeros(len(ws) + 1)
            np.cumsum(np.fromiter(map(memo.__getitem__, ws), float, len(ws)), out=total[1:])
            starts = np.asarray(spans_of(len(ws)))
            ends = np.minimum(starts + SPAN, len(ws))
            margin = float(((total[ends] - total[starts]) / (ends - starts)).max())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, margin + self.edge)))))  # class 1 of the softmax


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.crc32(key.cast("string")) % parts == part


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held: Column, bound: int) -> DataFrame:
    """_id, _y, _text of at most `bound` labelled rows of each class that aren't held out: those of least hash, so any input of a size gives as many.

    Of several rows of one id the least text counts, so repeated rows bring no more.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held).groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(label).alias("_y"))
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(bound) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * bound rows of two numbers, so it is broadcast
    found = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id").agg(F.first("_y").alias("_y"), F.min(F.coalesce("_text", F.lit(""))).alias("_text"))


def trained(rows: DataFrame, learn: Callable[[list[str], np.ndarray], object]) -> object | None:
    """What learn makes of the texts and labels of a bounded sample, in order of ids, in one task; None without both classes."""

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("_text").to_pylist()
            labels += batch.column("_y").to_pylist()
        model = learn(texts, np.asarray(labels)) if len({*labels}) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions("_id").select("_text", F.col("_y").cast("int"))
    models = one.mapInArrow(run, "model binary").toArrow()["model"]
    return pickle.loads(models[0].as_py()) if len(models) else None


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held: Column, bound: int = SAMPLE) -> Model | None:
    return trained(sample(docs, labels, key, text, label, held, bound), lambda texts, y: Model().fit(map(words, texts), y.tolist()))


def score(df: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """key, score. The model has a fixed size (about 2 MB), so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value) if shared.value is not None else None

        def step(batch, rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.add(k, scorer.score(t) if scorer else 0.0)

        return step

    return map_rows(df.select(F.col(key).cast("long"), text), f"{key} long,score double", make)


def keep(df: DataFrame, text: str, model: Model | None, below: float) -> DataFrame:
    """The rows, with all their columns, whose score is below the limit."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    bounded(df.sparkSession)
    place = df.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            yield batch.filter(pa.array([scorer is None or scorer.score(t) < below for t in batch.column(place).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
