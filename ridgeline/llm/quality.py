"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words. Every passage is encoded by what it says and how it looks: the mean of
learned vectors of its hashed words and word pairs, and its surface statistics, through a hidden layer. Gated attention
(tanh times sigmoid) gives each passage a weight; the weighted sum of encodings gives the document's score. All
parameters are learned together from document labels by Adam in numpy, in one task on whole texts of a bounded number
of labelled rows; the driver gets the model alone.

Null and empty text: one passage without words, scored like any other. Very long texts: all passages are encoded and
weighted, in training too. Repeated rows: each scored, one trained on. Ties: none in a weighted sum. Columns besides
those named are dropped, so their names can't clash. Rows without a key: scored, with a null key. Empty table: empty
result. No labels of both classes: every score 0.5. A label row with a null label or key, or whose document is missing,
is ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import hash_words, map_rows, mix64
from ridgeline.llm.toxicity import sample, trained

PASSAGE = 64
#: Bound of the training sample: labelled documents of each class. Their texts are trained on whole.
SAMPLE = 2000
HIDDEN, GATE = 16, 8
N_FEATURES = 14
#: Classes of hashed words and word pairs.
BUCKETS = 1 << 15

# Byte classes.
_CLASS = np.zeros((8, 256), np.int32)
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!", b".,;:?'\"()-", b"\n", bytes(range(0x80, 0x100)))):
    _CLASS[_row, list(_chars)] = 1
_KIND = np.full(256, 8, np.int64)
for _row in range(8):
    _KIND[_CLASS[_row] > 0] = _row


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of N_FEATURES numbers, all between 0 and about 1, for each passage; the classes of all words and pairs, and how many each passage has."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    solid = np.ones(256, bool)
    solid[[32, 9, 10, 11, 12, 13]] = False
    inside = solid[b]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(b) else np.zeros(0, int)
    n = max(1, -(-len(starts) // PASSAGE))
    out = np.zeros((n, N_FEATURES))
    if not len(starts):
        return out, np.zeros(0, np.int64), np.zeros(n, np.int64)
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    sizes = ends - starts
    word = hash_words(b[inside], sizes)
    cuts = np.append(starts[::PASSAGE], len(b))
    passage = np.repeat(np.arange(n), np.diff(cuts))
    kinds = np.bincount(passage * 9 + _KIND[b[cuts[0] :]], minlength=9 * n).reshape(n, 9)
    size = np.maximum(1, np.diff(cuts))
    letters = np.maximum(1, kinds[:, 0] + kinds[:, 1])
    out[:, 0] = kinds[:, 0] / letters
    out[:, 1:8] = np.minimum(1, kinds[:, 1:8] / size[:, None] * np.array([1, 5, 5, 5, 5, 10, 2]))
    of = np.arange(len(word)) // PASSAGE
    m = np.bincount(of, minlength=n)
    # Words and pairs by their numbers within the text: how many a passage has of each.
    code = np.unique(word, return_inverse=True)[1]
    pair = np.unique(code[:-1] * len(word) + code[1:], return_inverse=True)[1]
    inner = of[:-1] == of[1:]
    distinct, count = np.unique(of * len(word) + code, return_counts=True)
    out[:, 8] = m / PASSAGE
    out[:, 9] = np.bincount(distinct // len(word), minlength=n) / m
    out[:, 10] = np.bincount(of[:-1][inner & (code[:-1] == code[1:])], minlength=n) / m
    most = np.zeros(n, np.int64)
    np.maximum.at(most, distinct // len(word), count)
    out[:, 11] = most / m
    out[:, 12] = np.bincount(of, sizes, minlength=n) / m / 16
    out[:, 13] = np.bincount(np.unique((of[:-1] * len(word) + pair)[inner]) // len(word), minlength=n) / np.maximum(1, m - 1)
    both = np.stack([word, np.append(mix64(word[:-1] * np.uint64(3) + word[1:]), np.uint64(0))], axis=1) % np.uint64(BUCKETS)
    there = np.ones(both.shape, bool)
    there[:, 1] = np.append(inner, False)
    return out, both[there].astype(np.int64), m + np.bincount(of[:-1][inner], minlength=n)


Bag = tuple[np.ndarray, np.ndarray, np.ndarray]


def joined(bags: list[Bag]) -> Bag:
    return tuple(np.concatenate(x) for x in zip(*bags))


class Model:
    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {
            "E": r.normal(0, 0.4, (N_FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "W": np.zeros((BUCKETS, HIDDEN)),
            "V": r.normal(0, 0.4, (HIDDEN, GATE)), "U": r.normal(0, 0.4, (HIDDEN, GATE)), "w": r.normal(0, 0.4, GATE),
            "c": r.normal(0, 0.4, HIDDEN), "b": np.zeros(1),
        }

    def means(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The mean vector of each passage's words and pairs; zero for those that training never met, and without words."""
        out = np.zeros((len(counts), HIDDEN))
        some = counts > 0
        if some.any():
            out[some] = np.add.reduceat(self.p["W"][classes], (np.cumsum(counts) - counts)[some]) / counts[some, None]
        return out

    def forward(self, bag: Bag, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The logit of each document; its passages are those from its start to the next."""
        p = self.p
        x, classes, counts = bag
        sizes = np.diff(np.append(starts, len(x)))
        of = np.repeat(np.arange(len(starts)), sizes)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + self.means(classes, counts) + p["e"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (tv * su) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(h * a[:, None], starts)
        return z @ p["c"] + p["b"][0], {"x": x, "h": h, "tv": tv, "su": su, "a": a, "z": z, "of": of}

    def fit(self, bags: list[Bag], labels: np.ndarray, epochs: int = 30, batch: int = 64, seed: int = 11) -> Model:
        """Adam; the words' vectors move only where a batch meets them."""
        r = np.random.default_rng(seed)
        everything = np.concatenate([x for x, _, _ in bags])
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.where(labels == 1, 0.5 / max(1e-9, (labels == 1).mean()), 0.5 / max(1e-9, (labels == 0).mean()))
        t = 0
        for epoch in range(epochs):
            mix = r.permutation(len(bags))
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for at in range(0, len(mix), batch):
                take = mix[at : at + batch]
                t += 1
                sizes = [len(bags[i][0]) for i in take]
                grads = self._grads(joined([bags[i] for i in take]), np.cumsum(sizes) - sizes, labels[take], weight[take])
                met = grads.pop("met")
                for k, g in grads.items():
                    rows = met if k == "W" else slice(None)
                    g = g + 1e-4 * self.p[k][rows]
                    a, b = m[k]
                    a[rows] += 0.1 * (g - a[rows])
                    b[rows] += 0.001 * (g * g - b[rows])
                    self.p[k][rows] -= rate * (a[rows] / (1 - 0.9**t)) / (np.sqrt(b[rows] / (1 - 0.999**t)) + 1e-8)
        if not all(np.isfinite(v).all() for v in self.p.values()):
            raise ArithmeticError("training diverged")
        return self

    def _grads(self, bag: Bag, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, s = self.forward(bag, starts)
        d = (1 / (1 + np.exp(-logit)) - y) * weight / len(y)
        of, h, a = s["of"], s["h"], s["a"]
        dz = d[:, None] * p["c"]
        dh = a[:, None] * dz[of]
        da = (h * dz[of]).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[of])
        dg = ds[:, None] * p["w"]
        dv, du = dg * s["su"] * (1 - s["tv"] ** 2), dg * s["tv"] * s["su"] * (1 - s["su"])
        dh = dh + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - h**2)
        _, classes, counts = bag
        met, where = np.unique(classes, return_inverse=True)
        back = np.repeat(de / np.maximum(1, counts)[:, None], counts, axis=0)
        dw = np.stack([np.bincount(where, back[:, k], len(met)) for k in range(HIDDEN)], axis=1) if len(met) else np.zeros((0, HIDDEN))
        return {"met": met, "W": dw, "E": s["x"].T @ de, "e": de.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (s["tv"] * s["su"]).T @ ds, "c": s["z"].T @ d, "b": np.array([d.sum()])}

    def score(self, text: str | None) -> float:
        logit, _ = self.forward(features(text), np.zeros(1, int))
        return float(1 / (1 + np.exp(-np.clip(logit[0], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held: Column, bound: int = SAMPLE) -> Model | None:
    return trained(sample(docs, labels, key, text, label, held, bound), lambda texts, y: Model().fit([features(t) for t in texts], y))


def score(df: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """key, score. The model has a fixed size (4 MB), so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch, rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.add(k, model.score(t) if model else 0.5)

        return step

    return map_rows(df.select(F.col(key).cast("long"), text), f"{key} long,score double", make)
