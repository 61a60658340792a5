"""Quality classifier: random-indexing word vectors, pooled per document, under a
two-layer network with temperature-calibrated probabilities."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.stable import stable
from .text import body

TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+|\n")


class Buckets:
    """Hash bucket of each token of a text. A word in capitals has its own bucket
    beside the same word in lower case; digits count as 0."""

    def __init__(self, n, remember=500_000):
        self.n, self.remember, self.known = n, remember, {}

    def __call__(self, text):
        if len(self.known) > self.remember:
            self.known = {}
        tokens = TOKEN.findall(text)
        for t in [t for t in set(tokens) if t not in self.known]:
            shape = "A" if t.isupper() and len(t) > 1 else ""
            plain = re.sub("[0-9]", "0", t.lower())
            self.known[t] = zlib.crc32((shape + plain).encode("utf-8", "replace")) % self.n
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))


def index_vectors(buckets, dims, nonzero=4, seed=7):
    """(places, signs) of each bucket's sparse ternary index vector."""
    r = np.random.default_rng(seed)
    return (r.integers(0, dims, (buckets, nonzero)), r.choice([-1, 1], (buckets, nonzero)))


def word_vectors(docs: DataFrame, buckets: int, dims: int, window: int = 2) -> np.ndarray:
    """Sums of the index vectors of all neighbours up to ``window`` places away,
    over all texts, made to unit length. Each task sums its own texts; the result
    has ``buckets`` x ``dims`` numbers however large the corpus is."""
    places, signs = index_vectors(buckets, dims)
    names = [f"v{i}" for i in range(dims)]

    def run(batches):
        of, total = Buckets(buckets), np.zeros(buckets * dims)
        held, size = [], 0

        def add():
            b = np.concatenate(held)
            for d in range(1, window + 1):
                # texts are apart by ``window`` gaps of -1
                left, right = b[:-d], b[d:]
                ok = (left >= 0) & (right >= 0)
                for one, other in ((left[ok], right[ok]), (right[ok], left[ok])):
                    at = (one[:, None] * dims + places[other]).ravel()
                    total[:] += np.bincount(at, signs[other].ravel(), buckets * dims)

        gap = np.full(window, -1, np.int64)
        for batch in batches:
            texts = batch.column("body")
            for i in range(len(texts)):
                held += [of(texts[i].as_py()), gap]
                size += len(held[-2])
                if size > 500_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        sums = total.reshape(buckets, dims)
        used = np.flatnonzero(np.any(sums != 0, axis=1))
        yield pa.record_batch([pa.array(used), *[pa.array(sums[used, i]) for i in range(dims)]],
                              ["bucket", *names])

    schema = "bucket long, " + ", ".join(f"{n} double" for n in names)
    got = (docs.select(body("text").alias("body")).mapInArrow(run, schema)
           .groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas())
    out = np.zeros((buckets, dims), np.float32)
    if len(got):
        v = got[names].to_numpy(np.float64)
        out[got["bucket"]] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``x``: the mean word vector over tokens, over distinct tokens, the
    logarithm of the number of tokens and the share of distinct ones (float32)."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    keep = [c for c in docs.columns if c != "body"]

    def run(batches):
        v = shared.value
        of = Buckets(len(v))
        for batch in batches:
            texts, out = batch.column("body"), np.zeros((batch.num_rows, 2 * v.shape[1] + 2), "<f4")
            for i in range(len(texts)):
                b = of(texts[i].as_py())
                if len(b):
                    count = np.bincount(b, minlength=1)
                    kinds = np.flatnonzero(count)
                    out[i] = [*(count[kinds] @ v[kinds] / len(b)), *v[kinds].mean(0),
                              np.log1p(len(b)), len(kinds) / len(b)]
            yield pa.record_batch([*[batch.column(c) for c in keep],
                                   pa.array([row.tobytes() for row in out], pa.binary())], [*keep, "x"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "x binary"]))


def _matrix(column):
    rows = [np.frombuffer(x, "<f4") for x in column]
    return np.stack(rows).astype(np.float64)


class Network:
    """Two layers: tanh units, one logistic output. The temperature is the one
    under which rows that the weights were not fitted on are likeliest."""

    def __init__(self, x, y, hidden=32, epochs=60, batch=256, rate=3e-3, decay=1e-3, seed=11):
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        apart, fit = order[:len(y) // 5], order[len(y) // 5:]
        if len(set(y[fit])) < 2:  # nothing to tell apart: the share of ones
            self.constant = (y.sum() + 1) / (len(y) + 2)
            return
        self.constant = None
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        x = (x - self.mean) / self.scale
        w = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
             r.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        m, s, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            mixed = r.permutation(fit)
            for at in range(0, len(mixed), batch):
                rows = mixed[at:at + batch]
                h = np.tanh(x[rows] @ w[0] + w[1])
                err = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[rows]) / len(rows)
                back = np.outer(err, w[2]) * (1 - h * h)
                grads = [x[rows].T @ back + decay * w[0] / 10, back.sum(0), h.T @ err + decay * w[2] / 10, err.sum(keepdims=True)]
                step += 1
                for p, g, a, b in zip(w, grads, m, s):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if len(apart):
            z, t = self._logit((x[apart])), np.exp(np.linspace(-1, 2.5, 141))
            margin = np.where(y[apart] == 1, z, -z)
            self.temperature = float(t[np.argmin([np.logaddexp(0, -margin / u).mean() for u in t])])

    def _logit(self, x):
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3][0]

    def __call__(self, x):
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self._logit((x - self.mean) / self.scale) / self.temperature))


def score(docs: DataFrame, labels: DataFrame, train, label: str = "quality", buckets: int = 1 << 14,
          dims: int = 48, most: int = 20_000, **network) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are left out): doc_id and
    ``score``, the calibrated probability of label 1.

    ``train`` is the condition on doc_id of the documents whose labels may be
    learned; of those about ``most``, chosen by a hash of doc_id, are fitted on.
    Word vectors come from all texts. Null labels are left out. A null or empty
    text has no words and gets the network's score of a zero vector. Repeated
    rows get equal scores. An empty table gives no rows; without labels of both
    kinds every score is the smoothed share of ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body("text").alias("body"))
    features = stable(pooled(rows, word_vectors(docs, buckets, dims)), "features")
    marked = (labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .filter(train))
    n = marked.count()
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))
    got = (features.join(marked.filter(some), "doc_id").select("doc_id", "y", "x").toPandas()
           .sort_values("doc_id", kind="stable"))
    y = got["y"].to_numpy(np.float64)
    x = _matrix(got["x"]) if len(got) else np.zeros((0, 2 * dims + 2))
    model = Network(x, y, **network)

    def run(batches):
        for batch in batches:
            p = model(_matrix(batch.column("x").to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")
