"""Toxicity: bags of character n-grams, embedded, averaged, and classified by a linear softmax, all trained jointly in numpy.

A text is read in windows of 24 words, so an insult weighs as much in a long text as in a short one. A window's vector is
the mean of the embeddings of its words' character 3- to 5-grams (hashed to buckets, word edges marked; a word that follows
itself counts once), so a misspelling shares most vectors with the word it comes from. Labels belong to whole documents: training starts with every window under
its document's label, then keeps, of toxic documents, only the windows that the model holds toxic (the best one at least).
A document's score is that of its most toxic window, set to probabilities by a logistic fit on a part kept from training.

Training reads a bounded sample of labelled rows: at most `toxic_rows` and `clean_rows` documents, first by a hash of their
ids, with their whole texts, so that the logistic fit sees the same maximum as a score. Scoring covers whole texts too: with embeddings and softmax multiplied
out, each bucket adds one number to its window, so the model that goes to the tasks has one number a bucket.

Defined cases: null, empty and word-less texts get the score of an empty bag (the logistic fit's value for the softmax bias);
rows that repeat are scored one by one; labels that are null or neither 0 nor 1 are not learned from; a label without a
document does nothing; without toxic or without clean labels every score is the share of toxic labels; a null doc_id is not
held out.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_or_empty
from .words import powers

WINDOW = 24
GRAMS = (3, 4, 5)
BITS = 17
SLICE_CHARS = 500_000
#: Empty n-grams in every mean, so that few words say little.
PRIOR = 60
#: Which characters part words: all ASCII ones but letters and digits; place 128 stands for all others.
PARTS = np.array([not chr(i).isalnum() for i in range(128)] + [False])
FACTORS = (powers(8)[1:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@dataclass
class Grams:
    """The n-grams of some texts: by size, a bucket and whether one counts, at every place of the texts' characters."""

    text: np.ndarray  # of each window
    begin: np.ndarray  # of each window: its first place
    buckets: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str], window: int = WINDOW) -> "Grams":
        texts = [t.lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(texts) + " " * max(GRAMS)).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([1 + len(t) for t in texts])  # the separator after each text
        n = len(codes) - max(GRAMS)
        part = PARTS[np.minimum(codes, 128)]
        begins = np.flatnonzero(~part[1:] & part[:-1])  # the place before each word
        none = np.empty(0, np.int64)
        if not len(begins):
            return cls(none, none, [], [])
        lengths = np.flatnonzero(part[1:] & ~part[:-1]) - begins
        value = np.where(part, np.uint32(1), codes + np.uint32(2))
        buckets, counts, spread, h = [], [], [], value * FACTORS[0]
        solid = ~part
        inner = solid[1 : n + 1].copy()  # are all characters but the first and the last letters?
        for size in range(2, max(GRAMS) + 1):
            h = h[:-1] + value[size - 1 :] * FACTORS[size - 1]
            if size >= GRAMS[0]:
                if size > GRAMS[0]:
                    inner = inner & solid[size - 2 : n + size - 2]
                x = (h[:n] ^ (h[:n] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                spread.append(x)
                buckets.append(((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)).astype(np.int32))
                counts.append(inner)
        # a word that follows itself counts once
        head, tail = value[begins + 1], spread[0][begins + np.maximum(lengths - 1, 0)]
        for size, x in zip(GRAMS, spread, strict=True):  # the longest n-gram from the word's edge that ends within it
            head = np.where(lengths >= size - 1, x[begins], head)
        text = np.searchsorted(ends, begins + 1, "right")
        same = np.zeros(len(begins), bool)
        same[1:] = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1]) & (lengths[1:] == lengths[:-1]) & (text[1:] == text[:-1])
        if same.any():
            echo = np.zeros(n + 1, np.int32)
            np.add.at(echo, begins[same], 1)
            np.add.at(echo, begins[same] + lengths[same], -1)
            fresh = np.cumsum(echo[:n]) == 0
            counts = [c & fresh for c in counts]
            begins, text = begins[~same], text[~same]
        total = np.bincount(text, minlength=len(texts))
        place = np.arange(len(text)) - np.searchsorted(text, text)
        new = (place % window == 0) & ((place == 0) | (place + window <= total[text]))  # the last window takes the rest
        return cls(text[new], begins[new], buckets, counts)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, bucket) of each n-gram, by window."""
        found = []
        for b, c in zip(self.buckets, self.counts, strict=True):
            at = np.flatnonzero(c)
            found.append((np.searchsorted(self.begin, at, "right") - 1, b[at]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        window, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(window, kind="stable")
        return window[order], bucket[order]


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts): runs of about SLICE_CHARS characters, or one longer text."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


class Bags:
    """The n-grams of the windows of training texts: one bucket each, four bytes, those of one window together."""

    def __init__(self, texts: list[str]):
        self.texts = len(texts)
        bucket = np.empty(len(GRAMS) * (sum(map(len, texts)) + len(texts)), np.int32)  # room for an n-gram of each size at each place
        text, count, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for first, part in slices(texts):
            grams = Grams.of(part)
            window, found = grams.lists()
            bucket[n : n + len(found)] = found
            n += len(found)
            text.append(grams.text + first)
            count.append(np.bincount(window, minlength=len(grams.text)))
        self.bucket, self.text, self.count = bucket[:n], np.concatenate(text), np.concatenate(count)
        self.begin = np.cumsum(self.count) - self.count

    def gathered(self, windows: np.ndarray) -> np.ndarray:
        """The buckets of some windows, one window after the other."""
        sizes = self.count[windows]
        return self.bucket[np.repeat(self.begin[windows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def logits(self, model: "Model", step: int = 4096) -> np.ndarray:
        """The log-odds of each window."""
        out = np.empty(len(self.count))
        for low in range(0, len(out), step):
            sizes = self.count[low : low + step]
            start = int(self.begin[low])
            weights = model.weights[self.bucket[start : start + int(sizes.sum())]]
            out[low : low + step] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights, len(sizes)) / (sizes + PRIOR)
        return out + model.bias

    def best(self, logits: np.ndarray, bias: float) -> np.ndarray:
        """The log-odds of each text's most toxic window; without one, the bias."""
        out = np.full(self.texts, -np.inf)
        np.maximum.at(out, self.text, logits)
        return np.where(np.isfinite(out), out, bias)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: embedding times the difference of the softmax's rows
    bias: float
    slope: float
    shift: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of each text: the softmax log-odds of its most toxic window."""
        grams = Grams.of(texts)
        if not len(grams.begin):
            return np.full(len(texts), self.bias)
        weights = self.weights.astype(np.float32)
        total = sum(weights[b] * c for b, c in zip(grams.buckets, grams.counts, strict=True))
        count = sum(c.astype(np.int32) for c in grams.counts)
        odds = np.add.reduceat(total, grams.begin) / (np.add.reduceat(count, grams.begin) + PRIOR) + self.bias
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, grams.text, odds)
        return np.where(np.isfinite(best), best, self.bias)

    def score(self, texts: list[str]) -> np.ndarray:
        logits = np.concatenate([np.empty(0), *(self.logits(part) for _, part in slices(texts))])
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a weighted logistic regression on one number, by Newton steps."""
    features, theta = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])

    def loss(t: np.ndarray) -> float:
        z = features @ t
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * ((t - [1, 0]) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -40, 40)))
        gradient = features.T @ (weight * (p - y)) + ridge * (theta - [1, 0])
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        step, now = np.linalg.solve(hessian, gradient), loss(theta)
        while np.abs(step).max() > 1e-9 and loss(theta - step) > now:
            step = step / 2
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(texts: list[str], toxic: np.ndarray, share: float, size: int = 4, epochs: int = 6, batch: int = 1024, rate: float = 0.5, seed: int = 7) -> Model:
    """share: of toxic documents among labelled ones, before sampling."""
    random = np.random.default_rng(seed)
    kept = random.random(len(texts)) < 0.2  # for the logistic fit
    bags = Bags(texts)
    text, count = bags.text, bags.count
    table = (random.random((1 << BITS, size), dtype=np.float32) - 0.5) / size
    soft = (random.random((2, size)) - 0.5).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    seen, seen_soft, seen_bias = np.full((1 << BITS, size), 1e-6, np.float32), np.full((2, size), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    model = Model(np.zeros(1 << BITS), 0.0, 1.0, 0.0)

    def current() -> Model:
        return Model((table @ (soft[1] - soft[0])).astype(np.float64), float(bias[1] - bias[0]), model.slope, model.shift)

    for epoch in range(epochs):
        use = ~kept[text] & (count > 0)
        if epoch:
            now = current()
            logit = bags.logits(now)
            use &= ~toxic[text] | (logit >= np.minimum(bags.best(logit, now.bias)[text], 0))
        chosen = random.permutation(np.flatnonzero(use))
        for low in range(0, len(chosen), batch):
            w = chosen[low : low + batch]
            sizes = count[w]
            b = bags.gathered(w)
            mean = np.add.reduceat(table[b], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / (sizes + PRIOR)[:, None]
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.stack([~toxic[text[w]], toxic[text[w]]], 1)).astype(np.float32) / len(w)
            inner = np.repeat((g @ soft) / (sizes + PRIOR)[:, None], sizes, axis=0) * np.float32(len(w))
            step_soft, step_bias = g.T @ mean, g.sum(0)
            step = np.stack([np.bincount(b, inner[:, d], 1 << BITS) for d in range(size)], 1).astype(np.float32)
            hit = np.unique(b)
            s = step[hit]
            seen[hit] += s * s
            table[hit] -= rate * s / np.sqrt(seen[hit])
            for x, dx, sx in ((soft, step_soft, seen_soft), (bias, step_bias, seen_bias)):
                sx += dx * dx
                x -= 0.1 * rate * dx / np.sqrt(sx)
    model = current()
    held = np.flatnonzero(kept)
    y = toxic[held].astype(float)
    if 0 < y.sum() < len(y):
        weight = np.where(toxic[held], share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
        model.slope, model.shift = fit_logistic(bags.best(bags.logits(model), model.bias)[held], y, weight)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[list[str], np.ndarray, float]:
    """(texts, toxic, share of toxic labels) of a bounded sample of labelled documents. labels: doc_id, toxic."""
    good = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND _id IS NOT NULL")
    share = good.agg(F.avg("toxic")).first()[0]
    if share is None:
        return [], np.empty(0, bool), 0.0
    by_hash = F.xxhash64("_id", F.lit(11))
    sample = good.where("toxic = 1").orderBy(by_hash).limit(toxic_rows).unionByName(good.where("toxic = 0").orderBy(by_hash).limit(clean_rows))
    # bounded by toxic_rows + clean_rows
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    found = rows.select("text", "toxic", "_id").toPandas()
    found = found.sort_values(["_id", "text"], kind="stable")
    return found["text"].tolist(), found["toxic"].to_numpy() == 1, float(share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                clean = shared.value.score([t or "" for t in part.column(at).to_pylist()]) < threshold
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(kept, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2500, clean_rows: int = 2500) -> Model:
    """A model from the labels (doc_id, toxic) of docs."""
    texts, toxic, share = training_rows(docs, labels, toxic_rows, clean_rows)
    if not toxic.any() or toxic.all():
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))), 1.0, 0.0)
    return train(texts, toxic, min(max(share, 1e-3), 1 - 1e-3))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, kept_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels of held-out rows are not learned from."""
    model = fit(docs, labels.where(remainder(F.col("doc_id"), modulus) != kept_out))
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == kept_out, F.lit(False))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
