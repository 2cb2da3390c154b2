"""A quality classifier: supervised subword embeddings.

A text is a bag of features: its words, the character n-grams of its words (with the spaces around a word as marks) and
a mark for each word that repeats the one before it. Each feature is hashed to a bucket with a learned
vector; a document is the mean of its features' vectors, a softmax layer gives the classes. Vectors and
layer are trained on the driver by stochastic gradient descent in numpy, from a bounded sample of labelled
rows (PER_CLASS for each class).

For scoring, vectors and layer fold into one number a bucket: the mean is linear, so the difference of two
logits is a sum over features. A text is then one pass over its bytes, with no cache and no list of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, doc_crc, fresh, map_texts, quoted
from .samples import bounded, sample_ids

PER_CLASS, BUCKET_BITS, DIMS, NGRAMS = 700, 16, 16, (2, 3, 4)
BUCKETS = 1 << BUCKET_BITS
EPOCHS, RATE, SEED = 12, 0.5, 6
#: A document is rejected below this: well under even odds, as clean documents must stay.
MIN_SCORE = 0.2
_REPEAT = BUCKETS  # the bucket of the mark for a repeated word


def _hash(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


#: A byte's weight in a word's hash goes by its place in the word, modulo the length of this table.
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)
#: Bytes of a text whose features are found at once; a longer text is cut at white space (at a run without any: anywhere).
SLICE = 500_000


def slices(text: str) -> list[str]:
    """A text in parts of at most SLICE characters, whose bags add up to its own. A word behind a cut at white space is told the word before by `bags`."""
    out, at = [], 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(c, at, at + SLICE) for c in " \n\t")
        stop = cut if cut > at else at + SLICE
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def bags(text: str) -> Iterator[np.ndarray]:
    """Buckets of all features of one text, slice by slice."""
    last: list[bytes] = []
    for part in slices(text):
        words = part.encode("utf-8", "surrogatepass").split(None, 1)
        if last and words and last[-1] == words[0]:
            yield np.array([_REPEAT])
        if words:
            last = part.encode("utf-8", "surrogatepass").rsplit(None, 1)[-1:]
        yield bag([part])[0]


def bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, and the text each one is of; in no fixed order."""
    rows = [b" " + b" ".join(t.encode("utf-8", "surrogatepass").split()) + b" " for t in texts]
    b = np.frombuffer(b"".join(rows), np.uint8)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = b.astype(np.uint64)
    space = b == 0x20
    buckets, owners = [], []
    key = wide.copy()
    blank = space.astype(np.int8)
    inner = np.zeros(len(b), np.int8)  # spaces strictly inside the n-gram that begins here
    for n in range(2, max(NGRAMS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        key = key[:m] << np.uint64(8) | wide[n - 1 :]
        if n > 2:
            inner = inner[:m] + blank[n - 2 : n - 2 + m]
        if n in NGRAMS:
            # a space may only be first or last, and not both; texts are parted by two spaces
            some = np.flatnonzero((inner[:m] == 0) & ~(space[:m] & space[n - 1 :]))
            buckets.append(_hash(key[some] + np.uint64(n << 40)))
            owners.append(owner[some])
    # words: a polynomial over their bytes
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(first):
        stop = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b)))) if first[0] == 0 else np.arange(len(b)) - np.concatenate([np.zeros(first[0], np.int64), np.repeat(first, np.diff(np.append(first, len(b))))])
        weighed = np.where(space, np.uint64(0), (wide + np.uint64(1)) * _POWERS[place % len(_POWERS)])
        word = np.add.reduceat(weighed, first, dtype=np.uint64)
        of = owner[first]
        buckets.append(_hash(word))
        owners.append(of)
        same = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1]) & ((stop - first)[1:] == (stop - first)[:-1])) + 1
        buckets.append(np.full(len(same), _REPEAT))
        owners.append(of[same])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """vectors: a row a bucket; layer: a column a class; classes: the labels in order."""

    classes: list[int] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, DIMS), np.float32))
    layer: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 0), np.float32))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def folded(self, good: int = 1) -> tuple[np.ndarray, float]:
        """One weight a bucket, and an offset, whose mean over a text's features is the log odds of class `good` (of two)."""
        if len(self.classes) < 2:
            return np.zeros(BUCKETS + 1, np.float32), 0.0
        g = self.classes.index(good) if good in self.classes else len(self.classes) - 1
        o = 1 - g
        return (self.vectors @ (self.layer[:, g] - self.layer[:, o])).astype(np.float32), float(self.offset[g] - self.offset[o])


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent, one document a step, in an order drawn anew each epoch; the rate falls to zero.

    bags: for each document its distinct buckets and their shares, which sum to 1.
    """
    rng = np.random.default_rng(seed)
    model = Model(classes=sorted(set(labels)))
    c = len(model.classes)
    model.vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS + 1, DIMS)).astype(np.float32)
    model.layer, model.offset = np.zeros((DIMS, c), np.float32), np.zeros(c, np.float32)
    if c < 2:
        return model
    target = [model.classes.index(x) for x in labels]
    weight = [len(labels) / (c * target.count(k)) for k in range(c)]
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            now = rate * (1 - done / steps)
            done += 1
            places, shares = bags[i]
            mean = shares @ model.vectors[places] if len(places) else np.zeros(DIMS, np.float32)
            logits = mean @ model.layer + model.offset
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[i]] -= 1
            p *= weight[target[i]]
            back = model.layer @ p
            model.layer -= now * np.outer(mean, p).astype(np.float32)
            model.offset -= (now * 0.1 * p).astype(np.float32)
            if len(places):
                # shares are small numbers; the vectors' rate makes up for it
                model.vectors[places] -= np.outer(shares * np.float32(now * 40), back).astype(np.float32)
    return model


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS + 1, np.int64)
    for buckets in bags(text):
        total += np.bincount(buckets, minlength=BUCKETS + 1)
    places = np.flatnonzero(total)
    counts = total[places]
    return places, (counts / max(1, counts.sum())).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Fit on a sample of labelled rows whose crc32(id as text) mod 3 isn't 1; of them only text and label are used.

    The sample's ids are chosen from the labels alone; documents are then read once, and a bag a document reaches the driver, for never more than 2 x per_class documents a class.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(doc_crc(F.col("id")) % 3 != 1)
    marked = marked.groupBy("id").agg(F.min("label").alias("label"))
    ids = sample_ids(marked, "id", F.col("label"), per_class, salt=6).select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    most = 2 * per_class * max(1, ids.select("__label").distinct().count())
    chosen = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(bounded(ids, most)), F.col("__doc") == F.col("__id")).select("__doc", "__label", "__text")

    def make():
        def work(texts):
            found = [shares(t or "") for t in texts]
            return {"places": [p.astype("<i4").tobytes() for p, _ in found], "shares": [s.astype("<f4").tobytes() for _, s in found]}

        return work

    rows = map_texts(bounded(chosen, most), ["__doc", "__label"], "__text", "places binary, shares binary", make).collect()
    rows.sort(key=lambda r: (r["__doc"], r["places"], r["shares"]))
    return fit([(np.frombuffer(r["places"], "<i4").astype(np.int64), np.frombuffer(r["shares"], "<f4")) for r in rows], [r["__label"] for r in rows])


def score_texts(texts: list[str], weights: np.ndarray, offset: float) -> list[float]:
    """Probability of the good class for each text; texts without features get that of the offset alone."""
    out = []
    for _, part in blocks(texts, SLICE):
        if len(part) == 1:
            # alone because it is long, or the last
            found = [(weights[b].sum(dtype=np.float64), len(b)) for b in bags(part[0])]
            total, count = np.array([sum(t for t, _ in found)]), np.array([sum(n for _, n in found)])
        else:
            buckets, owner = bag(part)
            total = np.bincount(owner, weights[buckets], minlength=len(part))
            count = np.bincount(owner, minlength=len(part))
        out += (1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + offset, -500, 500)))).tolist()
    return out


def _scored(docs: DataFrame, model: Model, keep: list[str], text_col: str, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())  # BUCKETS numbers

    def make():
        weights, offset = shared.value

        def work(texts):
            return {name: score_texts(texts, weights, offset)}

        return work

    return map_texts(docs, keep, text_col, f"{name} double", make)


def quality_table(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted): score every row's whole text; higher: label 1 likelier.

    Null texts are empty ones and get the score of no evidence; so does everything where fewer than two classes are labelled.
    Repeated rows and ids give a row each; an empty table an empty one. Null ids aren't held out, and labels without a document, or null ones, teach nothing.
    """
    scored = _scored(docs, train(docs, labels, text_col, id_col=id_col), [id_col], text_col, "score")
    held = F.coalesce(doc_crc(F.col(id_col)) % 3 == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that score below min_score. One pass; no text is shuffled.

    Each row is judged by its own text: null ones as empty, with the score of no evidence; null or repeated ids and extra columns of any name
    don't matter; an empty table stays one. Where fewer than two classes are labelled, nothing goes.
    """
    kept = docs.columns
    name = fresh("score", kept)
    return _scored(docs, train(docs, labels, text_col, id_col=id_col), kept, text_col, name).where(F.col(name) >= min_score).select(*quoted(kept))
