"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at its ends) and of itself, hashed to BUCKETS vectors. A text's
vector is the mean over all n-grams of all its words; a softmax of two classes reads it. Vectors and softmax are learned
together by minibatch Adam. A misspelling that training never saw shares most n-grams with the word, and so its vectors.
A few words decide, also in a long text: training runs first on whole texts, then on the window of WINDOW words of each
text that the first model scores highest; a text's score is that of its highest window, and every window is scored.

Training reads at most SAMPLE labelled texts of each class, the first by a hash of their ids and texts, and never a held-out
row (crc32 of the id mod 5 is 0). The sample takes one text of each id, whole. Its texts stay in the executors, which hash them to
bags and pick their highest windows; the driver gets a bag of BUCKETS shares at most for each. The class ratio of all
labelled training ids then corrects the bias.

Defined results: a null or wordless text scores as the bias alone; repeated rows score alike; with no labelled rows of
one class, every score is that of an untrained model, the smoothed class ratio. Rows whose label is null are not used; an
id with both labels counts as toxic. Of an id with several texts, the first by hash is sampled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_map

#: Labelled rows of each class that training reads at most.
SAMPLE = 3000
BUCKETS, DIMENSIONS = 1 << 16, 8
SHORTEST, LONGEST = 3, 5
EPOCHS, BATCH, RATE = 4, 64, 0.03
WINDOW, WINDOW_EPOCHS, ROUNDS = 32, 10, 2
#: A text's mean is small beside its rare words; the factor lets small vectors move it.
SCALE = 20.0
#: Keeps Adam from moving n-grams of few texts as far as those of many.
SOFT = 5e-3
SEED = 7
#: Words whose sums a Python worker remembers.
REMEMBERED = 400_000
HELD_OUT = 5


def grams(word: str) -> list[int]:
    """The buckets of a word's n-grams and of the word."""
    w = f"<{word}>"
    out = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in range(SHORTEST, LONGEST + 1):
        out += [zlib.crc32(w[k : k + n].encode("utf-8", "surrogatepass")) % BUCKETS for k in range(len(w) - n + 1)]
    return out


def bag(words: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of some words and their shares of all the words' n-grams. Memory grows with the distinct words."""
    parts, times = [], Counter(words)
    for w in times:
        if w not in known:
            if len(known) > REMEMBERED:
                known.clear()
            known[w] = np.array(grams(w), np.int32)
        parts.append(known[w])
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    n = np.bincount(np.concatenate(parts), np.repeat(list(times.values()), [len(p) for p in parts]))
    ids = np.flatnonzero(n)
    return ids.astype(np.int32), (n[ids] / n.sum()).astype(np.float32)


class Bags:
    """Bags in two arrays, six bytes an entry: places of buckets among those that occur, and shares."""

    def __init__(self, bags: Iterable[tuple[np.ndarray, np.ndarray]]):
        ids, shares, size = bytearray(), bytearray(), []
        for i, share in bags:
            ids += i.astype(np.uint16).tobytes()
            shares += share.astype(np.float32).tobytes()
            size.append(len(i))
        self.ids, self.shares = np.frombuffer(ids, np.uint16), np.frombuffer(shares, np.float32)
        self.size = np.array(size, np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def ordered(self, order: np.ndarray) -> "Bags":
        """The bags in another order; the arrays stay as they are."""
        self.size, self.begin = self.size[order], self.begin[order]
        return self


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dimensions
    softmax: np.ndarray  # dimensions x 2
    bias: np.ndarray  # 2
    #: Class 1 minus class 0 of every bucket: the softmax of a mean is the mean of these, and the bias.
    lean: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lean = (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)

    def score(self, mean_lean: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(mean_lean + float(self.bias[1] - self.bias[0]), -500, 500))))


def train(bags: Bags | list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, positives: int, negatives: int, epochs: int, scale: float, start: Model | None = None) -> Model:
    """bags and labels of the sample; positives and negatives: the classes' sizes among all labelled training rows."""
    r = np.random.default_rng(SEED)
    vectors = (r.standard_normal((BUCKETS, DIMENSIONS)) * 0.01).astype(np.float32)
    softmax = (r.standard_normal((DIMENSIONS, 2)) * 0.1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if start is not None:
        vectors, softmax = (start.vectors / scale).astype(np.float32), start.softmax.copy()
    if 0 < labels.sum() < len(labels):
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        bags = bags if isinstance(bags, Bags) else Bags(bags)
        size, begin = bags.size, bags.begin
        place = np.zeros(BUCKETS, np.int32)
        place[bags.ids] = 1
        buckets = np.flatnonzero(place)  # others have no gradient
        place[buckets] = np.arange(len(buckets))
        used = vectors[buckets]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (used, softmax, bias)]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(labels))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                n = size[some]
                at = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i, share, owner = place[bags.ids[at]], bags.shares[at] * np.float32(scale), np.repeat(np.arange(len(some)), n)
                rows = used[i] * share[:, None]
                mean = np.stack([np.bincount(owner, rows[:, j], len(some)) for j in range(DIMENSIONS)], 1)
                z = mean @ softmax + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), labels[some]] -= 1
                p *= (weight[some] / len(some))[:, None]
                grown = (p @ softmax.T)[owner] * share[:, None]
                g = np.stack([np.bincount(i, grown[:, j], len(buckets)) for j in range(DIMENSIONS)], 1)
                step += 1
                for par, grad, (m, v) in zip((used, softmax, bias), (g, mean.T @ p, p.sum(0)), state, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    par -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + SOFT)).astype(np.float32)
        vectors[buckets] = used
    vectors = vectors * np.float32(scale)
    bias = bias.astype(np.float64)
    bias[1] += np.log((positives + 1) / (negatives + 1))
    return Model(vectors, softmax, bias)


class Scorer:
    """Scores texts; remembers each word's sum and count."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def words(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """The lean sums and the n-gram counts of each text's words."""
        if len(self.place) > REMEMBERED:
            self.place, self.sums, self.counts = {}, np.zeros(0), np.zeros(0)
        split = [words_of(t) for t in texts]
        new: dict[str, None] = {}
        for ws in split:
            new.update(dict.fromkeys(ws))
        fresh = [w for w in new if w not in self.place]
        if fresh:
            bags = [grams(w) for w in fresh]
            n = np.array([len(b) for b in bags])
            owner = np.repeat(np.arange(len(fresh)), n)
            sums = np.bincount(owner, self.model.lean[np.concatenate([np.array(b) for b in bags])], len(fresh))
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.sums, self.counts = np.concatenate([self.sums, sums]), np.concatenate([self.counts, n])
        places = [np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws)) for ws in split]
        return [(self.sums[at], self.counts[at]) for at in places]

    def __call__(self, texts: list) -> list[tuple[float]]:
        return [(self.model.score(windows(*x)[1]),) for x in self.words(texts)]


def windows(sums: np.ndarray, counts: np.ndarray) -> tuple[int, float]:
    """Where the highest of a text's windows begins (they overlap by half), and its mean lean."""
    if not len(sums):
        return 0, 0.0
    at = np.arange(0, max(len(sums) - WINDOW // 2, 1), WINDOW // 2)
    end = np.minimum(at + WINDOW, len(sums))
    s, n = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    mean = (s[end] - s[at]) / (n[end] - n[at])
    best = int(np.argmax(mean))
    return int(at[best]), float(mean[best])


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def highest(texts: list, scorer: Scorer, known: dict) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """The bag of each text's highest window."""
    for k in range(0, len(texts), 64):
        for t, x in zip(texts[k : k + 64], scorer.words(texts[k : k + 64]), strict=True):
            at = windows(*x)[0]
            yield bag(words_of(t)[at : at + WINDOW], known)


def rounds(whole: Callable[[], Bags], top: Callable[[Model], Bags], labels: np.ndarray, positives: int, negatives: int) -> Model:
    """Training on whole texts, then on each text's highest window."""
    model = train(whole(), labels, positives, negatives, EPOCHS, SCALE)
    for _ in range(ROUNDS):
        model = train(top(model), labels, positives, negatives, WINDOW_EPOCHS, SCALE, model)
    return model


def fit(texts: list, labels: np.ndarray, positives: int, negatives: int) -> Model:
    """rounds() over texts that are at hand."""
    known: dict = {}
    return rounds(lambda: Bags(bag(words_of(t), known) for t in texts), lambda m: Bags(highest(texts, Scorer(m), known)), labels, positives, negatives)


def gathered(rows: DataFrame, bags: Callable[[], Callable[[list], Iterable[tuple]]]) -> Bags:
    """The bags of the sample's texts, made by the executors; one partition after another comes to the driver."""

    def make():
        some = bags()
        return lambda texts: ((i.astype(np.uint16).tobytes(), share.tobytes()) for i, share in some(texts))

    made = saved(text_map(rows, ["doc_id", "toxic"], "text", "buckets binary, shares binary", make, rows=64), "toxicity-bags")
    keys = []

    def each():
        for r in made.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"), "buckets", "shares").toLocalIterator():  # 2 * SAMPLE rows at most
            keys.append((r["toxic"], r["h"], r["doc_id"]))
            yield np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32)

    out = Bags(each())
    return out.ordered(np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64))


def fit_rows(rows: DataFrame, positives: int, negatives: int) -> Model:
    """rounds() over the sample (doc_id, toxic, text), whose texts stay in the executors."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    labels = np.repeat([0, 1], [counts.get(0, 0), counts.get(1, 0)])

    def whole():
        known: dict = {}
        return lambda texts: (bag(words_of(t), known) for t in texts)

    def top(model: Model):
        shared = rows.sparkSession.sparkContext.broadcast((model.lean, model.bias))

        def make():
            lean, bias = shared.value
            scorer, known = Scorer(Model(lean[:, None], np.array([[0.0, 1.0]]), bias)), {}
            return lambda texts: highest(texts, scorer, known)

        return gathered(rows, make)

    return rounds(lambda: gathered(rows, whole), top, labels, positives, negatives)


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """The bounded sample of both classes (doc_id, toxic, text), and the sizes of both classes among all labelled training ids."""
    trained = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT != 0
    known = labels.where(F.col("toxic").isin(0, 1) & trained).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.where(trained).select("doc_id", F.col("text").cast("string").alias("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    some = [there.where(F.col("toxic") == c).orderBy(*order).limit(SAMPLE) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * SAMPLE ids
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return saved(rows, "toxicity-sample"), sizes.get(1, 0), sizes.get(0, 0)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list, np.ndarray, int, int]:
    """sampled(), with the texts and their classes in order, for fit()."""
    rows, positives, negatives = sampled(docs, labels)
    found = rows.orderBy("toxic", F.xxhash64("doc_id"), "doc_id").collect()
    return [r["text"] for r in found], np.array([r["toxic"] for r in found], np.int64), positives, negatives


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row. The model has a fixed size, whatever the input: BUCKETS numbers for scoring."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lean.astype(np.float32), model.bias))

    def make():
        lean, bias = shared.value
        return Scorer(Model(lean[:, None].astype(np.float64), np.array([[0.0, 1.0]]), bias))

    return text_map(docs, [key], text, "score double", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_rows(*sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
