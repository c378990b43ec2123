"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. From all pairs of a preferred and a rejected document
the weights are learnt by logistic loss on the feature differences; a quantile of the training
documents' strengths (the share of rejected ones) becomes the threshold, and a logistic of the
distance to it the score, so that score >= 0.3 says the same as strength >= threshold.

All labelled documents teach: their features are written in blocks of rows, and each round of the descent (L-BFGS, until nothing is
left to gain) reads them twice. The sums over all pairs come from the strengths' distributions on a grid of STEP, between whose points
they are interpolated, so their cost grows with the rows, not the pairs. The driver gets sums only. Scoring reads whole texts of all documents, batch
by batch, without a shuffle.

Defined results: null text scores as the empty text; null keys are scored and never held out; repeated keys are
scored each by its text; labels that are null, or whose key is null or unknown, teach nothing, and those of a repeated key teach once for
each label it has, by the text whose features sort first; how rows are dealt to partitions changes no score; with labels of one kind only,
all scores are 0.5 or 0.1 (all preferred, all rejected); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from strataframe.llm.common import WORDS, at_places, fold, free, materialize, slices, tables

#: Rows of a block of training rows, about; the grid's step; the share of the loss that a round must still promise to gain; rounds between second derivatives.
BLOCK, STEP, GAIN, RENEW = 2048, 1 / 32, 1e-3, 4
CUT = 0.3
KNOTS = (0.05, 0.2, 0.5, 0.8, 0.95)


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of each ASCII character class, repetition of lines, words and word pairs, and lengths."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256).astype(float)
    n = max(1.0, raw.sum())
    words = WORDS.findall(text)
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    low = [w.lower() for w in words]
    pairs = list(zip(low, low[1:], strict=False))
    triples = list(zip(low, low[1:], low[2:], strict=False))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    tails = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)
    return np.array(
        [
            *(raw[33:48] / n), *(raw[58:65] / n), *(raw[91:97] / n), *(raw[123:127] / n),
            raw[48:58].sum() / n, raw[65:91].sum() / n, raw[97:123].sum() / n, raw[128:].sum() / n, raw[32] / n, raw[10] / n,
            upper / k, tails / k, sum(map(len, words)) / k, sum(len(w) > 12 for w in words) / k, sum(len(w) == 1 for w in words) / k,
            len(set(low)) / k, len(set(pairs)) / max(1, len(pairs)), len(set(triples)) / max(1, len(triples)), len(set(lines)) / max(1, len(lines)),
            np.log1p(len(words)), np.log1p(len(lines)), np.log1p(k / max(1, len(lines))), float(not words),
        ],
        np.float32,
    )


@dataclass
class Ranker:
    """Knots, scale and weights of the strengths, the threshold and the slope of the score."""

    knots: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        hinges = [np.maximum(x - k, 0) for k in self.knots]
        return (np.concatenate([x, *hinges, x > 0], axis=1) - self.mean) / self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = (self.basis(x) * self.weights).sum(axis=1)  # row by row, so the batch a row comes in changes no bit
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.threshold) + np.log(CUT / (1 - CUT)), -35, 35)))


class Rows:
    """Training rows in memory, as one block."""

    def __init__(self, x: np.ndarray, preferred: np.ndarray):
        self.x, self.preferred = x, preferred

    def each(self, f: Callable) -> list[np.ndarray]:
        """f(features, preferred) of each block, in the order of blocks."""
        return [np.asarray(f(self.x, self.preferred), float)]

    def total(self, f: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Keys and their whole numbers, summed over the blocks; f gives keys and numbers."""
        return tally(f(self.x, self.preferred))

    def at(self, f: Callable, places: Callable[[int], list[float]]) -> np.ndarray:
        """Order statistics of each column of f(features): a row per place."""
        columns = np.sort(f(self.x).astype(float), axis=0)
        return np.array([[np.interp(p, np.arange(len(c)), c) for c in columns.T] for p in places(len(columns))])


class Blocks(Rows):
    """Training rows in a table of blocks, which labelled() makes."""

    def __init__(self, table: DataFrame):
        self.table = table

    def each(self, f: Callable) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, x, preferred in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.asarray(f(x, preferred), float).tobytes()], pa.binary())], ["block", "out"])

        return [np.frombuffer(r.out) for r in sorted(self.table.mapInArrow(run, "block long, out binary").collect(), key=lambda r: r.block)]

    def total(self, f: Callable) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n = np.zeros(0, np.int64), np.zeros(0)
            for _, x, preferred in _blocks(batches):
                keys, n = tally((keys, n), f(x, preferred))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, n)], ["keys", "n"])

        some = self.table.coalesce(64).mapInArrow(run, "keys binary, n binary").collect()  # whole numbers add up alike in any order
        return tally(*((np.frombuffer(r.keys, np.int64), np.frombuffer(r.n)) for r in some))

    def at(self, f: Callable, places: Callable[[int], list[float]]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, x, _ in _blocks(batches):
                v = f(x).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(v.shape[1], dtype=np.int32), len(v))), pa.array(v.ravel())], ["g", "v"])

        found = at_places(self.table.mapInArrow(run, "g int, v double"), ["g"], places)
        return np.array([found[g] for g in sorted(found)]).T


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, preferred, x = (c[i] for c in batch.columns)
            y = np.frombuffer(preferred.as_py(), bool)
            yield block.as_py(), np.frombuffer(x.as_py(), np.float32).reshape(len(y), -1), y


def tally(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in parts)]), len(keys))


def clipped(r: Ranker, x: np.ndarray) -> np.ndarray:
    return np.clip(r.basis(x), -20, 20)


Sums = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def pair_sums(rows: Rows, r: Ranker, w: np.ndarray) -> tuple[float, float, Sums]:
    """Means over all pairs of a preferred and a rejected row: of the loss, of its second derivative, and for both kinds (rejected
    first) points of strength with the mean, over all rows of the other kind, of both derivatives there."""

    def grid(x: np.ndarray, preferred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = (clipped(r, x) * w).sum(axis=1) / STEP
        low = np.floor(s)
        up = np.rint((s - low) * 65536)
        return np.concatenate([low, low + 1]).astype(np.int64) * 2 + np.tile(preferred, 2), np.concatenate([65536 - up, up])

    key, n = rows.total(grid)
    key, n = key[n > 0], n[n > 0]
    (bad, m), (good, k) = ((key[key % 2 == i] // 2, n[key % 2 == i] / n[key % 2 == i].sum()) for i in (0, 1))
    loss, worse, better, bent, turned = 0.0, np.zeros(len(bad)), np.zeros(len(good)), np.zeros(len(bad)), np.zeros(len(good))
    for a in range(0, len(good), 1024):
        d = (bad[None] - good[a : a + 1024, None]) * STEP
        wrong = np.exp(-np.logaddexp(0, -d))
        loss += float(k[a : a + 1024] @ np.logaddexp(0, d) @ m)
        better[a : a + 1024] = -(wrong @ m)
        worse += k[a : a + 1024] @ wrong
        turned[a : a + 1024] = wrong * (1 - wrong) @ m
        bent += k[a : a + 1024] @ (wrong * (1 - wrong))
    return loss, float(bent @ m), [(bad * STEP, worse, bent), (good * STEP, better, turned)]


def slope_of(rows: Rows, r: Ranker, w: np.ndarray, sums: Sums, counts: np.ndarray) -> np.ndarray:
    """The gradient of the mean loss of all pairs."""

    def pull(x: np.ndarray, preferred: np.ndarray) -> np.ndarray:
        b = clipped(r, x)
        s = (b * w).sum(axis=1)
        own = [np.interp(s, *sums[i][:2]) / counts[i] for i in (0, 1)]
        return np.where(preferred, own[1], own[0]) @ b

    return np.sum(rows.each(pull), axis=0)


def spread(rows: Rows, r: Ranker, w: np.ndarray, sums: Sums) -> np.ndarray:
    """The mean product of the pairs' basis differences, each row weighted by its second derivative. In whole numbers, which add
    up alike in any order (below 2**53 for 2**29 rows)."""
    width = len(r.mean)
    upper = np.triu_indices(width + 1)

    def products(x: np.ndarray, preferred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = clipped(r, x)
        s = (b * w).sum(axis=1)
        b = np.rint(np.concatenate([b, np.ones((len(x), 1))], axis=1) * 64)
        both = []
        for i, (points, _, bend) in enumerate(sums):
            own = b[preferred == i]
            weight = np.ceil(np.interp(s[preferred == i], points, bend) / bend.max() * 4095)
            both.append(((own * weight[:, None]).T @ own)[upper])
        return np.arange(2 * len(both[0])), np.concatenate(both)

    m = np.zeros((2, width + 1, width + 1))
    m[:, upper[0], upper[1]] = m[:, upper[1], upper[0]] = rows.total(products)[1].reshape(2, -1)
    m /= m[:, -1:, -1:]
    cross = np.outer(m[0, :-1, -1], m[1, :-1, -1])
    return m[0, :-1, :-1] + m[1, :-1, :-1] - cross - cross.T


def descend(rows: Rows, r: Ranker, counts: np.ndarray, l2: float) -> np.ndarray:
    """The weights of the least mean loss of all pairs plus l2 / 2 times their squares, until a round promises to gain less than GAIN
    of the loss: L-BFGS, which begins from spread() as the second derivative, and anew every RENEW rounds."""
    w, past = np.zeros(len(r.mean)), []
    loss, bend, sums = pair_sums(rows, r, w)
    g = slope_of(rows, r, w, sums, counts)
    for done in itertools.count():
        if done % RENEW == 0:
            start = np.linalg.inv(bend * spread(rows, r, w, sums) + l2 * np.eye(len(w)))
        d, steps = -g, []
        for s, y in reversed(past):
            steps.append(s @ d / (s @ y))
            d = d - steps[-1] * y
        d = start @ d
        for (s, y), a in zip(past, reversed(steps), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        t, gain = 1.0, -float(g @ d)
        while t * gain > GAIN * loss:
            new = w + t * d
            after, bend, sums = pair_sums(rows, r, new)
            after += l2 / 2 * float(new @ new)
            if after <= loss - 1e-4 * t * gain:
                break
            t /= 2
        else:
            break
        slope = slope_of(rows, r, new, sums, counts) + l2 * new
        if (new - w) @ (slope - g) > 1e-12:
            past = [*past[-19:], (new - w, slope - g)]
        w, loss, g = new, after, slope
    return w


def flat(all_preferred: bool) -> Ranker:
    """For labels of one kind, or none: one score for all texts."""
    width = len(features(""))
    knots, wide = np.zeros((len(KNOTS), width)), width * (2 + len(KNOTS))
    aim = 0.5 if all_preferred else 0.1
    return Ranker(knots, np.zeros(wide), np.ones(wide), np.zeros(wide), float(np.log(CUT / (1 - CUT)) - np.log(aim / (1 - aim))), 1.0)


def fit_rows(rows: Rows, l2: float = 1e-3) -> Ranker:
    """Strengths from all pairs of a preferred and a rejected row; knots, means and the threshold from all rows."""
    counts = np.sum([(0, 0), *rows.each(lambda x, y: ((~y).sum(), y.sum()))], axis=0)
    if not counts.all():
        return flat(not counts[0])
    n, cut = int(counts.sum()), int(counts[0])
    knots = rows.at(lambda x: x, lambda n: [q * (n - 1) for q in KNOTS]).astype(np.float32)
    r = Ranker(knots, np.float32(0), np.float32(1), np.zeros(0), 0.0, 1.0)
    r.mean = np.sum(rows.each(lambda x, y, r=r: r.basis(x).sum(axis=0, dtype=float)), axis=0) / n
    r.scale = np.maximum(np.sqrt(np.sum(rows.each(lambda x, y: (r.basis(x) ** 2).sum(axis=0)), axis=0) / n), 1e-3)
    r.weights = w = descend(rows, r, counts, l2)
    strength = lambda x: (clipped(r, x) * w).sum(axis=1)
    r.threshold = t = float(rows.at(lambda x: strength(x)[:, None], lambda n: [cut - 0.5])[0, 0])
    r.slope = float(4 / max(1e-6, np.sum(rows.each(lambda x, y: [np.abs(strength(x) - t).sum()])) / n))
    return r


def fit(x: np.ndarray, preferred: np.ndarray, pairs: int | None = None, seed: int = 7, l2: float = 1e-3, steps: int = 400) -> Ranker:
    """fit_rows() of rows in memory. With `pairs`, which queries don't give: so many drawn pairs, by gradient descent with momentum."""
    x, preferred = np.asarray(x, np.float32), np.asarray(preferred, bool)
    if pairs is None or not len(x) or preferred.all() or not preferred.any():
        return fit_rows(Rows(x, preferred), l2)
    r = Ranker(np.quantile(x, KNOTS, axis=0), np.float32(0), np.float32(1), np.zeros(0), 0.0, 1.0)
    b = r.basis(x)
    r.mean, r.scale = b.mean(axis=0), np.maximum(b.std(axis=0), 1e-3)
    b = np.clip((b - r.mean) / r.scale, -20, 20)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, v = np.zeros(b.shape[1]), np.zeros(b.shape[1])
    for step in range(steps):
        s = b @ w
        g = -1 / (1 + np.exp(np.clip(s[i] - s[j], -35, 35))) / pairs
        pull = np.bincount(i, g, len(b)) - np.bincount(j, g, len(b))
        v = 0.9 * v - (0.3 if step < steps // 2 else 0.1) * (pull @ b + l2 * w)
        w += v
    r.weights = w
    s = np.sort(b @ w)
    cut = int((~preferred).sum())
    r.threshold = float((s[cut - 1] + s[cut]) / 2)
    r.slope = float(4 / max(1e-6, np.abs(s - r.threshold).mean()))
    return r


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as _key and the features of each text as f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t) for t in batch.column(1).to_pylist()]
            at = np.arange(len(x) + 1, dtype=np.int32) * len(features(""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, np.concatenate([np.zeros(0, np.float32), *x]))], ["_key", "f"])

    some = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return some.mapInArrow(run, some.select("_key").schema.add("f", ArrayType(FloatType())))


def labelled(seen: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", block: int = BLOCK) -> DataFrame:
    """Features and labels of all labelled keys of seen, a table of featured(), in blocks of about `block` rows; of a key's
    several texts, the one whose features sort first. Which rows a block has, and in which order, depends on no partitions."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) > 0).alias("_label")).distinct()
    blocks = max(1, math.ceil(known.count() / block))
    one = seen.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("f").alias("f")).join(known, "_key")
    place = F.xxhash64("_key")

    def pack(table: pa.Table) -> pa.Table:
        place, label = table.column("place").to_numpy(), table.column("_label").to_numpy()
        x = table.column("f").combine_chunks().flatten().to_numpy().reshape(len(place), -1)
        order = np.lexsort((*x.T, label, place))
        return pa.table([table.column("block")[:1], pa.array([label[order].tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary())], ["block", "preferred", "x"])

    return one.select(F.pmod(place, F.lit(blocks)).alias("block"), place.alias("place"), "_label", "f").groupBy("block").applyInArrow(pack, "block long, preferred binary, x binary")


def score(docs: DataFrame, ranker: Ranker, key: str = "doc_id", text: str = "text", keep: bool = False, into: str = "score") -> DataFrame:
    """Adds a score under the name `into`; keep: all columns of docs stay (its own one of that name excepted), else the
    key alone."""
    cols = [c for c in docs.columns if c != into] if keep else [key]
    at = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            s = ranker.score(np.array([features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(s, pa.float64())], [*cols, into])

    schema = docs.select(*cols).schema.add(into, "double")
    return docs.select(*cols, F.col(text).alias(free(docs, "_scored_text"))).mapInArrow(run, schema)


def score_features(seen: DataFrame, ranker: Ranker, key: str = "doc_id", into: str = "score") -> DataFrame:
    """The key and the score of each row of a table of featured()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(x) if len(x) else np.zeros(0), pa.float64())], [key, into])

    return seen.mapInArrow(run, seen.select(F.col("_key").alias(key)).schema.add(into, "double"))


def train_features(seen: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Ranker:
    """The ranker of all labelled rows of a table of featured()."""
    with tables(seen.sparkSession):
        return fit_rows(Blocks(materialize(labelled(seen, labels, key, label), "quality-training")))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranker:
    return train_features(featured(docs, key, text), labels, key, label)


def held(key: Column) -> Column:
    return F.coalesce(fold(key, 5) == 0, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = materialize(featured(docs), "quality-features")
    ranker = train_features(seen, labels.where(~held(F.col("doc_id"))))
    return score_features(seen, ranker).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
