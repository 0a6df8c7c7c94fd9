"""Quality grades by ordinal cumulative-link regression on hashed text features.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector over hashed word, gap and
shape features of whole texts, shared by all ordered thresholds. The model is fitted
in one task on at most ``max_rows`` labelled documents (those with the smallest
hashes of their ids); scoring is one Arrow pass without a shuffle.

Grades come from ``labels``: 0 for low quality, 1 for toxic, 2 for all others; any
other integer grades work as well.

Defined cases: null and empty texts have no features and get the grade of the
thresholds alone; without labels, or with a single grade, all documents get
expected grade 0 or that grade; extra columns are ignored; repeated rows are all scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.llm import np_text as T

BUCKETS = 1 << 14
MAX_ROWS = 12_000


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket indices and values (log-scaled shares, unit length) of every text."""
    buf, bounds = T.buffer_of(texts)
    starts, ends, hashes = T.word_spans(buf, bounds)
    first = T.words_per_text(starts, bounds)
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(len(bounds) - 1)]
    # What stands between two words, at most eight bytes of it, and how the word begins.
    after = np.minimum(np.append(starts[1:], len(buf)), ends + 8)
    gap = np.zeros(len(starts), np.uint64)
    for k in range(8):
        at = ends + k
        gap = gap * np.uint64(257) + np.where(at < after, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint64)
    upper = (buf[starts] >= 65) & (buf[starts] <= 90)
    shouted = upper & (buf[ends - 1] >= 65) & (buf[ends - 1] <= 90) & (ends - starts > 1)
    shape = upper.astype(np.uint64) + 2 * shouted.astype(np.uint64)
    again = np.zeros(len(starts), np.uint64)
    again[1:] = hashes[1:] == hashes[:-1]
    size = np.minimum(ends - starts, 24).astype(np.uint64)
    kinds = [hashes, gap + np.uint64(1 << 56), shape + np.uint64(2 << 56), again + np.uint64(3 << 56), size + np.uint64(4 << 56)]
    slots = [(T.mix(x) % np.uint64(BUCKETS)).astype(np.int64) for x in kinds]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        index, counts = np.unique(np.concatenate([s[a:b] for s in slots]), return_counts=True)
        value = np.log1p(100.0 * counts / (b - a))
        out.append((index, value / np.sqrt((value**2).sum())))
    return out


def grades_of(labels: DataFrame) -> Column:
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


class CumulativeLink:
    """The fitted model: levels (sorted grades), weights and ordered thresholds."""

    def __init__(self, levels: list[int], weights: np.ndarray, thetas: np.ndarray) -> None:
        self.levels, self.weights, self.thetas = levels, weights, thetas

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thetas - self.weights[index] @ value, -40, 40)))

    def expected(self, tails: np.ndarray) -> float:
        return float(self.levels[0] + np.diff(self.levels) @ tails) if len(self.levels) > 1 else float(self.levels[0] if self.levels else 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> CumulativeLink:
    """AdaGrad on the all-threshold logistic loss; thresholds are kept in order."""
    levels = sorted({g for _, _, g in rows})
    k = max(0, len(levels) - 1)
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    theta = np.linspace(-0.5, 0.5, k) if k > 1 else np.zeros(k)
    gt = np.full(k, 1e-8)
    if not k:
        return CumulativeLink(levels, w, theta)
    rng = np.random.default_rng(seed)
    sign = {g: np.where(np.arange(k) < r, 1.0, -1.0) for r, g in enumerate(levels)}
    total = np.array([sum(g == lv for *_, g in rows) for lv in levels], float)
    weight = {lv: min(4.0, len(rows) / (len(levels) * n)) for lv, n in zip(levels, total, strict=True)}
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, value, g = rows[i]
            value = value.astype(float)
            z = w[index] @ value - theta
            s = sign[g]
            d = weight[g] * -s / (1 + np.exp(np.clip(s * z, -40, 40)))  # d loss / d z
            step = d.sum() * value + l2 * w[index]
            gw[index] += step**2
            w[index] -= rate * step / np.sqrt(gw[index])
            gt += d**2
            theta = np.sort(theta + rate * 0.1 * d / np.sqrt(gt))
    return CumulativeLink(levels, w, theta)


def fitted(docs: DataFrame, graded: DataFrame, max_rows: int) -> CumulativeLink:
    """The model of the labelled documents with the smallest id hashes, max_rows at most.

    One task holds their features and fits; only the model travels to the driver.
    """
    picked = graded.filter("_grade IS NOT NULL AND _lid IS NOT NULL").groupBy("_lid").agg(F.max("_grade").alias("_grade"))
    picked = picked.orderBy(F.xxhash64("_lid"), "_lid").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in T.parts(whole, 1)):
            rows = features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0].astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())], ["grade", "index", "value"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            index, value = ([np.frombuffer(x.as_buffer(), kind) if x.as_buffer().size else np.zeros(0, kind) for x in batch.column(i)] for i, kind in ((1, "<u2"), (2, "<f4")))
            rows += zip(index, value, batch.column(0).to_pylist(), strict=True)
        model = fit(sorted(rows, key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes())))
        parts = (pa.array([model.levels], pa.list_(pa.int32())), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thetas.tobytes()], pa.binary()))
        yield pa.RecordBatch.from_arrays(list(parts), ["levels", "weights", "thetas"])

    text = docs.join(F.broadcast(picked), docs["_id"].cast("string") == picked["_lid"].cast("string")).select(F.col("_grade").cast("int"), "_text")
    found = text.mapInArrow(run, "grade int, index binary, value binary").repartition(1).mapInArrow(learn, "levels array<int>, weights binary, thetas binary").first()
    return fit([]) if found is None else CumulativeLink(list(found.levels), np.frombuffer(found.weights), np.frombuffer(found.thetas))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, grade: Column | None = None, at_least: int = 1, label_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, _key, expected_grade, p_at_least (tail probability), predicted grade."""
    graded = labels.select(F.col(label_id).alias("_lid"), (grades_of(labels) if grade is None else grade).cast("int").alias("_grade"))
    model = fitted(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), graded, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.levels, model.weights, model.thetas))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CumulativeLink(*shared.value)
        cut = sum(lv < at_least for lv in own.levels) - 1
        for batch in (part for whole in batches for part in T.parts(whole, 1)):
            expected, tail, best = [], [], []
            for index, value in features(batch.column(1)):
                t = own.tails(index, value)
                expected.append(own.expected(t))
                tail.append(1.0 if cut < 0 or not own.levels else 0.0 if cut >= len(t) else float(t[cut]))
                p = -np.diff(np.concatenate([[1.0], t, [0.0]]))
                best.append(int(own.levels[int(np.argmax(p))]) if own.levels else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(best, pa.int32())], ["doc_id", "_key", "expected_grade", "p_at_least", "grade"])

    own = docs.select(F.col(doc_id), F.col(text), F.xxhash64(F.col(text)))
    return own.mapInArrow(run, f"doc_id {kind}, _key bigint, expected_grade double, p_at_least double, grade int")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose probability of a grade of at least 1 reaches the threshold, with all their columns."""
    bad = score_quality(docs, labels, doc_id, text).filter(F.col("p_at_least") < threshold).select(F.col("doc_id").alias("__tm_bad"), F.col("_key").alias("__tm_bad_key")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("__tm_bad")) & (F.xxhash64(F.col(text)) == F.col("__tm_bad_key"))
    return docs.join(bad, same, "left_anti")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_at_least", 6).alias("p_at_least"), "grade", (F.col("p_at_least") >= 0.5).alias("selected"))
