"""Cross-entropy difference of matched target and background n-gram models.

Both models are interpolated bigram models over one vocabulary, counted over all
documents (target: the rows marked as such). The vocabulary holds all words, and the
bigram table all pairs, that occur ``LEAST`` times at least, at every size. Rarer words
are <unk>, rarer pairs back off to the word. Counts are combined in each task before
the shuffle, so a word in every text is a row a batch.

Only the head of both tables is broadcast: the entries whose share of all tokens is at
least 1 / ``MAX_WORDS`` or 1 / ``MAX_PAIRS``, so there cannot be more than that many.
All others are looked up by a join: documents are dealt into batches of about ``DEALT``
tokens, each batch asks once for every key outside the head, and is scored with what
comes back. What is in the head changes no score.

Defined cases: null and wordless texts have no tokens and null scores; without target
rows both models are equal and all differences are 0; extra columns are ignored;
repeated rows count and are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm import np_text as T
from trailmesh.llm.lineage import removed
from trailmesh.llm.shuffles import stage_written

LEAST, DEALT = 2, 400_000
#: Batches are asked for and scored in so many rounds; Spark removes the shuffle files of a round before the next.
ROUNDS = 3
MAX_WORDS, MAX_PAIRS = 1 << 20, 1 << 21
BROADCAST_IDS = 2_000_000
#: Tokens that a task holds before it hands on their counts; keys leave their lowest bit free.
FLUSH, KEY = 1_000_000, np.uint64(0xFFFFFFFFFFFFFFFE)


def pair_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of (previous word, word); the first word of a text follows a start sign."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first[:-1][first[:-1] < len(hashes)]] = 1
    return T.mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(size, key, n, n_target) of all words (1) and pairs (2) of docs(_target, _text), and of all tokens (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            marks = sum(int((x & ~KEY).sum()) for x in held[0])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([marks], pa.int64())], ["size", "key", "n", "n_target"])
            for size in (0, 1):
                keys = np.concatenate([*held[size], np.zeros(0, np.uint64)])
                held[size].clear()
                keys.sort()  # the lowest bit marks the target
                own = keys & KEY
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(keys) else np.zeros(0, np.int64)
                own = own[at].view(np.int64)
                n = np.diff(np.append(at, len(keys)))
                target = np.add.reduceat((keys & ~KEY).view(np.int64), at) if len(at) else n
                del keys
                for a in range(0, len(at), 50_000):
                    b = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[b]), size + 1, np.int32)), pa.array(own[b]), pa.array(n[b]), pa.array(target[b])], ["size", "key", "n", "n_target"])

        for batch in batches:
            for part in T.parts(batch, 1, 2_000_000):
                buf, bounds = T.buffer_of(part.column(1))
                starts, _, hashes = T.word_spans(buf, bounds)
                first = T.words_per_text(starts, bounds)
                mark = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(first))
                held[0].append(hashes & KEY | mark)
                held[1].append(pair_keys(hashes, first) & KEY | mark)
                tokens += len(hashes)
                if tokens > FLUSH:
                    yield from flush()
                    tokens = 0
        yield from flush()

    rows = docs.select("_target", "_text").mapInArrow(run, "size int, key bigint, n bigint, n_target bigint")
    return rows.groupBy("size", "key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Table:
    """Sorted 64-bit keys with a bucket index: vectorised look-ups."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = [v[order] for v in values]
        self.shift = np.uint64(64 - max(4, min(22, int(np.ceil(np.log2(len(keys) + 2))) + 1)))
        self.bucket = np.searchsorted(self.keys[:-1], np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of every key, or -1."""
        keys = keys & KEY
        at = self.bucket[(keys >> self.shift).astype(np.int64)]
        active = np.flatnonzero(self.keys[at] < keys)
        while len(active):
            at[active] += 1
            active = active[self.keys[at[active]] < keys[active]]
        out = np.where((self.keys[at] == keys) & (at < len(self.keys) - 1), at, -1)
        return out


class MatchedModels:
    """Both interpolated bigram models over the shared vocabulary; the heads of their tables."""

    def __init__(self, words: tuple, pairs: tuple, totals: tuple[int, int], known: tuple[int, int], size: int, weight: float) -> None:
        """known: tokens of the vocabulary's words in either model; size: words of the vocabulary."""
        self.words, self.pairs, self.totals, self.size, self.weight = Table(*words), Table(*pairs), totals, size + 1, weight
        self.rest = [max(0, total - own) for total, own in zip(totals, known, strict=True)]  # tokens outside the vocabulary

    def missing(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of words and of pairs that are not in the heads."""
        keys = (np.unique(k & KEY) for k in (hashes, pair_keys(hashes, first)))
        return tuple(k[table.find(k) < 0] for k, table in zip(keys, (self.words, self.pairs), strict=True))

    def losses(self, hashes: np.ndarray, first: np.ndarray, words: Table, pairs: Table) -> list[np.ndarray]:
        """Bits of every token under the background and the target model; words and pairs: entries outside the heads."""
        seen = [(head.find(k), head, more.find(k), more) for k, head, more in ((hashes, self.words, words), (pair_keys(hashes, first), self.pairs, pairs))]
        (at, _, other, _), _ = seen
        out = []
        for k in (0, 1):
            count, joint = (np.where(i >= 0, np.append(head.values[k], 0)[i], np.append(more.values[k], 0)[j]).astype(float) for i, head, j, more in seen)
            low = (np.where((at >= 0) | (other >= 0), count, self.rest[k]) + 1.0) / (self.totals[k] + self.size)
            counts = np.roll(count, 1)
            counts[first[:-1][first[:-1] < len(counts)]] = 0
            known = (counts > 0) & (joint > 0)
            # Witten-Bell-like weight: the more is known of the history, the more its pairs count.
            trust = np.where(counts > 0, self.weight * counts / (counts + 20.0), 0.0)
            high = np.divide(joint, counts, out=np.zeros_like(low), where=known)
            out.append(-np.log2(trust * np.minimum(high, 1.0) + (1 - trust) * low))
        return out


def _arrays(kept: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return kept.column("key").to_numpy().view(np.uint64), kept.column("n").to_numpy(), kept.column("n_target").to_numpy()


def fit_models(docs: DataFrame, weight: float = 0.7) -> tuple[MatchedModels, DataFrame, str]:
    """Models of docs(_target, _text) with the heads of their tables, at most MAX_WORDS + MAX_PAIRS rows, all other entries, and the path of their table."""
    counts = stage_written(ngram_counts(docs).filter((F.col("size") == 0) | (F.col("n") >= LEAST)), "counts")
    path = counts.stage_path
    sums = {r["size"]: r for r in counts.groupBy("size").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("n_target").alias("t")).collect()}
    total, target = (int(sums[0]["n"]), int(sums[0]["t"])) if 0 in sums else (0, 0)
    size, known, marked = (int(sums[1]["rows"]), int(sums[1]["n"]), int(sums[1]["t"])) if 1 in sums else (0, 0, 0)
    counts = counts.filter("size > 0").withColumn("n_target", F.col("n_target" if target else "n"))
    head = F.col("n") >= F.when(F.col("size") == 1, -(-total // MAX_WORDS)).otherwise(-(-total // MAX_PAIRS))
    tables = [_arrays(counts.filter((F.col("size") == size_) & head).select("key", "n", "n_target").toArrow()) for size_ in (1, 2)]
    return MatchedModels(*tables, (total, target or total), (known, marked if target else known), size, weight), counts.filter(~head), path


def score_documents(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ce_target, ce_background, ce_difference (bits a token).

    ``target_ids`` names the rows of the target corpus by doc_id; it is broadcast when
    its counted size is within ``BROADCAST_IDS``. Low differences are target-like.
    """
    ids = target_ids.select(F.col("doc_id").alias("_t")).filter("_t IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    marked = own.join(ids, F.col("_id") == F.col("_t"), "left").select(F.col("_t").isNotNull().alias("_target"), "_text")
    models, others, path = fit_models(marked)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference"]
    scores = f"doc_id {kind}, n_tokens bigint, ce_target double, ce_background double, ce_difference double"

    def measure(batch: pa.RecordBatch, words: Table, pairs: Table) -> Iterator[pa.RecordBatch]:
        for part in T.parts(batch, 1, 2_000_000):
            buf, bounds = T.buffer_of(part.column(1))
            starts, _, hashes = T.word_spans(buf, bounds)
            first = T.words_per_text(starts, bounds)
            n = np.diff(first)
            base, target = (np.add.reduceat(np.append(x, 0.0), np.minimum(first[:-1], len(x))) if len(x) else np.zeros(len(n)) for x in shared.value.losses(hashes, first, words, pairs))
            none = n == 0
            size = np.maximum(n, 1)
            cols = [target / size, base / size, (target - base) / size]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *[pa.array(c, pa.float64(), mask=none) for c in cols]], names)

    def table(found: pa.Table, size: int) -> Table:
        key, n, target = _arrays(found)
        own = found.column("size").to_numpy() == size
        return Table(key[own], n[own], target[own])

    if others.isEmpty():
        removed(docs.sparkSession, path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = Table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for batch in batches:
                yield from measure(batch, none, none)

        return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, scores)

    dealt = own.withColumn("deal", F.pmod(F.xxhash64("_id", "_text"), F.lit(max(1, -(-models.totals[0] // DEALT)))).cast("int"))

    def ask(docs: pa.Table) -> pa.Table:
        keys: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for batch in docs.combine_chunks().to_batches():
            for part in T.parts(batch, 1, 2_000_000):
                buf, bounds = T.buffer_of(part.column(1))
                starts, _, hashes = T.word_spans(buf, bounds)
                for held, new in zip(keys, shared.value.missing(hashes, T.words_per_text(starts, bounds)), strict=True):
                    held.append(new)
        one, two = (np.unique(np.concatenate(x)).view(np.int64) for x in keys)
        size = np.repeat(np.array([1, 2], np.int32), [len(one), len(two)])
        return pa.table({"deal": pa.array(np.full(len(size), docs["deal"][0].as_py(), np.int32)), "size": pa.array(size), "key": pa.array(np.concatenate([one, two]))})

    def answer(docs: pa.Table, found: pa.Table) -> pa.Table:
        words, pairs = table(found, 1), table(found, 2)
        done = [x for batch in docs.combine_chunks().to_batches() for x in measure(batch, words, pairs)]
        return pa.Table.from_batches(done) if done else pa.table({n: pa.array([], t) for n, t in zip(names, [docs.schema.field(0).type, pa.int64(), *[pa.float64()] * 3], strict=True)})

    def scored(some: DataFrame) -> DataFrame:
        asked = some.groupBy("deal").applyInArrow(ask, "deal int, size int, key bigint")
        found = asked.join(others, ["size", "key"]).select("deal", "size", "key", "n", "n_target")
        return stage_written(some.groupBy("deal").cogroup(found.groupBy("deal")).applyInArrow(answer, scores), "scores")

    done = [scored(dealt.filter(F.col("deal") % ROUNDS == r)) for r in range(ROUNDS)]
    removed(docs.sparkSession, path)
    return reduce(DataFrame.unionByName, done)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0))
    return score_documents(docs, good)
