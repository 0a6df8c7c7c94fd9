"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of one to four words is one shingle).
Rows with the same set become one node. Nodes that share a band of MinHash values are
candidates; signatures are compared in steps, and a candidate is dropped as soon as
the posterior probability of reaching the threshold falls below ``TOLERANCE``; all
others are verified exactly on their shingle sets.

No bucket is expanded into all pairs. First every node of a bucket meets two pivots of
it (its smallest and its largest node); what links is one class. Only then the buckets
that still hold several classes are compared across classes, in blocks of bounded
size, from which only links that join classes leave. Every link lies within one class, so the links are counted last: all pairs of a
class, in blocks of bounded size, exactly, and as sums per node and block, not as a list.

Defined cases: null and wordless texts have no shingles, no links and a class of their
own; rows with a null doc_id get a null class; repeated rows are copies of each other,
and rows that share a doc_id but no text are different rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm import np_text as T
from trailmesh.llm.lineage import checkpointed

#: The tolerance holds at each of the eight looks: together they prune a pair at similarity 0.8 with probability 2e-5.
SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 2e-6
BANDS, ROWS, SIGNATURE, STEP, BLOCK = 25, 5, 128, 16, 256
#: Shingles of the nodes of a block of a class, and of a step of the comparison of two blocks.
BLOCK_SHINGLES, COLUMNS = 250_000, 2048
#: Rows of the table, or of the loop's state, for a file of an intermediate table; fewer files where there are few rows.
PER_FILE, STATE_PER_FILE = 10_000, 200_000
_seeds = np.random.default_rng(20240229).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    buf, bounds = T.buffer_of(texts)
    starts, _, hashes = T.word_spans(buf, bounds)
    first = T.words_per_text(starts, bounds)
    rolled = np.zeros_like(hashes)
    for i in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + np.append(hashes[i:], np.zeros(min(i, len(hashes)), np.uint64))
    rolled = T.mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    short = short * np.uint64(0x9E3779B97F4A7C15) + h
            yield T.mix(np.array([short]))
        else:
            yield np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: the fewest matches of n at which the posterior (uniform prior) reaches the tolerance."""
    grid = (np.arange(2000) + 0.5) / 2000
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log(1 - grid)
        p = np.exp(log - log.max(1, keepdims=True))
        tail = p[:, grid >= threshold].sum(1) / p.sum(1)
        out.append(int(np.argmax(tail >= tolerance)))
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the row pairs that are never pruned, and their matches of SIGNATURE."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, few in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= few]
    return alive, matches[alive]


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (hash of the text), n (shingles), set (128-bit hash), sig and bands of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, 1, 1_000_000):
                n, node, sig, bands = [], [], [], []
                for s in shingle_sets(part.column(1)):
                    n.append(len(s))
                    if not len(s):
                        node.append(None)
                        sig.append(None)
                        bands.append(None)
                        continue
                    other = T.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                    node.append(np.array([s.sum(), other.sum()], ">u8").tobytes())
                    low = np.full(SIGNATURE, 0xFFFFFFFFFFFFFFFF, np.uint64)
                    for a in range(0, len(s), 2048):
                        low = np.minimum(low, (s[a : a + 2048, None] * _seeds).min(0))
                    low = T.mix(low)
                    sig.append((low >> np.uint64(48)).astype("<u2").tobytes())
                    band = np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        band = T.mix(band * np.uint64(0x9E3779B97F4A7C15) + low[r : BANDS * ROWS : ROWS])
                    bands.append(band.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int32()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "key", "n", "set", "sig", "bands"],
                )

    own = docs.select(F.col(doc_id), F.col(text), F.xxhash64(F.col(text)))
    return own.mapInArrow(run, f"doc_id {kind}, key bigint, n int, set binary, sig binary, bands array<bigint>")


def _pruned(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures survive the incremental comparison, with their matches."""
    least = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SIGNATURE) for i in (2, 3))
            alive, matches = surviving(a, b, least)
            at = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(matches.astype(np.int32))], ["a", "b", "matches"])

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, matches int")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (y for x in T.parts(batch, 2) for y in T.parts(x, 3)):
                good = [jaccard(x, y) >= threshold for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True)]
                keep = pa.array(np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, class (its smallest node) of all nodes with links: smallest labels with pointer jumping.

    The joins of the loop are sort-merge joins at every size: edges and labels grow with
    the input, and a broadcast in every round would fill the driver. Each round is
    written in as many files as its counted rows call for.
    """
    both = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    files = -(-both.count() // STATE_PER_FILE)
    label = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("class")), files)
    while True:
        near = both.join(label.hint("merge"), both["v"] == label["node"]).groupBy("u").agg(F.min("class").alias("near"))
        step = label.join(near.hint("merge"), label["node"] == near["u"]).select("node", F.col("class").alias("old"), F.least("class", "near").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("class").alias("far"))
        step = checkpointed(step.join(jump.hint("merge"), "to").select("node", "old", F.least("to", "far").alias("class")), files)
        changed = not step.filter("old <> class").isEmpty()
        label = step.select("node", "class")
        if not changed:
            return label


def _with_class(nodes: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    own = classes.select(F.col("node").alias(name), F.col("class").alias(f"c_{name}"))
    return nodes.join(own, name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))


def joined_classes(classes: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """The classes after further links; the loop runs over the classes that these join, not over all links again."""
    ends = _with_class(_with_class(links.select("a", "b"), classes, "a"), classes, "b").filter("c_a <> c_b")
    found = components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    moved = found.select(F.col("node").alias("class"), F.col("class").alias("to"))
    known = classes.join(moved, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    return checkpointed(known.unionByName(found.join(classes.select("node"), "node", "left_anti")), files)


def _joining(pairs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Those rows of pairs that join classes not joined before; own: the class of each node."""
    root = list(range(int(own.max(initial=-1)) + 1))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    keep = []
    for k, (x, y) in enumerate(own[pairs].tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return pairs[keep]


def _across(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join different classes within the buckets of mixed(bucket, node, class, n).

    A bucket's nodes are dealt into blocks of bounded size, and each pair of blocks is one
    group: its pairs of different classes are compared by signature, those that survive
    exactly, and of the links found only a spanning set leaves the group. The nodes of
    the bucket's largest class meet those of other classes, never each other.
    """
    least = least_matches()

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, SIGNATURE)
        block = table["block"].to_numpy()
        own = np.unique(table["class"].to_numpy(), return_inverse=True)[1]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        left, right = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
        open_ = (own[left] != own[right]) & ((left < right) if i == j else True)
        left, right = left[open_], right[open_]
        alive = np.concatenate([np.zeros(0, np.int64), *(surviving(sig[left[k : k + 8192]], sig[right[k : k + 8192]], least)[0] + k for k in range(0, len(left), 8192))])
        left, right = left[alive], right[alive]
        if len(left):
            asked, at = np.unique(np.concatenate([left, right]), return_inverse=True)
            batch = table.select(["text"]).take(pa.array(asked)).combine_chunks().to_batches()[0]
            sets = [s for part in T.parts(batch, 0) for s in shingle_sets(part.column(0))]
            n = np.array([len(s) for s in sets])
            x, y = at[: len(left)], at[len(left) :]
            rows, cols = np.unique(x), np.unique(y)
            both = common(sets, rows, cols)[np.searchsorted(rows, x), np.searchsorted(cols, y)]
            good = both / (n[x] + n[y] - both) >= threshold
            pairs = _joining(np.stack([left[good], right[good]], 1), own)
        else:
            pairs = np.zeros((0, 2), np.int64)
        return pa.table({"a": table["node"].take(pa.array(pairs[:, 0])), "b": table["node"].take(pa.array(pairs[:, 1]))})

    sizes = mixed.groupBy("bucket", "class").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("m", "class")).alias("core"), F.max("m").alias("m_core"), F.max_by("n", F.struct("m", "class")).alias("n_core"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("classes"))
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.filter("classes > 1").select("bucket", "core", blocks(F.col("m_core"), F.col("n_core")).alias("cores"), blocks(F.col("m") - F.col("m_core"), F.col("n") - F.col("n_core")).alias("others"))
    placed = mixed.join(sizes, "bucket").withColumn("inner", F.col("class") == F.col("core"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("cores")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("inner"), F.col("others")).otherwise(0) + own)
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("inner"), 0).otherwise(F.col("cores")) - 1)))
    placed = placed.select("bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "class", "block").join(texts, "node")
    # Few bytes, much work: as many tasks as the session's shuffles have, not as few as their size suggests.
    placed = placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j")
    return placed.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of rows with those of cols."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = times > 1  # the others are in no intersection, but for a set's with itself
    owner, ids = owner[shared[ids]], (np.cumsum(shared) - 1)[ids[shared[ids]]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    out = np.zeros((len(rows), len(cols)))
    for at in range(0, int(np.count_nonzero(shared)), COLUMNS):
        part = slice(*np.searchsorted(ids, (at, at + COLUMNS)))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[part], ids[part] - at] = 1
        out += has[rows] @ has[cols].T
    return out


def link_counts(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """node, found: the rows of other nodes of its class that reach the threshold with it, of members(node, class, n, copies)."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        sets = [s for part in T.parts(batch, batch.schema.get_field_index("text")) for s in shingle_sets(part.column("text"))]
        block, copies = table["block"].to_numpy(), table["copies"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = np.zeros(len(sets), np.int64)
        if len(rows) and len(cols):
            n = np.array([len(s) for s in sets])
            both = common(sets, rows, cols)
            good = both / (n[rows][:, None] + n[cols] - both) >= threshold
            if i == j:
                np.fill_diagonal(good, False)
            else:
                found[cols] += good.T @ copies[rows]
            found[rows] += good @ copies[cols]
        return pa.table({"node": table["node"], "found": pa.array(found)})

    sizes = members.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "class").withColumn("blocks", F.least("blocks", F.lit(1 << 20)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(texts, "node")
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("class", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "block", "copies", "text")
    # Few bytes, much work: as many tasks as the session's shuffles have.
    placed = placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class", "i", "j")
    return placed.groupBy("class", "i", "j").applyInArrow(run, "node bigint, found bigint").groupBy("node").agg(F.sum("found").alias("found"))


def _classified(docs: DataFrame, doc_id: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows, their distinct sets, (node, class) of all sets with links, and (doc_id, key, text) of docs."""
    rows = checkpointed(signatures(docs, doc_id, text))
    files = -(-rows.count() // PER_FILE)
    usable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    sets = usable.groupBy("set").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key")).alias("rep"), F.first(F.struct("n", "sig", "bands")).alias("x"))
    # The numbers hold once they are written; which set gets which does not change the result.
    sets = checkpointed(sets.select(F.monotonically_increasing_id().alias("node"), "set", "copies", "rep", "x.n", "x.sig", "x.bands"), files, last=True)
    bands = sets.select("node", F.explode("bands").alias("bucket"))
    bands = bands.join(bands.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "bucket")
    bands = checkpointed(bands.select("bucket", "node"), files, last=True)
    of_set = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("m"), *of_set)
    # Buckets that hold the same nodes ask the same; one of them is enough.
    buckets = buckets.groupBy("m", "x0", "x1", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket", "lo", "hi")
    shared = checkpointed(bands.join(buckets, "bucket"), files)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))

    star = shared.select(F.col("lo").alias("a"), F.col("node").alias("b")).union(shared.select("node", "hi")).filter("a <> b").distinct()
    best = _pruned(star, sets).groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a"))
    classes = components(_linked(checkpointed(best, files), sets, texts, threshold, files))

    # The pivots leave links inside a bucket that no node's best pair shows; pairs of different classes are compared in full.
    mixed = _with_class(shared.select("bucket", "node"), classes, "node").withColumnRenamed("c_node", "class").join(sets.select("node", "n"), "node")
    several = mixed.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("bucket")
    mixed = checkpointed(mixed.join(several, "bucket"), files)
    wanted = _texts_of(mixed.select("node").distinct(), sets, texts).join(sets.select("node", "sig"), "node")
    more = checkpointed(_across(mixed, wanted, threshold), files, last=True)
    return rows, sets, joined_classes(classes, more, files), texts


def _texts_of(nodes: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """node and the text of its representative row, once each."""
    reps = sets.join(nodes, "node", "left_semi").select("node", "rep.doc_id", "rep.key")
    return reps.join(texts, ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: float, files: int) -> DataFrame:
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return checkpointed(_verified(pairs, _texts_of(involved, sets, texts), threshold), files, last=True)


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of the class), class_size, n_links.

    ``n_links`` counts all other rows that reach the threshold with the row: the copies of
    its shingle set, and the rows of every linked set of its class.
    """
    rows, sets, classes, texts = _classified(docs, doc_id, text, threshold)
    members = sets.select("node", "n", "copies").join(classes, "node")
    found = checkpointed(link_counts(members, _texts_of(classes.select("node"), sets, texts), threshold), last=True)
    nodes = _with_class(sets.select("node", "set", "copies", "rep.doc_id"), classes, "node").join(found, "node", "left")
    sizes = nodes.groupBy("c_node").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    nodes = nodes.join(sizes, "c_node").select("set", "class_id", "class_size", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
    out = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "set").join(nodes, "set").select("doc_id", "class_id", "class_size", "n_links")
    alone = rows.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(alone)


def keep_one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of every class, the one with the smallest doc_id (and text hash), with all its columns.

    Rows without words or doc_id all stay; of repeated rows one stays.
    """
    rows, sets, classes, _ = _classified(docs, doc_id, text, threshold)
    nodes = _with_class(sets.select("node", "set", "rep"), classes, "node")
    kept = nodes.groupBy("c_node").agg(F.min("rep").alias("kept"))
    nodes = nodes.join(kept, "c_node").select("set", "kept")
    own = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "key", "set").join(nodes, "set")
    own = own.groupBy(F.col("doc_id").alias("__tm_id"), F.col("key").alias("__tm_key")).agg(F.max(F.struct("doc_id", "key") == F.col("kept")).alias("__tm_kept"), F.count("*").alias("__tm_rows"))
    out = checkpointed(own.filter("NOT __tm_kept OR __tm_rows > 1"))
    same = (F.col(doc_id) == F.col("__tm_id")) & (F.xxhash64(F.col(text)) == F.col("__tm_key"))
    once = docs.join(out, same, "left_anti")
    repeated = docs.join(out.filter("__tm_kept"), same, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(repeated)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
