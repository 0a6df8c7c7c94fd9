"""Removal of repeated passages by level-wise doubling.

A window is ``window`` consecutive words of one text (words are runs without blanks,
unchanged). Its levels are a quarter, a half and the whole of its length; only what is
repeated at one level goes on to the next, twice as long:

1. of every window the quarter with the least hash, leftmost of equal ones, is its anchor.
   Equal windows have equal anchors at the same place, so windows whose anchor occurs once
   go, and one row stands for the run of all windows that share an anchor;
2. the half that extends the anchor inside the window, to the right where that fits, else
   to the left;
3. the windows themselves. Runs with the same windows are counted first; a run that occurs
   once is compared window by window with one run of each kind.

Windows are compared by 96 bits of hashes of their words, runs by 128; texts move twice,
to their candidates and to their repeated windows. All counts are taken where the rows
lie before anything is shuffled, so a passage of a third of all rows is no hot key, and
rows meet their counts by joins that Spark can split.

Defined cases: null, empty and short texts have no window and lose nothing; repeated rows
repeat each other's windows, as do texts that share a doc_id; every row, also with a null
doc_id, gives one row; empty tables give an empty result; extra columns are ignored by
``mark_repeats`` and kept by ``drop_repeats``. Long texts are walked in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm import np_text as T
from trailmesh.llm.shuffles import stage_written, stages_removed

WINDOW = 35
#: A run's repeated windows are bits of one long.
LONGEST_WINDOW = 120
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hash_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of texts that lie one after the other."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_BLANK[buf]
    begins, ends = word.copy(), np.append(~word[1:], True) & word
    begins[1:] &= ~word[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(buf))]
    begins[cut] |= word[cut]
    ends[cut - 1] |= word[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = T.powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return starts, T.mix((sums[stops] - sums[starts]) * down[starts])


@dataclass
class Piece:
    """Words of one or more texts: row of the batch, place in the text, words that follow in the piece, hash."""

    row: np.ndarray
    pos: np.ndarray
    left: np.ndarray
    hashes: np.ndarray


def pieces(texts: pa.Array, window: int) -> Iterator[Piece]:
    """Pieces of about ``T.SEGMENT`` bytes that hold each window of each text exactly once, whole."""
    buf, off = T.buffer_of(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + T.SEGMENT, "right")) - 1)
        if off[j] - off[i] <= T.SEGMENT:
            bounds = off[i : j + 1] - off[i]
            starts, hashes = hash_words(buf[off[i] : off[j]], bounds)
            first = np.searchsorted(starts, bounds)
            count = np.diff(first)
            pos = np.arange(len(starts)) - np.repeat(first[:-1], count)
            yield Piece(np.repeat(np.arange(i, j), count), pos, np.repeat(count, count) - pos, hashes)
        else:
            base, tail = 0, np.zeros(0, np.uint64)
            for part in cut_text(buf[off[i] : off[j]]):
                own = np.concatenate([tail, hash_words(part, np.zeros(0, np.int64))[1]])
                at = np.arange(len(own))
                yield Piece(np.full(len(own), i), base + at, len(own) - at, own)
                tail = own[max(0, len(own) - window + 1) :]
                base += len(own) - len(tail)
        i = j


def cut_text(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one text that end between words."""
    at = 0
    while at < len(buf):
        end = min(at + T.SEGMENT, len(buf))
        while end < len(buf) and not _BLANK[buf[end]]:
            end += 1
        yield buf[at:end]
        at = end


def _pair(a: np.ndarray, b: np.ndarray, m: np.uint64 = _M1) -> np.ndarray:
    return T.mix(a * m + b)


def levels(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all quarters, halves (twice a quarter) and, in two ways, whole windows."""
    quarter = -(-window // 4)
    n = lambda length: max(0, len(hashes) - length + 1)
    q = np.zeros(n(quarter), np.uint64)
    for k in range(quarter):
        q = T.mix(q * _M1 + hashes[k : k + len(q)])
    half = _pair(q[: n(2 * quarter)], q[quarter : quarter + n(2 * quarter)])
    rest = window - 2 * quarter
    a, b = half[: n(window)], half[rest : rest + n(window)]
    return q, half, _pair(a, b), _pair(a, b, _M2)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value of each ``width`` consecutive ones."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(at) - step], at[step:]
        at, size = np.where(values[a] <= values[b], a, b), size + step
    return at


def _rows(batch: pa.RecordBatch, at: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """The first two columns (doc_id, key) of the rows ``at``, and further columns."""
    at = pa.array(at, pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns.values()], ["doc_id", "key", *columns])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """A row for each run of windows with one anchor: doc_id, key, lo, hi (its windows), turn (the first
    window whose half extends to the right), quarter, left and right (hashes)."""
    quarter = -(-window // 4)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in T.parts(whole, 2)):
            for p in pieces(batch.column(2), window):
                at = np.flatnonzero(p.left >= window)
                if not len(at):
                    continue
                q, half, _, _ = levels(p.hashes, window)
                anchor = least_of(q, window - quarter + 1)[at]
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (p.row[at][1:] != p.row[at][:-1]))
                lo, hi, anchor = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)], anchor[new]
                turn = np.maximum(lo, anchor - (window - 2 * quarter))
                left, right = half[np.maximum(anchor - quarter, 0)], half[np.minimum(anchor, len(half) - 1)]
                base = p.pos[lo] - lo
                yield _rows(
                    batch, p.row[lo], lo=pa.array(lo + base, pa.int32()), hi=pa.array(hi + base, pa.int32()), turn=pa.array(turn + base, pa.int32()),
                    quarter=_signed(q[anchor]), left=_signed(T.mix(left + _M2)), right=_signed(right),
                )

    return docs.mapInArrow(run, f"doc_id {kind}, key bigint, lo int, hi int, turn int, quarter bigint, left bigint, right bigint")


def repeated(rows: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash of this level occurs more than once, and the written hashes that do."""
    often = stage_written(rows.groupBy(level).agg(F.count("*").alias("n")).filter("n > 1").select(level), "level")
    return rows.join(often, level, "left_semi"), often


def runs_of(docs: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """Candidate runs with their windows: doc_id, key, lo, run1, run2 (128 bits of the windows), w1, w2 (96 bits each)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in T.parts(whole, 2)):
            spans = batch.column(3)
            owner = np.repeat(np.arange(len(batch)), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            s_lo, s_hi = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            order = np.lexsort((s_lo, owner))
            owner, s_lo, s_hi = owner[order], s_lo[order], s_hi[order]
            for p in pieces(batch.column(2), window):
                if not len(p.row):
                    continue
                _, _, w1, w2 = levels(p.hashes, window)
                # The part of each span of these texts that lies in this piece.
                edge = np.flatnonzero(np.append(True, p.row[1:] != p.row[:-1]))
                of_row = np.full(len(batch), -1)
                of_row[p.row[edge]] = edge
                mine = np.flatnonzero(of_row[owner] >= 0)
                begin = of_row[owner[mine]]
                shift = begin - p.pos[begin]
                a = np.maximum(s_lo[mine] + shift, begin)
                b = np.minimum(s_hi[mine] + shift, begin + p.left[begin] - window)
                a, b, row = (x[b >= a] for x in (a, b, owner[mine]))
                if not len(a):
                    continue
                size = b - a + 1
                off = np.append(0, np.cumsum(size))
                nth = np.arange(off[-1]) - np.repeat(off[:-1], size)
                at = np.repeat(a, size) + nth
                v1, v2 = w1[at], w2[at]
                tag = nth.astype(np.uint64) * _M2
                r1, r2 = (np.add.reduceat(T.mix(v + tag), off[:-1]) for v in (v1, v2))
                yield _rows(
                    batch, row, lo=pa.array(p.pos[a], pa.int32()), run1=_signed(r1), run2=_signed(r2),
                    w1=T.lists(v1.view(np.int64), off, pa.int64()), w2=T.lists((v2 >> np.uint64(32)).astype(np.uint32).view(np.int32), off, pa.int32()),
                )

    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key"))
    both = docs.alias("d").join(candidates.alias("c"), same).select("d.doc_id", "d.key", "d.text", "c.spans")
    return both.mapInArrow(run, f"doc_id {kind}, key bigint, lo int, run1 bigint, run2 bigint, w1 array<bigint>, w2 array<int>")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, spans (lo, n, mask): the repeated windows of each text that has any; docs as of ``_keyed``.

    Bit i of ``mask`` is set where the window that starts at word lo + i occurs elsewhere too.
    """
    if not 2 <= window <= LONGEST_WINDOW:
        raise ValueError(f"windows have 2 to {LONGEST_WINDOW} words")
    # Each stage is written before what it was made from is removed.
    quarters = stage_written(anchors(docs, window), "anchors")
    first, often = repeated(quarters, "quarter")
    side = lambda lo, hi, half: F.struct(F.col(lo).alias("lo"), hi.alias("hi"), F.col(half).alias("half"))
    sides = F.array(side("lo", F.least("hi", F.col("turn") - 1), "left"), side("turn", F.col("hi"), "right"))
    halves = stage_written(first.select("doc_id", "key", F.inline(sides)).filter("lo <= hi"), "halves")
    stages_removed(quarters, often)
    second, often = repeated(halves, "half")
    second = second.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    runs = stage_written(runs_of(docs, second, window), "runs")
    stages_removed(halves, often)
    kinds = stage_written(runs.groupBy("run1", "run2").agg(F.count("*").alias("n"), F.first("w1").alias("w1"), F.first("w2").alias("w2")), "kinds")
    each = kinds.select("run1", "run2", "n", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w")).select("run1", "run2", "n", "i", "w.*")
    often = stage_written(each.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2"), "windows")
    once = each.filter("n = 1").join(often, ["w1", "w2"], "left_semi").groupBy("run1", "run2").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = stage_written(once.unionByName(kinds.filter("n > 1").select("run1", "run2", F.lit(-1).cast("bigint").alias("mask"))), "masks")
    found = runs.select("doc_id", "key", "lo", F.size("w1").alias("n"), "run1", "run2").join(masks, ["run1", "run2"])
    spans = stage_written(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "n", "mask")).alias("spans")), "spans")
    stages_removed(runs, kinds, often, masks)
    return spans


def covered(lo: np.ndarray, n: np.ndarray, mask: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of words that the masked windows cover."""
    at = np.repeat(lo, n) + (i := np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    at = np.unique(at[(np.repeat(mask, n) >> i) & 1 == 1])
    if not len(at):
        return at, at
    gap = np.flatnonzero(at[1:] > at[:-1] + window)
    return at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + window


def _applied(docs: DataFrame, window: int, doc_id: str, text: str, with_text: bool) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (start, end), and the kept text if asked for."""
    keyed = _keyed(docs, doc_id, text)
    extra = [F.struct(*docs.columns).alias("_row")] if with_text else []
    left = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"), *extra)
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key"))
    both = left.alias("d").join(repeated_windows(keyed, window).alias("r"), same, "left").select("d.doc_id", "d.text", "r.spans", *(["d._row"] if with_text else []))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffer_of(batch.column(1))
            spans, words, removed, shas, cuts, texts = batch.column(2), [], [], [], [], []
            bounds, flat, there = spans.offsets.to_numpy(), spans.flatten(), spans.is_valid().to_numpy(zero_copy_only=False)
            # Null lists have no entries, so flatten() and offsets agree once they start at 0.
            lo, n, mask = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1, 2))
            bounds = bounds - bounds[0]
            for i in range(len(batch)):
                own = slice(bounds[i], bounds[i + 1]) if there[i] else slice(0, 0)
                a, b = covered(lo[own], n[own], mask[own], window)
                base, gone, sha, kept_parts, between = 0, 0, hashlib.sha256(), [], b""
                for part in cut_text(buf[off[i] : off[i + 1]]):
                    own_words = part.tobytes().split()
                    keep = np.ones(len(own_words), bool)
                    for s, e in zip(*(x[(b > base) & (a < base + len(own_words))].tolist() for x in (a, b)), strict=True):
                        keep[max(0, s - base) : max(0, e - base)] = False
                    kept = b" ".join(compress(own_words, keep) if len(a) else own_words)
                    if kept:
                        sha.update(between + kept)
                        if with_text:
                            kept_parts += [between, kept]
                        between = b" "
                    base, gone = base + len(own_words), gone + int(len(keep) - keep.sum())
                words.append(base)
                removed.append(gone)
                shas.append(sha.hexdigest())
                cuts.append([{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)])
                texts.append(b"".join(kept_parts).decode() if with_text else None)
            stretch = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = [batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(cuts, stretch)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            if with_text:
                out, names = [*out, pa.array(texts, pa.string()), batch.column(3)], [*names, "kept", "_row"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    return both.mapInArrow(run, schema + (f", kept string, _row {both.schema['_row'].dataType.simpleString()}" if with_text else ""))


def mark_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans of every row."""
    return _applied(docs, window, doc_id, text, with_text=False)


def drop_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their kept words, joined by one blank; texts that lose nothing stay as they are."""
    out = _applied(docs, window, doc_id, text, with_text=True)
    cell = lambda c: F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row")[c]) if c == text else F.col("_row")[c]
    return out.select(*[cell(c).alias(c) for c in docs.columns])


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


OP13_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w) x),
o AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN o USING (g)) y),
k AS (SELECT r, count(*) AS n, string_agg(v, ' ' ORDER BY k) AS t FROM (SELECT r, unnest(ws) AS v, generate_subscripts(ws, 1) AS k FROM w) z ANTI JOIN c USING (r, k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""
