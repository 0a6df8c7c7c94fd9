"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon (words, and stems that many different words begin with) is learned from at
most ``max_rows`` labelled documents outside the held-out fold; near copies count once
per minimum hash of their word pairs. A word of a text is matched by running its
Levenshtein automaton (distance 1 for terms of at least ``FUZZY_FROM`` letters) along
the trie; each distinct word runs once per worker. A document's hits, how often they
stand in a window with another hit, and how often within a quotation that opens and
closes in the window around them, feed a logistic regression fitted on the same rows.

Defined cases: null and empty texts have no hits and get the score of the intercept;
without labels nothing is learned and every score is 0.0; extra columns are ignored; repeated rows are all scored; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.llm import np_text as T

MAX_ROWS, FUZZY_FROM, CONTEXT = 8_000, 5, 12
STEMS = (4, 5, 6)
WORD_CACHE = 1_000_000
#: Opening quotation marks with those that close them, and signs that are no part of a word.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’", "「": "」", "『": "』"}
SIGNS = "".join({*QUOTES, *"".join(QUOTES.values())}) + "".join(map(chr, range(0x2010, 0x2028))) + "…‼⁇⁉¡¿·、。！？"


class LexiconAutomaton:
    """The Levenshtein automata (distance 1) of all terms, run together along their trie.

    States of the product are sets of (trie node, errors); they are determinised when
    first reached, so that a word costs one table look-up a letter, and most words end
    in the dead state within a few letters. A stem term accepts any ending.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[int]] = {}
        for i, (term, _, _) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends.setdefault(node, []).append(i)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int]] = []
        self.dead = self._state({}, (9, 0.0, -1))
        self.start = self._state({0: 0}, (9, 0.0, -1))

    def _rank(self, term: int, errors: int) -> tuple[int, float, int]:
        return errors, -self.terms[term][2], term

    def _state(self, cells: dict[int, int], stem: tuple) -> int:
        for node, e in list(cells.items()):
            if e == 0:  # a letter of the term is missing in the word
                for child in self.children[node].values():
                    cells.setdefault(child, 1)
        full = (9, 0.0, -1)
        for node, e in cells.items():
            for i in self.ends.get(node, ()):
                if e == 0 or len(self.terms[i][0]) >= FUZZY_FROM + self.terms[i][1]:
                    if self.terms[i][1]:
                        stem = min(stem, self._rank(i, e))
                    else:
                        full = min(full, self._rank(i, e))
        key = (tuple(sorted(cells.items())), stem)
        if key not in self.ids:
            best = min(stem, full)
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.accepts.append((best[2], best[0]) if best[2] >= 0 else (-1, 0))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        cells: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if cells.get(node, 9) > e:
                cells[node] = e

        for node, e in self.states[state][0]:
            child = self.children[node].get(c)
            if child is not None:
                put(child, e)
            if e == 0:
                put(node, 1)  # an extra letter of the word
                for other in self.children[node].values():
                    put(other, 1)  # another letter
        to = self.moves[state][c] = self._state(cells, self.states[state][1])
        return to

    def match(self, word: str) -> tuple[int, int]:
        """(term, distance) of the nearest term, the heavier one of a tie; (-1, 0) without one."""
        if len(self.states) > 200_000:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                return -1, 0
        return self.accepts[state]


def in_quotation(left: str, right: str) -> bool:
    """Whether a quotation that opens in left, the words before, closes in right, the words after."""
    if left[-1:] in ("'", "`") and right[:1] in ("'", "`"):
        return True
    for start, ends in QUOTES.items():
        if start in ends:
            if left.count(start) % 2 and start in right:
                return True
        elif left.rfind(start) > max(left.rfind(e) for e in ends) and any(e in right for e in ends):
            return True
    return False


def _text(buf: np.ndarray, a: int, b: int) -> str:
    return buf[a:b].tobytes().decode("utf-8", "ignore")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word(buf: np.ndarray, a: int, b: int) -> str:
    return T.LOWER[buf[a:b]].tobytes().decode("utf-8", "replace")


def _training(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = F.broadcast(own.select(F.col("doc_id").alias("_l"), (F.col("toxic") == 1).cast("int").alias("toxic")))
    return docs.join(own, docs["_id"] == F.col("_l")).select("toxic", "_text")


def learn_terms(training: DataFrame, min_docs: int = 5, min_odds: float = 3.0) -> list[tuple[str, bool, float]]:
    """The terms (word or stem, is stem, log odds) that mark toxic rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = T.buffer_of(batch.column(1))
            starts, ends, hashes = T.word_spans(buf, bounds)
            first = T.words_per_text(starts, bounds)
            for i in range(len(batch)):
                a, b = first[i], first[i + 1]
                if a == b:
                    continue
                pairs = T.mix(hashes[a:b] * np.uint64(3) + np.append(hashes[a + 1 : b], np.uint64(0)))
                sketch = int(pairs.min() >> np.uint64(1))
                words = {_word(buf, s, e) for s, e in zip(starts[a:b][np.unique(hashes[a:b], return_index=True)[1]], ends[a:b][np.unique(hashes[a:b], return_index=True)[1]], strict=True)}
                words = {w for w in (w.strip(SIGNS) for w in words) if len(w) >= 3}
                rows = [(w, False, w) for w in words] + [(w[:n], True, w) for w in words for n in STEMS if len(w) > n]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string()), pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([sketch] * n, pa.int64())],
                    ["term", "stem", "word", "toxic", "sketch"],
                )

    seen = training.mapInArrow(run, "term string, stem boolean, word string, toxic int, sketch bigint")
    seen = seen.groupBy("term", "stem").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("bad"),
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("sketch"))).alias("good"),
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("word"))).alias("words"),
    )
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5))
    seen = seen.withColumn("odds", odds).filter((F.col("bad") >= min_docs) & (F.col("odds") >= min_odds) & (~F.col("stem") | (F.col("words") >= 5)))
    rows = seen.orderBy(F.desc(F.col("odds") * F.col("bad")), "term", "stem").collect()  # of max_rows rows
    return [(r["term"], r["stem"], float(r["odds"])) for r in rows]


def hit_features(texts: pa.Array, trie: LexiconAutomaton, known: dict[int, tuple[int, int]]) -> np.ndarray:
    """One row of features for every text; ``known`` remembers words by their hashes."""
    buf, bounds = T.buffer_of(texts)
    starts, ends, hashes = T.word_spans(buf, bounds)
    first = T.words_per_text(starts, bounds)
    out = np.zeros((len(bounds) - 1, 8))
    out[:, 0] = 1
    if not len(starts):
        return out
    distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if len(known) > WORD_CACHE:
        known.clear()
    terms, dists = np.full(len(distinct), -1), np.zeros(len(distinct), int)
    for k, (h, w) in enumerate(zip(distinct.tolist(), where.tolist(), strict=True)):
        got = known.get(h)
        if got is None:
            got = known[h] = trie.match(_word(buf, starts[w], ends[w]).strip(SIGNS))
        if got[0] >= 0:
            terms[k], dists[k] = got
    hits = np.flatnonzero(terms[inverse] >= 0)
    weights = np.array([t[2] for t in trie.terms] or [0.0])
    for i in np.unique(np.searchsorted(first, hits, "right") - 1).tolist():
        own = hits[(hits >= first[i]) & (hits < first[i + 1])]
        d, w = dists[inverse[own]], weights[terms[inverse[own]]]
        near = np.diff(own) <= CONTEXT
        clustered = np.count_nonzero(np.append(near, False) | np.insert(near, 0, False))
        quoted = 0
        for j in own.tolist():
            before, after = starts[max(first[i], j - CONTEXT)], ends[min(first[i + 1] - 1, j + CONTEXT)]
            word = _text(buf, starts[j], ends[j])
            lead, trail = len(word) - len(word.lstrip(SIGNS)), len(word) - len(word.rstrip(SIGNS))
            outside = max(bounds[i], before - 4), min(bounds[i + 1], after + 4)
            quoted += in_quotation(_text(buf, outside[0], starts[j]) + word[:lead], word[len(word) - trail :] + _text(buf, ends[j], outside[1]))
        exact = d == 0
        out[i, 1:] = [
            math.log1p(exact.sum()), math.log1p((~exact).sum()), w[exact].max(initial=0) / 5, w[~exact].max(initial=0) / 5,
            math.log1p(1000 * len(own) / (first[i + 1] - first[i])) / 5, math.log1p(clustered), quoted / len(own),
        ]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, n_hits."""
    training = _training(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), labels, max_rows)
    sc = docs.sparkSession.sparkContext
    lexicon = sc.broadcast(learn_terms(training))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = LexiconAutomaton(lexicon.value), {}
        for batch in batches:
            x = hit_features(batch.column(1), trie, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = training.mapInArrow(measure, "toxic int, x array<double>").collect()  # max_rows at most
    rows = sorted((tuple(r["x"]), r["toxic"]) for r in rows)
    weights = sc.broadcast(_logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)) if rows else np.zeros(8))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = LexiconAutomaton(lexicon.value), {}
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                x = hit_features(part.column(1), trie, known)
                p = 1 / (1 + np.exp(-np.clip(x @ weights.value, -30, 30))) if weights.value.any() else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array(np.round(np.expm1(x[:, 1]) + np.expm1(x[:, 2])).astype(np.int64))], ["doc_id", "score", "n_hits"])

    own = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, score double, n_hits bigint")
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "n_hits")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")
