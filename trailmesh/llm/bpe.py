"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled into a deterministic automaton over token labels, one merge
gadget after the other: the gadget of (a, b) -> c makes the state after c a copy of the
state after b, takes the arc b away from the state after a, and adds an arc c to every
state that had a followed by b. There is one state for each label that can stand before another, and an
arc t -> u leads to the state after u, so the transition table is one bit for each state and label,
columns of states in merge order. It is compiled once, on the driver, and broadcast; its size is that of the
vocabulary. A pre-split word has exactly one accepted path; it is found left to right
over the table: the labels' own automaton (a trie with failure links) names the arcs that may end after each byte, longest
first. Decoding emits the labels of the arcs.

Text is treated as the vocabulary's file says: special tokens are cut out first, the
rest is NFC-normalised, lower-cased and split into words of letters, single numbers
and runs of other signs; white space is dropped.

Defined cases: null and empty texts have no tokens and decode to ''; texts of any
length are encoded whole, in pieces cut at blanks; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
PIECE = 500_000
WORD_CACHE = 700_000


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: Letters and numbers that Unicode 16 adds to the standard library's tables.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Capital letters that Unicode 16 and 17 add (first, last, first of their small letters).
NEW_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
TO_SMALL = {c: c - a + small for a, b, small in NEW_CAPITALS for c in range(a, b + 1)}


def _ranges(codes: list[int]) -> str:
    """A character class body of sorted code points."""
    out, at = [], 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\U{codes[at]:08x}-\\U{codes[end]:08x}")
        at = end + 1
    return "".join(out)


def _with_classes(pattern: str, most: int = sys.maxunicode) -> str:
    """The pattern with \\p{L}, \\p{N} and \\s spelt out up to a code point, for the standard library's matcher."""
    by: dict[str, list[int]] = {"L": [], "N": []}
    for c in range(most + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in by:
            by[kind].append(c)
    for kind, new in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        by[kind] = sorted({*by[kind], *(c for a, b in new for c in range(a, b + 1) if c <= most)})
    blank = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return pattern.replace(r"\p{L}", _ranges(by["L"])).replace("[" + r"\p{N}" + "]", "[" + _ranges(by["N"]) + "]").replace(r"\p{N}", _ranges(by["N"])).replace(r"\s", blank)


class TokenizationAutomaton:
    """Compiled from the text of a vocabulary file of word-end BPE with byte-level labels; ``arcs`` is the table of one compiled before."""

    def __init__(self, spec: str, arcs: bytes | None = None) -> None:
        own = json.loads(spec)
        vocab: dict[str, int] = own["model"]["vocab"]
        self.end = own["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in own.get("added_tokens", [])}
        self.labels = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for label, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = label.encode()
        n = len(self.end)
        self._bytes = byte_labels()
        code = {label: b for b, label in enumerate(self._bytes)}
        spelt = {t: bytes(map(code.__getitem__, t)) for t in vocab if all(c in code for c in t)}
        self.inner = {w: vocab[t] for t, w in spelt.items() if not (n and t.endswith(self.end) and len(t) > n)}
        self.final = {w[:-n]: vocab[t] for t, w in spelt.items() if t.endswith(self.end) and len(t) > n} if n else self.inner
        self.longest = max(map(len, self.final))
        merges = [(vocab[x], vocab[y], vocab[x + y]) for x, y in (m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"])]
        made = {c for _, _, c in merges}
        # Columns in order of creation: the labels of single bytes, then one for each merge.
        base = [i for i in sorted({*self.inner.values(), *self.final.values()}) if i not in made]
        self.column = {i: at for at, i in enumerate([*base, *(c for _, _, c in merges)])}
        self.state = {i: at for at, i in enumerate(sorted(self.inner.values(), key=self.column.__getitem__))}
        self.width = (len(self.state) + 7) // 8
        self.arcs = self._compiled(merges, len(base)) if arcs is None else arcs
        self._index_labels()
        self._words: dict[str, bytes] = {}
        split = next(p for p in own["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._split, self._split_basic = re.compile(_with_classes(split)), re.compile(_with_classes(split, 0xFFFF))
        self._capital, self._capital_basic = (re.compile("[" + "".join(chr(c) for c in TO_SMALL if c <= most) + "]") for most in (sys.maxunicode, 0xFFFF))
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _compiled(self, merges: list[tuple[int, int, int]], n_base: int) -> bytes:
        """The transition table after all gadgets: for each column, a bit for each state that has its arc."""
        table = np.zeros((n_base + len(merges), self.width), np.uint8)
        for at in range(sum(self.column[i] < n_base for i in self.state)):
            table[:n_base, at >> 3] |= 1 << (at & 7)  # any byte may follow any other
        for n, (a, b, c) in enumerate(merges, n_base):
            before, last = self.state[a], self.column[b]
            there = table[last, before >> 3] >> (before & 7) & 1
            if c in self.state:
                old, new = self.state[b], self.state[c]
                table[:n, new >> 3] |= (table[:n, old >> 3] >> (old & 7) & 1) << (new & 7)
            table[last, before >> 3] &= ~(1 << (before & 7)) & 255
            if there:
                table[n] = table[self.column[a]]
        return table.tobytes()

    def _index_labels(self) -> None:
        """The trie's states are the beginnings of inner labels; each knows all labels that end there, longest first."""
        column = lambda token: self.column[token] * self.width
        self._last = {w: (token, column(token)) for w, token in self.final.items()}
        self._step: dict[int, int] = {}  # state << 8 | byte -> state
        self._back, self._ends, parents = [0], [()], []
        for label, token in self.inner.items():
            at = 0
            for b in label:
                key = at << 8 | b
                if key not in self._step:
                    self._step[key] = len(self._back)
                    self._back.append(0)
                    self._ends.append(())
                    parents.append(key)
                at = self._step[key]
            self._ends[at] = ((len(label), token, self.state[token], column(token)),)
        children: dict[int, list[int]] = {}
        for key in parents:
            children.setdefault(key >> 8, []).append(key)
        level = [0]
        while level:
            below = []
            for at in level:
                for key in children.get(at, ()):
                    to = self._step[key]
                    if at:
                        self._back[to] = self._next(self._back[at], key & 255)
                    self._ends[to] += self._ends[self._back[to]]
                    below.append(to)
            level = below

    def _next(self, at: int, b: int) -> int:
        to = self._step.get(at << 8 | b)
        while to is None and at:
            at = self._back[at]
            to = self._step.get(at << 8 | b)
        return to or 0

    def has_arc(self, t: int, u: int) -> bool:
        """Whether label u may follow label t."""
        at = self.state[t]
        return bool(self.arcs[self.column[u] * self.width + (at >> 3)] >> (at & 7) & 1)

    def encode_word(self, word: str) -> list[int]:
        """The accepted path of one pre-split word."""
        w = word.encode()
        n = len(w)
        # For each place: the state there, the label that led to it, and where that began.
        states, labels, start = [-1] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        step, ends, arcs, state = self._step.get, self._ends, self.arcs, 0
        for end in range(1, n):
            b = w[end - 1]
            to = step(state << 8 | b)
            state = self._next(state, b) if to is None else to
            for size, u, after, column in ends[state]:
                s = end - size
                if s and not arcs[column + (states[s] >> 3)] >> (states[s] & 7) & 1:
                    continue
                states[end], labels[end], start[end] = after, u, s
                break
        for s in range(max(0, n - self.longest), n):
            found = self._last.get(w[s:])
            if found is not None and (s == 0 or arcs[found[1] + (states[s] >> 3)] >> (states[s] & 7) & 1):
                labels[n], start[n] = found[0], s
                break
        path, at = [], n
        while at:
            path.append(labels[at])
            at = start[at]
        return path[::-1]

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                blank = text.find(" ", at + PIECE)
                end = blank if blank > 0 else end
            yield text[at:end]
            at = end

    def _plain(self, text: str) -> Iterator[bytes]:
        words = self._words
        for piece in self._pieces(text):
            s = unicodedata.normalize("NFC", piece)
            s = "".join([c.lower() for c in s]) if "Σ" in s else s.lower()
            basic = s.isascii() or len(s.encode("utf-16-le", "surrogatepass")) == 2 * len(s)
            if not s.isascii() and (self._capital_basic if basic else self._capital).search(s):
                s = s.translate(TO_SMALL)
            found = (self._split_basic if basic else self._split).findall(s)
            new = set(found).difference(words)
            if len(words) + len(new) > WORD_CACHE:
                words.clear()
                new = set(found)
            for w in new:
                words[w] = np.array(self.encode_word(w), "<u4").tobytes()
            yield b"".join(map(words.__getitem__, found))

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """Arrays of ids, piece by piece."""
        at, text = 0, text or ""
        for m in self._cut.finditer(text) if self._cut else ():
            for ids in self._plain(text[at : m.start()]):
                yield np.frombuffer(ids, "<u4")
            yield np.array([self.special[m[0]]], "<u4")
            at = m.end()
        for ids in self._plain(text[at:] if at else text):
            yield np.frombuffer(ids, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, joined by one blank, as UTF-8."""
        return b" ".join(map(self.labels.__getitem__, ids.tolist()))


_compiled: dict[str, TokenizationAutomaton] = {}


def automaton(spec: str, arcs: bytes | None = None) -> TokenizationAutomaton:
    """The automaton of a vocabulary file's text, made once per process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = TokenizationAutomaton(spec, arcs)
    return _compiled[key]


def _shared(df: DataFrame, spec: str) -> Broadcast:
    """The vocabulary's text and its compiled table, as large as the vocabulary makes them."""
    return df.sparkSession.sparkContext.broadcast((spec, automaton(spec).arcs))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    shared = _shared(docs, spec)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*shared.value)
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                ids = [np.concatenate([*own.encode(t.as_py()), np.zeros(0, "<u4")]).astype(np.int32) for t in part.column(1)]
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, spec: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids."""
    shared = _shared(encoded, spec)
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*shared.value)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], "<u4")).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id), F.col(ids)).mapInArrow(run, f"doc_id {kind}, text string")


def token_digests(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode without moving the ids."""
    shared = _shared(docs, spec)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*shared.value)
        for batch in batches:
            counts, shas, decoded = [], [], []
            for t in batch.column(1):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in own.encode(t.as_py()):
                    if len(ids):
                        a.update(ids.tobytes())
                        b.update(b" " + own.decode(ids) if n else own.decode(ids))
                        n += len(ids)
                counts.append(n)
                shas.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_spec() -> str:
    import public_tokenizers

    return read_spec(public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_spec())
