"""Packing documents into windows of tokens, best fit decreasing.

Documents are tokenised, overlong ones cut into full windows first; what is
left of each is packed by decreasing length into the tightest open window,
which a segment tree over remaining capacities finds.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW, END_ID = 4096, 2
#: Pieces packed together by one task; more groups, not larger ones, as the corpus grows.
GROUP_PIECES = 1 << 15
#: Distinct chunks whose ids a worker remembers; later ones are encoded where they occur.
CACHE_CHUNKS = 300_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTER = _byte_letters()
#: Chunks that are surely one run of letters (each its own normal form) and one of signs: no contractions, no special tokens.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")


#: The pipeline of vocabularies that are encoded chunk by chunk: white space is dropped, letters are lower-cased, words get an end.
CHUNKED = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def by_chunks(path: str) -> bool:
    """Whether a vocabulary file describes the pipeline that Encoder's chunks rest on."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm, pre = (j.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    split = (pre.get("pretokenizers") or [{}])[0]
    return (
        [x.get("type") for x in norm.get("normalizers", [])] == CHUNKED["normalizer"]
        and [x.get("type") for x in pre.get("pretokenizers", [])] == CHUNKED["pre_tokenizer"]
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": CHUNKED["pattern"]}, "Removed", True)
        and j["model"].get("end_of_word_suffix") is not None
    )


class Encoder:
    """Token ids of whole texts by their chunks between blanks.

    A CHUNKED vocabulary's splitting pattern never joins characters across white space and its normaliser
    keeps blanks and line feeds apart from their neighbours, so a text's ids are its chunks' ids in
    order; each distinct chunk is encoded once and texts are gathered from the table.  A chunk of
    letters and signs goes to the merge model at once, any other through the whole tokenizer.
    Under any other vocabulary whole texts go through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = by_chunks(path)
        self.model = self.tokenizer.model
        self.signs: dict[str, list[int]] = {}
        self.index = {"\n": 0}  # no chunk holds a line feed: this one stands for the end of a text
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([END_ID], np.uint32)

    def _piece(self, run: str) -> list[int]:
        return [t.id for t in self.model.tokenize(run if run.isascii() else "".join(map(_LETTER.__getitem__, run.encode())))]

    def ids(self, chunk: str) -> list[int]:
        m = _SIMPLE.fullmatch(chunk)
        if not m:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out = self._piece(m[1].lower())
        if m[2]:
            if m[2] not in self.signs:
                if len(self.signs) >= CACHE_CHUNKS:
                    self.signs.clear()
                self.signs[m[2]] = self._piece(m[2])
            out = out + self.signs[m[2]]
        return out

    def add(self, chunks: list[str]) -> None:
        got = [self.ids(c) for c in chunks]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))])
        at = len(self.index)
        self.index.update(zip(chunks, range(at, at + len(chunks)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with END_ID; bounds of the texts)."""
        if not self.chunked:
            got = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            bound = np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(bound[-1])), bound
        parts, count = [], []
        for t in texts:
            p = t.replace("\n", " ").split(" ")
            p.append("\n")
            parts += p
            count.append(len(p))
        new = sorted(set(parts).difference(self.index))
        known, flat = len(self.index), len(self.flat)
        if new:
            self.add(new)
        at = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - upto[:-1], size) + np.arange(upto[-1])]
        if len(self.index) > CACHE_CHUNKS:  # the common chunks came first: what this call added goes again
            for c in new:
                del self.index[c]
            self.start, self.size, self.flat = self.start[:known], self.size[:known], self.flat[:flat]
        return ids, upto[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over 0..window, a stack of windows at each leaf."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._change(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` at which a window is open."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # climb until a right sibling has windows
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.stacks[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window index, offset in it) for each piece; pieces of equal length are taken in their given order."""
    seq, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        room = tree.tightest(need) if need < window else None
        if room is None:
            w, room, n = n, window, n + 1
        else:
            w = tree.take(room)
        seq[i], at[i] = w, window - room
        if room > need:
            tree.put(room - need, w)
    return seq, at


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every text's ids cut into full windows and a rest: (key, start, length, ids_crc32, doc_tokens)."""

    def cut(batches):
        enc = encoder(tokenizer)
        for b in base.chunks(batches, text):
            ids, bound = enc.encode([t or "" for t in b.column(1).to_pylist()])
            n = np.diff(bound)
            parts = -(-n // window)
            row = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
            lo = bound[row] + start
            size = np.minimum(window, n[row] - start)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(lo.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[row], pa.int64())], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces with the sequence each lies in and its offset there.

    Null and empty texts are documents of END_ID alone; a very long text is encoded whole by one task.  Repeated rows are packed
    each, pieces of one length in the order of id and start (those of null ids last), an empty table gives no pieces, other
    columns are not read, whatever their names.  Windows never span the groups of GROUP_PIECES pieces
    that are packed by one task each; a sequence id is the group's number and the window's number in it.
    """
    cut = base.stash(pieces(docs, tokenizer, key, text, window), "pieces")
    groups = -(-cut.count() // GROUP_PIECES) or 1

    def place(pdf):
        pdf = pdf.sort_values([key, "start"], kind="stable")
        seq, at = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=(pdf["g"].to_numpy() << 32) | seq, offset=at).drop(columns="g")

    kind = cut.schema[key].dataType.simpleString()
    dealt = cut.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(place, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
