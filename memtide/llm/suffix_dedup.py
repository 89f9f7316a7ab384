"""Exact removal of repeated 100-byte strings with sparse suffix arrays.

Which bytes to index is decided by content: of the 69 32-byte grams inside a
100-byte string the one of least hash is its anchor, so equal strings have
equal anchors at equal places, and an anchor owns a run of string starts.

1. Map side, each anchor becomes a record (gram, context, place), where context
   hashes everything its strings cover, by another polynomial than the gram's;
   within a chunk of the corpus only the first record of each context goes on,
   the others are repeats already.
2. By gram, records of equal context are repeats of their first.  A gram whose
   records have several contexts goes on with the first of each; one that
   occurs once ends here.
3. The bytes around those anchors are fetched and compared exactly in
   logarithmic index families: batches of anchored suffixes, in the order of
   the corpus, get suffix arrays, are merge-scanned against the existing
   levels, and levels of like size merge, so a suffix is merged O(log n) times.
4. By document, runs are united and their bytes removed.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Records that a map task holds before it sends them on; suffixes of the first level of an index family.
HELD, BATCH = 1 << 19, 1 << 14

#: The contexts' own polynomial: gram and context are two independent hashes of 64 bits.
_BASE = 0x9FB21C651E98DF25
_INV = pow(_BASE, -1, 1 << 64)
_RAND = np.random.default_rng(20240415).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _context_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of the contexts' polynomial, inverse powers)."""
    n = len(data) + 1
    if len(_POW[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(max(n, base.CHUNK_BYTES + 2), b, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    acc = np.empty(n, np.uint64)
    acc[0] = 0
    np.cumsum(_RAND[data] * _POW[0][: n - 1], out=acc[1:])
    return acc, _POW[1]


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of all texts of a chunk: (text, place in the chunk, first and last string start before it, gram hash, context hash)."""
    n, span = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = base._powers(n + 1)
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum(base._RAND[data] * up[:n], out=acc[1:])
    h = base.mix((acc[gram:] - acc[:-gram]) * down[: n + 1 - gram])
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    w = 1
    while 2 * w <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < span:
        m = np.minimum(m[: len(m) - (span - w)], m[span - w :])
    count = size[long] - length + 1
    start = np.repeat(off[long] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at = (m[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    i = np.flatnonzero(new)
    a, p0, p1 = at[i], start[i], start[np.concatenate([i[1:] - 1, [len(at) - 1]])]
    acc, down = _context_sums(data)
    context = (acc[p1 + length] - acc[p0]) * down[p0]
    context = base.mix(context + ((a - p0) * 131 + (a - p1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(off, a, side="right") - 1, a, p0, p1, h[a], context


class Records:
    """Columns of equal length that travel as one binary value."""

    def __init__(self, **cols: np.ndarray) -> None:
        self.cols = cols

    def __len__(self) -> int:
        return len(next(iter(self.cols.values())))

    def __getattr__(self, name):
        return self.cols[name]

    def take(self, i) -> Records:
        return Records(**{k: v[i] for k, v in self.cols.items()})

    def pack(self) -> bytes:
        return len(self).to_bytes(8, "little") + b"".join(np.ascontiguousarray(v).tobytes() for v in self.cols.values())

    @staticmethod
    def unpack(raw: bytes, kinds: dict[str, str]) -> Records:
        n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
        for k, t in kinds.items():
            out[k] = np.frombuffer(raw, t, n, at)
            at += out[k].nbytes
        return Records(**out)

    @staticmethod
    def join(parts: list[Records], kinds: dict[str, str]) -> Records:
        return Records(**{k: np.concatenate([p.cols[k] for p in parts]) if parts else np.zeros(0, t) for k, t in kinds.items()})

    def dealt(self, bucket: np.ndarray, kind: int):
        """(bucket, kind, binary) rows, one for each bucket met."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]) if len(b) else [0]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield int(b[lo]), kind, self.take(order[lo:hi]).pack()


# A document is (d, h): its id and the 64-bit hash of its text, which tells apart rows that share an id or have none; both order the corpus.
_ANCHOR = {"k": "<u8", "c": "<u8", "d": "<i8", "h": "<i8", "p": "<u4", "L": "u1", "R": "u1"}
_RUN = {"d": "<i8", "h": "<i8", "s": "<u4", "n": "<u4"}
_ASK = {"k": "<u8", "d": "<i8", "h": "<i8", "p": "<u4", "L": "u1", "R": "u1"}
RUN, ANCHOR, ASK, TEXT = 0, 1, 2, 9
_NULL_ID = np.iinfo(np.int64).max


def first_of(rows: Records, *by: str) -> tuple[np.ndarray, np.ndarray]:
    """(order by ``by`` and place; for each row in that order, whether it is a first: no row of its class has an earlier place)."""
    order = np.lexsort((rows.p, rows.h, rows.d, *[rows.cols[c] for c in reversed(by)]))
    r = rows.take(order)
    n = len(r)
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([r.cols[c][1:] != r.cols[c][:-1] for c in by])
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return order, (r.d == r.d[lead]) & (r.h == r.h[lead]) & (r.p == r.p[lead])


def _runs(r: Records) -> Records:
    """Everything the strings of these anchors cover."""
    return Records(d=r.d, h=r.h, s=(r.p - r.L).astype("<u4"), n=(r.L.astype(np.int64) - r.R + LENGTH).astype("<u4"))


def split_repeats(rows: Records) -> tuple[Records, Records]:
    """(first record of every context, runs of the others)."""
    order, first = first_of(rows, "k", "c")
    return rows.take(order[first]), _runs(rows.take(order[~first]))


def several_contexts(firsts: Records) -> Records:
    """Of records sorted by gram and context, those whose gram has more than one context."""
    k, c = firsts.k, firsts.c
    n = len(k)
    if n < 2:
        return firsts.take(np.zeros(0, np.int64))
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    differs = np.zeros(n, bool)
    differs[1:] = (c[1:] != c[:-1]) & ~new[1:]
    mixed = np.bincount(group, differs) > 0
    return firsts.take(mixed[group])


# --- exact comparison --------------------------------------------------------------------------


class Level:
    """Anchored suffixes in the order of the corpus: what lies right of each anchor and, reversed, left of it, as rows of
    bytes padded with zeros beyond their ends, with the range of string starts that each owns."""

    def __init__(self, order: Records, right: np.ndarray, left: np.ndarray) -> None:
        self.order, self.right, self.left = order, right, left

    def __len__(self) -> int:
        return len(self.right)

    @staticmethod
    def join(a: Level, b: Level) -> Level:
        return Level(Records.join([a.order, b.order], _ASK), np.concatenate([a.right, b.right]), np.concatenate([a.left, b.left]))


def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of bytes, length of the prefix each shares with the one before it in that order)."""
    n, width = rows.shape
    pad = -width % 8
    words = np.pad(rows, ((0, 0), (0, pad))).reshape(n, -1, 8).view(">u8")[:, :, 0] if n else np.zeros((0, 1), ">u8")
    words = words.astype(np.uint64)
    order = np.lexsort(words.T[::-1]) if n else np.zeros(0, np.int64)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        s = rows[order]
        same = s[1:] == s[:-1]
        lcp[1:] = np.where(same.all(1), width, same.argmin(1))
    return order, lcp


def merge_scan(level: Level) -> np.ndarray:
    """For every suffix a row of flags, one for each string start that it owns (by distance from the anchor): an equal string
    starts earlier at a suffix of ``level``.

    Ranks of right parts at the depth a string needs come from the suffix array and its common prefixes, ranks of left
    parts likewise; equal pairs of ranks are equal strings.
    """
    n = len(level)
    right, r_lcp = suffix_array(level.right)
    left, l_lcp = suffix_array(level.left)
    r = level.order
    flags = np.zeros((n, SPAN), bool)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SPAN):
        own = np.flatnonzero((r.R <= o) & (o <= r.L))
        if len(own) < 2:
            continue
        rank_r[right] = np.cumsum(r_lcp < LENGTH - o)
        rank_l[left] = np.cumsum(l_lcp < o) if o else 0
        key = rank_r[own] * (n + 1) + rank_l[own]
        order, first = first_of(Records(key=key, d=r.d[own], h=r.h[own], p=r.p[own]), "key")
        flags[own[order[~first]], o] = True
    return flags


class IndexFamily:
    """Levels of doubling size.  A batch is scanned together with each level it may repeat; then levels of like size merge."""

    def __init__(self, batch: int = BATCH) -> None:
        self.levels: list[Level] = []
        self.batch = batch

    def add(self, new: Level) -> np.ndarray:
        """Flags of the batch's strings that start earlier, in it or in a level; the batch must come after all levels."""
        flags = merge_scan(new)
        for old in self.levels:
            flags |= merge_scan(Level.join(old, new))[len(old) :]
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = Level.join(self.levels[-1], last)
        return flags


def compare_contexts(asked: Records, bytes_: np.ndarray, begin: np.ndarray) -> Records:
    """Runs of strings that start earlier, among anchors given with the bytes that their strings cover."""
    n = len(asked)
    if not n:
        return Records.join([], _RUN)
    # families never mix grams, so grams are dealt to families; the order inside one is the order of the corpus
    order = np.lexsort((asked.p, asked.h, asked.d))
    asked, begin = asked.take(order), begin[order]
    L, size = asked.L.astype(np.int64), asked.L.astype(np.int64) - asked.R + LENGTH

    def grid(offset, width, sign, upto):
        k = np.arange(width)
        at = (begin + L)[:, None] + (offset + sign * k)[None, :]
        ok = k[None, :] < upto[:, None]
        return np.where(ok, bytes_[np.where(ok, at, 0)], 0).astype(np.uint8)

    out = []
    families: dict[int, IndexFamily] = {}
    family = (asked.k >> np.uint64(40)).astype(np.int64) % max(1, n // (4 * BATCH) + 1)
    for f in base.distinct(family):
        mine = np.flatnonzero(family == f)
        index = families.setdefault(int(f), IndexFamily())
        for lo in range(0, len(mine), index.batch):
            i = mine[lo : lo + index.batch]
            keep = L, begin
            L, begin = keep[0][i], keep[1][i]
            level = Level(asked.take(i), grid(0, LENGTH, 1, size[i] - L), grid(-1, SPAN - 1, -1, L))
            L, begin = keep
            edge = np.diff(np.pad(index.add(level), ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, o0 = np.nonzero(edge == 1)  # ranges of neighbouring starts make one run
            o1 = np.nonzero(edge == -1)[1] - 1
            r = level.order.take(row)
            out.append(Records(d=r.d, h=r.h, s=(r.p.astype(np.int64) - o1).astype("<u4"), n=(o1 - o0 + LENGTH).astype("<u4")))
    return Records.join(out, _RUN)


def unite(r: Records) -> Records:
    """Maximal runs of the union of runs, by document and start."""
    n = len(r)
    if not n:
        return r
    r = r.take(np.lexsort((r.s, r.h, r.d)))
    new = np.ones(n, bool)
    new[1:] = (r.d[1:] != r.d[:-1]) | (r.h[1:] != r.h[:-1])
    base_ = (np.cumsum(new) - 1) << 33  # documents one after the other, far apart
    s = base_ + r.s
    e = np.maximum.accumulate(s + r.n)
    new = np.ones(n, bool)
    new[1:] = s[1:] > e[:-1]
    i = np.flatnonzero(new)
    return Records(d=r.d[i], h=r.h[i], s=r.s[i], n=(e[np.concatenate([i[1:] - 1, [n - 1]])] - s[i]).astype("<u4"))


# --- Spark --------------------------------------------------------------------------------------


def _bucket(d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    return ((d ^ h) & 0x7FFFFFFFFFFFFFFF) % n


def _bucket_column(n: int):
    """The same of columns d and h."""
    return F.pmod(F.col("d").bitwiseXOR(F.col("h")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)), F.lit(n)).cast("int")


_BLOBS = "bucket int, kind int, blob binary"


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _pack_asks(r: Records, bytes_: np.ndarray) -> bytes:
    return r.pack() + bytes_.tobytes()


def _size(r: Records) -> np.ndarray:
    return r.L.astype(np.int64) - r.R + LENGTH


def of_document(r: Records, d: int, h: int) -> np.ndarray:
    """The rows of a document among records that are sorted by document."""
    lo, hi = np.searchsorted(r.d, d), np.searchsorted(r.d, d, side="right")
    return np.arange(lo + np.searchsorted(r.h[lo:hi], h), lo + np.searchsorted(r.h[lo:hi], h, side="right"))


def by_kind(part, kinds: dict[int, dict]):
    """(records of each kind of blobs of a bucket, an iterator of its batches of texts): blobs come before texts."""
    got: dict[int, list] = {k: [] for k in kinds}
    texts = iter(())
    for b in part:
        kind = np.asarray(b.column(1))
        for k, fields in kinds.items():
            if (kind == k).any():
                got[k] += [Records.unpack(x, fields) for x in b.column(2).filter(pa.array(kind == k)).to_pylist()]
        if (kind == TEXT).any():
            texts = itertools.chain([b.filter(pa.array(kind == TEXT))], part)
            break
    joined = {k: Records.join(v, kinds[k]) for k, v in got.items()}
    return {k: r.take(np.lexsort((r.h, r.d))) for k, r in joined.items()}, texts


class Outbox:
    """Records on their way to the buckets of their documents: held until there are enough, so that blobs are few."""

    def __init__(self, n: int, limit: int = HELD // 4) -> None:
        self.n, self.limit, self.held, self.count = n, limit, {}, 0

    def add(self, kind: int, r: Records):
        if len(r):
            self.held.setdefault(kind, []).append(r)
            self.count += len(r)
        if self.count >= self.limit:
            yield from self.flush()

    def flush(self):
        rows = []
        for kind, parts in self.held.items():
            r = Records.join(parts, dict.fromkeys(parts[0].cols))
            rows += r.dealt(_bucket(r.d, r.h, self.n), kind)
        self.held, self.count = {}, 0
        if rows:
            yield _batch(rows)


def repeated_runs(docs: DataFrame, n: int) -> DataFrame:
    """Blobs of runs (kind RUN) dealt to ``n`` buckets of documents, for ``docs`` (d, h, x)."""

    def scan(batches):
        held, count, runs = [], 0, []

        def flush():
            nonlocal held, count, runs
            firsts, more = split_repeats(Records.join(held, _ANCHOR))
            both = unite(Records.join([*runs, more], _RUN))
            held, count, runs = [], 0, []
            return _batch([*firsts.dealt((firsts.k % np.uint64(n)).astype(np.int64), ANCHOR), *both.dealt(_bucket(both.d, both.h, n), RUN)])

        for b in base.chunks(batches, "x"):
            data, off = base.text_buffers(b.column(2))
            doc, a, p0, p1, k, c = anchors(data, off)
            d, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            r = Records(k=k, c=c, d=d[doc].astype("<i8"), h=h[doc].astype("<i8"), p=(a - off[doc]).astype("<u4"), L=(a - p0).astype("u1"), R=(a - p1).astype("u1"))
            firsts, more = split_repeats(r)
            held.append(firsts)
            runs.append(unite(more))
            count += len(firsts)
            if count >= HELD:
                yield flush()
        yield flush()

    def by_gram(batches):
        told = Outbox(n)
        for part in base.by_bucket(batches):
            got, out = [], []
            for b in part:
                for bucket, kind, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if kind == RUN:
                        out.append((bucket, kind, blob))
                    else:
                        got.append(Records.unpack(blob, _ANCHOR))
            firsts, runs = split_repeats(Records.join(got, _ANCHOR))
            asked = several_contexts(firsts)
            asked = Records(**{c: asked.cols[c] for c in _ASK})
            yield from told.add(RUN, unite(runs))
            yield from told.add(ASK, asked)
            yield _batch(out)
        yield from told.flush()

    def fetch(batches):
        for part in base.by_bucket(batches):
            got, texts = by_kind(part, {ASK: _ASK})
            asked = got[ASK]
            if not len(asked):
                continue
            for c in base.chunks(texts, "x"):
                d, h = np.asarray(c.column(3)), np.asarray(c.column(4))
                data, off = base.text_buffers(c.column(5))
                rows = [(i, of_document(asked, int(d[i]), int(h[i]))) for i in range(c.num_rows)]
                rows = [(i, r) for i, r in rows if len(r)]
                if not rows:
                    continue
                r = asked.take(np.concatenate([x for _, x in rows]))
                begin = np.repeat([off[i] for i, _ in rows], [len(x) for _, x in rows])
                m = _size(r)
                at = np.repeat(begin + r.p - r.L - (np.cumsum(m) - m), m) + np.arange(m.sum())
                yield _send(r, data[at])

    def _send(r, data):
        begin = np.cumsum(_size(r)) - _size(r)
        bucket = (r.k % np.uint64(n)).astype(np.int64)
        order = np.lexsort((r.k, bucket))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        rows = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            i = order[lo:hi]
            m = _size(r.take(i))
            at = np.repeat(begin[i] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            rows.append((int(bucket[i[0]]), ASK, _pack_asks(r.take(i), data[at])))
        return _batch(rows)

    def compare(batches):
        told = Outbox(n)
        for part in base.by_bucket(batches):
            rs, datas = [], []
            for b in part:
                for blob in b.column(2).to_pylist():
                    r = Records.unpack(blob, _ASK)
                    rs.append(r)
                    datas.append(np.frombuffer(blob, np.uint8, int(_size(r).sum()), len(r.pack())))
            r = Records.join(rs, _ASK)
            yield from told.add(RUN, unite(compare_contexts(r, np.concatenate(datas), np.cumsum(_size(r)) - _size(r))))
        yield from told.flush()

    known = base.stash(dealt(docs.select("d", "h", "x").mapInArrow(scan, _BLOBS)).mapInArrow(by_gram, _BLOBS), "runs")
    asks = known.where(F.col("kind") == ASK)
    ctx = beside(docs, asks, n).mapInArrow(fetch, _BLOBS)
    exact = base.stash(dealt(ctx).mapInArrow(compare, _BLOBS), "exact-runs")
    return known.where(F.col("kind") == RUN).union(exact)


def dealt(blobs: DataFrame) -> DataFrame:
    """Blobs of a bucket side by side in one partition."""
    return blobs.repartition(base.partitions_for(blobs), "bucket").sortWithinPartitions("bucket")


def beside(docs: DataFrame, blobs: DataFrame, n: int) -> DataFrame:
    """Documents and the blobs of their buckets in the same partitions, bucket by bucket, blobs first."""
    none = {"bucket": "int", "kind": "int", "blob": "binary", "d": "long", "h": "long", "x": "string"}
    texts = docs.withColumns({"bucket": _bucket_column(n), "kind": F.lit(TEXT), "blob": F.lit(None).cast("binary")})
    both = texts.select(*none, *[c for c in docs.columns if c not in none]).unionByName(blobs, allowMissingColumns=True)
    return both.repartition(base.partitions_for(docs), "bucket").sortWithinPartitions("bucket", "kind")


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    x = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(x).alias("h"), x.alias("x"), F.col(key).alias("id"))


class RunsOf:
    """Runs of a bucket's documents, looked up by document."""

    def __init__(self, r: Records) -> None:
        self.r = unite(r)

    def __call__(self, d: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        i = of_document(self.r, d, h)
        return self.r.s[i].astype(np.int64), self.r.n[i].astype(np.int64)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (key, n_bytes, n_removed, n_spans, kept_sha256).

    Removed is every byte of a 100-byte string that also starts earlier: in a document of smaller id or, in the
    same document, at a smaller place.  Null texts are empty; a null id is after all others; rows with one id (or none)
    but different texts are ordered by a hash of theirs; rows equal in both are one document, each with its result.
    A very long text is handled whole by one task, which holds its bytes and some arrays of that length.
    An empty table gives an empty result; other columns are not read, whatever their names.
    """
    rows = _prepared(docs, key, text)
    n = base.buckets_for(docs)
    runs = repeated_runs(rows.drop("id"), n)

    def remove(batches):
        for part in base.by_bucket(batches):
            got, texts = by_kind(part, {RUN: _RUN})
            runs_of = RunsOf(got[RUN])
            for c in base.chunks(texts, "x"):
                out = []
                for d, h, x, k in zip(*(c.column(name).to_pylist() for name in ("d", "h", "x", "id")), strict=True):
                    raw = x.encode("utf-8", "surrogatepass")
                    s, m = runs_of(d, h)
                    sha, at = hashlib.sha256(), 0
                    for a, z in zip(s.tolist(), (s + m).tolist(), strict=True):
                        sha.update(raw[at:a])
                        at = z
                    sha.update(raw[at:])
                    out.append((k, len(raw), int(m.sum()), len(s), sha.hexdigest()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    got = beside(rows, runs, n).mapInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return got.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")
