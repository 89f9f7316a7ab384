"""Near-duplicate passages by compact windows.

Under each of HASHES min-hash functions a text's five-word shingles form a
Cartesian tree: a node is the minimum of the range its subtree spans, and with
that range it is a compact window, the group of all passages whose min-hash it
is.  Nodes that span at least a passage's length are kept.  Windows with equal
min-hashes in different documents meet; an interval join over the functions
finds passages that enough of them agree on; those are verified by the exact
Jaccard similarity of their shingles.

Windows of one content stand for each other: of those a task meets only the first goes on, and the others match it.
Where a value has few windows all pairs of them meet; where it has many they first meet leads only, and what the
verified passages leave open is then compared with every earlier window of its value, in blocks, by the windows' shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .suffix_dedup import _NULL_ID, _RUN, RUN, Outbox, Records, RunsOf, _batch, _bucket, _prepared, beside, by_kind, dealt, of_document, unite

SHINGLE, PASSAGE, THRESHOLD = 5, 50, 0.8
#: Shingles of the shortest passage; min-hash functions, and how many must agree.
WIDTH = PASSAGE - SHINGLE + 1
HASHES, AGREE = 6, 2
#: Shingles that the three context hashes of a minimum cover: on both sides of it, on the left, on the right.  A passage
#: holds SIDE shingles on one side of its minimum at least.
CONTEXT, SIDE = 6, (WIDTH - 1) // 2
#: How far alignments may drift inside a passage.
DRIFT = 16
HELD = 1 << 18
#: Of values with so many windows all pairs meet; windows of others meet leads, and what those leave open the exact pass compares.
FEW = 16
#: Distinct windows of a value in a block of the exact pass, whose units are pairs of blocks, and the shingles of a passage
#: that a near one shares at least; a window that shares NEED shares more than RARE of so many more of the rarest.
BLOCK, RARE = 4096, 8
NEED = int(np.ceil(2 * THRESHOLD / (1 + THRESHOLD) * WIDTH - 1e-9))

_ODD = np.random.default_rng(97531).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WINDOW, MATCH, ASK, MARK, OPEN = 1, 2, 3, 4, 5
_WINDOW = {"v": "<u8", "x": "<u4", "y": "<u4", "z": "<u4", "w": "<u8", "k": "u1", "d": "<i8", "h": "<i8", "p": "<u4", "L": "u1", "R": "u1"}
#: g: how many functions a match counts for; that of two windows with equal content counts for all that are needed.
_MATCH = {"d": "<i8", "h": "<i8", "p": "<u4", "L": "u1", "R": "u1", "d0": "<i8", "h0": "<i8", "p0": "<u4", "g": "u1"}
_MARK = {"d": "<i8", "h": "<i8", "k": "u1", "p": "<u4", "L": "u1", "R": "u1", "first": "u1", "size": "<u4"}
#: A window for the exact pass: place of its first start, shingles, the starts still open (first, one past the last), whether it stands for its content.
_OPEN = {"v": "<u8", "block": "<u8", "d": "<i8", "h": "<i8", "p": "<u4", "s": "<u4", "n": "u1", "lo": "u1", "hi": "u1", "first": "u1"}
_ASK = {"pid": "<u8", "side": "u1", "d": "<i8", "h": "<i8", "p": "<u4", "n": "<u4"}
_FOUND = {"d": "<i8", "h": "<i8", "s": "<u4", "n": "<u4", "d0": "<i8", "h0": "<i8", "s0": "<u4", "n0": "<u4"}


def cartesian_windows(key: np.ndarray, begin: np.ndarray, width: int):
    """Nodes of the Cartesian trees over ``key`` (distinct numbers, one tree for each text) that span ``width`` items or more.

    (node, first start, last start): the starts of the passages of ``width`` items whose minimum the node is, from
    the range its subtree spans, which nearest smaller items on both sides bound.
    """
    n = len(key)
    size = np.diff(begin)
    count = np.maximum(size - width + 1, 0)
    none = np.zeros(0, np.int64)
    if not count.sum():
        return none, none, none
    # a node spans width items if and only if it is the minimum of some width items
    table = [key]
    while 2 << (len(table) - 1) <= width:
        m, w = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(m[:-w], m[w:]))
    w = 1 << (len(table) - 1)
    m = np.minimum(table[-1][: n - width + 1], table[-1][width - w :])
    start = np.repeat(begin[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    low = m[start]
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    node = (low[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # nearest smaller items, looked for no further than a passage reaches
    doc = np.searchsorted(begin, node, side="right") - 1
    lo, hi = node.copy(), node + 1
    for j in range(len(table) - 1, -1, -1):
        for _ in range(2 if j == len(table) - 1 else 1):
            step, t = 1 << j, table[j]
            to = lo - step
            ok = (to >= begin[doc]) & (t[np.maximum(to, 0)] > key[node])
            lo = np.where(ok, to, lo)
            ok = (hi + step <= begin[doc + 1]) & (t[np.minimum(hi, len(t) - 1)] > key[node])
            hi = np.where(ok, hi + step, hi)
    return node, np.maximum(lo, node - width + 1), np.minimum(node, hi - width)


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Records]:
    """(text of each, windows) of a chunk; places count shingles within their text."""
    start, end, first = base.words(data, off)
    sh, _, begin = base.shingles(base.word_hashes(data, start, end), first, SHINGLE)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sh * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), dtype=np.uint64)])
    out, docs = [], []
    for k in range(HASHES):
        value = base.mix(sh * _ODD[k])
        key = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(sh), dtype=np.uint64)
        node, p0, p1 = cartesian_windows(key, begin, WIDTH)
        doc = np.searchsorted(begin, node, side="right") - 1
        context = lambda left, right: base.mix(upto[np.minimum(node + right + 1, begin[doc + 1])] - upto[np.maximum(node - left, begin[doc])]).astype("<u4")  # noqa: B023, E731
        v = base.mix(value[node] + np.uint64(k))
        d, h = np.zeros(len(node), "<i8"), np.zeros(len(node), "<i8")
        place = {"p": (node - begin[doc]).astype("<u4"), "L": (node - p0).astype("u1"), "R": (node - p1).astype("u1")}
        content = base.mix(upto[p1 + WIDTH] - upto[p0])
        out.append(Records(v=v, x=context(CONTEXT, CONTEXT), y=context(SIDE, 0), z=context(0, SIDE), w=content, k=np.full(len(node), k, "u1"), d=d, h=h, **place))
        docs.append(doc)
    return np.concatenate(docs), Records.join(out, _WINDOW)


def _matches(r: Records, a: np.ndarray, b: np.ndarray) -> Records:
    """Matches of windows b with windows a."""
    same = np.logical_and.reduce([r.cols[c][a] == r.cols[c][b] for c in ("w", "L", "R")])
    return Records(d=r.d[b], h=r.h[b], p=r.p[b], L=r.L[b], R=r.R[b], d0=r.d[a], h0=r.h[a], p0=r.p[a], g=np.where(same, AGREE, 1).astype("u1"))


def shared(rows: Records) -> tuple[np.ndarray, np.ndarray]:
    """(windows whose value another one has, in the order of the corpus; the others)."""
    order = np.argsort(rows.v, kind="stable")
    v = rows.v[order]
    same = np.zeros(len(v), bool)
    if len(v):
        same[1:] = v[1:] == v[:-1]
        same[:-1] |= same[1:]
    some = order[same]
    return some[np.lexsort((rows.p[some], rows.h[some], rows.d[some]))], order[~same]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by key, for each place in it that of its group's first)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))


def echoes(rows: Records) -> tuple[Records, Records]:
    """(windows that go on, matches of the others): a window goes on unless one of equal value and content lies in an earlier document."""
    some, alone = shared(rows)
    r = rows.take(some)
    order, lead = _groups(base.mix(base.mix(r.w) ^ (r.v + r.L.astype(np.uint64) * np.uint64(256) + r.R)))
    first = order[lead]
    echo = (r.d[order] != r.d[first]) | (r.h[order] != r.h[first])
    on = np.concatenate([alone, some[np.sort(order[~echo])]])
    return rows.take(on), _matches(r, first[echo], order[echo])


def meet(rows: Records) -> Records:
    """Matches of windows with equal min-hash: in groups of FEW at most all pairs; in others each with the first that has its
    context on both sides, on the left and on the right, and firsts of contexts with the first of all and the one before,
    at most 5 n matches for n windows.  Windows of one document do not match."""
    rows = rows.take(np.lexsort((rows.p, rows.h, rows.d)))
    order, lead = _groups(rows.v)
    rank = np.arange(len(lead)) - lead
    few = np.bincount(lead, minlength=len(lead))[lead] <= FEW
    later = np.flatnonzero(few)
    pairs = [(order[ragged(lead[later], rank[later])], np.repeat(order[later], rank[later]))]
    many = np.sort(order[~few])
    firsts = many
    for c in ("x", "y", "z"):
        order, lead = _groups(base.mix(rows.v[many] ^ (rows.cols[c][many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        new = lead == np.arange(len(lead))
        pairs.append((many[order[lead[~new]]], many[order[~new]]))
        if c == "x":
            firsts = np.sort(many[order[new]])
    order, lead = _groups(rows.v[firsts])
    f = firsts[order]
    later = np.flatnonzero(lead != np.arange(len(lead)))
    pairs += [(f[lead[later]], f[later]), (f[later - 1], f[later])]
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    other = (rows.d[a] != rows.d[b]) | (rows.h[a] != rows.h[b])
    a, b = np.divmod(base.distinct(a[other] * len(rows) + b[other]), max(len(rows), 1))
    return _matches(rows, a, b)


def marks(rows: Records) -> Records:
    """The windows whose min-hash another document has: whether each is the first with its content, and how many such its value has (0 where it has FEW windows at most)."""
    if not len(rows):
        return Records.join([], _MARK)
    r = rows.take(np.lexsort((rows.p, rows.h, rows.d, rows.R, rows.L, rows.w, rows.v)))
    edge = lambda *cols: np.concatenate([[True], np.logical_or.reduce([r.cols[c][1:] != r.cols[c][:-1] for c in cols])])
    value, first = edge("v"), edge("v", "w", "L", "R")
    group, top = np.cumsum(value) - 1, np.flatnonzero(value)
    firsts = np.add.reduceat(first.astype(np.int64), top)
    firsts[np.bincount(group) <= FEW] = 0
    other = (r.d != r.d[top[group]]) | (r.h != r.h[top[group]])
    i = np.flatnonzero(np.logical_or.reduceat(other, top)[group])
    i = i[np.lexsort((r.p[i], r.k[i], r.h[i], r.d[i]))]
    return Records(d=r.d[i], h=r.h[i], k=r.k[i], p=r.p[i], L=r.L[i], R=r.R[i], first=first[i].astype("u1"), size=firsts[group[i]].astype("<u4"))


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the items of pieces that start at ``begin``, piece after piece."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def open_windows(data: np.ndarray, off: np.ndarray, mark: list[Records], runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, Records, np.ndarray]:
    """(text of each, windows, their shingles as 16-bit numbers) for the exact pass, of a chunk of texts with their marks and verified runs.

    Open are starts of passages of which verified runs hold fewer than NEED shingles, which lie in marked windows of AGREE
    functions, one of them of a value with many windows.  A near passage agrees in AGREE of those; all of it that few windows'
    values can tell is known.  Where all the values have many windows AGREE - 1 of them need no look: where most have its value.
    """
    start, end, first = base.words(data, off)
    sh, _, begin = base.shingles(base.word_hashes(data, start, end), first, SHINGLE)
    n = len(sh)
    held = np.zeros(n + 1, np.int64)
    for j, (s, m) in enumerate(runs):
        np.add.at(held, begin[j] + s, 1)
        np.add.at(held, begin[j] + s + m - (SHINGLE - 1), -1)
    held = np.concatenate([[0], np.cumsum(np.cumsum(held[:n]) > 0)])
    doc = np.repeat(np.arange(len(mark)), [len(m) for m in mark])
    m = Records.join(mark, _MARK)
    node = begin[doc] + m.p
    first_start, last_start = node - m.L, node - m.R
    of_start = np.full((HASHES, n), -1, np.int64)
    got = []
    for k in range(HASHES):
        mine = np.flatnonzero(m.k == k)
        p0, p1 = first_start[mine], last_start[mine]
        of_start[k, ragged(p0, p1 - p0 + 1)] = np.repeat(m.size[mine], p1 - p0 + 1)
        got.append((k, mine, base.mix(base.mix(sh[node[mine]] * _ODD[k]) + np.uint64(k)), p0, p1))
    marked, many = (of_start >= 0).sum(0), (of_start > 0).sum(0)
    enough = (marked >= AGREE) & (many > 0)
    some = np.concatenate([[0], np.cumsum(enough)])
    look = np.zeros(n, bool)
    look[: max(n - WIDTH + 1, 0)] = enough[: max(n - WIDTH + 1, 0)] & (held[WIDTH:] - held[:-WIDTH] < NEED)
    skip = np.argsort(-of_start, axis=0, kind="stable")[: AGREE - 1]
    parts = []
    for k, mine, v, p0, p1 in got:
        todo = np.flatnonzero(look & (of_start[k] > 0) & ~((skip == k).any(0) & (marked == many)))
        a, z = np.searchsorted(todo, p0), np.searchsorted(todo, p1, side="right")
        safe = np.concatenate([todo, [0]])
        lo = np.where(z > a, safe[np.minimum(a, len(todo))] - p0, 0)
        hi = np.where(z > a, safe[np.maximum(z - 1, 0)] - p0 + 1, 0)
        ask = np.flatnonzero((m.size[mine] > 0) & ((z > a) | ((m.first[mine] == 1) & (some[p1 + 1] > some[p0]))))
        parts.append([x[ask] for x in (mine, v, p0, p1, lo, hi)])
    i, v, p0, p1, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    # of a value's pairs of blocks a window that stands for its content goes to those whose second is its own block, one with
    # open starts to those whose first is
    of = m.size[i].astype(np.int64) // BLOCK + 1
    own = (base.mix((m.d[i] ^ m.h[i]).view("<u8")) % of.astype(np.uint64)).astype(np.int64)
    stands, asked = m.first[i] == 1, hi > lo
    one, two = (np.repeat(np.flatnonzero(x), of[x]) for x in (stands, asked))
    other = [ragged(np.zeros(len(x), np.int64), x) for x in (of[stands], of[asked])]
    again = (other[1] == own[two]) & stands[two]  # there already
    row = np.concatenate([one, two[~again]])
    block = np.concatenate([other[0] * of[one] + own[one], (own[two] * of[two] + other[1])[~again]])
    here = np.concatenate([other[0] == own[one], np.ones(len(row) - len(one), bool)])
    size = (p1 - p0 + WIDTH)[row]
    j = i[row]
    first = np.concatenate([np.ones(len(one), "u1"), np.zeros(len(row) - len(one), "u1")])
    out = Records(v=v[row], block=block.astype("<u8"), d=m.d[j], h=m.h[j], p=m.p[j], s=(p0[row] - begin[doc[j]]).astype("<u4"), n=size.astype("u1"), lo=np.where(here, lo[row], 0).astype("u1"), hi=np.where(here, hi[row], 0).astype("u1"), first=first)
    return doc[j], out, (sh[ragged(p0[row], size)] >> np.uint64(48)).astype("<u2")


def settle(r: Records, content: np.ndarray) -> Records:
    """Matches of the open starts of windows with earlier windows of their value that a passage there is near.

    Each window is tried with what shares most of it first, until its starts are settled or nothing is left that shares NEED.
    """
    if not len(r):
        return Records.join([], _MATCH)
    n = r.n.astype(np.int64)
    order = np.lexsort((r.p, r.h, r.d, r.block, r.v))
    content = content[ragged((np.cumsum(n) - n)[order], n[order])]
    r, n = r.take(order), n[order]
    begin = np.concatenate([[0], np.cumsum(n)])
    edge = lambda *cols: np.concatenate([[True], np.logical_or.reduce([r.cols[c][1:] != r.cols[c][:-1] for c in cols])])
    # where the windows that stand for their content hold each shingle of their value's block
    group = np.cumsum(edge("v", "block")) - 1
    window = np.repeat(np.arange(len(r)), n)
    key = (group[window] << 16) | content
    of_lead = r.first[window] == 1
    if len(r) >= 1 << 24:
        raise ValueError("too many windows in a task: use more shuffle partitions")
    held = base.distinct((key[of_lead].astype(np.uint64) << np.uint64(24)) | window[of_lead].astype(np.uint64))
    names, where = (held >> np.uint64(24)).astype(np.int64), (held & np.uint64(0xFFFFFF)).astype(np.int64)
    post, stop = np.searchsorted(names, key), np.searchsorted(names, key, side="right")
    size = stop - post
    top = np.flatnonzero(edge("v", "block"))[group]
    docs = np.flatnonzero(edge("v", "block", "d", "h"))
    own = np.repeat(docs, np.diff(np.concatenate([docs, [len(r)]])))
    # starts of passages of which earlier documents' windows hold NEED shingles
    earlier = (size > 0) & (np.concatenate([where, [0]])[post] < own[window])
    at = np.concatenate([[0], np.cumsum(earlier)])
    lo, hi = begin[:-1] + r.lo, begin[:-1] + r.hi
    could = at[WIDTH:] - at[:-WIDTH] >= NEED
    good = np.concatenate([[0], np.cumsum(could)])
    last = len(good) - 1
    asked = np.flatnonzero((r.hi > 0) & (good[np.minimum(hi, last)] > good[np.minimum(lo, last)]))
    # windows that an earlier document's equals whole need no trial
    item = base.mix(content.astype(np.uint64) + (np.arange(len(content)) - begin[window]).astype(np.uint64) * np.uint64(1 << 16))
    whole = base.mix(np.add.reduceat(item, begin[:-1]) ^ base.mix(r.v + r.block * np.uint64(0x9E3779B97F4A7C15)))
    _, one, back = np.unique(whole, return_index=True, return_inverse=True)
    copy = one[back][asked]
    same = copy < own[asked]
    out = [(i, j, int(r.s[i]) + int(r.lo[i]), int(r.s[i]) + int(r.hi[i]) - 1) for i, j in zip(asked[same].tolist(), copy[same].tolist(), strict=True)]
    asked = asked[~same]
    there = np.zeros(1 << 16, bool)
    for i in asked.tolist():
        left = lo[i] - begin[i] + np.flatnonzero(could[lo[i] : hi[i]])
        mine = content[begin[i] : begin[i + 1]]
        # a near window has more than RARE of any so many shingles: look for those that fewest have
        span = np.arange(begin[i] + left[0], begin[i] + left[-1] + WIDTH)
        rare = span[np.argsort(np.where(earlier[span], size[span], 0), kind="stable")[: len(span) - NEED + 1 + RARE]]
        at = where[ragged(post[rare], size[rare])]
        lead = top[i] + np.flatnonzero(np.bincount(at[at < own[i]] - top[i]) > RARE)
        m = len(lead)
        theirs = content[ragged(begin[lead], n[lead])]
        at = np.concatenate([[0], np.cumsum(n[lead])])
        tried = np.zeros(m, bool)
        while m and len(left):
            x = mine[left[0] : left[-1] + WIDTH]
            there[x] = True
            shared = np.add.reduceat(there[theirs].astype(np.int64), at[:-1])
            there[x] = False
            shared[tried] = 0
            best, before = np.argsort(-shared, kind="stable"), len(left)
            for j in best[: np.count_nonzero(shared >= NEED)].tolist():
                tried[j] = True
                y = theirs[at[j] : at[j + 1]]
                there[y] = True
                c = np.concatenate([[0], np.cumsum(there[x])])
                there[y] = False
                if (c[WIDTH:] - c[:-WIDTH]).max() < NEED:
                    continue
                near = verify(y, x)
                slack = WIDTH - NEED
                done = np.logical_or.reduce([(left - left[0] >= s - slack) & (left - left[0] + WIDTH <= e + slack) for s, e, *_ in near]) if near else np.zeros(len(left), bool)
                if done.any():
                    one, two = left[done][[0, -1]]
                    out.append((i, int(lead[j]), int(r.s[i]) + int(one), int(r.s[i]) + int(two)))
                    left = left[~done]
                    break
            if len(left) == before:
                break
    i, j, lo, hi = np.array(out, np.int64).reshape(-1, 4).T
    p = r.p[i].astype(np.int64)
    return Records(d=r.d[i], h=r.h[i], p=r.p[i], L=(p - lo).astype("u1"), R=(p - hi).astype("u1"), d0=r.d[j], h0=r.h[j], p0=r.p[j], g=np.full(len(i), AGREE, "u1"))


def interval_join(m: Records) -> Records:
    """Passages that AGREE of the functions give the same partner at about the same alignment.

    A match covers the passage starts of its window; a sweep over starts and ends counts the matches that cover a start.
    """
    n = len(m)
    if not n:
        return Records.join([], _FOUND)
    shift = m.p.astype(np.int64) - m.p0
    order = np.lexsort((shift, m.h0, m.d0, m.h, m.d))
    m, shift = m.take(order), shift[order]
    new = np.ones(n, bool)
    new[1:] = (shift[1:] - shift[:-1] > DRIFT) | np.logical_or.reduce([m.cols[c][1:] != m.cols[c][:-1] for c in ("d", "h", "d0", "h0")])
    group = np.cumsum(new) - 1
    lo_shift, hi_shift = np.minimum.reduceat(shift, np.flatnonzero(new)), np.maximum.reduceat(shift, np.flatnonzero(new))
    lo = m.p.astype(np.int64) - m.L
    hi = m.p.astype(np.int64) - m.R + 1
    at = np.concatenate([lo, hi]) + (np.concatenate([group, group]) << 33)
    step = np.concatenate([m.g.astype(np.int64), -m.g.astype(np.int64)])
    order = np.argsort(at, kind="stable")
    at, step = at[order], np.cumsum(step[order])
    last = np.ones(2 * n, bool)
    last[:-1] = at[1:] != at[:-1]
    at, step = at[last], step[last]
    on = step >= AGREE
    edge = np.diff(np.concatenate([[0], on.view(np.int8), [0]]))
    s, e = at[np.flatnonzero(edge == 1)], at[np.flatnonzero(edge == -1)]
    g = s >> 33
    row = np.flatnonzero(new)[g]
    s, e = s & ((1 << 33) - 1), (e & ((1 << 33) - 1)) - 1 + WIDTH
    s0 = np.maximum(s - hi_shift[g] - DRIFT, 0)
    e0 = e - lo_shift[g] + DRIFT
    return Records(d=m.d[row], h=m.h[row], s=s.astype("<u4"), n=(e - s).astype("<u4"), d0=m.d0[row], h0=m.h0[row], s0=s0.astype("<u4"), n0=(e0 - s0).astype("<u4"))


def verify(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, stop in b, start, stop in a, similarity) of b that are near one of a.

    For each alignment that enough shingles share: where every ``width`` shingles of b find enough of theirs in a at that
    alignment, trimmed to what is shared, if the shingle sets' Jaccard similarity is THRESHOLD or more.
    """
    if len(b) < width or not len(a):
        return []
    # a sorted once: first is the place in that order of a shingle's first occurrence
    place = np.argsort(a, kind="stable")
    known = a[place]
    first = np.minimum(np.searchsorted(known, b), len(known) - 1)
    held = known[first] == b
    need = 2 * THRESHOLD / (1 + THRESHOLD) * width
    c = np.concatenate([[0], np.cumsum(held)])
    if (c[width:] - c[:-width]).max() < need:  # at no alignment is there a passage
        return []
    found = np.flatnonzero(held)
    first = first[found]
    again = np.concatenate([known[1:] == known[:-1], [False]])
    once = ~again[first]
    shifts = np.sort(place[first[once]] - found[once])
    # alignments: those of shingles that a has once, and the one that the ranges were cut for
    cut = [0, *(np.flatnonzero(shifts[1:] - shifts[:-1] > DRIFT) + 1).tolist(), len(shifts)]
    tries = [int((shifts[(x + y - 1) // 2] + shifts[(x + y) // 2]) / 2) for x, y in zip(cut[:-1], cut[1:], strict=True) if y - x >= need / 4]
    middle = (len(a) - len(b)) // 2
    tries += [middle] if all(abs(middle - t) > DRIFT for t in tries) else []
    if not once.all():
        rank = np.concatenate([[0], np.cumsum(~again[:-1])]) << 32
        key, ranked = rank[first], rank | place
    out = []
    for t in tries:
        want = np.clip(found + t, 0, len(a))
        if once.all():
            at = place[first]
        else:  # of a shingle's places in a the one nearest to the alignment
            j = np.searchsorted(ranked, key | want)
            lo, hi = np.maximum(j - 1, 0), np.minimum(j, len(place) - 1)
            gap = lambda k: np.where(rank[k] == key, np.abs(place[k] - want), 1 << 40)  # noqa: B023, E731
            at = place[np.where(gap(lo) <= gap(hi), lo, hi)]
        ok = np.abs(at - want) <= DRIFT
        if np.count_nonzero(ok) < need:
            continue
        aligned, where = np.zeros(len(b), bool), np.zeros(len(b), np.int64)
        aligned[found[ok]] = True
        where[found[ok]] = at[ok]
        c = np.concatenate([[0], np.cumsum(aligned)])
        count = c[width:] - c[:-width]
        todo = [(0, len(count), int(np.ceil(need)))]
        while todo:
            lo_, hi_, least = todo.pop()
            edge = np.diff(np.concatenate([[0], (count[lo_:hi_] >= least).view(np.int8), [0]]))
            for x, y in zip(np.flatnonzero(edge == 1) + lo_, np.flatnonzero(edge == -1) + lo_, strict=True):
                i = np.flatnonzero(aligned[x : y - 1 + width]) + x
                s, e, s0, e0 = int(i[0]), int(i[-1]) + 1, int(where[i].min()), int(where[i].max()) + 1
                mine, theirs = set(b[s:e].tolist()), set(a[s0:e0].tolist())
                both = len(mine & theirs)
                sim = both / (len(mine) + len(theirs) - both)
                if sim >= THRESHOLD:
                    out.append((s, e, s0, e0, sim))
                elif least < width:  # windows that are good one by one can add up to too little: ask more of each
                    todo.append((x, y, least + 1))
    return out


_BLOBS = "bucket int, kind int, blob binary"


def near_passages(docs: DataFrame, n: int) -> DataFrame:
    """Verified passages (d, h, s, n, d0, h0, s0, n0 in words, similarity) of ``docs`` (d, h, x), each with an earlier document's."""

    def scan(batches):
        held, count = [], 0

        def flush():
            rows, m = echoes(Records.join(held, _WINDOW))
            return _batch([*rows.dealt((rows.v % np.uint64(n)).astype(np.int64), WINDOW), *m.dealt(_bucket(m.d, m.h, n), MATCH)])

        for b in base.chunks(batches, "x"):
            doc, r = windows(*base.text_buffers(b.column(2)))
            d, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            r.cols["d"], r.cols["h"] = d[doc].astype("<i8"), h[doc].astype("<i8")
            held.append(r)
            count += len(r)
            if count >= HELD:
                yield flush()
                held, count = [], 0
        yield flush()

    def by_value(batches):
        told = Outbox(n)
        for part in base.by_bucket(batches):
            got, out = [], []
            for b in part:
                for bucket, kind, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if kind == WINDOW:
                        got.append(Records.unpack(blob, _WINDOW))
                    else:
                        out.append((bucket, kind, blob))
            rows = Records.join(got, _WINDOW)
            del got
            rows, m = echoes(rows)
            rows = rows.take(shared(rows)[0])
            yield from told.add(MATCH, Records.join([m, meet(rows)], _MATCH))
            yield from told.add(MARK, marks(rows))
            yield _batch(out)
        yield from told.flush()

    def by_document(batches):
        told = Outbox(n)
        for part in base.by_bucket(batches):
            got, out = [], []
            for b in part:
                for bucket, kind, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if kind == MATCH:
                        got.append(Records.unpack(blob, _MATCH))
                    else:
                        out.append((bucket, kind, blob))
            f = interval_join(Records.join(got, _MATCH))
            pid = base.mix(base.mix(base.mix((f.d ^ f.h).view("<u8")) + f.s) ^ base.mix((f.d0 ^ f.h0).view("<u8") + np.uint64(77) + f.s0))
            two = [Records(pid=pid, side=np.full(len(f), side, "u1"), d=d, h=h, p=p, n=m) for side, d, h, p, m in ((0, f.d0, f.h0, f.s0, f.n0), (1, f.d, f.h, f.s, f.n))]
            yield from told.add(ASK, Records.join(two, _ASK))
            yield _batch(out)
        yield from told.flush()

    def fetch(batches):
        for part in base.by_bucket(batches):
            got, texts = by_kind(part, {ASK: _ASK})
            if not len(got[ASK]):
                continue
            for c in base.chunks(texts, "x"):
                yield from _answers(got[ASK], c)

    def _answers(asked, c):
        d, h = np.asarray(c.column(3)), np.asarray(c.column(4))
        mine = [of_document(asked, int(d[i]), int(h[i])) for i in range(c.num_rows)]
        wanted = [i for i, r in enumerate(mine) if len(r)]
        if not wanted:
            return
        data, off = base.text_buffers(c.column(5).take(pa.array(wanted)))
        start, end, first = base.words(data, off)
        sh, _, begin = base.shingles(base.word_hashes(data, start, end), first, SHINGLE)
        sh = (sh >> np.uint64(32)).astype("<u4")
        which = np.repeat(np.arange(len(wanted)), [len(mine[i]) for i in wanted])
        r = asked.take(np.concatenate([mine[i] for i in wanted]))
        a = begin[which] + np.minimum(r.p, begin[which + 1] - begin[which])
        size = np.minimum(a + r.n, begin[which + 1]) - a
        r.cols["n"] = size.astype("<u4")
        bucket = (r.pid % np.uint64(n)).astype(np.int64)
        # a passage that very many ask for is answered in slices
        piece = np.cumsum(size) // HELD
        for lo, hi in zip(*_edges(piece), strict=True):
            order = lo + np.argsort(bucket[lo:hi], kind="stable")
            out = []
            for x, y in zip(*_edges(bucket[order]), strict=True):
                i = order[x:y]
                out.append((int(bucket[i[0]]), ASK, r.take(i).pack() + sh[ragged(a[i], size[i])].tobytes()))
            yield _batch(out)

    def check(batches):
        for part in base.by_bucket(batches):
            rs, values = [], []
            for b in part:
                for blob in b.column(2).to_pylist():
                    r = Records.unpack(blob, _ASK)
                    rs.append(r)
                    values.append(np.frombuffer(blob, "<u4", int(r.n.sum(dtype=np.int64)), len(r.pack())))
            r, v = Records.join(rs, _ASK), np.concatenate(values)
            begin = np.cumsum(r.n.astype(np.int64)) - r.n
            order = np.lexsort((r.side, r.pid))
            out, seen = [], set()
            for i, j in zip(order[:-1], order[1:], strict=True):
                if r.pid[i] != r.pid[j] or r.side[i] == r.side[j] or r.pid[j] in seen:
                    continue
                seen.add(r.pid[j])
                a, b = (v[begin[k] : begin[k] + r.n[k]] for k in (i, j))
                for s, e, s0, e0, sim in verify(a, b):
                    more = SHINGLE - 1
                    out.append((int(r.d[j]), int(r.h[j]), int(r.p[j]) + s, e - s + more, int(r.d[i]), int(r.h[i]), int(r.p[i]) + s0, e0 - s0 + more, sim))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 8 else pa.int64()) for k, c in enumerate(cols)], names=["d", "h", "s", "n", "d0", "h0", "s0", "n0", "similarity"])

    def left_open(batches):
        for part in base.by_bucket(batches):
            got, texts = by_kind(part, {RUN: _RUN, MARK: _MARK})
            if not len(got[MARK]):
                continue
            known = RunsOf(got[RUN])
            for c in base.chunks(texts, "x"):
                d, h = np.asarray(c.column(3)), np.asarray(c.column(4))
                mine = [of_document(got[MARK], int(d[i]), int(h[i])) for i in range(c.num_rows)]
                some = [i for i, r in enumerate(mine) if len(r) and got[MARK].size[r].any()]
                if not some:
                    continue
                _, r, content = open_windows(*base.text_buffers(c.column(5).take(pa.array(some))), [got[MARK].take(mine[i]) for i in some], [known(int(d[i]), int(h[i])) for i in some])
                at = np.concatenate([[0], np.cumsum(r.n.astype(np.int64))])
                bucket = (base.mix(r.v + r.block) % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out = []
                for x, y in zip(*_edges(bucket[order]), strict=True):
                    i = order[x:y]
                    out.append((int(bucket[i[0]]), OPEN, r.take(i).pack() + content[ragged(at[i], r.n[i].astype(np.int64))].tobytes()))
                yield _batch(out)

    def by_value_again(batches):
        told = Outbox(n)
        for part in base.by_bucket(batches):
            rs, contents = [], []
            for b in part:
                for blob in b.column(2).to_pylist():
                    r = Records.unpack(blob, _OPEN)
                    rs.append(r)
                    contents.append(np.frombuffer(blob, "<u2", int(r.n.sum(dtype=np.int64)), len(r.pack())))
            r, content = Records.join(rs, _OPEN), np.concatenate(contents)
            # whole values at a time, so that what settle lays out is of bounded size
            slices = len(content) // HELD + 1
            piece = ((base.mix(r.v + r.block) >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
            size = r.n.astype(np.int64)
            at = np.cumsum(size) - size
            for k in range(slices):
                i = np.flatnonzero(piece == k)
                yield from told.add(MATCH, settle(r.take(i), content[ragged(at[i], size[i])]))
        yield from told.flush()

    def verified(asks, tag):
        told = beside(docs, asks, n).mapInArrow(fetch, _BLOBS)
        return base.stash(dealt(told).mapInArrow(check, "d long, h long, s long, n long, d0 long, h0 long, s0 long, n0 long, similarity double"), tag)

    docs = docs.select("d", "h", "x")
    asks = base.stash(dealt(dealt(docs.mapInArrow(scan, _BLOBS)).mapInArrow(by_value, _BLOBS)).mapInArrow(by_document, _BLOBS), "passages-asked")
    found = verified(asks.where(F.col("kind") == ASK), "passages")
    # what the leads leave open: exactly, with all earlier windows of the same value
    told = asks.where(F.col("kind") == MARK).unionByName(run_blobs(found, n))
    left = dealt(beside(docs, told, n).mapInArrow(left_open, _BLOBS)).mapInArrow(by_value_again, _BLOBS)
    again = base.stash(dealt(left).mapInArrow(by_document, _BLOBS), "passages-asked")
    more = verified(again, "passages")
    base.release(asks, again)
    return found.unionByName(more)


def _edges(x: np.ndarray) -> tuple[list[int], list[int]]:
    """(starts, ends) of the runs of equal values."""
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else []
    return cut[:-1], cut[1:]


def run_blobs(found: DataFrame, n: int) -> DataFrame:
    """Blobs of the runs of ``found``, dealt to the buckets of their documents."""

    def pack(batches):
        for b in batches:
            r = unite(Records(d=np.asarray(b.column(0)).astype("<i8"), h=np.asarray(b.column(1)).astype("<i8"), s=np.asarray(b.column(2)).astype("<u4"), n=np.asarray(b.column(3)).astype("<u4")))
            yield _batch(r.dealt(_bucket(r.d, r.h, n), RUN))

    return found.select("d", "h", "s", "n").mapInArrow(pack, _BLOBS)


def passage_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (key, n_spans, n_removed, sources, spans).

    ``spans`` are (start word, words, source id, source start word, similarity) of passages of PASSAGE words or more that
    are near an earlier document's: Jaccard similarity of their five-word shingles THRESHOLD or more.  ``n_removed``
    counts words in any.  Passages repeated inside one document only are none.  Null texts are empty; a null id is after
    all others; rows equal in id and text are one document, each with its result; rows with one id (or none) but different texts
    are different documents, in the order of a hash of theirs.  A very long text is a chunk of its task.  An empty table gives an
    empty result; other columns are not read, whatever their names.
    """
    rows = _prepared(docs, key, text)
    found = near_passages(rows.drop("id"), base.buckets_for(docs))
    span = F.struct(F.col("s").alias("start"), F.col("n").alias("words"), F.nullif(F.col("d0"), F.lit(_NULL_ID)).alias("source"), F.col("s0").alias("source_start"), F.round("similarity", 6).alias("similarity"))
    per = found.groupBy(F.col("d").alias("fd"), F.col("h").alias("fh")).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    # words in the union of spans: spans come by start; each adds what lies beyond the furthest end so far
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("words"))
    add = lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["words"]).alias("end"), (acc["words"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["words"] - F.greatest(acc["end"], x["start"]))).alias("words"))
    per = per.withColumn("n_removed", F.aggregate("spans", state, add, lambda acc: acc["words"]))
    got = rows.select("d", "h", "id").join(per, (F.col("d") == F.col("fd")) & (F.col("h") == F.col("fh")), "left")
    return got.select(
        F.col("id").alias(key),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_sort(F.array_distinct(F.col("spans.source"))), F.array().cast("array<long>")).alias("sources"),
        F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("spans"),
    )


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of their texts, from each one's first word to its last; other columns and rows stay.

    A text that loses everything is empty; null texts stay null.  Documents count as in ``passage_dedup``.
    """
    n = base.buckets_for(docs)
    found = near_passages(_prepared(docs, key, text).drop("id"), n)
    others = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*others).alias("row"), F.col(text).isNull().alias("none"), F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    rows = whole.select("row", "none", F.coalesce(F.col("__k").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64("x").alias("h"), "x")
    both = beside(rows, run_blobs(found, n), n)
    row_at, none_at = both.columns.index("row"), both.columns.index("none")

    def cut(batches):
        for part in base.by_bucket(batches):
            got, texts = by_kind(part, {RUN: _RUN})
            runs_of = RunsOf(got[RUN])
            for c in base.chunks(texts, "x"):
                out = c.column(5).to_pylist()
                for i, (d, h, none) in enumerate(zip(c.column(3).to_pylist(), c.column(4).to_pylist(), c.column(none_at).to_pylist(), strict=True)):
                    s, k = runs_of(d, h)
                    if none:
                        out[i] = None
                    elif len(s):
                        out[i] = without_words(out[i], s, k)
                yield pa.RecordBatch.from_arrays([c.column(row_at), pa.array(out, pa.string())], names=["row", "x"])

    kind = whole.schema["row"].dataType.simpleString()
    got = both.mapInArrow(cut, f"row {kind}, x string")
    return got.select(*[F.col("x").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_words(text: str, start: np.ndarray, size: np.ndarray) -> str:
    """``text`` without runs of words, each cut from its first word's first byte to its last word's last."""
    raw = text.encode("utf-8", "surrogatepass")
    lo, hi, _ = base.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for p, q in zip(start.tolist(), (start + size).tolist(), strict=True):
        out.append(raw[at : lo[p]])
        at = int(hi[q - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")
