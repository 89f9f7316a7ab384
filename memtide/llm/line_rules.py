"""Line-first quality rules.

Each line is judged by itself (ending, navigation, boilerplate, symbols,
shouting); failing lines go; a document is rejected when what went is too
large a part of it, or when it fails the base statistics.  Everything is
computed for a whole Arrow chunk at once with cumulative sums over its bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

# What a prose line may end with, and phrases of page furniture.
ENDINGS = '.!?:;"\')]…”’»'
PHRASES = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "click here",
    "sign up",
    "log in",
    "read more",
    "skip to content",
)
NAV_WORDS = ("|", ">", "/", "-")
SYMBOLS = b"#*$%&|<>"

#: A line fails if symbols exceed this percentage of its word characters, or capitals that one (of lines of 3 words or more).
SYMBOL_PERCENT, CAPITAL_PERCENT = 10, 50
#: A document that loses more than this percentage of its word characters is rejected.
LOST_PERCENT = 50
MIN_WORDS, REPEAT_PERCENT = 10, 20

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_NAV = np.isin(np.arange(256), [ord(w) for w in NAV_WORDS])
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES), re.IGNORECASE)
_ASCII_END = np.isin(np.arange(256), [ord(c) for c in ENDINGS if ord(c) < 128])
_WIDE_END = [c.encode() for c in ENDINGS if ord(c) >= 128]


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeated_words(h: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    """Per text: words inside windows of ``size`` words that its text holds twice or more."""
    sh, at, begin = base.shingles(h, first, size)
    full = np.repeat(np.diff(first) >= size, np.diff(begin))
    sh, at, doc = sh[full], at[full], base.doc_of(begin)[full]
    key = base.mix(sh + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    hit = at[order[same]]
    step = np.zeros(len(h) + size + 1, np.int64)
    step[hit] += 1
    np.subtract.at(step, hit + size, 1)
    cover = _sums(np.cumsum(step[: len(h)]) > 0)
    return cover[first[1:]] - cover[first[:-1]]


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of a chunk of texts, per-line work included; ``_words`` has the words themselves."""
    n, docs = len(data), len(off) - 1
    lo, hi = off[:-1], off[1:]
    space = base.NONSPACE_IN[data]
    start, end, first = base.words(data, off, base.NONSPACE, base.NONSPACE_IN)
    code_points = _sums(~space & ((data & 0xC0) != 0x80))
    symbols, capitals = _sums(_SYMBOL[data]), _sums(_CAPITAL[data])
    h = base.word_hashes(data, start, end, np.arange(256, dtype=np.uint8))
    out = {
        "n_words": np.diff(first),
        "word_chars": code_points[hi] - code_points[lo],
        "n_symbols": symbols[hi] - symbols[lo],
        "n_repeat_words": _repeated_words(h, first),
    }
    # lines
    feeds = np.flatnonzero(data == 10) + 1
    s = base.distinct(np.concatenate([lo[lo < hi], feeds[feeds < n]]))
    e = np.concatenate([s[1:], [n]]) if len(s) else s
    w0, w1 = np.searchsorted(start, s), np.searchsorted(start, e)
    has = w1 > w0
    s, e, w0, w1 = s[has], e[has], w0[has], w1[has]
    doc = np.searchsorted(off, s, side="right") - 1
    body = e - (data[e - 1] == 10) if len(e) else e
    key = base.word_hashes(data, s, body, np.arange(256, dtype=np.uint8)) if len(s) else np.zeros(0, np.uint64)
    key = base.mix(key + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(s), bool)
    if len(s) > 1:
        later[order[1:]] = key[order[1:]] == key[order[:-1]]
    per_doc = lambda v: np.bincount(doc, v, docs).astype(np.int64)
    out["n_dup_lines"] = per_doc(later)
    chars = code_points[e] - code_points[s]
    stop = end[w1 - 1]
    ends = _ASCII_END[data[stop - 1]] if len(s) else np.zeros(0, bool)
    for tail in _WIDE_END:
        m = len(tail)
        ok = stop - m >= s
        for k in range(m):
            ok &= data[np.maximum(stop - m + k, 0)] == tail[k]
        ends |= ok
    nav = _sums((end - start == 1) & _NAV[data[start]])
    nav = nav[w1] - nav[w0]
    words = w1 - w0
    bad = ~ends
    bad |= (nav >= 2) & (nav * 4 >= words)
    bad |= (symbols[e] - symbols[s]) * 100 > SYMBOL_PERCENT * chars
    bad |= (words >= 3) & ((capitals[e] - capitals[s]) * 100 > CAPITAL_PERCENT * chars)
    found = [(m.start(), m.end()) for m in _PHRASE.finditer(data.tobytes())]
    if found and len(s):
        a, b = np.array(found).T
        i = np.searchsorted(s, a, side="right") - 1
        ok = (i >= 0) & (b <= e[i])
        bad[i[ok]] = True
    out["n_lines"] = per_doc(np.ones(len(s)))
    out["n_bad_lines"] = per_doc(bad)
    out["lost_chars"] = per_doc(np.where(bad, chars, 0))
    out["_words"] = (start, end, first, h)
    return out


def line_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row with its counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words: all counts 0, base_failed, not kept; a very long text is a chunk of its task.  Shares at
    a limit pass.  Repeated rows are measured each, an empty table gives an empty result, other columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_chars"]

    def run(batches):
        for b in base.chunks(batches, text):
            got = measure(*base.text_buffers(b.column(1)))
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEAT_PERCENT * got["n_words"])
            kept = ~failed & (100 * got["lost_chars"] <= LOST_PERCENT * got["word_chars"])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[x], pa.int64()) for x in names), pa.array(failed), pa.array(kept)], names=[key, *names, "base_failed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS o FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d))),
lw AS (SELECT doc_id, i, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM ln),
lf AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS later, len(ws) AS nw, length(array_to_string(ws, '')) AS chars,
         right(ws[-1], 1) AS tail, len(list_filter(ws, lambda x: x IN ({", ".join(map(_quote, NAV_WORDS))}))) AS nav,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS cap
       FROM lw WHERE len(ws) > 0),
lb AS (SELECT *, (strpos({_quote(ENDINGS)}, tail) = 0 OR (nav >= 2 AND nav * 4 >= nw) OR sym * 100 > {SYMBOL_PERCENT} * chars
         OR (nw >= 3 AND cap * 100 > {CAPITAL_PERCENT} * chars) OR regexp_matches(line, '(?i){"|".join(PHRASES)}')) AS bad FROM lf),
la AS (SELECT doc_id, count(*) AS n_lines, sum(later::INT) AS n_dup, sum(bad::INT) AS n_bad, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost FROM lb GROUP BY 1),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_bad_lines, coalesce(lost, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT *, base_failed = FALSE AND 100 * lost_chars <= {LOST_PERCENT} * word_chars AS kept
FROM (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM f)
"""
