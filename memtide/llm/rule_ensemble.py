"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on bootstrap samples of labelled rows; every path from
a root to a node is a conjunctive rule; a lasso logistic regression keeps few
of the rules; the fitted rules become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, line_rules

#: The labelled rows that are learnt from, about, at most: those whose ids' hashes lie under a threshold set by their number.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, MIN_LEAF = 40, 3, 32, 20
LASSO, STEPS = 0.002, 400
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "symbol_share", "capital_share", "digit_share", "wide_share", "nav_share", "repeat_share",
    "distinct_share", "echo_share", "duplicate_line_share", "bad_line_share", "words_per_line", "ended_share", "comma_share",
)

_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_COMMA = np.isin(np.arange(256), list(b",;:"))
_STOP = np.isin(np.arange(256), list(b".!?"))


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of every text of a chunk, one row each; all 0 for a text without words."""
    m = line_rules.measure(data, off)
    lo, hi = off[:-1], off[1:]
    start, end, first, h = m["_words"]
    doc = base.doc_of(first)
    docs = len(off) - 1
    echo = np.zeros(len(h), bool)
    if len(h) > 1:
        echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.zeros(docs, np.int64)
    if len(h):
        key = base.mix(h + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(h), bool)
        new[1:] = key[1:] != key[:-1]
        distinct = np.bincount(doc[order[new]], minlength=docs)
    count = lambda mask: (lambda c: c[hi] - c[lo])(line_rules._sums(mask))
    nav = np.bincount(doc, (end - start == 1) & line_rules._NAV[data[start]], docs) if len(h) else np.zeros(docs)
    stops = np.bincount(doc, _STOP[data[end - 1]], docs) if len(h) else np.zeros(docs)
    w = m["n_words"].astype(float)
    c = m["word_chars"].astype(float)
    share = lambda x, of: np.where(of > 0, x / np.maximum(of, 1), 0.0)
    wide = count((data & 0xC0) == 0xC0)
    return np.column_stack(
        [
            w,
            share(c, w),
            share(m["n_symbols"], c),
            share(count(line_rules._CAPITAL[data]), c),
            share(count(_DIGIT[data]), c),
            share(wide, c),
            share(nav, w),
            share(m["n_repeat_words"], w),
            share(distinct, w),
            share(np.bincount(doc, echo, docs) if len(h) else np.zeros(docs), w),
            share(m["n_dup_lines"], m["n_lines"]),
            share(m["n_bad_lines"], m["n_lines"]),
            share(w, m["n_lines"]),
            share(stops, w),
            share(count(_COMMA[data]), w),
        ]
    )


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, FEATURES) per row of ``docs``."""

    def run(batches):
        for b in base.chunks(batches, text):
            x = np.round(statistics(*base.text_buffers(b.column(0))), 6)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(FEATURES)))], names=[*b.schema.names[1:], *FEATURES])

    cols = [F.col(text), F.col(key), *(F.col(c) for c in keep)]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    return docs.select(*cols).mapInArrow(run, ", ".join([*kinds, *(f"{f} double" for f in FEATURES)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature index, True for above / False for at most, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            out = out & ((F.col(FEATURES[f]) > t) if above else (F.col(FEATURES[f]) <= t))
        return out


@dataclass
class RuleModel:
    bias: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The model as a Spark expression over the FEATURES columns."""
        z = F.lit(float(self.bias))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(code: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, allowed: np.ndarray, path: tuple, depth: int, out: set) -> None:
    """Split ``rows`` by the best Gini gain over binned features; each node's path is a rule."""
    if path:
        out.add(path)
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return
    best = (1e-9, None)
    total, pos = len(rows), y[rows].sum()
    if pos in (0, total):
        return
    base_gini = pos * (total - pos) / total
    for f in allowed:
        if not len(cuts[f]):
            continue
        n = np.bincount(code[rows, f], minlength=len(cuts[f]) + 1)
        p = np.bincount(code[rows, f], y[rows], len(cuts[f]) + 1)
        nl, pl = np.cumsum(n)[:-1], np.cumsum(p)[:-1]
        nr, pr = total - nl, pos - pl
        ok = (nl >= MIN_LEAF) & (nr >= MIN_LEAF)
        gain = np.where(ok, base_gini - pl * (nl - pl) / np.maximum(nl, 1) - pr * (nr - pr) / np.maximum(nr, 1), -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (int(f), k))
    if best[1] is None:
        return
    f, k = best[1]
    left = code[rows, f] <= k
    for above, side in ((False, rows[left]), (True, rows[~left])):
        _grow(code, cuts, y, side, allowed, (*path, (f, above, float(cuts[f][k]))), depth - 1, out)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Rules from TREES bootstrap trees, weighted by a lasso logistic regression (FISTA).  One class only: the constant prior."""
    n = len(y)
    if n == 0:
        return RuleModel()
    prior = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if y.min() == y.max():
        return RuleModel(float(prior))
    rng = np.random.default_rng(seed)
    cuts = [base.distinct(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # a feature that is mostly one value still needs a cut beside it
    cuts = [base.distinct(np.concatenate([c, np.quantile(x[y == 0, f], [0.05, 0.25, 0.5])])) for f, c in enumerate(cuts)]
    code = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    paths: set = set()
    for _ in range(TREES):
        rows = rng.integers(0, n, n)
        allowed = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        _grow(code, cuts, y.astype(float), rows, allowed, (), DEPTH, paths)
    rules = [Rule(p) for p in sorted(paths)]
    z = np.column_stack([r.holds(x) for r in rules]).astype(np.float32) if rules else np.zeros((n, 0), np.float32)
    mean, dev = z.mean(0), z.std(0)
    use = dev > 0.005
    z, mean, dev, rules = (z[:, use] - mean[use]) / dev[use], mean[use], dev[use], [r for r, u in zip(rules, use, strict=True) if u]
    w = v = np.zeros(z.shape[1])
    b = vb = prior
    step, t = 4 * n / max(np.linalg.norm(z, 2) ** 2 + n, 1), 1.0
    for _ in range(STEPS):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        w_new = v - step * (z.T @ g) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * LASSO, 0)
        b_new = vb - step * g.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    keep = np.abs(w) > 1e-4
    raw = w[keep] / dev[keep]
    return RuleModel(round(float(b - raw @ mean[keep]), 9), [r for r, k in zip(rules, keep, strict=True) if k], [round(float(a), 9) for a in raw])


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text divisible by 5.  A null id counts as held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_TRAIN) -> DataFrame:
    """(key, label, FEATURES) of about ``limit`` labelled documents that are not held out, in no order.

    A document labelled twice counts with its larger label; null labels and null ids are none.  Of rows that share an id the
    one with the least statistics is learnt from.  The ids that are looked for are bounded by ``limit``, so they are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("__k"), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__x")).join(F.broadcast(known), "__k")
    stats = text_statistics(rows, "__k", "__x", ("__y",))
    return stats.groupBy("__k", "__y").agg(F.min(F.struct(*FEATURES)).alias("x")).select("__k", "__y", "x.*")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_TRAIN) -> RuleModel:
    """Fit on the training rows: only those documents' statistics are computed, and some MB of them come to the driver."""
    rows = training_rows(docs, labels, key, text, label, limit).toPandas().sort_values("__k")
    return fit(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["__y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row: (key, *keep, FEATURES, held_out, score, predicted).  One pass, no shuffle of the documents.

    Null and empty texts have all statistics 0 and are scored like any other; repeated rows are scored each; a score at
    the threshold passes; a very long text is one chunk of its task.  Without labels every score is 0.5; an empty table
    gives an empty result.  Columns other than ``keep`` are not read; those may have no name of FEATURES.
    """
    model = train(docs, labels, key, text)
    scored = text_statistics(docs, key, text, keep).withColumn("held_out", held_out(F.col(key))).withColumn("score", model.column())
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
