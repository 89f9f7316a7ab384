"""Near-duplicate documents by consistent weighted sampling.

Texts are bags of five-word shingles weighted tf x idf; 64 improved consistent
weighted samples of each bag are banded; texts that share a band are candidates
and are verified by exact weighted Jaccard similarity; verified links make
classes.  Exact copies are one node from the start.

A shingle's idf is the mean idf of its words, word frequencies being counted
over all documents into a fixed number of hashed features.  (With a frequency
per shingle a group of copies would lower the weight of what its members share
and so push itself under the threshold; and the table would have no bound.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, graph

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Hashed features of the word frequencies: the idf table that every task gets is this long whatever the corpus.
FEATURES = 1 << 18
SLICES = 16
#: Candidates compared with one copy of their hub, and members of a block in the exact all-pairs pass.
FAN, BLOCK = 256, 128

_rng = np.random.default_rng(1234567)
_POOL = 1 << 16
_R = _rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)
_BETA = _rng.random(_POOL).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = np.uint64((1 << 44) - 1)


def _word_features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def bags(data: np.ndarray, off: np.ndarray, idf: np.ndarray):
    """Weighted shingle bags of a chunk of texts: (text of each entry, 44-bit shingle key ascending within its text, weight)."""
    start, end, first = base.words(data, off)
    h = base.word_hashes(data, start, end)
    sh, at, begin = base.shingles(h, first, SHINGLE)
    doc = base.doc_of(begin)
    if not len(sh):
        return doc, sh, np.zeros(0, np.float32)
    upto = np.concatenate([[0.0], np.cumsum(idf[_word_features(h)], dtype=np.float64)])
    stop = np.minimum(at + SHINGLE, first[1:][doc])
    mean = (upto[stop] - upto[at]) / (stop - at)
    key = (doc.astype(np.uint64) << np.uint64(44)) | (sh >> np.uint64(20))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.concatenate([at, [len(key)]]))
    # the weight is rounded so that equal shingles weigh the same whatever their place in a chunk
    weight = np.round(mean[order[at]], 3) * tf
    return doc[order[at]], key[at] & _KEY, weight.astype(np.float32)


def samples(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """BANDS x ROWS consistent weighted samples of every text that has shingles: (texts, samples as 32-bit numbers).

    A sample is the shingle of least ln a = ln c - r (t - beta + 1), t = floor(ln w / r + beta), with its t.
    r, c and beta come from a pool by a hash of shingle and sample number; ties fall to the lower shingle hash.
    """
    have = np.flatnonzero(np.bincount(doc, minlength=docs)) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((len(have), BANDS * ROWS), np.uint32)
    if not len(have):
        return have, out
    begin = np.searchsorted(doc, have)
    ln_w = np.log(weight)
    h = base.mix(key)
    ident = (h >> np.uint64(40)) << np.uint64(8)
    for k in range(BANDS * ROWS):
        i = ((h * _ODD[k]) >> np.uint64(48)).astype(np.uint16)
        beta, r = _BETA[i], _R[i]
        t = np.floor(ln_w * _INV_R[i] + beta)
        a = _LN_C[i] - r * (t - beta + np.float32(1)) + np.float32(128)
        np.maximum(a, np.float32(1e-6), out=a)
        packed = (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | ident | (t.astype(np.int64).astype(np.uint64) & np.uint64(255))
        out[:, k] = np.minimum.reduceat(packed, begin).astype(np.uint32)
    return have, out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for r in range(ROWS):
        acc = base.mix(acc ^ (s[:, :, r] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return acc.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (ascending keys, weights)."""
    (ka, wa), (kb, wb) = a, b
    total = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64))
    if total == 0 or min(wa.sum(), wb.sum()) < 0.5 * max(wa.sum(), wb.sum()):
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    hit = kb[at] == ka
    both = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype=np.float64))
    return both / (total - both)


def word_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf of FEATURES hashed words over all rows: each task sums its documents, slices of the counts are summed by tasks."""
    width = FEATURES // SLICES

    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for b in base.chunks(batches, text):
            data, off = base.text_buffers(b.column(0))
            start, end, first = base.words(data, off)
            f = _word_features(base.word_hashes(data, start, end))
            seen = base.distinct(base.doc_of(first) * FEATURES + f) % FEATURES
            total += np.bincount(seen, minlength=FEATURES)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[i * width : (i + 1) * width].astype("<u4").tobytes() for i in range(SLICES)], pa.binary()), pa.array([n] * SLICES, pa.int64())], names=["s", "c", "n"])

    def add(batches):
        got: dict[int, list] = {}
        for b in batches:
            for s, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                old = got.setdefault(s, [np.zeros(width, np.int64), 0])
                old[0] += np.frombuffer(c, "<u4")
                old[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v[0].astype("<i8").tobytes() for v in got.values()], pa.binary()), pa.array([v[1] for v in got.values()], pa.int64())], names=["s", "c", "n"])

    schema = "s int, c binary, n long"
    rows = docs.select(text).mapInArrow(count, schema).repartition(SLICES, "s").mapInArrow(add, schema).collect()  # SLICES rows, FEATURES numbers
    df, n = np.zeros(FEATURES), 0
    for r in rows:
        df[r.s * width : (r.s + 1) * width] = np.frombuffer(r.c, "<i8")
        n = max(n, r.n)
    return (np.log((1 + n) / (1 + np.minimum(df, n))) + 1).astype(np.float32)


def node(text) -> F.Column:
    """The identity of a text: equal texts are one node."""
    return F.unhex(F.md5(text))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, first, copies, class_id, class_node): every distinct text with its smallest id, number of rows, and its class.

    ``class_id`` is the smallest id in the class and ``class_node`` the text that bears it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    idf = spark.sparkContext.broadcast(word_idf(docs, "x"))

    def sign(batches):
        for b in base.chunks(batches, "x"):
            data, off = base.text_buffers(b.column(0))
            have, sig = samples(*bags(data, off, idf.value), b.num_rows)
            keys = band_keys(sig)
            n = np.zeros(b.num_rows, np.int64)
            n[have] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), lists], names=["k", "node", "bands"])

    kind = docs.schema["k"].dataType.simpleString()
    signed = docs.select("x", "k", node(F.col("x")).alias("node")).mapInArrow(sign, f"k {kind}, node binary, bands array<long>")
    texts = base.stash(signed.groupBy("node").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "texts")

    member = texts.select("node", F.explode("bands").alias("band"))
    sized = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("set"), F.min("node").alias("least")).where("n > 1")
    # bands with the same members are looked at once; their number counts in the degree
    groups = sized.groupBy("n", "set", "least").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("same"))
    members = base.stash(member.join(groups.select("band", "n", "same"), "band"), "members")
    # each group's hub is its member that shares most bands with most others: of edited copies, the original
    degree = members.groupBy("node").agg(F.sum(F.col("n") * F.col("same")).alias("degree"))
    ranked = members.join(degree, "node")
    # written tables on both sides of the joins that follow, so that a hot band's rows can be split over tasks
    hubs = base.stash(ranked.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("hub")), "hubs")
    stars = base.stash(members.join(hubs, "band").where("node <> hub").select("hub", "node").distinct(), "stars")
    links = base.stash(_verify_stars(docs, texts, stars, idf), "links")
    label = graph.components(links)

    # groups that the hubs' links left in several classes: all pairs between classes, in blocks
    comp = members.where("n > 2").join(label.select("node", "label"), "node", "left").select("band", "n", "node", F.coalesce("label", "node").alias("label"))
    open_ = base.stash(comp.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band"), "open-bands")
    rest = base.stash(comp.join(open_, "band"), "open")
    used = [members, hubs, stars, links, open_, rest]
    if rest.limit(1).count():
        more = base.stash(_verify_blocks(docs, texts, rest, idf), "links")
        used += [label, more]
        label = graph.components(links.union(more))

    owned = texts.select("node", "first", "copies").join(label.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = base.stash(owned.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best")).select("label", F.col("best.first").alias("class_id"), F.col("best.node").alias("class_node")), "best")
    classes = base.stash(owned.join(best, "label").select("node", "first", "copies", "class_id", "class_node"), "classes")
    base.release(*used, label, best, texts)
    return classes


def _texts_of(docs, wanted):
    """Texts for ``wanted`` (node, first, ...): read from the first row of each node, so copies are not expanded."""
    mine = docs.select("k", node(F.col("x")).alias("node_"), "x")
    return mine.join(wanted, mine["node_"].eqNullSafe(wanted["node"]) & mine["k"].eqNullSafe(wanted["first"])).drop("k", "node_", "first")


def _verify_stars(docs, texts, stars, idf):
    """Links hub - node of weighted similarity THRESHOLD or more: tasks stream a hub and up to FAN or so of its candidates."""
    first = texts.select("node", "first")
    fans = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", (F.floor(F.col("n") / FAN) + 1).cast("int").alias("fans"))
    side = stars.join(fans, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("fans")).cast("int").alias("fan"), "node", F.lit(1).alias("role"))
    lead = fans.select("hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("hub").alias("node"), F.lit(0).alias("role"))
    rows = _texts_of(docs, side.union(lead).join(first, "node"))

    def compare(batches):
        at, lead = None, None
        for b in base.chunks(batches, "x"):
            data, off = base.text_buffers(b.column(0))
            doc, key, weight = bags(data, off, idf.value)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            a_, b_, s_ = [], [], []
            for i, (hub, fan, me, role) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                bag = key[cut[i] : cut[i + 1]].copy(), weight[cut[i] : cut[i + 1]].copy()
                if role == 0:
                    at, lead = (hub, fan), bag
                elif at == (hub, fan) and (s := jaccard(lead, bag)) >= THRESHOLD:
                    a_.append(hub)
                    b_.append(me)
                    s_.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary()), pa.array(s_, pa.float64())], names=["a", "b", "similarity"])

    dealt = rows.select("x", "hub", "fan", "node", "role").repartition("hub", "fan").sortWithinPartitions("hub", "fan", "role")
    return dealt.mapInArrow(compare, "a binary, b binary, similarity double")


def _verify_blocks(docs, texts, rest, idf):
    """Links between different classes of the same group, exactly.

    Members outside a group's largest class are dealt to blocks of about BLOCK, and so are all its members; a task's unit is a
    block of the former beside one of the latter.  Inside the largest class nothing is compared, so its texts are copied only
    once for each block of others.
    """
    first = texts.select("node", "first")
    per = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    most = base.stash(per.groupBy("band").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all")).select("band", F.col("m.label").alias("most"), blocks_of(F.col("all")).alias("of_all"), blocks_of(F.col("all") - F.col("m.c")).alias("of_few")), "most")
    dealt = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    mine = rest.select("band", "node", "label").join(most, "band")
    few = mine.where("label <> most").select("band", dealt("of_few").alias("p"), each("of_all").alias("q"), F.lit(0).alias("role"), "node", "label")
    other = mine.select("band", each("of_few").alias("p"), dealt("of_all").alias("q"), F.lit(1).alias("role"), "node", "label")
    rows = _texts_of(docs, few.union(other).join(first, "node"))

    def compare(batches):
        at, held = None, []
        for b in base.chunks(batches, "x"):
            data, off = base.text_buffers(b.column(0))
            doc, key, weight = bags(data, off, idf.value)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            a_, b_, s_ = [], [], []
            for i, (band, p, q, role, me, label) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                bag = key[cut[i] : cut[i + 1]].copy(), weight[cut[i] : cut[i + 1]].copy()
                if at != (band, p, q):
                    at, held = (band, p, q), []
                if role == 0:
                    held.append((me, label, bag))
                    continue
                for other_node, other_label, other_bag in held:
                    if label != other_label and (s := jaccard(other_bag, bag)) >= THRESHOLD:
                        a_.append(other_node)
                        b_.append(me)
                        s_.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary()), pa.array(s_, pa.float64())], names=["a", "b", "similarity"])

    units = rows.select("x", "band", "p", "q", "role", "node", "label").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "role")
    return units.mapInArrow(compare, "a binary, b binary, similarity double")


def blocks_of(n):
    return (F.floor(n / BLOCK) + 1).cast("int")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (key, class_id, class_size, n_copies).

    ``class_id`` is the smallest id of the class, ``class_size`` its rows, ``n_copies`` the rows with the very same text.
    Null texts are empty texts; texts without words are near nothing but equal texts; a text of fewer than five words
    is one shingle; a very long text is one bag of a task.  Repeated rows are copies.  A null id is larger than any other; of
    classes' rows with the smallest id the text of least hash counts.  An empty table gives an empty result; other columns
    are not read, whatever their names.
    """
    classes = near_classes(docs, key, text)
    size = base.stash(classes.groupBy("class_node").agg(F.sum("copies").alias("class_size")), "sizes")
    info = classes.join(size, "class_node").select("node", "class_id", "class_size", F.col("copies").alias("n_copies"))
    rows = docs.select(F.col(key), node(F.coalesce(F.col(text), F.lit(""))).alias("node"))
    return rows.join(base.stash(info, "infos"), "node").select(key, "class_id", "class_size", "n_copies")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the smallest id, all columns untouched.

    Texts and ids count as in ``near_dedup``.  Of rows equal in both, whose other columns may differ, one stays, no matter which.
    Texts move once, dealt by text and id, so that a text that very many rows have is spread over the tasks.
    """
    classes = near_classes(docs, key, text)
    known = lambda c: (F.col(c).isNull().alias("__none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__key"))
    stay = base.stash(classes.where(F.col("node") == F.col("class_node")).select(F.col("node").alias("__node"), *known("first")), "stay")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), node(F.coalesce(F.col(text), F.lit(""))).alias("__node"), *known(key))
    return rows.join(stay, ["__node", "__none", "__key"], "left_semi").dropDuplicates(["__node", "__none", "__key"]).select("__row.*")
