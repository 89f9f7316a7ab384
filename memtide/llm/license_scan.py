"""Licence scan: headers, statements and licence files by TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are whole licences, openings of long ones, headers and statements.  A
text's runs of three words are looked up among the templates' own; runs that
agree on where a template would lie name a block of that template's length, and
the block's sparse TF-IDF vector is compared with the template's.  Where the
wording is alike, phrases that a template must have (a version, above all)
decide.  A file that consists mostly of such blocks, starts with a licence's own
text or is named like one is the licence file of its directory; a file without a
licence of its own has that of the nearest ancestor directory that has a licence
file, found by joining directories' ancestor paths.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .licence_texts import Template, templates
from .near_dedup import _word_features, word_idf

LICENCE_FILE = re.compile(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$")

SIMILARITY = 0.7
#: Words of a run; the part of a template's runs that a block shares before it is compared; how far runs' places may drift.
RUN, SHARE, DRIFT = 3, 0.2, 8
#: A file is a licence file if blocks are this part of its words, or if a licence's own text starts within its first words.
MOSTLY, TOP = 0.5, 60
#: Words beside a block in which the phrases that decide may stand.
BESIDE = 4


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = base.words(data, np.array([0, len(data)]))
    return base.word_hashes(data, s, e)


def vector(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words ascending, tf x idf weights of length 1)."""
    u, tf = np.unique(h, return_counts=True)
    w = tf * idf[_word_features(u)].astype(np.float64)
    return u, w / max(np.sqrt((w * w).sum()), 1e-12)


def cosine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    return round(float((a[1][hit] * b[1][at[hit]]).sum()), 6)


def _has(words: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the words stand in a row somewhere."""
    raw, part, at = words.tobytes(), phrase.tobytes(), -1
    while (at := raw.find(part, at + 1)) >= 0:
        if at % 8 == 0:
            return True
    return False


class Index:
    """Templates by their runs of words, with their vectors under an idf."""

    def __init__(self, known: list[Template], idf: np.ndarray) -> None:
        self.known = known
        words = [word_hashes(t.text) for t in known]
        self.size = np.array([len(w) for w in words])
        self.vectors = [vector(w, idf) for w in words]
        self.must = [[[word_hashes(p) for p in group] for group in t.must] for t in known]
        runs = [base.shingles(w, np.array([0, len(w)]), RUN)[0] for w in words]
        self.need = np.array([max(1, int(np.ceil(SHARE * len(r)))) for r in runs])
        run, of = np.concatenate(runs), np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        place = np.concatenate([np.arange(len(r)) for r in runs])
        order = np.argsort(run, kind="stable")
        self.run, self.of, self.place = run[order], of[order], place[order]

    def blocks(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, template, first word, one past the last) of blocks that share enough runs with a template."""
        sh, at, begin = base.shingles(h, first, RUN)
        lo, hi = np.searchsorted(self.run, sh), np.searchsorted(self.run, sh, side="right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return np.zeros((0, 4), np.int64)
        n = (hi - lo)[hit]
        k = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.repeat(np.searchsorted(begin, hit, side="right") - 1, n)
        t, start = self.of[k], np.repeat(at[hit], n) - self.place[k]
        order = np.lexsort((start, t, doc))
        doc, t, start = doc[order], t[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (start[1:] - start[:-1] > DRIFT)
        top = np.flatnonzero(new)
        votes = np.diff(np.concatenate([top, [len(doc)]]))
        ok = votes >= self.need[t[top]]
        top, votes = top[ok], votes[ok]
        doc, t, middle = doc[top], t[top], start[top + votes // 2]
        a = np.maximum(middle, first[doc])
        z = np.minimum(middle + self.size[t], first[doc + 1])
        return np.column_stack([doc, t, a, z])[z > a]

    def matches(self, h: np.ndarray, first: np.ndarray, idf: np.ndarray, similarity: float) -> dict[int, list]:
        """Of each text its matches (words x similarity, -template, similarity, first word, one past the last), the best of those that overlap."""
        found: dict[int, list] = {}
        for doc, t, a, z in self.blocks(h, first).tolist():
            cos = cosine(vector(h[a:z], idf), self.vectors[t])
            if cos < similarity:
                continue
            near = h[max(a - BESIDE, first[doc]) : min(z + BESIDE, first[doc + 1])]
            if all(any(_has(near, p) for p in group) for group in self.must[t]):
                found.setdefault(doc, []).append((round(cos * (z - a), 6), -t, cos, a, z))
        for doc, m in found.items():
            kept: list = []
            for x in sorted(m, reverse=True):
                if all(x[4] <= y[3] or y[4] <= x[3] for y in kept):
                    kept.append(x)
            found[doc] = kept
        return found


def statements(files: DataFrame, idf: np.ndarray, path: str, text: str, keep: tuple[str, ...] = (), similarity: float = SIMILARITY, known: list[Template] | None = None) -> DataFrame:
    """(keep..., path, license, similarity, licenses, is_licence_file) per row; license is null where no block is like a template.

    Of a file's matches the one of most words times similarity names its licence, of equal ones the first template's.
    """
    shared = files.sparkSession.sparkContext.broadcast((idf, Index(known if known is not None else templates(), idf)))

    def scan(batches):
        idf, index = shared.value
        for b in base.chunks(batches, text):
            data, off = base.text_buffers(b.column(0))
            s, e, first = base.words(data, off)
            found = index.matches(base.word_hashes(data, s, e), first, idf, similarity)
            best, cos, names, own = [], [], [], []
            for i, p in enumerate(b.column(1).to_pylist()):
                m = found.get(i)
                best.append(m and index.known[-m[0][1]].license)
                cos.append(m and m[0][2])
                names.append(sorted({index.known[-x[1]].license for x in m}) if m else [])
                said = sum(x[4] - x[3] for x in m) if m else 0
                begins = bool(m) and any(index.known[-x[1]].whole and x[3] - first[i] <= TOP for x in m)
                own.append(bool(m) and (begins or said >= MOSTLY * (first[i + 1] - first[i]) or bool(p and LICENCE_FILE.search(p))))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], b.column(1), pa.array(best, pa.string()), pa.array(cos, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array([bool(x) for x in own])],
                names=[*keep, "path", "license", "similarity", "licenses", "is_licence_file"],
            )

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}{', ' if kinds else ''}path string, license string, similarity double, licenses array<string>, is_licence_file boolean"
    return files.select(text, path, *keep).mapInArrow(scan, schema)


def directory(path: Column) -> Column:
    """What lies before the last slash; '' for a file at the top."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """A directory and all above it, '' included."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def inherit(stated: DataFrame) -> DataFrame:
    """Add (resolved, origin, origin_path): a file's own licence or that of the nearest ancestor directory's licence file.

    Of several licence files in a directory the one of smallest path counts.  Directories, not files, are joined to their
    ancestors, so a directory of very many files is one row there.
    """
    rows = stated.withColumn("__dir", directory(F.coalesce("path", F.lit(""))))
    held = rows.where("is_licence_file").groupBy("__dir").agg(F.min(F.struct("path", "license")).alias("file")).select(F.col("__dir").alias("__at"), "file")
    up = rows.select("__dir").distinct().select("__dir", F.explode(ancestors(F.col("__dir"))).alias("__at"))
    nearest = up.join(held, "__at").groupBy("__dir").agg(F.max_by("file", F.struct(F.length("__at"), "__at")).alias("__file"))
    got = rows.join(nearest, "__dir", "left")
    own = F.col("license").isNotNull()
    return got.withColumns(
        {
            "resolved": F.when(own, F.col("license")).otherwise(F.col("__file.license")),
            "origin": F.when(own, F.lit("own")).when(F.col("__file").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")),
            "origin_path": F.when(own, F.col("path")).otherwise(F.col("__file.path")),
        }
    ).drop("__dir", "__file")


def license_scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``files``: licences of its own, then what it inherits.

    idf is of all words over all rows, in a table of fixed size.  Null and empty texts state nothing and may inherit; a null
    path is a file at the top; a very long text is scanned whole.  Repeated rows are judged each; an empty table gives an
    empty result; columns other than ``keep``, whose names must not be the result's own, are not read.
    """
    return inherit(base.stash(statements(files, word_idf(files, text), path, text, keep), "statements"))


def document_path(source: Column, doc_id: Column) -> Column:
    """A path for documents, which have none of their own: their source, folders of 4096 and of 64 ids, their id."""
    s = lambda shift: F.coalesce(F.shiftright(doc_id, shift).cast("string"), F.lit("none"))
    return F.concat_ws("/", F.coalesce(source, F.lit("unknown")), s(12), s(6), F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(".txt")))
