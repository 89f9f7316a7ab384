"""URL filters over a sorted digest array.

Every rule is a string ``host/path``; its 64-bit xxhash is a key of one sorted
array, a file in the shared folder which workers memory-map.  A URL probes with the digests of all pairs
(suffix of its host, prefix of its path as long as some rule's path) in one
vectorised binary search per batch, and every hit is confirmed against the
stored full string, so a digest collision cannot decide anything.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


@dataclass(frozen=True)
class Rule:
    text: str  # host, then a path from its first "/"
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


class DigestArray:
    """Sorted xxhash64 keys with their full strings, laid out in one flat file:
    count, keys, string offsets, verdict codes, string bytes."""

    VERDICTS = ("allow", "block")

    def __init__(self, buf) -> None:
        n = int(np.frombuffer(buf, "<u8", 1)[0])
        at = 8
        self.keys = np.frombuffer(buf, "<u8", n, at)
        self.offsets = np.frombuffer(buf, "<u8", n + 1, at := at + 8 * n)
        self.codes = np.frombuffer(buf, "u1", n, at := at + 8 * (n + 1))
        self.blob = memoryview(buf)[at + n :]

    @staticmethod
    def pack(rules: list[Rule]) -> bytes:
        """Rules with equal strings: the last one holds."""
        last = {r.text: r for r in rules}
        rows = sorted((xxhash.xxh64_intdigest(t.encode()), t.encode(), DigestArray.VERDICTS.index(r.verdict)) for t, r in last.items())
        off = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype("<u8")
        return b"".join(
            [np.array([len(rows)], "<u8").tobytes(), np.array([r[0] for r in rows], "<u8").tobytes(), off.tobytes(), bytes(r[2] for r in rows), b"".join(r[1] for r in rows)]
        )

    @classmethod
    def opened(cls, uri: str) -> DigestArray:
        """The array of a file: memory-mapped where the folder is a mounted one, read from other stores."""
        if uri.startswith("file:"):
            return cls(np.memmap(re.sub("^file:/*", "/", uri), np.uint8, "r"))
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            return cls(f.read_buffer())

    def string(self, i: int) -> bytes:
        return bytes(self.blob[int(self.offsets[i]) : int(self.offsets[i + 1])])

    def find(self, strings: list[bytes]) -> np.ndarray:
        """For each string its position in the array, or -1."""
        got = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return got
        want = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, want)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == want[i]:  # equal digests lie side by side
                if self.string(k) == strings[i]:
                    got[i] = k
                    break
                k += 1
        return got


@functools.cache
def _opened(uri: str) -> DigestArray:
    return DigestArray.opened(uri)


_URL = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.match(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every row's URL: (key, host, path, rule, verdict).

    Null URLs and such without ``://`` have empty host and path and get ``default``.
    Of several fitting rules the longest string wins, then the longer host.  Repeated rows
    are judged each; very long URLs are tried whole; an empty table gives an empty result; other columns are not read.
    Only the file's name and the paths' lengths travel with the tasks, however long the list.
    """
    from pyarrow import fs

    uri = base.fresh_path(pages.sparkSession, "digests")
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(DigestArray.pack(rules))
    lengths = sorted({len(r.path) for r in rules}, reverse=True)

    def judge(batches):
        index = _opened(uri)
        for b in batches:
            hosts, paths, tries, owner = [], [], [], []
            for i, u in enumerate(b.column(1).to_pylist()):
                host, path = split_url(u)
                hosts.append(host)
                paths.append(path)
                labels = host.split(".") if host else []
                for n in lengths:
                    if n <= len(path):
                        for k in range(len(labels)):
                            tries.append((".".join(labels[k:]) + path[:n]).encode("utf-8", "surrogatepass"))
                            owner.append(i)
            best: list[tuple[int, int, int] | None] = [None] * b.num_rows
            hit = index.find(tries)
            for j in np.flatnonzero(hit >= 0):
                s = tries[j]
                rank = (len(s), s.find(b"/") if b"/" in s else len(s), int(hit[j]))
                i = owner[j]
                if best[i] is None or rank > best[i]:
                    best[i] = rank
            rule = [None if x is None else index.string(x[2]).decode() for x in best]
            verdict = [default if x is None else DigestArray.VERDICTS[index.codes[x[2]]] for x in best]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(url)).mapInArrow(judge, f"{key} {kind}, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]

SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
