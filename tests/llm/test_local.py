"""The parts that need no session: each against a plain version of itself."""

import io
import os
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from memtide.llm import base, compact_windows, licence_texts, license_scan, line_rules, near_dedup, packing, registry, rule_ensemble, suffix_dedup, url_filter, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.text(alphabet="aAbB zé\n\t.!|\x00", max_size=40), max_size=6)


def plain_words(t):
    return WORDS.findall(t.translate(UPPER))


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(texts):
    data, off = base.text_buffers(pa.array(texts, pa.string()))
    s, e, first = base.words(data, off)
    raw = "".join(texts).encode()
    low = base.ALNUM[data].tobytes()
    got = [[low[a:b].decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] for i in range(len(texts))]
    assert got == [plain_words(t) for t in texts] and len(raw) == len(data)
    h = base.word_hashes(data, s, e)
    sh, at, begin = base.shingles(h, first, 3)
    seen = {}
    for i, w in enumerate(got):
        want = [tuple(w[j : j + 3]) for j in range(max(len(w) - 2, 1))] if w else []
        mine = sh[begin[i] : begin[i + 1]].tolist()
        assert len(mine) == len(want)
        for k, x in zip(want, mine):
            assert seen.setdefault(k, x) == x
    assert len(set(seen.values())) == len(seen)


def test_text_buffers_of_nulls_and_slices():
    a = pa.array(["ab", None, "", "cdé"])
    for arr in (a, a.slice(1), a.cast(pa.large_string()), a.slice(1, 2)):
        data, off = base.text_buffers(arr)
        assert [data[x:y].tobytes().decode() for x, y in zip(off, off[1:])] == [x or "" for x in arr.to_pylist()]


def test_chunks_are_bounded():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7 + ["y" * 100, ""])], names=["t"])
    got = list(base.chunks([b], "t", limit=25))
    assert sum(x.num_rows for x in got) == 9 and max(x.num_rows for x in got) <= 3


def plain_line_rules(t):
    space = re.compile(r"[\x20\x09-\x0D]+")
    split = lambda x: [w for w in space.split(x) if w]
    w = split(t)
    wins = {}
    for i in range(len(w) - 4):
        wins.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {i + k for v in wins.values() if len(v) > 1 for i in v for k in range(5)}
    seen, dup, lost, bad_n, n = set(), 0, 0, 0, 0
    for line in t.split("\n"):
        lw = split(line)
        if not lw:
            continue
        n += 1
        dup += line in seen
        seen.add(line)
        chars = sum(map(len, lw))
        nav = sum(x in line_rules.NAV_WORDS for x in lw)
        sym = sum(c in "#*$%&|<>" for c in line)
        caps = sum("A" <= c <= "Z" for c in line)
        bad = lw[-1][-1] not in line_rules.ENDINGS or (nav >= 2 and nav * 4 >= len(lw)) or sym * 100 > 10 * chars or (len(lw) >= 3 and caps * 100 > 50 * chars) or any(p in line.lower() for p in line_rules.PHRASES)
        bad_n += bad
        lost += chars if bad else 0
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup, "n_repeat_words": len(cover), "n_lines": n, "n_bad_lines": bad_n, "lost_chars": lost}


@given(st.lists(st.text(alphabet=st.sampled_from(list("abA .\n|*!é…\x0b\x00")), max_size=60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_line_rules(texts):
    texts = [*texts, "All Rights Reserved.\nfine line.", "a b c d e f a b c d e f a b c d e.\na b.\na b."]
    got = line_rules.measure(*base.text_buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items() if k != "_words"} == plain_line_rules(t), t


def test_url_split_and_digest_array(tmp_path):
    assert url_filter.split_url("HTTP://A.Example.NET/x?q#f") == ("a.example.net", "/x")
    assert url_filter.split_url(None) == url_filter.split_url("no scheme") == ("", "")
    assert url_filter.split_url("x://h?a/b") == ("h", "") and url_filter.split_url("x://É.Z") == ("É.z", "")
    rules = [url_filter.Rule(f"h{i}.net/{i}", "block") for i in range(1000)]
    (tmp_path / "d").write_bytes(url_filter.DigestArray.pack(rules))
    d = url_filter.DigestArray.opened(f"file://{tmp_path}/d")
    assert isinstance(d.keys.base, np.memmap) or isinstance(d.keys, np.memmap) or d.keys.base is not None
    asked = [f"h{i}.net/{i}".encode() for i in range(0, 2000, 7)]
    assert [k >= 0 for k in d.find(asked)] == [i < 1000 for i in range(0, 2000, 7)]
    clash = url_filter.DigestArray(url_filter.DigestArray.pack(rules[:3]))
    clash.keys = np.full(3, url_filter.xxhash.xxh64_intdigest(b"h1.net/1"), np.uint64)  # every digest collides
    assert clash.string(int(clash.find([b"h1.net/1"])[0])) == b"h1.net/1"


def test_packing_windows():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 4096, 3000)
    seq, at = packing.best_fit_decreasing(n)
    for s in np.unique(seq):
        i = np.flatnonzero(seq == s)
        i = i[np.argsort(at[i])]
        assert at[i[0]] == 0 and (at[i[1:]] == at[i[:-1]] + n[i[:-1]]).all() and n[i].sum() <= 4096
    # best fit: the tightest open window, against a plain search
    room, want = [], []
    for x in sorted(n.tolist(), reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            r = min(fits)
            room.remove(r)
        else:
            r = 4096
        if r > x:
            room.append(r - x)
        want.append(r - x)
    assert seq.max() + 1 == (n.sum() + sum(room)) // 4096
    assert packing.best_fit_decreasing(np.array([4096, 1, 4095]))[0].tolist() == [0, 1, 1]


def test_encoder_equals_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    texts = ["", "a\x1cb ć ́x", "<|endoftext|> hi<|startoftext|>", "it's they'll ΑΣ Σ", "　x y\r\nz", "x\x85y", "Straße-ÉCOLE!! (a) \n\n b", "ÿÀ×÷ 12 ½", "x" * 3000]
    ref = Tokenizer.from_file(registry.tokenizer_path())
    for limit in (packing.CACHE_CHUNKS, 3):
        monkeypatch.setattr(packing, "CACHE_CHUNKS", limit)
        e = packing.Encoder(registry.tokenizer_path())
        for _ in range(2):
            ids, bound = e.encode(texts)
            for i, t in enumerate(texts):
                assert ids[bound[i] : bound[i + 1]].tolist() == [*ref.encode(t, add_special_tokens=False).ids, 2], t


def test_warc_archive():
    rows = [warc.record(i, None if i % 3 else f"http://x/{i}\r\n", b"<html>" + bytes([65 + i % 7]) * i, "0" * 64, 1 if i % 5 == 0 else None, "d") for i in range(60)]
    for part in (rows, rows[:1], rows[:3]):
        raw = warc.encode_archive(part)
        assert raw[:4] == b"\x5d\x2a\x4d\x18"
        got = list(warc.decode_archive(io.BytesIO(raw)))
        assert len(got) == len(part) and [int(h["X-Page"]) for h, _ in got] == list(range(len(part)))
        assert got[0][0]["WARC-Type"] == "revisit"
    assert list(warc.decode_archive(io.BytesIO(b""))) == []


def test_rule_ensemble_learns_a_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(rule_ensemble.FEATURES)))
    y = ((x[:, 2] < 0.4) & (x[:, 7] < 0.6)).astype(float)
    m = rule_ensemble.fit(x[:2000], y[:2000])
    assert ((m.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97 and 0 < len(m.rules) < 120
    assert rule_ensemble.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert (rule_ensemble.fit(x, np.ones(len(x))).scores(x) > 0.99).all()


def test_statistics_of_odd_texts():
    got = rule_ensemble.statistics(*base.text_buffers(pa.array(["", None, " \n ", "A", "a b a b.\n" * 50])))
    assert np.isfinite(got).all() and (got[:3] == 0).all() and got[4, 7] > 0.9


def plain_repeats(rows, n=100):
    seen, out = set(), {}
    for k, t in sorted(rows):
        raw = t.encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if w in seen:
                cover[i : i + n] = b"\1" * n
            seen.add(w)
        out[k] = cover
    return out


def suffix_cover(rows, chunk, batch):
    """The operator's steps without Spark."""
    S = suffix_dedup
    held, runs = [], []
    for lo in range(0, len(rows), chunk):
        part = rows[lo : lo + chunk]
        data, off = base.text_buffers(pa.array([t for _, t in part]))
        doc, a, p0, p1, k, c = S.anchors(data, off)
        d = np.array([i for i, _ in part])
        r = S.Records(k=k, c=c, d=d[doc].astype("<i8"), h=np.zeros(len(a), "<i8"), p=(a - off[doc]).astype("<u4"), L=(a - p0).astype("u1"), R=(a - p1).astype("u1"))
        f, more = S.split_repeats(r)
        held.append(S.Records.unpack(f.pack(), S._ANCHOR))
        runs.append(more)
    f, more = S.split_repeats(S.Records.join(held, S._ANCHOR))
    ask = S.several_contexts(f)
    text = {i: np.frombuffer(t.encode(), np.uint8) for i, t in rows}
    n = S._size(ask)
    data = np.concatenate([text[int(d)][int(p) - int(x) :][: int(m)] for d, p, x, m in zip(ask.d, ask.p, ask.L, n)]) if len(ask) else np.zeros(0, np.uint8)
    S.BATCH, old = batch, S.BATCH
    S.IndexFamily.__init__.__defaults__ = (batch,)
    try:
        exact = S.compare_contexts(S.Records(**{c: ask.cols[c] for c in S._ASK}), data, np.cumsum(n) - n)
    finally:
        S.BATCH = old
        S.IndexFamily.__init__.__defaults__ = (old,)
    whole = S.unite(S.Records.join([*runs, more, exact], S._RUN))
    out = {i: bytearray(len(t.encode())) for i, t in rows}
    for d, s, m in zip(whole.d, whole.s, whole.n):
        out[int(d)][int(s) : int(s + m)] = b"\1" * int(m)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays_find_every_repeat(seed):
    rnd = random.Random(seed)
    seedtext = "".join(rnd.choice("abé") for _ in range(500))
    rows = [(i, "".join(seedtext[a : a + rnd.randint(50, 260)] for a in [rnd.randint(0, 400) for _ in range(rnd.randint(0, 5))])) for i in range(60)]
    rows += [(70, "x" * 1000), (71, "xy" * 300), (72, "x" * 99), (73, "")]
    assert suffix_cover(rows, chunk=7, batch=50) == plain_repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_cartesian_windows(seed):
    rng = np.random.default_rng(seed)
    begin = np.concatenate([[0], np.cumsum(rng.integers(0, 90, 12))])
    n, width = begin[-1], 10
    key = (rng.integers(0, 50, n).astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    want = {}
    for a, z in zip(begin, begin[1:]):
        for s in range(a, z - width + 1):
            m = s + int(np.argmin(key[s : s + width]))
            want.setdefault(m, []).append(s)
    node, p0, p1 = compact_windows.cartesian_windows(key, begin, width)
    assert {int(m): (int(a), int(b)) for m, a, b in zip(node, p0, p1)} == {m: (v[0], v[-1]) for m, v in want.items()}


def test_passage_verification():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 30, 300).astype("<u4")
    b = np.concatenate([rng.integers(0, 1 << 30, 40).astype("<u4"), a[100:180], rng.integers(0, 1 << 30, 40).astype("<u4")])
    assert [(s, e, s0, e0) for s, e, s0, e0, _ in compact_windows.verify(a, b)] == [(40, 120, 100, 180)]
    b[60] ^= 1
    assert len(compact_windows.verify(a, b)) == 1
    assert compact_windows.verify(a, rng.integers(0, 1 << 30, 100).astype("<u4")) == []
    again = np.tile(a[:13], 10)
    assert compact_windows.verify(again, again)[0][:2] == (0, 130)


def test_weighted_jaccard_and_samples():
    rnd = random.Random(1)
    w = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(4000)]
    one = [rnd.choice(w) for _ in range(600)]
    near = list(one)
    for i in range(0, 600, 60):
        near[i] = "other"
    far = [rnd.choice(w) for _ in range(600)]
    idf = np.full(near_dedup.FEATURES, 3.0, np.float32)
    data, off = base.text_buffers(pa.array([" ".join(x) for x in (one, near, far, [])]))
    doc, key, weight = near_dedup.bags(data, off, idf)
    bag = [(key[doc == i], weight[doc == i]) for i in range(4)]
    sh = [set(zip(*(x[k:] for k in range(5)))) for x in (one, near, far)]
    assert abs(near_dedup.jaccard(bag[0], bag[1]) - len(sh[0] & sh[1]) / len(sh[0] | sh[1])) < 0.01
    have, sig = near_dedup.samples(doc, key, weight, 4)
    assert have.tolist() == [0, 1, 2]
    alike = lambda i, j: (sig[i] == sig[j]).mean()
    assert abs(alike(0, 1) - near_dedup.jaccard(bag[0], bag[1])) < 0.2 and alike(0, 2) < 0.1
    # a heavier weight makes the same set less alike in proportion
    twice = near_dedup.samples(doc, key, weight * 2, 4)[1]
    assert abs((twice[0] == sig[0]).mean() - 0.5) < 0.2
    band = near_dedup.band_keys(sig)
    assert len(np.intersect1d(band[0], band[1])) > 0 and len(np.intersect1d(band[0], band[2])) == 0


def licence_matches(texts, known=None):
    idf = np.full(near_dedup.FEATURES, 3.0, np.float32)
    index = license_scan.Index(known or licence_texts.templates(), idf)
    s, e, first = base.words(*(b := base.text_buffers(pa.array(texts))))
    got = index.matches(base.word_hashes(b[0], s, e), first, idf, license_scan.SIMILARITY)
    return [[(index.known[-x[1]].license, x[2], x[3] - first[i], x[4] - first[i]) for x in got.get(i, [])] for i in range(len(texts))]


def plain_cosine(a, b):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    return sum(a[k] * b[k] for k in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5


def test_licences_against_brute_force():
    """Whatever block of a template's length shares its runs and is very like it is found, with the cosine that plain counting gives."""
    runs = lambda w: set(zip(w, w[1:], w[2:]))
    rnd = random.Random(4)
    known = [t for t in licence_texts.templates() if len(plain_words(t.text)) >= 9]
    texts = []
    for t in known:
        w = plain_words(t.text)
        for _ in range(len(w) // 40):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join([*(rnd.choice("qwxyz") * 5 for _ in range(rnd.randint(0, 50))), *w, *(rnd.choice("qwxyz") * 5 for _ in range(rnd.randint(0, 50)))]))
    said = lambda words, t: all(any(" " + " ".join(plain_words(p)) + " " in " " + " ".join(words) + " " for p in g) for g in t.must)
    for text, got in zip(texts, licence_matches(texts, known)):
        words = plain_words(text)
        best = (0, None)
        for t in known:
            w = plain_words(t.text)
            for i in range(max(len(words) - len(w) + 1, 1)):
                if len(runs(words[i : i + len(w)]) & runs(w)) >= license_scan.SHARE * (len(w) - 2) and said(words[max(i - 4, 0) : i + len(w) + 4], t):
                    c = plain_cosine(words[i : i + len(w)], w)
                    if c >= license_scan.SIMILARITY:
                        best = max(best, (round(c * len(words[i : i + len(w)]), 6), t.license))
        assert bool(got) == bool(best[1])
        if not got:  # a phrase that decides is among the changed words
            continue
        name, cos, a, z = got[0]
        assert name == best[1] and abs(cos * (z - a) - best[0]) < 0.02 * best[0], (name, best)
        t = max((t for t in known if t.license == name), key=lambda t: plain_cosine(words[a:z], plain_words(t.text)))
        assert abs(cos - plain_cosine(words[a:z], plain_words(t.text))) < 2e-6


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0")])
def test_licence_files_of_the_system(file, name):
    p = pathlib.Path("/usr/share/common-licenses", file)
    if not p.exists():
        pytest.skip("not on this system")
    (got,) = licence_matches([p.read_text(errors="replace")])
    assert got[0][0] == name and got[0][1] > 0.9


def test_licence_versions_and_tags_decide():
    lines = ["Licensed under the GNU General Public License, version 2.", "x Licensed under the GNU Lesser General Public License v2.1 y", "// SPDX-License-Identifier: GPL-3.0-or-later", "# SPDX-License-Identifier: EPL-2.0", "Project Acme is licensed under the Apache License, Version 2.0", "licensed to kill under the moon", "Licensed under CC BY-NC 4.0.", licence_texts.ISC, "Copyright X. " + licence_texts.MIT.replace("\n", "\n * ")]
    got = [m and m[0][0] for m in licence_matches(lines)]
    assert got == ["GPL-2.0", "LGPL-2.1", "GPL-3.0-or-later", [], "Apache-2.0", [], "CC-BY-NC-4.0", "ISC", "MIT"]
    later, only = (next(t.text for t in licence_texts.templates() if t.license == f"GPL-2.0-{k}") for k in ("or-later", "only"))
    assert [m[0][0] for m in licence_matches([later, only])] == ["GPL-2.0-or-later", "GPL-2.0-only"]
    assert license_scan.LICENCE_FILE.search("a/LICENSE.txt") and not license_scan.LICENCE_FILE.search("a/licensed.txt")


def thue_morse(n, k):
    return "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n))


def test_no_strings_collide_by_structure():
    one, two = thue_morse(4096, 0), thue_morse(4096, 1)
    for n in (512, 1024, 2048, 4096):
        got = line_rules.measure(*base.text_buffers(pa.array([f"{one[:n]}\n{two[:n]}", f"a b {one[:n]} c d a b {two[:n]} c d"])))
        assert got["n_dup_lines"].tolist() == [0, 0] and got["n_repeat_words"].tolist() == [0, 0]


def test_distinct_and_buckets():
    x = np.array([5, 3, 3, 9, 5], np.uint64)
    assert base.distinct(x).tolist() == [3, 5, 9] and len(base.distinct(x[:0])) == 0
    rows = [pa.RecordBatch.from_arrays([pa.array(k, pa.int32())], names=["bucket"]) for k in ([1, 1, 2], [2, 3], [], [3])]
    assert [[b.column(0).to_pylist() for b in part] for part in base.by_bucket(iter(rows))] == [[[1, 1]], [[2], [2]], [[3], [3]]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_crc_of_pieces(name):
    """Whole texts under either kind of vocabulary."""
    import public_tokenizers

    e = packing.Encoder(str(public_tokenizers.path(name)))
    assert e.chunked == (name == registry.TOKENIZER)
    texts = ["Hello World Foo", "", " lead  and trail ", "a\n\nb", "É1 x"]
    ids, bound = e.encode(texts)
    for i, t in enumerate(texts):
        want = np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[bound[i] : bound[i + 1]].astype("<u4").tobytes()) == zlib.crc32(want.tobytes())


def test_verification_sorts_once_and_ends_early(monkeypatch):
    calls = []
    for name in ("argsort", "sort", "unique"):
        f = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, name=name, f=f, **b: (calls.append((name, len(x))), f(x, *a, **b))[1])
    a = np.arange(1000, 1120, dtype=np.uint32)
    b = np.concatenate([np.arange(40, dtype=np.uint32), a[20:100], np.arange(100, 130, dtype=np.uint32)])
    assert compact_windows.verify(a, b) == [(40, 120, 20, 100, 1.0)]
    assert calls == [("argsort", 120), ("sort", 80)]
    # as many shared shingles, but in no passage enough of them
    calls.clear()
    b = np.arange(160, dtype=np.uint32)
    b[::2] = a[20:100]
    assert compact_windows.verify(a, b) == []
    assert calls == [("argsort", 120)]


def test_freed_memory_goes_back_at_the_end_of_a_partition():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(["a", "b"])], names=["bucket", "x"])
    for read in (lambda: [list(p) for p in base.by_bucket(iter([batch]))], lambda: list(base.chunks(iter([batch]), "x"))):
        held = [np.ones(10_000, np.uint8) for _ in range(20_000)]
        kept = held[::500]  # pins what lies behind it
        del held
        high = resident()
        base._given_back = 0.0
        read()
        assert resident() < high - 100, len(kept)
