"""LZARI: LZSS matches under an adaptive arithmetic code (Okumura's published scheme)."""

from __future__ import annotations

# Fixed values of the format.
WINDOW, MIN_MATCH, MAX_MATCH = 4096, 3, 60
CODE_BITS = 15
QUARTER = 1 << CODE_BITS
SYMBOLS = 256 + MAX_MATCH - MIN_MATCH + 1
TOP = QUARTER - 1
#: Earlier places that the encoder tries for a match: more compress a little better; what it writes is whole either way.
MATCH_TRIES = 512

_POSITIONS = [0] * (WINDOW + 1)
for _i in range(WINDOW, 0, -1):
    _POSITIONS[_i - 1] = _POSITIONS[_i] + 10000 // (200 + _i)


class _Symbols:
    """Adaptive frequencies by rank: rank 0 is the most frequent; cumulative sums live in a Fenwick tree over ranks."""

    def __init__(self) -> None:
        self.freq = [1] * SYMBOLS
        self.at_rank = list(range(SYMBOLS))
        self.rank = list(range(SYMBOLS))
        self._sum()

    def _sum(self) -> None:
        self.total = sum(self.freq)
        self.tree = [0] * (SYMBOLS + 1)
        for i, f in enumerate(self.freq, 1):
            self.tree[i] += f
            j = i + (i & -i)
            if j <= SYMBOLS:
                self.tree[j] += self.tree[i]

    def before(self, rank: int) -> int:
        out = 0
        while rank:
            out += self.tree[rank]
            rank &= rank - 1
        return out

    def bounds(self, rank: int) -> tuple[int, int]:
        """The part of [0, total) that belongs to a rank; the most frequent lies at the top."""
        upper = self.total - self.before(rank)
        return upper - self.freq[rank], upper

    def find(self, value: int) -> int:
        """The rank whose part holds ``value``."""
        want, rank = self.total - value - 1, 0
        step = 1 << SYMBOLS.bit_length() - 1
        while step:
            nxt = rank + step
            if nxt <= SYMBOLS and self.tree[nxt] <= want:
                rank, want = nxt, want - self.tree[nxt]
            step >>= 1
        return rank

    def seen(self, rank: int) -> None:
        if self.total >= TOP:
            self.freq = [(f + 1) >> 1 for f in self.freq]
            self._sum()
        f, first = self.freq[rank], rank
        while first and self.freq[first - 1] == f:
            first -= 1
        a, b = self.at_rank[first], self.at_rank[rank]
        self.at_rank[first], self.at_rank[rank] = b, a
        self.rank[b], self.rank[a] = first, rank
        self.freq[first] += 1
        self.total += 1
        i = first + 1
        while i <= SYMBOLS:
            self.tree[i] += 1
            i += i & -i


def decode(src: bytes, size: int) -> bytes:
    """``size`` bytes from ``src``; there is no end mark, bits past the end are zeros.  A match past ``size`` is an error."""
    if size == 0:
        return b""
    raw, left, at = src, 8 * len(src), 0

    def bit() -> int:
        nonlocal at
        at += 1
        if at > left + 4096:
            raise ValueError("compressed data ends too soon")
        return raw[at - 1 >> 3] >> (7 - (at - 1 & 7)) & 1 if at <= left else 0

    model = _Symbols()
    low, high, code = 0, 4 * QUARTER, 0
    for _ in range(CODE_BITS + 2):
        code = 2 * code + bit()

    def narrow(a: int, b: int, total: int) -> None:
        nonlocal low, high, code
        span = high - low
        low, high = low + a * span // total, low + b * span // total
        while True:
            if low >= 2 * QUARTER:
                shift = 2 * QUARTER
            elif low >= QUARTER and high <= 3 * QUARTER:
                shift = QUARTER
            elif high <= 2 * QUARTER:
                shift = 0
            else:
                return
            low, high, code = 2 * (low - shift), 2 * (high - shift), 2 * (code - shift) + bit()

    out = bytearray(b" " * (WINDOW - MAX_MATCH))
    start = len(out)
    while len(out) - start < size:
        value = ((code - low + 1) * model.total - 1) // (high - low)
        rank = model.find(value)
        symbol = model.at_rank[rank]
        narrow(*model.bounds(rank), model.total)
        model.seen(rank)
        if symbol < 256:
            out.append(symbol)
            continue
        value = ((code - low + 1) * _POSITIONS[0] - 1) // (high - low)
        lo, hi = 0, WINDOW - 1
        while lo < hi:  # the position whose part holds the value; parts descend
            mid = (lo + hi) // 2
            if _POSITIONS[mid + 1] <= value:
                hi = mid
            else:
                lo = mid + 1
        narrow(_POSITIONS[lo + 1], _POSITIONS[lo], _POSITIONS[0])
        length, back = symbol - 256 + MIN_MATCH, lo + 1
        if len(out) - start + length > size:
            raise ValueError("a match runs past the stated size")
        for _ in range(length):
            # before the blanks that the window starts with there are zeros
            out.append(out[-back] if back <= len(out) else 0)
    return bytes(out[start:])


def encode(src: bytes) -> bytes:
    """Greedy longest matches found through chains of equal three-byte heads inside the window."""
    if not src:
        return b""
    lead = min(MAX_MATCH, len(src))
    data = b" " * lead + src
    n = len(data)
    model = _Symbols()
    low, high, pending = 0, 4 * QUARTER, 0
    bits: list[int] = []

    def put(b: int) -> None:
        nonlocal pending
        bits.append(b)
        bits.extend([b ^ 1] * pending)
        pending = 0

    def narrow(a: int, b: int, total: int) -> None:
        nonlocal low, high, pending
        span = high - low
        low, high = low + a * span // total, low + b * span // total
        while True:
            if high <= 2 * QUARTER:
                put(0)
                shift = 0
            elif low >= 2 * QUARTER:
                put(1)
                shift = 2 * QUARTER
            elif low >= QUARTER and high <= 3 * QUARTER:
                pending += 1
                shift = QUARTER
            else:
                return
            low, high = 2 * (low - shift), 2 * (high - shift)

    heads: dict[bytes, int] = {}
    chain = [-1] * n

    def index(p: int) -> None:
        k = data[p : p + MIN_MATCH]
        chain[p] = heads.get(k, -1)
        heads[k] = p

    for p in range(lead):
        index(p)
    at = lead
    while at < n:
        best, where, room = 0, -1, min(MAX_MATCH, n - at)
        p, tries = heads.get(data[at : at + MIN_MATCH], -1) if room >= MIN_MATCH else -1, 0
        while p >= 0 and at - p <= WINDOW - MAX_MATCH and tries < MATCH_TRIES and best < room:
            if data[p + best : p + best + 1] == data[at + best : at + best + 1]:
                limit, k = min(room, at - p), 0
                while k < limit and data[p + k] == data[at + k]:
                    k += 1
                if k > best:
                    best, where = k, p
            p, tries = chain[p], tries + 1
        symbol = data[at] if best < MIN_MATCH else 256 - MIN_MATCH + best
        rank = model.rank[symbol]
        narrow(*model.bounds(rank), model.total)
        model.seen(rank)
        step = 1
        if best >= MIN_MATCH:
            back = at - where - 1
            narrow(_POSITIONS[back + 1], _POSITIONS[back], _POSITIONS[0])
            step = best
        for p in range(at, at + step):
            index(p)
        at += step
    pending += 1
    put(0 if low < QUARTER else 1)
    bits.extend([0] * (-len(bits) % 8))
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
