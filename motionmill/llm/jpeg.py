"""Progressive JPEG in numpy: many images at once, every restart interval a lane.

Decoding follows the scans of an image in order. A first scan of a band stores coefficients shifted by its ``Al``, a
refining scan adds one more bit to those known and finds new ones; spectral selection says which of the 64 zigzag
places a scan holds. Entropy-coded data are sequential, so speed comes from reading one symbol of every restart
interval of all images in each numpy step. The inverse transform is a product with an integer matrix in float64, hence
exact and the same for equal images; chroma is repeated to full resolution before the change to RGB.

Read: 8-bit progressive files with one or three components, any sampling, restart intervals or none. Written: three
components in 4:2:0 with unit quantisation, from given coefficients.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
RESTART = 4
#: (components, first place, last place, high, low)
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1), *[((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))],
    ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)],
]
UNITS = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (2, 0, 0)]

DC_LENGTHS = {s: 4 for s in range(12)}
#: Short codes for what bytes of plain text give; (run << 4 | size).
AC_LENGTHS = {0x06: 1, 0x05: 3, 0x07: 4, 0x00: 4, 0x01: 6, 0x02: 6, 0x03: 6, 0x04: 6, 0x08: 6, 0x10: 6, 0xF0: 9}
AC_LENGTHS |= {r << 4 | s: 10 for r in range(1, 16) for s in range(1, 9)}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes per length 1 to 16, symbols, code and length of each symbol)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return [sum(n == k for n in lengths.values()) for k in range(1, 17)], symbols, codes


@lru_cache(maxsize=64)
def _table(spec: bytes) -> np.ndarray:
    """For every 16 bits: symbol << 8 | length of the code they begin with. ``spec``: 16 counts, then the symbols."""
    counts, symbols = spec[:16], spec[16:]
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
            code += 1
        at += count
        code <<= 1
    return out


_BITS = np.array([i.bit_length() for i in range(1 << 12)])


def _size(a: np.ndarray) -> np.ndarray:
    """Bits of each number up to 4095, the largest that a coefficient may have; 0 has none."""
    return _BITS[a]


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(lengths)[2].items():
        code[s], size[s] = c, n
    return code, size


# ---------------------------------------------------------------- writing


def _pack(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the symbols, stuffed; ``counts``: symbols of each interval. Returns bytes and each interval's end."""
    symbol_end = np.cumsum(sizes)
    ends = symbol_end[np.cumsum(counts) - 1]
    bits = np.diff(ends, prepend=0)
    pad = -bits % 8
    start = np.cumsum((bits + pad) // 8) * 8 - bits - pad  # first bit of each interval
    interval = np.repeat(np.arange(counts.size), counts)
    at = symbol_end - sizes + (start - (ends - bits))[interval]
    at = np.concatenate((at, start + bits))
    values, sizes = np.concatenate((values, (1 << pad) - 1)), np.concatenate((sizes, pad))
    word, inside = at >> 5, at & 31
    long = values << (64 - inside - sizes)  # at most 32 bits from place ``inside`` of a 64-bit pair of words
    n = int((start[-1] + bits[-1] + pad[-1]) >> 3)
    words = np.bincount(word, (long >> 32 & 0xFFFFFFFF).astype(np.float64), n // 4 + 2)
    words[1:] += np.bincount(word, (long & 0xFFFFFFFF).astype(np.float64), n // 4 + 2)[:-1]
    raw = words.astype(np.uint32).astype(">u4").view(np.uint8)[:n]
    wide = np.ones(n, np.int64) + (raw == 255)
    stop = np.cumsum(wide)
    out = np.zeros(int(stop[-1]), np.uint8)
    out[stop - wide] = raw
    return out, stop[(start + bits + pad) // 8 - 1]


def _first_dc(v: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of differences; ``opens`` marks units at the start of an interval."""
    before = np.zeros_like(v)
    for comp in ((0, 1, 2, 3), (4,), (5,)):
        flat = v[:, comp].ravel()
        shifted = np.concatenate(([0], flat[:-1])).reshape(-1, len(comp))
        shifted[opens, 0] = 0
        before[:, comp] = shifted
    diff = (v - before).ravel()
    s = _size(np.abs(diff))
    code, length = _codes(DC_LENGTHS)
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
    return code[s] << s | extra, length[s] + s


def _first_ac(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v: (blocks, places). Returns values, sizes and symbols per block."""
    a = np.abs(v) >> low
    row, col = np.nonzero(a)
    first = np.concatenate(([True], row[1:] != row[:-1])) if row.size else np.empty(0, bool)
    run = col - np.where(first, -1, np.concatenate(([0], col[:-1]))) - 1 if row.size else col
    full = run >> 4
    last = np.full(len(v), -1)
    last[row] = col
    open_end = last < v.shape[1] - 1
    each = np.bincount(row, 1 + full, len(v)).astype(np.int64) if row.size else np.zeros(len(v), np.int64)
    before = np.cumsum(open_end) - open_end
    place = np.arange(row.size) + np.cumsum(full) + before[row]
    symbol = np.full(int(each.sum() + open_end.sum()), 0xF0)
    extra, bits = np.zeros(symbol.size, np.int64), np.zeros(symbol.size, np.int64)
    s = _size(a[row, col])
    symbol[place] = (run & 15) << 4 | s
    bits[place] = s
    extra[place] = np.where(v[row, col] < 0, (1 << s) - 1 - a[row, col], a[row, col])
    symbol[(np.cumsum(each) + before)[open_end]] = 0
    code, length = _codes(AC_LENGTHS)
    return code[symbol] << bits | extra, length[symbol] + bits, each + open_end


def _refine_row(v: np.ndarray) -> list[tuple[int, int]]:
    """Symbols of one block with new coefficients, place by place."""
    code = canonical(AC_LENGTHS)[2]
    out, held, run = [], [], 0
    new = np.flatnonzero(np.abs(v) == 1)
    for k, x in enumerate(v.tolist()):
        if x == 0:
            run += 1
            continue
        while run > 15 and k <= new[-1]:
            out += [code[0xF0], *held]
            held, run = [], run - 16
        if abs(x) > 1:
            held.append((abs(x) & 1, 1))
            continue
        out += [code[run << 4 | 1], (int(x > 0), 1), *held]
        held, run = [], 0
    return out + ([code[0x00], *held] if run or held else [])


def _refine_ac(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.abs(v)
    slow = np.flatnonzero((a == 1).any(axis=1))
    row, col = np.nonzero(a > 1)
    n = np.bincount(row, minlength=len(v))
    inside = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
    groups = -(-n // 16)
    begin = np.flatnonzero(inside % 16 == 0)
    width = np.diff(np.append(begin, row.size))
    shift = np.repeat(width, width) - 1 - inside % 16
    value = np.add.reduceat((a[row, col] & 1) << shift, begin) if begin.size else np.empty(0, np.int64)
    per = 1 + groups
    special = {int(r): _refine_row(v[r]) for r in slow}
    for r, x in special.items():
        per[r] = len(x)
    start = np.cumsum(per) - per
    values, sizes = np.empty(int(per.sum()), np.int64), np.empty(int(per.sum()), np.int64)
    code, length = canonical(AC_LENGTHS)[2][0x00]
    plain = np.ones(len(v), bool)
    plain[slow] = False
    values[start[plain]], sizes[start[plain]] = code, length
    owner = row[begin] if begin.size else np.empty(0, np.int64)
    number = inside[begin] // 16 if begin.size else owner
    keep = plain[owner] if begin.size else np.empty(0, bool)
    to = (start[owner] + 1 + number)[keep] if begin.size else owner
    values[to], sizes[to] = value[keep], width[keep]
    for r, x in special.items():
        values[start[r] : start[r] + len(x)] = [p[0] for p in x]
        sizes[start[r] : start[r] + len(x)] = [p[1] for p in x]
    return values, sizes, per


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(images: list[tuple[np.ndarray, int, int, bytes]]) -> list[bytes]:
    """Files of ``images``: (blocks in the order of interleaved units, (6 * wide * high, 64) in zigzag; wide; high; comment)."""
    if not images:
        return []
    blocks = np.concatenate([b for b, _, _, _ in images]).astype(np.int64)
    units = np.array([w * h for _, w, h, _ in images])
    opens_at = np.cumsum(units) - units
    # raster order of each component's blocks, image after image
    order: list[list[np.ndarray]] = [[], [], []]
    for (_, w, h, _), base in zip(images, opens_at.tolist()):
        grid = (base + np.arange(w * h).reshape(h, w)) * 6
        luma = np.empty((2 * h, 2 * w), np.int64)
        for k, (_, dy, dx) in enumerate(UNITS[:4]):
            luma[dy::2, dx::2] = grid + k
        for c, x in enumerate((luma, grid + 4, grid + 5)):
            order[c].append(x.ravel())
    head = _segment(0xDB, bytes([0]) + bytes([1] * 64))
    tables = b""
    for kind, lengths in ((0x00, DC_LENGTHS), (0x10, AC_LENGTHS)):
        counts, symbols, _ = canonical(lengths)
        tables += _segment(0xC4, bytes([kind, *counts, *symbols]))
    tables += _segment(0xDD, struct.pack(">H", RESTART))
    parts = []
    for _, w, h, comment in images:
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts.append([b"\xff\xd8", _segment(0xFE, comment) if comment else b"", head, _segment(0xC2, frame), tables])
    for comps, a, b, high, low in SCRIPT:
        if len(comps) == 3:
            number = units
            v = blocks[:, 0].reshape(-1, 6) >> low
            inner = np.arange(len(v)) - np.repeat(opens_at, units)
            values, sizes = ((v & 1).ravel(), np.ones(v.size, np.int64)) if high else _first_dc(v, inner % RESTART == 0)
            per = np.full(len(v), 6)
        else:
            number = units * (4 if comps == (0,) else 1)
            v = blocks[np.concatenate(order[comps[0]])][:, a : b + 1]
            inner = np.arange(len(v)) - np.repeat(np.cumsum(number) - number, number)
            values, sizes, per = _refine_ac(v) if high else _first_ac(v, low)
        counts = np.add.reduceat(per, np.flatnonzero(inner % RESTART == 0))
        data, ends = _pack(values, sizes, counts)
        lanes = -(-number // RESTART)
        # markers between the intervals of one image
        last = np.cumsum(lanes)
        starts = np.concatenate(([0], ends[:-1]))
        number_in = np.arange(ends.size) - np.repeat(last - lanes, lanes)
        shift = np.arange(ends.size) * 2
        out = np.empty(data.size + 2 * ends.size, np.uint8)
        out[np.arange(data.size) + np.repeat(shift, ends - starts)] = data
        out[ends + shift], out[ends + shift + 1] = 0xFF, 0xD0 + number_in % 8
        raw, stop = out.tobytes(), ends + shift
        sos = _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0x00]) for c in comps) + bytes([a, b, high << 4 | low]))
        begin = np.concatenate(([0], stop[:-1] + 2))[last - lanes].tolist()
        for part, i, j in zip(parts, begin, stop[last - 1].tolist()):
            part += [sos, raw[i:j]]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


# ---------------------------------------------------------------- reading


class _Image:
    """Headers of one file; scans with the tables and interval then in force."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
        plain = marks[(raw[marks + 1] < 0xD0) | (raw[marks + 1] > 0xD7)]
        self.scans, self.comments, quant, huff, interval, at = [], [], {}, {}, 0, 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            kind = data[at + 1]
            if kind == 0xD9:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if kind == 0xC2:
                _, self.height, self.width, count = struct.unpack_from(">BHHB", body)
                self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            elif kind in (0xC0, 0xC1, 0xC3):
                raise ValueError("not a progressive file")
            elif kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = 64 * (1 + (body[i] >> 4))
                    quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + wide], ">u2" if wide == 128 else "u1").astype(np.int64)
                    i += 1 + wide
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    huff[body[i]] = body[i + 1 : i + 17 + sum(counts)]
                    i += 17 + sum(counts)
            elif kind == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xDA:
                names = [c[0] for c in self.comps]
                picked = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
                stop = int(plain[np.searchsorted(plain, at)])
                self.scans.append((picked, body[-3], body[-2], body[-1] >> 4, body[-1] & 15, interval, dict(huff), at, stop))
                at = stop
        self.quant = quant
        hs, vs = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        self.wide, self.high = -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        self.grid = [(self.wide * c[1], self.high * c[2]) for c in self.comps]  # blocks, with those that only fill up units
        self.own = [(-(-(-(-self.width * c[1] // hs)) // 8), -(-(-(-self.height * c[2] // vs)) // 8)) for c in self.comps]
        self.scale = [(hs // c[1], vs // c[2]) for c in self.comps]


class _Bits:
    """Unstuffed bytes of many stretches of data, read at many places at once."""

    def __init__(self, raw: np.ndarray):
        padded = np.concatenate((raw, np.zeros(16, np.uint8)))
        self.raw = padded
        self.window = np.zeros(raw.size + 8, np.uint64)
        for i in range(8):
            self.window |= padded[i : i + raw.size + 8].astype(np.uint64) << np.uint64(56 - 8 * i)

    def look(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place, at least 57 of them true."""
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.raw[at >> 3] >> (7 - (at & 7)) & 1).astype(np.int64)


def _lanes(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[_Bits, np.ndarray, np.ndarray]:
    """Bits of ``spans`` of ``data`` without stuffing and markers; first bit and span of each interval."""
    sizes = np.array([b - a for a, b in spans])
    raw = np.concatenate([data[a:b] for a, b in spans])
    edge = np.cumsum(sizes) - sizes
    after = np.concatenate(([False], raw[:-1] == 0xFF))
    after[edge] = False
    marker = after & (raw >= 0xD0) & (raw <= 0xD7)
    drop = (after & (raw == 0)) | marker
    drop[:-1] |= marker[1:]
    kept = np.cumsum(~drop) - ~drop  # bytes before each place
    firsts = np.sort(np.concatenate((edge, np.flatnonzero(marker) + 1)))
    span = np.searchsorted(edge, firsts, side="right") - 1
    return _Bits(raw[~drop]), np.append(kept, (~drop).sum())[firsts] * 8, span


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _take(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` bits of each window after ``skip``; size 0 gives 0."""
    shifted = window << skip.astype(np.uint64) >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64))
    return np.where(size > 0, shifted.astype(np.int64), 0)


def _read_first(coefs: np.ndarray, bits: _Bits, at: np.ndarray, block: np.ndarray, n: np.ndarray, where: np.ndarray, tables: np.ndarray, which: np.ndarray, a: int, b: int, low: int) -> None:
    """A first scan: one step reads a symbol of every lane that is not done. ``where``: blocks in scan order; lane i has ``n[i]`` from ``block[i]`` on."""
    single = len(tables) == 1
    end, block, k = block + n, block.copy(), np.full(at.size, a)
    flat, table = coefs.reshape(-1), tables.reshape(-1)
    while at.size:
        window = bits.look(at)
        code = (window >> np.uint64(48)).astype(np.int64)
        found = table[code] if single else table[which << 16 | code]
        length, r, s = found & 255, found >> 12, found >> 8 & 15
        if not length.all():
            raise ValueError("no such code")
        band = (s == 0) & (r < 15)
        size = np.where(band, r, s)
        value = _take(window, length, size)
        at = at + length + size
        k = k + r
        put = np.flatnonzero(s)
        v, z = value[put], s[put]
        flat[where[block[put]] * 64 + k[put]] = np.where(v < 1 << (z - 1), v - (1 << z) + 1, v) << low
        k += 1
        done = k > b
        if band.any():
            k[band] = a
            block = block + np.where(band, (1 << r) + value, done)
            done &= ~band
        else:
            block = block + done
        k[done] = a
        live = block < end
        if not live.all():
            at, block, k, end, which = at[live], block[live], k[live], end[live], which[live]


def _read_refining(coefs: np.ndarray, bits: _Bits, at: np.ndarray, block: np.ndarray, n: np.ndarray, where: np.ndarray, tables: np.ndarray, which: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> None:
    """A refining scan, read like a first one; correction bits are only placed here and applied after the last step."""
    at, block, k = at.copy(), block.copy(), a.copy()
    end, known = block + n, coefs != 0
    idle = np.zeros(at.size, np.int64)  # blocks still covered by an end-of-band run
    fixes: list[tuple[np.ndarray, ...]] = []
    live = np.arange(at.size)
    while live.size:
        quiet = idle[live] > 0
        if quiet.any():
            lane = live[quiet]
            rows = where[block[lane]]
            span = (np.arange(64) >= k[lane, None]) & (np.arange(64) <= b[lane, None])
            fixes.append((rows, k[lane], b[lane] + 1, at[lane]))
            at[lane] += (known[rows] & span).sum(axis=1)
            idle[lane] -= 1
            block[lane] += 1
            k[lane] = a[lane]
        lane = live[~quiet]
        if lane.size:
            window = bits.look(at[lane])
            found = tables[which[lane], (window >> np.uint64(48)).astype(np.int64)]
            length, r, s = found & 255, found >> 12, found >> 8 & 15
            if not length.all():
                raise ValueError("no such code")
            kk, row = k[lane], where[block[lane]]
            band = (s == 0) & (r < 15)
            size = np.where(band, r, s)
            value = _take(window, length, size)
            at[lane] += length + size
            second = ~band
            if second.any():
                mine, to = lane[second], row[second]
                zero = ~known[to] & (np.arange(64) >= kk[second, None]) & (np.arange(64) <= b[mine, None])
                reached = np.cumsum(zero, axis=1) > r[second, None]
                q = np.where(reached.any(axis=1), reached.argmax(axis=1), b[mine] + 1)
                span = known[to] & (np.arange(64) >= kk[second, None]) & (np.arange(64) < q[:, None])
                fixes.append((to, kk[second], q, at[mine]))
                at[mine] += span.sum(axis=1)
                new = s[second] == 1
                coefs[to[new], q[new]] = np.where(value[second][new] == 1, 1, -1) << low[mine[new]]
                kk[second] = q + 1
            run = (1 << np.where(band, r, 0)) + np.where(band, value, 0)
            done = ~band & (kk > b[lane])
            idle[lane] = np.where(band, run, 0)
            block[lane] += done
            k[lane] = np.where(done, a[lane], np.where(band, k[lane], kk))
        live = live[block[live] < end[live]]
    for rows, start, stop, place in fixes:
        column = np.arange(64)
        hit, col = np.nonzero(known[rows] & (column >= start[:, None]) & (column < stop[:, None]))
        first = np.concatenate(([True], hit[1:] != hit[:-1])) if hit.size else np.empty(0, bool)
        begin = np.flatnonzero(first)
        inner = np.arange(hit.size) - np.repeat(begin, np.diff(np.append(begin, hit.size)))
        one = bits.bit(place[hit] + inner) == 1
        old = coefs[rows[hit[one]], col[one]]
        coefs[rows[hit[one]], col[one]] = old + np.sign(old)


def _read_dc(coefs: np.ndarray, bits: _Bits, at: np.ndarray, unit: np.ndarray, n: np.ndarray, where: np.ndarray, comp: list[int], tables: np.ndarray, which: np.ndarray, high: int, low: int) -> None:
    """``where``: (units, blocks of a unit); ``comp``: the component of each."""
    at = at.copy()
    if high:
        for i in range(int(n.max())):
            live = np.flatnonzero(n > i)
            for j in range(len(comp)):
                coefs[where[unit[live] + i, j], 0] |= bits.bit(at[live]) << low
                at[live] += 1
        return
    before = np.zeros((at.size, max(comp) + 1), np.int64)
    for i in range(int(n.max())):
        live = np.flatnonzero(n > i)
        for j, c in enumerate(comp):
            window = bits.look(at[live])
            found = tables[which[live, j], (window >> np.uint64(48)).astype(np.int64)]
            length, s = found & 255, found >> 8
            before[live, c] += _extend(_take(window, length, s), s)
            at[live] += length + s
            coefs[where[unit[live] + i, j], 0] = before[live, c] << low


def coefficients(files: list[bytes]) -> list[tuple[_Image, list[np.ndarray]]]:
    """Headers and, for each component, coefficients (blocks in raster order, 64 in zigzag order)."""
    images = [_Image(f) for f in files]
    base, total = [], 0
    for im in images:
        base.append([])
        for w, h in im.grid:
            base[-1].append(total)
            total += w * h
    coefs = np.zeros((total, 64), np.int32)
    data = np.frombuffer(b"".join(files), np.uint8)
    begin = np.cumsum([0] + [len(f) for f in files])
    total_before = [b[0] for b in base]
    seen: dict[tuple, np.ndarray] = {}

    def places(picked: tuple[int, ...], im: _Image) -> np.ndarray:
        """(units, blocks of a unit) of a scan, counted from the image's first block; images of one shape share it."""
        key = (picked, im.height, im.width, tuple(im.comps))
        if key in seen:
            return seen[key]
        first = np.cumsum([0] + [w * h for w, h in im.grid])
        if len(picked) == 1:
            c = picked[0]
            w, h = im.own[c]
            rows = (np.arange(h)[:, None] * im.grid[c][0] + np.arange(w)).reshape(-1, 1) + first[c]
        else:
            cells = []
            for c in picked:
                for dy in range(im.comps[c][2]):
                    for dx in range(im.comps[c][1]):
                        y0, x0 = np.arange(im.high)[:, None] * im.comps[c][2] + dy, np.arange(im.wide) * im.comps[c][1] + dx
                        cells.append((y0 * im.grid[c][0] + x0).ravel() + first[c])
            rows = np.stack(cells, axis=1)
        seen[key] = rows
        return rows

    for k in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if k < len(im.scans):
                picked, a, b, high, low, *_ = im.scans[k]
                key = ("ac", a, b, high, low) if a else ("dc", high, low, tuple(im.comps[c][1:3] for c, _ in picked))
                groups.setdefault(key, []).append(i)
        for key, members in groups.items():
            luts: dict[bytes, int] = {}
            spans, where, units, which, every = [], [], [], [], []
            for i in members:
                im = images[i]
                picked, a, b, high, low, interval, huff, x, y = im.scans[k]
                spans.append((begin[i] + x, begin[i] + y))
                rows = places(tuple(c for c, _ in picked), im) + total_before[i]
                where.append(rows)
                units.append(len(rows))
                every.append(interval or len(rows))
                if not high or a:
                    own = [huff[0x10 | t & 15] if a else huff[t >> 4] for _, t in picked]
                    which.append([luts.setdefault(h, len(luts)) for h in own])
            bits, at, span = _lanes(data, spans)
            where, units, every = np.concatenate(where), np.array(units), np.array(every)
            number = np.arange(at.size) - np.searchsorted(span, span)
            first = number * every[span]
            n = np.minimum(units[span] - first, every[span])
            first += (np.cumsum(units) - units)[span]
            tables = np.stack([_table(h) for h in luts]) if luts else np.zeros((1, 1 << 16), np.int64)
            which = np.array(which or [[0]] * len(members))[span]
            if key[0] == "ac":
                full = np.full(at.size, 0)
                if key[3] and key[4]:
                    raise ValueError("refining scans above the last bit are not read")
                if not key[3]:
                    _read_first(coefs, bits, at, first, n, where[:, 0], tables, which[:, 0], key[1], key[2], key[4])
                    continue
                _read_refining(coefs, bits, at, first, n, where[:, 0], tables, which[:, 0], full + key[1], full + key[2], full + key[4])
            else:
                im, picked = images[members[0]], images[members[0]].scans[k][0]
                single = len(picked) == 1
                comp = [j for j, (c, _) in enumerate(picked) for _ in range(1 if single else im.comps[c][1] * im.comps[c][2])]
                _read_dc(coefs, bits, at, first, n, where, comp, tables, which if key[1] else which[:, comp], key[1], key[2])
    return [(im, [coefs[s : s + w * h] for s, (w, h) in zip(b, im.grid)]) for im, b in zip(images, base)]


_SCALE = 1 << 13


def _basis() -> np.ndarray:
    """Integer matrix from 64 zigzag coefficients to 64 samples, times ``_SCALE``."""
    x = np.arange(8)
    c = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.round(np.einsum("uy,vx->uvyx", c, c).reshape(64, 64) * _SCALE)[ZIGZAG]


BASIS = _basis()


def rgb(image: _Image, comps: list[np.ndarray]) -> np.ndarray:
    """The full-resolution (height, width, 3) tensor."""
    planes = []
    for (w, h), (_, _, _, q), (sx, sy), v in zip(image.grid, image.comps, image.scale, comps):
        steps = image.quant[q]
        exact = (v if (steps == 1).all() else v * steps).astype(np.float64) @ BASIS
        samples = ((exact.astype(np.int64) + _SCALE // 2) >> 13) + 128
        plane = np.clip(samples, 0, 255).astype(np.int32).reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
        if sx > 1 or sy > 1:
            plane = plane.repeat(sy, axis=0).repeat(sx, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=2)
    y, cb, cr = (planes[0] << 16) + 32768, planes[1] - 128, planes[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    for c, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[..., c] = np.clip(x >> 16, 0, 255)
    return out
