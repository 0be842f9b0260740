"""FLAC media columns: mono 8-bit streams, encoded and decoded many frames at a time.

A byte b of the payload is the sample b - 128.  Streams have a STREAMINFO block with
the payload's MD5, a SEEKTABLE with one point a frame, and frames of up to 4096 samples,
each a constant, verbatim, fixed-predictor or linear-predictor subframe with Rice-coded
residuals.  The decoder walks the Rice codes of many frames in step, restores the
predictors, and checks every header's CRC-8, every frame's CRC-16 and the stream's MD5;
any mismatch raises ``BadStream``.

Work goes by groups of frames of a bounded size, so that a long text takes little more
memory than its bytes, stream and payload.  Streams of other encoders with one channel of
8 bits are read too: with Rice partitions, escape codes, five-bit parameters, wasted bits
or without a seek table, one code at a time.

Defined cases: a null text is the empty one; a payload is padded with zero bytes to a
positive multiple of 64; equal payloads give equal streams; an empty table gives no rows;
the input's columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import as_row, with_id, with_row
from .words import pieces

FRAME = 4096
#: Samples that are encoded or decoded together; a run of texts of a megabyte fits.
GROUP = 3 << 19
#: Sample rate written to the stream, and its code in frame headers (8 kHz).
RATE, RATE_CODE = 8000, 4
#: Order, coefficient precision and shift of the encoder's linear predictor.
ORDER, PRECISION, SHIFT = 4, 12, 9
#: Coefficients of the fixed predictors' differences, by order.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


class BadStream(ValueError):
    """A stream that is not FLAC of this kind, or whose checksums don't hold."""


def _crc_table(width: int, poly: int) -> np.ndarray:
    x = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        x = ((x << 1) ^ np.where(x >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return x


_CRC8 = _crc_table(8, 0x07).tolist()
_CRC16 = _crc_table(16, 0x8005).astype(np.uint16)
_by_place = _CRC16[None, :].copy()


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def _crc16_places(n: int) -> np.ndarray:
    """What a byte adds to a CRC-16, by its distance from the end and its value (the CRC is linear)."""
    global _by_place
    if n > len(_by_place):
        grown = np.empty((n, 256), dtype=np.uint16)
        grown[: len(_by_place)] = _by_place
        for i in range(len(_by_place), n):
            last = grown[i - 1]
            grown[i] = (last << np.uint16(8)) ^ _CRC16[last >> np.uint16(8)]
        _by_place = grown
    return _by_place


def crc16(data: np.ndarray) -> int:
    places = _crc16_places(max(8192, len(data)))
    return int(np.bitwise_xor.reduce(places[np.arange(len(data) - 1, -1, -1), data])) if len(data) else 0


def _utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    bits = 6
    while n >= 1 << bits:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        bits -= 1
    return bytes([(0xFF << bits + 1) & 0xFF | n, *reversed(tail)])


def _read_utf8_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    more = 0
    while first & (0x40 >> more):
        more += 1
    value = first & ((0x3F >> more))
    for b in data[at + 1 : at + 1 + more]:
        value = value << 6 | b & 0x3F
    return value, at + 1 + more


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Writes values of ``width`` bits, most significant first, from the places ``at`` on."""
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def _predictors(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised least-squares predictors of all frames (autocorrelation, Levinson's recursion); zeros where there is none."""
    auto = np.empty((ORDER + 1, len(n)))
    frame = np.repeat(np.arange(len(n)), n)
    for lag in range(ORDER + 1):
        product = x.copy()
        product[lag:] *= x[: len(x) - lag]
        if lag:
            product[:lag] = 0
            product[lag:][frame[lag:] != frame[:-lag]] = 0
        auto[lag] = np.add.reduceat(product, first)
    good = (auto[0] > 0) & (n > 4 * ORDER)
    error = np.where(good, auto[0], 1.0)
    a = np.zeros((0, len(n)))
    for i in range(ORDER):
        reflection = (auto[i + 1] - sum((a[j] * auto[i - j] for j in range(i)), np.zeros(len(n)))) / error
        a = np.concatenate([a - reflection * a[::-1], reflection[None, :]])
        error = error * (1 - reflection * reflection)
        good &= error > 1e-9
        error = np.where(good, error, 1.0)
    most = (1 << PRECISION - 1) - 1
    return np.where(good, np.clip(np.round(a * (1 << SHIFT)), -most - 1, most), 0).astype(np.int32)


def _subframes(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The subframe of each frame x[first : first + n], in the cheapest of four predictors or verbatim."""
    place = np.arange(len(x)) - np.repeat(first, n)
    weights = _predictors(x, first, n)
    residuals = [x]
    for _ in (1, 2):
        step = residuals[-1].copy()
        step[1:] -= residuals[-1][:-1]
        residuals.append(step)
    predicted = np.zeros(len(x), dtype=np.int32)
    for j in range(ORDER):
        predicted[j + 1 :] += np.repeat(weights[j], n)[j + 1 :] * x[: len(x) - j - 1]
    residuals.append(x - (predicted >> SHIFT))
    orders = np.array([0, 1, 2, ORDER])
    over = np.array([0, 8, 16, (8 + PRECISION) * ORDER + 9])
    guess = np.empty((4, len(n)))
    for c, residual in enumerate(residuals):
        size = np.abs(residual)
        size[place < orders[c]] = 0
        mean = np.add.reduceat(size, first) / np.maximum(n - orders[c], 1)
        guess[c] = n * (np.log2(2 * mean + 1) + 1.5) + over[c]
    guess[3, (weights == 0).all(axis=0)] = np.inf
    kind = guess.argmin(axis=0)
    order = orders[kind]
    which = np.repeat(kind, n)
    residual = np.choose(which, residuals)
    folded = (residual << 1) ^ (residual >> 31)
    warm = place < np.repeat(order, n)
    folded[warm] = 0
    many = n - order
    near = np.log2(np.maximum(np.add.reduceat(folded, first) / np.maximum(many, 1), 1)).astype(np.int32)
    options = np.clip(np.stack([near - 1, near, near + 1]), 0, 14)
    costs = np.stack([np.add.reduceat(folded >> np.repeat(k, n), first) + many * (k + 1) for k in options])
    k = np.take_along_axis(options, costs.argmin(axis=0)[None], 0)[0]
    cost = costs.min(axis=0)
    linear = kind == 3
    head = 8 + 8 * order + np.where(linear, 9 + PRECISION * ORDER, 0) + 10
    constant = (np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first))
    verbatim = ~constant & (head + cost >= 8 * n + 8)
    coded = ~constant & ~verbatim

    size = np.where(coded, -(-(head + cost) // 8), 0)
    base = (np.cumsum(size) - size) * 8
    bits = np.zeros(int(size.sum()) * 8, dtype=np.uint8)
    f = np.flatnonzero(coded)
    _put(bits, base[f], np.where(linear[f], 0x20 | ORDER - 1, 0x08 | order[f]) << 1, 8)
    own = np.repeat(coded, n)
    on = own & warm
    _put(bits, np.repeat(base + 8, n)[on] + 8 * place[on], x[on], 8)
    at = base + 8 + 8 * order
    g = np.flatnonzero(coded & linear)
    _put(bits, at[g], np.full(len(g), PRECISION - 1), 4)
    _put(bits, at[g] + 4, np.full(len(g), SHIFT), 5)
    for j in range(ORDER):
        _put(bits, at[g] + 9 + PRECISION * j, weights[j][g], PRECISION)
    at = base + head - 4  # after the coding method and the partition order, both 0
    _put(bits, at[f], k[f], 4)
    on = own & ~warm
    value, shift = folded[on], np.repeat(k, n)[on]
    length = np.zeros(len(x), dtype=np.int64)
    length[on] = (value >> shift) + 1 + shift
    ends = np.cumsum(length)
    stop = (ends + np.repeat(base + head - (ends[first] - length[first]), n))[on] - shift - 1
    bits[stop] = 1
    for j in range(int(shift.max(initial=0))):
        here = shift > j
        bits[stop[here] + shift[here] - j] = value[here] >> j & 1
    packed = np.packbits(bits).tobytes()
    raw = (x.astype(np.int8)).tobytes()
    out = []
    for i, (a, m, b, s) in enumerate(zip(first.tolist(), n.tolist(), (base // 8).tolist(), size.tolist())):
        if constant[i]:
            out.append(b"\x00" + raw[a : a + 1])
        elif verbatim[i]:
            out.append(b"\x02" + raw[a : a + m])
        else:
            out.append(packed[b : b + s])
    return out


def _groups(items: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Runs of frames, which end with their number of samples."""
    group, size = [], 0
    for item in items:
        if group and size + item[-1] > GROUP:
            yield group
            group, size = [], 0
        group.append(item)
        size += item[-1]
    if group:
        yield group


def _all_subframes(payloads: list[bytes], cuts: list[tuple[int, int, int]]) -> Iterator[bytes]:
    """The subframes of (payload, first sample, samples), a group at a time."""
    for group in _groups(cuts):
        x = (np.frombuffer(b"".join(payloads[i][at : at + m] for i, at, m in group), dtype=np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
        n = np.array([m for _, _, m in group], dtype=np.int64)
        yield from _subframes(x, np.cumsum(n) - n, n)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its samples are the payload's bytes less 128."""
    cuts = []
    for i, payload in enumerate(payloads):
        cuts += [(i, at, min(FRAME, len(payload) - at)) for at in range(0, len(payload), FRAME)]
    subframes = _all_subframes(payloads, cuts)
    heads: dict[tuple[int, int], bytes] = {}
    out, each = [], iter(cuts)
    for payload in payloads:
        frames, points, at = [], [], 0
        for number in range(-(-len(payload) // FRAME)):
            _, first, m = next(each)
            if (head := heads.get((number, m))) is None:
                head = bytes([0xFF, 0xF8, (0xC0 if m == FRAME else 0x70) | RATE_CODE, 0x02]) + _utf8_number(number) + (b"" if m == FRAME else struct.pack(">H", m - 1))
                head = heads[number, m] = head + bytes([crc8(head)])
            body = head + next(subframes)
            frames.append(body + struct.pack(">H", crc16(np.frombuffer(body, dtype=np.uint8))))
            points.append(struct.pack(">QQH", first, at, m))
            at += len(frames[-1])
        sizes = [len(f) for f in frames] or [0]
        signed = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", FRAME, FRAME) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek = b"".join(points)
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + b"".join(frames))
    return out


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


class Stream:
    """The metadata of a stream: sample count, MD5 and the frames' places."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise BadStream("no FLAC marker")
        self.data, at, last, self.points = data, 4, False, []
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.samples, self.md5 = packed & (1 << 36) - 1, block[18:34]
                if (packed >> 36 & 31, packed >> 41 & 7) != (7, 0):
                    raise BadStream("not mono with 8 bits")
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != (1 << 64) - 1]
            at += 4 + size
        self.start = at
        if not self.points:
            self.points = list(_walk(data, at))
            self.samples = self.samples or sum(p[2] for p in self.points)

    def frames(self, first: int = 0, count: int | None = None) -> list[tuple[int, int, int, int]]:
        """(first sample, samples, begin, end) of the frames that hold the samples first .. first + count - 1."""
        end = self.samples if count is None else min(self.samples, first + count)
        cuts = [self.start + p[1] for p in self.points] + [len(self.data)]
        return [(p[0], p[2], a, b) for p, a, b in zip(self.points, cuts, cuts[1:]) if p[0] < end and p[0] + p[2] > first]


def _frame_header(data: bytes, begin: int) -> tuple[int, int]:
    """Samples of a frame and the place of its subframe; checks the header's CRC-8."""
    if data[begin : begin + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise BadStream("no frame sync")
    if data[begin + 3] >> 4 or data[begin + 3] >> 1 & 7 not in (0, 1):
        raise BadStream("not mono with 8 bits")
    _, at = _read_utf8_number(data, begin + 4)
    size = data[begin + 2] >> 4
    if size == 7:
        n, at = int.from_bytes(data[at : at + 2], "big") + 1, at + 2
    elif size == 6:
        n, at = data[at] + 1, at + 1
    elif size >= 8:
        n = 256 << size - 8
    elif size:
        n = 192 if size == 1 else 576 << size - 2
    else:
        raise BadStream("unknown block size")
    at += {12: 1, 13: 2, 14: 2}.get(data[begin + 2] & 15, 0)
    if crc8(data[begin:at]) != data[at]:
        raise BadStream("a header's CRC-8 doesn't hold")
    return n, at + 1


def _open_frame(data: bytes, begin: int, end: int, samples: int):
    """Checks a frame's checksums; its subframe, without the frame's CRC-16."""
    frame = np.frombuffer(data, dtype=np.uint8, count=end - begin, offset=begin)
    if int.from_bytes(data[end - 2 : end], "big") != crc16(frame[:-2]):
        raise BadStream("a frame's CRC-16 doesn't hold")
    n, at = _frame_header(data, begin)
    if n != samples:
        raise BadStream("the seek table and a frame disagree")
    return frame[at - begin : -2]


class _Bits:
    """Reads numbers of any width from bytes, a code at a time."""

    def __init__(self, body: np.ndarray):
        self.bits, self.at = np.unpackbits(body), 0
        self.ones = np.flatnonzero(self.bits)

    def take(self, width: int) -> int:
        if self.at + width > len(self.bits):
            raise BadStream("a frame is cut off")
        value = 0
        for bit in self.bits[self.at : self.at + width].tolist():
            value = value << 1 | bit
        self.at += width
        return value

    def unary(self) -> int:
        i = int(np.searchsorted(self.ones, self.at))
        if i == len(self.ones):
            raise BadStream("a Rice code runs past its frame")
        zeros, self.at = int(self.ones[i]) - self.at, int(self.ones[i]) + 1
        return zeros


def _any_subframe(body: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Samples of a subframe of any kind, and its bytes; a code at a time."""
    bits = _Bits(body)
    kind, wasted = bits.take(7), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    width = 8 - wasted
    if kind == 0:
        x = [_signed(bits.take(width), width)] * n
    elif kind == 1:
        x = [_signed(bits.take(width), width) for _ in range(n)]
    else:
        order = (kind & 31) + 1 if kind >= 0x20 else kind & 7
        if kind < 0x20 and (kind >> 3 != 1 or order > 4):
            raise BadStream("unknown subframe")
        x = [_signed(bits.take(width), width) for _ in range(order)]
        weights, shift = FIXED.get(order, []), 0
        if kind >= 0x20:
            precision, shift = bits.take(4) + 1, _signed(bits.take(5), 5)
            weights = [_signed(bits.take(precision), precision) for _ in range(order)]
        method, partitions = bits.take(2), bits.take(4)
        if method > 1 or n % (1 << partitions):
            raise BadStream("unknown residuals")
        escape = 15 if method == 0 else 31
        for p in range(1 << partitions):
            k = bits.take(4 + method)
            raw = bits.take(5) if k == escape else 0
            for _ in range((n >> partitions) - (order if p == 0 else 0)):
                if k == escape:
                    residual = _signed(bits.take(raw), raw) if raw else 0
                else:
                    value = bits.unary() << k
                    value |= bits.take(k)
                    residual = value >> 1 ^ -(value & 1)
                x.append(residual + (sum(w * v for w, v in zip(weights, reversed(x))) >> shift))
    return np.array(x, dtype=np.int64) << wasted, -(-bits.at // 8)


def _walk(data: bytes, start: int) -> Iterator[tuple[int, int, int]]:
    """(first sample, place after the metadata, samples) of the frames of a stream without a seek table."""
    at, first = start, 0
    while at < len(data):
        n, body = _frame_header(data, at)
        _, used = _any_subframe(np.frombuffer(data, dtype=np.uint8, offset=body), n)
        yield first, at - start, n
        first, at = first + n, body + used + 2


def _signed(bits: int, width: int) -> int:
    return bits - (1 << width) if bits >> (width - 1) else bits


def decode_frames(jobs: Iterable[tuple[bytes, int, int, int]]) -> Iterator[np.ndarray]:
    """Samples (int64) of many frames, each (data, begin, end, samples), a group at a time."""
    for group in _groups(jobs):
        yield from _decode_group(group)


def _decode_group(jobs: list[tuple[bytes, int, int, int]]) -> list[np.ndarray]:
    """Samples of a group of frames; Rice codes are walked in step."""
    out: list[np.ndarray | None] = [None] * len(jobs)
    coded = []  # (job, order, coefficients or None, shift, warm-up, samples, bytes, first bit, parameter)
    for i, (data, begin, end, n) in enumerate(jobs):
        body = _open_frame(data, begin, end, n)
        head = int(body[0]) >> 1
        if body[0] & 1:  # wasted bits
            out[i] = _any_subframe(body, n)[0]
            continue
        if head == 0:
            out[i] = np.full(n, _signed(int(body[1]), 8), dtype=np.int64)
            continue
        if head == 1:
            out[i] = body[1 : 1 + n].astype(np.int8).astype(np.int64)
            continue
        linear = head >= 0x20
        order = (head & 31) + 1 if linear else head & 7
        if not linear and (head >> 3 != 1 or order > 4):
            raise BadStream("unknown subframe")
        warm = body[1 : 1 + order].astype(np.int8).astype(np.int64)
        start = 1 + order
        bits = int.from_bytes(body[start : start + 64].tobytes().ljust(64, b"\0"), "big")
        used = 0

        def take(width: int) -> int:
            nonlocal used
            used += width
            return bits >> (512 - used) & ((1 << width) - 1)

        coefficients, shift = FIXED[order] if not linear else [], 0
        if linear:
            precision, shift = take(4) + 1, _signed(take(5), 5)
            coefficients = [_signed(take(precision), precision) for _ in range(order)]
        if take(6) or (k := take(4)) == 15:  # partitions, five-bit parameters or an escape code
            out[i] = _any_subframe(body, n)[0]
            continue
        coded.append((i, order, coefficients, shift, warm, n, body[start:], used, k, linear))
    if not coded:
        return out  # type: ignore[return-value]
    coded.sort(key=lambda c: c[1] - c[5])  # most residuals first
    sizes = np.array([len(c[6]) for c in coded])
    data = np.concatenate([c[6] for c in coded])
    bits = np.unpackbits(data)
    end = np.int32(len(bits))
    places = np.arange(len(bits), dtype=np.int32)
    one = np.full(len(bits) + 64, end, dtype=np.int32)
    one[: len(bits)] = np.minimum.accumulate(np.where(bits == 1, places, end)[::-1])[::-1]  # the next stop bit
    many = np.array([c[5] - c[1] for c in coded])
    k = np.array([c[8] for c in coded], dtype=np.int32)
    first_code = ((np.cumsum(sizes) - sizes) * 8 + np.array([c[7] for c in coded])).astype(np.int32)
    stops = np.full((int(many.max()), len(coded)), end, dtype=np.int32)
    live = np.searchsorted(-many, -np.arange(1, len(stops) + 1), side="right")  # frames that have a code t
    at, beyond = first_code.copy(), k + np.int32(1)
    for t, m in enumerate(live.tolist()):
        if m < len(at):
            at, beyond = at[:m], beyond[:m]
        np.take(one, at, out=stops[t, :m])
        at = stops[t, :m] + beyond
    lasts = stops[many - 1, np.arange(len(coded))]
    if (lasts + k >= np.cumsum(sizes) * 8).any():
        raise BadStream("a Rice code runs past its frame")
    stops = np.ascontiguousarray(stops.T)  # a row a frame
    starts = np.empty_like(stops)
    starts[:, 0] = first_code
    starts[:, 1:] = stops[:, :-1] + (k + 1)[:, None]
    tail = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = tail[:-3] << 24 | tail[1:-2] << 16 | tail[2:-1] << 8 | tail[3:]  # 32 bits from each byte on
    value = (stops - starts) << k[:, None]
    low = stops + 1
    part = word[np.minimum(low >> 3, len(data))] << (low & 7).astype(np.uint32)
    value |= np.where(k[:, None] > 0, part >> (32 - np.maximum(k, 1)).astype(np.uint32)[:, None], 0).astype(np.int32)
    residual = (value >> 1) ^ -(value & 1)
    by_order: dict[tuple[bool, int], list[int]] = {}
    for c, x in enumerate(coded):
        by_order.setdefault((x[9], x[1]), []).append(c)
    for (linear, order), members in by_order.items():
        if not linear:
            for c in members:
                i, _, _, _, warm, n, *_ = coded[c]
                y = residual[c, : n - order].astype(np.int64)
                for depth in range(order, 0, -1):  # undo one difference at a time
                    seed = np.diff(warm, depth - 1)[-1] if depth > 1 else warm[-1]
                    y = seed + np.cumsum(y)
                out[i] = np.concatenate([warm, y])
            continue
        n = np.array([coded[c][5] for c in members])  # falls, as the members are sorted
        x = np.zeros((int(n[0]), len(members)), dtype=np.int64)
        x[:order] = np.array([coded[c][4] for c in members]).T
        own = residual[members, : len(x) - order].T.astype(np.int64, order="C")
        weights = np.array([coded[c][2] for c in members], dtype=np.int64).T.copy()
        shifts = np.array([coded[c][3] for c in members], dtype=np.int64)
        live = np.searchsorted(-n, -np.arange(1, len(x) + 1), side="right").tolist()
        for t in range(order, len(x)):
            m = live[t]
            total = weights[0, :m] * x[t - 1, :m]
            for j in range(1, order):
                total += weights[j, :m] * x[t - 1 - j, :m]
            total >>= shifts[:m]
            np.add(own[t - order, :m], total, out=x[t, :m])
        whole = np.ascontiguousarray(x.T)
        for row, c in enumerate(members):
            out[coded[c][0]] = whole[row, : coded[c][5]]
    return out  # type: ignore[return-value]


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, checked against their MD5."""
    opened = [Stream(s) for s in streams]
    jobs = [(s.data, begin, end, n) for s in opened for _, n, begin, end in s.frames()]
    parts = decode_frames(jobs)
    out = []
    for s in opened:
        signed = b"".join(next(parts).astype(np.int8).tobytes() for _ in s.frames())
        if len(signed) != s.samples or hashlib.md5(signed).digest() != s.md5:
            raise BadStream("the samples' MD5 doesn't hold")
        out.append((np.frombuffer(signed, dtype=np.uint8) ^ 0x80).tobytes())
    return out


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """Payload bytes first .. first + count - 1; only the frames that hold them are read."""
    opened = Stream(stream)
    frames = opened.frames(first, count)
    if not frames:
        return b""
    samples = np.concatenate(list(decode_frames([(stream, begin, end, n) for _, n, begin, end in frames])))
    skip = max(0, first - frames[0][0])
    return (samples[skip : skip + count] + 128).astype(np.uint8).tobytes()


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def features(payload: bytes) -> str:
    """Whole-number features of the samples: count, sum, energy, sign changes, least and greatest."""
    total = energy = crossings = 0
    least, most, before = 127, -128, None
    for at in range(0, len(payload), GROUP):
        x = np.frombuffer(payload, dtype=np.uint8)[at : at + GROUP].astype(np.int64) - 128
        total, energy = total + int(x.sum()), energy + int((x * x).sum())
        crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum()) + (before is not None and (before < 0) != (x[0] < 0))
        least, most, before = min(least, int(x.min())), max(most, int(x.max())), x[-1]
    return f"samples={len(payload)};sum={total};energy={energy};crossings={crossings};min={least};max={most}"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("row").field("text").cast(pa.binary()).fill_null(b"")
        for a, b in pieces(texts, 1 << 20):
            raw = texts.slice(a, b - a).to_pylist()
            media = encode_many([padded(t) for t in raw])
            payloads = decode_many(media)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(a, b - a), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary()),
                    pa.array([-(-len(p) // FRAME) for p in payloads], pa.int64()), pa.array(payloads, pa.binary()), pa.array([features(p) for p in payloads], pa.string()),
                ],
                names=["row", "n_bytes", "media", "n_blocks", "payload", "feature"],
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """row (a struct of the input's columns), n_bytes, media (a FLAC stream), n_blocks (PCM blocks that ``pcm_blocks`` makes of it), payload (read back from media) and feature."""
    rows = docs.select(as_row(docs.columns))
    return rows.mapInArrow(_round_trip, with_row(rows, "n_bytes long, media binary, n_blocks long, payload binary, feature string"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        streams = ((i, stream) for i, stream in enumerate(batch.column("media").to_pylist()) if stream is not None)
        frames = ((i, number, first, stream, begin, end, n) for i, stream in streams for number, (first, n, begin, end) in enumerate(Stream(stream).frames()))
        for group in _groups(frames):
            at, number, first = ([f[c] for f in group] for c in range(3))
            pcm = [(x + 128).astype(np.uint8).tobytes() for x in decode_frames([f[3:] for f in group])]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array([len(x) for x in pcm], pa.int32()), pa.array(pcm, pa.binary())],
                names=["doc_id", "block", "first_sample", "samples", "pcm"],
            )


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> doc_id, block, first_sample, samples, pcm: a row a frame, seekable by first_sample."""
    return media.select("doc_id", "media").mapInArrow(_blocks, with_id(media, "block int, first_sample long, samples int, pcm binary"))
