"""FLAC, both ways, in vectorised numpy: 8-bit mono streams of 192-sample frames with a seek table."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 192
RATE = 44_100
SEEK = 64  # frames between seek points
ORDERS = 3  # fixed predictors 0 to 2 compete
SLAB = 1 << 13  # frames that are coded or decoded at once
LINEAR, PRECISION = 4, 7  # with a linear one: so many coefficients of so many bits


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint32)
    for i in range(256):
        v = i << (bits - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly if v & top else v << 1) & mask
        out[i] = v
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-8 of the first `length` bytes of each row."""
    crc = np.zeros(len(rows), np.uint32)
    for i in range(int(length.max(initial=0))):
        crc = np.where(i < length, CRC8[crc ^ rows[:, i]], crc)
    return crc


def crc16(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of spans of data, all spans side by side, longest first."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    crc = np.zeros(len(begin), np.uint32)
    alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left") if len(length) else []
    for i, n in enumerate(alive):
        c = crc[:n]
        crc[:n] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(c >> np.uint32(8)) ^ data[begin[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code: rows of 6 bytes, and how many of them count."""
    size = 1 + (n > 0x7F).astype(int) + (n > 0x7FF) + (n > 0xFFFF) + (n > 0x1FFFFF) + (n > 0x3FFFFFF)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        at = size == s
        if at.any():
            v = n[at]
            lead = 0 if s == 1 else (0xFF << (8 - s)) & 0xFF
            out[at, 0] = lead | (v >> (6 * (s - 1)))
            for i in range(1, s):
                out[at, i] = 0x80 | ((v >> (6 * (s - 1 - i))) & 0x3F)
    return out, size


def linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each frame's coefficients by Levinson's recursion, cut to PRECISION bits, their shift, and what they leave of the samples.

    Autocorrelations are whole numbers, so equal frames get equal coefficients whatever frames they are coded with."""
    wide = x.astype(np.int64)
    r = [(wide[:, k:] * wide[:, : BLOCK - k]).sum(1).astype(float) for k in range(LINEAR + 1)]
    a, error = np.zeros((len(x), LINEAR)), np.maximum(r[0], 1.0)
    for i in range(LINEAR):
        left = r[i + 1] - sum((a[:, j] * r[i - j] for j in range(i)), np.zeros(len(x)))
        k = left / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(1), 1e-9))), 0, 15).astype(np.int64)
    q = np.clip(np.rint(a * 2.0 ** shift[:, None]), -top - 1, top).astype(np.int64)
    guess = np.zeros((len(x), BLOCK - LINEAR), np.int64)
    for j in range(LINEAR):
        guess += q[:, j, None] * wide[:, LINEAR - 1 - j : BLOCK - 1 - j]
    return q, shift, wide[:, LINEAR:] - (guess >> shift[:, None])


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 192 bytes) as a FLAC stream; samples are the bytes less 128. SLAB frames at once, of
    however many payloads, so that working memory doesn't follow the longest."""
    sizes = np.array([len(p) for p in payloads]) // BLOCK
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    number = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    made = [_encode_frames(joined[k : k + SLAB].astype(np.int32) - 128, number[k : k + SLAB]) for k in range(0, len(joined), SLAB)]
    out, length = np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made])
    begin = np.cumsum(length) - length
    streams, f = [], 0
    for p, count in zip(payloads, sizes.tolist(), strict=True):
        own, each = begin[f : f + count] - begin[f], length[f : f + count]
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(own[i]), BLOCK) for i in range(0, count, SEEK))
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ np.uint8(0x80)).tobytes()).digest()  # noqa: S324  the format's own
        info = struct.pack(">HH", BLOCK, BLOCK) + int(each.min()).to_bytes(3, "big") + int(each.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        meta = b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        streams.append(meta + out[begin[f] : begin[f] + own[-1] + each[-1]].tobytes())
        f += count
    return streams


def _encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of frames of samples, one after the other, and each frame's length."""
    frames = len(x)
    best = np.full(frames, 8 * BLOCK)  # as plain samples
    order, rice = np.full(frames, -1), np.zeros(frames, int)
    folded = []
    d = x
    for o in range(ORDERS):
        z = np.where(d < 0, -2 * d - 1, 2 * d)
        folded.append(z)
        r = z[:, o:] if o else z
        for k in range(3, 8):
            bits = 8 * o + 10 + (r >> k).sum(1) + (BLOCK - o) * (1 + k)
            better = bits < best
            best = np.where(better, bits, best)
            order[better], rice[better] = o, k
        d = np.concatenate([np.zeros((frames, 1), np.int32), np.diff(d, axis=1)], axis=1)
    q, shift, d = linear(x)
    z = np.where(d < 0, -2 * d - 1, 2 * d)
    for k in range(3, 8):
        bits = (8 + PRECISION) * LINEAR + 9 + 10 + (z >> k).sum(1) + (BLOCK - LINEAR) * (1 + k)
        better = bits < best
        best = np.where(better, bits, best)
        order[better], rice[better] = ORDERS, k  # stands for the linear predictor
    # fields of a frame: sub-frame header, warm-up or plain samples, coefficients, Rice header, residuals: values and widths
    value, width = np.zeros((frames, BLOCK + 3 + LINEAR), np.uint64), np.zeros((frames, BLOCK + 3 + LINEAR), np.int64)
    plain = order < 0
    value[:, 0] = np.where(plain, 0x02, (8 + np.maximum(order, 0)) << 1)
    width[:, 0] = 8
    for o in range(ORDERS):
        at = np.flatnonzero(order == o)
        if len(at):
            value[at, 1 : 1 + o], width[at, 1 : 1 + o] = (x[at, :o] & 0xFF).astype(np.uint64), 8
            value[at, 1 + o], width[at, 1 + o] = rice[at].astype(np.uint64), 10  # method 0, one partition
            own, k = folded[o][at, o:], rice[at][:, None]
            value[at, 2 + o : 2 + BLOCK] = ((1 << k) | (own & ((1 << k) - 1))).astype(np.uint64)
            width[at, 2 + o : 2 + BLOCK] = (own >> k) + 1 + k
    at = np.flatnonzero(order == ORDERS)
    if len(at):
        n = LINEAR
        value[at, 0] = (32 + n - 1) << 1
        value[at, 1 : 1 + n], width[at, 1 : 1 + n] = (x[at, :n] & 0xFF).astype(np.uint64), 8
        value[at, 1 + n], width[at, 1 + n] = ((PRECISION - 1) << 5 | shift[at]).astype(np.uint64), 9
        value[at, 2 + n : 2 + 2 * n], width[at, 2 + n : 2 + 2 * n] = (q[at] & ((1 << PRECISION) - 1)).astype(np.uint64), PRECISION
        value[at, 2 + 2 * n], width[at, 2 + 2 * n] = rice[at].astype(np.uint64), 10
        own, k = z[at], rice[at][:, None]
        value[at, 3 + 2 * n :] = ((1 << k) | (own & ((1 << k) - 1))).astype(np.uint64)
        width[at, 3 + 2 * n :] = (own >> k) + 1 + k
    at = np.flatnonzero(plain)
    value[at, 1 : BLOCK + 1], width[at, 1 : BLOCK + 1] = (x[at] & 0xFF).astype(np.uint64), 8
    body = (width.sum(1) + 7) // 8
    # headers: sync, 192 samples at 44.1 kHz, mono, 8 bits, frame number, CRC-8
    code, n = _numbers(number)
    head = np.zeros((frames, 11), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x19, 0x02)
    head[:, 4:10] = code
    check = crc8(head, 4 + n)
    head[np.arange(frames), 4 + n] = check
    length = 5 + n + body + 2
    begin = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) + 16, np.uint8)
    for i in range(11):
        at = np.flatnonzero(i < 5 + n)
        out[begin[at] + i] = head[at, i]
    # bits: each field lies in two 32-bit words of a buffer of bodies that start on whole words
    words = (body + 3) // 4 + 1
    base = np.cumsum(words) - words
    ends = np.cumsum(width, axis=1)
    start = (ends - width + 32 * base[:, None]).ravel()
    w, v = width.ravel(), value.ravel()
    long = w > 32  # leading zeros of a long unary part need no bits set
    start, w = np.where(long, start + w - 32, start), np.where(long, 32, w)
    shifted = v << (64 - w - (start & 31)).astype(np.uint64)
    buffer = np.bincount(start >> 5, (shifted >> np.uint64(32)).astype(float), int(words.sum()) + 2)
    buffer += np.bincount((start >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), int(words.sum()) + 2)
    raw = buffer.astype(np.uint64).astype(">u4").view(np.uint8)
    inner = np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
    out[np.repeat(begin + 5 + n, body) + inner] = raw[np.repeat(4 * base, body) + inner]
    foot = crc16(out, begin, length - 2)
    out[begin + length - 2], out[begin + length - 1] = foot >> 8, foot & 0xFF
    return out[: int(length.sum())], length


class Damaged(ValueError):
    """A stream whose structure, checksums or digest don't hold."""


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """STREAMINFO, seek points (sample, byte offset from the first frame, samples), and where frames begin."""
    if stream[:4] != b"fLaC":
        raise Damaged("no stream marker")
    at, info, points, last = 4, {}, [], False
    while not last:
        if at + 4 > len(stream):
            raise Damaged("metadata break off")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and size == 34:
            bits = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[:2], "big"), "rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "bits": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size - size % 18, 18)]
    if not info or (info["block"], info["channels"], info["bits"]) != (BLOCK, 1, 8):
        raise Damaged("not a stream of 192-sample mono frames of 8 bits")
    return info, points, at


def _peek(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 56 bits or so that follow each bit position, at the top of a 64-bit word."""
    at = bit >> 3
    v = np.zeros(len(bit), np.uint64)
    for i in range(8):
        v |= data[at + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return v << (bit & 7).astype(np.uint64)


def _decode_frames(data: np.ndarray, begin: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the frames at `begin`, all side by side, and where each ends. Raises Damaged if a header or checksum is wrong."""
    frames = len(begin)
    code, n = _numbers(number)
    head = data[begin[:, None] + np.arange(11)]
    good = (head[:, :4] == (0xFF, 0xF8, 0x19, 0x02)).all(1) & ((head[:, 4:10] == code) | (np.arange(6) >= n[:, None])).all(1)
    if not good.all() or (crc8(head, 4 + n) != head[np.arange(frames), 4 + n]).any():
        raise Damaged("a frame's header is wrong")
    bit = (begin + 5 + n) * 8
    kind = data[bit >> 3].astype(int)
    bit = bit + 8
    out = np.zeros((frames, BLOCK), np.int64)
    plain, fixed, linear = kind == 2, (kind >= 16) & (kind <= 24), kind >= 64
    if not (plain | fixed | linear).all() or (kind & 1).any():
        raise Damaged("an unknown kind of sub-frame")
    order = np.where(fixed, (kind >> 1) - 8, np.where(linear, (kind >> 1) - 31, 0))
    signed = lambda v, w: np.where(v >> (w - 1) & 1, v - (np.int64(1) << w), v)
    at = np.flatnonzero(plain)
    if len(at):
        out[at] = data[(bit[at] >> 3)[:, None] + np.arange(BLOCK)].view(np.int8)
        bit[at] += 8 * BLOCK
    for i in range(int(order.max(initial=0))):
        at = np.flatnonzero(order > i)
        out[at, i] = signed((_peek(data, bit[at]) >> np.uint64(56)).astype(np.int64), np.int64(8))
        bit[at] += 8
    coefficients, shift = np.zeros((frames, 32), np.int64), np.zeros(frames, np.int64)
    for o, taps in enumerate(((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))):
        coefficients[fixed & (order == o), : len(taps)] = taps
    at = np.flatnonzero(linear)
    if len(at):
        bits = (_peek(data, bit[at]) >> np.uint64(55)).astype(np.int64)
        precision, shift[at] = (bits >> 5) + 1, signed(bits & 31, np.int64(5))
        bit[at] += 9
        for i in range(int(order[at].max())):
            on = order[at] > i
            v = (_peek(data, bit[at][on]) >> (64 - precision[on]).astype(np.uint64)).astype(np.int64)
            coefficients[at[on], i] = signed(v, precision[on])
            bit[at[on]] += precision[on]
    at = np.flatnonzero(~plain)
    if len(at):
        bits = (_peek(data, bit[at]) >> np.uint64(54)).astype(np.int64)
        method, parts = bits >> 8, np.int64(1) << (bits >> 4 & 15)
        rice = bits & 15
        bit[at] += 6
        width = 4 + method
        if (method > 1).any() or (BLOCK % parts).any():
            raise Damaged("an unknown residual code")
        position, taps, most = bit[at], coefficients[at], int(order.max())
        span, first = BLOCK // parts, order[at]
        x = out[at].T.copy()
        raw = np.full(len(at), -1, np.int64)  # bits of a sample in an escaped partition
        for i in range(BLOCK):
            opens = np.flatnonzero((i % span == 0))
            if len(opens):  # a partition's parameter
                v = _peek(data, position[opens]) >> (64 - width[opens]).astype(np.uint64)
                rice[opens] = v.astype(np.int64)
                position[opens] += width[opens]
                escaped = rice[opens] == (1 << width[opens]) - 1
                raw[opens] = np.where(escaped, (_peek(data, position[opens]) >> np.uint64(59)).astype(np.int64), -1)
                position[opens] += 5 * escaped
            on = np.flatnonzero(i >= first) if i < most else slice(None)
            p, k, more = position[on], rice[on], 0
            v = _peek(data, p)
            whole = raw[on] >= 0
            while (far := ((v >> np.uint64(24)) == 0) & ~whole).any():  # forty zeros: go on behind them
                skipped = far * np.int64(40)
                p, more = p + skipped, more + skipped
                if (p >= 8 * (len(data) - 16)).any():
                    raise Damaged("a unary part doesn't end")
                v = _peek(data, p)
            zeros = 53 - np.frexp((v >> np.uint64(11)).astype(float))[1].astype(np.int64)
            low = (v << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
            z = (zeros + more) << k | low.astype(np.int64)
            rest = z >> 1 ^ -(z & 1)
            after = p + zeros + 1 + k
            if whole.any():
                w = np.maximum(raw[on], 0)
                plain_bits = np.where(w > 0, (_peek(data, p) >> np.minimum(64 - w, 63).astype(np.uint64)).astype(np.int64), 0)
                rest = np.where(whole, np.where(w > 0, signed(plain_bits, np.maximum(w, 1)), 0), rest)
                after = np.where(whole, p + w, after)
            position[on] = after
            guess = sum((taps[on, j] * x[i - 1 - j][on] for j in range(min(most, i))), np.int64(0))
            x[i][on] = rest + (guess >> shift[at][on] if linear.any() else guess)
        out[at] = x.T
        bit[at] = position
    end = (bit + 7) // 8
    foot = data[end].astype(int) << 8 | data[end + 1]
    if (crc16(data, begin, end - begin) != foot).any():
        raise Damaged("a frame's checksum is wrong")
    return out, end + 2


def frame_starts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Candidate frame starts: every place with this stream's sync code; decoding confirms or denies them."""
    d = data[begin:end]
    return begin + np.flatnonzero((d[:-3] == 0xFF) & (d[1:-2] == 0xF8) & (d[2:-1] == 0x19) & (d[3:] == 0x02))


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads back from their streams; headers, frame checksums and the samples' MD5 are verified."""
    heads = [metadata(s) for s in streams]
    joined = np.frombuffer(b"".join(streams) + bytes(32), np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    begins, numbers, counts = [], [], []
    for (info, _, first), size, end in zip(heads, map(len, streams), ends, strict=True):
        base = end - size
        found, count = frame_starts(joined, int(base + first), int(end)), -(-info["samples"] // BLOCK)
        if len(found) > count:  # a sync code within a frame: the header's number and CRC-8 tell
            kept, at = [], 0
            code, n = _numbers(np.arange(count + 1))
            for p in found:
                h = joined[p : p + 11]
                if at < count and (h[4 : 4 + n[at]] == code[at, : n[at]]).all() and crc8(h[None], n[at : at + 1] + 4)[0] == h[4 + n[at]]:
                    kept.append(p)
                    at += 1
            found = np.array(kept, np.int64)
        if len(found) != count:
            raise Damaged("a frame is missing")
        begins.append(found)
        numbers.append(np.arange(count))
        counts.append(count)
    begin, number = np.concatenate(begins), np.concatenate(numbers)
    raw, over = bytearray(), np.empty_like(begin)
    for k in range(0, len(begin), SLAB):
        samples, over[k : k + SLAB] = _decode_frames(joined, begin[k : k + SLAB], number[k : k + SLAB])
        raw += samples.astype(np.int8).tobytes()
    follows = np.r_[begin[1:], 0]
    last = np.cumsum(counts) - 1
    follows[last] = ends
    if (over != follows).any():
        raise Damaged("frames don't follow each other")
    out, f = [], 0
    for (info, _, _), count in zip(heads, counts, strict=True):
        own = bytes(raw[f * BLOCK : (f + count) * BLOCK][: info["samples"]])
        if hashlib.md5(own).digest() != info["md5"]:  # noqa: S324
            raise Damaged("the samples' digest is wrong")
        out.append((np.frombuffer(own, np.uint8) ^ np.uint8(0x80)).tobytes())
        f += count
    return out


def read_samples(stream: bytes, sample: int, count: int) -> bytes:
    """Bytes sample .. sample + count - 1 of the payload, decoded from the nearest seek point before them."""
    info, points, first = metadata(stream)
    sample, stop = max(0, min(sample, info["samples"])), min(info["samples"], sample + count)
    if stop <= sample:
        return b""
    origin, offset, _ = max((p for p in points if p[0] <= sample), default=(0, 0, 0))
    data = np.frombuffer(stream + bytes(32), np.uint8)
    at, number, parts = first + offset, origin // BLOCK, []
    while number * BLOCK < stop:
        block, end = _decode_frames(data, np.array([at]), np.array([number]))
        parts.append(block[0])
        at, number = int(end[0]), number + 1
    own = (np.concatenate(parts) + 128).astype(np.uint8).tobytes()
    return own[sample - origin : stop - origin]
