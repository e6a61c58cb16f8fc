import hashlib
import random

import pytest

from convlake.llm import flac


def crc(data, poly, bits):
    v = 0
    for byte in data:
        v ^= byte << (bits - 8)
        for _ in range(8):
            v = (v << 1 ^ (poly if v >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
    return v


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, value, k):
        z = -2 * value - 1 if value < 0 else 2 * value
        self.s += "0" * (z >> k) + "1"
        self.put(z & ((1 << k) - 1), k)

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def stream(frames, coefficients, shift, precision, order_bits, method, escapes):
    """A stream written bit by bit, apart from the encoder: linear predictor, partitions, Rice parameters of 4 or 5 bits, escapes."""
    out, n, parts = b"", len(coefficients), 1 << order_bits
    for number, x in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x02, number])
        b = Bits()
        b.put((32 + n - 1) << 1, 8)
        for v in x[:n]:
            b.put(v, 8)
        b.put(precision - 1, 4)
        b.put(shift, 5)
        for c in coefficients:
            b.put(c, precision)
        rest = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(n, 192)]
        b.put(method, 2)
        b.put(order_bits, 4)
        at = 0
        for p in range(parts):
            own = rest[at : at + 192 // parts - (n if p == 0 else 0)]
            at += len(own)
            if p in escapes:
                width = max((abs(v).bit_length() + 1 for v in own), default=0) if any(own) else 0
                b.put((1 << (4 + method)) - 1, 4 + method)
                b.put(width, 5)
                for v in own:
                    b.put(v, width)
            else:
                b.put(3, 4 + method)
                for v in own:
                    b.rice(v, 3)
        body = head + bytes([crc(head, 0x07, 8)]) + b.bytes()
        out += body + crc(body, 0x8005, 16).to_bytes(2, "big")
    samples = bytes(v & 0xFF for x in frames for v in x)
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (44_100 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples).digest()
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + out, bytes((v + 128) & 0xFF for x in frames for v in x)


def test_streams_of_another_writer():
    r = random.Random(5)
    walk = lambda: [max(-128, min(127, int(40 * r.random()) - 20 + i % 50)) for i in range(192)]
    cases = [([3, -2, 1], 1, 5, 0, 0, ()), ([12, -5, 0, 1], 3, 8, 2, 0, (1,)), ([1], 0, 2, 3, 1, (0, 7)), ([127, -64] * 4, 7, 12, 1, 1, (0, 1))]
    made = [stream([walk(), walk(), [5] * 192], *case) for case in cases]
    assert flac.decode([s for s, _ in made]) == [want for _, want in made]
    broken = bytearray(made[1][0])
    broken[-40] ^= 4
    with pytest.raises(flac.Damaged):
        flac.decode([bytes(broken)])


def test_linear_predictors_are_written_and_read():
    r = random.Random(6)
    text = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) for _ in range(900)).encode()
    wave = bytes(int(128 + 100 * __import__("math").sin(i / 5)) for i in range(192 * 8))
    payloads = [text.ljust(-(-len(text) // 192) * 192), wave, bytes(192), bytes([255, 0] * 96)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    kinds = {s[flac.metadata(s)[2] + 6] >> 6 for s in streams}  # of each first frame
    assert 1 in kinds and len(streams[1]) < 0.65 * len(wave)
    # what a stream looks like doesn't depend on what it is coded with
    assert flac.encode([payloads[0]])[0] == streams[0] and flac.encode(payloads[::-1])[::-1] == streams
