"""Progressive JPEG: a decoder of scans into coefficient arrays, and an encoder of given coefficients.

decode() accumulates spectral-selection and successive-approximation scans (with any Huffman tables, sampling factors and
restart intervals) into coefficient arrays, transforms them back with an integer matrix, repeats chroma samples up to full
resolution and gives an RGB tensor. A scan whose bits lie at fixed places is read all at once; what it finds is checked
against the scan's table, and any other scan is read symbol by symbol.

Formats, fixed by the JPEG standard (ITU T.81): markers, the zigzag order, and the conversion of colours.
"""

from __future__ import annotations

import functools
import math
import struct
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_BITS = 13


def _inverse_matrix() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to samples, scaled by 2 ** _BITS and rounded. Products of integers below 2 ** 53
    are exact in floating point, so results don't depend on how many blocks are transformed together."""
    x = np.arange(8)
    basis = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * i + 1) * u * math.pi / 16) for i in x] for u in x])
    full = np.einsum("ui,vj->uvij", basis, basis).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << _BITS))


_INVERSE = _inverse_matrix()


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks a row, whole units
    high: int = 0
    cols: int = 0  # blocks a row that scans of this component alone have
    rows: int = 0
    coefs: np.ndarray | None = None  # (high * wide, 64), zigzag order


@functools.lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class _Seen(dict):
    """The next 16 bits as text -> (symbol, length of its code), for those that have come up."""

    def __init__(self, look: dict):
        super().__init__()
        self.look = look

    def __missing__(self, key):
        for n in range(1, 17):
            got = self.look.get((n, int(key[:n], 2)))
            if got is not None:
                self[key] = got, n
                return got, n
        raise ValueError("a code that the table doesn't have")


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        code, k, self.codes, self.look = 0, 0, {}, {}
        self.seen = _Seen(self.look)
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[symbols[k]] = (code, length)
                self.look[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


@dataclass
class _Bits:
    """Bits of a scan (one restart interval), read from the left; beyond the end there are ones."""

    bits: np.ndarray
    at: int = 0
    text: str = field(default="", repr=False)

    def start(self) -> None:
        if not self.text:
            self.text = (self.bits + 48).tobytes().decode() + "1" * 64

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.at += n
        return int(self.text[self.at - n : self.at] or "1", 2)

    def symbol(self, table: Huffman) -> int:
        got, n = table.seen[self.text[self.at : self.at + 16].ljust(16, "1")]
        self.at += n
        return got


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Decoder:
    def __init__(self, raw: bytes):
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.quant, self.dc, self.ac, self.order, self.comps = {}, {}, {}, {}, []
        self.comment, self.restart, self.width, self.height = b"", 0, 0, 0
        at = 2
        while at < len(raw):
            if raw[at] != 0xFF:
                raise ValueError("a marker was expected")
            kind = raw[at + 1]
            if kind == 0xD9:
                break
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quants(body)
            elif kind == 0xC4:
                self._huffmans(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body)
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xDA:
                end = at
                while True:
                    end = raw.find(b"\xff", end)
                    if end < 0:
                        end = len(raw)
                        break
                    if raw[end + 1 : end + 2] != b"\x00" and not 0xD0 <= raw[end + 1] <= 0xD7:
                        break
                    end += 2
                self._scan(body, raw[at:end])
                at = end

    def _quants(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quant[n] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + size :]

    def _huffmans(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8:
            raise ValueError("8-bit samples only")
        self.comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(c.h for c in self.comps), max(c.v for c in self.comps)
        self.units = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.comps:
            c.wide, c.high = self.units[0] * c.h, self.units[1] * c.v
            c.cols = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.rows = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.coefs = np.zeros((c.wide * c.high, 64), np.int32)

    def _places(self, comps) -> np.ndarray:
        """(number of component in the scan, block's number), in the scan's order."""
        if len(comps) == 1:
            c = comps[0]
            at = (np.arange(c.rows)[:, None] * c.wide + np.arange(c.cols)).ravel()
            return np.stack([np.zeros(len(at), np.int64), at], axis=1)
        wide, high = self.units
        per = []
        for k, c in enumerate(comps):
            y = np.arange(high)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None]
            x = np.arange(wide)[None, :, None, None] * c.h + np.arange(c.h)[None, None, None, :]
            at = (y * c.wide + x).reshape(high * wide, c.h * c.v)
            per.append(np.stack([np.full_like(at, k), at], axis=2))
        return np.concatenate(per, axis=1).reshape(-1, 2)

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        by_name = {c.name: c for c in self.comps}
        comps = [by_name[body[1 + 2 * i]] for i in range(n)]
        tables = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        key = tuple(c.name for c in comps)
        if key not in self.order:
            self.order[key] = self._places(comps)
        places = self.order[key]
        parts = [data]
        if self.restart:
            parts, at = [], 0
            while (cut := data.find(b"\xff", at)) >= 0:
                if 0xD0 <= data[cut + 1] <= 0xD7:
                    parts.append(data[:cut])
                    data, at = data[cut + 2 :], 0
                else:
                    at = cut + 2
            parts.append(data)
        each = len(places) if len(parts) == 1 else self.restart * (1 if n == 1 else sum(c.h * c.v for c in comps))
        for i, part in enumerate(parts):
            some = places[i * each : (i + 1) * each]
            bits = _Bits(np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)))
            if first == 0 and last == 0:
                (self._dc_more if high else self._dc_first)(bits, comps, tables, some, low)
            elif first == 0:
                self._sequential(bits, comps, tables, some)
            elif high:
                if not self._ac_more_fixed(bits, comps[0], self.ac[tables[0][1]], some[:, 1], first, last, low):
                    self._ac_more(bits, comps[0], self.ac[tables[0][1]], some[:, 1], first, last, low)
            elif not self._ac_first_fixed(bits, comps[0], self.ac[tables[0][1]], some[:, 1], first, last, low):
                self._ac_first(bits, comps[0], self.ac[tables[0][1]], some[:, 1], first, last, low)

    def _dc_first(self, bits, comps, tables, places, low) -> None:
        bits.start()
        text, at, value = bits.text, 0, [0] * len(comps)
        looks = [self.dc[t[0]].seen for t in tables]
        out = []
        for k in places[:, 0].tolist():
            size, n = looks[k][text[at : at + 16].ljust(16, "1")]
            at += n
            if size:
                v = int(text[at : at + size], 2)
                at += size
                value[k] += v if v >> (size - 1) else v - (1 << size) + 1
            out.append(value[k])
        out = np.array(out, np.int32) << low
        for k, c in enumerate(comps):
            mine = places[:, 0] == k
            c.coefs[places[mine, 1], 0] = out[mine]

    def _dc_more(self, bits, comps, tables, places, low) -> None:
        got = bits.bits[: len(places)].astype(np.int32) << low
        for k, c in enumerate(comps):
            mine = places[:, 0] == k
            c.coefs[places[mine, 1], 0] |= got[mine]

    def _ac_first_fixed(self, bits, comp, table, blocks, first, last, low) -> bool:
        """Every coefficient has a code of its own with one and the same run and size: their places are known."""
        bits_ = bits.bits
        head = (bits_[:16] + 48).tobytes().decode()
        if not head:
            return False
        size, n = table.seen[head.ljust(16, "1")]
        if size >> 4 or not size:
            return False
        step, count = n + size, len(blocks) * (last - first + 1)
        if count * step > len(bits_):
            return False
        grid = bits_[: count * step].reshape(count, step)
        if (grid[:, :n] != grid[0, :n]).any():
            return False
        if size == 8:
            value = np.packbits(grid[:, n:]).astype(np.int32)
        else:
            value = grid[:, n:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1)).astype(np.int32)
        value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
        comp.coefs[blocks, first : last + 1] = (value << low).reshape(len(blocks), -1)
        return True

    def _ac_first(self, bits, comp, table, blocks, first, last, low) -> None:
        bits.start()
        skip = 0
        for b in blocks.tolist():
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                run, size = divmod(bits.symbol(table), 16)
                if size:
                    k += run
                    comp.coefs[b, k] = _extend(bits.take(size), size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.take(run) - 1
                    break

    def _ac_more_fixed(self, bits, comp, table, blocks, first, last, low) -> bool:
        """Nothing but runs of blocks without new coefficients: one bit for each coefficient that isn't zero."""
        known = comp.coefs[blocks, first : last + 1]
        if not known.all():
            return False
        width, done, at, got = last - first + 1, 0, 0, []
        while done < len(blocks):
            head = (bits.bits[at : at + 32] + 48).tobytes().decode()
            symbol, n = table.seen[head[:16].ljust(16, "1")]
            if symbol & 15 or symbol == 0xF0 or not head:
                return False
            run = symbol >> 4
            count = (1 << run) + (int(head[n : n + run], 2) if run else 0)
            at += n + run
            if done + count > len(blocks) or at + count * width > len(bits.bits):
                return False
            got.append(bits.bits[at : at + count * width])
            done, at = done + count, at + count * width
        more = np.concatenate(got).reshape(-1, width).astype(np.int32) << low
        comp.coefs[blocks, first : last + 1] += np.where(known < 0, -more, more)
        return True

    def _ac_more(self, bits, comp, table, blocks, first, last, low) -> None:
        bits.start()
        skip, bit = 0, 1 << low
        for b in blocks.tolist():
            row, k = comp.coefs[b], first
            while k <= last and not skip:
                run, size = divmod(bits.symbol(table), 16)
                new = 0
                if size:
                    new = bit if bits.take(1) else -bit
                elif run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if row[k]:
                        self._correct(bits, row, k, bit)
                    elif run:
                        run -= 1
                    else:
                        if new:
                            row[k] = new
                        k += 1
                        break
                    k += 1
            if skip:
                for j in range(k, last + 1):
                    if row[j]:
                        self._correct(bits, row, j, bit)
                skip -= 1

    @staticmethod
    def _correct(bits, row, k, bit) -> None:
        if bits.take(1) and not abs(int(row[k])) & bit:
            row[k] += bit if row[k] > 0 else -bit

    def _sequential(self, bits, comps, tables, places) -> None:
        bits.start()
        value = [0] * len(comps)
        for k, b in places.tolist():
            size = bits.symbol(self.dc[tables[k][0]])
            value[k] += _extend(bits.take(size), size)
            row, i = comps[k].coefs[b], 1
            row[0] = value[k]
            while i < 64:
                run, size = divmod(bits.symbol(self.ac[tables[k][1]]), 16)
                if not size and run < 15:
                    break
                i += run
                if size:
                    row[i] = _extend(bits.take(size), size)
                i += 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3), full resolution."""
        planes = []
        for c in self.comps:
            samples = (c.coefs * self.quant[c.table]).astype(np.float64) @ _INVERSE
            samples = (samples.astype(np.int64) + (1 << (_BITS - 1)) >> _BITS) + 128
            plane = np.clip(samples, 0, 255).astype(np.int32).reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)
            plane = plane.repeat(self.vmax // c.v, axis=0).repeat(self.hmax // c.h, axis=1) if (c.v, c.h) != (self.vmax, self.hmax) else plane
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # weights of the standard, in 16-bit fractions
        r = y + (91881 * cr + 32768 >> 16)
        g = y - (22554 * cb + 46802 * cr + 32768 >> 16)
        b = y + (116130 * cb + 32768 >> 16)
        return np.clip(np.stack([r, g, b], axis=2), 0, 255).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    """lengths: symbol -> length of its code."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind]) + bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17)) + bytes(order)


_DC_LENGTHS = {s: 4 for s in range(12)}
_AC_LENGTHS = {0x08: 1} | {r << 4: 5 for r in range(15)}
_DC = Huffman(_table(0, _DC_LENGTHS)[1:17], _table(0, _DC_LENGTHS)[17:])
_AC = Huffman(_table(0, _AC_LENGTHS)[1:17], _table(0, _AC_LENGTHS)[17:])
_UNIT = 6  # blocks a unit of 16 x 16 pixels: four of luma, one of each chroma


def _packed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.r_[bits, np.ones(pad, np.uint8)] if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def encode(blocks: np.ndarray, comment: bytes = b"") -> bytes:
    """A progressive 4:2:0 image of coefficients from 256 to 511 (n x 64 in zigzag order; n a multiple of 6: four luma blocks and
    two of chroma a unit), in one row of scans: DC, AC (luma in two bands), then the last bit of each. Units fill a near-square
    image; what is beyond the last unit holds 256 everywhere."""
    n = len(blocks) // _UNIT
    wide = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    high = -(-n // wide)
    full = np.full((wide * high * _UNIT, 64), 256, np.int32)
    full[: len(blocks)] = blocks
    units = full.reshape(high, wide, _UNIT, 64)
    luma = units[:, :, :4].reshape(high, wide, 2, 2, 64).swapaxes(1, 2).reshape(-1, 64)
    planes = [luma, units[:, :, 4].reshape(-1, 64), units[:, :, 5].reshape(-1, 64)]
    out = [b"\xff\xd8", _segment(0xFE, comment) if comment else b"", _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_segment(0xC4, _table(0x00, _DC_LENGTHS)), _segment(0xC4, _table(0x10, _AC_LENGTHS))]
    # the DC scan: differences within each component, in the units' order
    dc = units[:, :, :, 0].reshape(-1, _UNIT) >> 1
    diff = np.empty_like(dc)
    flat = dc[:, :4].ravel()
    diff[:, :4] = np.diff(flat, prepend=0).reshape(-1, 4)
    for k in (4, 5):
        diff[:, k] = np.diff(dc[:, k], prepend=0)
    diff = diff.ravel()
    size = np.frexp(np.abs(diff).astype(np.float64))[1]
    size[diff == 0] = 0
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = np.array([_DC.codes[s][0] for s in range(12)])[size]
    word, length = code << size | value, 4 + size
    at = np.arange(16)
    bits = (word[:, None] >> np.maximum(length[:, None] - 1 - at, 0) & 1).astype(np.uint8)[at < length[:, None]]
    scans = [(bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 0, 0x01]), _packed(bits))]
    code, n_code = _AC.codes[0x08]
    for k, first, last in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        top = (planes[k][:, first : last + 1] >> 1).astype(np.uint8).reshape(-1, 1)
        grid = np.empty((len(top), n_code + 8), np.uint8)
        grid[:, :n_code], grid[:, n_code:] = code, np.unpackbits(top, axis=1)
        scans.append((bytes([1, k + 1, 0x00, first, last, 0x01]), _packed(grid.ravel())))
    scans.append((bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 0, 0x10]), _packed((units[:, :, :, 0].ravel() & 1).astype(np.uint8))))
    for k, plane in enumerate(planes):
        low, parts, done = (plane[:, 1:] & 1).astype(np.uint8), [], 0
        while done < len(low):
            run = min(14, (len(low) - done).bit_length() - 1)
            count = min(len(low) - done, (2 << run) - 1)
            code, n_code = _AC.codes[run << 4]
            head = code << run | (count - (1 << run))
            parts.append(np.array([int(b) for b in format(head, f"0{n_code + run}b")], np.uint8))
            parts.append(low[done : done + count].ravel())
            done += count
        scans.append((bytes([1, k + 1, 0x00, 1, 63, 0x10]), _packed(np.concatenate(parts))))
    for head, data in scans:
        out += [_segment(0xDA, head), data]
    return b"".join([*out, b"\xff\xd9"])


def to_coefficients(payload: np.ndarray) -> np.ndarray:
    """Bytes (a multiple of 64 of them) as coefficients of whole units."""
    blocks = payload.reshape(-1, 64).astype(np.int32) + 256
    pad = -len(blocks) % _UNIT
    return np.concatenate([blocks, np.full((pad, 64), 256, np.int32)]) if pad else blocks


def from_coefficients(image: Decoder, n: int) -> np.ndarray:
    """The first n bytes that to_coefficients() and encode() have stored."""
    luma, cb, cr = (c.coefs for c in image.comps)
    wide, high = image.units
    units = np.concatenate([luma.reshape(high, 2, wide, 2, 64).swapaxes(1, 2).reshape(high * wide, 4, 64), cb[:, None], cr[:, None]], axis=1)
    return (units.reshape(-1)[:n] - 256).astype(np.uint8)
