"""Progressive JPEG: payloads stored as coefficients, images decoded to RGB tensors.

``decode`` reads any progressive JPEG with 8-bit samples and one or three
components: it accumulates the spectral-selection and successive-approximation
scans into coefficient arrays. ``rgb`` dequantises them, inverse-transforms all
blocks at once in numpy, repeats chroma to full resolution and converts to RGB.

``store`` keeps bytes without loss in the format's own unit, the quantised
coefficient: byte b is the coefficient 256 + b, 64 bytes a block, four blocks of
luma to one of each chroma. Coefficients so mapped have a fixed code width in
the first scans, and in the refining scans a single run of blocks, which is what
lets numpy pack and unpack a scan as a whole; the decoder takes these short cuts
only where the tables and coefficients show that they hold.

The transform works in whole numbers, in doubles that hold them exactly, so
equal images give equal tensors whatever they are batched with.

Defined cases: a null or empty text is a payload of 64 zero bytes; a text of a
positive multiple of 64 bytes is its own payload; repeated rows are treated alike.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 64
_OFFSET = 256
_MAX_RUN = 0x7FFF
_short_cuts = True  # off in a test, which then decodes the same scans code by code


@lru_cache(maxsize=1)
def _zigzag() -> np.ndarray:
    """Natural position (row * 8 + column) of each zigzag index."""
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    return np.array(order)


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Zigzag coefficients to samples, 64 x 64, in units of 2**-12 and whole."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    natural = np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)
    return np.rint(natural[_zigzag()] * 4096)


# ---------------------------------------------------------------- Huffman tables


class Huffman:
    """A table of a DHT segment: the counts of codes by length and the symbols by code."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.codes: dict[int, tuple[int, int]] = {}
        self.lengths = np.zeros(1 << 16, np.uint8)
        self.values = np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length in range(1, 17):
            for symbol in symbols[at:at + counts[length - 1]]:
                self.codes[symbol] = code, length
                low, high = code << 16 - length, code + 1 << 16 - length
                self.lengths[low:high], self.values[low:high] = length, symbol
                code += 1
            at += counts[length - 1]
            code <<= 1

    @staticmethod
    def flat(symbols: list[int], length: int) -> Huffman:
        """A table that gives each symbol a code of this length."""
        return Huffman(bytes(len(symbols) if i == length else 0 for i in range(1, 17)), bytes(symbols))

    def segment(self, kind: int, slot: int) -> bytes:
        return _segment(0xC4, bytes([kind << 4 | slot]) + self.counts + self.symbols)


@lru_cache(maxsize=64)
def _table(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# ---------------------------------------------------------------- storing bytes

_DC = Huffman.flat(list(range(12)), 4)
_FIRST = Huffman.flat([0x08], 1)
_REFINE = Huffman.flat([r << 4 for r in range(15)], 4)


def _stuffed(raw: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 0xFF."""
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _bits_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated bits of numbers with the given lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    back = np.repeat(ends, lengths) - 1 - np.arange(total)
    return (np.repeat(values, lengths) >> back & 1).astype(np.uint8)


def _filled(bits: np.ndarray) -> np.ndarray:
    """Bits to bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)]))


_UP = np.arange(1, 9, dtype=np.uint16)
_DOWN = np.arange(7, -1, -1, dtype=np.uint16)
_MARKS = (1 << _DOWN).astype(np.uint8)


def _nine(values: np.ndarray) -> np.ndarray:
    """A zero bit and the 8 bits of each number: eight numbers are nine bytes."""
    n = len(values)
    v = np.full(n + -n % 8, 0xFF, np.uint16)
    v[:n] = values
    v = v.reshape(-1, 8)
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    out[:, 1:8] = v[:, :7] << _DOWN[:7] | v[:, 1:] >> _UP[1:]
    out[:, 8] = v[:, 7]
    flat = out.reshape(-1)[:-(-9 * n // 8)]
    if 9 * n % 8:
        flat[-1] |= (1 << 8 - 9 * n % 8) - 1
    return flat


def _of_nine(raw: np.ndarray, n: int) -> np.ndarray:
    """The numbers that ``_nine`` packed; any other code is an error."""
    groups = -(-n // 8)
    g = np.zeros(groups * 9, np.uint8)
    g[:min(len(raw), groups * 9)] = raw[:groups * 9]
    g = g.reshape(-1, 9)
    codes = (g[:, :8] & _MARKS).reshape(-1)[:n]
    if codes.any():
        raise ValueError("not the only code of its table")
    return ((g[:, :8].astype(np.uint16) << _UP | g[:, 1:] >> _DOWN) & 0xFF).reshape(-1)[:n]


def _scan(components: list[int], tables: int, low: int, high: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(b for c in components for b in (c, tables)), low, high, ah << 4 | al]))


def _interleaved(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, wide: int) -> np.ndarray:
    """Values by block, luma in rows of 2 * wide blocks, in MCU order."""
    luma = y.reshape(-1, 2, wide, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    return np.concatenate([luma, cb.reshape(-1, 1), cr.reshape(-1, 1)], axis=1)


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    mcus = -(-len(payload) // (6 * BLOCK))
    wide = min(mcus, max(16, -(-mcus // 4095)))
    tall = -(-mcus // wide)
    mcus = wide * tall
    values = np.zeros(mcus * 6 * BLOCK, np.uint8)
    values[:len(payload)] = np.frombuffer(payload, np.uint8)
    parts = np.split(values.reshape(-1, BLOCK), [4 * mcus, 5 * mcus])
    high = [(p >> 1) | 0x80 for p in parts]  # (256 + b) >> 1
    dc = _interleaved(*(h[:, 0].astype(np.int32) for h in high), wide)
    diffs = np.empty_like(dc)
    luma = dc[:, :4].reshape(-1)
    diffs[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    diffs[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=np.zeros((1, 2), np.int32))
    diffs = diffs.reshape(-1)
    size = _SIZES[np.abs(diffs)]
    bits = _bits_of((size << size) | np.where(diffs < 0, diffs + (1 << size) - 1, diffs), size + 4)
    out = [
        b"\xff\xd8", _segment(0xFE, f"payload={len(payload)}".encode()), _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _DC.segment(0, 0), _FIRST.segment(1, 0), _REFINE.segment(1, 1),
        _scan([1, 2, 3], 0x00, 0, 0, 0, 1), _stuffed(_filled(bits)),
    ]
    for c, low, top in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        out += [_scan([c + 1], 0x00, low, top, 0, 1), _stuffed(_nine(high[c][:, low:top + 1].reshape(-1)))]
    odd = [p & 1 for p in parts]
    out += [_scan([1, 2, 3], 0x00, 0, 0, 1, 0), _stuffed(_filled(_interleaved(*(o[:, 0] for o in odd), wide).reshape(-1)))]
    for c in range(3):
        runs = []
        for i in range(0, len(odd[c]), _MAX_RUN):
            own = odd[c][i:i + _MAX_RUN, 1:].reshape(-1)
            n = len(own) // 63
            r = n.bit_length() - 1
            runs += [_bits_of(np.array([r, n - (1 << r)]), np.array([4, r])), own]
        out += [_scan([c + 1], 0x01, 1, 63, 1, 0), _stuffed(_filled(np.concatenate(runs)))]
    return b"".join([*out, b"\xff\xd9"])


_SIZES = np.array([n.bit_length() for n in range(1 << 12)], np.int32)


def stored(image: bytes) -> bytes:
    """The payload that ``store`` put in an image."""
    found = decode(image)
    if not found.comment.startswith(b"payload="):
        raise ValueError("the image holds no payload")
    flat = np.concatenate([c.blocks.reshape(-1, BLOCK) for c in found.components])
    return payload_of(flat, int(found.comment.partition(b"=")[2]))


def payload_of(flat: np.ndarray, size: int) -> bytes:
    values = flat.reshape(-1)[:size] - _OFFSET
    if len(values) < size or (values & ~0xFF).any():
        raise ValueError("a coefficient is no payload byte")
    return values.astype(np.uint8).tobytes()


# ---------------------------------------------------------------- decoding


class Component:
    """A component's sampling factors, quantisation slot and coefficients (rows, columns, 64 in zigzag order)."""

    def __init__(self, number: int, across: int, down: int, quant: int):
        self.number, self.across, self.down, self.quant = number, across, down, quant
        self.blocks = np.zeros((0, 0, 64), np.int16)
        self.shown = (0, 0)  # rows and columns of blocks that scans of this component alone hold


class Image:
    """Coefficients of a decoded image."""

    def __init__(self):
        self.height = self.width = 0
        self.components: list[Component] = []
        self.quants: dict[int, np.ndarray] = {}
        self.comment = b""


class _Bits:
    """Reads an entropy-coded segment, bytes already without stuffing."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.at = 0
        self._whole: int | None = None
        self.size = 8 * len(raw)

    def peek16(self) -> int:
        i = self.at >> 3
        window = int.from_bytes(self.raw[i:i + 3].tobytes().ljust(3, b"\xff"), "big")
        return window >> 8 - (self.at & 7) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        i, end = self.at >> 3, self.at + n
        j = end + 7 >> 3
        window = int.from_bytes(self.raw[i:j].tobytes().ljust(j - i, b"\xff"), "big")
        self.at = end
        return window >> 8 * j - end & (1 << n) - 1

    def array(self, n: int) -> np.ndarray:
        """The next n bits."""
        i, skip = self.at >> 3, self.at & 7
        self.at += n
        found = np.unpackbits(self.raw[i:i + (n + skip + 7 >> 3)])[skip:skip + n]
        if len(found) < n:
            raise ValueError("a scan is cut short")
        return found

    def symbol(self, table: Huffman) -> int:
        window = self.peek16()
        length = int(table.lengths[window])
        if not length:
            raise ValueError("no such code")
        self.at += length
        return int(table.values[window])


def _extend(value: int, size: int) -> int:
    return value if not size or value >> size - 1 else value - (1 << size) + 1


def _unstuffed(raw: np.ndarray) -> np.ndarray:
    full = raw[:-1] == 0xFF
    if not full.any():
        return raw
    keep = np.ones(len(raw), bool)
    np.logical_not(full, out=keep[1:])
    return raw[keep]


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, restart, at = Image(), {}, 0, 2
    raw = np.frombuffer(data, np.uint8)
    # The ends of entropy-coded data: an 0xFF that no zero or restart marker follows.
    follows = raw[1:]
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (follows != 0) & ((follows & 0xF8) != 0xD0) & (follows != 0xFF))
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4:at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            _quantisation(body, image)
        elif marker == 0xC4:
            _huffman(body, tables)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _frame(body, image)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman-coded frame")
        elif marker == 0xDA:
            end = int(marks[np.searchsorted(marks, at)]) if len(marks) and marks[-1] >= at else len(data)
            _scan_of(body, raw[at:end], image, tables, restart)
            at = end
    raise ValueError("the image has no end")


def _quantisation(body: bytes, image: Image) -> None:
    at = 0
    while at < len(body):
        wide, slot = body[at] >> 4, body[at] & 15
        image.quants[slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int32)
        at += 1 + 64 * (1 + bool(wide))


def _huffman(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        counts = body[at + 1:at + 17]
        tables[body[at] >> 4, body[at] & 15] = _table(counts, body[at + 17:at + 17 + sum(counts)])
        at += 17 + sum(counts)


def _frame(body: bytes, image: Image) -> None:
    depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or n not in (1, 3):
        raise ValueError("only 8-bit images of one or three components")
    image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    across, down = max(c.across for c in image.components), max(c.down for c in image.components)
    wide, tall = -(-image.width // (8 * across)), -(-image.height // (8 * down))
    for c in image.components:
        c.blocks = np.zeros((tall * c.down, wide * c.across, 64), np.int16)
        c.shown = (-(-(-(-image.height * c.down // down)) // 8), -(-(-(-image.width * c.across // across)) // 8))


def _scan_of(body: bytes, coded: np.ndarray, image: Image, tables: dict, restart: int) -> None:
    n = body[0]
    chosen = [(next(c for c in image.components if c.number == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    low, high, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    # Restart markers stand only where an interval was defined.
    resets = np.flatnonzero((coded[:-1] == 0xFF) & ((coded[1:] & 0xF8) == 0xD0)).tolist() if restart else []
    bounds = zip([0, *(r + 2 for r in resets)], [*resets, len(coded)], strict=True)
    pieces = [_Bits(_unstuffed(coded[a:b])) for a, b in bounds]
    if low == 0:
        order = [_order(c, image, n > 1) for c, _ in chosen]
        units = len(order[0])
        for i, bits in enumerate(pieces):
            part = slice(i * restart, (i + 1) * restart) if restart else slice(0, units)
            places = [o[part] for o in order]
            if ah:
                _refine_dc(bits, chosen, places, al)
            else:
                _first_dc(bits, chosen, places, tables, al)
        return
    (component, slots), = chosen
    table = tables[1, slots & 15]
    rows, columns = component.shown
    own = component.blocks[:rows, :columns].reshape(-1, 64)  # a copy if the component is padded
    for i, bits in enumerate(pieces):
        part = own[i * restart:(i + 1) * restart] if restart else own
        (_refine_ac if ah else _first_ac)(bits, part, table, low, high, al)
    if component.blocks.shape[:2] != (rows, columns):
        component.blocks[:rows, :columns] = own.reshape(rows, columns, 64)


def _order(c: Component, image: Image, together: bool) -> np.ndarray:
    """Indices of a component's blocks by unit of a DC scan: (units, blocks of a unit)."""
    rows, columns = c.blocks.shape[:2]
    grid = np.arange(rows * columns).reshape(rows, columns)
    if not together:
        return grid[:c.shown[0], :c.shown[1]].reshape(-1, 1)
    return grid.reshape(rows // c.down, c.down, columns // c.across, c.across).transpose(0, 2, 1, 3).reshape(-1, c.down * c.across)


def _first_dc(bits: _Bits, chosen: list, places: list[np.ndarray], tables: dict, al: int) -> None:
    """Every bit position is decoded as if a code began there; following the codes' lengths finds those that do."""
    per = [p.shape[1] for p in places]
    units, width = len(places[0]), sum(per)
    used = [tables[0, slots >> 4] for _, slots in chosen]
    padded = np.concatenate([bits.raw, np.full(6, 0xFF, np.uint8)]).astype(np.int64)
    n = bits.size + 1
    five = padded[:-5] << 32 | padded[1:-4] << 24 | padded[2:-3] << 16 | padded[3:-2] << 8 | padded[4:-1]
    window = ((five[:, None] << np.arange(8)) & 0xFFFFFFFFFF).reshape(-1)[:n]
    steps, found = [], []
    for k, table in enumerate(used):
        if any(table is t for t in used[:k]):
            same = next(i for i, t in enumerate(used) if t is table)
            steps.append(steps[same])
            found.append(found[same])
            continue
        code = window >> 24
        length, size = table.lengths[code].astype(np.int64), table.values[code].astype(np.int64)
        extra = window >> (40 - length - size) & (1 << size) - 1
        value = np.where((size > 0) & (extra >> np.maximum(size - 1, 0) == 0), extra - (1 << size) + 1, extra)
        steps.append(np.where(length > 0, np.minimum(np.arange(n) + length + size, n - 1), n - 1).tolist())
        found.append(value)
    at, starts = 0, []
    if len({id(s) for s in used}) == 1:
        step = steps[0]
        for _ in range(units * width):
            starts.append(at)
            at = step[at]
    else:
        turn = [step for step, k in zip(steps, per, strict=True) for _ in range(k)]
        for _ in range(units):
            for step in turn:
                starts.append(at)
                at = step[at]
    grid = np.array(starts, np.int64).reshape(units, width)
    if units and starts[-1] >= bits.size:
        raise ValueError("a scan is cut short")
    column = 0
    for (component, _), place, value, k in zip(chosen, places, found, per, strict=True):
        diffs = value[grid[:, column:column + k]].reshape(-1)
        component.blocks.reshape(-1, 64)[place.reshape(-1), 0] = np.cumsum(diffs) << al
        column += k


def _refine_dc(bits: _Bits, chosen: list, places: list[np.ndarray], al: int) -> None:
    per = [p.shape[1] for p in places]
    found = bits.array(len(places[0]) * sum(per)).reshape(len(places[0]), -1).astype(np.int16)
    column = 0
    for (component, _), place, k in zip(chosen, places, per, strict=True):
        component.blocks.reshape(-1, 64)[place.reshape(-1), 0] |= found[:, column:column + k].reshape(-1) << al
        column += k


def _first_ac(bits: _Bits, blocks: np.ndarray, table: Huffman, low: int, high: int, al: int) -> None:
    band = high - low + 1
    if _short_cuts and table.symbols == b"\x08" and table.counts[0] == 1 and len(bits.raw) >= -(-9 * band * len(blocks) // 8):
        # The only code is a zero bit for "no zeros before, 8 bits follow", so a coefficient takes nine bits.
        values = _of_nine(bits.raw, band * len(blocks)).astype(np.int16)
        values -= (values < 128) * np.int16(255)
        blocks[:, low:high + 1] = values.reshape(-1, band) << al
        return
    run = 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = low
        while k <= high:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = _extend(bits.take(size), size) << al
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _refine_ac(bits: _Bits, blocks: np.ndarray, table: Huffman, low: int, high: int, al: int) -> None:
    i, k = 0, low
    step = 1 << al
    while i < len(blocks):
        block = blocks[i]
        if k > high:
            i, k = i + 1, low
            continue
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            part = block[k:high + 1]
            _correct(bits, part, part != 0, step)
            rest = blocks[i + 1:i + run, low:high + 1]
            if len(rest):
                _correct(bits, rest, rest != 0, step)
            i, k = i + run, low
            continue
        fresh = (step if bits.take(1) else -step) if size else 0
        while k <= high:
            if block[k]:
                if bits.take(1) and not block[k] & step:
                    block[k] += step if block[k] > 0 else -step
            elif not zeros:
                if fresh:
                    block[k] = fresh
                k += 1
                break
            else:
                zeros -= 1
            k += 1


def _correct(bits: _Bits, part: np.ndarray, there: np.ndarray, step: int) -> None:
    """One correction bit for each coefficient that is not zero, in order."""
    if _short_cuts and there.all() and part.flags.c_contiguous:
        found = bits.array(part.size).reshape(part.shape)
        part += ((part >> 15) | 1) * (found * np.int16(step))  # -1 or 1 by sign
        return
    n = int(there.sum())
    if n:
        own = part[there]
        part[there] = own + ((own >> 15) | 1) * (bits.array(n) * np.int16(step))


def planes(image: Image) -> list[np.ndarray]:
    """The samples of each component, whole blocks, not yet cut to the image."""
    out = []
    for c in image.components:
        rows, columns = c.blocks.shape[:2]
        coefficients = (c.blocks.reshape(-1, 64) * image.quants[c.quant]).astype(np.float64)
        samples = np.floor((coefficients @ _basis() + (128 * 4096 + 2048)) / 4096)
        out.append(np.clip(samples, 0, 255).astype(np.uint8).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8))
    return out


def rgb(image: Image) -> np.ndarray:
    """The image as (height, width, 3) bytes."""
    across, down = max(c.across for c in image.components), max(c.down for c in image.components)
    full = []
    for c, plane in zip(image.components, planes(image), strict=True):
        if across % c.across or down % c.down:
            raise ValueError("sampling factors must divide the largest")
        plane = plane.repeat(down // c.down, axis=0) if down > c.down else plane
        plane = plane.repeat(across // c.across, axis=1) if across > c.across else plane
        full.append(plane[:image.height, :image.width])
    if len(full) == 1:
        return np.repeat(full[0][..., None], 3, axis=2)
    y = full[0].astype(np.int32) << 16
    cb, cr = full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    half = 1 << 15
    out[..., 0] = np.clip(y + 91881 * cr + half >> 16, 0, 255)
    out[..., 1] = np.clip(y - 22554 * cb - 46802 * cr + half >> 16, 0, 255)
    out[..., 2] = np.clip(y + 116130 * cb + half >> 16, 0, 255)
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, sum of each channel and checksum of a tensor."""
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"rgb {tensor.shape[1]}x{tensor.shape[0]} {sums[0]},{sums[1]},{sums[2]} {crc32(tensor.tobytes()):08x}"


# ---------------------------------------------------------------- columns


def payload(text: str | None) -> bytes:
    """A text in UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK) or bytes(BLOCK)


def store_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the payload of every text as an image."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, images = [], []
            for t in batch.column(1):
                value = t.as_py()
                sizes.append(len((value or "").encode()))
                images.append(store(payload(value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(encode, f"`{key}` {kind}, n_bytes long, media binary")


def tensors(df: DataFrame, *, media: str = "media", payload: bool = False) -> DataFrame:
    """Adds height, width and rgb (binary, row by row) of each image, and with ``payload`` the bytes stored in it; columns of these names are replaced. An image that cannot be read fails the query; a null one has nulls."""
    added = [("height", "int", pa.int32()), ("width", "int", pa.int32()), ("rgb", "binary", pa.binary())] + [("payload", "binary", pa.binary())] * payload
    df = df.drop(*(n for n, _, _ in added))
    at = df.columns.index(media)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, rows = 0, 0, []
            for i, m in enumerate(batch.column(at)):
                rows.append(_opened(m.as_py(), payload))
                held += len(rows[-1][2] or b"")
                if held > 4 << 20 or i + 1 == batch.num_rows:
                    columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows, strict=True), added, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(rows)).columns, *columns], names=[*batch.schema.names, *(n for n, _, _ in added)])
                    begin, held, rows = i + 1, 0, []

    return df.mapInArrow(read, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} {kind}" for n, kind, _ in added)]))


def _opened(image: bytes | None, payload: bool) -> tuple:
    """Height, width and tensor of a stored image, and the bytes stored in it."""
    if image is None:
        return (None,) * (3 + payload)
    found = decode(image)
    tensor = rgb(found)
    out = (tensor.shape[0], tensor.shape[1], tensor.tobytes())
    if not payload:
        return out
    flat = np.concatenate([c.blocks.reshape(-1, BLOCK) for c in found.components])
    return (*out, payload_of(flat, int(found.comment.partition(b"=")[2])))


def features(df: DataFrame) -> DataFrame:
    """Adds ``feature``, taken from the columns of ``tensors``, in the place of ``rgb``."""
    df = df.drop("feature")
    names = [n for n in df.columns if n != "rgb"]
    at = [df.columns.index(n) for n in ("height", "width", "rgb")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else feature(np.frombuffer(t, np.uint8).reshape(h, w, 3)) for h, w, t in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            yield batch.select(names).append_column("feature", pa.array(found, pa.string()))

    return df.mapInArrow(read, ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names) + ", feature string")
