"""Progressive JPEG: exact round trips, and images of a plain encoder with other scans, tables and samplings."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from tessella.llm import media, queries


class Plain:
    """Encodes coefficient blocks a symbol at a time, with flat tables, runs of blocks and restarts."""

    def __init__(self, height, width, components, quant=1, restart=0):
        self.height, self.width, self.components, self.quant, self.restart = height, width, components, quant, restart
        self.across, self.down = max(h for h, _, _ in components), max(v for _, v, _ in components)
        self.out = [b"\xff\xd8", media._segment(0xDB, b"\x00" + bytes([quant]) * 64)]
        frame = struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(components))
        self.out.append(media._segment(0xC2, frame))
        symbols = list(range(256))
        self.dc = media.Huffman.flat(symbols[:12], 5)
        self.ac = media.Huffman.flat([s for s in symbols if s & 15 <= 10 and s not in (0xFA,)], 8)
        self.out += [self.dc.segment(0, 0), self.ac.segment(1, 0)]
        if restart:
            self.out.append(media._segment(0xDD, struct.pack(">H", restart)))

    def shown(self, c):
        h, v, blocks = self.components[c]
        return -(-(-(-self.height * v // self.down)) // 8), -(-(-(-self.width * h // self.across)) // 8)

    def units(self, chosen):
        if len(chosen) == 1:
            rows, columns = self.shown(chosen[0])
            return [[(chosen[0], y, x)] for y in range(rows) for x in range(columns)]
        wide, tall = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))
        return [[(c, my * self.components[c][1] + y, mx * self.components[c][0] + x) for c in chosen for y in range(self.components[c][1]) for x in range(self.components[c][0])] for my in range(tall) for mx in range(wide)]

    def scan(self, chosen, low, high, ah, al):
        self.out.append(media._segment(0xDA, bytes([len(chosen), *(b for c in chosen for b in (c + 1, 0)), low, high, ah << 4 | al])))
        units = self.units(chosen)
        size = self.restart or len(units)
        for n, i in enumerate(range(0, len(units), size)):
            if n:
                self.out.append(bytes([0xFF, 0xD0 + (n - 1) % 8]))
            self.bits = []
            part = [b for u in units[i:i + size] for b in u]
            if not low:
                self._dc(part, ah, al)
            else:
                self._ac([self.components[c][2][y, x] for c, y, x in part], low, high, ah, al)
            self.bits += [1] * (-len(self.bits) % 8)
            self.out.append(np.packbits(self.bits).tobytes().replace(b"\xff", b"\xff\x00"))

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def code(self, table, symbol):
        self.put(*table.codes[symbol])

    def _signed(self, v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    def _dc(self, blocks, ah, al):
        before = {}
        for c, y, x in blocks:
            v = int(self.components[c][2][y, x, 0]) >> al
            if ah:
                self.put(v & 1, 1)
                continue
            n, raw = self._signed(v - before.get(c, 0))
            before[c] = v
            self.code(self.dc, n)
            self.put(raw, n)

    def _ac(self, blocks, low, high, ah, al):
        run, waiting = 0, []

        def flush():
            nonlocal run, waiting
            if run:
                r = run.bit_length() - 1
                self.code(self.ac, r << 4)
                self.put(run - (1 << r), r)
                self.bits += waiting
                run, waiting = 0, []

        for block in blocks:
            values = [int(np.sign(v)) * (abs(int(v)) >> al) for v in block[low:high + 1]]
            fresh = [k for k, v in enumerate(values) if (abs(v) == 1 if ah else v)]
            last = fresh[-1] if fresh else -1
            zeros, corrections = 0, []
            if last >= 0:
                flush()
            for k, v in enumerate(values[:last + 1]):
                if ah and abs(v) > 1:
                    corrections.append(abs(v) & 1)
                elif not v:
                    zeros += 1
                    if zeros == 16:
                        self.code(self.ac, 0xF0)
                        self.bits += corrections
                        zeros, corrections = 0, []
                else:
                    n, raw = (1, int(v > 0)) if ah else self._signed(v)
                    self.code(self.ac, zeros << 4 | n)
                    self.put(raw, n)
                    self.bits += corrections
                    zeros, corrections = 0, []
            rest = values[last + 1:]
            corrections += [abs(v) & 1 for v in rest if ah and abs(v) > 1]
            if rest:
                run += 1
                waiting += corrections
                if run == 0x7FFF:
                    flush()
            else:
                self.bits += corrections
        flush()

    def finish(self):
        return b"".join([*self.out, b"\xff\xd9"])


def plain_samples(block, quant):
    """A block's samples by the definition of the transform."""
    natural = np.zeros(64)
    for k, position in enumerate(media._zigzag()):
        natural[position] = block[k] * quant
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    out[y, x] += scale * natural[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return np.clip(np.rint(out + 128), 0, 255)


def sparse(rng, rows, columns, scale):
    blocks = (rng.integers(-scale, scale + 1, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < 0.2)).astype(np.int16)
    blocks[..., 0] = rng.integers(-200, 200, (rows, columns))
    return blocks


SCRIPTS = {
    "bands": lambda n: [(list(range(n)), 0, 0, 0, 0), *(([c], a, b, 0, 0) for c in range(n) for a, b in ((1, 5), (6, 63)))],
    "steps": lambda n: [(list(range(n)), 0, 0, 0, 2), *(([c], 1, 63, 0, 2) for c in range(n)), (list(range(n)), 0, 0, 2, 1), *(([c], 1, 63, 2, 1) for c in range(n)), (list(range(n)), 0, 0, 1, 0), *(([c], 1, 63, 1, 0) for c in range(n))],
    "alone": lambda n: [*(([c], 0, 0, 0, 1) for c in range(n)), *(([c], 0, 0, 1, 0) for c in range(n)), *(([c], a, b, 0, 1) for c in range(n) for a, b in ((1, 2), (3, 63))), *(([c], 1, 63, 1, 0) for c in range(n))],
}


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize(("size", "factors"), [((21, 35), [(1, 1)]), ((40, 50), [(2, 2), (1, 1), (1, 1)]), ((17, 33), [(2, 1), (1, 1), (1, 1)]), ((16, 16), [(1, 1), (1, 1), (1, 1)])])
def test_scans_of_a_plain_encoder_accumulate(script, restart, size, factors):
    rng = np.random.default_rng(5)
    across, down = max(h for h, _ in factors), max(v for _, v in factors)
    wide, tall = -(-size[1] // (8 * across)), -(-size[0] // (8 * down))
    components = [(h, v, sparse(rng, tall * v, wide * h, 40)) for h, v in factors]
    plain = Plain(*size, components, quant=3, restart=restart)
    together = SCRIPTS[script](len(factors))
    for scan in together:
        plain.scan(*scan)
    image = media.decode(plain.finish())
    for i, (component, (_, _, blocks)) in enumerate(zip(image.components, components, strict=True)):
        rows, columns = plain.shown(i)
        np.testing.assert_array_equal(component.blocks[:rows, :columns], blocks[:rows, :columns])
    found = media.planes(image)[0][:8, :8]
    assert np.abs(found - plain_samples(components[0][2][0, 0], 3)).max() <= 1
    assert media.rgb(image).shape == (*size, 3)


def test_chroma_is_repeated_and_converted():
    components = [(2, 2, np.zeros((2, 2, 64), np.int16)), (1, 1, np.zeros((1, 1, 64), np.int16)), (1, 1, np.zeros((1, 1, 64), np.int16))]
    components[2][2][0, 0, 0] = 8 * 50
    plain = Plain(16, 16, components)
    for scan in SCRIPTS["bands"](3):
        plain.scan(*scan)
    pixels = media.rgb(media.decode(plain.finish()))
    expected = [128 + 1.402 * 50, 128 - 0.714136 * 50, 128]
    assert np.abs(pixels.reshape(-1, 3) - expected).max() <= 1


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7, 13, 100, 700])
def test_payloads_come_back(blocks):
    rng = np.random.default_rng(blocks)
    for data in (rng.integers(0, 256, 64 * blocks, np.uint8).tobytes(), bytes(64 * blocks), b"\xff" * 64 * blocks, b"plain text " * 6 * blocks):
        data = data[:64 * blocks]
        assert media.stored(media.store(data)) == data


def test_wrong_payloads_and_images_are_refused():
    for data in (b"", b"x" * 63):
        with pytest.raises(ValueError, match="multiple"):
            media.store(data)
    image = media.store(bytes(range(64)))
    for bad in (b"", image[:-2], image.replace(b"\xff\xc2", b"\xff\xc0"), b"GIF89a"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


def test_every_text_is_stored_whole(make_docs, corpus):
    docs = make_docs(corpus).repartition(3)
    found = {r.doc_id: r for r in media.features(media.tensors(media.store_texts(docs), payload=True)).collect()}
    for i, text in enumerate(corpus):
        raw = (text or "").encode()
        assert bytes(found[i].payload) == raw + bytes(64 - len(raw) % 64)
        assert found[i].n_bytes == len(raw)
        assert found[i].feature == media.feature(media.rgb(media.decode(bytes(found[i].media))))
    assert found[5].feature == found[6].feature
    assert media.features(media.tensors(media.store_texts(make_docs([])), payload=True)).collect() == []


def test_columns_named_like_those_added_are_replaced(spark):
    image = media.store(media.payload("words"))
    df = spark.createDataFrame([(1, image, "x", 2.0, "z", "f"), (2, None, "x", 2.0, "z", "f")], "height long, media binary, width string, rgb double, payload string, feature string")
    one, two = media.tensors(df, payload=True).collect()
    assert bytes(one.payload) == media.payload("words") and len(one.rgb) == one.height * one.width * 3 and one.feature == "f"
    assert (two.height, two.width, two.rgb, two.payload) == (None,) * 4
    assert [r.feature for r in media.features(media.tensors(df)).collect()] == [media.feature(media.rgb(media.decode(image))), None]


def test_the_general_scans_decode_what_the_short_cuts_decode(monkeypatch):
    raw = bytes(range(256)) * 5 + "words and words".encode()
    image = media.store(raw + bytes(64 - len(raw) % 64))
    short = media.rgb(media.decode(image))
    monkeypatch.setattr(media, "_short_cuts", False)
    assert (media.rgb(media.decode(image)) == short).all()


def test_tensors_are_columns(make_docs):
    rows = media.tensors(media.store_texts(make_docs([None, "some text " * 50])))
    for r in rows.collect():
        assert len(r.rgb) == r.height * r.width * 3
        whole = media.rgb(media.decode(bytes(r.media)))
        assert zlib.crc32(bytes(r.rgb)) == zlib.crc32(whole.tobytes())


def test_payloads_are_filled_up_to_a_multiple_and_no_further(spark, make_docs, tmp_path):
    texts = [None, "", "x" * 63, "x" * 64, "\u00e9" * 32, "x" * 65, "y" * 384, "z" * 385]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op3_media(spark, str(tmp_path)).collect()}
    assert [found[i].payload_bytes for i in range(8)] == [64, 64, 64, 64, 64, 128, 384, 448]
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(found[i].payload_bytes, b"\0")
        assert (found[i].n_bytes, found[i].payload_sha256, found[i].tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
