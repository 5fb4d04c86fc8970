import struct
import sys
import types
import zlib

import numpy as np
import pytest

from leafsieve.functions.imaging import decode

ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png(values, depth, interlaced):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b""
    for x, y, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        for row in values[y::dy, x::dx]:
            bits = "".join(f"{v:0{depth}b}" for v in row)
            bits += "0" * (-len(bits) % 8)
            raw += (b"\0" + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))) if bits else b""
    head = struct.pack(">IIBBBBB", values.shape[1], values.shape[0], depth, 0, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("shape", [(13, 11), (1, 1), (3, 2)])
def test_depths_and_interlacing(depth, interlaced, shape):
    values = np.random.default_rng(depth).integers(0, 1 << depth, shape)
    want = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)
    assert (decode(png(values, depth, interlaced))[:, :, 0] == want).all()


def test_pillow_reads_what_the_own_decoder_refuses(monkeypatch):
    picture = types.SimpleNamespace(convert=lambda mode: np.full((2, 3, 3), 7, dtype=np.uint8))
    pil = types.ModuleType("PIL")
    pil.Image = types.SimpleNamespace(open=lambda file: picture)
    monkeypatch.setitem(sys.modules, "PIL", pil)
    assert decode(b"P5 3 2 15\n" + bytes(6)).shape == (2, 3, 3)
