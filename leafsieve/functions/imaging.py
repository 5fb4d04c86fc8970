"""Digests of pictures: true size, a difference fingerprint, and whether they are flat.

A small decoder reads PNG, PPM/PGM and BMP files, and Pillow the others where it is installed; anything
else is a page with an error. Pictures are made smaller by separable filters in fixed point, 8 bits
a value and pass, which is how imaging libraries do it, so fingerprints agree with theirs.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import struct
import zlib
from importlib import metadata

import numpy as np

#: Columns of the grid that is compared, less one, and the deviation below which a picture is flat. Fixed values.
GRID, FLAT_DEVIATION = 8, 6.0
#: Grey levels by which a pixel must differ to count as changed.
CHANGED = 16


#: First column and row and the steps of the passes of an interlaced PNG.
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class DecodeError(ValueError):
    """A picture that can't be read."""


def _png(data: bytes) -> np.ndarray:
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8)
    pixels, at = np.zeros((height, width, channels), dtype=np.uint8), 0
    for x, y, dx, dy in _ADAM7 if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * channels * depth + 7) // 8
        rows = _unfiltered(raw[at : at + h * (1 + stride)].reshape(h, 1 + stride), max(1, channels * depth // 8))
        at += h * (1 + stride)
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            rows = np.unpackbits(rows, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1])
            rows = rows[:, :w] * (1 if colour == 3 else 255 // ((1 << depth) - 1))
        pixels[y::dy, x::dx] = rows.reshape(h, w, channels)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]]
    elif colour in (4, 6):
        pixels = pixels[:, :, :-1]
    return pixels


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; ``step`` bytes are a pixel."""
    height, stride = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((height, stride), dtype=np.uint8)
    before = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            row += before
        elif kind in (1, 3, 4):
            # These go from pixel to pixel, all bytes of a pixel at once.
            row2, up = row.reshape(-1, step).astype(np.int32), before.reshape(-1, step).astype(np.int32)
            left, corner = np.zeros(step, dtype=np.int32), np.zeros(step, dtype=np.int32)
            for x in range(len(row2)):
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                row2[x] = (row2[x] + guess) & 255
                left, corner = row2[x], up[x]
            row = row2.reshape(-1).astype(np.uint8)
        out[y] = before = row
    return out


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        line = data[at : at + 1]
        if line.isspace():
            at += 1
        elif line == b"#":
            at = data.index(b"\n", at) + 1
        else:
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
    width, height, most = fields
    channels = 3 if data[1:2] == b"6" else 1
    if most != 255:
        raise DecodeError("a picture of another depth than 8")
    return np.frombuffer(data[at + 1 :], dtype=np.uint8, count=width * height * channels).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack("<I", data[10:14])
    width, height, _, depth, packed = struct.unpack("<iiHHI", data[18:34])
    if depth != 24 or packed:
        raise DecodeError("a BMP of another depth than 24, or packed")
    stride = (3 * width + 3) // 4 * 4
    rows = np.frombuffer(data[start:], dtype=np.uint8, count=stride * abs(height)).reshape(abs(height), stride)[:, : 3 * width]
    pixels = rows.reshape(abs(height), width, 3)[:, :, ::-1]
    return pixels[::-1] if height > 0 else pixels


#: What can add kinds of pictures when it is installed, and a number that grows when the own decoders do.
_DECODERS, _OWN = ("pillow", "pillow-heif", "pillow-avif-plugin", "pillow-jxl-plugin"), 2


def codec_fingerprint() -> str:
    """16 digits that change when pictures are decoded by others than before, as the installed packages tell."""
    versions: dict[str, str | int] = {"own": _OWN}
    for name in _DECODERS:
        with contextlib.suppress(metadata.PackageNotFoundError):
            versions[name] = metadata.version(name)
    return hashlib.blake2b(repr(versions).encode(), digest_size=8).hexdigest()


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 1 or 3), 8 bits each."""
    own = _png if data.startswith(b"\x89PNG") else _netpbm if data[:2] in (b"P5", b"P6") else _bmp if data[:2] == b"BM" else None
    failure: Exception = DecodeError("no decoder for this kind of picture")
    if own:
        try:
            return own(data)
        except Exception as refused:
            failure = refused
    try:
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except ImportError:
        pass
    except Exception as refused:
        failure = refused
    if isinstance(failure, DecodeError):
        raise failure
    raise DecodeError(f"could not decode image: {failure}") from failure


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of pixels, by the weights of ITU-R 601 in 16 bits, rounded."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.int64)
    return (pixels.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


#: Filters by their reach: bilinear, and Lanczos of three lobes.
BILINEAR, LANCZOS = (_triangle, 1.0), (_lanczos, 3.0)
#: Bits behind the point of a filter's weights.
POINT = 22


def _weights(size: int, cells: int, kind) -> np.ndarray:
    """(cells, size): the weight of each pixel of a side in each of ``cells`` new ones, in fixed point."""
    curve, reach = kind
    scale = size / cells
    stretch = max(scale, 1.0)
    centre = (np.arange(cells)[:, None] + 0.5) * scale
    low = np.maximum((centre - reach * stretch + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + reach * stretch + 0.5).astype(np.int64), size)
    place = np.arange(size)
    weight = np.where((place >= low) & (place < high), curve((place - centre + 0.5) / stretch), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.trunc(weight * (1 << POINT) + np.where(weight < 0, -0.5, 0.5)).astype(np.int64)


def shrink(values: np.ndarray, width: int, height: int, kind=LANCZOS) -> np.ndarray:
    """A plane of whole numbers from 0 to 255 in another size, first along rows, then along columns."""
    for side in (width, height):
        if values.shape[1] != side:
            # Sums stay far below 2^53, so they are whole numbers also as floats, which are multiplied much faster.
            sums = (values.astype(np.float64) @ _weights(values.shape[1], side, kind).T.astype(np.float64)).astype(np.int64)
            values = np.clip((sums + (1 << POINT - 1)) >> POINT, 0, 255)
        values = values.T
    return values


def fingerprint(pixels: np.ndarray) -> tuple[int, bool]:
    """Whether each cell of a 9 by 8 grid is darker than the next, as 64 bits, the first highest; and whether the picture is flat."""
    luma = grey(pixels)
    small = shrink(luma, GRID + 1, GRID)
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    flat = float(shrink(luma, 32, 32, BILINEAR).std()) < FLAT_DEVIATION
    return int.from_bytes(np.packbits(bits).tobytes(), "big"), flat


def difference(one: bytes, other: bytes) -> float:
    """The share of pixels that differ by more than CHANGED grey levels; the other picture is brought to the size of the one."""
    return difference_of(grey(decode(one)), grey(decode(other)))


def difference_of(a: np.ndarray, b: np.ndarray) -> float:
    """:func:`difference` of planes of grey values."""
    return float((np.abs(a - shrink(b, a.shape[1], a.shape[0], BILINEAR)) > CHANGED).mean())


def thumbnail(data: bytes, side: int = 256) -> bytes:
    """The picture as PNG, at most ``side`` pixels long."""
    pixels = decode(data)
    height, width = pixels.shape[:2]
    scale = min(1.0, side / max(height, width))
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    planes = [shrink(pixels[:, :, c].astype(np.int64), w, h).astype(np.uint8) for c in range(pixels.shape[2])]
    return encode_png(np.stack(planes * (3 // len(planes)), axis=2))


def encode_png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    raw = np.concatenate((np.zeros((height, 1), dtype=np.uint8), pixels.reshape(height, -1)), axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def digest(data: bytes | None) -> tuple[int, int, int, bool, str | None]:
    """(width, height, fingerprint as a signed number, flat, error) of a picture; one that can't be decoded has an error and zeros."""
    try:
        if data is None:
            raise DecodeError("could not be read")
        pixels = decode(data)
        bits, flat = fingerprint(pixels)
    except DecodeError as failure:
        return 0, 0, 0, False, str(failure)
    return pixels.shape[1], pixels.shape[0], bits - (1 << 64) if bits >> 63 else bits, flat, None
