"""PNG and TIFF pages as grey arrays, from bytes: all bit depths, interlacing, several pages to a file.

What can't be read is a ValueError that says why. Sizes are checked against the
data before any array is made, so a damaged header can't ask for memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

GREY = np.array([0.299, 0.587, 0.114])
#: Pixels of a page beyond which it is an error: a sheet of A0 at 600 dpi has 560 million.
MOST_PIXELS = 600_000_000


def grey_of(px: np.ndarray) -> np.ndarray:
    """(h, w, bands) of bytes as grey; two bands are grey and alpha, four are colour and alpha; alpha is left out."""
    return np.ascontiguousarray(px[:, :, 0]) if px.shape[2] < 3 else np.rint(px[:, :, :3] @ GREY).astype(np.uint8)


def _bits(lines: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Lines of bytes as lines of values of 1, 2 or 4 bits, the high bits first."""
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return ((lines[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(len(lines), -1)[:, :width]


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def unfilter(raw: np.ndarray, unit: int) -> np.ndarray:
    """The bytes of PNG lines, each with its filter in front; unit is the bytes of a pixel, 1 at least.

    A byte of an Average or Paeth line needs its left, upper and upper left
    neighbours. Bytes on one diagonal don't need each other, so the page is
    turned so that diagonals are rows, and one numpy step makes a whole diagonal.
    """
    kinds, lines = raw[:, 0], raw[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise ValueError("damaged PNG: unknown filter")
    h, n = lines.shape
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((h + 1, n), np.uint8)
        for y in range(h):
            out[y + 1] = (lines[y].reshape(-1, unit).cumsum(0, dtype=np.uint8).ravel() if kinds[y] == 1 else lines[y]) + (out[y] if kinds[y] == 2 else 0)
        return out[1:]
    w = n // unit
    wide = np.zeros((h, w + h, unit), np.int16)
    wide[:, :w] = lines.reshape(h, w, unit)
    d, step = w + h - 1, wide.strides[1]
    turned = np.ascontiguousarray(np.lib.stride_tricks.as_strided(wide, (h, d, unit), ((w + h - 1) * step, step, wide.strides[2])).transpose(1, 0, 2))
    out = np.zeros((d + 2, h + 1, unit), np.int16)  # two diagonals and a line of zeros before the first
    sub, up, mean, paeth = ((kinds == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4))
    plain = not (sub.any() or up.any() or mean.any())
    for i in range(d):
        y0, y1 = max(0, i - w + 1), min(h, i + 1)
        a, b, c = out[i + 1, y0 + 1 : y1 + 1], out[i + 1, y0:y1], out[i, y0:y1]
        bc, ac = b - c, a - c
        pa, pb, pc = np.abs(bc), np.abs(ac), np.abs(bc + ac)
        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)) * paeth[y0:y1]
        if not plain:
            guess += sub[y0:y1] * a + up[y0:y1] * b + mean[y0:y1] * ((a + b) >> 1)
        out[i + 2, y0 + 1 : y1 + 1] = (turned[i, y0:y1] + guess) & 255
    flat = np.ascontiguousarray(out[2:, 1:].transpose(1, 0, 2))  # (h, d, unit), line y begins at diagonal y
    back = np.lib.stride_tricks.as_strided(flat, (h, w, unit), (flat.strides[0] + flat.strides[1], flat.strides[1], flat.strides[2]))
    return back.astype(np.uint8).reshape(h, n)


#: First line and column, and steps, of the seven passes of an interlaced PNG (fixed values).
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def decode_png(data: bytes) -> np.ndarray:
    """The grey page; 16-bit values keep their high byte."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    head, palette, body = b"", None, []
    for name, part in png_chunks(data):
        if name == b"IHDR":
            head = part
        elif name == b"PLTE":
            palette = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
    if len(head) != 13:
        raise ValueError("damaged PNG: no header")
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", head)
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind, 0)
    if not bands or depth not in {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(kind, (8, 16)) or lace > 1:
        raise ValueError(f"damaged PNG: colour type {kind} of {depth} bits")
    if not w or not h or w * h > MOST_PIXELS:
        raise ValueError(f"damaged PNG: {w} x {h} pixels")
    unit = max(1, bands * depth // 8)
    sub = [(y, x, dy, dx) for y, x, dy, dx in (PASSES if lace else ((0, 0, 1, 1),)) if y < h and x < w]
    sizes = [(-(-(h - y) // dy), -(-(w - x) // dx)) for y, x, dy, dx in sub]
    lengths = [sh * (1 + -(-sw * bands * depth // 8)) for sh, sw in sizes]
    try:
        raw = np.frombuffer((stream := zlib.decompressobj()).decompress(b"".join(body), sum(lengths)), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged PNG") from e
    if raw.size < sum(lengths):
        raise ValueError("short PNG" if stream.eof else "damaged PNG")
    out, at = np.zeros((h, w, bands), np.uint8), 0
    for (y, x, dy, dx), (sh, sw), n in zip(sub, sizes, lengths, strict=True):
        lines = unfilter(raw[at : at + n].reshape(sh, -1), unit)
        at += n
        if depth < 8:
            lines = _bits(lines, depth, sw)
            lines = lines if kind == 3 else lines * (255 // ((1 << depth) - 1))
        out[y::dy, x::dx] = (lines[:, ::2] if depth == 16 else lines).reshape(sh, sw, bands)
    if kind == 3:
        if palette is None or int(out.max()) >= len(palette):
            raise ValueError("damaged PNG: palette")
        out = palette[out[:, :, 0]]
    return grey_of(out)


@dataclass(frozen=True)
class TiffPage:
    tags: dict[int, tuple[float, ...]]

    def one(self, tag: int, otherwise: float) -> int:
        return int(self.tags.get(tag, (otherwise,))[0])

    @property
    def n_bytes(self) -> int:
        return int(sum(self.tags.get(279, ()) or self.tags.get(325, ())))

    @property
    def dpi(self) -> float | None:
        x = self.tags.get(282, (0.0,))[0] * {2: 1.0, 3: 2.54}.get(self.one(296, 2), 0.0)
        return x if round(x) > 72 else None


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def tiff_pages(read) -> tuple[str, list[TiffPage]]:  # noqa: ANN001
    """The byte order and the directories of a TIFF, by read(offset, n): a few small reads a page, whatever its size."""
    start = read(0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(start[:4]))
    if not order:
        raise ValueError("not a TIFF")
    pages, seen = [], set()
    try:
        at = struct.unpack(order + "I", start[4:8])[0]
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack(order + "H", read(at, 2))[0]
            body = read(at + 2, 12 * n + 4)
            tags = {}
            for i in range(n):
                tag, kind, count, own = struct.unpack(order + "HHI4s", body[12 * i : 12 * i + 12])
                size = _SIZES.get(kind, 0) * count
                if not size or size > 1 << 24 or kind in (2, 7):
                    continue
                raw = own[:size] if size <= 4 else read(struct.unpack(order + "I", own)[0], size)
                if kind in (5, 10):
                    parts = struct.unpack(order + f"{2 * count}{'I' if kind == 5 else 'i'}", raw)
                    tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True))
                else:
                    tags[tag] = struct.unpack(order + f"{count}{_CODES[kind]}", raw)
            pages.append(TiffPage(tags))
            at = struct.unpack(order + "I", body[12 * n : 12 * n + 4])[0]
    except struct.error as e:
        raise ValueError("damaged TIFF: directory") from e
    if not pages:
        raise ValueError("damaged TIFF: no page")
    return order, pages


def _packbits(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _lzw(data: bytes, most: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the high bits first; 256 clears the table, 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    first = len(table)
    out, size, last, held, bits = [], 0, None, 0, 9
    n_held = 0
    for byte in data:
        held, n_held = (held << 8) | byte, n_held + 8
        if n_held < bits:
            continue
        n_held -= bits
        code = held >> n_held
        held &= (1 << n_held) - 1
        if code == 257:
            break
        if code == 256:
            del table[first:]
            bits, last = 9, None
            continue
        if code < len(table):
            own = table[code]
        elif last is not None and code == len(table):
            own = last + last[:1]
        else:
            raise ValueError("damaged TIFF: LZW code")
        out.append(own)
        size += len(own)
        if size >= most:
            break
        if last is not None:
            table.append(last + own[:1])
        last = own
        bits = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def _unpacked(data: bytes, method: int, most: int) -> bytes:
    if method == 1:
        return data[:most]
    if method == 32773:
        return _packbits(data, most)
    if method == 5:
        return _lzw(data, most)
    if method in (8, 32946):
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error as e:
            raise ValueError("damaged TIFF") from e
    raise ValueError(f"unsupported TIFF: compression {method}")


def decode_tiff(page: TiffPage, read, order: str) -> np.ndarray:  # noqa: ANN001
    """The grey page: strips or tiles of 1, 4, 8 or 16 bits, one or more interleaved bands."""
    w, h, bands, depth = page.one(256, 0), page.one(257, 0), page.one(277, 1), page.one(258, 1)
    method, kind = page.one(259, 1), page.one(262, 1)
    if w < 1 or h < 1 or w * h > MOST_PIXELS:
        raise ValueError(f"damaged TIFF: {w} x {h} pixels")
    if depth not in (1, 4, 8, 16) or depth < 8 and bands > 1 or kind not in (0, 1, 2, 3) or bands > 1 and page.one(284, 1) != 1 or kind == 2 and bands < 3:
        raise ValueError(f"unsupported TIFF: {bands} bands of {depth} bits, colours {kind}")
    tiled = 322 in page.tags
    tw, th = (page.one(322, w), page.one(323, h)) if tiled else (w, min(h, page.one(278, h)))
    starts, counts = (page.tags.get(t, ()) for t in ((324, 325) if tiled else (273, 279)))
    if tw < 1 or th < 1 or tw * th > MOST_PIXELS:
        raise ValueError("damaged TIFF: tiles")
    across, down = -(-w // tw), -(-h // th)
    if len(starts) < across * down or len(counts) < across * down:
        raise ValueError("damaged TIFF: strips")
    line = -(-tw * bands * depth // 8)
    out = np.zeros((h, w, bands), np.uint16 if depth == 16 else np.uint8)
    for i in range(across * down):
        y, x = i // across * th, i % across * tw
        rows = th if tiled else min(th, h - y)
        raw = np.frombuffer(_unpacked(read(int(starts[i]), int(counts[i])), method, rows * line), np.uint8)
        if raw.size < rows * line:
            raise ValueError("short TIFF")
        lines = raw[: rows * line].reshape(rows, line)
        if depth == 16:
            own = lines.view(order + "u2").reshape(rows, tw, bands).astype(np.uint16)
        else:
            own = (_bits(lines, depth, tw) if depth < 8 else lines).reshape(rows, tw, bands)
        if page.one(317, 1) == 2 and depth >= 8:  # neighbours' differences
            own = own.cumsum(axis=1, dtype=own.dtype)
        own = own[: h - y, : w - x]
        out[y : y + own.shape[0], x : x + own.shape[1]] = own
    if kind == 3:
        table = np.array(page.tags.get(320, ()), np.int64)
        if depth > 8 or table.size != 3 << depth:
            raise ValueError("damaged TIFF: palette")
        return grey_of((table.reshape(3, -1) >> 8).astype(np.uint8).T[out[:, :, 0]])
    px = (out >> 8).astype(np.uint8) if depth == 16 else out * (255 // ((1 << depth) - 1)) if depth < 8 else out
    return grey_of(255 - px if kind == 0 else px)
