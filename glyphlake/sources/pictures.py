"""Grey pictures as bytes: PNG read and written, and the way a photo is to be turned, in Arrow tasks on zlib and numpy.

PNG: grey, grey with alpha, RGB, RGBA and palette, 8 bits a channel (grey and palette also 1, 2, 4), not interlaced; colours
become grey by (299 r + 587 g + 114 b) / 1000, alpha is dropped. Written PNGs are 8-bit grey. The turn is the orientation
tag of EXIF in a PNG's eXIf chunk or a JPEG's APP1 segment (JPEG pixels aren't decoded).

A null, broken or unsupported picture has null pixels and a reason; a picture without a tag stands upright.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ORIENTATION = 0x0112
#: Most pixels of a picture (a task holds one).
PIXELS = 1 << 28


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut short")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("cut short")


def unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """(height, stride) bytes of a PNG's filtered rows; step: bytes from a pixel to the next."""
    rows = np.frombuffer(raw, np.uint8)
    if len(rows) < height * (stride + 1):
        raise ValueError("cut short")
    rows = rows[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)
    for y in range(height):
        kind, line, above = int(rows[y, 0]), rows[y, 1:], out[y]
        now = out[y + 1]
        if kind == 0:
            now[step:] = line
        elif kind == 2:
            now[step:] = line + above[step:]
        elif kind == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = line
            now[step:] = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind in (3, 4):
            # each byte needs the one before
            got, up, new = bytearray(step), above.tolist(), line.tolist()
            for i, v in enumerate(new):
                a, b, c = got[i], up[i + step], up[i]
                if kind == 3:
                    got.append((v + (a + b) // 2) & 255)
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    got.append((v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255)
            now[:] = np.frombuffer(bytes(got), np.uint8)
        else:
            raise ValueError(f"row filter {kind}")
    return out[1:, step:]


def decoded(data: bytes) -> np.ndarray:
    """Grey pixels of a PNG."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    head = palette = None
    body = []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, woven = head
    if woven or colour not in CHANNELS or not (depth == 8 or depth < 8 and colour in (0, 3)) or not 0 < width * height <= PIXELS:
        raise ValueError("unsupported")
    channels = CHANNELS[colour]
    rows = unfiltered(zlib.decompress(b"".join(body)), height, -(-width * channels * depth // 8), max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        if colour == 0:
            rows = (rows * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rows = rows.reshape(height, width, channels)
    if colour == 3:
        if palette is None or rows.max(initial=0) >= len(palette):
            raise ValueError("no palette")
        rows = palette[rows[:, :, 0]]
    if rows.shape[2] < 3:
        return np.ascontiguousarray(rows[:, :, 0])
    return ((rows[:, :, :3].astype(np.int64) @ np.array([299, 587, 114])) // 1000).astype(np.uint8)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(page: np.ndarray, turn: int | None = None) -> bytes:
    """An 8-bit grey PNG; rows are stored as differences from the row above. `turn` is written as the EXIF tag."""
    height, width = page.shape
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = 2
    rows[:, 1:] = page
    rows[1:, 1:] -= page[:-1]
    tag = _chunk(b"eXIf", struct.pack("<2sHIHHHIHHI", b"II", 42, 8, 1, ORIENTATION, 3, 1, turn, 0, 0)) if turn else b""
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + tag + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _tag(exif: bytes) -> int:
    end = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if end is None or len(exif) < 8:
        return 1
    (at,) = struct.unpack(end + "I", exif[4:8])
    if at + 2 > len(exif):
        return 1
    (n,) = struct.unpack(end + "H", exif[at : at + 2])
    for k in range(n):
        entry = exif[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(end + "H", entry[:2])[0] == ORIENTATION:
            value = struct.unpack(end + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def turn_of(data: bytes) -> int:
    """The orientation tag, 1 to 8; 1 without one."""
    if data.startswith(SIGNATURE):
        try:
            return next((_tag(part) for kind, part in chunks(data) if kind == b"eXIf"), 1)
        except ValueError:
            return 1
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tag(data[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


#: What each tag asks for.
UPRIGHT = {1: lambda p: p, 2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.T, 6: lambda p: p.T[:, ::-1], 7: lambda p: p[::-1, ::-1].T, 8: lambda p: p.T[::-1]}


#: What a picture that can't be read raises.
FAULTS = (ValueError, struct.error, zlib.error)


def upright(data: bytes | None) -> tuple[int, np.ndarray]:
    """A picture's turn and its grey pixels, turned upright."""
    if data is None:
        raise ValueError("nothing")
    turn = turn_of(data)
    return turn, UPRIGHT[turn](decoded(data))


def read(files: DataFrame) -> DataFrame:
    """files(page, content) -> page, turn, h, w, pix (upright, grey), fault. One picture at a time."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for page, data in zip(p["page"], p["content"], strict=True):
                turn = h = w = pix = fault = None
                try:
                    turn = turn_of(data) if data is not None else None
                    _, grey = upright(data)
                    (h, w), pix = grey.shape, grey.tobytes()
                except FAULTS as e:
                    fault = str(e)[:80]
                yield pd.DataFrame({"page": [page], "turn": pd.Series([turn], dtype="Int32"), "h": pd.Series([h], dtype="Int32"), "w": pd.Series([w], dtype="Int32"), "pix": [pix], "fault": [fault]})

    kind = files.schema["page"].dataType.simpleString()
    return files.select("page", "content").mapInPandas(each, f"page {kind}, turn int, h int, w int, pix binary, fault string")


def write(pages: DataFrame, turn: str | None = None) -> DataFrame:
    """pages(page, h, w, pix) -> page, content: PNGs, with the turn of a column if one is named."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for x in p.itertuples(index=False):
                yield pd.DataFrame({"page": [x.page], "content": [encoded(np.frombuffer(x.pix, np.uint8).reshape(x.h, x.w), int(x.turn) if turn else None)]})

    kind = pages.schema["page"].dataType.simpleString()
    more = [F.col(turn).alias("turn")] if turn else []
    return pages.select("page", "h", "w", "pix", *more).mapInPandas(each, f"page {kind}, content binary")

