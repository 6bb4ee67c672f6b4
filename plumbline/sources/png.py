"""8-bit grey and RGB PNG in numpy and zlib, so that images need no native decoder on the executors."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_HEAD = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray) -> bytes:
    colour = 2 if image.ndim == 3 else 0
    h, w = image.shape[:2]
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, dtype=np.uint8))
    return _HEAD + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Levels (height, width, channels).  Anything else than an 8-bit, non-interlaced PNG is an error."""
    if not data or not data.startswith(_HEAD):
        raise ValueError("not a PNG")
    at, packed, head = len(_HEAD), b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if head is None or channels is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG without interlacing is read")
    w, h = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError) as e:
        raise ValueError("broken PNG") from e
    if not raw[:, 0].any():  # no line is filtered
        return raw[:, 1:].copy().reshape(h, w, channels)
    out = np.zeros((h, w * channels), dtype=np.uint8)
    before = np.zeros(w * channels, dtype=np.int32)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + before
        elif kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0).ravel()
        elif kind in (3, 4):
            line = line.copy()
            for x in range(w * channels):
                a = line[x - channels] if x >= channels else 0
                if kind == 3:
                    guess = (a + before[x]) // 2
                else:
                    c = before[x - channels] if x >= channels else 0
                    p = a + before[x] - c
                    guess = min((abs(p - a), 0, a), (abs(p - before[x]), 1, before[x]), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        before = line & 255
        out[y] = before
    return out.reshape(h, w, channels)


def decode_colour(data: bytes) -> np.ndarray:
    """RGB levels (height, width, 3); grey in each of the three."""
    pixels = decode(data)
    return pixels[:, :, :3] if pixels.shape[2] > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)


def decode_gray(data: bytes) -> np.ndarray:
    """Grey levels (height, width); colour is weighted."""
    pixels = decode(data)
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
