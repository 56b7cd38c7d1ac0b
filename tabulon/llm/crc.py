"""CRC-32 of many byte spans at once, with array operations."""

from __future__ import annotations

import zlib

import numpy as np

#: Spans longer than this are taken one by one, by the library.
LONG = 64


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


_TABLE = _table()
_ALL = np.uint32(0xFFFFFFFF)


def extend_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC of what gave each ``crc``, followed by one byte."""
    state = crc ^ _ALL
    return (_TABLE[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8))) ^ _ALL


def extend(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC of what gave each ``crc`` (0: nothing), followed by ``data[start:end]``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG, "left"))
    out = np.array(crc, np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(out[i]))
    order = order[long:]
    state, at, size = out[order] ^ _ALL, start[order], size[order]
    live = len(order)
    for j in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -j, "left"))
        own = state[:live]
        state[:live] = _TABLE[(own ^ data[at[:live] + j]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out[order] = state ^ _ALL
    return out
