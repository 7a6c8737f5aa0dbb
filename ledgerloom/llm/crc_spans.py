"""CRC-32 of many spans of one byte array, from a table of what each byte adds at each place.

A CRC without its constants is linear: the sum (XOR) of what each byte adds, which depends on the byte and
on how many bytes follow. The constants add a word that depends on the length alone.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

# Places of the table: bytes further from a span's end than this are folded in by blocks.
PLACES = 128
# Bytes of spans that are looked up together.
GATHER = 1 << 20


def _pure(data: bytes) -> int:
    """The linear part of a CRC: that of a message of zeros of the same length taken out."""
    return zlib.crc32(data) ^ zlib.crc32(bytes(len(data)))


@cache
def place_table() -> np.ndarray:
    """place_table()[d * 256 + b]: what byte b adds with d bytes after it."""
    out = np.zeros((PLACES, 256), np.uint32)
    out[0] = [_pure(bytes([b])) for b in range(256)]
    for d in range(1, PLACES):
        # One more zero byte after it moves the register on by eight bits.
        out[d] = (out[d - 1] >> np.uint32(8)) ^ out[0][out[d - 1] & np.uint32(255)]
    return out.ravel()


@cache
def _moved_on(level: int) -> np.ndarray:
    """[4, 256]: a register's four bytes each moved on by PLACES * 2**level zero bytes."""
    if level:
        table = _moved_on(level - 1)
        return np.stack([_move(table, row) for row in table])
    flat = place_table().reshape(PLACES, 256)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(PLACES):
            register = (register >> np.uint32(8)) ^ flat[0][register & np.uint32(255)]
        out[k] = register
    return out


def _move(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    moved = table[0][register & np.uint32(255)]
    for k in range(1, 4):
        moved = moved ^ table[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return moved


@cache
def _short_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(1 << 12)], np.uint32)


def length_constants(size: np.ndarray) -> np.ndarray:
    """The CRC-32 of so many zero bytes."""
    known = _short_constants()
    out = known[np.minimum(size, len(known) - 1)]
    for k in np.flatnonzero(size >= len(known)).tolist():
        crc, left = 0, int(size[k])
        while left:
            crc, left = zlib.crc32(bytes(min(left, 1 << 20)), crc), left - min(left, 1 << 20)
        out[k] = crc
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for every range, one after another."""
    step = begin - np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.repeat(step, size) + np.arange(int(size.sum()))


def _block_sums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The XOR of what the bytes of each span of 1 to PLACES bytes add, by one reduceat."""
    size = end - begin
    out = np.empty(len(begin), np.uint32)
    table = place_table()
    total = np.cumsum(size)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + GATHER, "right")))
        n = size[a:b]
        at = np.cumsum(n) - n
        local = np.arange(int(n.sum()), dtype=np.int32)
        index = local + np.repeat((begin[a:b] - at).astype(np.int64), n)
        place = np.repeat((at + n - 1).astype(np.int32), n) - local
        out[a:b] = np.bitwise_xor.reduceat(table[(place << 8) | data[index]], at)
        a = b
    return out


def span_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[begin:end] for every span; spans have a byte or more.

    A long span is cut into blocks of ``PLACES`` bytes from its end. Neighbouring blocks are folded by
    moving the first on by the length of the second, until one is left.
    """
    size = end - begin
    blocks = -(-size // PLACES)
    if not len(size) or blocks.max() == 1:
        return (_block_sums(data, begin, end) if len(size) else np.zeros(0, np.uint32)) ^ (
            length_constants(size))
    # Blocks of a span stand in order from its end.
    number = _ranges(np.zeros(len(size), np.int64), blocks)
    block_end = np.repeat(end, blocks) - number * PLACES
    sums = _block_sums(data, np.maximum(np.repeat(begin, blocks), block_end - PLACES), block_end)
    level = 0
    while blocks.max() > 1:
        first = np.cumsum(blocks) - blocks
        fewer = (blocks + 1) // 2
        number = _ranges(np.zeros(len(size), np.int64), fewer)
        low = np.repeat(first, fewer) + 2 * number
        has_high = 2 * number + 1 < np.repeat(blocks, fewer)
        high = np.where(has_high, sums[np.minimum(low + 1, len(sums) - 1)], np.uint32(0))
        sums, blocks, level = sums[low] ^ _move(_moved_on(level), high), fewer, level + 1
    return sums ^ length_constants(size)
