"""SHA-256 with its chaining states in the open, for many messages at once.

A digest written as hex text is 64 bytes, exactly one block of the hash. A node over such
digests is therefore a chain of whole blocks, and the state before each child is eight words
that can be stored in a table and resumed later, which a library's hash object cannot.
Every function works on arrays with one row per message.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK = 64
_MASK = np.uint64(0xFFFFFFFF)


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


# The first 32 bits of the fractions of square and cube roots of primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint16)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def resume(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one further block each (n, 16), all as 32-bit words."""
    w = [np.ascontiguousarray(blocks[:, i]) for i in range(16)]
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(states[:, i]) for i in range(8))
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[t % 16] = (
                w[t % 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[(t - 7) % 16]
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[t] + w[t % 16]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def start(n: int) -> np.ndarray:
    return np.tile(START, (n, 1))


def finish(states: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages of whole blocks, from the states after their last block."""
    closing = np.zeros((len(states), 16), np.uint32)
    bits = n_blocks.astype(np.uint64) * np.uint64(8 * BLOCK)
    closing[:, 0] = 0x80000000
    closing[:, 14], closing[:, 15] = bits >> np.uint64(32), bits & _MASK
    return resume(states, closing)


def words(data: bytes | np.ndarray, width: int) -> np.ndarray:
    """Bytes as rows of ``width`` big-endian words."""
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, width)


def as_bytes(rows: np.ndarray) -> bytes:
    return rows.astype(">u4").tobytes()


def hex_text(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the bytes of their hex text (n, 64)."""
    return HEX[np.frombuffer(as_bytes(digests), np.uint8)].view(np.uint8).reshape(-1, BLOCK)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the blocks (n, 16) their hex text makes."""
    return words(hex_text(digests).tobytes(), 16)
