"""SHA-256 over many messages at once, with its state between blocks open to the caller.

A hex digest is 64 bytes, which is one SHA-256 block: the state after hashing the first
i children of a node is eight words that can be kept, copied and resumed from anywhere.
States are arrays (8, lanes) of uint32, blocks (16, lanes).
"""

from __future__ import annotations

import numpy as np

LANES = 2048  # worked on at a time, so that the schedule stays in the processor's cache


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_fraction(p: int, power: int) -> int:
    """First 32 bits of the fraction of p ** (1 / power), by whole numbers."""
    goal, low, high = p << (32 * power), 0, 1 << 40
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** power <= goal else (low, mid - 1)
    return low & 0xFFFFFFFF


INITIAL = np.array([_root_fraction(p, 2) for p in _primes(8)], dtype=np.uint32)
_ROUND = np.array([_root_fraction(p, 3) for p in _primes(64)], dtype=np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _step(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7]
                 + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(lanes: int) -> np.ndarray:
    return np.repeat(INITIAL[:, None], lanes, axis=1)


def resume(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States after one more block each."""
    out = np.empty_like(state)
    for i in range(0, state.shape[1], LANES):
        out[:, i:i + LANES] = _step(state[:, i:i + LANES], block[:, i:i + LANES])
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (8, lanes) of messages that ended after ``blocks`` whole blocks."""
    pad = np.zeros((16, state.shape[1]), dtype=np.uint32)
    pad[0] = 0x80000000
    pad[15] = blocks.astype(np.uint32) * np.uint32(512)
    return resume(state, pad)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The block (16, lanes) that holds a digest's 64 lowercase hex characters."""
    nibbles = np.arange(28, -4, -4, dtype=np.uint32)
    x = (digest[:, None, :] >> nibbles[None, :, None]) & np.uint32(15)
    x += np.uint32(48) + np.uint32(39) * (x > 9)
    x = x.reshape(16, 4, -1)
    return (x[:, 0] << np.uint32(24)) | (x[:, 1] << np.uint32(16)) | (x[:, 2] << np.uint32(8)) | x[:, 3]


def from_bytes(digests: bytes) -> np.ndarray:
    """(8, lanes) from 32-byte digests end to end."""
    return np.frombuffer(digests, dtype=">u4").astype(np.uint32).reshape(-1, 8).T.copy()


def to_bytes(state: np.ndarray) -> np.ndarray:
    """(lanes, 32) bytes."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)
