"""Generators: the affine mask stream (with its closed form), multiply-with-carry chunk order, and two program seeds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from vaultlens.codecs.errors import MalformedError

M32 = 0xFFFFFFFF
#: Fixed seed of name and offset masks.
MASK_SEED = 0x75D6EE39


def mask_state(n: int, seed: int = MASK_SEED) -> int:
    """The n-th state (n >= 0) of s' = 5 s + seed from 0: seed * (5**n - 1) / 4 modulo 2**32."""
    return seed * ((pow(5, n, 1 << 34) - 1) // 4) & M32


def mask_states(first: int, count: int, seed: int = MASK_SEED) -> np.ndarray:
    """States first .. first + count - 1, without stepping through them."""
    if not count:
        return np.zeros(0, np.uint64)
    powers = np.full(count, 5, np.uint64)
    powers[0] = pow(5, first, 1 << 64)
    powers = np.cumprod(powers, dtype=np.uint64) & np.uint64((1 << 34) - 1)
    return (powers - np.uint64(1)) // np.uint64(4) * np.uint64(seed & M32) & np.uint64(M32)


def mask_states_at(places: np.ndarray, seed: int = MASK_SEED) -> np.ndarray:
    """The states at any places (0 or more), by squaring: 5**n from the bits of n."""
    n, power, square = np.asarray(places, np.uint64).copy(), np.ones(len(places), np.uint64), 5
    while n.any():
        power *= np.where(n & np.uint64(1), np.uint64(square), np.uint64(1))
        n >>= np.uint64(1)
        square = square * square % (1 << 64)
    return ((power & np.uint64((1 << 34) - 1)) - np.uint64(1)) // np.uint64(4) * np.uint64(seed & M32) & np.uint64(M32)


def signed32(x: int) -> int:
    return x - (1 << 32) if x & 0x80000000 else x


def mask_bytes(data: bytes, first: int, seed: int = MASK_SEED) -> bytes:
    """data XORed with the low bytes of states first, first + 1, ...; its own inverse."""
    keys = mask_states(first, len(data), seed).astype(np.uint8)
    return (np.frombuffer(data, np.uint8) ^ keys).tobytes()


class CarryStream:
    """Multiply-with-carry of lag four, seeded by a xorshift and warmed up by 19 steps."""

    #: Factors of the last four outputs, oldest last.
    FACTORS = (5115, 1776, 1492, 2111111111)

    def __init__(self, seed: int):
        x, lags = seed or M32, []
        for _ in range(5):
            x ^= x << 13 & M32
            x ^= x >> 17
            x ^= x << 5 & M32
            lags.append(x)
        self.lags, self.carry = lags[:4], lags[4]
        for _ in range(19):
            self.next()

    def next(self) -> int:
        total = sum(f * s for f, s in zip(self.FACTORS, self.lags, strict=True)) + self.carry
        self.carry = total >> 32
        self.lags = [total & M32, *self.lags[:3]]
        return self.lags[0]

    def below(self, n: int) -> int:
        return int(self.next() / (1 << 32) * n)


def chunk_order(count: int, seed: int) -> list[int]:
    """Where chunk k of the original lies among the scrambled ones; the last stays last."""
    stream, free, place = CarryStream(seed), list(range(count)), [0] * count
    for k in range(count):
        left = len(free)
        place[free.pop(stream.below(left - 1) if left > 1 else 0)] = k
    return place


SEED_MASK = 0xF8EA


def _chunks(body: bytes, size: int) -> list[slice]:
    return [slice(i, min(i + size, len(body))) for i in range(0, len(body), size)]


def unscramble(data: bytes) -> bytes:
    """Undo scramble(); the header is the chunk size (signed) and the raw seed."""
    if len(data) < 8:
        raise MalformedError("scrambled data has at least 8 bytes")
    size = signed32(int.from_bytes(data[:4], "little"))
    if size <= 0:
        raise MalformedError(f"chunk size {size}")
    body = data[8:]
    parts = _chunks(body, size)
    return b"".join(body[parts[k]] for k in chunk_order(len(parts), int.from_bytes(data[4:8], "little") ^ SEED_MASK))


def scramble(data: bytes, size: int, raw_seed: int = 0) -> bytes:
    if size <= 0:
        raise MalformedError(f"chunk size {size}")
    parts = _chunks(data, size)
    mixed: list[bytes] = [b""] * len(parts)
    for part, place in zip(parts, chunk_order(len(parts), (raw_seed & M32) ^ SEED_MASK), strict=True):
        mixed[place] = data[part]
    return size.to_bytes(4, "little") + (raw_seed & M32).to_bytes(4, "little") + b"".join(mixed)


def permutation(count: int, key: int) -> list[int]:
    """Draw without replacement by the mask stream of seed key, each state modulo what is left."""
    free = list(range(count))
    return [free.pop(int(s) % len(free)) for s in mask_states(1, count, key)]


def program_lcg(seed: int) -> Callable[[], int]:
    state = seed

    def draw() -> int:
        nonlocal state
        old, state = state, (state * 1103515245 + 12345) & M32
        return (state ^ old << 16 ^ old >> 16) & M32

    return draw


def program_xorshift(seed: int, extra: int) -> Callable[[], int]:
    a, b = seed, extra

    def draw() -> int:
        nonlocal a, b
        a = (a ^ a << 17) & M32
        a = ~(a ^ (a << 18 & M32 | a >> 15)) & M32
        b = (b ^ b << 13) & M32
        b ^= b >> 17
        b = (b ^ b << 5) & M32
        return a ^ b

    return draw
