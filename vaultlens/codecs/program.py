"""The program cipher: a generated register program turns a member's checksum into three XOR keys.

A program is compiled once to a list of closures over four 32-bit registers
and a stack, for each of the 128 seeds, and kept per worker.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.prng import M32, program_lcg, program_xorshift

SIGNATURE = b" Encryption control block"
BLOCK_WORDS = 1024
#: Most bytes of machine code that a program may stand for.
CODE_LIMIT = 0x80


def control_block(plugin: bytes) -> tuple[int, ...] | None:
    """The 1,024 words that begin at the signature, inverted; None without it."""
    at = plugin.find(SIGNATURE)
    if at < 0 or at + 4 * BLOCK_WORDS > len(plugin):
        return None
    return tuple((~np.frombuffer(plugin, "<u4", BLOCK_WORDS, at)).tolist())


class Machine:
    """Registers a (result), b, c and the argument d."""

    __slots__ = ("a", "b", "c", "d", "stack", "block")

    def __init__(self, argument: int, block: tuple[int, ...]):
        self.a = self.b = self.c = 0
        self.d, self.stack, self.block = argument & M32, [], block

    def push(self, name: str) -> None:
        self.stack.append(getattr(self, name))

    def pop(self, name: str) -> None:
        if not self.stack:
            raise MalformedError("the program pops an empty stack")
        setattr(self, name, self.stack.pop())

    def fetch(self) -> None:
        if self.a >= len(self.block):
            raise MalformedError(f"word {self.a} of a block of {len(self.block)}")
        self.a = ~self.block[self.a] & M32


Step = Callable[[Machine], None]


def _set(name: str, value: Callable[[Machine], int]) -> Step:
    return lambda m: setattr(m, name, value(m) & M32)


class TooLong(Exception):
    pass


class Program:
    """Steps, and the machine code bytes that they take."""

    def __init__(self, draw: Callable[[], int]):
        self.draw, self.steps, self.size = draw, [], 0

    def add(self, size: int, step: Step | None = None) -> None:
        if self.size + size > CODE_LIMIT:
            raise TooLong
        self.size += size
        if step:
            self.steps.append(step)

    def clear(self) -> None:
        self.steps, self.size = [], 0

    def run(self, argument: int, block: tuple[int, ...]) -> int:
        m = Machine(argument, block)
        for step in self.steps:
            step(m)
        if m.stack:
            raise MalformedError("the program leaves values on its stack")
        return m.a


class Generator:
    """Writes programs: a binary tree of values (leaves), joined and changed by random operations."""

    def __init__(self, leaf_order, join_order, change_order):
        self.leaf_order, self.join_order, self.change_order = leaf_order, join_order, change_order

    def program(self, draw: Callable[[], int]) -> Program:
        """The deepest of five depths that fits; the draws of those that don't are not taken back."""
        p = Program(draw)
        for depth in range(5, 0, -1):
            try:
                p.add(5)
                p.add(4)
                self.value(p, depth)
                p.add(5)
                p.add(1)
                return p
            except TooLong:
                p.clear()
        raise MalformedError("no program fits")

    def either(self, p: Program, depth: int) -> None:
        (self.value if p.draw() & 1 else self.changed)(p, depth)

    def value(self, p: Program, depth: int) -> None:
        if depth == 1:
            return self.leaf(p)
        p.add(1, lambda m: m.push("b"))
        self.either(p, depth - 1)
        p.add(2, _set("b", lambda m: m.a))
        self.either(p, depth - 1)
        self.join(p)
        p.add(1, lambda m: m.pop("b"))

    def changed(self, p: Program, depth: int) -> None:
        if depth == 1:
            return self.leaf(p)
        self.either(p, depth - 1)
        self.change(p)

    def leaf(self, p: Program) -> None:
        kind = self.leaf_order[p.draw() % 3]
        if kind == 0:
            p.add(1)
            self.with_word(p, lambda word: _set("a", lambda m: word))
        elif kind == 1:
            p.add(2, _set("a", lambda m: m.d))
        else:
            p.add(5)
            p.add(2)
            self.with_word(p, lambda word: _set("a", lambda m: word & 0x3FF))
            p.add(0, Machine.fetch)

    @staticmethod
    def with_word(p: Program, step: Callable[[int], Step]) -> None:
        """A step with a random word in its code: the word is drawn before it is known to fit."""
        word = p.draw()
        p.add(4, step(word))

    def join(self, p: Program) -> None:
        kind = self.join_order[p.draw() % 6]
        if kind in (0, 1):
            shift = (lambda m: m.a >> (m.c & 31)) if kind == 0 else (lambda m: m.a << (m.c & 31))
            p.add(1, lambda m: m.push("c"))
            p.add(2, _set("c", lambda m: m.b))
            p.add(3, _set("c", lambda m: m.c & 15))
            p.add(2, _set("a", shift))
            p.add(1, lambda m: m.pop("c"))
        elif kind == 2:
            p.add(2, _set("a", lambda m: m.a + m.b))
        elif kind == 3:
            p.add(2, _set("a", lambda m: -m.a))
            p.add(2, _set("a", lambda m: m.a + m.b))
        elif kind == 4:
            p.add(3, _set("a", lambda m: m.a * m.b))
        else:
            p.add(2, _set("a", lambda m: m.a - m.b))

    def change(self, p: Program) -> None:
        kind = self.change_order[p.draw() & 7]
        if kind == 0:
            p.add(2, _set("a", lambda m: ~m.a))
        elif kind == 1:
            p.add(1, _set("a", lambda m: m.a - 1))
        elif kind == 2:
            p.add(2, _set("a", lambda m: -m.a))
        elif kind == 3:
            p.add(1, _set("a", lambda m: m.a + 1))
        elif kind == 4:
            p.add(5)
            p.add(1)
            p.add(4, _set("a", lambda m: m.a & 0x3FF))
            p.add(3, Machine.fetch)
        elif kind == 5:  # neighbouring bits swapped, by way of b
            p.add(1, lambda m: m.push("b"))
            p.add(2, _set("b", lambda m: m.a))
            p.add(2)
            p.add(4, _set("b", lambda m: m.b & 0xAAAAAAAA))
            p.add(1)
            p.add(4, _set("a", lambda m: m.a & 0x55555555))
            p.add(2, _set("b", lambda m: m.b >> 1))
            p.add(2, _set("a", lambda m: m.a << 1))
            p.add(2, _set("a", lambda m: m.a | m.b))
            p.add(1, lambda m: m.pop("b"))
        elif kind == 6:
            p.add(1)
            self.with_word(p, lambda word: _set("a", lambda m: m.a ^ word))
        else:
            sign = 1 if p.draw() & 1 else -1
            p.add(1)
            self.with_word(p, lambda word: _set("a", lambda m: m.a + sign * word))


@lru_cache(maxsize=1024)
def _program(seed: int, orders: tuple, prng_type: str, random_seed: int) -> Program:
    return Generator(*orders).program(program_xorshift(seed, random_seed) if prng_type == "nana" else program_lcg(seed))


def program_xor(
    data: bytes, key: int, control_block, mask: int = 0, offset: int = 0, prolog_order=(0, 1, 2), odd_branch_order=(0, 1, 2, 3, 4, 5),
    even_branch_order=(0, 1, 2, 3, 4, 5, 6, 7), prng_type: str = "lcg", random_seed: int = 0,
) -> bytes:
    """data under the cipher, which is its own inverse.

    The member is cut at (key & mask) + offset; the part before it is keyed by
    the checksum, the rest by the checksum's halves together.
    """
    block = tuple(control_block)
    orders = tuple(map(tuple, (prolog_order, odd_branch_order, even_branch_order)))
    out = np.frombuffer(data, np.uint8).copy()
    cut = min((key & mask) + offset & M32, len(out))
    for begin, end, k in ((0, cut, key), (cut, len(out), key >> 16 ^ key)):
        if begin == end:
            continue
        program = _program(k & 0x7F, orders, prng_type, random_seed)
        one, two = (program.run(x, block) for x in (k >> 7, ~(k >> 7)))
        first, second = two >> 16, two & 0xFFFF
        if first == second:
            second += 1
        out[begin:end] ^= np.uint8(one & 0xFF or 1)
        for at, byte in ((second, one >> 16 & 0xFF), (first, one >> 8 & 0xFF)):
            if begin <= at < end:
                out[at] ^= np.uint8(byte)
    return out.tobytes()


def make_plugin(block, prefix: bytes = b"") -> bytes:
    """A plugin file whose control block is block, for tests; its first seven words are the signature's."""
    raw = struct.pack(f"<{BLOCK_WORDS}I", *(~w & M32 for w in block))
    return prefix + SIGNATURE + raw[len(SIGNATURE) :]
