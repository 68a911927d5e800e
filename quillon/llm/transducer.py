"""Minimal acyclic transducer over a sorted list of distinct byte strings: a string leads to its place in the list.

States are the classes of prefixes after which the same endings may follow. They are found from the longest prefixes up: a prefix's
endings hash from its own being in the list and from its next bytes with the hashes behind them. A transition carries how many strings
the state's earlier ways out hold, so the sum over a string's path is its ordinal. All prefixes of one length, and all strings that
are looked up, take a step at a time as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .text import U, mix


@dataclass
class Strings:
    """Byte strings end to end, and where each begins (one more offset than strings)."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, items: list[bytes]) -> Strings:
        return cls(np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64))

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Transducer:
    """`keys` is state * 256 + byte in order, with each transition's target and output; `final` tells where a string may end."""

    keys: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    size: int
    start: int

    def ordinals(self, s: Strings) -> np.ndarray:
        """Place of each string in the list, -1 for one that isn't in it."""
        state, place, out = np.full(len(s), self.start), np.zeros(len(s), np.int64), np.full(len(s), -1)
        length, live, step = np.diff(s.offsets), np.arange(len(s)), 0
        while len(live):
            ends = length[live] == step
            done = live[ends]
            out[done] = np.where(self.final[state[done]], place[done], -1)
            live = live[~ends]
            key = state[live] * 256 + s.data[s.offsets[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            there = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            live, at = live[there], at[there]
            state[live] = self.target[at]
            place[live] += self.output[at]
            step += 1
        return out

    def string(self, ordinal: int) -> bytes:
        """The string at a place of the list."""
        state, out, left = self.start, bytearray(), ordinal
        while not (left == 0 and self.final[state]):
            a, b = np.searchsorted(self.keys, (state * 256, state * 256 + 256))
            at = a + int(np.searchsorted(self.output[a:b], left, "right")) - 1
            out.append(int(self.keys[at]) & 255)
            left -= int(self.output[at])
            state = int(self.target[at])
        return bytes(out)

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.size, self.start], "<i8")
        return b"".join(x.tobytes() for x in (head, self.keys.astype("<i8"), self.target.astype("<i4"), self.output.astype("<i8"), self.final.astype("u1")))

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        n, states, size, start = np.frombuffer(data, "<i8", 4).tolist()
        keys, target, output, final = (np.frombuffer(data, t, k, at) for t, k, at in (("<i8", n, 32), ("<i4", n, 32 + 8 * n), ("<i8", n, 32 + 12 * n), ("u1", states, 32 + 20 * n)))
        return cls(keys, target, output, final.astype(bool), size, start)


def _shared(s: Strings) -> np.ndarray:
    """How many bytes each string has in common with the one before it."""
    length = np.diff(s.offsets)
    out, step = np.zeros(len(s), np.int64), 0
    live = np.flatnonzero(np.minimum(length[1:], length[:-1]) > 0) + 1
    while len(live):
        same = s.data[s.offsets[live] + step] == s.data[s.offsets[live - 1] + step]
        step += 1
        live = live[same]
        out[live] = step
        live = live[np.minimum(length[live], length[live - 1]) > step]
    return out


def build(s: Strings) -> Transducer:
    """The minimal transducer of distinct strings in ascending order of their bytes."""
    n, length = len(s), np.diff(s.offsets)
    shared = _shared(s)
    deepest = int(length.max()) if n else 0
    # Prefixes of one length: the strings that are the first to have them.
    by_depth: list[np.ndarray] = [np.zeros(min(n, 1), np.int64)]
    live = np.arange(n)
    for d in range(1, deepest + 1):
        live = live[length[live] >= d]
        by_depth.append(live[shared[live] < d])
    hashes: dict[int, np.ndarray] = {}
    found: list[tuple[np.ndarray, ...]] = []  # per depth: parents' hash, byte, own hash, strings before among the parent's ways
    held = np.zeros(0, np.int64)  # strings below each prefix
    states: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(deepest, -1, -1):
        first = by_depth[d]
        final = length[first] == d
        total, value = final.astype(np.int64), final.astype(U) + U(11)
        if d == deepest:
            value = mix(value)
        else:
            below = by_depth[d + 1]
            parent = np.searchsorted(first, below, "right") - 1
            byte = s.data[s.offsets[below] + d]
            np.add.at(value, parent, mix(hashes[d + 1] ^ mix(byte.astype(U) + U(257))))
            np.add.at(total, parent, held)
            upto = np.cumsum(held) - held
            head = np.searchsorted(parent, parent)  # the parent's first way out
            value = mix(value)
            found.append((value[parent], byte, hashes[d + 1], upto - upto[head] + final[parent]))
            del hashes[d + 1]
        hashes[d], held = value, total
        states.append((value, final))
    value, at = np.unique(np.concatenate([v for v, _ in states]), return_index=True)
    if not n:
        return Transducer(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, bool), 0, 0)
    final = np.concatenate([f for _, f in states])[at]
    if not found:
        return Transducer(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), final, n, 0)
    source, byte, to, output = (np.concatenate([f[i] for f in found]) for i in range(4))
    keys, at = np.unique(np.searchsorted(value, source) * 256 + byte, return_index=True)
    return Transducer(keys, np.searchsorted(value, to)[at].astype(np.int32), output[at], final, n, int(np.searchsorted(value, hashes[0][0])))
