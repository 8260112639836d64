"""Sorted runs of byte strings that carry their common prefixes, and a loser tree that uses them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

ENTRY = "<HHHHI"


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix of two strings of which the first ``known`` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differs = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differs.bit_length() + 7) // 8


def front_code(run: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, left context, members) as bytes; what a suffix or left shares with the one before isn't repeated."""
    out, suffix, left = [], b"", b""
    for new, new_left, members in run:
        shared, shared_left = common_prefix(suffix, new), common_prefix(left, new_left)
        out += [struct.pack(ENTRY, shared, len(new) - shared, shared_left, len(new_left) - shared_left, len(members)), new[shared:], new_left[shared_left:], members]
        suffix, left = new, new_left
    return b"".join(out)


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(prefix shared with the suffix before, suffix, left context, members) of each entry."""
    at, suffix, left, size = 0, b"", b"", struct.calcsize(ENTRY)
    while at < len(data):
        shared, n, shared_left, n_left, n_members = struct.unpack_from(ENTRY, data, at)
        at += size
        suffix = suffix[:shared] + data[at : at + n]
        left = left[:shared_left] + data[at + n : at + n + n_left]
        at += n + n_left
        yield shared, suffix, left, data[at : at + n_members]
        at += n_members


def merge(runs: list[Iterator[tuple[int, bytes, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The entries of all runs in order, each with the prefix it shares with the entry before.

    A loser tree over the runs' heads. With each head goes the length of its common prefix with the
    last entry that left the tree: of two heads the one with the longer is smaller, without a look
    at the strings; at equal lengths comparing starts beyond that prefix, and the loser keeps the
    length found.
    """
    k = len(runs)
    heads: list[tuple[int, bytes, bytes, bytes] | None] = [next(r, None) for r in runs]
    shared = [0] * k
    losers = [-1] * k  # at inner nodes 1 … k - 1; leaf of run i is node k + i

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if b < 0 or heads[b] is None:
            return a, b
        if a < 0 or heads[a] is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = common_prefix(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = [-1] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while k and heads[top] is not None:
        yield shared[top], *heads[top][1:]
        heads[top] = next(runs[top], None)
        shared[top] = heads[top][0] if heads[top] else 0
        node = (k + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2
