"""Canonical, length-limited Huffman codes for token ids, encoded and decoded with numpy.

A block is a run of ids with its own bits and a checkpoint (bit offset) every
``STRIDE`` ids. Decoding follows all checkpoints of a block side by side, one table look-up for
each id, so a block needs nothing but the code lengths.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits, which is also the width of the decoding table.
MAX_LENGTH = 20
#: Ids from one checkpoint to the next.
STRIDE = 256


def lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Code length of every symbol (0: it does not occur) by package-merge: the best
    lengths among those of at most ``limit`` bits."""
    present = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(present) <= 1:
        out[present] = 1
        return out
    if len(present) > 1 << limit:
        raise ValueError(f"{len(present)} symbols need codes of more than {limit} bits")
    order = present[np.argsort(counts[present], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    taken_at, level = [], weight
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        rank = np.argsort(merged, kind="stable")
        taken_at.append(rank < n)
        level = merged[rank]
    depth = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for own in reversed(taken_at):
        leaves = int(own[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    out[order] = depth
    return out


def canonical(code_lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each with its most significant bit first."""
    codes = np.zeros(len(code_lengths), dtype=np.uint64)
    code, last = 0, 0
    by_length = np.argsort(code_lengths, kind="stable")
    for length in range(1, int(code_lengths.max(initial=0)) + 1):
        own = by_length[code_lengths[by_length] == length]
        code <<= length - last
        last = length
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code += len(own)
    return codes


def decoding_table(code_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next ``width`` bits."""
    width = max(1, int(code_lengths.max(initial=1)))
    symbols = np.flatnonzero(code_lengths)
    order = symbols[np.argsort(code_lengths[symbols], kind="stable")]
    span = np.left_shift(1, width - code_lengths[order].astype(np.int64))
    table = np.repeat(order.astype(np.uint32), span)
    sizes = np.repeat(code_lengths[order], span)
    short = (1 << width) - len(table)
    return np.concatenate([table, np.zeros(short, np.uint32)]), np.concatenate([sizes, np.ones(short, np.uint8)]), width


def encode(ids: np.ndarray, code_lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, and the bit offsets of every ``STRIDE``-th id."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int32)
    size = code_lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id without a code")
    end = np.cumsum(size)
    start = end - size
    word, inside = start >> 5, start & 31
    shifted = codes[ids] << (64 - size - inside).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    whole = np.bitwise_or.reduceat(shifted, first)
    words = np.zeros(int(end[-1] >> 5) + 2, dtype=np.uint32)
    at = word[first]
    words[at] |= (whole >> np.uint64(32)).astype(np.uint32)
    words[at + 1] |= (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], start[::STRIDE].astype(np.int32)


def decode(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block."""
    symbols, sizes, width = table
    raw = np.frombuffer(bits + b"\0" * 8, dtype=np.uint8)
    at = checkpoints.astype(np.int64)
    out = np.empty((STRIDE, len(at)), dtype=np.uint32)
    for k in range(STRIDE):
        byte = np.minimum(at >> 3, len(raw) - 4)
        ahead = (
            (raw[byte].astype(np.uint32) << 24)
            | (raw[byte + 1].astype(np.uint32) << 16)
            | (raw[byte + 2].astype(np.uint32) << 8)
            | raw[byte + 3]
        )
        value = (ahead << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[k] = symbols[value]
        at += sizes[value]
    return out.T.reshape(-1)[:n]
