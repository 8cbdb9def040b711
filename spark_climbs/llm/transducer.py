"""A minimal acyclic transducer from words to ids, as arrays in one file.

Words that end alike share states: built from sorted words, a state is looked up among the
finished ones as soon as no further word can change it. The outputs on the way through a word add up
to the word's number, at which its ids stand. States are packed into one array (``base`` + byte,
checked by owner), so many words take their next step in a few gathers.

The file is a JSON header and the arrays, each at an offset that memory mapping can start from.
"""

from __future__ import annotations

import json

import numpy as np

_ALIGN = 64
#: Places that are tried together for a state's edges.
_WINDOW = 256


def build(words: list[bytes]) -> dict[str, np.ndarray]:
    """The arrays of different words in ascending order; word k gets number k."""
    final: list[bool] = []
    edges: list[tuple] = []
    counts: list[int] = []
    register: dict[tuple, int] = {}

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        found = register.get(key)
        if found is None:
            found = register[key] = len(final)
            final.append(node[0])
            edges.append(key[1])
            counts.append(node[0] + sum(counts[t] for _, t in key[1]))
        return found

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        same = 0
        for a, b in zip(word, last):
            if a != b:
                break
            same += 1
        while len(path) > same + 1:
            done = finish(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = finish(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = finish(path[0])
    return _packed(final, edges, counts, root)


def _packed(final, edges, counts, root) -> dict[str, np.ndarray]:
    n = len(final)
    free = np.ones(1024 + 2 * sum(map(len, edges)), dtype=bool)
    base = np.zeros(n, dtype=np.int32)
    # states of many edges first; those of one edge fill what is left free
    low = 256
    for s in sorted((s for s in range(n) if len(edges[s]) > 1), key=lambda s: -len(edges[s])):
        at = np.array([b for b, _ in edges[s]])
        while True:
            if low + 1024 >= len(free):
                free = np.concatenate([free, np.ones(len(free), dtype=bool)])
            open_ = np.flatnonzero(free[low : low + _WINDOW]) + low - at[0]
            fits = np.flatnonzero(free[open_[:, None] + at].all(axis=1))
            if len(fits):
                break
            low += _WINDOW
        base[s] = open_[fits[0]]
        free[base[s] + at] = False
        if fits[0] > _WINDOW // 4:
            low += _WINDOW // 8
    single = [s for s in range(n) if len(edges[s]) == 1]
    open_ = np.flatnonzero(free[256:]) + 256
    if len(open_) < len(single):
        open_ = np.r_[open_, len(free) + np.arange(len(single))]
    for s, k in zip(single, open_.tolist()):
        base[s] = k - edges[s][0][0]
    size = int(base.max(initial=0)) + 512
    check = np.full(size, -1, dtype=np.int32)
    target, output = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    for s in range(n):
        before = int(final[s])
        for b, t in edges[s]:
            k = base[s] + b
            check[k], target[k], output[k] = s, t, before
            before += counts[t]
    return {"base": base, "final": np.array(final, dtype=np.uint8), "check": check, "target": target, "output": output, "root": np.array([root], dtype=np.int32)}


def find(arrays, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of every word, -1 for those not in the transducer."""
    base, final, check, target, output = (arrays[k] for k in ("base", "final", "check", "target", "output"))
    out = np.full(len(starts), -1, dtype=np.int64)
    who = np.arange(len(starts))
    at, left = starts.astype(np.int64), sizes.astype(np.int32)
    state = np.full(len(starts), arrays["root"][0], dtype=np.int32)
    number = np.zeros(len(starts), dtype=np.int32)
    while len(who):
        ended = left == 0
        if ended.any():
            here = ended & (final[state] > 0)
            out[who[here]] = number[here]
            on = ~ended
            who, at, left, state, number = who[on], at[on], left[on], state[on], number[on]
        k = base[state] + data[at]
        on = check[k] == state
        if not on.all():
            who, at, left, number, k = who[on], at[on], left[on], number[on], k[on]
        state, number = target[k], number + output[k]
        at, left = at + 1, left - 1
    return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    header, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        header[name] = [a.dtype.str, len(a), at]
        raw += bytes(-len(raw) % _ALIGN)
        parts.append(raw)
        at += len(raw)
    head = json.dumps(header).encode()
    head += b" " * (-(len(head) + 8) % _ALIGN)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped and not read."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        header = json.loads(f.read(size))
    return {name: np.memmap(path, dtype=kind, mode="r", offset=8 + size + at, shape=(n,)).view(np.ndarray) if n else np.zeros(0, kind) for name, (kind, n, at) in header.items()}
