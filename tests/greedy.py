"""Plain restatements of the greedy rules, for comparison on small inputs."""

from __future__ import annotations

from math import atan2, cos, radians, sin, sqrt


def metres(a, b) -> float:
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h))


def first_kept(segments, tol=10.0) -> list[int]:
    """``segments``: (seq, start, end) with seq ascending."""
    kept = []
    for seq, start, end in segments:
        if all(metres(start, s) >= tol or metres(end, e) >= tol for _, s, e in kept):
            kept.append((seq, start, end))
    return [k[0] for k in kept]


def build_roads(pieces, tol=0.002) -> list[tuple[list, list]]:
    """``pieces``: (seq, street, nodes). Roads as (seqs in joining order, nodes)."""

    def meet(p, q):
        return abs(p[0] - q[0]) < tol and abs(p[1] - q[1]) < tol

    roads = []
    for street in sorted({p[1] for p in pieces}):
        left = sorted((p for p in pieces if p[1] == street), key=lambda p: (-len(p[2]), p[0]))
        while left:
            seq, _, nodes = left.pop(0)
            ids, nodes = [seq], list(nodes)
            grown = True
            while grown:
                grown = False
                for k, (seq, _, other) in enumerate(left):
                    if meet(nodes[-1], other[0]):
                        nodes = nodes + other[1:]
                    elif meet(nodes[-1], other[-1]):
                        nodes = nodes + other[:-1][::-1]
                    elif meet(nodes[0], other[0]):
                        nodes = nodes[::-1] + other[1:]
                    elif meet(nodes[0], other[-1]):
                        nodes = other + nodes[1:]
                    else:
                        continue
                    ids.append(seq)
                    left.pop(k)
                    grown = True
                    break
            roads.append((ids, nodes))
    return roads


def chains(ways) -> list[list[int]]:
    """``ways``: (seq, inside, head, tail). Chains by shared nodes."""
    left, out = sorted(ways), []
    while left:
        chain = [left.pop(0)]
        while True:
            k = next((k for k, w in enumerate(left) if w[1] == chain[-1][1] and w[2] == chain[-1][3]), None)
            if k is None:
                break
            chain.append(left.pop(k))
        out.append([w[0] for w in chain])
    return out
