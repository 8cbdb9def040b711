"""The greedy road-building scan, as seen by one task.

Frames hold whole groups, sorted by group and, inside one, in scan order. They
carry ids and end points only, never geometry.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pandas as pd

HEAD, TAIL = 0, 1
END_ARM, START_ARM = 0, 1
_FIRST = (-math.inf, 0)
_NEVER = (math.inf, 0)

PIECE_COLUMNS = ("seq", "n_nodes", "street", "start_lat", "start_lon", "end_lat", "end_lon")

# A claim: a piece, the end it is joined by, the seed, arm and count of the arm, the
# time of joining and the arm's last joining by a head before.
CLAIM_COLUMNS = ("seq", "via", "s_n", "s_seq", "arm", "k", "cm_n", "cm_seq", "h_n", "h_seq")


def whole_groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no frame cuts a group."""
    open_group: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        ids = batch[key].to_numpy()
        last_start = int(np.searchsorted(ids, ids[-1], side="left"))
        if last_start > 0 or (open_group and open_group[-1][key].iloc[-1] != ids[0]):
            yield pd.concat([*open_group, batch.iloc[:last_start]], ignore_index=True)
            open_group = []
        open_group.append(batch.iloc[last_start:])
    if open_group:
        yield pd.concat(open_group, ignore_index=True)


class _Tile:
    """Road building inside a group of tiles of the map, given the claims of other tiles.

    A road grows from a seed by two *arms*, one at either end. All happens in a total
    order of events ``(seed, cm, ...)``: seeds by rank; inside a road, an arm's next
    piece waits until every better ranked piece in reach of the other arm is taken,
    so the time of joining is ``cm``, the worst rank the arm has taken so far. When
    both arms want the same piece at the same time, the end of the road goes first;
    the end is the arm that last joined a piece by its head (``h``).

    Claims of other tiles are events like our own. The group plays only the arms
    whose tip lies in the core of one of its tiles (``homes``: the tile of either end, None
    outside), which is the tile the claim is told under; where an arm leaves, the next
    group takes over. ``support`` names the claim by which an arm entered the group.
    """

    def __init__(self, tol: float, homes: list[tuple], seq, n_nodes, street, start_lat, start_lon, end_lat, end_lon):
        self.tol, self.cell = tol, tol * 1.25
        self.seq = seq
        self.rank = [(-n, s) for n, s in zip(n_nodes, seq)]
        self.street = street
        self.ends = list(zip(zip(start_lat, start_lon), zip(end_lat, end_lon)))
        self.homes = homes
        self.used = bytearray(len(self.seq))
        self.waiting: dict[tuple, list[int]] = defaultdict(list)
        for piece, (head, tail) in enumerate(self.ends):
            here, there = self._cell(*head), self._cell(*tail)
            self.waiting[self.street[piece], *here].append(piece)
            if there != here:
                self.waiting[self.street[piece], *there].append(piece)
        self.events: list[tuple] = []
        self.serial = count()
        self.claims: list[tuple] = []

    def _cell(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / self.cell), math.floor(lon / self.cell)

    def _meets(self, tip: tuple[float, float], piece: int, end: int) -> bool:
        lat, lon = self.ends[piece][end]
        return abs(tip[0] - lat) < self.tol and abs(tip[1] - lon) < self.tol

    def _first_near(self, street: str, tip: tuple[float, float]) -> int | None:
        """First unused piece, in rank order, with an end in the box around the tip."""
        ci, cj = self._cell(*tip)
        best = None
        for i in (ci - 1, ci, ci + 1):
            for j in (cj - 1, cj, cj + 1):
                waiting = self.waiting.get((street, i, j))
                if not waiting:
                    continue
                passed = scanned = 0
                for piece in waiting:
                    if best is not None and piece >= best:
                        break
                    scanned += 1
                    if self.used[piece]:
                        passed += 1
                    elif self._meets(tip, piece, HEAD) or self._meets(tip, piece, TAIL):
                        best = piece
                        break
                if passed > 8:  # forget the used ones that were scanned
                    waiting[:scanned] = [p for p in waiting[:scanned] if not self.used[p]]
        return best

    def _grow(self, street: str, tip, home, s, arm: int, k: int, cm, h, support) -> None:
        """Queue the next joining of an arm, if anything is in reach."""
        piece = self._first_near(street, tip)
        if piece is not None:
            self._queue(s, max(cm, self.rank[piece]), arm, k + 1, h, piece, (street, tip, home, k, cm, h, support))

    def _queue(self, s, cm, arm: int, k: int, h, piece: int, event: tuple) -> None:
        """The piece of rank ``cm`` is what both arms may reach for at once, so it comes
        first, for the arm whose turn it is; what follows at the same time is all the
        winner's, in its own count."""
        if self.rank[piece] == cm:
            order = (0, _NEVER if h is None else (-h[0], -h[1]), arm)
        else:
            order = (1, k)
        heappush(self.events, (s, cm, order, next(self.serial), arm, k, piece, event))

    def _leave(self, piece: int, via: int, s, arm: int, k: int, cm, h, support) -> None:
        """Go on from the far end of a joined piece, if that end is ours."""
        far = TAIL if via == HEAD else HEAD
        home = self.homes[piece][far]
        if home is not None:
            self._grow(self.street[piece], self.ends[piece][far], home, s, arm, k, cm, cm if via == HEAD else h, support)

    def play(self, foreign: list[tuple]) -> list[tuple]:
        """All claims made in this group: piece, tile, CLAIM_COLUMNS and support. ``foreign``
        holds CLAIM_COLUMNS tuples with the name of the claim itself."""
        index = {seq: piece for piece, seq in enumerate(self.seq)}
        for seq, via, s_n, s_seq, arm, k, cm_n, cm_seq, h_n, h_seq, name in foreign:
            h = None if h_seq is None else (h_n, h_seq)
            event = (via, (s_n, s_seq), arm, k, (cm_n, cm_seq), h, name)
            self._queue((s_n, s_seq), (cm_n, cm_seq), arm, k, h, index[seq], event)
        # Seeds come in rank order, so they need no place in the queue.
        for seed, rank in enumerate(self.rank):
            self._play_until((rank, _FIRST))
            if not self.used[seed]:
                self.used[seed] = 1
                for end, arm in ((TAIL, END_ARM), (HEAD, START_ARM)):
                    home = self.homes[seed][end]
                    if home is not None:
                        self._grow(self.street[seed], self.ends[seed][end], home, rank, arm, 0, rank, None, None)
        self._play_until((_NEVER,))
        return self.claims

    def _play_until(self, limit: tuple) -> None:
        while self.events and self.events[0][:2] < limit:
            s, cm, _, _, arm, k, piece, event = heappop(self.events)
            if event[0] in (HEAD, TAIL):  # a claim of another group
                if not self.used[piece]:
                    self.used[piece] = 1
                    self._leave(piece, *event)
                continue
            street, tip, home, k_before, cm_before, h, support = event
            if self.used[piece]:
                self._grow(street, tip, home, s, arm, k_before, cm_before, h, support)
                continue
            self.used[piece] = 1
            via = HEAD if self._meets(tip, piece, HEAD) else TAIL
            self.claims.append((piece, home, self.seq[piece], via, *s, arm, k, *cm, *(h or (None, None)), support))
            self._leave(piece, via, s, arm, k, cm, h, support)


def _homes(tiles: np.ndarray, start_in: np.ndarray, end_in: np.ndarray, piece: np.ndarray, n: int) -> list[tuple]:
    """The tile of either end of every piece, from a row for each piece and tile."""
    out = []
    for own in (start_in, end_in):
        home: list = [None] * n
        for p, t in zip(piece[own].tolist(), tiles[own].tolist()):
            home[p] = t
        out.append(home)
    return list(zip(*out))


def play_tiles(frame: pd.DataFrame, tol: float) -> pd.DataFrame:
    """Claims of every group of tiles in a frame of whole groups. The rows of a group are its pieces in
    rank order, one for each of its tiles that knows them, then the claims other groups make on them."""
    ids = frame["grp"].to_numpy()
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    stops = np.r_[starts[1:], len(ids)]
    claims_before = np.r_[0, np.cumsum(frame["is_claim"].to_numpy(bool))]
    n_foreign = (claims_before[stops] - claims_before[starts]).tolist()
    seq, tiles, shared = frame["seq"].to_numpy(), frame["tile"].to_numpy(), frame["shared"].to_numpy(bool)
    start_in, end_in = frame["start_in"].to_numpy(bool), frame["end_in"].to_numpy(bool)
    piece_columns = [frame[c].tolist() for c in PIECE_COLUMNS]
    claim_columns = [frame[c].tolist() for c in (*CLAIM_COLUMNS, "support")]
    has_h = frame["has_h"].tolist()
    out: list[tuple] = []
    for start, stop, n in zip(starts.tolist(), stops.tolist(), n_foreign):
        end = stop - n
        if stop - start == 1:
            continue  # one piece alone has nothing to join
        new = np.r_[True, seq[start + 1 : end] != seq[start : end - 1]]
        first = (np.flatnonzero(new) + start).tolist()
        homes = _homes(tiles[start:end], start_in[start:end], end_in[start:end], np.cumsum(new) - 1, len(first))
        foreign = [
            (*claim[:8], *(claim[8:10] if h else (None, None)), claim[10])
            for h, *claim in zip(has_h[end:stop], *[c[end:stop] for c in claim_columns])
        ]
        claims = _Tile(tol, homes, *[[c[k] for k in first] for c in piece_columns]).play(foreign)
        out += [(tile, bool(shared[first[piece]]), *claim) for piece, tile, *claim in claims]
    names = ["tile", "on_border", *CLAIM_COLUMNS, "support"]
    claims = pd.DataFrame(out, columns=names, dtype=object)
    return claims.astype({c: "Int64" for c in ("tile", *CLAIM_COLUMNS)} | {"on_border": bool})
