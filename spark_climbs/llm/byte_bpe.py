"""Byte-level BPE over whole chunks of texts at once, as arrays.

A chunk is the bytes of many texts, one after the other. It is cut into words where the
tokenizer cuts it, and the bytes of many words are merged together: every round merges in each word the
pair of the lowest rank, wherever it stands in that word, until no word has a pair left. That is what
merging one pair at a time gives, as a new token's pairs rank after the merge that made it.

What a character is (letter, number, white space or other) is asked of the tokenizer itself when the
character is first met, so both always follow the same edition of Unicode.
"""

from __future__ import annotations

import json
import re

import numpy as np

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)
#: No rank: pairs that do not merge.
NEVER = np.int64(1) << 40
_QUOTE, _SPACE = ord("'"), ord(" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class PairTable:
    """Ranks of pairs by key: open addressing, many keys looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NEVER, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] < 0
            # of those that want the same free slot, one gets it
            self.keys[at[free]] = keys[left[free]]
            got = self.keys[at] == keys[left]
            self.values[at[got]] = values[left[got]]
            left, at = left[~got], (at[~got] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, ``NEVER`` for those not in the table."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NEVER)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        mask = len(self.keys) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def merged(pairs: PairTable, size: int, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words after all merges, from those of their bytes, and how many each has. ``pairs`` gives
    rank * ``size`` + new id by first id * ``size`` + second id."""
    n = len(sizes)
    word = np.repeat(np.arange(n), sizes)
    done_ids, done_words = [], []
    while len(ids):
        value = np.full(len(ids), NEVER, dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        value[inner] = pairs.get(ids[inner] * size + ids[inner + 1])
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        counts = np.diff(np.r_[heads, len(ids)])
        least = np.repeat(np.minimum.reduceat(value, heads), counts)
        ended = least == NEVER
        if ended.any():
            done_ids.append(ids[ended])
            done_words.append(word[ended])
            ids, word, value, least = ids[~ended], word[~ended], value[~ended], least[~ended]
        at = np.flatnonzero(value == least)
        if len(at):
            # in a row of equal tokens, every second pair from the left
            chained = np.r_[False, (at[1:] == at[:-1] + 1) & (word[at[1:]] == word[at[:-1]])]
            if chained.any():
                lead = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(lead, np.diff(np.r_[lead, len(at)]))
                at = at[place % 2 == 0]
            ids[at] = value[at] % size
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
    ids, word = np.concatenate([*done_ids, np.zeros(0, np.int64)]), np.concatenate([*done_words, np.zeros(0, np.int64)])
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=n)


def merges_of(model: dict, size: int) -> PairTable:
    """The table of a vocabulary's merges; a pair listed twice has its last rank, as in the library."""
    vocabulary = model["vocab"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    keys = np.array([vocabulary[a] * size + vocabulary[b] for a, b in pairs], dtype=np.int64)
    made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
    at = np.array(sorted({int(k): n for n, k in enumerate(keys)}.values()), dtype=np.int64)
    return PairTable(keys[at], at * size + made[at])


class Characters:
    """Classes of characters, each asked of ``classify`` when it is first met."""

    def __init__(self, classify):
        self.classify = classify
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._learn(np.arange(128))
        self.ascii = self.classes[:256].copy()

    def _learn(self, points: np.ndarray) -> None:
        for k in points.tolist():
            self.classes[k] = self.classify(chr(k))

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code point, class and first byte of every character."""
        if not len(data) or data.max() < 128:
            return data, self.ascii[data], np.arange(len(data) + 1)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        classes = self.classes[points]
        new = classes == UNKNOWN
        if new.any():
            self._learn(np.unique(points[new]))
            classes = self.classes[points]
        sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return points, classes, np.r_[0, np.cumsum(sizes)]


def contractions(points, at, stop, kind, last, joins, token) -> None:
    """A quote alone and not after a joining space takes the ending s, t, re, ve, m, ll or d."""
    k = np.flatnonzero((kind == OTHER) & (stop - at == 1) & ~last)
    k = k[(points[at[k]] == _QUOTE) & (kind[np.minimum(k + 1, len(kind) - 1)] == LETTER)]
    k = k[~np.where(k > 0, joins[k - 1], False)]
    if not len(k):
        return
    begin, end = at[k + 1], stop[k + 1]
    one = points[begin]
    two = np.where(end - begin > 1, points[np.minimum(begin + 1, len(points) - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    double = np.zeros(len(k), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        double |= (one == ord(a)) & (two == ord(b))
    taken = np.where(short, 1, np.where(double, 2, 0))
    some = taken > 0
    token[begin[some]] = False
    rest = some & (end - begin > taken)
    token[begin[rest] + taken[rest]] = True


class ByteBpe:
    """A byte-level BPE tokenizer from its file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        model, before, after = told["model"], told["pre_tokenizer"], told["decoder"]
        odd = [model["type"] != "BPE", model.get("dropout"), model.get("ignore_merges"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")]
        odd += [told["normalizer"], before["type"] != "ByteLevel", before["add_prefix_space"], not before["use_regex"], after["type"] != "ByteLevel"]
        odd += [t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]]
        if any(odd):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters, vocabulary = byte_letters(), model["vocab"]
        of_letter = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        shown = {k: bytes(of_letter[c] for c in t) for t, k in vocabulary.items()}
        # decoding knows no difference between added tokens and others
        shown |= {k: b"".join(bytes([of_letter[c]]) if c in of_letter else c.encode() for c in t) for t, k in added.items()}
        self.size = max(shown) + 1
        self.token_bytes = [shown.get(k, b"") for k in range(self.size)]
        self.token_sizes = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_data = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.pairs = merges_of(model, self.size)
        self.added = {t.encode(): k for t, k in added.items()}
        self.added_at = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.characters = Characters(self._classify)

    def _classify(self, c: str) -> int:
        cut = [len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + c)) for x in "a1!"]
        return cut.index(1) if 1 in cut else BLANK

    def words(self, data: np.ndarray, ends: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every word of texts that end at the given bytes, and the id of those
        that are added tokens (else -1). Without ``special``, these are text like any other."""
        marks, ids = [], {}
        if special and self.added_at is not None:
            raw = data.tobytes()
            starts = np.r_[0, ends[:-1]]
            for m in self.added_at.finditer(raw):
                # not where one text ends and the next begins
                k = np.searchsorted(starts, m.start(), "right") - 1
                while k + 1 < len(ends) and ends[k] <= m.start():
                    k += 1
                if m.end() <= ends[k]:
                    marks += [m.start(), m.end()]
                    ids[m.start()] = self.added[m[0]]
        points, classes, first = self.characters.of(data)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.unique(np.r_[0, ends, marks].astype(np.int64))
        opens = np.searchsorted(first, cuts[cuts < len(data)])
        begin = np.zeros(n + 1, dtype=bool)
        begin[opens] = True
        begin[n] = True
        run = begin[:n].copy()
        run[1:] |= classes[1:] != classes[:-1]
        at = np.flatnonzero(run)
        stop = np.r_[at[1:], n]
        kind = classes[at]
        last = begin[stop]  # the run ends its text
        token = np.zeros(n + 1, dtype=bool)
        token[at] = True
        blank = (kind == BLANK) & ~last
        token[stop[blank] - 1] = True
        joins = blank & (points[stop - 1] == _SPACE)
        token[stop[joins]] = False
        contractions(points, at, stop, kind, last, joins, token)
        for k in ids:
            a, b = np.searchsorted(first, [k, k + len(self.token_bytes[ids[k]])])
            token[a + 1 : b] = False
        starts = first[np.flatnonzero(token[:n])]
        fixed = np.full(len(starts), -1, dtype=np.int64)
        for k, v in ids.items():
            fixed[np.searchsorted(starts, k)] = v
        return starts, fixed

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word after the other, and how many each has."""
        return merged(self.pairs, self.size, self.first[data[spread(starts, sizes)]], sizes)

    def shown(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, one after the other."""
        return self.token_data[spread(self.token_starts[ids], self.token_sizes[ids])]


def hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = sizes.astype(np.uint64)
    at, rest = np.arange(len(starts)), 0
    while len(at):
        at = at[sizes[at] > rest]
        out[at] = (out[at] ^ data[starts[at] + rest]) * _MIX
        out[at] ^= out[at] >> np.uint64(29)
        rest += 1
    return out


def distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different word, and for every word the number of its own. Equal hashes of
    different words are told apart by their bytes."""
    h = hashes(data, starts, sizes)
    _, first, own = np.unique(h, return_index=True, return_inverse=True)
    other = first[own]
    same = sizes == sizes[other]
    flat = np.flatnonzero(same)
    equal = data[spread(starts[flat], sizes[flat])] == data[spread(starts[other[flat]], sizes[flat])]
    if len(flat) < len(starts) or not equal.all():
        raw = data.tobytes()
        met: dict[bytes, int] = {}
        own = np.array([met.setdefault(raw[s : s + n], len(met)) for s, n in zip(starts.tolist(), sizes.tolist())], dtype=np.int64)
        _, first = np.unique(own, return_index=True)
    return first, own


def encode(bpe: ByteBpe, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fixed: np.ndarray, known=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words in turn and how many each has. ``known(data, starts, sizes)`` may give those
    it has: a number for each word (-1: none), and ids, starts and sizes by number."""
    number = np.full(len(starts), -1, dtype=np.int64)
    tables = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if known is not None:
        number, *tables = known(data, starts, sizes)
    number[fixed >= 0] = -2
    new = np.flatnonzero(number == -1)
    first, own = distinct(data, starts[new], sizes[new])
    ids, counts = bpe.merge(data, starts[new[first]], sizes[new[first]])
    # the words of the chunk after those of the lexicon, and the added tokens last
    all_ids = np.concatenate([tables[0], ids, fixed[fixed >= 0]])
    begins = np.concatenate([tables[1], len(tables[0]) + np.cumsum(counts) - counts, len(tables[0]) + len(ids) + np.arange((fixed >= 0).sum())])
    lengths = np.concatenate([tables[2], counts, np.ones((fixed >= 0).sum(), np.int64)])
    number[new] = len(tables[1]) + own
    number[fixed >= 0] = len(tables[1]) + len(counts) + np.arange((fixed >= 0).sum())
    sizes_out = lengths[number]
    return all_ids[spread(begins[number], sizes_out)], sizes_out
