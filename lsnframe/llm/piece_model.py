"""A SentencePiece BPE vocabulary as numpy tables, with a vectorised merge-round encoder.

A text is cut into units at places that no piece of the vocabulary spans (before a run of spaces,
around line breaks), so units are encoded independently and distinct units only once.  Inside units,
words end wherever two neighbouring characters stand together in no piece: no merge ever crosses such
a place.  All words advance together, whatever their length: every round finds the smallest pair rank
of each word, merges all pairs of that rank at once, leftmost first where they overlap, and compacts
the symbol array, until no word has a pair left.

Merging one pair at a time could differ from that only if a merge makes a pair of a rank that is not
larger; so a round ends, for that word, with the first merge that does.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from lsnframe.llm.hashing import IntMap

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Characters that are no piece get symbol UNKNOWN + code point, written as one token a byte.
UNKNOWN = 1 << 16
#: Characters that are encoded together.
SLICE = 1 << 20


class PieceModel:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        self.bytes_of: list[bytes] = []
        plain = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                plain[p] = i
                self.bytes_of.append(p.replace(SPACE, " ").encode())
        self.ids = plain
        many = [p for p in plain if len(p) > 1]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(plain[p]) for p in many}, reverse=True))}
        self.rank = np.full(n + 1, NONE, np.int32)  # the last one: no piece
        pairs: dict[int, int] = {}
        for p in many:
            i = plain[p]
            self.rank[i] = order[sp.get_score(i)]
            for cut in range(1, len(p)):
                a, b = plain.get(p[:cut]), plain.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = i
        self._merge = IntMap(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        beside = sorted({ord(p[k]) << 21 | ord(p[k + 1]) for p in many for k in range(len(p) - 1)})
        self._beside = IntMap(np.array(beside, np.int64), np.zeros(len(beside), np.int64))
        self.char_id = np.arange(0x110000, dtype=np.int32) + np.int32(UNKNOWN)
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.longest = max(map(len, plain))
        if any(SPACE in p.lstrip(SPACE) for p in many):
            raise ValueError("a piece holds a space after another character: texts can't be cut into units")
        # a line break that no longer piece holds stands alone; else it stays inside its unit
        lone = "" if any("\n" in p for p in many) else "\n"
        self._unit = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|{lone}" if lone else ""))

    def units(self, text: str) -> list[str]:
        """The units of a text; their concatenation is the normalised text."""
        return self._unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units in one array, and the offsets of each unit in it.

        About SLICE characters are held at a time, or one unit that is longer."""
        parts, sizes, lo, held = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
        for k, u in enumerate(units):
            held += len(u)
            if held >= SLICE or k == len(units) - 1:
                sym, size = self._rounds(units[lo : k + 1])
                parts.append(sym)
                sizes.append(size)
                lo, held = k + 1, 0
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    def word_ends(self, chars: np.ndarray) -> np.ndarray:
        """For each character but the last, whether no piece holds it and the next one side by side."""
        return self._beside.get(chars[:-1] << 21 | chars[1:]) < 0

    def _rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The merge rounds of some units: their symbols, and how many each unit has."""
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        ends = self.word_ends(chars.astype(np.int64))
        ends[np.cumsum(lens)[:-1][lens[:-1] > 0] - 1] = True
        place = np.arange(len(chars), dtype=np.int32)  # of a symbol's first character
        word = np.concatenate((np.zeros(1, np.int32), np.cumsum(ends, dtype=np.int32)))
        sym = self.char_id[chars]
        rank = np.append(self._ranks(sym, word, np.arange(len(sym) - 1)), np.int32(NONE))
        begun = np.concatenate(([0], np.cumsum(lens)))
        done_sym, done_place = [], []
        while len(sym):
            new = np.empty(len(sym), bool)
            new[0] = True
            np.not_equal(word[1:], word[:-1], out=new[1:])
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, first)
            mine = np.repeat(least, np.diff(np.append(first, len(sym))))
            over = mine == NONE
            at = np.flatnonzero((rank == mine) & ~over)
            if over.any():
                done_sym.append(sym[over])
                done_place.append(place[over])
            if not len(at):
                break
            at = self._accepted(sym, word, rank, self._leftmost(at))
            sym[at] = self._merge.get(sym[at].astype(np.int64) << 21 | sym[at + 1])
            keep = ~over
            keep[at + 1] = False
            where = (np.cumsum(keep) - 1)[at]
            sym, word, rank, place = sym[keep], word[keep], rank[keep], place[keep]
            for p in (where, where[where > 0] - 1):
                rank[p] = NONE
                q = p[p + 1 < len(sym)]
                rank[q] = self._ranks(sym, word, q)
        sym, place = np.concatenate(done_sym), np.concatenate(done_place)
        order = np.argsort(place, kind="stable")
        return sym[order], np.diff(np.searchsorted(place[order], begun))

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of pairs at ascending places, those left when each is taken that overlaps none taken before."""
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + 1
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - head) % 2 == 0]

    def _accepted(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The merges up to each word's first one that makes a pair of a rank not larger than its own."""
        merged = self._merge.get(sym[at].astype(np.int64) << 21 | sym[at + 1])
        before = sym[np.maximum(at - 1, 0)]
        close = np.append(False, at[1:] == at[:-1] + 2)  # the symbol before is one just merged
        before[close] = merged[np.flatnonzero(close) - 1]
        inside = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        left = np.where(inside, self.rank[self._merge.get(before.astype(np.int64) << 21 | merged)], NONE)
        after = np.minimum(at + 2, len(sym) - 1)
        inside = (at + 2 < len(sym)) & (word[after] == word[at])
        right = np.where(inside, self.rank[self._merge.get(merged << 21 | sym[after])], NONE)
        stop = np.minimum(left, right) <= rank[at]
        if not stop.any():
            return at
        w = word[at]
        stops = np.cumsum(stop) - stop  # stops before each merge
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        return at[stops == np.repeat(stops[head], np.diff(np.append(head, len(at))))]

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs at some places; _merge gives -1 for no piece, and rank[-1] is NONE."""
        merged = self._merge.get(sym[at].astype(np.int64) << 21 | sym[at + 1])
        return np.where(word[at] == word[at + 1], self.rank[merged], np.int32(NONE))

    def encode_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all units, and the offsets of each unit: a character that is no piece becomes its bytes."""
        sym, offsets = self.encode_units(units)
        strange = np.flatnonzero(sym >= UNKNOWN)
        if not len(strange):
            return sym, offsets
        written = [self.byte_ids[list(chr(x - UNKNOWN).encode())] for x in sym[strange].tolist()]
        size = np.ones(len(sym), np.int64)
        size[strange] = list(map(len, written))
        reach = np.cumsum(size)
        out = np.repeat(sym, size)
        where = np.repeat(sym >= UNKNOWN, size)
        out[where] = np.concatenate(written)
        return out, np.append(0, reach)[offsets]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a path, once per Python process."""
    return PieceModel(path)
