"""Exact token counts by prefix dynamic programming (operator 1).

A BPE encoding ends, at every prefix of a text, in exactly one token that (a) is a suffix of the
prefix, (b) encodes to itself and (c) may follow the last token of the shorter prefix, that is, the
two tokens together encode to themselves.  So one pass stores the last token and the exact count at
every prefix:  count[end] = count[start] + 1.  Whether two tokens may stand together is asked of the
merge-round encoder once a pair and remembered.  Units of a text (see piece_model) are independent,
so a text's counts are its units' counts added up, and a unit's counts are kept in a bounded cache.

Nulls count as empty texts with 0 tokens; repeated rows give repeated results; other columns of the
input are not read by :func:`count_tokens`; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces, small_batches
from lsnframe.llm.hashing import IntMap, Recent
from lsnframe.llm.piece_model import SLICE, UNKNOWN, PieceModel, load

START = (1 << 21) - 1  # stands before the first token of a unit


class PrefixCounter:
    def __init__(self, model: PieceModel, most: int = 256 << 20, most_pairs: int = 400_000) -> None:
        """``most`` bounds the bytes of the cache of units, ``most_pairs`` that of pairs of tokens."""
        self.model, self.most_pairs = model, most_pairs
        self._recent = Recent(most)
        self._pairs, self._apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self._table = IntMap(self._pairs, self._apart)
        self._fresh: dict[int, bool] = {}
        edges: dict[tuple[int, str], int] = {}
        self._token = [-1]
        for p, i in model.ids.items():
            at = 0
            for ch in p:
                at = edges.setdefault((at, ch), len(edges) + 1)
                if at == len(self._token):
                    self._token.append(-1)
            self._token[at] = i
        keys = np.array([s << 21 | ord(c) for s, c in edges], np.int64)
        self._trie = IntMap(keys, np.fromiter(edges.values(), np.int64, len(edges)))
        self._token = np.array(self._token, np.int32)

    def _stand(self, keys: np.ndarray) -> np.ndarray:
        """Whether the tokens of each key (first << 21 | second) stay apart when encoded together."""
        got = self._table.get(keys)
        open_ = np.flatnonzero(got < 0)
        if not len(open_):
            return got > 0
        ask = np.unique(keys[open_])
        ask = np.array([k for k in ask.tolist() if k not in self._fresh], np.int64)
        if len(ask):
            a, b = ask >> 21, ask & START
            free = (a >= UNKNOWN) & (a != START) | (b >= UNKNOWN)  # no pair spans such a character
            text = lambda t: "" if t == START else chr(t - UNKNOWN) if t >= UNKNOWN else self.model.pieces[t]
            test = np.flatnonzero(~free)
            sym, at = self.model.encode_units([text(x) + text(y) for x, y in zip(a[test].tolist(), b[test].tolist(), strict=True)])
            ok = free.copy()
            size = np.diff(at)
            alone = a[test] == START
            begin = at[:-1]
            ok[test] = np.where(
                alone,
                (size == 1) & (sym[begin] == b[test]),
                (size == 2) & (sym[begin] == a[test]) & (sym[np.minimum(begin + 1, len(sym) - 1)] == b[test]),
            ) if len(test) else False
            self._fresh.update(zip(ask.tolist(), ok.tolist(), strict=True))
        got[open_] = [self._fresh[k] for k in keys[open_].tolist()]
        return got > 0

    def _settle(self) -> None:
        """Moves freshly learned pairs into the table; a full one is begun anew."""
        if len(self._fresh) > max(2_000, len(self._pairs) // 8):
            n = len(self._fresh)
            keys, apart = np.fromiter(self._fresh.keys(), np.int64, n), np.fromiter(self._fresh.values(), bool, n)
            if len(self._pairs) + n <= self.most_pairs:
                keys, apart = np.concatenate((self._pairs, keys)), np.concatenate((self._apart, apart))
            self._pairs, self._apart, self._fresh = keys, apart, {}
            self._table = IntMap(keys, apart)

    def prefix_counts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The exact count at every prefix of every unit (the empty one first), and each unit's place.

        About SLICE characters are held at a time, or one word that is longer."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.append(0, np.cumsum(lens + 1))  # a unit of n characters has n + 1 prefixes
        count = np.zeros(first[-1], np.int64)
        if not len(chars):
            return count, first
        off = np.append(0, np.cumsum(lens))
        ends = np.append(self.model.word_ends(chars), True)
        ends[off[1:][lens > 0] - 1] = True
        ends = np.flatnonzero(ends) + 1
        inside, begins, lo = [], [], 0
        while lo < len(chars):
            hi = max(int(ends[np.searchsorted(ends, lo, side="right")]), int(ends[np.searchsorted(ends, lo + SLICE, side="right") - 1]))
            n, new = self._word_counts(chars[lo:hi], ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, hi, side="right")] - lo)
            inside.append(n)
            begins.append(new)
            lo = hi
        self._settle()
        n, begin = np.concatenate(inside), np.flatnonzero(np.concatenate(begins))
        word = np.cumsum(np.concatenate(begins)) - 1
        total = n[np.append(begin[1:], len(n)) - 1].astype(np.int64)
        before = np.cumsum(total) - total  # tokens of all words before each word
        of = np.repeat(np.arange(len(units)), lens)
        count[np.arange(len(chars)) + of + 1] = n + before[word] - before[word[off[:-1][of]]]
        return count, first

    def _word_counts(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For characters of words that end at ``ends``: the count up to and with each one inside its
        part of a word, and where such parts begin: where no occurrence of a piece reaches across."""
        starts, stops, tokens = [], [], []
        at, state = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), np.int64)
        end_of = ends[np.searchsorted(ends, at, side="right")].astype(np.int32)
        step = 0
        while len(at):
            state = self._trie.get(state << 21 | chars[at + step])
            alive = state >= 0
            at, state = at[alive], state[alive]
            step += 1
            token = self._token[state]
            full = token >= 0
            starts.append(at[full])
            stops.append(at[full] + np.int32(step))
            tokens.append(token[full])
            more = at + step < end_of[at]
            at, state = at[more], state[more]
        lone = np.flatnonzero(self.model.char_id[chars] >= UNKNOWN).astype(np.int32)
        starts.append(lone)
        stops.append(lone + np.int32(1))
        tokens.append(self.model.char_id[chars[lone]])
        start, stop, token = map(np.concatenate, (starts, stops, tokens))
        over = np.bincount(start + 1, minlength=len(chars) + 2) - np.bincount(stop, minlength=len(chars) + 2)
        begins = np.cumsum(over)[: len(chars)] == 0
        part = np.maximum.accumulate(np.where(begins, np.arange(len(chars), dtype=np.int32), 0))
        place = stop - part[stop - 1]
        order = np.argsort(place, kind="stable")
        start, stop, token, place = start[order], stop[order], token[order], place[order]
        cost = np.ones(len(token), np.int32)
        code = token - UNKNOWN
        cost[code >= 0] += (code[code >= 0] > 0x7F).astype(np.int32) + (code[code >= 0] > 0x7FF) + (code[code >= 0] > 0xFFFF)
        last, count = np.full(len(chars) + 1, START, np.int64), np.zeros(len(chars) + 1, np.int32)  # the last one: nothing before
        head = np.where(begins[start], len(chars), start - 1)
        bounds = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, t = head[lo:hi], token[lo:hi]
            ok = self._stand(last[s] << 21 | t)
            e = stop[lo:hi][ok] - 1
            last[e] = t[ok]
            count[e] = count[s[ok]] + cost[lo:hi][ok]
        return count[:-1], begins

    @property
    def known(self) -> dict[str, int]:
        return self._recent.now

    def learn(self, units: set[str]) -> None:
        """Makes sure that the counts of all units are known; older ones may be forgotten."""
        new = self._recent.missing(units)
        lo, held = 0, 0
        for k, u in enumerate(new):
            held += len(u)
            if held >= SLICE or k == len(new) - 1:
                count, first = self.prefix_counts(new[lo : k + 1])
                for u, n in zip(new[lo : k + 1], count[first[1:] - 1].tolist(), strict=True):
                    self._recent.put(u, n)
                lo, held = k + 1, 0

    def text_counts(self, text: str) -> np.ndarray:
        """The exact token count of text[:i] for every i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        units = self.model.units(text)
        distinct = list(dict.fromkeys(units))
        count, first = self.prefix_counts(distinct)
        where = {u: k for k, u in enumerate(distinct)}
        out, total = [np.zeros(1, np.int64)], 0
        for u in units:
            k = where[u]
            c = count[first[k] + 1 : first[k + 1]]
            out.append(c + total)
            total += int(c[-1])
        out = np.concatenate(out)[1:]  # the leading word mark is no character of the text
        out[0] = 0
        return out


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(load(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every text, one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                split = [c.model.units(t or "") for t in texts]
                c.learn(set().union(*split))
                known = c.known.__getitem__
                n_tokens = [sum(map(known, units)) for units in split]
                n_bytes = [len((t or "").encode()) for t in texts]
                columns = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(rows, run, rows.schema.simpleString().split(",text:")[0][7:] + ", n_bytes long, n_tokens long, over_limit boolean")


def prefix_token_counts(text: Column, model_path: str) -> Column:
    """array<int> of the token counts of all prefixes of a text, the empty one first; null: [0]."""

    @F.arrow_udf("array<int>")
    def counts(column: pa.Array) -> pa.Array:
        c = counter(model_path)
        return pa.array([c.text_counts(t.as_py() or "") for t in column], pa.list_(pa.int32()))

    return counts(text)


def truncate(docs: DataFrame, model_path: str, budget: int, text_col: str = "text", out_col: str = "truncated") -> DataFrame:
    """All columns, and the longest prefix of a text whose own token count is at most ``budget``, in place of a column of that name."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cut(column: pa.Array) -> pa.Array:
        c = counter(model_path)
        texts = (t for _, _, texts in pieces(column) for t in texts)
        return pa.array([None if t is None else t[: int(np.flatnonzero(c.text_counts(t) <= budget)[-1])] for t in texts], pa.string())

    return docs.withColumn(out_col, cut(F.col(text_col)))


def pack(counts: Column, budget: int) -> Column:
    """From the counts of all prefixes, the count of the longest prefix within a budget."""
    return F.array_max(F.filter(counts, lambda n: n <= budget))
