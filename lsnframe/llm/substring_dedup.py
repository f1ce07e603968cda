"""Removal of word windows that occur earlier in the corpus, by super-k-mers (operator 6).

Consecutive windows of a document that share their minimiser (the smallest hash among the runs of
``seed`` words in a window) travel as one packed string, a super-k-mer, to the bucket of that
minimiser.  Equal windows have equal minimisers, so they meet in one bucket, where sorting brings
them together and decides, word for word, which one starts first.

Before anything is sent, each chunk of a task settles its own repeats: a window that also starts
earlier in the same chunk is removed whatever else there is, and only the first one of each travels.
So a passage in a third of all documents reaches its bucket once for every chunk, not for every
document.  Of these super-k-mers the minimisers meet first, each one once a chunk with its count; only
super-k-mers whose minimiser another one has too travel as packed strings, compressed together for each
chunk and bucket.  A minimiser with more than ``hot`` super-k-mers would fill its bucket: their windows
travel on their own instead, by all of their words, and the first of each is found by an aggregate.

A null or empty text has no words.  Rows with a null id keep all their words and count for nobody.
Rows that share an id must be repeats of one row: a window never counts as earlier than itself, so
each gets the same result.  An empty table gives an empty result, texts of any length are read whole, and ids
are numbers or text of numbers (they are cast to long).  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces
from lsnframe.llm.components import cut
from lsnframe.llm.hashing import mix

#: Characters that settle their repeats together before anything is sent.
CHUNK = 4_000_000
_ODD = (mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode().split() if text else []


def _numbered(words: list[bytes]) -> tuple[np.ndarray, _Numbers]:
    numbers = _Numbers()
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), numbers


def _rolling(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of n values."""
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += h[j : j + size] * _ODD[seed + j]
    return mix(out)


def _leftmost_min(v: np.ndarray, n: int) -> np.ndarray:
    """The place of the smallest of every n values, the leftmost of equals."""
    at, width = np.arange(len(v)), 1
    while width < n:
        step = min(width, n - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        width += step
    return at


def _firsts(ids: np.ndarray, start: np.ndarray, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For windows at ``start`` of ids: whether none with the same words has a smaller (doc, place)."""
    seed = 0
    while True:
        h = _rolling(mix(ids.astype(np.uint64) + np.uint64(1)), n, seed)[start]
        order = np.lexsort((place, doc, h))
        s, same = start[order], np.zeros(len(start), bool)
        same[1:] = h[order][1:] == h[order][:-1]
        k = np.flatnonzero(same)
        equal = np.ones(len(k), bool)
        for j in range(n):
            equal &= ids[s[k] + j] == ids[s[k - 1] + j]
        if equal.all():
            break
        seed += n  # two different windows with one hash: other multipliers part them
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
    d, p = doc[order], place[order]
    first = np.empty(len(start), bool)
    first[order] = (d == d[head]) & (p == p[head])
    return first


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(breaks)
    return at, np.diff(np.append(at, len(breaks)))


def _marks(doc: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered word ranges [start, stop) of windows, one for each run of neighbours."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    at, size = _runs(new)
    return doc[at], place[at], place[at + size - 1] + n


def _pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    """Equally long arrays and a text, compressed."""
    head = np.array([len(arrays[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *(a.tobytes() for a in arrays), text]))


def _unpack(blob: bytes, *kinds: type) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out, raw[at:]


#: Minimiser, document, first word, windows and count of a super-k-mer; with 0 windows it stands for the
#: count ones of a chunk, which know already that they aren't alone.
_SEEDS = (np.uint64, np.int64, np.int32, np.int32, np.int32)
#: Document, first word, stop, minimiser, and whether it has one, of ranges that need no bucket.
_OWN = (np.int64, np.int32, np.int32, np.int64, np.bool_)


def _by_bucket(bucket: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket's rows, in order of ``second``."""
    order = np.lexsort((second, bucket))
    at, size = _runs(np.append(True, bucket[order][1:] != bucket[order][:-1])[: len(order)])
    for lo, n in zip(at.tolist(), size.tolist(), strict=True):
        yield int(bucket[order[lo]]), order[lo : lo + n]


def _bucket_of(seeds: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(seeds) % np.uint64(buckets)).astype(np.int64)


def _seeds(doc_ids: list[int], texts: list[str], window: int, seed: int, buckets: int) -> Iterator[tuple[int, bytes | None, bytes | None]]:
    """(bucket, packed super-k-mers without their words, None), and (any bucket, None, packed ranges that
    are settled within the chunk or wait for nobody to be found shared)."""
    words, lens = [], []
    for t in texts:
        w = words_of(t)
        words += w
        lens.append(len(w))
    lens = np.array(lens)
    off = np.append(0, np.cumsum(lens))
    windows = np.maximum(lens - window + 1, 0)
    if not windows.sum():
        return
    ids, numbers = _numbered(words)
    doc_of = np.repeat(np.arange(len(lens)), windows)
    place = np.arange(len(doc_of)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = off[doc_of] + place
    doc = np.array(doc_ids, np.int64)[doc_of]
    first = _firsts(ids, start, doc, place, window)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[ids]
    values = _rolling(hashes, seed)
    least = _leftmost_min(values, window - seed + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1) | (first[1:] != first[:-1])
    at, n = _runs(new)
    at, n = at[first[at]], n[first[at]]
    value = values[least[at]]
    _, which, count = np.unique(value, return_inverse=True, return_counts=True)
    twin = count[which] > 1
    d, a, b = _marks(doc[~first], place[~first], window)
    own = (
        np.append(d, doc[at[twin]]),
        np.append(a, place[at[twin]]),
        np.append(b, place[at[twin]] + n[twin]),
        np.append(np.zeros(len(d), np.int64), value[twin].view(np.int64)),
        np.arange(len(d) + twin.sum()) >= len(d),
    )
    if len(own[0]):
        yield int(_bucket_of(np.array(doc_ids[:1], np.int64).view(np.uint64), buckets)[0]), None, _pack(
            *(x.astype(k) for x, k in zip(own, _OWN, strict=True))
        )
    lead = np.zeros(len(value), bool)  # one of each minimiser stands for all of them
    lead[np.unique(value, return_index=True)[1]] = True
    value, at, n, twin, count = value[lead], at[lead], n[lead], twin[lead], count[which][lead]
    rows = (value, doc[at], place[at], np.where(twin, 0, n), count)
    for bucket, k in _by_bucket(_bucket_of(value, buckets), value):
        yield bucket, _pack(*(x[k].astype(t) for x, t in zip(rows, _SEEDS, strict=True))), None


def _shared(group: pa.Table, hot: int) -> pa.Table:
    """Of a bucket, the super-k-mers whose minimiser another one has too (seed), ranges settled already (no
    seed), and minimisers with more than ``hot`` super-k-mers (no document)."""
    parts = [_unpack(x, *_SEEDS)[0] for x in group.column("packed").to_pylist() if x] or [[np.zeros(0, t) for t in _SEEDS]]
    value, doc, place, n, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
    values, which = np.unique(value, return_inverse=True)
    total = np.bincount(which, count, len(values))
    k = np.flatnonzero((total[which] > 1) & (n > 0))
    much = values[total > hot].view(np.int64)
    known = [_unpack(x, *_OWN)[0] for x in group.column("own").to_pylist() if x] or [[np.zeros(0, t) for t in _OWN]]
    d, a, b, s, seeded = (np.concatenate([p[i] for p in known]) for i in range(5))
    seeds = np.concatenate((value[k].view(np.int64), s, much))
    none = np.concatenate((np.zeros(len(k), bool), ~seeded, np.zeros(len(much), bool)))
    gone = np.arange(len(seeds)) >= len(seeds) - len(much)
    column = lambda x, y, kind, mask: pa.array(np.concatenate((x, y, np.zeros(len(much), np.int64))).astype(kind), mask=mask)
    return pa.table(
        {
            "doc_id": column(doc[k], d, np.int64, gone),
            "start": column(place[k], a, np.int32, gone),
            "stop": column(place[k] + n[k], b, np.int32, gone),
            "seed": pa.array(seeds, mask=none),
        }
    )


def _settle(group: pa.Table, window: int) -> pa.Table:
    """Of a bucket of packed super-k-mers, the word ranges of windows that start earlier elsewhere."""
    parts = [_unpack(x, np.int64, np.int32, np.int32) for x in group.column("packed").to_pylist()]
    ids, _ = _numbered(b" ".join([p[1] for p in parts]).split(b" "))
    doc0, place0, size = (np.concatenate([p[0][i] for p in parts]).astype(np.int64) for i in range(3))
    n = size - window + 1
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = np.append(0, np.cumsum(size))[which] + step
    doc, place = doc0[which], place0[which] + step
    first = _firsts(ids, start, doc, place, window)
    d, a, b = _marks(doc[~first], place[~first], window)
    return pa.table({"doc_id": d.astype(np.int64), "start": a.astype(np.int32), "stop": b.astype(np.int32)})


#: Minimisers of so many super-k-mers are hot, and so many hot ones (8 bytes each) are broadcast.
HOT, MOST_HOT = 100_000, 1_000_000


def repeats(rows: DataFrame, window: int = 20, seed: int = 5, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, start, stop: word ranges covered by windows whose words also start earlier.

    rows: doc_id long, never null, and text.  First only the minimisers of super-k-mers meet; then
    those that share theirs with another one travel as packed strings."""
    buckets = buckets or max(64, 16 * rows.rdd.getNumPartitions())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1), CHUNK):
                out = list(_seeds(batch.column(0).slice(a, b - a).to_pylist(), texts, window, seed, buckets))
                columns = [
                    pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "packed", "own"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in pieces(batch.column(1), CHUNK):
                doc, place, size, value, packed = [], [], [], [], []
                ids, *spans = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 2, 3, 4))
                for d, text, starts, stops, seeds in zip(ids, texts, *spans, strict=True):
                    words = words_of(text)
                    for a, b, v in zip(starts, stops, seeds, strict=True):
                        doc.append(d)
                        place.append(a)
                        size.append(b - a + window - 1)
                        value.append(v)
                        packed.append(b" ".join(words[a : b + window - 1]))
                d, p, s, v = np.array(doc, np.int64), np.array(place, np.int32), np.array(size, np.int32), np.array(value, np.int64)
                out = [
                    (k, _pack(d[i], p[i], s[i], text=b" ".join([packed[j] for j in i.tolist()]))) for k, i in _by_bucket(
                        _bucket_of(v.view(np.uint64), buckets), v
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "packed"]
                )

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in pieces(batch.column(1), CHUNK // 16):
                out = []
                ids, *spans = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 2, 3))
                for d, text, starts, stops in zip(ids, texts, *spans, strict=True):
                    words = words_of(text)
                    out += [(b" ".join(words[p : p + window]), d, p) for a, b in zip(starts, stops, strict=True) for p in range(a, b)]
                columns = [
                    pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["words", "doc_id", "start"])

    def with_texts(spans: DataFrame) -> DataFrame:
        """Documents with a list of their spans; the rows get other names, so that their shuffle by id looks like
        the caller's and is done once."""
        each = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "seed")).alias("k")).select(
            "doc_id", "k.start", "k.stop", "k.seed"
        )
        again = rows.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).join(each, F.col("d") == F.col("doc_id"))
        return again.select("d", "t", "start", "stop", "seed")

    sent = mapped(rows, send, "bucket int, packed binary, own binary")
    found = cut(sent.groupBy("bucket").applyInArrow(lambda t: _shared(t, hot), "doc_id long, start int, stop int, seed long"))
    spans, much = found.where("seed IS NOT NULL AND doc_id IS NOT NULL"), found.where("doc_id IS NULL").select("seed")
    settled, few = found.where("seed IS NULL").select("doc_id", "start", "stop"), much.count()
    if few:
        much = F.broadcast(much) if few <= MOST_HOT else much
        windows = mapped(with_texts(spans.join(much, "seed", "left_semi")), lone, "words binary, doc_id long, start int")
        first = windows.groupBy("words").agg(
            F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")
        ).where("n > 1").select("words", "first")
        later = windows.join(first, "words").where(F.struct("doc_id", "start") != F.col("first"))
        settled = settled.unionAll(later.select("doc_id", "start", (F.col("start") + window).alias("stop")))
        spans = spans.join(much, "seed", "left_anti")
    travelling = mapped(with_texts(spans), strings, "bucket int, packed binary")
    return travelling.groupBy("bucket").applyInArrow(lambda t: _settle(t, window), "doc_id long, start int, stop int").unionAll(settled)


def remove_repeats(
    docs: DataFrame,
    window: int = 20,
    seed: int = 5,
    buckets: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = False,
    hot: int = HOT,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and the kept words (text) if asked for."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = base.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = repeats(known, window, seed, buckets, hot).groupBy("doc_id").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )
    none = F.lit(None).cast("array<int>")
    rows = known.join(found, "doc_id", "left").unionAll(
        base.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), "text", none.alias("starts"), none.alias("stops"))
    )
    kept_type = ", text string" if keep_text else ""

    def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_sha, kept = [], [], [], []
            for text, starts, stops in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                words = words_of(text)
                n_words.append(len(words))
                if starts:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, stops, -1)
                    left = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                    words = [words[i] for i in left]
                n_removed.append(n_words[-1] - len(words))
                out = b" ".join(words)
                kept_sha.append(sha256(out).hexdigest())
                if keep_text:
                    kept.append(None if text is None else out.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_sha, pa.string())] + [
                pa.array(kept, pa.string())
            ] * keep_text
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)

    return mapped(rows, kept_words, f"doc_id long, n_words long, n_removed long, kept_sha256 string{kept_type}")
