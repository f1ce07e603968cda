"""Near-duplicate vectors by a pivot-permutation index (operator 4).

A vector is described by the ordered list of its nearest pivots.  Inverted lists hold, for every two
pivots, the vectors that have both among their first ``nearest``; so two vectors meet exactly if they
share two pivots at least, and the pair is dealt with only in the list of the two smallest pivots it
shares.  What meets is counted: every shared pivot counts the more the nearer it is to both (the
product of ``nearest`` less its two places), and pairs whose count is at least ``least`` of
``nearest`` squared are verified by cosine in double precision.

Pivots are chosen by farthest-first traversal from a sample of ``sample`` vectors, or of twice as many as
there are pivots; every vector is indexed.  There are 128 pivots for up to 200,000 vectors, and twice as
many for each four times as many vectors, without an upper limit, so lists grow with the square root of the
table; every second doubling takes one more nearest pivot, so that the share of pairs that are found stays
the same (README has the measured ones).  Vectors of each length have an index of their own.

Equal vectors form a class of which one is indexed.  Lists longer than ``block`` are compared in
blocks, and a list yields sums of links and one edge for each vector, never its pairs.

Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null id link
with nothing, nor do vectors of different lengths with each other.  Repeated rows are vectors of
their own, an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, packed, unpacked
from lsnframe.llm.components import components, cut


#: The lengths of so many lists (12 bytes each) are broadcast; more are joined by a shuffle.
MOST_LISTS = 1_000_000


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first unit vectors from a sample."""
    sample = sample / np.linalg.norm(sample, axis=1)[:, None]
    chosen = [0]
    best = sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        i = int(np.argmin(best))
        if best[i] > 0.999999:
            break
        chosen.append(i)
        best = np.maximum(best, sample @ sample[i])
    return sample[chosen]


def index_size(rows: int) -> tuple[int, int]:
    """Pivots and nearest pivots for so many vectors."""
    doublings = 0
    while rows > 200_000 * 4**doublings:
        doublings += 1
    return 128 << doublings, 7 + (doublings + 1) // 2


def ordered(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of unit vectors, nearest first, smaller numbers first among equals."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :nearest]


def _weights(order: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each vector and pivot of ``columns`` its nearness: the list's length less its place, or 0."""
    out = np.zeros((len(order), len(columns)), np.float32)
    np.put_along_axis(out, np.searchsorted(columns, order), np.broadcast_to(np.arange(order.shape[1], 0, -1, dtype=np.float32), order.shape), 1)
    return out


def _linked(
    x: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray, pair: tuple[int, int], threshold: float, least: float
) -> np.ndarray:
    """Which vectors of left and right are linked, if the two pivots are the smallest ones they share."""
    columns = np.unique(order[np.concatenate((left, right))])
    a, b = _weights(order[left], columns), _weights(order[right], columns)
    hit = a @ b.T >= least * order.shape[1] ** 2
    if not hit.any():
        return hit
    smaller = (columns < pair[1]) & (columns != pair[0])
    hit &= (a[:, smaller] > 0).astype(np.float32) @ (b[:, smaller] > 0).astype(np.float32).T == 0
    some, other = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit[np.ix_(some, other)] &= x[left[some]] @ x[right[other]].T >= threshold
    return hit


def _links(t: pa.Table, threshold: float, least: float, kind: str, pivots: int) -> pa.Table:
    """Sums of links, and the smallest vector linked with, of the vectors of some lists or pairs of blocks of them."""
    key, lo, hi, own = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own"))
    rep, size = t.column("rep").to_numpy(), t.column("size").to_numpy().astype(float)
    order, x = unpacked(t.column("perm"), np.uint32), unpacked(t.column("vector"), kind).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    a = np.lexsort((rep, hi, lo, key))
    new = np.ones(len(a), bool)
    new[1:] = (key[a][1:] != key[a][:-1]) | (lo[a][1:] != lo[a][:-1]) | (hi[a][1:] != hi[a][:-1])
    bounds = np.append(np.flatnonzero(new), len(a)).tolist()
    reps, counts, roots = [], [], []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        rows = a[i:j]
        one = lo[rows[0]] == hi[rows[0]]
        left = rows if one else rows[own[rows] == lo[rows[0]]]
        right = rows if one else rows[own[rows] == hi[rows[0]]]
        if not len(left) or not len(right) or (one and len(rows) < 2):
            continue
        hit = _linked(x, order, left, right, divmod(int(key[rows[0]]), pivots), threshold, least)
        if one:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        both = left if one else np.concatenate((left, right))
        sums = hit @ size[right] if one else np.concatenate((hit @ size[right], hit.T @ size[left]))
        label = np.arange(len(both))
        while True:
            old = label.copy()
            if one:
                label = np.minimum(label, np.where(hit, label[None, :], len(label)).min(1))
            else:
                n = len(left)
                label[:n] = np.minimum(label[:n], np.where(hit, label[None, n:], len(label)).min(1))
                label[n:] = np.minimum(label[n:], np.where(hit, label[:n, None], len(label)).min(0))
            label = label[label]
            if (label == old).all():
                break
        some = sums > 0
        reps.append(rep[both][some])
        counts.append(sums[some].astype(np.int64))
        roots.append(rep[both][label][some])
    empty = [np.zeros(0, np.int64)]
    return pa.table({"rep": np.concatenate(reps + empty), "links": np.concatenate(counts + empty), "root": np.concatenate(roots + empty)})


_FOUND = "rep long, links long, root long"


def _found(classes: DataFrame, dims: int, n: int, threshold: float, pivots: int, nearest: int, least: float, sample: int, block: int) -> DataFrame:
    """Sums of links and edges between n distinct vectors of one length."""
    drawn = [r.vector for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(max(sample, 2 * pivots)).select("vector").collect()]
    at = choose_pivots(np.array(drawn, float), pivots)
    kind = "float32" if "float" in classes.schema["vector"].dataType.simpleString() else "float64"
    near, count = min(nearest, len(at)), len(at)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
            y = x.astype(np.float64)
            order = ordered(y / np.linalg.norm(y, axis=1)[:, None], at, near)
            i, j = np.triu_indices(near, 1)
            two = np.sort(order, axis=1)
            keys = two[:, i] * count + two[:, j] if near > 1 else np.zeros((len(two), 1), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.astype(np.int64).ravel()))
            columns = [b.column(1), b.column(2), packed(order.astype(np.uint32)), packed(x), lists]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "size", "perm", "vector", "keys"])

    posted = cut(mapped(classes.select("vector", "rep", "size"), post, "rep long, size long, perm binary, vector binary, keys array<long>"))
    each = posted.select(F.explode("keys").alias("key"), "rep", "size", "perm", "vector")
    lists = posted.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select(
        "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")
    )
    if count * (count - 1) // 2 <= MOST_LISTS:  # there are no more lists than pairs of pivots
        lists = F.broadcast(lists)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = each.join(lists, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "size", "perm", "vector", "blocks"
    )
    task = F.when(F.col("blocks") > 1, F.xxhash64("key", "lo", "hi")).otherwise(F.pmod(F.xxhash64("key"), F.lit(max(64, n // 500))))
    return cut(dealt.withColumn("task", task).drop("blocks").groupBy("task").applyInArrow(lambda t: _links(t, threshold, least, kind, count), _FOUND))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, pivots: int | None = None, nearest: int | None = None, least: float = 0.35,
    sample: int = 4096, block: int = 1000, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col("vector")
    good = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(
            v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        ) & F.exists(v, lambda c: c != 0),
        F.lit(False),
    )
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).withColumn("vector", F.when(good, v))
    classes = cut(base.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("size")))
    result = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if classes.isEmpty():
        return result
    found = vectors.sparkSession.createDataFrame([], _FOUND)
    # one vector alone in its length has nothing to meet
    for r in classes.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dims").collect():
        count, near = index_size(r.n)
        found = found.unionAll(
            _found(classes.where(F.size("vector") == r.dims), r.dims, r.n, threshold, pivots or count, nearest or near, least, sample, block)
        )
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select("rep", "root"), "rep", "root").select(F.col("id").alias("rep"), "component")
    named = classes.join(sums, "rep", "left").join(parts, "rep", "left").where("size > 1 OR links IS NOT NULL").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    out = base.join(named, "vector", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
