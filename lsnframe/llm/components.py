"""Connected components of an edge table: forests of single partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped
from lsnframe.sources.storage import checkpointed


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows in reliable checkpoint files in the shared folder, without lineage.

    Of so many rows as a shuffle has left (at most ``rows``), one file for each 50,000 is enough: every file costs
    the file system several calls, and the next stage a task."""
    return checkpointed(df if rows is None else df.coalesce(rows // 50_000 + 1))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Edges that a task makes a forest of, in the mean.
LOCAL = 200_000
#: Rows of one node that a task takes, as long as there are fewer than 50,000 times as many rows.
MOST = 256


def split_hubs(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """key and parts of the nodes with so many rows (column n of counts) that they go to several tasks.

    They may be broadcast: of ``rows`` rows at most 50,000 nodes can have more than a 50,000th."""
    most = max(MOST, rows // 50_000)
    return counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges but the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tolist() != root.tolist():
            root = up
    some = root != np.arange(len(ids))
    return ids[some], ids[root[some]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's edges; of a large partition, those of parts of it."""
    out = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    u = v = np.zeros(0, np.int64)
    for batch in batches:
        u, v = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate((u, v)))
        if len(u) > LOCAL:
            u, v = _forest(u, v)
        if len(u) > 4 * LOCAL:
            yield out(u, v)
            u = v = np.zeros(0, np.int64)
    if len(u):
        yield out(*_forest(u, v))


def _facts(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _beside_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """u, v and m, the smallest v of u, for every row.  A hub's rows are dealt into parts by v, and so is its
    smallest neighbour, so that no task gets all of them."""
    hubs = F.broadcast(split_hubs(least, "u", n))
    rows = rows.join(hubs, "u", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    return rows.join(least.join(hubs, "u", "left").select("u", "m", parts.alias("part")), ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """id, component (smallest id that can be reached) of every id of an edge that isn't a loop.

    First every partition of about ``local`` edges replaces its edges by a forest; if there is one partition,
    its trees are the components.  Otherwise stars follow: only minima are gathered for an id, never its list
    of neighbours, hubs are split, and every row count stays below twice the number of edges.  So neither a
    hub nor a long chain ends up in one task."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    tasks = max(1, -(-e.count() // local))
    e = cut(mapped(e.coalesce(tasks), _forests, "u long, v long"))
    if tasks > 1:
        last = _facts(e)
        while last[0]:
            n = 2 * last[0]
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _beside_least(both, _least(both), n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            least = _least(large)
            small = _beside_least(large, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
            now = _facts(e)
            if now == last:
                break
            last = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
