"""Near-duplicate documents by SetSketch registers (operator 7).

A document's set of word shingles becomes ``m`` SetSketch registers: for each of m hash functions
the smallest of the set's exponentially distributed values, kept as a truncated power of the base b.
Registers of unions are maxima of registers, and equal registers are likely for similar sets, so
bands of registers serve as keys.  Documents with equal sets form a class; only one of each class
goes on.  Candidates of a band key are judged by the joint maximum likelihood of the counts of
larger, smaller and equal registers, and what passes (with five standard errors of slack) is
confirmed on the full sets.

A key with many documents never yields all its pairs.  First every document is held against the
likeliest of its keys' smallest documents.  Then keys whose documents still lie in several components are looked
at again, in blocks and with every document's shingles in 32 bits, for links that join components: the
documents of a key's largest component only against all others.  This is repeated, without pairs that failed
on the full sets, until no key has such a link.

With 24 bands of 4 registers a pair at similarity 0.8 is missed with probability 3e-6.

Null and empty texts have empty sets and link with nothing.  Rows with a null id take no part (their
component is null, they are kept).  Repeated rows get one component; an empty table gives an empty result.
Texts of any length are read whole.  Ids are numbers or text of numbers (they are cast to long).  Other columns
are not read, and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, packed, pieces, unpacked
from lsnframe.llm.components import components, cut, split_hubs
from lsnframe.llm.hashing import mix

BASE, RATE, LAST = 1.02, 20.0, 65534
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
_ODD = (mix(np.arange(1, REGISTERS + 2, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
_PLACE = (mix(np.arange(9001, 9065, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
#: Documents of a key are compared in blocks of this many.
BLOCK = 500
#: Up to so many ids (8 bytes each) are sent to every task; more are joined by a shuffle.
MOST_SENT = 1_000_000


def _sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending within a text, and the texts' offsets."""
    words, lens = [], []
    for t in texts:
        w = t.encode().lower().split() if t else []  # bytes: A-Z and ASCII white space only
        words += w
        lens.append(len(w))
    lens = np.array(lens, np.int64)
    seen: dict[bytes, int] = dict.fromkeys(words, 0)
    for w in seen:
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    off = np.append(0, np.cumsum(lens))
    n = np.where(lens >= k, lens - k + 1, (lens > 0).astype(np.int64))
    of = np.repeat(np.arange(len(lens)), n)
    start = off[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(lens[of], k)
    h = np.append(h, np.zeros(k, np.uint64))
    s = size.astype(np.uint64)
    for j in range(k):
        s = s + np.where(j < size, h[start + j] * _PLACE[j], np.uint64(0))
    s = mix(s)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=len(lens))))


def _registers(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint16 registers of each set, zeros for empty sets."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    least = np.empty((len(full), REGISTERS))
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((s ^ (s >> np.uint64(29))) * _ODD[i], off[full])
    x = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LAST + 1)
    return out


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash, registers and bands (null for an empty set) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                s, off = _sets(texts, k)
                regs = _registers(s, off)
                bands = np.empty((len(regs), BANDS), np.uint64)
                for i in range(BANDS):
                    part = regs[:, i * ROWS : (i + 1) * ROWS].astype(np.uint64)
                    bands[:, i] = mix(
                        part[:, 0] | part[:, 1] << np.uint64(16) | part[:, 2] << np.uint64(32) | part[:, 3] << np.uint64(48)
                    ) * _ODD[-1] + np.uint64(i)
                n = np.diff(off)
                hashes = [xxhash.xxh3_128_digest(s[off[i] : off[i + 1]].tobytes()) if n[i] else None for i in range(len(n))]
                keys = [list(x) if c else None for x, c in zip(mix(bands).view(np.int64).tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(hashes, pa.binary()),
                        packed(regs),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "registers", "bands"],
                )

    return mapped(rows, run, "doc_id long, n_shingles long, set_hash binary, registers binary, bands array<long>")


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches with known set sizes, by joint maximum likelihood."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    u, v = nx / (nx + ny), ny / (nx + ny)
    p = lambda z: -np.log1p(-np.clip(z, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave in j
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = value(a) < value(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def _slack(similarity: float) -> float:
    return similarity - 5 * (similarity * (1 - similarity) / REGISTERS) ** 0.5


def _matrix(column: pa.Array) -> np.ndarray:
    return unpacked(column, np.uint16).reshape(-1, REGISTERS)


def _beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs x, y with the columns of both documents (doc_id and others), their names ending in x and y.

    A document y that many others are held against is dealt into parts, so that no task gets all of them."""
    others = [c for c in rows.columns if c != "doc_id"]
    side = lambda c: rows.select(F.col("doc_id").alias(c), *[F.col(o).alias(o + c) for o in others])
    hubs = F.broadcast(split_hubs(pairs.groupBy("y").agg(F.count("*").alias("n")), "y", pairs.count()))
    part = F.coalesce(F.pmod(F.xxhash64("x"), F.col("parts")), F.lit(0)).cast("int")
    first = pairs.join(hubs, "y", "left").select("x", "y", part.alias("part")).join(side("x"), "x")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    second = side("y").join(hubs, "y", "left").select("y", *[o + "y" for o in others], parts.alias("part"))
    return first.join(second, ["y", "part"])


def _likely(pairs: DataFrame, unique: DataFrame, percent: int) -> DataFrame:
    """The pairs that size and likelihood leave, and their estimated similarity."""
    both = _beside(pairs, unique.select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), F.col("registers").alias("r")))
    both = both.where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)").select("x", "y", "nx", "ny", "rx", "ry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j = estimate(_matrix(b.column(4)), _matrix(b.column(5)), b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j)], ["x", "y", "j"]).filter(
                    pa.array(j >= _slack(percent / 100))
                )

    return mapped(both, run, "x long, y long, j double")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs x, y whose full sets have 100 * intersection >= percent * union."""
    ids = cut(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), 2 * pairs.count())
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                s, off = _sets(texts, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s[off[i] : off[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    ["doc_id", "s"],
                )

    sets = mapped(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), make, "doc_id long, s binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((p, q)), kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                ok.append(100 * n >= percent * (len(p) + len(q) - n))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return mapped(_beside(pairs, sets.select("doc_id", "s")).select("x", "y", "sx", "sy"), check, "x long, y long")


def _named(shared: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed documents with their components, and the keys that still hold several of these: the largest
    component (main), and into how many blocks its documents and all others are dealt."""
    named = shared.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    sizes = named.groupBy("key", "band", "component").agg(F.count("*").alias("size"))
    still = sizes.groupBy("key", "band").agg(
        F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("n"), F.count("*").alias("parts")
    ).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    return named, still.select(
        "key",
        "band",
        F.col("top.component").alias("main"),
        blocks(F.col("top.size")).alias("majors"),
        blocks(F.col("n") - F.col("top.size")).alias("minors"),
    )


def _short(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """rep and its shingles in 32 bits each: what these share bounds what the sets share, and hardly
    ever differs from it."""
    ids = cut(ids)
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                s, off = _sets(texts, k)
                s = (s >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s[off[i] : off[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    ["rep", "short"],
                )

    rows = docs.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return mapped(rows, make, "rep long, short binary")


def _forest(t: pa.Table, percent: int) -> pa.Table:
    """Of one key's documents (or two blocks of them), likely links that join components, no more than
    it takes: once two components are joined here, their other pairs are passed over."""
    lo, hi, own, band = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("own").to_numpy(), t.column("band")[0].as_py()
    rep, n = (t.column(c).to_numpy() for c in ("rep", "n_shingles"))
    _, comp = np.unique(t.column("component").to_numpy(), return_inverse=True)
    regs = _matrix(t.column("registers"))
    by_band = regs.reshape(len(regs), BANDS, ROWS)
    flat = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("short")]
    values, numbers = np.unique(np.concatenate(flat), return_inverse=True)
    short = np.split(numbers, np.cumsum([len(x) for x in flat])[:-1])
    failed = [set(f or ()) for f in t.column("failed").to_pylist()]
    left = np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    fewest = int(REGISTERS * percent / 100 - 6 * (REGISTERS * percent / 100 * (1 - percent / 100)) ** 0.5)
    mine = np.zeros(len(values), bool)
    xs, ys = [], []
    for i in left.tolist():
        j = right[rep[right] > rep[i]] if lo == hi else right
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if failed[i]:
            j = j[[r not in failed[i] for r in rep[j].tolist()]]
        if len(j):
            j = j[(regs[j] == regs[i]).sum(1) >= fewest]
        if len(j) and band:  # pairs that share an earlier band meet there
            j = j[~(by_band[j, :band] == by_band[i, :band]).all(2).any(1)]
        if len(j):
            j = j[
                estimate(regs[j], np.broadcast_to(regs[i], regs[j].shape), n[j].astype(float), np.full(len(j), float(n[i]))) >= _slack(percent / 100)
            ]
        if not len(j):
            continue
        mine[short[i]] = True
        both = np.array([np.count_nonzero(mine[short[q]]) for q in j.tolist()])
        mine[short[i]] = False
        near = 100 * both >= percent * (n[j] + n[i] - both)
        for q in j[near][np.argsort(-both[near] / (n[j][near] + n[i] - both[near]), kind="stable")].tolist():
            if comp[q] != comp[i]:
                comp[comp == comp[q]] = comp[i]
                xs.append(rep[i])
                ys.append(rep[q])
    return pa.table({"x": pa.array(np.array(xs, np.int64)), "y": pa.array(np.array(ys, np.int64))})


def _across(named: DataFrame, still: DataFrame, unique: DataFrame, short: DataFrame, failed: DataFrame | None, percent: int) -> DataFrame:
    """Likely links between components that share a key."""
    rows = named.join(still, ["key", "band"]).join(unique.select("rep", "n_shingles", "registers"), "rep").join(short, "rep")
    if failed is None:
        rows = rows.withColumn("failed", F.lit(None).cast("array<long>"))
    else:
        both = failed.unionAll(failed.select("y", "x")).groupBy(F.col("x").alias("rep")).agg(F.collect_set("y").alias("failed"))
        rows = rows.join(both, "rep", "left")
    # documents of the main component are never held against each other, so each is dealt once for every
    # block of the others, and the others for every block
    major, every = F.col("component") == F.col("main"), F.col("majors") + F.col("minors")
    own = F.when(major, F.pmod(F.xxhash64("rep"), F.col("majors"))).otherwise(
        F.col("majors") + F.pmod(F.xxhash64("rep"), F.col("minors"))
    ).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(major, F.col("majors")).otherwise(0), every - 1)))
    rows = rows.select(
        "key",
        "band",
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        "own",
        "rep",
        "component",
        "n_shingles",
        "registers",
        "short",
        "failed",
    )
    return rows.groupBy("key", "band", "lo", "hi").applyInArrow(lambda t: _forest(t, percent), "x long, y long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = cut(sketches(docs, k))
    n = base.count()
    members = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash")
    classes = cut(members.agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), n)
    unique = base.join(
        classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"
    ).where("n_shingles > 0").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    keyed = unique.select("rep", F.posexplode("bands").alias("band", "key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(leaders.select("key", "leader"), "key").select("key", "band", "rep", "leader"), BANDS * n)
    led = cut(shared.where("rep <> leader").select(F.col("rep").alias("x"), F.col("leader").alias("y")).distinct(), BANDS * n)
    stars = _likely(led, unique, percent)
    # one leader for each document is enough to begin with: what else it links with is found across components
    to_leader = cut(stars.groupBy("x").agg(F.max(F.struct("j", -F.col("y"))).alias("top")).select("x", (-F.col("top.col2")).alias("y")), n)
    links = cut(_confirm(to_leader, docs, k, percent))
    found = components(links, "x", "y")
    named, still = _named(shared, found)
    short, failed = None, None
    while True:
        still = cut(still, BANDS * n)
        if still.isEmpty():
            break
        if short is None:  # keys only ever close, so later rounds need no others
            short = cut(_short(docs, named.join(still, ["key", "band"]).select("rep").distinct(), k))
        across = cut(_across(named, still, unique, short, failed, percent).distinct(), n)
        if across.isEmpty():
            break
        more = cut(_confirm(across, docs, k, percent))
        wrong = across.exceptAll(more)
        links = cut(links.unionAll(more), 2 * n)
        found = components(links, "x", "y")
        wrong = cut(wrong, n)
        if wrong.isEmpty():  # every pair passed over lies in one component, every other one was judged
            break
        failed = cut(wrong if failed is None else failed.unionAll(wrong), 2 * n)
        named, still = _named(shared, found)
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").where("members > 1 OR component IS NOT NULL").select(
        "set_hash", F.coalesce("component", "rep").alias("component")
    )
    out = base.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest id, null ids last.

    Where ids are null or repeated, rows are numbered and compared by their numbers."""
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if ids.where("id IS NULL OR n > 1").isEmpty():
        gone = near_duplicates(docs, k, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col))
        return docs.join(gone, docs[id_col].cast("long") == gone[id_col], "left_anti")
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.struct("*").alias("doc"), F.col(text_col).alias("text")
        )
    )
    found = near_duplicates(rows, k, percent, "row", "text").select(F.col("doc_id").alias("row"), "component_id")
    first = rows.select("row", "id").join(found, "row").groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    ).select("first.row")
    return rows.join(first, "row", "left_semi").select("doc.*")
