"""Benchmark decontamination with DataFrame functions only (operator 10).

The normalised windows of all benchmark items form a hash set that is broadcast.  A text is split into
words once; one hash for each *aligned* block of half a window finds the places worth a look (a window of
10 consecutive words always covers an aligned block of 5), and only there whole windows are compared, word
for word, with the broadcast windows.  No text leaves its task: after both joins a document is a few rows of
numbers.

A broadcast holds at most ``most_bytes``, which is checked: a larger benchmark is dealt by hash into parts
of that size, and the same scan is made once a part.

Null and empty texts have no words; items without words are ignored; an item with fewer than ``window``
words is one window of that length.  Item ids that are null count as hits but are not listed.  Repeated
rows give repeated results, an empty benchmark hits nothing, an empty table gives an empty result.  Texts of
any length are read whole.  Other columns of the inputs are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.components import cut, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of benchmark windows, and of their block hashes, that are broadcast at once.
MOST_BYTES = 64 << 20
#: Hashes of so many contaminated texts (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_GONE = 1_000_000


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after A-Z became a-z; null: no words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def benchmark_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """n (words of the window), window (its words joined by spaces), items (ids as strings)."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - n)
    each = w.select("item", n.alias("n"), F.explode(F.transform(starts, lambda s: F.array_join(F.slice(F.col("w"), s + 1, n), " "))).alias("window"))
    return each.groupBy("n", "window").agg(F.collect_set("item").alias("items"))


def _half(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("int")


def _blocks(windows: DataFrame) -> DataFrame:
    """Hashes of all runs of half a window in the windows, with the windows' length."""
    split = windows.select("n", _half(F.col("n")).alias("half"), F.split("window", " ").alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("half") + 1), lambda s: F.xxhash64("n", F.slice("w", s, F.col("half"))))
    return split.select(F.explode(runs).alias("block")).distinct()


def _parts(windows: DataFrame, most_bytes: int) -> tuple[list[DataFrame], list[int]]:
    """The windows in parts of at most about ``most_bytes`` each, and the lengths that occur."""
    own = F.octet_length("window") + F.coalesce(
        F.aggregate(F.col("items"), F.lit(0), lambda a, x: a + F.octet_length(x) + 16), F.lit(0)
    ) + 16 * F.col("n") + 64
    facts = windows.agg(F.sum(own).alias("bytes"), F.array_sort(F.collect_set("n")).alias("lengths")).first()
    many = -(-(facts.bytes or 0) // most_bytes)
    part = F.pmod(F.xxhash64("window"), F.lit(max(1, many)))
    return [windows.where(part == i) if many > 1 else windows for i in range(many)], list(facts.lengths)


def _looked_at(base: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """keys, s, n, items for every occurrence of a window, and one row with null s for every row of base.

    base: key columns and the words w.  Block numbers of all lengths follow each other in one sequence, whose
    last number stands for the row itself."""
    size, count, first = F.size("w"), F.lit(0), []
    for n in lengths:
        first.append(count)
        count = count + F.when(size >= n, F.floor(size / ((n + 1) // 2))).otherwise(0).cast("int")
    keys = [c for c in base.columns if c != "w"]
    rows = base.select(*keys, "w", count.alias("many"), F.explode(F.sequence(F.lit(0), count)).alias("i"))
    n, j = F.lit(None).cast("int"), F.lit(None).cast("int")
    for length, begin in zip(lengths, first, strict=True):
        n, j = F.when((F.col("i") >= begin) & (F.col("i") < F.col("many")), F.lit(length)).otherwise(n), F.when(
            (F.col("i") >= begin) & (F.col("i") < F.col("many")), F.col("i") - begin
        ).otherwise(j)
    rows = rows.select(*keys, "w", n.alias("n"), j.alias("j"))
    half = _half(F.col("n"))
    block = F.when(F.col("n").isNotNull(), F.xxhash64("n", F.slice("w", F.col("j") * half + 1, half)))
    known = F.broadcast(_blocks(windows).withColumn("known", F.lit(True)))
    rows = rows.withColumn("block", block).join(known, "block", "left").where("known OR n IS NULL")
    low, high = F.greatest(F.col("j") * half + half - F.col("n"), F.lit(0)), F.least(F.col("j") * half, F.size("w") - F.col("n"))
    rows = rows.select(*keys, "w", "n", F.explode_outer(F.sequence(low, high)).alias("s"))
    rows = rows.select(
        *keys, "n", "s", F.array_join(F.slice("w", F.coalesce(F.col("s"), F.lit(0)) + 1, F.coalesce(F.col("n"), F.lit(0))), " ").alias("window")
    )
    found = rows.join(F.broadcast(windows.select("window", "items")), "window", "left")
    return found.where("s IS NULL OR items IS NOT NULL").select(*keys, "s", "n", "items")


def _occurrences(base: DataFrame, benchmark: DataFrame, window: int, most_bytes: int) -> DataFrame:
    """keys, hits (start and length of each occurrence) and items (sorted ids) of every row of base."""
    windows = cut(benchmark_windows(benchmark, window))
    parts, lengths = _parts(windows, most_bytes)
    keys = [c for c in base.columns if c != "w"]
    none = base.select(
        *keys, F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<string>").alias("items")
    )
    found = reduce(DataFrame.unionAll, [_looked_at(base, p, lengths) for p in parts]) if parts else none
    hits = F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "n"))).alias("hits")
    return found.groupBy(*keys).agg(hits, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(hits: Column) -> Column:
    """How many words the occurrences cover, each counted once."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def grow(a: Column, x: Column) -> Column:
        end = x["s"] + x["n"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["s"]))).alias("n"))

    return F.aggregate(F.array_sort(hits), begin, grow, lambda a: a["n"])


def scan(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    Rows are numbered where they are read and meet again by that number.  That is the same number in every
    attempt of a task over files; rows that come out of a shuffle should be written first."""
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")
    ).withColumn("n_words", F.size("w"))
    per_row = _occurrences(base, benchmark, window, most_bytes)
    n_hit = _covered(F.col("hits")).cast("long")
    return per_row.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def _by_text(docs: DataFrame, text_col: str) -> tuple[Column, Column, DataFrame]:
    """128 bits that stand for a row's text, in two columns, and a frame of them with the words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    return one, two, docs.select(one.alias("_one"), two.alias("_two"), words(F.col(text_col)).alias("w"))


def _sent(found: DataFrame) -> DataFrame:
    """Rows of contaminated texts, to be sent to every task unless they are too many."""
    found = cut(found)
    return F.broadcast(found) if found.count() <= MOST_GONE else found


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows, with all their columns, in which no window of the benchmark occurs.

    A row's own text decides, whatever its id: rows are held against the 128-bit hashes of contaminated texts."""
    one, two, base = _by_text(docs, text_col)
    windows = cut(benchmark_windows(benchmark, window))
    parts, lengths = _parts(windows, most_bytes)
    if not parts:
        return docs
    gone = _sent(reduce(DataFrame.unionAll, [_looked_at(base, p, lengths).where("s IS NOT NULL").select("_one", "_two") for p in parts]).distinct())
    a, b = unused(docs, "one"), unused(docs, "two")
    gone = gone.select(F.col("_one").alias(a), F.col("_two").alias(b))
    return docs.join(gone, (one == F.col(a)) & (two == F.col(b)), "left_anti")


def _ranges(hits: Column) -> Column:
    """Covered word ranges (s, e), e exclusive, ascending and apart."""
    none = F.expr("CAST(array() AS array<struct<s: int, e: int>>)")

    def grow(a: Column, x: Column) -> Column:
        end, last = x["s"] + x["n"], F.element_at(a, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], end).alias("e"))
        alone = F.struct(x["s"].alias("s"), end.alias("e"))
        return F.when(
            (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))
        ).otherwise(F.concat(a, F.array(alone)))

    return F.aggregate(F.array_sort(hits), none, grow)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """All rows and columns; from a text in which windows of the benchmark occur their words are cut, and what
    stands between two words that are cut.  Other texts, null ones too, stay as they are."""
    one, two, base = _by_text(docs, text_col)
    hits = _sent(
        _occurrences(base, benchmark, window, most_bytes).where(F.size("hits") > 0).select("_one", "_two", _ranges(F.col("hits")).alias("gone"))
    )
    a, b, gone = unused(docs, "one"), unused(docs, "two"), unused(docs, "gone")
    hits = hits.select(F.col("_one").alias(a), F.col("_two").alias(b), F.col("gone").alias(gone))
    # words and what stands between them take turns
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    first = F.when(F.col(text_col).rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)

    def stays(_: Column, i: Column) -> Column:
        word = F.floor((i - first) / 2)
        between = F.pmod(i - first, F.lit(2))  # 1 for what stands after a word: it goes if both neighbours do
        return ~F.exists(F.col(gone), lambda r: (word >= r["s"]) & (word + between < r["e"]))

    left = F.array_join(F.filter(tokens, stays), "")
    return docs.join(hits, (one == F.col(a)) & (two == F.col(b)), "left").withColumn(
        text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)
    ).drop(a, b, gone)
