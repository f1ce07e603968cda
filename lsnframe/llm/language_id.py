"""Language identification by rank-order profiles (operator 5).

A language's profile is the list of its most frequent character n-grams (1 to 3 characters of
lower-cased text, every run of non-letters one blank).  A document's own most frequent n-grams are
held against each profile: an n-gram counts the distance between its two ranks, one that the profile
lacks counts the profile's length.  The language with the smallest sum wins (ties: the smallest
name); the score is how much smaller it is than the next one's sum, from 0 to 1.

Profiles are learned from labelled rows only, from about ``per_language`` of them for each label,
picked by a hash of the id; whole texts are counted.  Every label is learned.  More than
``most_languages`` different ones raise ValueError: profiles are held in memory, and the column is then
no language.

Null, empty or letterless texts are "und" with score 0, and so is every text if nothing could be learned.
A text of any length is read whole, SLICE characters at a time.  Repeated rows give repeated results, an
empty table gives an empty one.  Other columns are not read; a function that returns all columns replaces
those of the names it adds.

As a filter, a text stays if it has a letter and its smallest distance is at most ``FARTHEST`` of the
largest possible one.  Against profiles that are full, documents of the four languages reach 0.633 on
sf0.1 and 0.679 on check_s, single words 0.709; random letters, base64 and hex of 100 characters or bytes begin
at 0.752.  Shorter random ones overlap with words and may stay.  A profile shorter than ``size``
comes from too little text to reject what is nearest to it, and without profiles nothing with a
letter is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces, small_batches
from lsnframe.llm.components import unused

UNKNOWN = "und"
#: Characters of a text that are counted together.
SLICE = 1 << 18
#: Limit of the filter, as a share of the distance of a text that has no n-gram of the profile.
FARTHEST = 0.72
_BLANK = 0x20


def _letters() -> np.ndarray:
    table = np.full(0x110000, _BLANK, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


_table: list[np.ndarray] = []


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and their counts; none if it has no letter."""
    if not _table:
        _table.append(_letters())
    low = text.lower()
    tail, found, counts = np.array([_BLANK], np.int64), [], []
    for k in range(0, len(low), SLICE):
        c = _table[0][np.frombuffer(low[k : k + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate((tail, c, [_BLANK] if k + SLICE >= len(low) else []), dtype=np.int64, casting="unsafe")
        new = np.append(True, (c[1:] != _BLANK) | (c[:-1] != _BLANK))
        c = c[new]
        had = len(tail)  # n-grams that end there were counted before
        two = c[:-1] << 21 | c[1:]
        three = two[:-1] << 21 | c[2:]
        one = c[had:]
        codes, n = np.unique(np.concatenate((one[one != _BLANK], two[had - 1 :], three[max(0, had - 2) :])), return_counts=True)
        found.append(codes)
        counts.append(n)
        tail = c[-2:]
    if len(found) > 1:
        codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), len(codes)).astype(np.int64)
    elif not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not (codes < 0x110000).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return codes, n


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, smaller codes first among equals."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """One rank list for each language."""

    def __init__(self, lists: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(lists), size
        self.codes = np.unique(np.concatenate([np.array(x, np.int64) for x in lists.values()] or [np.zeros(0, np.int64)]))
        self.full = [len(lists[name]) >= size for name in self.names]
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, np.array(lists[name], np.int64))] = np.arange(len(lists[name]))

    def _away(self, top: np.ndarray) -> np.ndarray:
        """The out-of-place distance of ranked codes to every profile."""
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at = np.where(self.codes[at] == top, at, len(self.codes))
        r = self.ranks[:, at]
        return np.where(r < 0, self.size, np.abs(r - np.arange(len(top)))).sum(1)

    def identify(self, text: str | None) -> tuple[str, float]:
        top = ranked(*grams(text), self.size) if text else []
        if not len(top) or not self.names:
            return UNKNOWN, 0.0
        away = self._away(top)
        best = int(np.argmin(away))
        if len(away) == 1:
            return self.names[0], float(1 - away[0] / (self.size * len(top)))
        second = int(np.partition(away, 1)[1])
        return self.names[best], float(1 - away[best] / second) if second else 0.0

    def near(self, text: str | None, farthest: float = FARTHEST, wanted: set[str] | None = None) -> bool:
        """Whether a text has a letter, is no farther from the nearest profile than the limit, and that profile is wanted."""
        top = ranked(*grams(text), self.size) if text else []
        if not len(top):
            return False
        if not self.names:
            return True
        away = self._away(top)
        best = int(np.argmin(away))
        if wanted is not None and self.names[best] not in wanted:
            return False
        return not self.full[best] or bool(away[best] <= farthest * self.size * len(top))


def held_out(id_: Column) -> Column:
    """Rows whose CRC-32 of the id as text leaves remainder 2 by 4: never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, per_language: int = 1500, size: int = 300, most_languages: int = 10_000) -> Profiles:
    """Profiles from the columns id, text and label of all rows given."""
    rows = labelled.where("label IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").select("id", "text", "label")
    share = [
        (r.label, min(1.0, per_language / r["n"])) for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    ]
    if len(share) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not share:
        return Profiles({}, size)
    parts = labelled.sparkSession.createDataFrame(share, "label string, part double")  # most_languages rows at most
    drawn = rows.join(F.broadcast(parts), "label").where(
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("part") * 1_000_000
    ).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
                for label, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, strict=True):
                    by.setdefault(label, []).append(grams(text))
                for label, found in by.items():
                    codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["label", "code", "n"]
                    )

    counted = mapped(drawn, count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    lists: dict[str, list[int]] = {}
    for r in top.orderBy("label", "rank").collect():
        lists.setdefault(r.label, []).append(r.code)
    return Profiles(lists, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """All columns of the input and language (string) and language_score (double)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("lang string, score double")
    def guess(column: pa.Array) -> pa.Array:
        found = [profiles.identify(t) for _, _, texts in pieces(column) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in found], pa.string()), pa.array([g[1] for g in found], pa.float64())], ["lang", "score"]
        )

    name = unused(docs, "found")
    found = docs.withColumn(name, guess(F.col(text_col)))
    return found.withColumns({"language": F.col(f"{name}.lang"), "language_score": F.col(f"{name}.score")}).drop(name)


def predict(
    docs: DataFrame, per_language: int = 1500, size: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that aren't held out."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.col(label_col).alias("label")
    )
    profiles = learn(base.where("NOT held_out").select(F.col("doc_id").alias("id"), "text", "label"), per_language, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(2)):
                got = [profiles.identify(t) for t in texts]
                columns = [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(base.select("doc_id", "held_out", "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, per_language: int = 1500, size: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", farthest: float = FARTHEST, languages: list[str] | None = None
) -> DataFrame:
    """The rows, with all their columns, that have letters, lie near a learned language (all with letters
    if none was learned) and, if ``languages`` are given, are nearest to one of these."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    profiles = learn(rows.where(~held_out(F.col("id"))), per_language, size)
    wanted = None if languages is None else set(languages)
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def known(column: pa.Array) -> pa.Array:
        return pa.array([profiles.near(t, farthest, wanted) for _, _, texts in pieces(column) for t in texts], pa.bool_())

    return docs.where(known(F.col(text_col)))
