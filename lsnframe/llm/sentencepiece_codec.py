"""SentencePiece encoding and decoding over DataFrames (operator 2).

Nulls count as empty texts; an empty text has no tokens and decodes to the empty string.  Repeated
rows give repeated results, other columns of the input are not read, a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces, small_batches
from lsnframe.llm.hashing import Recent
from lsnframe.llm.piece_model import SLICE, PieceModel, load


#: Bytes of encoded units that a worker remembers.
CACHE = 128 << 20


class Codec:
    """Encodes texts through a cache of encoded units of about ``most`` bytes."""

    def __init__(self, model: PieceModel, most: int = CACHE) -> None:
        self.model = model
        #: unit -> (ids as text, decoded bytes)
        self._recent = Recent(most)
        self._names = [str(i) for i in range(len(model.pieces))]

    @property
    def known(self) -> dict[str, tuple[str, bytes]]:
        return self._recent.now

    def learn(self, units: set[str]) -> None:
        """Makes sure that all units are known; older ones may be forgotten."""
        new = self._recent.missing(units)
        lo, held = 0, 0
        for k, u in enumerate(new):
            held += len(u)
            if held >= SLICE or k == len(new) - 1:
                ids, offsets = self.model.encode_ids(new[lo : k + 1])
                ids, at = ids.tolist(), offsets.tolist()
                names, pieces = [self._names[i] for i in ids], [self.model.bytes_of[i] for i in ids]
                for j, u in enumerate(new[lo : k + 1]):
                    self._recent.put(u, (",".join(names[at[j] : at[j + 1]]), b"".join(pieces[at[j] : at[j + 1]])))
                lo, held = k + 1, 0

    def joined(self, units: list[str]) -> str:
        """The ids of known units, comma-joined."""
        known = self.known
        return ",".join([known[u][0] for u in units])

    def encode(self, text: str) -> list[int]:
        units = self.model.units(text)
        self.learn(set(units))
        return [int(i) for i in self.joined(units).split(",")] if units else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for word marks but the leading one, bytes joined as UTF-8."""
        return self.model.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, most: int = CACHE) -> Codec:
    if (path, most) not in _codecs:
        _codecs[path, most] = Codec(load(path), most)
    return _codecs[path, most]


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """id, n_tokens, SHA-256 of the comma-joined ids and of the decoded text, one row per input row."""
    schema = f"{docs.select(F.col(id_col).alias('doc_id')).schema.simpleString()[7:-1]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, cache)
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                counts, ids_sha, decoded_sha = [], [], []
                split = [c.model.units(t or "") for t in texts]
                c.learn(set().union(*split))
                known = c.known
                for units in split:
                    ids = c.joined(units)
                    counts.append(ids.count(",") + 1 if units else 0)
                    ids_sha.append(sha256(ids.encode()).hexdigest())
                    text = b"".join([known[u][1] for u in units]).decode("utf-8", "replace").removeprefix(" ")
                    decoded_sha.append(sha256(text.encode()).hexdigest())
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All columns of the input and the token ids of a text as array<int>, in place of a column of that name."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.array([c.encode(t or "") for _, _, texts in pieces(column) for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode(tokens: DataFrame, model_path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """All columns and the text of an array of token ids, in place of a column of that name; null ids give the empty text."""
    small_batches(tokens.sparkSession)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.array([c.decode(x.as_py() or []) for x in column], pa.string())

    return tokens.withColumn(out_col, text(F.col(ids_col)))
