"""Cleans and encodes a corpus in stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of their input, whatever
their names, and judge every row by its own text: texts without letters or far from every learned language go, one
document of each group of near copies stays (five-word shingles, similarity 0.8), documents that hold a
benchmark window go, and secrets in texts are replaced, with n_chars brought up to date.  The last one encodes the
texts and returns doc_id, n_tokens and two digests.

Null and empty texts have no letters and go in the first stage.  Null and repeated ids stay as they are; of
repeated rows, as of all near copies, one stays: that of the smallest id, null ids last.  If no row has a lang,
nothing with a letter is rejected as foreign.  An empty table or benchmark gives an empty or unchanged result.
Texts of any length are read whole.  Tables lie in the shared folder named by spark.checkpoint.dir; those
between the stages are removed once the last stage is done.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from lsnframe.llm.components import cut
from lsnframe.llm.decontamination import keep_clean
from lsnframe.llm.language_id import keep_identified
from lsnframe.llm.near_dedup import keep_one
from lsnframe.llm.queries import piece_model, table
from lsnframe.llm.secrets import redacted
from lsnframe.llm.sentencepiece_codec import round_trip
from lsnframe.sources.storage import Storage, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, piece_model(), cache=48 << 20)  # beside what earlier stages left in executors


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("sentencepiece", encode),
]

#: Models and similarity joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder, with a written table in the shared folder between them."""
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        Storage(spark, folder).delete("")
