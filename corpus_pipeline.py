"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again.

Stages keep what is clean: language ID drops texts without letters or without a clear language,
SimHash near-dedup keeps one document of each group, substring dedup cuts later copies of
20-word passages (and documents that consist of them), mixing takes each document as often as
its source's quota gives, and the last stage encodes the texts as pieces.

Defined results: null texts count as empty and go with the first stage; null ids are kept and come last among equals;
rows that repeat an id and text count once after near-dedup; ties go to the smaller doc_id; all further columns, whatever their
names, are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, pieces, simhash, substring
from corpusloom.llm.common import named, shared_folder
from corpusloom.llm.queries import PIECE_MODEL

#: Documents whose best language has a lower mean probability over all bytes are rejected.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts, texts without letters and those without a clear language go."""
    known = langid.identify_languages(docs, langid.fit(docs), docs.columns)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("carried.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, null ids last."""
    return simhash.without_near_copies(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of 20-word passages; a document of which nothing is left goes, n_chars follows the text."""
    rest = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]).alias("rest"))
    out = substring.remove_repeated_windows(rest, window=20, carry=("rest",)).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    values = {c: F.col("rest").getField(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its share of its source's target gives; null sources are a source, texts without words go."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text with its id and source; null texts have none, repeated rows are encoded each."""
    return pieces.encode_documents(docs, pieces.PieceModel.load(PIECE_MODEL), ["doc_id", "source"])


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Stages are written below the shared checkpoint folder, and only the last one's stay."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            _delete(spark, f"{place}/{k - 1}")
    return docs
