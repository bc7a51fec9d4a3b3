"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, packing.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm.common import materialize, release, table
from lattika.llm.language import UNKNOWN, identify, train
from lattika.llm.minhash import drop_near_duplicates
from lattika.llm.mixing import take
from lattika.llm.packing import pack
from lattika.llm.secrets import redact


#: Rows of an Arrow batch: texts are long, and a batch is held on both sides of a worker's pipe.
BATCH = 1_000
#: Rows and bytes of texts that packing encodes together, and bytes of pieces that it remembers: less than op1's, as the executors still hold what earlier stages took.
PACKED_TEXTS, PACKED_REMEMBERED = (2_000, 2 << 20), 32 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that has changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter. All others stay, however uncertain theirs is, and `lang` is then the language found in the whole text, which packing goes by.

    Rows are judged one by one, repeated rows alike; an empty table stays empty. Where no row has a label to learn from, texts with a letter stay as they are.
    """
    _small_batches(spark)
    network = train(docs)
    if network is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = identify(docs, network, "__language", "__certainty").where(F.col("__language") != UNKNOWN)
    return found.withColumn("lang", F.col("__language").cast(docs.schema["lang"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at similarity 0.8 on five-word shingles; of rows that share an id one, rows without an id and texts without words all. An empty table stays empty."""
    _small_batches(spark)
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; all documents stay, null texts as null, repeated rows alike. An empty table stays empty."""
    _small_batches(spark)
    return _measured(redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, in the order of the mix, repeated or cut as it says.

    Texts without words are no part of a mix; a null source is a source; repeated rows count one by one. An empty table stays empty.
    """
    _small_batches(spark)
    return _measured(take(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their ids and language, bucket by bucket of a language and a length in each partition; a null text is empty, repeated rows are packed alike. An empty table gives no rows."""
    _small_batches(spark)
    return pack(docs, by="lang", texts=PACKED_TEXTS, remembered=PACKED_REMEMBERED)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: The stages hold a trained network, a tokenizer and hashed sketches, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; returns what the last one wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            release(before)
    return docs
