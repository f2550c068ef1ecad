"""From raw documents to packed training sequences, in five stages.

Defined cases: null and empty texts and texts without a letter are of no language and go with the first stage; rows without an id stay
and are their own documents in all stages; rows that share an id are packed each by itself, and near dedup looks at the shorter text; a null source is a
source of its own; columns may have any names, also those the stages use inside; texts of any length are read whole; an empty table gives
an empty result. Ties: of equal texts the largest id stays, of near copies the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, language_id, minhash_dedup, mixing, packing
from quillspark.llm.common import settle
from quillspark.llm.queries import tokenizer_path


def plainly(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns _c0, _c1, ... that nothing clashes with, and what each given name became."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty."""
    rows, name = plainly(docs)
    model = language_id.fit(rows, name["text"], name["lang"], name["doc_id"])
    return language_id.predict(rows, model, name["text"]).where(~F.col("lang_rejected")).select(*rows.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return minhash_dedup.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice. Each row has its own count, also without an id or with another row's."""
    rows, name = plainly(docs)
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
    taken, _ = mixing.mix(rows, tag_col="_row", id_col=name["doc_id"], text_col=name["text"], sources=name["source"])
    times = taken.where("taken > 0").select(F.col("tag").alias("_row"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    again = rows.join(times, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return again.select(*name.values()).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
