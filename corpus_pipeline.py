"""A corpus pipeline of five stages; counted as part of the ``llm`` subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs.  All but the last return the columns of
``documents``; rows with null or repeated ids are kept apart as the operators'
modules define.

1. language ID: documents without a language (null text, or no letter in it) go;
   the language found replaces ``lang``, which stays where there is no language to
   learn;
2. exact dedup: of equal texts (blanks deleted) one stays;
3. SimHash near-dedup: of documents linked within 4 bits the smallest doc_id stays;
4. mixing: documents are taken, up to twice, toward the target weights;
5. byte-level BPE: ids of every text, and the digest of what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmint.llm import bpe, exact_dedup, langid, mixing, queries, simhash
from segmint.llm._util import bounded, cut, id_crc_mod, table


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where((id_crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    found = langid.marked(docs, model).where("__letter")
    return found.withColumn("lang", F.col("__lang") if model.families else F.col("lang")).select(*docs.columns)


@bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs, exact_dedup.exact_dedup(docs))


@bounded
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, cut(simhash.near_duplicates(docs, shingle=4, seed=42, d=4)))


@bounded
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, queries.tree(), queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_EPOCHS, queries.MIX_SEED)


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(docs, queries.VOCABULARY, queries.PATTERN, decode=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The fitted classifier of the first stage and the token ids of the last have no SQL; tests hold both to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
