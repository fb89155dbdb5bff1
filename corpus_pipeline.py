"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that the
stage before it kept; the last returns packed sequences, the others the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import mixing, nearcopies, packing, quality, secrets
from attestra.llm.common import shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text has no words and is scored as such; rows of
    one doc_id (null being one) stay or go together; repeated rows stay as often; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word Jaccard index of at least 0.8, verified) the document of the smallest
    id stays, a null id being the smallest. Null and empty texts are near duplicates of each other alone; of repeated rows one
    stays; an empty table stays empty."""
    return nearcopies.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text. Null and empty texts, ids and repeated rows stay as they are."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: rows are dropped or repeated. A null source is one of its own; a
    null or empty text has no words and is taken as often as its hash says; rows of one doc_id and source are taken alike."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; a document that the mix repeats is packed as often. A null or empty text is the end id alone; an
    empty table gives no sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL expresses the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage is written and read again, in the shared folder, and
    its input there goes once it is written. The last stage's table stays: it is the result."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
    return docs


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
