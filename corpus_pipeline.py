"""A corpus from raw documents: toxic ones go, copies go, near copies go, benchmark leaks go; what stays is encoded.

Part of the llm subpackage.  Each stage takes the documents that the stage before kept, with
all their columns, whatever their names.  In every stage a null text counts as empty, texts are
taken whole, rows that repeat a doc_id are judged by their own texts except where a stage says
otherwise, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.llm.bpe_lexicon import encode
from kithline.llm.decontaminate import drop_contaminated
from kithline.llm.exact_dedup import drop_exact_duplicates
from kithline.llm.scratch import let_go, materialise
from kithline.llm.simhash import drop_near_duplicates
from kithline.llm.similar import SHINGLE_WORDS, SIMILARITY
from kithline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels at hand, does not reject.

    Without labels of both classes all stay, or go, as one class.
    """
    let_go(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the smallest doc_id, null last; one of repeated rows."""
    let_go(spark)
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similarity 0.8 or more link: the smallest doc_id.

    This is operator 10 with a similarity in place of a distance.  Documents whose doc_id is
    null stay; a doc_id that several rows have goes with any of them.
    """
    let_go(spark)
    return drop_near_duplicates(docs, SHINGLE_WORDS, similarity=SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; items without words are contained in none."""
    let_go(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's token ids and of the text they decode to, one row per document."""
    import public_tokenizers

    let_go(spark)
    found = encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("bpe", tokens)]

#: The stages toxicity and bpe have no SQL; a test holds run() against a brute-force version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for documents; between stages the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
