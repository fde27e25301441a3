"""documents through quality rules, near-duplicate removal, substring removal, masking and packing.

Each stage takes the documents that the one before kept, in the columns of documents; the last
returns the packed pieces. Stages that change a text keep n_chars, where there is one, in step.

Defined results, all stages: null text counts as empty; an empty table gives an empty table; very long
texts are taken whole; ties go as the stage's operator says; other columns pass through, whatever their
names. Repeated rows: each is judged, cut, masked and packed; the n-gram Jaccard join keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard, packing, pii, quality, substring
from weftline.llm.textops import with_text
from weftline.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have too few words and go; rows are judged one by one."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, one of a group without any;
    documents without words link with nothing and stay."""
    return jaccard.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; a text that loses nothing, a null one too, stays as it is, and
    one that loses all its words stays as an empty text."""
    return substring.shortened(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by [KIND]; null stays null."""
    return with_text(pii.mask(docs), F.col("text"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and offsets; an empty or null text is one piece of the end id."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("PII", mask_pii),
    ("best-fit packing", best_fit_packing),
]
#: Tokens, random fields and packing are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else materialize(docs, "stage"), sf_dir)
    return docs
