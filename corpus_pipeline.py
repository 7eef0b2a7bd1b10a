"""A corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; it is written as Parquet and read again as the next stage's docs. All stages but the last return the columns of docs,
extra ones of any name included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surfacelab.llm import bpe, mixing, quality_classifier, quality_rules, shingle_join
from surfacelab.llm.shared import column, table, unused, written

#: Columns that an operator adds; a document's own column of such a name is set aside meanwhile.
ADDED = {"n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept", "score", "predicted", *mixing.ADDED}


def with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs as they were, those that an operator's names clash with too."""
    name: dict[str, str] = {}
    for c in docs.columns:
        name[c] = unused([*docs.columns, *name.values(), *ADDED], f"own_{c}") if c.lower() in ADDED else c
    out = stage(docs.select(*[column(c).alias(n) for c, n in name.items()]))
    return out.select(*[column(n).alias(c) for c, n in name.items()])


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the stages' models learn from: the whole table, as stages before remove most of one class."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    A null or empty text has no words and goes; a very long one is measured whole; a null id, ties and repeated rows are judged each
    alone; an empty table stays empty.
    """
    return with_own_columns(docs, lambda d: quality_rules.quality_rules(d).where("kept"))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; the model learns from all labelled documents, the rejected ones too.

    A null or empty text has one fixed score; a very long one is scored whole, block by block; null ids, ties and repeated rows
    are scored alike; an empty table stays empty; without labels of both classes every score is the share of label 1.
    """
    model = quality_classifier.train(labelled_texts(spark, sf_dir), quality_classifier.learnable_labels(spark, sf_dir))
    return with_own_columns(docs, lambda d: quality_classifier.score(d, model).where("predicted = 1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by 0.8 or more of the 5-word shingles.

    Null and empty texts are copies of each other; a very long text is compared whole; null ids come last; rows that share an id are
    judged by their texts, and of equal rows one stays; an empty table stays empty.
    """
    return shingle_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: toxic and low shares halved, the token total kept.

    A null or empty text has no tokens, so its rate plays no part in the totals; a very long one counts whole; rows of null id share one draw;
    repeated rows and ties have equal rates and draws; an empty table stays empty; without labels all rates are 1.
    """
    labels, learned = mixing.domain_labels(spark, sf_dir), labelled_texts(spark, sf_dir)
    return with_own_columns(docs, lambda d: mixing.mix(d, labels, factors=mixing.FACTORS, learned=learned))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the digests of its ids and of the decoded text.

    A null or empty text has no ids; a very long one is encoded whole; null ids and repeated rows pass through, a row each; an
    empty table stays empty; other columns are left out.
    """
    return bpe.digests(bpe.encode_decode(docs, bpe.vocabulary_path("word_bpe_49k.json"), carry=["doc_id"]))


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: Compression, fingerprint components and fitted rates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each one written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
