"""Pipeline over the documents: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Each result is
written to the shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm import blob_ledger, decontaminate, mixing, near_dups, toxicity
from chatterloom.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null, empty and blank texts get the base rate and stay. Rows without id teach nothing but are judged; repeated rows get equal
    scores. Texts of any length are scored whole. Without labels nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8) the document with the smallest id stays.

    Texts without words link with nothing and stay, as do rows without id. Rows that share the smallest id all stay. Empty tables stay empty.
    """
    return near_dups.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go.

    Texts without words, null included, can't repeat any and stay; so does everything if the benchmark is empty. Rows that share an id are
    judged by their own texts. Texts of any length are read whole.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; ``n_chars`` follows where that changed it.

    Null stays null. Equal texts are scanned once and masked alike. No row goes, whatever its id.
    """
    return blob_ledger.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies.

    Null texts have no words and cost nothing; null sources are one source, last in order. Repeated rows stand or fall together. Ranks
    come from a hash, so ties and reruns agree. An empty table gives no rows.
    """
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("mixing_sources", mix_sources),
]
# Toxicity is a trained model, which SQL can't express; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
