"""op9: secrets of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.llm import blob_ledger
from chatterloom.llm.registry import query
from chatterloom.llm.shared import stored, table


def _count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op9_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # An earlier run saw half of the documents; the run over all of them scans only blobs that its ledger lacks.
    earlier = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    ledger = stored(blob_ledger.scan_unseen(earlier), "ledger")
    found = blob_ledger.secrets_of_paths(docs, ["doc_id"], ledger)
    spans = F.array_join(
        F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id", *[_count(k) for k in blob_ledger.KINDS], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans")
    )
