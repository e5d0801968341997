"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, for each pair of
blob and rule version, what a scan found. A run scans only pairs that the ledger lacks, each blob once
however many paths or versions carry it, and joins the findings back to all paths.

Null texts count as empty, so they share one blob and have no findings. Repeated rows stay repeated. Empty
tables give empty results with the same columns. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.shared import let, stored

RULE_VERSION = 1
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short can't hold a longer one, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MARK = "[SECRET]"
FINDINGS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"
# Copied blobs, and findings with their blobs, that may be sent to all tasks; more of them are joined by a shuffle.
SENT_BLOBS, SENT_FINDINGS = 100_000, 200_000
LEDGER = f"blob string, rule_version int, findings {FINDINGS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, pattern: str, kind: str, wanted: Column) -> Column:
    """Spans in code points of the matches for which ``wanted`` (an array beside them) is true."""
    number = KINDS.index(kind)
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast(FINDINGS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["good"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zipped = F.zip_with(F.arrays_zip(pieces.alias("gap"), found.alias("size")), wanted, lambda x, good: F.struct(
        x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), good.alias("good")))
    whole = F.filter(zipped, lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(whole, start, step, lambda acc: acc["out"])).otherwise(F.lit([]).cast(FINDINGS))


def findings(text: Column) -> Column:
    """All secrets of a text by start, then kind."""

    def scan(t: Column) -> Column:
        long_enough = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
        every = lambda p: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda x: F.lit(True))
        found = F.concat(
            _matches(t, ASSIGN, "assign", long_enough),
            _matches(t, ACCESS, "access", every(ACCESS)),
            _matches(t, HEX, "hex", every(HEX)),
        )
        return F.array_sort(found)

    return let(F.coalesce(text, F.lit("")), scan)


def _one_of_each(addressed: DataFrame) -> DataFrame:
    """One row (blob, text) for each blob. Texts that occur once stay where they are; few copied ones are all that moves."""
    copied = stored(addressed.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("blob"), "copied")
    if copied.limit(SENT_BLOBS + 1).count() > SENT_BLOBS:
        return addressed.dropDuplicates(["blob"])
    copied = F.broadcast(copied)
    several = addressed.join(copied, "blob", "left_semi").dropDuplicates(["blob"])
    return addressed.join(copied, "blob", "left_anti").unionByName(several)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """One row (blob, text) for each content whose pair with this rule version the ledger lacks."""
    addressed = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is None:
        return _one_of_each(addressed)
    # The join has dealt the texts out by blob already.
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
    return addressed.join(seen, "blob", "left_anti").dropDuplicates(["blob"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """New rows of the ledger. Append them to it (a Parquet table) before the next run."""
    blobs = unseen_blobs(versions, ledger, text, rule_version)
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("text")).alias("findings"))


def secrets_of_paths(
    versions: DataFrame, keys: list[str], ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION
) -> DataFrame:
    """Every row of ``versions`` with its keys, blob and findings (an empty array if there are none).

    The new ledger rows are a table before they meet the paths, so the paths of a frequent blob are dealt out apart from its scan
    and AQE can split them.
    """
    known = stored(scan_unseen(versions, ledger, text, rule_version), "ledger")
    if ledger is not None:
        old = ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
        known = known.unionByName(old.select("blob", "rule_version", "findings"))
    # Most blobs hold nothing: only the others meet the paths.
    hits = known.where(F.size("findings") > 0).select("blob", "findings")
    paths = versions.select(*keys, blob_of(F.col(text)).alias("blob"))
    return paths.join(hits, "blob", "left").select(
        *keys, "blob", F.coalesce("findings", F.lit([]).cast(FINDINGS)).alias("findings")
    )


def _sent_if_few(hits: DataFrame, found: str) -> DataFrame:
    """Broadcast hint if blobs and findings together are few: then the texts that they meet don't move."""
    size = hits.agg(F.coalesce(F.sum(F.size(found) + 1), F.lit(0))).first()[0]
    return F.broadcast(hits) if size <= SENT_FINDINGS else hits


def redacted(text: Column, found: Column) -> Column:
    """The text with every found span (or run of overlapping ones) replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MARK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The documents with their secrets masked and ``n_chars`` set anew where that changed the text."""
    known = stored(scan_unseen(docs, ledger), "ledger")
    if ledger is not None:
        old = ledger.where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"])
        known = known.unionByName(old.select("blob", "rule_version", "findings"))
    hits = known.where(F.size("findings") > 0).select(F.col("blob").alias("_blob"), F.col("findings").alias("_found"))
    joined = docs.withColumn("_blob", blob_of(F.col("text"))).join(_sent_if_few(hits, "_found"), "_blob", "left")
    masked = F.when(F.col("_found").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("_found")))
    out = joined.withColumn("text", masked)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_found").isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)
