"""Primary-source captures: content identity, first arrival, validation, audit. Batch operators; the stream is in tidemark.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import aware_time, micros, stamp
from tidemark.functions.text import STATEMENT_URL, event_of, is_allowed, statement_column

#: Version tag of stored records; `violations` takes another for logs written by other collectors.
SCHEMA_TAG = "information.v1"


def content_key() -> Column:
    """sha256 of the compact JSON array of URL, release header and text hash."""
    return F.sha2(F.to_json(F.array("source_url", "source_release_claim", "text_sha256")), 256)


def canonical_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(earliest record of each content key, alias of every record). rows: document_id, usable_at and the fields of the key.

    The earliest record of a key comes from a pre-aggregated minimum, so a key with many records isn't gathered in one task.
    """
    keyed = rows.withColumn("content_version_id", content_key()).withColumn("_us", micros(aware_time(F.col("usable_at"))))
    first = keyed.groupBy("content_version_id").agg(F.min(F.struct("_us", "document_id", "usable_at")).alias("f"))
    first = first.select(F.col("content_version_id").alias("_k"), F.col("f.document_id").alias("canonical_document_id"), F.col("f.usable_at").alias("canonical_usable_at"))
    joined = keyed.join(first, F.col("content_version_id") == F.col("_k")).drop("_k", "_us")
    aliases = joined.select("document_id", "content_version_id", "canonical_document_id", F.col("usable_at").alias("record_usable_at"), "canonical_usable_at")
    unique = joined.where((F.col("document_id") == F.col("canonical_document_id")) & (F.col("usable_at") == F.col("canonical_usable_at"))).dropDuplicates(["content_version_id"])
    return unique.drop("canonical_document_id", "canonical_usable_at"), aliases


def index_counts(rows: DataFrame) -> DataFrame:
    """documents, information_records, duplicate_information_records, distinct_information_events."""
    n, d = F.count("*"), F.countDistinct(content_key())
    return rows.agg(d.alias("documents"), n.alias("information_records"), (n - d).alias("duplicate_information_records"), F.countDistinct("information_event_id").alias("distinct_information_events"))


CLOCKS = ("plan_recorded_at", "request_started_at", "received_at", "features_ready_at", "usable_at")


def violations(rows: DataFrame, plans: DataFrame, snapshots: DataFrame, schema_tag: str = SCHEMA_TAG) -> DataFrame:
    """rows with `errors`, the array of broken rules.

    plans: recorded_at, plan_sha256, own_sha256 (hash of the recorded plan), selection_basis. snapshots: raw_path and content, of paths inside the capture root.
    """
    t = [micros(aware_time(F.col(c))) for c in CLOCKS]
    ordered = (t[0] <= t[1]) & (t[1] <= t[2]) & (t[2] <= t[3]) & (t[3] == t[4])
    good = plans.where("plan_sha256 = own_sha256 and selection_basis = 'source_schedule'").select(F.col("recorded_at").alias("_at"), F.col("plan_sha256").alias("_plan")).distinct().withColumn("_planned", F.lit(True))
    out = rows.join(good, (F.col("plan_recorded_at") == F.col("_at")) & (F.col("plan_sha256") == F.col("_plan")), "left")
    raw = snapshots.select(F.col("raw_path").alias("_path"), F.sha2("content", 256).alias("_sha"), F.col("content").alias("_content"))
    out = out.join(raw, F.col("raw_path") == F.col("_path"), "left").withColumn("_parsed", statement_column("_content", "extractor" if "extractor" in rows.columns else None))
    rules = {
        "schema": (F.col("schema") == schema_tag) & (F.col("availability_basis") == "collector_observation"), "clock order": ordered, "source": is_allowed(F.col("source_url")),
        "mode": (F.col("discovery_mode") == "source_schedule") & (F.trim(F.col("verified_text")) != ""), "backdated": F.col("historical_usable_at").isNull(), "text hash": F.sha2("verified_text", 256) == F.col("text_sha256"),
        "plan": F.col("_planned"), "snapshot": (F.col("_sha") == F.col("raw_sha256")) & (F.col("_parsed.text") == F.col("verified_text")), "header": F.col("_parsed.header") == F.col("source_release_claim"),
        "event": F.col("source_url").rlike(STATEMENT_URL) & (event_of(F.col("source_url")) == F.col("information_event_id")),
        "content key": (F.coalesce(F.col("content_version_id"), F.lit("")) == "") | (F.col("content_version_id") == content_key()),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return out.withColumn("errors", broken).select(*rows.columns, "errors")


def eligible_before(checked: DataFrame, cutoff: str) -> DataFrame:
    """Valid records usable strictly before a cut-off, which needs an offset."""
    return checked.where(F.size("errors") == 0).where(micros(aware_time(F.col("usable_at"))) < micros(stamp(F.lit(cutoff)))).drop("errors")


def event_audit(rows: DataFrame) -> DataFrame:
    """For each event: records, distinct texts, first usable time, sorted URLs."""
    first = F.min(F.struct(micros(aware_time(F.col("usable_at"))), "usable_at"))
    return rows.groupBy(F.col("information_event_id").alias("event_id")).agg(F.count("*").alias("saved_records"), F.countDistinct("text_sha256").alias("distinct_extracted_texts"), first["usable_at"].alias("first_usable_at"), F.array_sort(F.collect_set("source_url")).alias("source_urls"))


def error_counts(cycles: DataFrame) -> DataFrame:
    """cycles.errors (array of surface, error) counted by source and error."""
    return cycles.select(F.explode("errors").alias("e")).groupBy(F.col("e.surface").alias("source_url"), F.col("e.error").alias("error")).agg(F.count("*").alias("count"))


def status_histogram(rows: DataFrame, name: str = "status") -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").alias("n"))
