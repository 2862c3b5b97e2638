"""Records of documents and jobs: latest state, search, paging, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a job's state makes of its document's; others change nothing.
DISPLAY = {"queued": "queued", "scheduled": "queued", "deferred": "queued", "started": "processing", "finished": "ready", "failed": "failed", "stopped": "failed", "canceled": "failed"}


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """K2, K4: upsert as the latest row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """K2."""
    return rows.join(gone.select(*key), key, "left_anti")


def patched(rows: DataFrame, changes: DataFrame, key: list[str], always: tuple[str, ...] = ("error",)) -> DataFrame:
    """A partial update (one row of changes for a key at most) keeps what it gives as null, but for the columns always, which it overwrites."""
    new = [c for c in changes.columns if c not in key]
    met = rows.alias("r").join(changes.withColumn("_hit", F.lit(True)).alias("c"), key, "left")
    value = lambda c: F.when(F.col("c._hit"), F.col(f"c.{c}")).otherwise(F.col(f"r.{c}")) if c in always else F.coalesce(f"c.{c}", f"r.{c}")
    return met.select(*[F.col(c) if c in key else value(c).alias(c) if c in new else F.col(f"r.{c}").alias(c) for c in rows.columns])


def display_status(status: Column) -> Column:
    """A document's state by its job's; null where it stays as it is."""
    return F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])[status]


def synced_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """A document's state after its job's events in turn. One that is ready isn't queued or processed again; one that failed may be."""
    own = events.withColumn("_s", display_status(F.col(status))).where("_s is not null")
    last = lambda s: F.max(F.when(F.col("_s") == s, F.struct(*order)))
    agg = own.groupBy(key).agg(last("ready").alias("r"), last("failed").alias("f"), F.max(F.struct(*order, "_s")).alias("l"))
    stays = F.col("l._s").isin("queued", "processing") & F.col("r").isNotNull() & F.coalesce(F.col("r") > F.col("f"), F.lit(True))
    return agg.select(key, F.when(stays, "ready").otherwise(F.col("l._s")).alias(status))


def search(rows: DataFrame, columns: list[str], query: str, status: str | None = None) -> DataFrame:
    """a substring of the joined fields, whatever its case, and a state."""
    found = rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))
    return found.where(F.col("status") == status) if status else found


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 8) -> DataFrame:
    """One page of the sorted rows."""
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def latest_events(events: DataFrame, n: int = 80) -> DataFrame:
    """The newest, 1 to 250."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(250, n)))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """A6, A14, A15."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def error_report(rows: DataFrame) -> DataFrame:
    """Linked and unresolved rows by reason."""
    return rows.groupBy(F.coalesce("unresolved_reason", F.lit("linked")).alias("outcome")).agg(F.count("*").alias("n"))


def process_summary(reports: DataFrame, fields: list[str]) -> DataFrame:
    """K11, sheet Summary: a row for each field of each report (document_id, source_filename, mode and others): document_id, place, field, value."""
    named = ["document_id", "source_filename", "mode", *fields]
    first = F.struct(F.lit("timestamp_utc").alias("field"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("value"))
    rest = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in named]
    return reports.select("document_id", F.posexplode(F.array(first, *rest)).alias("place", "f")).select("document_id", "place", "f.*")


def unresolved_links(rows: DataFrame) -> DataFrame:
    """K11, sheet Unresolved Links: rows of contents without a target."""
    label, reason = F.coalesce("target_label", F.lit("")), F.coalesce("unresolved_reason", F.lit("target_not_found"))
    return rows.where("target_page is null").select("document_id", F.col("page_number").alias("toc_page"), "toc_type", label.alias("target_label"), reason.alias("unresolved_reason"), "title", "reference_text", "chapter")
