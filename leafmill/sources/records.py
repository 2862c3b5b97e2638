"""Scans and sinks of JSON records and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# What activity says of a stored artefact of each kind: action, state, message for a known document.
SAVED = {
    "toc": ("toc_saved", "success", "Saved TOC data for"),
    "xml_stats": ("xml_stats_saved", "success", "Saved XML statistics for document"),
    "process_log": ("process_log_saved", "info", "Saved process diagnostics log for"),
    "xml": ("xml_conversion_ready", "success", "XML conversion ready for"),
}


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, one JSON object a line; what can't be read keeps its text in _bad and nulls elsewhere."""
    return spark.read.schema(f"{schema}, _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def read_activity(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Activity lines, those that can't be read left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def with_workflow(records: DataFrame) -> DataFrame:
    """M4: records without a workflow get xml if they have only an XML path, else toc."""
    old = F.when(F.col("xml_path").isNotNull() & F.col("output_path").isNull() & F.col("toc_path").isNull(), "xml").otherwise("toc")
    return records.withColumn("workflow", F.coalesce("workflow", old))


def preview(text, n: int = 16_000):
    """S14."""
    return F.substring(text, 1, n)


def read_stored(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    """Artefacts `<document_id><suffix>.json` as document_id and data, of the schema (array<...> for contents, struct<...> for sums).

    A missing path is an error as the scan is planned, a file that isn't of the schema's kind one as it is read.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}.json")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.regexp_replace(F.url_decode(name), rf"{suffix}\.json$", "").alias("document_id"), X.loaded(F.col("value"), schema, strict=True).alias("data"))


def append_activity(events: DataFrame, path: str) -> None:
    """K3: events as JSON lines added to a folder; a write that fails adds none."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def save_records(rows: DataFrame, path: str) -> None:
    """K1, K5: rows as JSON in place of the folder's; they are seen by the writer's commit. Rows must not be read from the same folder."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def saved(records: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: records with pointers to new artefacts, and what activity says of them.

    records: document_id, original_filename, status, error, process_log_path, xml_path, xml_stats_path and others. artifacts: document_id, kind
    (toc, xml_stats, process_log or xml; one of a kind for a document), path, stats_path. Contents and sums set no pointer; an XML makes its
    document ready. Activity has a row for each artefact; contents of a document that isn't known give a warning, a log or an XML none.
    """
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    new = artifacts.groupBy("document_id").agg(of("process_log", "path").alias("_log"), of("xml", "path").alias("_xml"), of("xml", "stats_path").alias("_stats"), F.bool_or(F.col("kind") == "xml").alias("_ready"))
    ready = F.coalesce("_ready", F.lit(False))
    out = records.join(new, "document_id", "left").withColumns({
        "process_log_path": F.coalesce("_log", "process_log_path"), "xml_path": F.coalesce("_xml", "xml_path"), "xml_stats_path": F.coalesce("_stats", "xml_stats_path"),
        "status": F.when(ready, "ready").otherwise(F.col("status")), "error": F.when(~ready, F.col("error")),
    }).select(*records.columns)
    met = artifacts.join(records.select("document_id", F.col("original_filename").alias("filename")), "document_id", "left")
    says = F.create_map(*[x for k, (a, s, m) in SAVED.items() for x in (F.lit(k), F.struct(F.lit(a).alias("action"), F.lit(s).alias("status"), F.lit(m).alias("message")))])[F.col("kind")]
    stats, known = F.col("kind") == "xml_stats", F.col("filename").isNotNull()
    message = F.when(stats, F.concat(says["message"], F.lit(" "), "document_id", F.lit("."))).when(known, F.concat(says["message"], F.lit(" "), "filename", F.lit("."))).otherwise(F.concat(F.lit("Saved TOC data for missing document "), "document_id", F.lit(".")))
    activity = met.where(known | F.col("kind").isin("toc", "xml_stats")).select("document_id", says["action"].alias("action"), F.when(known | stats, says["status"]).otherwise("warning").alias("status"), message.alias("message"), "path")
    return out, activity


def started_lines(jobs: DataFrame) -> DataFrame:
    """The first lines of a document's progress text: document_id, part 0, place, line. jobs: document_id, source_filename, mode."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("None")))
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    lines = F.array(line("timestamp_utc", at), *[line(c, F.col(c)) for c in ("document_id", "source_filename", "mode")], F.lit("status: processing_started"))
    return jobs.select("document_id", F.lit(0).alias("part"), F.posexplode(lines).alias("place", "line"))


def report_lines(fields: DataFrame, unresolved: DataFrame) -> DataFrame:
    """A process report as lines: document_id, part, place, line, in order of part and place.

    fields: document_id, place, field, value (as process_summary gives them). unresolved: document_id, place, toc_page, toc_type, target_label,
    unresolved_reason. Lines stay rows, so that a report of any length is never one value; a document without unresolved rows says None.
    """
    none = F.lit("None")
    first = fields.select("document_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), F.concat(F.coalesce("field", none), F.lit(": "), F.coalesce("value", none)).alias("line"))
    part = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    text = F.concat(F.lit("- toc_page="), F.coalesce(F.col("toc_page").cast("string"), none), F.lit(", toc_type="), F.coalesce("toc_type", none), F.lit(", label="), part("target_label", "-"), F.lit(", reason="), part("unresolved_reason", "target_not_found"))
    rows = unresolved.select("document_id", F.lit(2).alias("part"), F.col("place").cast("long").alias("place"), text.alias("line"))
    # one aggregate says which documents have such rows
    ids = fields.select("document_id", F.lit(0).alias("n")).unionByName(unresolved.select("document_id", F.lit(1).alias("n"))).groupBy("document_id").agg(F.max("n").alias("n"))
    heads = F.when(F.col("n") > 0, F.array(F.lit(""), F.lit("Unresolved rows:"))).otherwise(F.array(F.lit(""), F.lit("Unresolved rows:"), none))
    middle = ids.select("document_id", F.lit(1).alias("part"), F.posexplode(heads).alias("place", "line")).withColumn("place", F.col("place").cast("long"))
    return first.unionByName(middle).unionByName(rows)


def write_reports(lines: DataFrame, path: str) -> None:
    """Lines added as text, a folder for each document, in order within a write."""
    rows = lines.where("line is not null").repartition("document_id").sortWithinPartitions("document_id", "part", "place")
    rows.select("document_id", "line").write.partitionBy("document_id").mode("append").text(path)


def report_previews(texts: DataFrame, fields: DataFrame) -> DataFrame:
    """document_id and preview: the stored text if there is one, else the first 30 fields (place from 0) as lines; of neither, no row.

    A field of a null name and value is left out, a null beside a value reads None. At most 30 short lines meet in one value.
    """
    none = F.lit("None")
    line = F.concat(F.coalesce("field", none), F.lit(": "), F.coalesce("value", none))
    rows = fields.where((F.col("place") < 30) & (F.col("field").isNotNull() | F.col("value").isNotNull())).select("document_id", "place", line.alias("line"))
    made = rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda r: r["line"]), "\n").alias("made"))
    return texts.select("document_id", "text").join(made, "document_id", "full").select("document_id", F.coalesce("text", "made", F.lit("")).alias("preview"))
