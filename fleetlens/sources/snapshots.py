"""Reading what collectors land: snapshot documents, response text, command output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import casts
from fleetlens.operators.nested import newer_layout
from fleetlens.operators.specs import FALLBACKS, MODULES

MALFORMED = "Malformed envelope"
ENVELOPE = "collected_at timestamp, module string, device string, success boolean, hostname string, error string, data variant"


def read_snapshots(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Whole snapshot documents, one row per file: ``payload``, ``collected_at``, ``source``.
    A stream takes ``files_per_trigger`` files at a time, which bounds its micro-batches."""
    reader = spark.read
    if streaming:
        reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("wholetext", True).format("text").load(path).select(
        F.col("value").alias("payload"),
        F.col("_metadata.file_modification_time").alias("collected_at"),
        F.col("_metadata.file_path").alias("source"),
    )


def read_envelopes(
    spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 1000
) -> DataFrame:
    """Line-delimited envelopes, one device and module per line: the splittable landing format.
    A stream takes ``files_per_trigger`` files at a time, which bounds its micro-batches."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if streaming else spark.read
    return reader.schema(ENVELOPE).json(path)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """Raw command output, one row per file; device and command come from the file path
    ``…/<device>/<command>.<ext>``."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("collected_at"),
        F.element_at(parts, -2).alias("device"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("command"),
    )


def parsed(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Snapshots as ``document`` (VARIANT) and the rows that are no JSON object; ``strict`` makes those an error.

    A document's own ``timestamp`` is its collection time; the file's is used where it has none.
    """
    parse = "parse_json" if strict else "try_parse_json"
    # Generated, not projected: filters on the document would else be moved below the projection and parse it once more.
    documents = raw.drop("document").selectExpr("*", f"inline(array(named_struct('document', {parse}(payload))))")
    broken = F.expr(f"NOT {casts.is_object('document')}")
    if "collected_at" in raw.columns:
        own = F.expr("try_variant_get(document, '$.timestamp', 'timestamp')")
        documents = documents.withColumn("collected_at", F.coalesce(own, F.col("collected_at")))
    return documents.filter(~broken).drop("payload"), documents.filter(broken).drop("document")


def envelopes(documents: DataFrame, modules: Sequence[str] = MODULES) -> DataFrame:
    """One row per module and device.

    Only the known modules are looked at; whatever else a document holds is left alone. An envelope that is no object
    becomes a failed row with an error, its siblings stay as they are. Any set value of ``success`` counts as true.
    A device's host name is resolved here, where its whole document is at hand: an envelope's own, else the one that the
    device reports about itself in the same document.
    """
    kept = [c for c in documents.columns if c != "document"]
    told = f"{casts.truthy_leaf(casts.leaf('e', 'success'))} = 1"
    reported = f"CASE WHEN {told} THEN {casts.leaf_text('e', 'data', 'system_info', 'system', 'hostname')} END"
    names = f"transform_values({casts.as_object('document', 'system')}, (k, e) -> {reported})"
    return (
        documents.select(*kept, F.expr(names).alias("_names"), F.expr(f"explode({casts.as_object('document')}) as (module, _devices)"))
        .filter(F.col("module").isin(*modules))
        .select(*kept, "_names", "module", F.expr(f"explode({casts.as_object('_devices')}) as (device, _envelope)"))
        .select(
            *kept,
            "module",
            "device",
            F.expr(f"coalesce({casts.truthy_leaf(casts.leaf('_envelope', 'success'))} = 1, false)").alias("success"),
            F.expr(f"coalesce(nullif({casts.leaf_text('_envelope', 'hostname')}, ''), nullif(try_element_at(_names, device), ''))").alias("hostname"),
            F.expr(
                f"CASE WHEN NOT {casts.is_object('_envelope')} THEN '{MALFORMED}' "
                f"ELSE {casts.leaf_text('_envelope', 'error')} END"
            ).alias("error"),
            F.expr(casts.leaf("_envelope", "data")).alias("data"),
        )
    )


def succeeded(envelope_rows: DataFrame) -> DataFrame:
    return envelope_rows.filter(F.coalesce("success", F.lit(False)))


def failed(envelope_rows: DataFrame) -> DataFrame:
    return envelope_rows.filter(~F.coalesce(F.col("success"), F.lit(False))).select(
        "collected_at", "module", "device", F.coalesce("error", F.lit("Unknown error")).alias("error")
    )


def collections(envelope_rows: DataFrame) -> DataFrame:
    """One row per named part of a successful envelope.

    ``superseded`` marks parts that count only while the device's first choice is absent or empty,
    decided here where both are at hand, so no join is needed later.
    """
    superseded = F.lit(False)
    for fallback, first in FALLBACKS.items():
        first_choice = F.expr(casts.present(casts.leaf("data", first)))
        superseded = superseded | ((F.col("collection") == fallback) & first_choice)
    return succeeded(envelope_rows).select(
        "collected_at",
        "module",
        "device",
        "hostname",
        F.expr(casts.leaf_text("data", "_hostname")).alias("data_hostname"),
        F.expr(casts.leaf_text("data", "routing_mode")).alias("routing_mode"),
        "data",
        F.expr(f"explode({casts.as_object('data')}) as (collection, body)"),
    ).select(
        "collected_at", "module", "device", "hostname", "data_hostname", "routing_mode", "collection",
        F.expr(newer_layout("collection", "routing_mode", "body")).alias("body"),
        superseded.alias("superseded"),
    )


def decoded_responses(raw: DataFrame, body: Column) -> DataFrame:
    """Status, payload and error message of XML response texts; anything unexpected is an error row."""
    parsed_body = F.from_xml(
        body, "_status string, msg string, result string, _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    raw = raw.withColumn("_xml", parsed_body)
    well_formed = F.coalesce(
        body.rlike(r"^\s*(<\?xml[^>]*\?>\s*)?<response[\s/>]") & F.col("_xml._corrupt_record").isNull(), F.lit(False)
    )
    status, message = F.col("_xml._status"), F.col("_xml.msg")
    error = (
        F.when(~well_formed, "Invalid response format")
        .when(status == "success", F.lit(None))
        .when(status == "error", F.concat(F.lit("API error: "), F.coalesce(message, F.lit("Unknown error"))))
        .otherwise(F.concat(F.lit("Unexpected response status: "), F.coalesce(status, F.lit("None"))))
    )
    good = F.coalesce(well_formed & (status == "success"), F.lit(False))
    return raw.select(
        "*", good.alias("success"), F.when(good, F.col("_xml.result")).alias("result"), error.alias("error")
    ).drop("_xml")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("success"))
