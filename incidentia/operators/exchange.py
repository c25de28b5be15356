"""Reports as nested resources for exchange, in the shape of a FHIR R4 ``AdverseEvent``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: field contents of the resource ----------------------------------------------

SERIOUS = ["D", "I"]
NOT_SERIOUS = ["M", "O"]
ACTUALITY = ["actual", "potential"]

# ---------------------------------------------------------------------------------------------


def _given(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def adverse_event(
    score: Column | None = None, version: Column | str | None = None
) -> Column:
    """The resource of a report row as a struct; fields without content are null.

    ``score`` is the probability of the predicted class and ``version`` names the classifier. A date
    that is no day of the form yyyyMMdd counts as missing, and so does a severity that is unknown.
    """
    label = F.col("severity_label")
    serious = F.when(label.isin(SERIOUS), True).when(label.isin(NOT_SERIOUS), False)
    number, device = _given(F.col("report_number")), _given(F.col("device_name"))
    received = F.col("date_received")
    day = F.when(received.rlike("^[0-9]{8}$"), F.try_to_timestamp(received, F.lit("yyyyMMdd")))
    category = F.when(serious, "serious").when(~serious, "non-serious")
    extensions = []
    if score is not None:
        none = F.lit(None).cast("string")
        extensions.append(
            F.struct(
                F.lit("severity_score").alias("url"), score.alias("valueDecimal"), none.alias("valueString")
            )
        )
    if version is not None:
        named = F.lit(version) if isinstance(version, str) else version
        extensions.append(
            F.struct(
                F.lit("classifier_version").alias("url"),
                F.lit(None).cast("double").alias("valueDecimal"),
                named.alias("valueString"),
            )
        )

    def where(known: Column, value: Column) -> Column:
        return F.when(known.isNotNull(), value)

    return F.struct(
        F.lit("AdverseEvent").alias("resourceType"),
        where(number, F.struct(number.alias("value"))).alias("identifier"),
        F.lit("completed").alias("status"),
        F.lit("actual").alias("actuality"),
        where(category, F.array(F.struct(category.alias("text")))).alias("category"),
        where(
            _given(F.col("event_type")), F.struct(_given(F.col("event_type")).alias("text"))
        ).alias("event"),
        F.struct(F.lit("Patient/anonymous").alias("reference")).alias("subject"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        serious.alias("seriousness"),
        where(
            device, F.array(F.struct(F.struct(device.alias("display")).alias("instance")))
        ).alias("suspectEntity"),
        *([F.array(*extensions).alias("extension")] if extensions else []),
    )


def missing_fields(resource: Column) -> Column:
    """Names of the fields a complete resource lacks, in the order of the resource."""
    checks = {
        "identifier": resource["identifier"]["value"].isNotNull(),
        "actuality": resource["actuality"].isin(ACTUALITY),
        "category": resource["category"].isNotNull(),
        "event": resource["event"]["text"].isNotNull(),
        "subject": resource["subject"]["reference"].isNotNull(),
        "date": resource["date"].isNotNull(),
        "suspectEntity": resource["suspectEntity"].isNotNull(),
    }
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_compact(F.array(*names))


def adverse_events(reports: DataFrame, score: Column | None = None, version=None) -> DataFrame:
    """``(report_number, severity_label, resource, missing, complete)``: a JSON resource per report."""
    made = reports.select("report_number", "severity_label", adverse_event(score, version).alias("__r"))
    checked = made.withColumn("missing", missing_fields(F.col("__r")))
    return checked.select(
        "report_number",
        "severity_label",
        F.to_json("__r").alias("resource"),
        "missing",
        (F.size("missing") == 0).alias("complete"),
    )


def pass_rate(events: DataFrame) -> DataFrame:
    """``(severity_label, n, n_complete, pass_rate)``, with a row for all under a null label."""
    counts = events.rollup("severity_label").agg(
        F.count("*").alias("n"),
        F.count_if("complete").alias("n_complete"),
        F.grouping("severity_label").alias("__all"),
    )
    label = F.when(F.col("__all") == 0, F.coalesce("severity_label", F.lit("")))
    return counts.select(
        label.alias("severity_label"), "n", "n_complete", (F.col("n_complete") / F.col("n")).alias("pass_rate")
    )
