"""Report tables derived from the benchmark tables.

The tables hold invented prose, not reports, so the report fields are derived from each row by
fixed rules: labels from the language with some noise, stock phrases in front of the text so that
cleaning has something to do, raw JSON pages around the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentia.functions.labels import severity_of
from incidentia.schema import REPORT

# --- Fixed values: phrases put in front of the texts -------------------------------------------

PHRASES = [
    "It was reported that the pt was seen by MD and DR at hosp. ",
    "ACCORDING TO THE REPORT, pts had SOB w/pain after tx; ",
    "Per the reporter the device failed w/ alarm. ",
    "Follow-up will be requested. Followup is requested. ",
    "pt pt c/o n/v, h/o rx, s/p adm, dx UNK. ",
    "w/h/o pté éptb pt_x 3pt w/5 dr. ",
    "No further information was available. ",
    "Information has been received. The following information was received: ",
    "This is a report. The reporter stated Model 3000 failed! ",
    "xit was reported thatpt follow\nup is requested ",
    "",
    "",
    "",
    "",
    "",
    "",
]

# ---------------------------------------------------------------------------------------------

_HEX = "0123456789abcdef"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts.

    A scan with fewer tasks than cores is dealt out over the cores, since the work per row far
    outweighs moving it; a large table has tasks enough and stays where it is.
    """
    table = read_table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def digit(tag: str, key: Column) -> Column:
    """A digit 0–15 of the row, drawn from md5 so that any engine finds the same."""
    first = F.substring(F.md5(F.concat(F.lit(tag), key.cast("string")).cast("binary")), 1, 1)
    return F.instr(F.lit(_HEX), first) - 1


def base_label(lang: Column) -> Column:
    return (
        F.when(lang == "en", "M").when(lang == "fr", "I").when(lang == "de", "D").otherwise("O")
    )


def noisy_label(lang: Column, key: Column) -> Column:
    """The language's label, moved to the next class in an eighth of the rows."""
    label = base_label(lang)
    moved = (
        F.when(label == "M", "I").when(label == "I", "D").when(label == "D", "O").otherwise("M")
    )
    return F.when(digit("n", key) < 2, moved).otherwise(label)


def event_name(lang: Column, key: Column) -> Column:
    label = noisy_label(lang, key)
    injury = F.when(digit("e", key) < 8, "Injury").otherwise("Serious Injury")
    return (
        F.when(digit("u", key) == 0, "No Answer Provided")
        .when(label == "D", "Death")
        .when(label == "I", injury)
        .when(label == "M", "Malfunction")
        .otherwise("Other")
    )


def phrase(key: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHRASES]), digit("p", key))


def received_date(start: str, days: Column) -> Column:
    return F.date_format(F.date_add(F.lit(start).cast("date"), days.cast("int")), "yyyyMMdd")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per document."""
    key = F.col("doc_id")
    event = event_name(F.col("lang"), key)
    return read_texts(spark, sf_dir, "documents").select(
        key.cast("string").alias("report_number"),
        received_date("2024-01-01", key % 365).alias("date_received"),
        event.alias("event_type"),
        severity_of(event).alias("severity_label"),
        F.col("source").alias("device_name"),
        F.concat(phrase(key), "text").alias("narrative_text"),
    )


def conversation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per turn; the turns of a conversation share a report number."""
    event = F.when(F.col("role") == "user", "Malfunction").otherwise("Injury")
    return read_texts(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("report_number"),
        received_date("2024-06-01", F.col("turn")).alias("date_received"),
        event.alias("event_type"),
        severity_of(event).alias("severity_label"),
        F.col("role").alias("device_name"),
        F.col("text").alias("narrative_text"),
    )


def unnumbered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without a number, blank or null."""
    key = F.col("item_id")
    return read_table(spark, sf_dir, "benchmark").select(
        F.when(digit("b", key) < 8, F.lit("")).alias("report_number"),
        F.lit("20240701").alias("date_received"),
        F.lit("Other").alias("event_type"),
        F.lit("O").alias("severity_label"),
        F.lit("").alias("device_name"),
        F.col("text").alias("narrative_text"),
    )


def accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports already held: those of the labelled documents."""
    held = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    rows = reports(spark, sf_dir)
    return rows.join(held, rows["report_number"] == held["id"], "left_semi")


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that repeats held reports, repeats numbers within itself and lacks some numbers."""
    return (
        reports(spark, sf_dir)
        .unionByName(conversation_reports(spark, sf_dir))
        .unionByName(unnumbered_reports(spark, sf_dir))
        .select(*REPORT.names)
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_no, value)``: a JSON page per document, in the shapes raw reports come in.

    The event type is an array or a bare string; narratives come in one part, several, with a part
    lacking its text, a null one, or none at all; devices have a brand, a generic name, or neither.
    """
    key, text = F.col("doc_id"), F.concat(phrase(F.col("doc_id")), "text")
    event = event_name(F.col("lang"), key)
    shape = digit("r", key)

    def part(column: Column) -> Column:
        return F.to_json(F.struct(column.alias("text")), {"ignoreNullFields": "false"})

    def quoted(column: Column) -> Column:
        # The value of a one-field object, cut out of {"v":…}.
        packed = F.to_json(F.struct(column.alias("v")))
        return F.substring(packed, F.lit(6), F.length(packed) - 6)

    whole = part(text)
    narrative = (
        F.when(shape == 0, F.concat(F.lit("["), whole, F.lit(',{"kind":"D"},'), part(F.lit("end")), F.lit("]")))
        .when(shape == 1, F.concat(F.lit("["), part(F.lit(None).cast("string")), F.lit(","), whole, F.lit("]")))
        .when(shape == 2, F.lit("[]"))
        .when(shape == 3, F.lit('[{"text":"  \\n "}]'))
        .when(shape == 4, F.concat(F.lit('["loose",'), whole, F.lit("]")))
        .otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    )
    device = (
        F.when(digit("d", key) < 8, F.concat(F.lit('[{"brand_name":'), quoted(F.col("source")), F.lit("}]")))
        .when(digit("d", key) < 12, F.concat(F.lit('[{"brand_name":"","generic_name":'), quoted(F.col("source")), F.lit("},{}]")))
        .when(digit("d", key) < 14, F.lit("[]"))
        .otherwise(F.lit("[{}]"))
    )
    listed = F.concat(F.lit("["), quoted(event), F.lit("]"))
    kind = digit("t", key)
    event_json = (
        F.when(kind < 8, listed)
        .when(kind < 12, quoted(event))
        .when(kind == 12, F.lit("[]"))
        .when(kind == 13, F.lit("null"))
        .when(kind == 14, F.lit('""'))
        .otherwise(F.lit('["banana","Death"]'))
    )
    number = F.when(digit("k", key) == 0, F.lit("")).otherwise(
        F.concat(F.lit('"report_number":'), quoted(key.cast("string")), F.lit(","))
    )
    record = F.concat(
        F.lit("{"), number,
        F.lit('"date_received":'), quoted(received_date("2024-01-01", key % 365)),
        F.lit(',"event_type":'), event_json,
        F.lit(',"device":'), device,
        F.when(shape == 5, F.lit("")).otherwise(F.concat(F.lit(',"mdr_text":'), narrative)),
        F.lit("}"),
    )
    return read_texts(spark, sf_dir, "documents").select(
        key.alias("page_no"),
        F.concat(F.lit('{"results":['), record, F.lit("]}")).alias("value"),
    )


def many_record_pages(spark: SparkSession, sf_dir: str, per_page: int = 20) -> DataFrame:
    """``(page_no, value)``: the records of ``raw_pages``, ``per_page`` to a page in their order."""
    key = F.col("page_no")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "value")))
    # Each value is {"results":[record]}: what stands between the brackets.
    inner = F.transform(ordered["value"], lambda v: F.substring(v, F.lit(13), F.length(v) - 14))
    joined = F.concat(F.lit('{"results":['), F.array_join(inner, ","), F.lit("]}"))
    pages = raw_pages(spark, sf_dir).groupBy(F.floor(key / per_page).alias("page"))
    return pages.agg(joined.alias("value")).select(F.col("page").alias("page_no"), "value")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training run per day of events, in the layout of the run log."""
    daily = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("value") / 100 + 0.5, 6).alias("f1"),
            F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))) / 100 + 0.5, 6)
            .alias("cv"),
            F.round(F.min("value") / 100 + 0.3, 6).alias("dummy"),
        )
    )
    day = F.date_format("day", "yyyyMMdd")
    number = F.datediff("day", F.lit("2024-01-01").cast("date"))
    has_cv = number % 7 != 3  # some runs never cross-validated
    return daily.select(
        F.md5(day.cast("binary")).alias("run_id"),
        (F.unix_date("day").cast("long") * 86_400_000 + F.col("n") * 1000).alias("start_time"),
        F.create_map(
            F.lit("model_type"), F.when(number % 2 == 0, "logreg").otherwise("svm"),
            F.lit("records_fetched"), (F.col("n") * 5).cast("string"),
        ).alias("params"),
        F.when(
            has_cv,
            F.create_map(
                F.lit("f1_weighted"), F.col("f1"), F.lit("cv_f1_mean"), F.col("cv"),
                F.lit("dummy_f1_weighted"), F.col("dummy"), F.lit("accuracy"), F.col("f1"),
            ),
        )
        .otherwise(F.create_map(F.lit("f1_weighted"), F.col("f1"), F.lit("accuracy"), F.col("f1")))
        .alias("metrics"),
        F.create_map(F.lit("promoted"), F.when(F.col("cv") > 0.7, "true").otherwise("false"))
        .alias("tags"),
    )


def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_no, f1, cv_f1, training_records)``: daily runs over a table that grows day by day.

    The whole log stands for 40,000 records, so early runs fall below the volume at which runs
    become comparable and later ones above it.
    """
    daily = (
        read_table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("value") / 100 + 0.5, 6).alias("f1"),
            F.round(
                F.avg(F.when(F.col("event_type") == "click", F.col("value"))) / 100 + 0.5, 6
            ).alias("cv_f1"),
        )
    )
    in_order = Window.partitionBy(F.lit(0)).orderBy("day")  # one row per day
    grown = F.sum("n").over(in_order)
    all_rows = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return daily.select(
        F.row_number().over(in_order).cast("long").alias("run_no"),
        "f1",
        "cv_f1",
        F.floor(grown * 40_000 / all_rows).alias("training_records"),
    )
