"""Record layouts and the fixed vocabularies of the report domain."""

from pyspark.sql import types as T

REPORT = T.StructType(
    [
        T.StructField("report_number", T.StringType()),
        T.StructField("date_received", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity_label", T.StringType()),
        T.StructField("device_name", T.StringType()),
        T.StructField("narrative_text", T.StringType()),
    ]
)

CHAMPION = T.StructType(
    [
        T.StructField("f1_weighted", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("cv_f1_mean", T.DoubleType()),
        T.StructField("cv_f1_std", T.DoubleType()),
        T.StructField("training_records", T.LongType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("checkpoint_path", T.StringType()),
    ]
)

RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("texts", T.MapType(T.StringType(), T.StringType())),
    ]
)

# --- Fixed values: results depend on these exact entries -------------------------------------

LABELS = ["D", "I", "M", "O", "UNKNOWN"]

LABEL_NAMES = {
    "D": "Death",
    "I": "Injury",
    "M": "Malfunction",
    "O": "Other",
    "UNKNOWN": "Unknown",
}

EVENT_TYPE_SEVERITY = {
    "Death": "D",
    "D": "D",
    "Serious Injury": "I",
    "Injury": "I",
    "I": "I",
    "Malfunction": "M",
    "M": "M",
    "Other": "O",
    "O": "O",
    "No Answer Provided": "UNKNOWN",
    "*": "UNKNOWN",
}

UNKNOWN = "UNKNOWN"
DEFAULT_EVENT_TYPE = "Other"

PAGE_LIMIT = 1000  # largest page a source may hand out
MIN_CLEAN_CHARS = 10  # cleaned texts must be longer than this
MIN_TRAINING_ROWS = 50
MIN_RECORDS_FOR_COMPARISON = 10_000
PROMOTION_MIN_DELTA = 0.005

NGRAM_RANGE = (1, 2)
MAX_FEATURES = 50_000
MIN_DF = 3
MAX_DF = 0.95
MAX_TOKENS = 256

# ---------------------------------------------------------------------------------------------

# Classes of a classification target. Small by nature (a model keeps one weight row per class);
# operators that carry one entry per class into every task check it against this bound.
MAX_CLASSES = 1_000
