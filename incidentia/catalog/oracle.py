"""The same results in plain SQL, written against the benchmark tables alone."""

from __future__ import annotations

from incidentia.functions.text import ABBREVIATIONS, BOILERPLATE, WHITESPACE
from incidentia.schema import EVENT_TYPE_SEVERITY, LABEL_NAMES, LABELS, MIN_RECORDS_FOR_COMPARISON
from incidentia.sources.tables import PHRASES


def _str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(column: str, entries: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_str(k)} THEN {_str(v)}" for k, v in entries.items())
    return f"CASE {column} {whens} ELSE {default} END"


def _digit(tag: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}' || CAST({key} AS VARCHAR)), 1, 1) AS INTEGER)"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_str(v) for v in values) + "]"


def _date(start: str, days: str) -> str:
    return f"strftime(DATE '{start}' + CAST({days} AS INTEGER), '%Y%m%d')"


# --- Report tables ----------------------------------------------------------------------------

_BASE = "CASE lang WHEN 'en' THEN 'M' WHEN 'fr' THEN 'I' WHEN 'de' THEN 'D' ELSE 'O' END"
_NEXT = "CASE base WHEN 'M' THEN 'I' WHEN 'I' THEN 'D' WHEN 'D' THEN 'O' ELSE 'M' END"

DOCS = f"""docs AS MATERIALIZED (
  SELECT doc_id, source, base, event, phrase || text AS narrative,
         {_case("event", EVENT_TYPE_SEVERITY, "'UNKNOWN'")} AS label,
         {_date("2024-01-01", "doc_id % 365")} AS received
  FROM (
    SELECT *, CASE WHEN u = 0 THEN 'No Answer Provided' WHEN lab = 'D' THEN 'Death'
                   WHEN lab = 'I' AND e < 8 THEN 'Injury' WHEN lab = 'I' THEN 'Serious Injury'
                   WHEN lab = 'M' THEN 'Malfunction' ELSE 'Other' END AS event
    FROM (
      SELECT *, CASE WHEN n < 2 THEN {_NEXT} ELSE base END AS lab
      FROM (
        SELECT doc_id, text, lang, source, {_BASE} AS base,
               {_digit("n", "doc_id")} AS n, {_digit("u", "doc_id")} AS u,
               {_digit("e", "doc_id")} AS e,
               ({_list(PHRASES)})[{_digit("p", "doc_id")} + 1] AS phrase
        FROM documents))))"""

REPORTS = (
    DOCS
    + """,
reports AS (
  SELECT CAST(doc_id AS VARCHAR) AS report_number, received AS date_received,
         event AS event_type, label AS severity_label, source AS device_name,
         narrative AS narrative_text
  FROM docs)"""
)

INCOMING = (
    REPORTS
    + f""",
conv AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS report_number,
         {_date("2024-06-01", "turn")} AS date_received,
         CASE WHEN role = 'user' THEN 'Malfunction' ELSE 'Injury' END AS event_type,
         CASE WHEN role = 'user' THEN 'M' ELSE 'I' END AS severity_label,
         role AS device_name, text AS narrative_text
  FROM conversations),
incoming AS (
  SELECT * FROM reports
  UNION ALL SELECT * FROM conv
  UNION ALL
  SELECT CASE WHEN {_digit("b", "item_id")} < 8 THEN '' END, '20240701', 'Other', 'O', '', text
  FROM benchmark),
held AS (
  SELECT * FROM reports
  WHERE report_number IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)),
added AS (
  SELECT * FROM incoming i
  WHERE NOT EXISTS (
    SELECT 1 FROM held h WHERE h.report_number = i.report_number AND i.report_number <> ''))"""
)

# --- Cleaning ---------------------------------------------------------------------------------


def _boilerplate(text: str) -> str:
    for phrase in BOILERPLATE:
        text = f"regexp_replace({text}, {_str(phrase)}, ' ', 'gi')"
    return text


def _abbreviations(text: str) -> str:
    # Edges are consumed, not looked at, so each substitution runs twice for adjacent hits.
    for short, full in ABBREVIATIONS.items():
        if short.endswith("/"):
            pattern, to = rf"(^|[^\pL\pN_]){short}([\pL\pN_])", rf"\1{full}\2"
        else:
            pattern, to = rf"(^|[^\pL\pN_]){short}($|[^\pL\pN_])", rf"\1{full}\2"
        for _ in range(2):
            text = f"regexp_replace({text}, {_str(pattern)}, {_str(to)}, 'gi')"
    return text


def _letters(text: str, keep: str = "a-zA-Z") -> str:
    return f"trim(regexp_replace({text}, '[^{keep}]+', ' ', 'g'))"


_CHAIN = _abbreviations(_boilerplate("narrative_text"))

ALL_CLEANED = (
    REPORTS
    + f""",
all_cleaned AS MATERIALIZED (
  SELECT *, lower({_letters(_CHAIN)}) AS clean_text FROM reports)"""
)
CLEANED = (
    ALL_CLEANED
    + """,
cleaned AS (SELECT * FROM all_cleaned WHERE length(clean_text) > 10)"""
)

WORDS = (
    CLEANED
    + """,
words AS MATERIALIZED (
  SELECT report_number, row_number() OVER (PARTITION BY report_number ORDER BY pos) AS pos, word
  FROM (
    SELECT report_number, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
    FROM (SELECT report_number, string_split(clean_text, ' ') AS ws FROM cleaned))
  WHERE length(word) >= 2)"""
)

GRAMS = (
    WORDS
    + """,
grams AS MATERIALIZED (
  SELECT report_number, word AS term FROM words
  UNION ALL
  SELECT report_number, word || ' ' || follower FROM (
    SELECT report_number, word,
           lead(word) OVER (PARTITION BY report_number ORDER BY pos) AS follower
    FROM words)
  WHERE follower IS NOT NULL),
tf AS MATERIALIZED (
  SELECT report_number, term, count(*) AS tf FROM grams GROUP BY ALL)"""
)


def _vocab(size: int) -> str:
    return (
        GRAMS
        + f""",
nd AS (SELECT count(*) AS n_docs FROM cleaned),
vocab AS MATERIALIZED (
  SELECT *, ln((1 + n_docs) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term), nd
  WHERE df >= 3 AND CAST(df AS DOUBLE) <= CAST(0.95 AS DOUBLE) * n_docs
  ORDER BY cf DESC, term LIMIT {size})"""
    )


_WEIGHTS = (
    _vocab(50_000)
    + """,
raw_weights AS (
  SELECT report_number, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (
  SELECT report_number, term, w / sqrt(sum(w * w) OVER (PARTITION BY report_number)) AS weight
  FROM raw_weights)"""
)

# --- Raw pages: what reading them must give, straight from the rule that made them ------------

_RAW = (
    DOCS
    + f""",
raw AS (
  SELECT doc_id AS page_no, received, event, source, narrative,
         {_digit("r", "doc_id")} AS r, {_digit("d", "doc_id")} AS d,
         {_digit("t", "doc_id")} AS t, {_digit("k", "doc_id")} AS k
  FROM docs),
shown AS (
  SELECT page_no, r, received AS date_received,
         CASE WHEN k = 0 THEN '' ELSE CAST(page_no AS VARCHAR) END AS report_number,
         CASE WHEN t < 8 THEN event WHEN t < 12 THEN substr(event, 1, 1)
              WHEN t < 15 THEN 'Other' ELSE 'banana' END AS event_type,
         CASE WHEN t < 12 THEN event WHEN t < 15 THEN 'Other' ELSE 'banana' END AS full_type,
         CASE WHEN d < 12 THEN source ELSE '' END AS device_name,
         trim(CASE WHEN r = 0 THEN narrative || '  end'
                   WHEN r = 1 THEN ' ' || narrative
                   WHEN r IN (2, 3, 5) THEN '' ELSE narrative END,
              {_str(WHITESPACE)}) AS narrative_text
  FROM raw),
parsed AS (
  SELECT page_no, report_number, date_received, event_type,
         {_case("event_type", EVENT_TYPE_SEVERITY, "'UNKNOWN'")} AS severity_label,
         device_name, narrative_text
  FROM shown WHERE r <> 1 AND narrative_text <> '')"""
)

# --- Splits -----------------------------------------------------------------------------------

_LABELLED = (
    DOCS
    + """,
labelled AS (
  SELECT CAST(doc_id AS VARCHAR) AS report_number, label AS severity_label, base AS prediction,
         md5(CAST(doc_id AS VARCHAR) || ':42') AS h
  FROM docs)"""
)

_SPLIT = (
    _LABELLED
    + """,
class_n AS (SELECT severity_label, count(*) AS n FROM labelled GROUP BY 1),
whole AS (
  SELECT sum(n) AS n_all, CAST(sum(n) - ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS draws
  FROM class_n),
shares AS (
  SELECT severity_label, n, draws,
         CAST(n AS DOUBLE) / CAST(n_all AS DOUBLE) * CAST(draws AS DOUBLE) AS share
  FROM class_n, whole),
quota AS (
  SELECT severity_label,
         n - (floor(share) + CASE WHEN row_number() OVER (
                 ORDER BY share - floor(share) DESC, severity_label)
               <= draws - sum(floor(share)) OVER () THEN 1 ELSE 0 END) AS n_test
  FROM shares),
split AS (
  SELECT report_number, severity_label,
         row_number() OVER (PARTITION BY severity_label ORDER BY h) <= n_test AS is_test
  FROM labelled JOIN quota USING (severity_label))"""
)

_FOLDS = (
    _LABELLED
    + """,
class_n AS (SELECT severity_label, count(*) AS n FROM labelled GROUP BY 1),
placed AS (
  SELECT severity_label, n, sum(n) OVER (ORDER BY severity_label) - n AS first FROM class_n),
dealt AS (
  SELECT severity_label, (first + i) % 5 AS fold, count(*) AS size
  FROM (SELECT severity_label, first, unnest(range(CAST(n AS BIGINT))) AS i FROM placed)
  GROUP BY ALL),
ends AS (
  SELECT f.fold, c.severity_label,
         sum(coalesce(size, 0)) OVER (PARTITION BY c.severity_label ORDER BY f.fold) AS upto
  FROM class_n c CROSS JOIN (SELECT unnest(range(5)) AS fold) f
  LEFT JOIN dealt d ON d.severity_label = c.severity_label AND d.fold = f.fold),
ranked AS (
  SELECT report_number, severity_label,
         row_number() OVER (PARTITION BY severity_label ORDER BY h) AS rn
  FROM labelled),
folded AS (
  SELECT report_number, r.severity_label, CAST(min(fold) AS BIGINT) AS fold
  FROM ranked r JOIN ends e ON e.severity_label = r.severity_label AND r.rn <= e.upto
  GROUP BY ALL)"""
)

# The same split over the rows that classifiers take.
_TRAINING = (
    CLEANED
    + """,
labelled AS (
  SELECT report_number, severity_label, md5(report_number || ':42') AS h
  FROM cleaned WHERE severity_label <> 'UNKNOWN')"""
)
_TRAINING_SPLIT = _TRAINING + _SPLIT[len(_LABELLED) :]

# --- Metrics ----------------------------------------------------------------------------------


def _class_scores(source: str, by: str = "") -> str:
    """Per-class table of ``(label, prediction)`` rows, optionally per group."""
    comma = f"{by}, " if by else ""
    return f"""
seen AS (
  SELECT DISTINCT {comma}c FROM (
    SELECT {comma}label AS c FROM {source} UNION ALL SELECT {comma}prediction FROM {source})),
cls AS (
  SELECT {comma}c,
         count(*) FILTER (WHERE s.label = c) AS support,
         count(*) FILTER (WHERE s.prediction = c) AS predicted,
         count(*) FILTER (WHERE s.label = c AND s.prediction = c) AS tp
  FROM {source} s JOIN seen {"USING (" + by + ")" if by else "ON TRUE"}
  GROUP BY {comma}c),
scored AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
         CASE WHEN support + predicted = 0 THEN 0
              ELSE 2 * tp / CAST(support + predicted AS DOUBLE) END AS f1
  FROM cls)"""


_PAIRS = (
    _LABELLED
    + """,
pairs AS (SELECT severity_label AS label, prediction FROM labelled)"""
)
_SCORED = _PAIRS + "," + _class_scores("pairs")
_WF1 = "sum(support * f1) / CAST(sum(support) AS DOUBLE)"

_GUESSED_FOLDS = (
    _FOLDS
    + """,
guess AS (
  SELECT fold, arg_max(severity_label, (n_train, -code)) AS prediction
  FROM (
    SELECT f.fold, c.severity_label, c.n - coalesce(k.n, 0) AS n_train,
           dense_rank() OVER (ORDER BY c.severity_label) AS code
    FROM class_n c CROSS JOIN (SELECT unnest(range(5)) AS fold) f
    LEFT JOIN (SELECT fold, severity_label, count(*) AS n FROM folded GROUP BY ALL) k
      ON k.fold = f.fold AND k.severity_label = c.severity_label)
  GROUP BY fold),
fold_pairs AS (
  SELECT fold, severity_label AS label, prediction FROM folded JOIN guess USING (fold)),"""
    + _class_scores("fold_pairs", "fold")
    + f""",
fold_f1 AS (SELECT fold, {_WF1} AS f1 FROM scored GROUP BY fold)"""
)

# --- Runs -------------------------------------------------------------------------------------

# Displayed scores round the exact binary value, halves to even: what printf does and round() not.
_RUN_LOG = """
daily AS (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value) / 100 + 0.5, 6) AS f1,
         round(avg(value) FILTER (WHERE event_type = 'click') / 100 + 0.5, 6) AS cv,
         round(min(value) / 100 + 0.3, 6) AS dummy
  FROM events GROUP BY 1),
runs AS (
  SELECT *, md5(strftime(day, '%Y%m%d')) AS run_id,
         epoch_ms(CAST(day AS TIMESTAMP)) + n * 1000 AS start_time,
         (day - DATE '2024-01-01') % 7 <> 3 AS has_cv, (day - DATE '2024-01-01') % 2 AS parity
  FROM daily),
history AS (
  SELECT substr(run_id, 1, 8) AS run_id,
         strftime(make_timestamp_ms(start_time), '%Y-%m-%d %H:%M') AS started,
         CAST(printf('%.4f', f1) AS DOUBLE) AS f1_holdout,
         CASE WHEN has_cv THEN CAST(printf('%.4f', cv) AS DOUBLE) END AS cv_f1_mean,
         CAST(printf('%.4f', f1) AS DOUBLE) AS accuracy,
         CASE WHEN has_cv THEN CAST(printf('%.4f', dummy) AS DOUBLE) ELSE 0 END AS dummy_f1,
         CASE WHEN parity = 0 THEN 'logreg' ELSE 'svm' END AS model, n * 5 AS records,
         CASE WHEN cv > 0.7 THEN 'true' ELSE 'false' END AS promoted, '' AS reason, start_time
  FROM runs ORDER BY start_time DESC, runs.run_id LIMIT 20),
trend AS (
  SELECT row_number() OVER (ORDER BY start_time, run_id DESC) AS run_no, f1_holdout, cv_f1_mean,
         first_value(dummy_f1) OVER (ORDER BY start_time DESC) AS dummy_f1
  FROM history)"""

_SCORED_RUNS = """
daily AS (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value) / 100 + 0.5, 6) AS f1,
         round(avg(value) FILTER (WHERE event_type = 'click') / 100 + 0.5, 6) AS cv_f1
  FROM events GROUP BY 1),
sruns AS (
  SELECT row_number() OVER (ORDER BY day) AS run_no, f1, cv_f1,
         CAST(floor(sum(n) OVER (ORDER BY day) * 40000 / CAST(sum(n) OVER () AS DOUBLE)) AS BIGINT)
           AS training_records
  FROM daily)"""

_LOGITS = """
parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings)"""


def _softmax(logits: str) -> str:
    """Probabilities and first maximum of ``(vec_id, c, z)`` rows."""
    return f"""{logits},
shifted AS (SELECT vec_id, c, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e, z FROM logits),
probs AS (SELECT vec_id, c, z, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM shifted)"""


_PROB_COLUMNS = ", ".join(
    f"round(max(p) FILTER (WHERE c = {i}), 6) AS p_{label}" for i, label in enumerate(LABELS)
)
_PREDICT = (
    f"SELECT vec_id, ({_list(LABELS)})[CAST(arg_max(c, (z, -c)) AS INTEGER) + 1] "
    f"AS predicted_label, {_PROB_COLUMNS} FROM probs GROUP BY vec_id"
)
_SUM_LOGITS = _softmax(
    _LOGITS
    + """,
logits AS (SELECT vec_id, i % 5 AS c, sum(CAST(x AS DOUBLE)) AS z FROM parts GROUP BY ALL)"""
)
_COS_LOGITS = _softmax(
    _LOGITS
    + """,
logits AS (
  SELECT vec_id, c, sum(CAST(x AS DOUBLE) * cos(CAST(c * 64 + i AS DOUBLE))) AS z
  FROM parts CROSS JOIN (SELECT unnest(range(5)) AS c)
  GROUP BY ALL)"""
)


_CALIBRATION = (
    _SUM_LOGITS
    + f""",
judged AS (
  SELECT p.vec_id, max(p) AS confidence,
         arg_max(c, (z, -c)) = max(e.label) % 5 AS correct
  FROM probs p JOIN embeddings e USING (vec_id) GROUP BY p.vec_id),
bins AS (
  SELECT least(floor(confidence * 50), 49)::BIGINT AS bin, count(*) AS n,
         avg(confidence) AS confidence, avg(correct::DOUBLE) AS accuracy
  FROM judged GROUP BY 1)"""
)

_LABEL_SCORES = (
    _SUM_LOGITS
    + f""",
lab AS (SELECT unnest({_list(LABELS)}) AS label, unnest(range(5)) AS c),
scored AS (
  SELECT vec_id, l.c, label, round(1 / (1 + exp(-z)), 3) AS score,
         CAST('0x' || substr(md5(label || '?' || CAST(vec_id AS VARCHAR)), 1, 1) AS INTEGER) < 5 AS t
  FROM logits JOIN lab l ON l.c = logits.c),
ranks AS (
  SELECT a.vec_id, a.c, a.t, count(*) AS rank, count(*) FILTER (WHERE b.t) AS true_rank
  FROM scored a JOIN scored b ON a.vec_id = b.vec_id AND b.score >= a.score
  GROUP BY ALL),
rows_ AS (
  SELECT vec_id, count(*) FILTER (WHERE t AND score >= 0.5) AS tp, count(*) FILTER (WHERE t) AS nt,
         count(*) FILTER (WHERE score >= 0.5) AS np
  FROM scored GROUP BY vec_id),
ranking AS (
  SELECT vec_id, coalesce(max(rank) FILTER (WHERE t), 0) AS coverage,
         CASE WHEN count(*) FILTER (WHERE t) IN (0, 5) THEN 1
              ELSE avg(true_rank / rank::DOUBLE) FILTER (WHERE t) END AS lrap
  FROM ranks GROUP BY vec_id)"""
)


def _hex(tag: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}' || key), 1, 1) AS INTEGER)"


_ENTITY_SPANS = f"""
keyed AS (
  SELECT doc_id AS doc, CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR) AS key
  FROM documents, (SELECT unnest([0, 1, 2, 3, 3]) AS k)),
kinds AS (SELECT ['ADVERSE_EVENT', 'BODY_PART', 'DEVICE'] AS names),
true_spans AS (
  SELECT doc, names[{_hex("c")} % 3 + 1] AS type, 7 * {_hex("a")} + {_hex("b")} AS s,
         7 * {_hex("a")} + {_hex("b")} + 4 + {_hex("l")} AS e
  FROM keyed, kinds),
guesses AS (
  SELECT doc, names[({_hex("c")} + ({_hex("y")} = 0)::INTEGER) % 3 + 1] AS type,
         7 * {_hex("a")} + {_hex("b")} + greatest({_hex("g")} - 10, 0) AS s,
         7 * {_hex("a")} + {_hex("b")} + greatest({_hex("g")} - 10, 0) + 4 + {_hex("l")} AS e
  FROM keyed, kinds WHERE {_hex("h")} > 2),
sides AS (
  SELECT doc, type, s, e, coalesce(a, 0) AS a, coalesce(b, 0) AS b
  FROM (SELECT doc, type, s, e, count(*) AS a FROM true_spans GROUP BY ALL)
  FULL JOIN (SELECT doc, type, s, e, count(*) AS b FROM guesses GROUP BY ALL) USING (doc, type, s, e)),
pairs AS (
  SELECT x.doc, x.type, x.s, x.e, y.s AS gs, y.e AS ge, x.a - least(x.a, x.b) AS na,
         y.b - least(y.a, y.b) AS nb, least(x.e, y.e) - greatest(x.s, y.s) AS shared,
         greatest(x.e, y.e) - least(x.s, y.s) AS spanned
  FROM sides x JOIN sides y ON x.doc = y.doc AND x.type = y.type AND x.s < y.e AND y.s < x.e
    AND (x.s <> y.s OR x.e <> y.e)
  WHERE x.a > x.b AND y.b > y.a),
rounds AS (
  SELECT *, 0::BIGINT AS m FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT doc, type, s, e, gs, ge, (na - sum(m) OVER (PARTITION BY doc, type, s, e))::BIGINT AS na,
           (nb - sum(m) OVER (PARTITION BY doc, type, gs, ge))::BIGINT AS nb, shared, spanned, m
    FROM (
      SELECT doc, type, s, e, gs, ge, na, nb, shared, spanned,
             CASE WHEN i = 1 AND j = 1 THEN least(na, nb) ELSE 0 END AS m
      FROM (
        SELECT *,
          row_number() OVER (PARTITION BY doc, type, s, e ORDER BY shared DESC, spanned, s, e, gs, ge) AS i,
          row_number() OVER (PARTITION BY doc, type, gs, ge ORDER BY shared DESC, spanned, s, e, gs, ge) AS j
        FROM rounds WHERE m = 0)))
  WHERE m > 0 OR (na > 0 AND nb > 0)),
per_type AS (
  SELECT type, sum(a) AS n_true, sum(b) AS n_predicted, sum(least(a, b)) AS strict_hits,
         sum(least(a, b)) + coalesce(any_value(extra), 0) AS partial_hits
  FROM sides LEFT JOIN (
    SELECT type, sum(m * shared / spanned::DOUBLE) AS extra FROM rounds WHERE m > 0 GROUP BY type)
    USING (type)
  GROUP BY type),
bounds AS (
  SELECT sum(least(a, b)) / sum(a)::DOUBLE AS accuracy
  FROM (SELECT sum(a) AS a, sum(b) AS b FROM sides GROUP BY doc, s, e)),
every AS (
  SELECT * FROM per_type
  UNION ALL
  SELECT 'all', sum(n_true), sum(n_predicted), sum(strict_hits), sum(partial_hits) FROM per_type)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _rule_coefficients(value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_str(label)} AS label, {i} AS c, term, idf, "
        f"({_digit(label + ':', 'term')} - 7.5) / CAST(10.0 AS DOUBLE){value} AS coef FROM vocab"
        for i, label in enumerate(LABELS)
    )


def _code(column: str) -> str:
    return f"coalesce(nullif(list_position({_list(LABELS)}, {column}), 0) - 1, 4)"


def _report_lines() -> str:
    return """
SELECT c AS class_name, precision, recall, f1, support, 0 AS o FROM scored
UNION ALL
SELECT 'accuracy', a, a, a, s, 1 FROM (
  SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS a, sum(support) AS s FROM scored)
UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support), 1 FROM scored
UNION ALL
SELECT 'weighted avg', sum(precision * support) / CAST(sum(support) AS DOUBLE),
       sum(recall * support) / CAST(sum(support) AS DOUBLE),
       sum(f1 * support) / CAST(sum(support) AS DOUBLE), sum(support), 1 FROM scored"""


_MATRIX = """
trained AS (SELECT DISTINCT label AS t FROM pairs),
matrix AS (
  SELECT a.t AS label, b.t AS prediction,
         (SELECT count(*) FROM pairs p WHERE p.label = a.t AND p.prediction = b.t) AS n
  FROM trained a CROSS JOIN trained b)"""


def all_oracles() -> dict[str, str]:
    names = {k: v for k, v in LABEL_NAMES.items()}
    q: dict[str, str] = {}

    # Text
    q["strip_boilerplate"] = _with(
        REPORTS, f"SELECT report_number, {_boilerplate('narrative_text')} AS text_out FROM reports"
    )
    q["expand_abbreviations"] = _with(
        REPORTS, f"SELECT report_number, {_abbreviations('narrative_text')} AS text_out FROM reports"
    )
    q["clean_text_tfidf"] = _with(
        ALL_CLEANED, "SELECT report_number, clean_text FROM all_cleaned"
    )
    q["clean_text_digits"] = _with(
        REPORTS,
        f"SELECT report_number, lower({_letters(_CHAIN, 'a-zA-Z0-9')}) AS clean_text FROM reports",
    )
    q["clean_text_cased"] = _with(
        REPORTS, f"SELECT report_number, {_letters(_CHAIN)} AS clean_text FROM reports"
    )
    q["clean_blank_guard"] = _with(
        INCOMING,
        f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE c = '') AS n_blank,
  CAST(0 AS BIGINT) AS n_null
FROM (SELECT coalesce(CASE WHEN report_number IS NOT NULL THEN {_letters(_CHAIN)} END, '') AS c
      FROM incoming)""",
    )
    q["clean_table"] = _with(
        CLEANED, "SELECT report_number, severity_label, clean_text FROM cleaned"
    )
    q["drop_short"] = _with(
        ALL_CLEANED,
        """SELECT count(*) AS n_before, count(*) FILTER (WHERE length(clean_text) > 10) AS n_after,
  count(*) FILTER (WHERE length(clean_text) <= 10) AS n_dropped FROM all_cleaned""",
    )
    q["text_length"] = _with(
        REPORTS, "SELECT report_number, length(narrative_text) AS text_length FROM reports"
    )
    q["tokens"] = _with(
        CLEANED,
        """SELECT report_number, len(ws) AS n_tokens, md5(array_to_string(ws, ' ')) AS digest
FROM (SELECT report_number, list_filter(string_split(clean_text, ' '),
                                        lambda w: length(w) >= 2) AS ws FROM cleaned)""",
    )
    q["tokens_raw"] = """
SELECT doc_id, len(ws) AS n_tokens, md5(array_to_string(ws, ' ')) AS digest
FROM (
  SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pN_]+'),
                             lambda w: regexp_full_match(w, '[a-z][a-z]+')) AS ws
  FROM documents)"""
    q["ngrams"] = _with(
        GRAMS,
        """SELECT report_number, count(term) AS n_grams, count(DISTINCT term) AS n_distinct,
  md5(coalesce(string_agg(term, ' ' ORDER BY term), '')) AS digest
FROM cleaned LEFT JOIN grams USING (report_number) GROUP BY report_number""",
    )
    q["truncate_tokens"] = _with(
        REPORTS,
        f"""SELECT report_number, array_to_string(list_slice(ws, 1, 254), ' ') AS kept,
  len(ws) > 254 AS is_truncated
FROM (SELECT report_number, string_split(lower({_letters(_CHAIN, "a-zA-Z0-9")}), ' ') AS ws
      FROM reports)""",
    )
    q["truncation_rate"] = _with(
        REPORTS,
        f"""SELECT round(avg(CAST(
    len(string_split(lower({_letters(_CHAIN, "a-zA-Z0-9")}), ' ')) > 254 AS INTEGER)), 6)
  AS truncation_rate FROM reports""",
    )

    # Raw records
    q["parse_record"] = _with(_RAW, "SELECT * FROM parsed")
    q["narrative_join"] = _with(_RAW, "SELECT page_no, narrative_text FROM shown")
    q["device_name"] = _with(_RAW, "SELECT page_no, device_name FROM shown")
    q["first_event_type"] = _with(_RAW, "SELECT page_no, event_type FROM shown")
    q["full_event_type"] = _with(_RAW, "SELECT page_no, full_type AS event_type FROM shown")
    q["severity_map"] = _with(
        _RAW,
        f"SELECT page_no, {_case('event_type', EVENT_TYPE_SEVERITY, _str('UNKNOWN'))} "
        "AS severity_label FROM shown",
    )
    q["reject_reasons"] = _with(
        _RAW,
        """SELECT CASE WHEN r = 1 THEN 'malformed_narrative' ELSE 'no_narrative' END
  AS reject_reason, count(*) AS n
FROM shown WHERE r = 1 OR narrative_text = '' GROUP BY 1""",
    )
    q["narrative_exists"] = _with(_RAW, "SELECT page_no FROM shown WHERE r <> 5")
    q["source_bounded_prefix"] = _with(
        _RAW,
        "SELECT * EXCLUDE (page_no) FROM (SELECT * FROM parsed ORDER BY page_no LIMIT 500)",
    )
    q["head_rows"] = "SELECT * FROM documents ORDER BY doc_id LIMIT 5"

    # Labels, filters, exploring
    q["drop_unknown"] = _with(
        _LABELLED,
        """SELECT report_number, severity_label FROM labelled
WHERE severity_label IS DISTINCT FROM 'UNKNOWN'""",
    )
    q["label_encode"] = _with(
        REPORTS,
        f"""SELECT report_number, CAST({_code("severity_label")} AS INTEGER) AS label_code,
  CAST({_code("event_type")} AS INTEGER) AS event_code FROM reports""",
    )
    q["label_decode"] = _with(
        _LABELLED, "SELECT report_number, severity_label AS label FROM labelled"
    )
    q["label_name"] = _with(
        REPORTS,
        f"""SELECT report_number, {_case("severity_label", names, "NULL")} AS label_name,
  {_case("event_type", names, "NULL")} AS event_name,
  {_case("event_type", names, "event_type")} AS event_or_name FROM reports""",
    )
    q["label_distribution"] = _with(
        CLEANED, "SELECT severity_label, count(*) AS n FROM cleaned GROUP BY 1"
    )
    q["class_count_metrics"] = _with(
        _LABELLED,
        """SELECT 'class_count_' || severity_label AS metric, CAST(count(*) AS DOUBLE) AS value
FROM labelled GROUP BY 1""",
    )
    q["distinct_labels"] = _with(_LABELLED, "SELECT DISTINCT severity_label FROM labelled")
    q["severity_filter"] = _with(
        _LABELLED,
        "SELECT report_number, severity_label FROM labelled WHERE severity_label IN ('D', 'I')",
    )
    q["narrative_search"] = _with(
        REPORTS,
        """SELECT report_number, narrative_text FROM reports
WHERE regexp_matches(narrative_text, 'device|pt[s ]|Model \\d+', 'i')""",
    )
    q["literal_search"] = _with(
        REPORTS,
        "SELECT report_number FROM reports WHERE contains(lower(narrative_text), 'w/h/o pt')",
    )
    q["explore_filter"] = _with(
        CLEANED,
        """SELECT report_number, date_received, severity_label, device_name, clean_text
FROM cleaned WHERE severity_label IN ('D', 'M') AND regexp_matches(clean_text, 'patient|the ')""",
    )
    q["median_length_by_label"] = _with(
        REPORTS,
        """SELECT severity_label, median(length(narrative_text)) AS median_length
FROM reports GROUP BY 1""",
    )
    q["severity_overview"] = _with(
        CLEANED,
        """SELECT severity_label, count(*) AS n_reports,
  round(avg(length(clean_text)), 6) AS avg_clean_length,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM cleaned WHERE severity_label <> 'UNKNOWN' GROUP BY 1""",
    )

    # Merge
    q["anti_join_new"] = _with(INCOMING, "SELECT * FROM added")
    q["merge_dedup"] = _with(INCOMING, "SELECT * FROM held UNION ALL SELECT * FROM added")
    q["append_rows"] = _with(
        INCOMING,
        """SELECT report_number, date_received, event_type, severity_label,
  NULL::VARCHAR AS device_name FROM held
UNION ALL SELECT report_number, date_received, NULL, severity_label, device_name FROM conv""",
    )
    q["count_new"] = _with(INCOMING, "SELECT count(*) AS n_new FROM added")
    q["intra_batch_dedup"] = _with(
        INCOMING,
        """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY report_number ORDER BY date_received DESC,
    event_type DESC, severity_label DESC, device_name DESC, narrative_text DESC) AS rn
  FROM incoming)
WHERE rn = 1 OR coalesce(report_number, '') = ''""",
    )
    q["ingest_summary"] = _with(
        INCOMING,
        """SELECT CAST(10000 AS BIGINT) AS batch_requested,
  (SELECT count(*) FROM incoming) AS batch_returned,
  (SELECT count(*) FROM added) AS new_records_added,
  (SELECT count(*) FROM held) + (SELECT count(*) FROM added) AS total_accumulated""",
    )
    q["retrain_decision"] = _with(
        INCOMING,
        """SELECT count(*) > 0 AS after_new, FALSE AS after_none, TRUE AS no_model,
  FALSE AS switched_off FROM added""",
    )
    q["incremental_ingest"] = _with(
        INCOMING + "," + _RAW[len(DOCS) + 1 :],
        """SELECT report_number, date_received, event_type, severity_label, device_name,
  narrative_text FROM held
UNION ALL
SELECT * EXCLUDE (page_no) FROM parsed p
WHERE report_number = '' OR report_number NOT IN (SELECT report_number FROM held)""",
    )

    # Splits
    q["stratified_split"] = _with(_SPLIT, "SELECT * FROM split")
    q["stratified_split_repeated_keys"] = _with(
        INCOMING,
        """, sizes AS (
  SELECT severity_label, count(*) AS n, sum(count(*)) OVER () AS n_all
  FROM incoming GROUP BY 1),
drawn AS (
  SELECT *, n_all - ceil(CAST(0.2 AS DOUBLE) * n_all) AS draws,
    n / CAST(n_all AS DOUBLE) * (n_all - ceil(CAST(0.2 AS DOUBLE) * n_all)) AS share FROM sizes),
placed AS (
  SELECT *, floor(share) AS base, draws - sum(floor(share)) OVER () AS missing,
    row_number() OVER (ORDER BY share - floor(share) DESC, severity_label) AS place FROM drawn),
quota AS (
  SELECT severity_label, n, CAST(base AS BIGINT) + (place <= missing)::BIGINT AS train FROM placed)
SELECT severity_label, side, CASE side WHEN 0 THEN train ELSE n - train END AS n
FROM quota, (SELECT unnest([0, 1])::INTEGER AS side)""",
    )
    q["kfold_repeated_keys"] = _with(
        INCOMING,
        """SELECT severity_label, side, count(*) AS n
FROM (SELECT severity_label,
        ((row_number() OVER (ORDER BY severity_label) - 1) % 5)::INTEGER AS side FROM incoming)
GROUP BY 1, 2""",
    )
    q["kfold_assign"] = _with(_FOLDS, "SELECT * FROM folded")
    q["positional_split"] = """
SELECT doc_id, row_number() OVER (ORDER BY doc_id)
  <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER ()) AS is_first FROM documents"""

    # Metrics
    q["class_weights"] = _with(
        _LABELLED
        + """,
present AS (
  SELECT severity_label, count(*) AS n FROM labelled WHERE severity_label <> 'UNKNOWN' GROUP BY 1)""",
        f"""SELECT l.label, coalesce(round((SELECT sum(n) FROM present)
  / CAST((SELECT count(*) FROM present) * p.n AS DOUBLE), 6), 0) AS weight
FROM (SELECT unnest({_list(LABELS)}) AS label) l
LEFT JOIN present p ON p.severity_label = l.label""",
    )
    q["binary_class_weights"] = """
SELECT CAST(toxic AS VARCHAR) AS label,
  round(sum(count(*)) OVER () / CAST(2 * count(*) AS DOUBLE), 6) AS weight
FROM labels GROUP BY toxic"""
    q["accuracy"] = _with(
        _PAIRS,
        "SELECT round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM pairs",
    )
    q["weighted_f1"] = _with(_SCORED, f"SELECT round({_WF1}, 6) AS f1_weighted FROM scored")
    q["class_report"] = _with(
        _SCORED,
        f"""SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM ({_report_lines()})""",
    )
    q["confusion_matrix"] = _with(_PAIRS + "," + _MATRIX, "SELECT * FROM matrix")
    q["evaluate_bundle"] = _with(
        _SCORED + "," + _MATRIX,
        f"""SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round({_WF1}, 6) AS f1_weighted,
  (SELECT string_agg(t, ',' ORDER BY t) FROM trained) AS classes,
  (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY label, prediction) FROM matrix) AS matrix,
  (SELECT md5(string_agg(printf('%-14s precision=%.4f recall=%.4f f1=%.4f support=%d',
      class_name, precision, recall, f1, CAST(support AS BIGINT)), chr(10) ORDER BY o, class_name))
   FROM ({_report_lines()})) AS report_digest
FROM scored""",
    )
    q["majority_baseline"] = _with(
        _SPLIT
        + """,
top AS (
  SELECT severity_label AS prediction FROM split WHERE NOT is_test
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
guessed AS (SELECT severity_label AS label, prediction FROM split, top WHERE is_test),"""
        + _class_scores("guessed"),
        f"""SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS dummy_accuracy,
  round({_WF1}, 6) AS dummy_f1_weighted FROM scored""",
    )
    dummy = """(SELECT sum(n * CASE WHEN n = m THEN 2 * n / CAST(t + n AS DOUBLE) ELSE 0 END) / t
  FROM (SELECT n, max(n) OVER () AS m, sum(n) OVER () AS t
        FROM (SELECT label, count(*) AS n FROM pairs GROUP BY 1)) GROUP BY t)"""
    q["beats_baseline"] = _with(
        _SCORED,
        f"""SELECT {_WF1} > {dummy} AS beats_dummy, round({_WF1} - {dummy}, 6) AS delta
FROM scored""",
    )
    q["cv_majority"] = _with(
        _GUESSED_FOLDS, "SELECT CAST(fold AS BIGINT) AS fold, round(f1, 6) AS f1 FROM fold_f1"
    )
    q["cv_summary"] = _with(
        _GUESSED_FOLDS,
        """SELECT string_agg(printf('%.6f', f1), ',' ORDER BY fold) AS per_fold,
  round(avg(f1), 6) AS cv_f1_mean, round(stddev_pop(f1), 6) AS cv_f1_std,
  count(*) AS n_splits FROM fold_f1""",
    )

    q["chance_agreement"] = _with(
        _PAIRS
        + """,
margins AS (
  SELECT c, count(*) FILTER (WHERE label = c) AS a, count(*) FILTER (WHERE prediction = c) AS b
  FROM pairs, (SELECT DISTINCT unnest([label, prediction]) AS c FROM pairs) GROUP BY c),
agreed AS (
  SELECT avg((label = prediction)::DOUBLE) AS o,
         (SELECT sum(a * b)::DOUBLE FROM margins) / (count(*) * count(*)) AS x
  FROM pairs)""",
        """SELECT round(o, 6) AS observed, round(x, 6) AS expected,
  round((o - x) / (1 - x), 6) AS kappa FROM agreed""",
    )
    q["calibration_bins"] = _with(
        _CALIBRATION,
        "SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins",
    )
    q["calibration_error"] = _with(
        _CALIBRATION,
        """SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS expected_error,
  round(max(abs(accuracy - confidence)), 6) AS largest_error FROM bins""",
    )
    growth = "(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE))"
    q["latency_percentiles"] = f"""
WITH counts AS (
  SELECT event_type, CASE WHEN value > 0 THEN ceil(ln(value) / ln{growth}) END AS bucket,
         count(*) AS k
  FROM events WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, sum(k) OVER (PARTITION BY event_type) AS n,
         sum(k) OVER (PARTITION BY event_type ORDER BY bucket NULLS FIRST) AS upto
  FROM counts)
SELECT event_type, share, coalesce(round(2 * pow({growth}, bucket) / ({growth} + 1), 6), 0) AS value,
  CAST(n AS BIGINT) AS n
FROM ranked, (SELECT unnest([CAST(0.5 AS DOUBLE), 0.95, 0.99]) AS share)
WHERE upto >= ceil(share * n) AND upto - k < ceil(share * n)"""
    q["composite_score"] = _with(
        _SCORED,
        f"""SELECT round(CAST(0.5 AS DOUBLE) * {_WF1} + CAST(0.3 AS DOUBLE) * avg(f1)
  + CAST(0.2 AS DOUBLE) * sum(tp) / sum(support), 6) AS composite FROM scored""",
    )

    # Several labels
    hot = [f"max(severity_label = {_str(label)})" for label in LABELS]
    q["multi_hot_labels"] = _with(
        INCOMING
        + f""",
grouped AS (
  SELECT report_number, [{", ".join(hot)}] AS hot FROM incoming WHERE report_number <> ''
  GROUP BY report_number
  UNION ALL
  SELECT report_number, [{", ".join(hot).replace("max(", "(")}] FROM incoming
  WHERE coalesce(report_number, '') = '')""",
        f"""SELECT array_to_string(list_transform(list_filter(range(1, 6), lambda i: hot[i]),
    lambda i: {_list(LABELS)}[i]), ',') AS label_set,
  array_to_string(list_transform(hot, lambda x: x::INTEGER::VARCHAR), '') AS multi_hot,
  count(*) AS n, max(report_number) AS last_number
FROM grouped GROUP BY ALL""",
    )
    q["sigmoid_label_sets"] = _with(
        _LABEL_SCORES,
        """SELECT vec_id, coalesce(string_agg(label, ',' ORDER BY c) FILTER (WHERE t), '') AS true_labels,
  coalesce(string_agg(label, ',' ORDER BY c) FILTER (WHERE score >= 0.5), '') AS above_half,
  coalesce(string_agg(label, ',' ORDER BY c)
    FILTER (WHERE score >= ([CAST(0.3 AS DOUBLE), 0.4, 0.5, 0.6, 0.7])[c::INTEGER + 1]), '') AS above_own
FROM scored GROUP BY vec_id""",
    )
    q["best_thresholds"] = _with(
        _LABEL_SCORES
        + """,
steps AS (
  SELECT label, score,
         sum(t::INTEGER) OVER down AS tp, count(*) OVER down AS predicted,
         sum(t::INTEGER) OVER (PARTITION BY label) AS pos, count(*) OVER (PARTITION BY label) AS n
  FROM scored WINDOW down AS (PARTITION BY label ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
rated AS (SELECT DISTINCT *, 2 * tp / (predicted + pos)::DOUBLE AS f1 FROM steps)""",
        """SELECT label, score AS threshold, round(f1, 6) AS f1, pos::BIGINT AS n_positive, n
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, score DESC) AS k FROM rated)
WHERE k = 1""",
    )
    q["multilabel_metrics"] = _with(
        _LABEL_SCORES
        + """,
per_label AS (
  SELECT label, 2 * count(*) FILTER (WHERE t AND score >= 0.5)
    / nullif(count(*) FILTER (WHERE t) + count(*) FILTER (WHERE score >= 0.5), 0)::DOUBLE AS f1
  FROM scored GROUP BY label)""",
        """SELECT round(2 * sum(tp) / (sum(nt) + sum(np))::DOUBLE, 6) AS micro_f1,
  (SELECT round(sum(coalesce(f1, 0)) / 5, 6) FROM per_label) AS macro_f1,
  round(avg((nt + np - 2 * tp) / CAST(5 AS DOUBLE)), 6) AS hamming_loss,
  round(avg(CASE WHEN nt + np - tp = 0 THEN 1 ELSE tp / (nt + np - tp)::DOUBLE END), 6) AS jaccard,
  (SELECT round(avg(coverage), 6) FROM ranking) AS coverage_error,
  (SELECT round(avg(lrap), 6) FROM ranking) AS ranking_precision
FROM rows_""",
    )

    # Entities
    q["entity_scores"] = "WITH RECURSIVE " + (
        _ENTITY_SPANS.strip()
        + """
SELECT type, n_true::BIGINT AS n_true, n_predicted::BIGINT AS n_predicted,
  strict_hits::BIGINT AS strict_hits, round(partial_hits, 6)::DOUBLE AS partial_hits,
  round(strict_hits / n_predicted::DOUBLE, 6) AS strict_precision,
  round(strict_hits / n_true::DOUBLE, 6) AS strict_recall,
  round(2 * strict_hits / (n_true + n_predicted)::DOUBLE, 6) AS strict_f1,
  round(partial_hits / n_predicted, 6) AS partial_precision,
  round(partial_hits / n_true, 6) AS partial_recall,
  round(2 * partial_hits / (n_true + n_predicted), 6) AS partial_f1,
  CASE WHEN type = 'all' THEN round(accuracy, 6) END AS boundary_accuracy
FROM every, bounds"""
    )

    first = "lower(array_to_string(regexp_extract_all(text, '[\\pL\\pN]+')[1:"
    q["dictionary_entities"] = "WITH RECURSIVE " + (
        f"""
dict AS (
  SELECT phrase, min(type) AS type, len(string_split(phrase, ' ')) AS n
  FROM (
    SELECT {first}({_digit("l", "item_id")} % 3 + 1)], ' ')) AS phrase,
           (['ADVERSE_EVENT', 'BODY_PART', 'DEVICE'])[{_digit("c", "item_id")} % 3 + 1] AS type
    FROM benchmark)
  WHERE phrase <> '' GROUP BY phrase),
parts AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '([^\\pL\\pN]*)([\\pL\\pN]+)', 1)) AS gap,
         unnest(regexp_extract_all(text, '([^\\pL\\pN]*)([\\pL\\pN]+)', 2)) AS raw,
         generate_subscripts(regexp_extract_all(text, '[\\pL\\pN]+'), 1) AS pos
  FROM documents),
words AS MATERIALIZED (
  SELECT doc_id, pos, lower(raw) AS w, length(raw) AS size,
         sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop
  FROM parts),
looks AS (
  SELECT doc_id, pos, stop - size AS start, w AS p1, w || ' ' || lead(w) OVER d AS p2,
         w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS p3,
         [stop, lead(stop) OVER d, lead(stop, 2) OVER d] AS stops
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
hits AS MATERIALIZED (
  SELECT doc_id, pos, arg_max(n, n) AS n, any_value(start) AS start,
         arg_max(stops[n], n) AS stop, arg_max(type, n) AS type, arg_max(phrase, n) AS phrase
  FROM (SELECT l.*, d.n, d.type, d.phrase FROM looks l JOIN dict d ON d.n = 1 AND d.phrase = p1
        UNION ALL SELECT l.*, d.n, d.type, d.phrase FROM looks l JOIN dict d ON d.n = 2 AND d.phrase = p2
        UNION ALL SELECT l.*, d.n, d.type, d.phrase FROM looks l JOIN dict d ON d.n = 3 AND d.phrase = p3)
  GROUP BY doc_id, pos),
nexts AS MATERIALIZED (
  SELECT a.doc_id, a.pos, b.pos AS after
  FROM (SELECT doc_id, pos, pos + n AS free FROM hits) a
  ASOF JOIN (SELECT doc_id, pos FROM hits) b ON a.doc_id = b.doc_id AND a.free <= b.pos),
chain AS (
  SELECT doc_id, min(pos) AS pos FROM hits GROUP BY doc_id
  UNION ALL SELECT c.doc_id, n.after FROM chain c JOIN nexts n ON n.doc_id = c.doc_id AND n.pos = c.pos)
SELECT doc_id, type, start::INTEGER AS start, stop::INTEGER AS "end", phrase
FROM chain JOIN hits USING (doc_id, pos)"""
    ).strip()

    # Exchange
    resources = INCOMING + """,
fields AS (
  SELECT report_number, severity_label, narrative_text,
         nullif(report_number, '') AS number, nullif(device_name, '') AS device, event_type,
         CASE WHEN severity_label IN ('D', 'I') THEN 'serious'
              WHEN severity_label IN ('M', 'O') THEN 'non-serious' END AS category,
         date_received[1:4] || '-' || date_received[5:6] || '-' || date_received[7:8] AS day
  FROM incoming),
resources AS (
  SELECT report_number, severity_label,
    '{"resourceType":"AdverseEvent"'
    || CASE WHEN number IS NULL THEN '' ELSE ',"identifier":{"value":"' || number || '"}' END
    || ',"status":"completed","actuality":"actual"'
    || CASE WHEN category IS NULL THEN '' ELSE ',"category":[{"text":"' || category || '"}]' END
    || ',"event":{"text":"' || event_type || '"},"subject":{"reference":"Patient/anonymous"}'
    || ',"date":"' || day || '"'
    || CASE WHEN category IS NULL THEN '' ELSE ',"seriousness":' || (category = 'serious')::VARCHAR END
    || CASE WHEN device IS NULL THEN '' ELSE ',"suspectEntity":[{"instance":{"display":"' || device || '"}}]' END
    || ',"extension":[{"url":"severity_score"'
    || coalesce(',"valueDecimal":' || (length(narrative_text) % 100 / CAST(100 AS DOUBLE))::VARCHAR, '')
    || '},{"url":"classifier_version","valueString":"v1"}]}' AS resource,
    concat_ws(',', CASE WHEN number IS NULL THEN 'identifier' END,
              CASE WHEN category IS NULL THEN 'category' END,
              CASE WHEN device IS NULL THEN 'suspectEntity' END) AS missing
  FROM fields)"""
    q["exchange_resources"] = _with(
        resources, "SELECT report_number, resource, missing, missing = '' AS complete FROM resources"
    )
    q["exchange_pass_rate"] = _with(
        resources,
        """SELECT coalesce(severity_label, 'all') AS severity_label, count(*) AS n,
  count(*) FILTER (WHERE missing = '') AS n_complete,
  round(avg((missing = '')::DOUBLE), 6) AS pass_rate
FROM resources GROUP BY ROLLUP (severity_label)""",
    )

    # Features
    q["term_frequency"] = _with(
        GRAMS,
        """SELECT report_number, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams,
  max(tf) AS max_tf, md5(string_agg(term || ':' || tf, ' ' ORDER BY term || ':' || tf)) AS digest
FROM tf GROUP BY report_number""",
    )
    q["document_frequency"] = _with(
        GRAMS,
        """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term
HAVING count(*) >= 3
  AND count(*) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM cleaned)""",
    )
    q["vocabulary_topk"] = _with(
        _vocab(50_000), "SELECT term, df, cf, round(idf, 6) AS idf FROM vocab"
    )
    q["sublinear_idf"] = _with(
        _vocab(50_000),
        "SELECT term, round(1 + ln(cf), 6) AS log_cf, round(idf, 6) AS idf FROM vocab",
    )
    q["tfidf_weights"] = _with(
        _WEIGHTS, "SELECT report_number, term, round(weight, 6) AS weight FROM weights"
    )
    q["linear_score"] = _with(
        _WEIGHTS
        + f""",
coefs AS ({_rule_coefficients("")}),
sums AS (
  SELECT report_number, label, sum(weight * coef) AS s
  FROM weights JOIN coefs USING (term) GROUP BY ALL)""",
        f"""SELECT d.report_number, l.label,
  round(coalesce(s, 0) + CAST(0.1 AS DOUBLE) * l.c, 6) AS score
FROM cleaned d
CROSS JOIN (SELECT unnest({_list(LABELS)}) AS label, unnest(range(5)) AS c) l
LEFT JOIN sums USING (report_number, label)""",
    )
    q["top_terms_per_class"] = _with(
        _vocab(50_000)
        + f""",
coefs AS (SELECT label, term, round(coef, 6) AS coef FROM ({_rule_coefficients(" * idf")}))""",
        """SELECT * FROM (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY coef DESC, term) AS rank, term, coef
  FROM coefs) WHERE rank <= 15""",
    )

    # Scores
    q["softmax_argmax"] = _with(_SUM_LOGITS, _PREDICT)
    q["rank_class_scores"] = _with(
        _SUM_LOGITS
        + f""",
named AS (SELECT *, ({_list(LABELS)})[CAST(c AS INTEGER) + 1] AS label FROM probs)""",
        f"""SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rank,
  label, {_case("label", names, "label")} AS label_name, round(p, 6) AS score FROM named""",
    )
    q["batch_predictor"] = _with(_COS_LOGITS, _PREDICT)

    # Run log
    q["latest_runs"] = _with(
        _RUN_LOG,
        "SELECT run_id, start_time FROM runs ORDER BY start_time DESC, run_id LIMIT 20",
    )
    q["run_history_top20"] = _with(_RUN_LOG, "SELECT * FROM history")
    q["f1_trend"] = _with(_RUN_LOG, "SELECT * FROM trend")
    q["cv_trend"] = _with(
        _RUN_LOG, "SELECT run_no, cv_f1_mean FROM trend WHERE cv_f1_mean IS NOT NULL"
    )
    q["best_epoch"] = """
SELECT model_id, epoch AS best_epoch, f1 AS best_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, epoch) AS rn FROM (
    SELECT event_type AS model_id, day(ts) AS epoch, round(avg(value) / 100, 2) AS f1
    FROM events GROUP BY ALL))
WHERE rn = 1"""
    gate = """
judged AS (
  SELECT *, lag(cv_f1) OVER (ORDER BY run_no) AS champ FROM sruns),
delta AS (SELECT *, cv_f1 - coalesce(champ, 0) AS d FROM judged)"""
    scores = (
        "printf('%.4f vs %.4f, delta=%+.4f ', cv_f1, champ, d)"
    )
    q["promotion_gate"] = _with(
        _SCORED_RUNS + "," + gate,
        f"""SELECT run_no,
  champ IS NULL OR training_records < 10000 OR d >= CAST(0.005 AS DOUBLE) AS promote,
  CASE WHEN champ IS NULL THEN 'no_champion_exists'
       WHEN training_records < 10000 THEN
         'below_min_records_threshold (' || training_records || ' < 10000) — '
         || 'metrics unreliable on small datasets, always promoting'
       WHEN d >= CAST(0.005 AS DOUBLE) THEN 'cv_f1_improved (' || {scores} || '>= threshold=0.005)'
       ELSE 'cv_f1_insufficient_improvement (' || {scores} || '< threshold=0.005)' END AS reason
FROM delta""",
    )
    q["champion_score"] = _with(
        _SCORED_RUNS
        + """,
champs AS (
  SELECT run_no, CASE WHEN run_no % 3 = 0 THEN NULL WHEN run_no % 7 = 0 THEN 0 ELSE cv_f1 END AS cv,
         CASE WHEN run_no % 2 = 0 THEN f1 END AS f
  FROM sruns)""",
        """SELECT run_no, CAST(CASE WHEN cv IS NOT NULL AND cv <> 0 THEN cv ELSE coalesce(f, 0) END
    AS DOUBLE) AS score,
  CAST(CASE WHEN coalesce(f, 0) <> 0 THEN f ELSE coalesce(cv, 0) END AS DOUBLE) AS shown
FROM champs""",
    )
    q["promotion_history"] = "WITH RECURSIVE " + (
        _SCORED_RUNS
        + """,
chain AS (
  SELECT run_no, TRUE AS promoted, cv_f1 AS champion FROM sruns WHERE run_no = 1
  UNION ALL
  SELECT s.run_no,
         s.training_records < 10000 OR s.cv_f1 - c.champion >= CAST(0.005 AS DOUBLE),
         CASE WHEN s.training_records < 10000 OR s.cv_f1 - c.champion >= CAST(0.005 AS DOUBLE)
              THEN s.cv_f1 ELSE c.champion END
  FROM chain c JOIN sruns s ON s.run_no = c.run_no + 1)
SELECT run_no, promoted, champion AS champion_cv_f1 FROM chain"""
    ).strip()
    q["dashboard_totals"] = _with(
        INCOMING + "," + _SCORED_RUNS,
        """SELECT (SELECT count(*) FROM held) AS accumulated_records, f1 AS champion_f1,
  training_records AS champion_records
FROM sruns ORDER BY run_no DESC LIMIT 1""",
    )
    placed = """,
placed AS (
  SELECT doc_id, doc_id // 20 AS page,
         row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS pos FROM docs)"""
    q["page_records"] = _with(
        _RAW + placed,
        """SELECT page AS page_no, pos::INTEGER AS pos, report_number, date_received, event_type,
  severity_label, device_name, narrative_text
FROM parsed JOIN placed ON doc_id = page_no""",
    )
    q["ingest_broken_pages"] = _with(
        _RAW
        + placed
        + f""",
held AS (SELECT CAST(doc_id AS VARCHAR) AS number FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
bad AS (SELECT DISTINCT page FROM placed WHERE {_digit("z", "page")} < 3),
good AS (
  SELECT * FROM parsed JOIN placed ON doc_id = page_no WHERE page NOT IN (SELECT page FROM bad)),
new AS (SELECT * FROM good WHERE report_number = '' OR report_number NOT IN (SELECT number FROM held))""",
        """SELECT (SELECT count(*) FROM bad) AS pages_aside, (SELECT count(*) FROM bad) AS pages_rejected,
  (SELECT count(*) FROM good) AS batch_returned, (SELECT count(*) FROM new) AS new_records_added,
  (SELECT count(*) FROM held) + (SELECT count(*) FROM new) AS total_accumulated""",
    )
    # Fitted models: what holds whatever the solver's last digits
    classes = "(SELECT count(DISTINCT severity_label) FROM labelled) AS n_classes"
    # Weighted F1 of the majority class alone: its share of the test rows times 2s / (1 + s).
    majority = """,
common AS (
  SELECT severity_label FROM split WHERE NOT is_test
  GROUP BY 1 ORDER BY count(*) DESC, severity_label LIMIT 1),
held AS (
  SELECT avg((severity_label = (FROM common))::INT::DOUBLE) AS s FROM split WHERE is_test),
guess AS (SELECT round(s * 2 * s / (1 + s), 6) AS majority_f1 FROM held)"""
    judged = f"""{classes}, CAST(1 AS DOUBLE) AS total, TRUE AS is_best, majority_f1,
  TRUE AS beats_majority
FROM split, guess WHERE is_test"""
    q["predict_scores"] = _with(_TRAINING_SPLIT + majority, f"SELECT report_number, {judged}")
    vectors = """
labelled AS (
  SELECT vec_id AS report_number, label AS severity_label,
         md5(CAST(vec_id AS VARCHAR) || ':42') AS h
  FROM embeddings)"""
    q["embedding_head"] = _with(
        vectors + _SPLIT[len(_LABELLED) :] + majority, f"SELECT report_number AS vec_id, {judged}"
    )
    known = _WEIGHTS.replace("WHERE length(clean_text) > 10", "WHERE length(clean_text) > 10 AND severity_label <> 'UNKNOWN'")
    for kind, push in (
        ("svm", "CASE WHEN own = label THEN -2 * own_weight ELSE 2 END"),
        ("logreg", "own_weight * (1 / k - (own = label)::DOUBLE)"),
    ):
        q[f"{kind}_optimality"] = _with(
            known
            + f""",
class_n AS (
  SELECT severity_label AS label, count(*) AS n, sum(count(*)) OVER () AS n_all,
         (count(*) OVER ())::DOUBLE AS k
  FROM cleaned GROUP BY 1),
pushes AS (
  SELECT report_number, c.label, {push} AS push
  FROM (SELECT report_number, label AS own, n_all / (k * n) AS own_weight, k
        FROM cleaned JOIN class_n ON label = severity_label) r, class_n c),
starts AS (
  SELECT label, sum(weight * push) AS g FROM weights JOIN pushes USING (report_number)
  GROUP BY label, term
  UNION ALL SELECT label, sum(push) FROM pushes GROUP BY label)""".replace(
                "(1 / k - ", "(1 / r.k - "
            ),
            """SELECT label, any_value(n) AS n, round(sqrt(sum(g * g)), 4) AS start_norm, TRUE AS is_minimum
FROM starts JOIN class_n USING (label) GROUP BY label""",
        )
    q["training_job"] = _with(
        _TRAINING_SPLIT + majority,
        f"""SELECT count(*) AS training_records, count(DISTINCT severity_label) AS n_classes,
  CAST(5 AS BIGINT) AS n_folds, (SELECT majority_f1 FROM guess) AS dummy_f1, TRUE AS beats_dummy,
  count(*) < {MIN_RECORDS_FOR_COMPARISON} AS promoted,
  CASE WHEN count(*) < {MIN_RECORDS_FOR_COMPARISON} THEN 'below_min_records_threshold'
       ELSE 'cv_f1_insufficient_improvement' END AS reason,
  count(*) < {MIN_RECORDS_FOR_COMPARISON} AS switched
FROM split""",
    )
    return q
