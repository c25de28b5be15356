"""The operators as queries over the given tables: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentia.llm import (
    decontamination,
    divergence,
    language,
    line_dedup,
    near_dedup,
    packing,
    quality,
    secret_scan,
    separators,
    sharding,
    token_orc,
    url_lists,
    whitening,
)
from incidentia.llm.common import Work, unsigned_crc32
from incidentia.sources.tables import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        unsigned_crc32(F.col("ids")).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op2")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = work.table(
        read_table(spark, sf_dir, "documents").select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            unsigned_crc32(F.col("text")).alias("text_crc32"),
            # Equal texts are one group.
            F.md5(F.col("text").cast("binary")).alias("group"),
        ),
        "documents",
    )
    links = docs.select("row", "group")
    sharded = sharding.balanced_shards(docs.drop("group"), links, work)
    return sharding.with_slots(sharded, work).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op3")
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), work)
    return found.select("doc_id", "class_id", "class_size", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn(
        "held_out", language.is_held_out(F.col("doc_id"))
    )
    profiles = language.learn_profiles(docs.filter(~F.col("held_out")))
    found = language.identify_language(docs, profiles)
    return found.select(
        "doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["n_words"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _number(tag: str, first: int, digits: int):
    """A number from hexadecimal digits of the page's md5, the same in any engine."""
    text = F.md5(F.concat(F.lit(tag), F.col("page_id").cast("string")).cast("binary"))
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each fetched at a time drawn from its id, over 40 days."""
    seconds = F.lit(_FIRST) + _number("fetch", 1, 6) % (40 * 86_400)
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.timestamp_seconds(seconds).alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries drawn from a quarter of the pages, over 30 days.

    A page names its domain, its host or the first step of its path on one of two lists.
    """
    pages = read_table(spark, sf_dir, "pages").filter(_number("entry", 1, 2) < 64)
    host, kind = url_lists.host_of(F.col("url")), _number("entry", 3, 1)
    step = F.split_part(url_lists.path_of(F.col("url")), F.lit("/"), F.lit(2))
    pattern = (
        F.when(kind < 8, F.concat(F.lit("."), host))
        .when(kind < 12, host)
        .otherwise(F.concat(host, F.lit("/"), step))
    )
    seconds = F.lit(_FIRST) + _number("entry", 5, 6) % (30 * 86_400)
    return pages.select(
        F.when(_number("entry", 11, 1) < 8, "ads").otherwise("malware").alias("list"),
        pattern.alias("pattern"),
        F.timestamp_seconds(seconds).alias("at"),
        F.when(_number("entry", 4, 1) < 10, "add").otherwise("remove").alias("action"),
    )


#: 1 January 2024.
_FIRST = 1_704_067_200


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_lists.match_lists(captures(spark, sf_dir), list_entries(spark, sf_dir))
    names = F.transform("matches", lambda m: F.concat(m["list"], F.lit(" "), m["pattern"]))
    return found.select(
        F.col("id").alias("page_id"),
        F.size("matches").cast("long").alias("n_matches"),
        F.concat_ws(",", names).alias("matches"),
        (F.size("matches") > 0).alias("blocked"),
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host,
         regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) AS step,
         string_split(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/') AS parts,
         md5('fetch' || page_id) AS f, md5('entry' || page_id) AS e
  FROM pages),
captures AS (
  SELECT *, 1704067200 + ('0x' || f[1:6])::BIGINT % (40 * 86400) AS t FROM p),
entries AS (
  SELECT CASE WHEN ('0x' || e[11:11])::BIGINT < 8 THEN 'ads' ELSE 'malware' END AS list,
         CASE WHEN ('0x' || e[3:3])::BIGINT < 8 THEN '.' || host
              WHEN ('0x' || e[3:3])::BIGINT < 12 THEN host ELSE host || '/' || step END AS pattern,
         1704067200 + ('0x' || e[5:10])::BIGINT % (30 * 86400) AS moment,
         ('0x' || e[4:4])::BIGINT >= 10 AS gone
  FROM p WHERE ('0x' || e[1:2])::BIGINT < 64),
dated AS (SELECT list, pattern, moment, bool_or(gone) AS gone FROM entries GROUP BY ALL),
asked AS (
  SELECT DISTINCT page_id, t, unnest(list_concat(
    [host],
    list_transform(range(1, len(string_split(host, '.')) + 1),
                   lambda n: '.' || array_to_string(string_split(host, '.')[n:], '.')),
    list_transform(range(1, len(list_filter(parts, lambda x: x != '')) + 1),
                   lambda n: host || '/' || array_to_string(list_filter(parts, lambda x: x != '')[1:n], '/'))
  )) AS pattern
  FROM captures),
latest AS (
  SELECT page_id, list, pattern, arg_max(gone, moment) AS gone
  FROM asked JOIN dated USING (pattern) WHERE moment <= t GROUP BY page_id, list, pattern),
hits AS (
  SELECT page_id, count(*) AS n, string_agg(list || ' ' || pattern, ',' ORDER BY list, pattern) AS m
  FROM latest WHERE NOT gone GROUP BY page_id)
SELECT page_id, coalesce(n, 0) AS n_matches, coalesce(m, '') AS matches, n IS NOT NULL AS blocked
FROM pages LEFT JOIN hits USING (page_id)
"""


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op7")
    path = work.path("orc")
    token_orc.write_token_orc(read_table(spark, sf_dir, "documents"), path)
    index = token_orc.token_index(token_orc.read_token_orc(spark, path), work)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op8")
    stats = work.table(
        quality.with_features(quality.text_statistics(read_table(spark, sf_dir, "documents"))),
        "statistics",
    )
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    rules = quality.learn_decision_list(
        stats.join(labels, "doc_id"), list(quality.FEATURES), F.col("q") == 0, work
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & rules.verdict()).alias("kept"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op9")
    found = line_dedup.alike_lines(read_table(spark, sf_dir, "documents"), work)
    return found.drop("row")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents' ids to flat files, counts them there, and names the documents again.

    The files do not hold document ids. The scan of the table deals rows to tasks by file ranges,
    whichever columns it reads, so a row's task and place in it are the files and place of its ids.
    """
    work = Work(spark, "op10")
    docs = read_table(spark, sf_dir, "documents")
    path = work.path("flat")
    separators.write_flat_tokens(docs, path)
    counts = separators.scan_separators(spark, path, work)
    row = F.monotonically_increasing_id()
    named = docs.select(
        "doc_id", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("place")
    )
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    place = separators.place_in_part(F.col("file"), F.col("file_doc"))
    same = (part == F.col("part")) & (place == F.col("place"))
    return counts.join(named, same, "full").select("doc_id", "start", "n_tokens")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op11")
    return whitening.whitened_components(read_table(spark, sf_dir, "embeddings"), work)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op12")
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"), work)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, sum(n) AS total, count(*) AS kept FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts USING (lang, source)
  GROUP BY g.lang, g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.kept) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.kept) AS whole
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - whole) * (p - whole)) // whole)::BIGINT
  FROM shares WHERE n > 0 AND p > whole),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    words = secret_scan.common_words(docs, Work(spark, "op13"))
    found = secret_scan.find_secrets(docs, words)
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.VALUE)

    def joined(spans):
        fields = ("kind", "start", "end")
        each = F.transform(spans, lambda s: F.concat_ws(":", *(s[f].cast("string") for f in fields)))
        return F.concat_ws(",", each)

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def llm_oracles() -> dict[str, str]:
    return {"op6_url_lists": OP6_SQL, "op12_divergence": OP12_SQL}
