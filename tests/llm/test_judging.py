"""Language, quality rules, shards and URL lists."""

import re
from collections import Counter

import pytest
from material import odd_rows, prose
from pyspark.sql import functions as F

from incidentia.llm import language, quality, sharding, url_lists
from incidentia.sources.tables import read_table

SF = "/root/testdata/sf0.01"

# --- language ----------------------------------------------------------------------------------


def test_held_out_languages_are_named(spark):
    docs = read_table(spark, SF, "documents")
    profiles = language.learn_profiles(docs.filter(~language.is_held_out(F.col("doc_id"))))
    found = language.identify_language(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter(language.is_held_out(F.col("doc_id")))
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_distance_is_out_of_place():
    profiles = language.Profiles([("a", 5, 0), ("a", 6, 1), ("b", 6, 0)], 10)
    text = "ab"
    own = language.ranked(language.ngrams(text), 10)
    assert len(own) == 7  # a b | _a ab b_ | _ab ab_
    rows = [("x", int(g), i) for i, g in enumerate(own[::-1])]
    name, score = language.Profiles(rows, 10).classify(text)
    apart = sum(abs(i - (6 - i)) for i in range(7))
    assert (name, score) == ("x", 1 - apart / 70)
    assert profiles.classify("zz") == ("a", 0.0)


def test_ngrams_stay_inside_words():
    def names(text):
        out = []
        for code in language.ngrams(text).tolist():
            chars = []
            while code:
                chars.append("_" if code & 0x1FFFFF == 1 else chr(code & 0x1FFFFF))
                code >>= 21
            out.append("".join(reversed(chars)))
        return Counter(out)

    expected = Counter()
    for word in ("ab", "é", "ab"):
        expected.update(word)
        padded = f"_{word}_"
        expected.update(padded[i : i + 2] for i in range(len(padded) - 1))
        expected.update(padded[i : i + 3] for i in range(len(padded) - 2))
    assert names("Ab, É--3ab!") == expected


def test_language_of_odd_rows(odd, none):
    profiles = language.learn_profiles(odd)
    rows = language.identify_language(odd, profiles).collect()
    unknown = [not re.search(r"[^\W\d_]", t or "") for _, t, *_ in odd_rows()]
    assert Counter(r.lang_pred for r in rows) == {
        language.UNKNOWN: sum(unknown), "en": len(unknown) - sum(unknown)
    }
    assert language.learn_profiles(none).collect() == []
    assert language.identify_language(none, profiles).collect() == []
    nothing = language.identify_language(odd, profiles.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {(language.UNKNOWN, 0.0)}
    kept = language.keep_identified(odd, profiles)
    assert kept.columns == odd.columns and kept.count() == len(unknown) - sum(unknown)
    assert language.keep_identified(odd, profiles, languages=["de"]).count() == 0


def test_texts_far_from_every_profile_go(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs).cache()
    bounds = language.learn_bounds(docs, profiles)
    strange = ["Привет как дела сегодня", "日本語の文章です", "გამარჯობა", prose(3, 300), prose(4, 1000)]
    odd = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(strange)], docs.schema)
    kept = language.keep_identified(odd.unionByName(docs), profiles, bounds=bounds)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [i for i in ids if i < 0]
    clean = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert clean <= ids
    # Without bounds a score of 0 still rejects.
    none = language.keep_identified(odd.filter("doc_id > -4"), profiles)
    assert none.count() == 0


def test_sample_is_spread_without_usable_ids(spark):
    for same in (None, 7, 8, 9):
        rows = [(same, prose(i, 3), "en") for i in range(1000)]
        frame = spark.createDataFrame(rows, "id long, text string, lang string")
        taken = language._sample(frame, "id", "text", "lang", learn_from=100).count()
        assert 50 < taken < 200


def test_every_document_is_learned_from(spark):
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñåøæłőşžđ"
    rows = [(i, "oo" if i >= len(letters) else letters[i], "en") for i in range(7_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(frame)
    assert {ord(c) for c in letters} <= {r.gram for r in profiles.select("gram").collect()}


# --- quality -----------------------------------------------------------------------------------


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    again = set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again))


def test_statistics_against_plain_counts(spark):
    texts = [t for _, t, *_ in odd_rows()]
    texts += ["a a a", "a a a a", "a b c d a b c", "x y z x y z x", "a b c\x0b\x0ca b c", "a\n\na\n \na\nb"]
    texts += ["# * < a|b", "a b c " * 50, "a b  c\ta b\r\nc", "q\n" * 5 + "q ", "a b a b a b", "\U0001f600 é" * 3]
    frame = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id int, text string, words int")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.text_statistics(frame).collect():
        assert tuple(r[c] for c in columns) == plain_statistics(texts[r.doc_id]), texts[r.doc_id]


def test_rules_recover_planted_thresholds(spark, work):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        *(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000)).cast("double").alias(c) for c in "abc"),
    )
    bad = ((F.col("a") > 800) & (F.col("b") <= 300)) | (F.col("c") > 950)
    rules = quality.learn_decision_list(rows, ["a", "b", "c"], bad, work)
    wrong = rows.select((rules.verdict() == bad).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert wrong < 0.02
    assert {c.feature for r in rules.rules for c in r.conditions} == {"a", "b", "c"}
    numbered = rows.filter(rules.number().isNull() != rules.verdict())
    assert numbered.count() == 0


def test_no_rules_without_bad_rows(spark, none, work):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("a"))
    assert quality.learn_decision_list(rows, ["a"], F.lit(False), work).rules == ()
    assert quality.learn_decision_list(rows, ["a"], F.lit(None).cast("boolean"), work).rules == ()
    assert quality.learn_decision_list(rows.limit(0), ["a"], F.lit(True), work).rules == ()
    assert quality.text_statistics(none).collect() == []


# --- shards ------------------------------------------------------------------------------------


def sharded(spark, rows, work):
    docs = work.table(
        spark.createDataFrame(rows, "row long, size long, group string, note string"), "docs"
    )
    found = sharding.balanced_shards(docs.drop("group"), docs.select("row", "group"), work)
    return sharding.with_slots(found, work).collect()


def test_linked_rows_meet_and_sizes_stay_even(spark, work):
    rows = [(i, 100 + i % 50, f"g{i // 4}" if i < 400 else None, "x") for i in range(4000)]
    found = sharded(spark, rows, work)
    loads, groups = Counter(), {}
    for r in found:
        loads[r.shard] += r.size
        if r.row < 400:
            groups.setdefault(r.row // 4, set()).add(r.shard)
    assert len(found) == 4000 and len(loads) == 8
    assert max(loads.values()) - min(loads.values()) <= 150
    assert all(len(g) == 1 for g in groups.values())
    slots = Counter((r.shard, r.slot) for r in found)
    assert max(slots.values()) == 1
    assert all(max(s for k, s in slots if k == shard) + 1 == sum(k == shard for k, _ in slots) for shard in range(8))


def test_a_group_beyond_a_shard_is_split_over_few(spark, work):
    rows = [(i, 100, "hot" if i < 1000 else None, "x") for i in range(3000)]
    found = sharded(spark, rows, work)
    loads = Counter(r.shard for r in found)
    assert max(loads.values()) - min(loads.values()) <= 30
    hot = Counter(r.shard for r in found if r.row < 1000)
    # A shard holds 375: the group needs three, and had 125 in each of eight at the start.
    assert sum(n for _, n in hot.most_common(3)) > 900


def test_shards_of_little(spark, work):
    assert sharded(spark, [], work) == []
    assert len(sharded(spark, [(1, 5, "a", None)], work)) == 1
    assert len(sharded(spark, [(i, 1, "a", None) for i in range(3)], work)) == 3


# --- URL lists ---------------------------------------------------------------------------------


def test_patterns_of_a_url(spark):
    urls = {
        "https://User@A.b.Example.org:80/x//y/?q#f": [
            "a.b.example.org", ".org", ".example.org", ".b.example.org", ".a.b.example.org",
            "a.b.example.org/x", "a.b.example.org/x/y",
        ],
        "http://h.net": ["h.net", ".net", ".h.net"],
        "mailto:x@y": [],
        "": [],
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in frame.select("url", url_lists.patterns_of(F.col("url")).alias("p")).collect():
        assert sorted(r.p) == sorted(urls[r.url])


@pytest.mark.parametrize("bucket", [3600, 86_400, 864_000])
def test_matches_against_the_latest_entries(spark, bucket):
    entries, captures = [], []
    for i in range(300):
        code = [ord(c) for c in prose(i, 2)]
        pattern = [".b.org", "a.b.org", "a.b.org/x", ".org"][code[0] % 4]
        hours = (code[1] * 26 + code[2]) % 400
        entries.append((f"l{code[3] % 2}", pattern, hours, "add" if code[4] % 3 else "remove"))
        captures.append((i, "http://a.b.org/x/y" if code[6] % 2 else "http://c.b.org/", (code[7] * 26 + code[8]) % 500))
    captures += [(900, None, 3), (901, "http://a.b.org", None), (0, "http://a.b.org/x", 100)]
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600)
    listed = spark.createDataFrame(
        entries + [(None, ".org", 1, "add"), ("l0", None, 1, "add"), ("l0", ".org", None, "add"), ("l0", ".org", 1, "?")],
        "list string, pattern string, h int, action string",
    ).withColumn("at", time)
    pages = spark.createDataFrame(captures, "page_id int, url string, h int").withColumn("fetched_at", time)
    pages = pages.withColumn("row", F.lit("x"))
    rows = url_lists.match_lists(pages, listed, bucket=bucket).collect()
    expected = []
    for page, url, hour in captures:
        asked = {"http://a.b.org/x/y": ["a.b.org", ".b.org", ".org", "a.b.org/x"], "http://c.b.org/": [".b.org", ".org"],
                 "http://a.b.org": ["a.b.org", ".b.org", ".org"], "http://a.b.org/x": ["a.b.org", ".b.org", ".org", "a.b.org/x"]}.get(url, [])
        on = []
        for name in ("l0", "l1"):
            for p in asked if hour is not None else []:
                past = [(h, a) for n, q, h, a in entries if (n, q) == (name, p) and h <= hour]
                last = max((h for h, _ in past), default=None)
                if past and all(a == "add" for h, a in past if h == last):
                    on.append((name, p))
        expected.append((page, sorted(on)))
    assert sorted((r.id, [(m.list, m.pattern) for m in r.matches]) for r in rows) == sorted(expected)


def test_deep_entries_match(spark):
    """Eight labels and eight path parts, active at fetch time."""
    host, path = "a.b.c.d.e.f.g.org", "/1/2/3/4/5/6/7/8"
    patterns = [f".{host}", f"{host}{path}", f"{host}/1/2/3/4/5/6/7", ".b.c.d.e.f.g.org", ".x." + host]
    entries = spark.createDataFrame([("l", p, "add") for p in patterns], "list string, pattern string, action string")
    entries = entries.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    pages = spark.createDataFrame([(1, f"https://{host}{path}/9?q")], "page_id int, url string")
    pages = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_600)))
    found = url_lists.match_lists(pages, entries).first()
    assert [m.pattern for m in found.matches] == sorted(patterns[:4])
    every = pages.select(url_lists.patterns_of(F.col("url")).alias("p")).first().p
    assert set(patterns[:4]) <= set(every) and len(every) == 1 + 8 + 9


def test_no_entries_and_no_captures(spark):
    entries = spark.createDataFrame([], "list string, pattern string, at timestamp, action string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    pages = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(0)))
    assert [r.matches for r in url_lists.match_lists(pages, entries).collect()] == [[]]
    assert url_lists.match_lists(pages.limit(0), entries).collect() == []
