"""Decontamination, near copies and alike lines against brute force."""

import re
from itertools import combinations

import pytest
from material import prose
from pyspark.sql import functions as F

from incidentia.llm import decontamination, line_dedup, linking, near_dedup
from incidentia.llm.decontamination import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- benchmark ---------------------------------------------------------------------------------


def covered(text, items, window=10):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for at in range(len(doc) - len(part) + 1):
                if doc[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(item)
    return len(doc), sorted(hit), sorted(found)


ITEMS = [
    (1, prose(1, 15)),
    (2, "Short ITEM here"),
    (3, prose(1, 15)),
    (4, None),
    (5, " ?! "),
    (6, "wörter ÄB c"),
]
TEXTS = [
    (1, "x " + prose(1, 15) + " y"),
    (2, prose(1, 60)),
    (3, "so SHORT, item-here! and short item here short item here"),
    (4, "shorter item here"),
    (5, None),
    (6, ""),
    (7, "Ein wörter Äb C. wörter äb c \U0001f600 wörter Äb c"),
    (7, " ".join(prose(1, 15).split()[:10])),
    (None, " ".join(prose(1, 15).split()[:9])),
    (8, prose(9, 5000) + " " + prose(1, 15)),
]


def benchmark_frames(spark, texts=TEXTS, items=ITEMS):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, row int, items int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("size", [decontamination.AUTOMATON_BYTES, 40])
def test_benchmark_windows_are_found(spark, size):
    docs, items = benchmark_frames(spark)
    rows = decontamination.find_benchmark(docs, items, automaton_bytes=size).collect()
    texts = dict(enumerate(t for _, t in TEXTS))
    expected = sorted(str((i, *covered(t, ITEMS))) for i, t in TEXTS)
    found = []
    for r in rows:
        hit = [x for s in r.runs for x in range(s.first_word, s.first_word + s.n_words)]
        found.append(str((r.doc_id, r.n_words, hit, r["items"])))
    assert sorted(found) == expected
    for r in rows:
        for s in r.runs:
            text = next(t for i, t in TEXTS if i == r.doc_id and len(words(t)) == r.n_words)
            assert words(text[s.begin : s.end]) == words(text)[s.first_word : s.first_word + s.n_words]
    assert texts


def test_contaminated_documents_go(spark, odd):
    docs, items = benchmark_frames(spark)
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    clean = [(i, t) for i, t in TEXTS if not covered(t, ITEMS)[1]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == len(TEXTS)
    assert decontamination.find_benchmark(odd, items.limit(0)).filter("size(items) > 0").count() == 0


def test_nothing_is_contaminated_in_no_documents(spark, none):
    _, items = benchmark_frames(spark)
    assert decontamination.find_benchmark(none, items).collect() == []


# --- near copies -------------------------------------------------------------------------------


def classes_of(keys, linked):
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def altered(text, changes, offset=0):
    w = text.split()
    for k in range(changes):
        w[(offset + k * 17) % len(w)] = f"changed{k}"
    return " ".join(w)


def near_rows():
    base, rows = prose(50, 200), []
    rows += [(i, base) for i in range(40)]
    rows += [(100 + i, altered(base, 1 + i % 6, i)) for i in range(60)]
    rows += [(200 + i, prose(60 + i, 80)) for i in range(20)]
    rows += [(300, "a b c"), (301, "A, b! C"), (302, "a b d"), (303, "!!!"), (304, "!!!"), (305, "??")]
    return rows


def test_near_copies_against_all_pairs(spark, tmp_path, work):
    rows = near_rows()
    path = str(tmp_path / "docs")
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node int")
    frame.repartition(3).write.parquet(path)
    found = near_dedup.near_duplicates(spark.read.parquet(path), work).collect()
    sets = {}
    for i, t in rows:
        w = words_of(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else {t}
    linked = [
        (a, b)
        for a, b in combinations(sets, 2)
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    label = classes_of(sets, linked)
    assert {r.doc_id: r.class_id for r in found} == label
    for r in found:
        assert r.class_size == sum(x == r.class_id for x in label.values())
        assert r.kept == (r.doc_id == r.class_id)


def test_near_copies_of_odd_rows(odd, none, work):
    rows = near_dedup.near_duplicates(odd, work).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.class_id for r in by_id[3]] == [1, 1]
    assert sorted((r.class_id, r.class_size) for r in by_id[None] if r.class_id) == [(2, 2)]
    assert by_id[4][0].class_size == 1 and by_id[4][0].kept
    assert by_id[6][0].class_id == 5 and by_id[10][0].class_id == 9
    kept = near_dedup.drop_near_duplicates(odd, work)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 1, 2, 4, 5, 7, 8, 9, 11, 12]
    assert near_dedup.near_duplicates(none, work).collect() == []


def test_signatures_estimate_the_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    items = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    ratio_a, ratio_b = a[:, None] / a[None, :], b[:, None] / b[None, :]
    exact = (1 / np.maximum(ratio_a, ratio_b).T.sum(axis=1)).sum()
    one, two = (near_dedup.signature(items, w, 4000) for w in (a, b))
    assert abs((one == two).mean() - exact) < 0.03


def test_search_finds_texts_with_repeated_passages():
    """Set similarity 0.82 to 0.91, but down to 0.48 by weights from counts."""
    import numpy as np

    rng = np.random.default_rng(5)
    for own_a, own_b, shared, times in ((0, 10, 100, 1000), (10, 10, 90, 50)):
        missed = 0
        for _ in range(100):
            items = np.unique(rng.integers(1, 1 << 62, own_a + own_b + shared).astype(np.uint64))
            rng.shuffle(items)
            a, b = items[: own_a + shared], items[own_a:]
            n_a, n_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
            n_a[:own_a], n_b[shared:] = times, times
            one = near_dedup.search_keys(a, n_a, near_dedup.BANDS, near_dedup.ROWS)
            two = near_dedup.search_keys(b, n_b, near_dedup.BANDS, near_dedup.ROWS)
            missed += not len(np.intersect1d(one, two))
        assert missed == 0


def test_near_copies_with_repeated_passages(spark, tmp_path, work):
    rows = []
    for i in range(40):
        base, x, y = prose(900 + i, 94), prose(500 + i, 6), prose(700 + i, 6)
        rows += [(2 * i, " ".join([base] + [x] * 50)), (2 * i + 1, " ".join([base] + [y] * 50))]
    for i, t in rows:
        w = words_of(t)
        rows[i] = (i, t, {tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    linked = [
        (a, b)
        for (a, _, s), (b, _, t) in combinations(rows, 2)
        if len(s & t) >= 0.8 * len(s | t)
    ]
    path = str(tmp_path / "docs")
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(path)
    found = near_dedup.near_duplicates(spark.read.parquet(path), work)
    assert len(linked) == 40
    assert {r.doc_id: r.class_id for r in found.collect()} == classes_of([r[0] for r in rows], linked)


# --- links in buckets --------------------------------------------------------------------------


@pytest.mark.parametrize("step", [1, 3, 50])
def test_links_in_a_large_bucket(spark, work, step):
    """A chain in which no centre sees more than a few of its kind."""
    n = 700
    rows = [(1, i) for i in range(n)] + [(2, i) for i in range(n - 1, n + 3)]
    buckets = spark.createDataFrame(rows, "bucket long, node long")
    items = spark.createDataFrame([(i, i) for i in range(n + 3)], "node long, item long")
    _, classes = linking.link_buckets(
        buckets, items, lambda x, y: (F.abs(x - y) == step) & (x < n) & (y < n), work
    )
    expected = {(i, i % step) for i in range(n) if step < n}
    assert {(r.node, r.label) for r in classes.collect()} == expected


def test_components_of_a_long_chain(spark, work):
    edges = [(i, i + 1) for i in range(0, 50) if i != 30]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.label for r in linking.components(frame, work)[0].collect()}
    assert found == {i: 0 if i <= 30 else 31 for i in range(51)}


# --- lines -------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(line, seed, edits):
    for k in range(edits):
        at = (seed * 31 + k * 97) % len(line)
        kind = (seed + k) % 3
        new = "" if kind == 0 else "Q"
        line = line[:at] + new + line[at + (kind != 1) :]
    return line


def line_rows():
    base = [prose(200 + i, 8 + i) for i in range(4)]
    lines = [edited(b, s, s % 5) for b in base for s in range(12)]
    lines += ["  " + base[0] + "\t", "short line of text one", "short line of text two"]
    lines += ["short line of text one", "tiny", "tiny", "ä" * 45, "ä" * 44 + "ö"]
    return [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(-(-len(lines) // 4))]


def test_alike_lines_against_all_pairs(spark, tmp_path, work):
    rows = line_rows()
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    found = line_dedup.alike_lines(docs, work).collect()
    lines = {(i, n): x.strip() for i, t in rows for n, x in enumerate(t.split("\n"))}
    lines = {k: x for k, x in lines.items() if len(x) >= line_dedup.MIN_CHARS}
    linked = [
        (a, b)
        for a, b in combinations(sorted(lines), 2)
        if lines[a] == lines[b]
        or min(len(lines[a]), len(lines[b])) >= line_dedup.FUZZY_CHARS
        and abs(len(lines[a]) - len(lines[b])) <= 2
        and distance(lines[a], lines[b]) <= 2
    ]
    label = classes_of(lines, linked)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in found}
    assert got == label
    assert all(r.n_alike == sum(x == label[r.doc_id, r.line_no] for x in label.values()) for r in found)
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, work).collect()}
    for i, t in rows:
        left = [x for n, x in enumerate(t.split("\n")) if label.get((i, n), (i, n)) == (i, n)]
        assert kept.get(i, "") == "\n".join(left)


def test_short_lines_count(spark, tmp_path, work):
    """Copies at any length; one edit from 10 characters, two from 20, none below."""
    licence = "Licensed under the terms of the MIT"
    lines = ["Page footer", "}", "tiny", "tinx", licence, licence.replace("terms", "terns")]
    lines += [edited(prose(600 + i, 6)[:n], s, e) for i, n in enumerate((9, 10, 15, 19, 20, 21, 30, 39)) for s in range(6) for e in (0, 1, 2)]
    lines += ["Page footer", "}", " ", "", "Page footed", "Page facted"]
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(-(-len(lines) // 5))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    found = line_dedup.alike_lines(spark.read.parquet(path), work).collect()
    lines = {(i, n): x.strip() for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip()}
    linked = [
        (a, b)
        for a, b in combinations(sorted(lines), 2)
        if distance(lines[a], lines[b]) <= min(2, min(len(lines[a]), len(lines[b])) // 10)
    ]
    label = classes_of(lines, linked)
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in found} == label
    assert label[1, 0] == (0, 4)


def test_probes_reach_every_edit_within_the_threshold(spark):
    line = prose(7, 9)
    others = [edited(line, s, e) for s in range(40) for e in (1, 2)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([line, *others])], "i int, line string")
    for edits in (1, 2, 3):
        found = line_dedup.probes(line_dedup.coded(frame.line), F.length("line"), edits)
        rows = frame.select("i", found.alias("p")).collect()
        keys = {r.i: {x & -2 for x in r.p if x is not None} for r in rows}
        own = {r.i: {x & -2 for x in r.p if x is not None and x & 1} for r in rows}
        for i, other in enumerate(others, 1):
            if distance(line, other) <= edits:
                assert keys[0] & own[i] or keys[i] & own[0]


def test_lines_of_odd_rows(odd, none, work):
    rows = line_dedup.alike_lines(odd, work).collect()
    assert all(r.kept == ((r.first_doc_id, r.first_line_no) == (r.doc_id, r.line_no)) for r in rows if r.doc_id != 3)
    kept = line_dedup.drop_repeated_lines(odd, work)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    # Copies lose every line and go; texts that were blank before stay.
    assert ids == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12] or ids == [0, 1, 2, 4, 5, 6, 7, 8, 9, 11, 12]
    assert line_dedup.alike_lines(none, work).collect() == []
    assert line_dedup.drop_repeated_lines(none, work).collect() == []
