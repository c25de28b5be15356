"""The registered queries over small tables of odd rows, against plain versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from material import SCHEMA, odd_rows
from test_judging import plain_statistics
from test_matching import ITEMS, TEXTS, covered
from test_token_files import crc, plain

from incidentia.llm import quality, separators
from incidentia.llm import queries as Q

SF = "/root/testdata/sf0.001"
EXTRA = [(100 + (i or 0), t) for i, t in TEXTS]
DOCS = [(i, t) for i, t, *_ in odd_rows()] + EXTRA


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("queries")
    rows = odd_rows() + [(i, t, "de" if t else None, 7, 3, "x", "y", 1) for i, t in EXTRA]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'web' AS source", "length(text) AS n_chars")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    items.write.parquet(f"{root}/benchmark.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/labels.parquet")
    return str(root)


def rows_of(spark, tables, name):
    return Q.llm_queries()[name](spark, tables).collect()


def test_op1(spark, tables):
    pieces = rows_of(spark, tables, "op1_packing")
    ids = defaultdict(list)
    for i, text in DOCS:
        ids[i].append(plain("byte_bpe_50k.json", text))
    held = Counter()
    for p in pieces:
        assert p.length > 0
        held[p.doc_id] += p.length
        slices = [t[p.start : p.start + p.length] for t in ids[p.doc_id] if len(t) == p.doc_tokens]
        assert p.ids_crc32 in [crc(s) for s in slices]
    assert held == {i: sum(map(len, texts)) for i, texts in ids.items()}
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for window in windows.values():
        window.sort()
        ends = np.cumsum([length for _, length in window])
        assert [at for at, _ in window] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_op2(spark, tables):
    rows = rows_of(spark, tables, "op2_sharding")
    sizes = Counter((i, len((t or "").encode()) + 1) for i, t in DOCS)
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    sums = {(i, zlib.crc32(t.encode())) for i, t in DOCS if t is not None}
    assert {(r.doc_id, r.text_crc32) for r in rows if r.text_crc32} == {s for s in sums if s[1]}
    slots = defaultdict(list)
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_op3(spark, tables):
    rows = rows_of(spark, tables, "op3_near_dedup")
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in DOCS)
    classes = defaultdict(list)
    for r in rows:
        classes[r.class_id].append(r)
    assert all(sum(r.kept for r in c) == 1 and len(c) == c[0].class_size for c in classes.values())
    alike = [(i, shingles(t)) for i, t in DOCS if len(shingles(t)) >= 20]
    expected = set()
    for at, (i, a) in enumerate(alike):
        for j, b in alike[at + 1 :]:
            if len(a & b) >= 0.8 * len(a | b):
                expected.add(frozenset(((i, 0), (j, 0))) if i != j else frozenset([(i, 0)]))
    together = {
        frozenset({(a.doc_id, 0), (b.doc_id, 0)}) for c in classes.values() for a in c for b in c if a is not b
    }
    assert expected <= together


def test_op4(spark, tables):
    rows = rows_of(spark, tables, "op4_language_id")
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in DOCS)
    blank = Counter(i for i, t in DOCS if not re.search(r"[^\W\d_]", t or ""))
    assert Counter(r.doc_id for r in rows if r.lang_pred == "und") == blank
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op5(spark, tables):
    expected = Counter()
    for i, text in DOCS:
        n, hit, found = covered(text, ITEMS)
        names = ",".join(sorted(map(str, found)))
        digest = hashlib.sha256(names.encode()).hexdigest()
        expected[i, n, len(hit), len(found), digest, bool(hit)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = rows_of(spark, tables, "op5_decontamination")
    assert Counter(tuple(r[c] for c in columns) for r in rows) == expected


def test_op6(spark):
    found = Q.op6_url_lists(spark, SF)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    expected = db.execute(Q.llm_oracles()["op6_url_lists"])
    names = [d[0] for d in expected.description]
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(expected.fetchall())


def test_op7(spark, tables):
    rows = sorted(rows_of(spark, tables, "op7_token_orc"), key=lambda r: r.start)
    ids = [(i, plain("word_bpe_49k.json", t)) for i, t in DOCS]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(t), crc(t)) for i, t in ids)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known)


def test_op8(spark, tables):
    expected = Counter()
    for i, text in DOCS:
        words, *rest, again = plain_statistics(text)
        expected[i, words, *rest, again, words < 50 or 100 * again > 50 * words] += 1
    rows = rows_of(spark, tables, "op8_quality_rules")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in rows) == expected
    assert not any(r.kept for r in rows if r.base_failed)


def test_op10(spark, tables):
    rows = rows_of(spark, tables, "op10_token_counts")
    expected = Counter((i, len(plain("word_bpe_49k.json", t)) - 1) for i, t in DOCS)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == expected


def test_ids_beyond_16_bits_are_an_error():
    assert separators.flat_ids(np.array([0, 65534], "<u4")) == b"\x01\x00\xff\xff"
    with pytest.raises(ValueError):
        separators.flat_ids(np.array([65535], "<u4"))


def test_feature_names_of_the_learner(spark, work):
    rows = spark.createDataFrame([(1, 1.0, True)], "doc_id int, grow double, is_bad boolean")
    with pytest.raises(ValueError):
        quality.learn_decision_list(rows, ["grow"], rows["is_bad"], work)
