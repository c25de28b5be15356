"""Encoding, packing, ORC files and flat files against the tokenizer itself."""

import zlib
from itertools import pairwise

import numpy as np
import pytest
from tokenizers import Tokenizer

from incidentia.llm import packing, separators, token_orc
from incidentia.llm.tokens import StretchEncoder, vocabulary_path

ODD_TEXTS = [
    "", "a  b", " a", "a ", "\n\na", "a\n b", "x  y", "don't we'll 12's", "я a яb aя", "é café",
    "<|endoftext|> x<|endoftext|>", "a\t\tb\r\n\r\nc   d\n", "日本 a日", "½a a½ ²", "ª º µm", "a\x0bb",
    "!\x1c!", "a  b", " ", " \n", "ΑΣ Σ", "İ I", "ǅ", "foo_bar __x", "a­ b", "ﬁ ﬁx", "Å å",
]


def plain(vocabulary, text):
    tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_stretches_give_the_ids_of_whole_texts(vocabulary):
    tokens = StretchEncoder(vocabulary, cache_entries=5)
    texts = ODD_TEXTS + [a + b for a in ODD_TEXTS for b in ODD_TEXTS]
    assert tokens.encode(texts) == tokens.whole(texts)
    assert tokens.encode([None, ""]) == [b"", b""]


def windows(rows):
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append(r)
    for pieces in found.values():
        pieces.sort(key=lambda r: r.offset)
        assert pieces[0].offset == 0
        assert all(a.offset + a.length == b.offset for a, b in pairwise(pieces))
    return found


def test_packing_places_every_id_once(odd):
    rows = packing.pack_documents(odd).collect()
    texts = sorted(crc(plain(packing.VOCABULARY, r.text)) for r in odd.collect())
    whole, at = [], {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)):
        assert len(r.ids) == 4 * r.length > 0
        at.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(r.ids)
    for key in [k for k in at if k[2] == 0]:
        for copy in range(len(at[key])):
            ids, start = b"", 0
            while start < key[1]:
                ids += at[key[0], key[1], start][copy]
                start = len(ids) // 4
            whole.append(zlib.crc32(ids))
    assert sorted(whole) == texts
    sizes = [sum(r.length for r in w) for w in windows(rows).values()]
    assert max(sizes) <= packing.WINDOW
    assert sum(s < packing.WINDOW for s in sizes) <= odd.rdd.getNumPartitions()


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).collect() == []


def test_levels_minimise_the_sum_of_squares():
    levels = packing.LevelArray(16)
    rng = np.random.default_rng(1)
    for length in rng.integers(1, 16, 400):
        counts = levels.counts.copy()
        cost = {}
        for level in range(16):
            if (level and not counts[level]) or level + length > 16:
                continue
            after = counts.copy()
            after[level] -= level > 0
            after[level + length] += 1
            cost[level] = (after[1:16] ** 2).sum()
        assert cost[levels.choose(int(length))] == min(cost.values())
        levels.place(packing.Piece(0, int(length), 0, np.zeros(length, "<u4")))


def test_open_windows_stay_bounded():
    docs = [(i, np.full(1100, i, "<u4")) for i in range(400)]
    found = list(packing.windows_of(docs, 2048, 8))
    sizes = [sum(len(p.ids) for p in w) for w in found]
    assert sum(sizes) == 400 * 1100 and sum(s < 2048 for s in sizes) == 1
    assert sorted(np.concatenate([p.ids for w in found for p in w])) == sorted(
        np.concatenate([ids for _, ids in docs])
    )


def test_orc_files_hold_all_ids_in_order(spark, odd, work):
    path = work.path("orc")
    token_orc.write_token_orc(odd, path)
    files = token_orc.read_token_orc(spark, path)
    rows = token_orc.token_index(files, work).collect()
    expected = [(r.doc_id, plain(token_orc.VOCABULARY, r.text)) for r in odd.collect()]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (i or 0, len(ids), crc(ids)) for i, ids in expected
    )
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or 0 for r in rows] == sorted(i or 0 for i, _ in expected)
    ends = [r.start + r.n_tokens for r in rows]
    assert [r.start for r in rows] == [0, *ends[:-1]]


def test_orc_readers_skip_by_id(spark, odd, work):
    path = work.path("orc")
    token_orc.write_token_orc(odd, path)
    some = token_orc.read_token_orc(spark, path, [9, 12])
    assert sorted(r.doc_id for r in some.collect()) == [9, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_orc_of_nothing(spark, none, work):
    path = work.path("orc")
    token_orc.write_token_orc(none, path)
    assert token_orc.token_index(token_orc.read_token_orc(spark, path), work).collect() == []


@pytest.mark.parametrize("block", [3, 64, 1 << 19])
def test_separators_across_blocks(spark, odd, work, block):
    path = work.path("flat")
    separators.write_flat_tokens(odd, path)
    rows = separators.scan_separators(spark, path, work, block=block).collect()
    rows.sort(key=lambda r: r.start)
    counts = [len(plain(separators.VOCABULARY, r.text)) - 1 for r in odd.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(counts)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens + 1 for r in rows])[:-1]]


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_documents_may_span_files(spark, work, tmp_path, block):
    streams = [[5, 6], [7, 0, 0, 8], [], [9, 9, 0], [4], [3, 3]]
    for number, ids in enumerate(streams):
        (tmp_path / f"part-{number}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    rows = separators.scan_separators(spark, str(tmp_path), work, block=block).collect()
    found = sorted((r.start, r.n_tokens) for r in rows)
    assert found == [(0, 3), (4, 0), (5, 3), (9, 3)]


def test_separators_of_nothing(spark, none, work):
    path = work.path("flat")
    separators.write_flat_tokens(none, path)
    assert separators.scan_separators(spark, path, work).collect() == []


def test_rare_white_space_is_told_from_the_text():
    from incidentia.llm.tokens import CACHE_ENTRIES, _has_rare

    rare = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\t\r"]
    assert all(_has_rare(f"aé日{c}b") and _has_rare(f"a{c}") for c in rare) and len(rare) == 25
    assert not _has_rare("a b\n\t\rcé日🙂") and CACHE_ENTRIES <= 450_000
