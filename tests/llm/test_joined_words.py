"""New words are encoded many at a time, with the ids of whole texts."""

import random

from incidentia.llm import tokens

LETTERS = [*"abzHJTWYKıßŉǰÅÉñſŁ'.,<|>_19 \n\t中éΣσάµªº̱́K", "<|endoftext|>", "ENDOFTEXT", "don't", "'LL"]


def test_ids_of_odd_texts_are_those_of_whole_texts():
    draw = random.Random(1)
    found = tokens.StretchEncoder("word_bpe_49k.json")
    for letters in (LETTERS, [*LETTERS, "İ"]):
        for _ in range(15):
            texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(60)]
            assert found.encode(texts) == found.whole(texts)


def test_new_words_are_encoded_joined_and_once_for_all_cases():
    encoder = tokens.StretchEncoder("word_bpe_49k.json")
    handed = {"full": [], "lowered": []}

    class Seen:
        def __init__(self, real, name):
            self.real, self.name = real, name

        def encode_batch_fast(self, texts, **options):
            handed[self.name] += texts
            return self.real.encode_batch_fast(texts, **options)

    words = ["alpha", "Alpha", "ALPHA", "gamma", "été", "Été", "ñu"]
    expected = encoder.whole([" ".join(words)])
    encoder._tokenizer = Seen(encoder._tokenizer, "full")
    encoder._lowered = Seen(encoder._lowered, "lowered")
    assert encoder.encode([" ".join(words)]) == expected
    assert sorted(handed["lowered"][0].split()) == ["alpha", "gamma"]
    assert len(handed["full"]) == 1 and sorted(handed["full"][0].split()) == sorted(["été", "Été", "ñu"])


def test_a_word_that_is_split_sends_its_group_one_by_one():
    encoder = tokens.StretchEncoder("word_bpe_49k.json")
    words = ["İa", "b", "é"]
    assert dict(encoder._by_ends(encoder._tokenizer, words)) == dict(zip(words, encoder.whole(words)))


def test_vocabularies_that_do_not_tell_a_words_end_are_left_alone():
    assert tokens.StretchEncoder("byte_bpe_50k.json")._ends is None
