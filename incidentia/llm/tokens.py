"""Token ids of whole texts, with each distinct stretch of a text encoded once.

The merges of a byte-pair vocabulary stay inside the words that its splitting pattern finds. A text
may therefore be cut wherever a word ends for certain: in front of white space that follows another
character, after one line break, and after a run of Latin letters. Natural text repeats its
stretches, and looking one up costs a fraction of encoding it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np

from incidentia.llm.common import in_slot

if TYPE_CHECKING:
    from tokenizers import Tokenizer

# White space that only some definitions count as such: a text with one is encoded as a whole. Looking
# for one character at a time is a scan of memory, and no scan where the text's characters are narrower.
_RARE = (
    "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    "\u0130"  # no white space, but lowered it ends in a mark that may join what follows its word
)
# Every letter up to U+024F. What follows a run of them must lie below too, or it could be a letter.
_LATIN = "[A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f]++(?![^\\x00-\\u024f])"
_SPACED = re.compile(
    f"[\\n\\t\\r](?=[^ \\n\\t\\r])| ?{_LATIN}|[ \\n\\t\\r]*+[^ \\n\\t\\r]++|[ \\n\\t\\r]++"
)
_LATIN_WORD = re.compile(_LATIN).fullmatch
_UNSPACED = re.compile(f"{_LATIN}|[^ \\n\\t\\r]++")

# A normalizer's step that changes white space only.
_SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}

#: Stretches a worker process remembers (about 150 bytes each); later ones are encoded anew.
CACHE_ENTRIES = 450_000
#: New words that are encoded as one text.
JOINED_WORDS = 128


def vocabulary_path(name: str) -> str:
    """A file's place on the machine that asks: an absolute path, or a name of a public vocabulary."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class StretchEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``as_text`` makes the strings of special tokens ordinary text, so that their ids never occur.
    """

    def __init__(self, vocabulary: str, as_text: bool = False, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self._tokenizer.encode_special_tokens = as_text
        together, first, second = self.whole(["a b", "a", "b"])
        self._stretches = (_UNSPACED if together == first + second else _SPACED).findall
        settings = json.loads(self._tokenizer.to_str())
        self._ends = _word_ends(settings) if self._stretches == _UNSPACED.findall else None
        self._lowered = None
        if self._ends is not None and _only_lowers(settings["normalizer"]):
            self._lowered = Tokenizer.from_file(vocabulary_path(vocabulary))
            self._lowered.normalizer = None
        self._known: dict[str, bytes] = {}
        self._limit = cache_entries

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, each encoded in one go."""
        return _ids(self._tokenizer, texts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; ``None`` counts as empty."""
        parts = [None if t and _has_rare(t) else self._stretches(t or "") for t in texts]
        known = self._known
        new = list(set().union(*(x for x in parts if x)).difference(known))
        if new:
            fresh = self._fresh(new)
            if len(known) + len(fresh) <= self._limit:
                known.update(fresh)
            else:
                self._limit = min(self._limit, len(known))
                known = _Either(known, fresh)
        at = known.__getitem__
        return [
            self.whole([t])[0] if x is None else b"".join(map(at, x)) for t, x in zip(texts, parts)
        ]

    def _fresh(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of each stretch; Latin words, whose ends their ids tell, are encoded many at a time.

        Where lowering is all that normalizing does to ASCII words, those that differ in case alone are
        encoded once and without the normalizer's passes.
        """
        if self._ends is None:
            return dict(zip(stretches, self.whole(stretches)))
        words = [s for s in stretches if _LATIN_WORD(s)]
        others = set(stretches).difference(words)
        out = dict(zip(others, self.whole(list(others))))
        if self._lowered is not None:
            ascii_words = {s: s.lower() for s in words if s.isascii()}
            words = [s for s in words if s not in ascii_words]
            lower = dict.fromkeys(ascii_words.values())
            lower.update(zip(lower, map(self._known.get, lower)))
            new = [word for word, ids in lower.items() if ids is None]
            lower.update(self._by_ends(self._lowered, new))
            out.update((s, lower[word]) for s, word in ascii_words.items())
        out.update(self._by_ends(self._tokenizer, words))
        return out

    def _by_ends(self, tokenizer: Tokenizer, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids, ``JOINED_WORDS`` encoded as one text and cut where an id ends a word."""
        groups = [words[at : at + JOINED_WORDS] for at in range(0, len(words), JOINED_WORDS)]
        found = tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found):
            ids = np.array(encoding.ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
            if len(ends) == len(group):
                held = ids.tobytes()
                yield from zip(group, (held[a:b] for a, b in zip([0, *ends], ends)))
            else:  # a word that its normal form splits
                yield from zip(group, _ids(tokenizer, group))


def _has_rare(text: str) -> bool:
    return any(c in text for c in _RARE)


def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return [array("I", e.ids).tobytes() for e in found]


def _only_lowers(normalizer: dict | None) -> bool:
    """Whether normalizing ASCII words is lowering them: composing, and replacing white space, change none."""
    steps = (normalizer or {}).get("normalizers", [normalizer])
    kinds = {step["type"] for step in steps if step and step != _SPACES}
    return "Lowercase" in kinds and kinds <= {"NFC", "Lowercase"}


def _word_ends(settings: dict) -> np.ndarray | None:
    """Per id whether it ends a word, if the vocabulary tells and every word ends with such an id.

    That is so when a suffix marks a word's last symbol and no byte, with it or without, lacks an id. No
    added token may be found in words with spaces between them.
    """
    model = settings["model"]
    suffix, ids = model.get("end_of_word_suffix"), model["vocab"]
    added = [token["content"] for token in settings["added_tokens"]]
    if not suffix or model["type"] != "BPE" or any(not re.search(r"[^\w ]", c) for c in added):
        return None
    from tokenizers import pre_tokenizers

    symbols = pre_tokenizers.ByteLevel.alphabet()
    if not {*symbols, *(c + suffix for c in symbols)} <= ids.keys():
        return None
    ends = np.zeros(max([*ids.values(), *(token["id"] for token in settings["added_tokens"])]) + 1, dtype=bool)
    ends[[at for symbol, at in ids.items() if symbol.endswith(suffix)]] = True
    return ends


class _Either:
    """Two tables read as one."""

    def __init__(self, first: dict[str, bytes], second: dict[str, bytes]):
        self._first, self._second = first, second

    def __getitem__(self, key: str) -> bytes:
        found = self._first.get(key)
        return self._second[key] if found is None else found


def encoder(vocabulary: str, as_text: bool = False, cache_entries: int = CACHE_ENTRIES) -> StretchEncoder:
    """The worker process's encoder for a vocabulary, made at first use."""
    key = ("encoder", vocabulary, as_text, cache_entries)
    return in_slot(key, lambda: StretchEncoder(vocabulary, as_text, cache_entries))
