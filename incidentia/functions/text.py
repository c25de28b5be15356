"""Narrative cleaning and tokenising as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentia.functions.arrays import let, running_totals
from incidentia.schema import MAX_TOKENS, MIN_CLEAN_CHARS, NGRAM_RANGE

# --- Fixed values: phrases and short forms, in the order they must be applied ------------------

BOILERPLATE = [
    r"it was reported that",
    r"the reporter stated",
    r"according to the report",
    r"this is a report",
    r"per the report",
    r"the following information was received",
    r"information has been received",
    r"no further information (is|was) available",
    r"follow[^\n]?up (is|will be) requested",
]

ABBREVIATIONS = {
    "pt": "patient",
    "pts": "patients",
    "md": "physician",
    "dr": "doctor",
    "hosp": "hospital",
    "adm": "admitted",
    "dx": "diagnosis",
    "tx": "treatment",
    "rx": "prescription",
    "s/p": "status post",
    "w/": "with",
    "h/o": "history of",
    "c/o": "complaint of",
    "n/v": "nausea vomiting",
    "SOB": "shortness of breath",
    "UNK": "unknown",
}

WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------------------------

_FOLD = "(?iu)"
_WORD = r"[\p{L}\p{N}_]"

# Every boilerplate phrase holds one of these fragments. They have no letter with a non-ASCII case
# partner (i, k, s do), so matching ASCII case alone never misses a phrase.
_BOILERPLATE_FRAGMENT = "(?i)re(?:port|ce|que)|forma"
# Letters that no boilerplate match can swallow: the phrases do not contain them, and the one
# wildcard stands after a "w".
_LASTING_LETTER = "(?<![wW])[jkxyzJKXYZ][^jkxyzJKXYZ]*+"
_ANY_LETTER = "[a-zA-Z][^a-zA-Z]*+"


def _short_form_pattern(short: str) -> str:
    # The literal leads and the left edge is looked up behind it: the matcher scans for a literal
    # and tests boundaries on hits only. Edges are spelled out because \b differs between JDKs.
    right = f"(?={_WORD})" if short.endswith("/") else f"(?!{_WORD})"
    return f"{_FOLD}{short}{right}(?<!{_WORD}{short})"


_PLAIN_FORMS = "|".join(s for s in ABBREVIATIONS if not s.endswith("/"))
_OPEN_FORMS = "|".join(s for s in ABBREVIATIONS if s.endswith("/"))
_ANY_SHORT_FORM = (
    f"{_FOLD}(?<!{_WORD})(?:(?:{_PLAIN_FORMS})(?!{_WORD})|(?:{_OPEN_FORMS})(?={_WORD}))"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode included."""
    return F.btrim(text, F.lit(WHITESPACE))


def remove_boilerplate(text: Column) -> Column:
    """Blank out stock phrases, one after the other.

    Texts without any phrase skip the pass: the first substitution of the sequence can only fire
    if the untouched text holds a phrase.
    """
    out = text
    for phrase in BOILERPLATE:
        out = F.regexp_replace(out, _FOLD + phrase, " ")
    return F.when(text.rlike(_BOILERPLATE_FRAGMENT), out).otherwise(text)


def expand_abbreviations(text: Column) -> Column:
    """Spell out clinical short forms, one after the other; texts without any skip the pass."""
    out = text
    for short, full in ABBREVIATIONS.items():
        out = F.regexp_replace(out, _short_form_pattern(short), full)
    return F.when(text.rlike(_ANY_SHORT_FORM), out).otherwise(text)


def letters_only(text: Column, preserve_digits: bool = False) -> Column:
    """Fold each run of other characters, white space included, to one blank; no blank ends."""
    keep = "a-zA-Z0-9" if preserve_digits else "a-zA-Z"
    return F.trim(F.regexp_replace(text, f"[^{keep}]+", " "))


def clean_text(text: Column, lowercase: bool = True, preserve_digits: bool = False) -> Column:
    """Whole cleaning chain; null and blank texts become the empty string."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    out = letters_only(expand_abbreviations(remove_boilerplate(known)), preserve_digits)
    return F.lower(out) if lowercase else out


def long_enough(text: Column, cleaned: Column, min_chars: int = MIN_CLEAN_CHARS) -> Column:
    """``length(cleaned) > min_chars``, decided from the raw text where that is cheaper.

    Catalyst moves a filter below the projection it reads and so repeats the cleaning. Expanding
    short forms only adds letters, hence ``min_chars + 1`` letters left after boilerplate removal
    settle the test, and enough letters that boilerplate never takes settle it on sight; the full
    chain runs a second time for very short texts only.
    """
    known = F.coalesce(text.cast("string"), F.lit(""))
    enough = "(?:%s){%d}"
    lasting = enough % (_LASTING_LETTER, min_chars + 1)
    letters = enough % (_ANY_LETTER, min_chars + 1)
    return (
        known.rlike(lasting)
        | (known.rlike(letters) & ~known.rlike(_BOILERPLATE_FRAGMENT))
        | remove_boilerplate(known).rlike(letters)
        | (F.length(cleaned) > min_chars)
    )


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")


def clean_tokens(cleaned: Column) -> Column:
    """Words of two letters or more of a cleaned text."""
    return F.filter(F.split(cleaned, " "), lambda word: F.length(word) >= 2)


def _accent_table() -> tuple[str, str]:
    # Built from Unicode: letters whose decomposition is one base letter plus combining marks.
    src, dst = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != char:
            src.append(char)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    """Base letters for accented ones, in composed or decomposed spelling."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def word_tokens(text: Column) -> Column:
    """Lower-cased, accent-free ASCII words of two letters or more from any text.

    A run of letters that touches a digit, an underscore or a foreign letter is no word.
    """
    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    pattern = f"(?<!{_WORD})[a-z][a-z]+(?!{_WORD})"
    return F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, ngram_range: tuple[int, int] = NGRAM_RANGE) -> Column:
    """All n-grams of the token list, shortest first, joined by one blank."""

    def runs(words: Column) -> Column:
        parts = []
        for n in range(ngram_range[0], ngram_range[1] + 1):
            if n == 1:
                parts.append(words)
                continue
            grams = words
            for shift in range(1, n):
                width = F.greatest(F.size(words) - shift, F.lit(0))
                grams = F.zip_with(
                    F.slice(grams, 1, width),
                    F.slice(words, shift + 1, width),
                    lambda left, right: F.concat_ws(" ", left, right),
                )
            parts.append(grams)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(tokens, runs)


# Places of a sequence that its opening and closing marks take.
RESERVED_TOKENS = 2


def _places(max_tokens: int) -> int:
    if max_tokens <= RESERVED_TOKENS:
        raise ValueError(f"a sequence needs more than {RESERVED_TOKENS} places")
    return max_tokens - RESERVED_TOKENS


def truncate_tokens(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The tokens of a cleaned text that fit a sequence beside its two marks."""
    return F.slice(F.split(text, " "), 1, _places(max_tokens))


def is_truncated(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    return F.size(F.split(text, " ")) > _places(max_tokens)


_WORD_RUN = r"[\p{L}\p{N}]+"


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD_RUN), 0), F.lower)


def positioned_words(text: Column) -> Column:
    """``array<struct<word, start, end>>``: ``plain_words`` with their places in the text, end excluded."""
    pattern = F.lit(rf"([^\p{{L}}\p{{N}}]*)({_WORD_RUN})")

    def placed(gaps: Column, words: Column) -> Column:
        sizes = F.zip_with(gaps, words, lambda g, w: F.length(g) + F.length(w))

        def join(ends: Column) -> Column:
            return F.zip_with(
                words,
                ends,
                lambda w, e: F.struct(
                    F.lower(w).alias("word"), (e - F.length(w)).alias("start"), e.alias("end")
                ),
            )

        return let(running_totals(sizes), join)

    return let(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        lambda gaps: let(
            F.regexp_extract_all(text, pattern, F.lit(2)), lambda words: placed(gaps, words)
        ),
    )
