"""Words of ranked text: runs of letters and numbers, without case and accents, stemmed.

The stemmer is that of Porter (1980) with its later departures, in the five steps of the paper, as SQLite's full-text
search has it.  A word that is not of ASCII letters alone is stemmed all the same; words shorter than three or longer than
sixty-four bytes are not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex

#: Most bytes of a query.
QUERY_BYTES = 4_096
RUNS = regex.compile(r"[\p{L}\p{N}\p{Co}]+")
LAST_RUN = regex.compile(r"(?r)[\p{L}\p{N}\p{Co}]+")

# Suffixes of the paper's steps 2, 3 and 4, with what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    """The stem as c (consonants) and v (vowels), a letter for each byte; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c" * len(c.encode())
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Whether a stem ends in consonant, vowel, consonant, the last of which is not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(word) > len(s)), key=len, default=None)


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix) and (len(word) > len(suffix) or "e" not in suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and "v" in _shape(stem := word[: -len(suffix)]):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _replaced(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    if suffix is None or not _measure(stem := word[: -len(suffix)]):
        return word
    return stem + table[suffix]


def _bare(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None or _measure(stem := word[: -len(suffix)]) < 2 or (suffix == "ion" and stem[-1] not in "st"):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if not 3 <= len(word.encode()) <= 64:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_bare(_replaced(_replaced(word, STEP2), STEP3)))


@lru_cache(1 << 16)
def folded(word: str) -> str:
    """Lower case; accents off where a letter is a base and one or more marks."""
    low = word.lower()
    if low.isascii():
        return low
    return "".join(unicodedata.normalize("NFD", c)[0] if unicodedata.normalize("NFD", c)[1:] and unicodedata.category(unicodedata.normalize("NFD", c)[1]) == "Mn" else c for c in low if unicodedata.category(c) != "Mn")


def tokens(text: str) -> Iterator[str]:
    for run in RUNS.finditer(text):
        yield stem(folded(run[0]))


def phrases(query: str) -> list[tuple[str, ...]]:
    """Of each distinct word of a query its tokens.  Words with one stem each count; words without a token go."""
    if len(query.encode()) > QUERY_BYTES:
        raise ValueError(f"the query exceeds {QUERY_BYTES} bytes")
    words = dict.fromkeys(regex.findall(r"[^\W_]+", query.lower()))
    return [p for w in words if (p := tuple(tokens(w)))]
