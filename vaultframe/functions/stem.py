"""Porter's suffix stripping (M. F. Porter, 1980) for English words, and a column of it.

Words of other letters than a-z, of fewer than three and of more than 64 letters stay as they are.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, longest match first within a step.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_PLAIN = re.compile("^[a-z]{3,64}$")


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _twice(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _first(word: str, endings: list[str]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if not _PLAIN.match(word):
        return word
    w = word
    # plurals
    for ending, keep in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(ending):
            w = w[: -len(ending)] + keep
            break
    # -ed and -ing
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    elif (ending := next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)) is not None:
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _twice(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        ending = _first(w, [e for e, _ in rules])
        if ending and _measure(w[: -len(ending)]):
            w = w[: -len(ending)] + dict(rules)[ending]
    ending = _first(w, STEP_4)
    if ending and _measure(w[: -len(ending)]) > 1 and (ending != "ion" or w[: -len(ending)].endswith(("s", "t"))):
        w = w[: -len(ending)]
    # a final e, and ll
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _twice(w) and w[-1] == "l":
        w = w[:-1]
    return w


def stems(words) -> Column:
    """Stems of a column of words; each distinct word of a batch once."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map({w: stem(w) for w in s.dropna().unique()})

    return of(words)
