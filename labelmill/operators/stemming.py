"""Suffix stripping of English words by rules in five steps (the algorithm of M. F. Porter, 1980).

ASCII words of three letters and more are stripped; everything else is only case-folded. A stem keeps its
word's first two letters.
"""

from __future__ import annotations

import re

# Suffixes and what replaces them, and suffixes that go.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

_BY_LENGTH = lambda pairs: sorted((tuple(p.split(":")) for p in pairs.split()), key=lambda p: -len(p[0]))
_REPLACED = (_BY_LENGTH(STEP_2), _BY_LENGTH(STEP_3))
_DROPPED = sorted(STEP_4.split(), key=len, reverse=True)
_WORD = re.compile(r"[a-z]{3,}")


def shape(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    rest = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in shape(w[: -len(s)])), None)
    if rest is None:
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if len(rest) > 1 and rest[-1] == rest[-2] and shape(rest)[-1] == "c" and rest[-1] not in "lsz":
        return rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short_end(rest) else rest


def _final_e(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stem(word: str) -> str:
    w = word.casefold()
    if not _WORD.fullmatch(w):
        return w
    w = _past(_plural(w))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in _REPLACED:
        found = next((p for p in table if w.endswith(p[0])), None)
        if found and measure(w[: -len(found[0])]):
            w = w[: -len(found[0])] + found[1]
    gone = next((s for s in _DROPPED if w.endswith(s)), None)
    if gone:
        rest = w[: -len(gone)]
        if measure(rest) > 1 and (gone != "ion" or rest[-1] in "st"):
            w = rest
    return _final_e(w)
