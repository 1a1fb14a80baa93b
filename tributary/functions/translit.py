"""Transliteration of nine Brahmic scripts to simplified Latin, as an Arrow UDF for the rows that need it.

The scripts are encoded alike: each has a block of 128 places, and a letter of one has the place of its sister letters in the others. So a word is first
moved into the Devanagari block and then read syllable by syllable: a consonant, with or without a dot below, and the vowel sign, the virama or nothing that
follows. With nothing there is an inherent a, which four scripts leave out at the end of a word. What is no such syllable is spelt letter by letter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of the Devanagari block and their spellings.
VOWELS = {
    0x0905: "a", 0x0906: "a", 0x0907: "i", 0x0908: "i", 0x0909: "u", 0x090A: "u", 0x090B: "ri", 0x090C: "li",
    0x090D: "e", 0x090E: "e", 0x090F: "e", 0x0910: "ai", 0x0911: "o", 0x0912: "o", 0x0913: "o", 0x0914: "au",
}
CONSONANTS = {
    0x0915: "k", 0x0916: "kh", 0x0917: "g", 0x0918: "gh", 0x0919: "n",
    0x091A: "ch", 0x091B: "chh", 0x091C: "j", 0x091D: "jh", 0x091E: "n",
    0x091F: "t", 0x0920: "th", 0x0921: "d", 0x0922: "dh", 0x0923: "n",
    0x0924: "t", 0x0925: "th", 0x0926: "d", 0x0927: "dh", 0x0928: "n", 0x0929: "n",
    0x092A: "p", 0x092B: "f", 0x092C: "b", 0x092D: "bh", 0x092E: "m",
    0x092F: "y", 0x0930: "r", 0x0931: "r", 0x0932: "l", 0x0933: "l", 0x0934: "zh", 0x0935: "v",
    0x0936: "sh", 0x0937: "sh", 0x0938: "s", 0x0939: "h",
    0x0958: "q", 0x0959: "kh", 0x095A: "g", 0x095B: "z", 0x095C: "r", 0x095D: "rh", 0x095E: "f", 0x095F: "y",
}
SIGNS = {
    0x093E: "a", 0x093F: "i", 0x0940: "i", 0x0941: "u", 0x0942: "u", 0x0943: "ri", 0x0944: "ri", 0x0945: "e", 0x0946: "e",
    0x0947: "e", 0x0948: "ai", 0x0949: "o", 0x094A: "o", 0x094B: "o", 0x094C: "au", 0x0957: "au", 0x0962: "li", 0x0963: "li",
}
NASALS = {0x0901: "n", 0x0902: "n", 0x0903: "h"}
DIGITS = {0x0966: "0", 0x0967: "1", 0x0968: "2", 0x0969: "3", 0x096A: "4", 0x096B: "5", 0x096C: "6", 0x096D: "7", 0x096E: "8", 0x096F: "9"}
VIRAMA, NUKTA = 0x094D, 0x093C
#: Spelling of a consonant with a dot below, where it differs.
DOTTED = {"j": "z", "jh": "z", "d": "r", "dh": "rh", "k": "q", "ph": "f", "f": "f"}
#: Letters that have no sister at their place: final consonants of Malayalam and Bengali, and the Tamil visarga.
ALONE = {0x0D7A: "n", 0x0D7B: "n", 0x0D7C: "r", 0x0D7D: "l", 0x0D7E: "l", 0x0D7F: "k", 0x09CE: "t", 0x0B83: "h"}
#: Blocks that leave out the inherent a at the end of a word: Devanagari, Bengali, Gurmukhi, Gujarati.
SILENT_END = (0x0900, 0x0980, 0x0A00, 0x0A80)
JOINERS = "‌‍"

_KNOWN = VOWELS | CONSONANTS | SIGNS | NASALS | DIGITS
_MOVED = {c: 0x0900 + c % 0x80 if 0x0900 + c % 0x80 in _KNOWN or c % 0x80 + 0x0900 in (VIRAMA, NUKTA) else None for c in range(0x0900, 0x0D80)}
_MOVED |= dict.fromkeys(map(ord, JOINERS)) | ALONE
_one_of = lambda codes: "[" + "".join(map(chr, codes)) + "]"
_SYLLABLE = re.compile(f"({_one_of(CONSONANTS)})({chr(NUKTA)}*)({_one_of([*SIGNS, VIRAMA])}?)")
_LETTERS = _KNOWN | {VIRAMA: None, NUKTA: None}
_NATIVE = re.compile("[ऀ-ൿ]")


def is_native(text: str) -> bool:
    return bool(_NATIVE.search(text))


def word(native: str) -> str:
    """One word in simplified Latin; letters of other scripts stay."""
    natives = _NATIVE.findall(native)
    silent = bool(natives) and ord(natives[-1]) // 0x80 * 0x80 in SILENT_END

    def syllable(m: re.Match) -> str:
        consonant = CONSONANTS[ord(m[1])]
        if m[2]:
            consonant = DOTTED.get(consonant, consonant)
        if m[3]:
            return consonant + SIGNS.get(ord(m[3]), "")
        return consonant if silent and m.end() == len(m.string) else consonant + "a"

    spelt = _SYLLABLE.sub(syllable, native.translate(_MOVED)).translate(_LETTERS)
    return re.sub(r"([aeiou])\1+", r"\1", spelt)


def text(value: str, dictionary: dict[str, str] | None = None) -> str:
    """Every word in a native script by the dictionary, else by rule; other words as they are."""
    if not is_native(value):
        return value
    known = dictionary or {}
    return " ".join((known.get(w) or word(w)) if is_native(w) else w for w in value.split())


def translit(column: Column, dictionary: dict[str, str] | None = None) -> Column:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: text(v, dictionary), na_action="ignore")

    return run(column)
