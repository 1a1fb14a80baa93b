"""Column expressions that normalise names and addresses, and cut records into typed tokens.

Everything is built from Spark's own functions; only texts that aren't in NFKC form already (never ASCII ones) pass an Arrow UDF, and only records in
native scripts pass the transliterator (see `translit`).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T

NON_WORD = r"[^\p{L}\p{N}_ऀ-ൿ]+"
NATIVE = "[ऀ-ൿ]"
#: Word border for patterns on text that may hold letters beyond ASCII.
UNICODE_WORDS = "(?U)"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def literal_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def strip_accents(text: Column) -> Column:
    """Latin letters (lower case) without accents; ligatures spelt out; marks of other scripts untouched."""
    source, target = T.accent_table()
    out = F.translate(text, source, target)
    for letter, spelt in T.LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return out


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def basic_clean(text: Column, nfkc: bool = False) -> Column:
    """Lower case without accents; null becomes ''. nfkc: also compose compatibility characters (an Arrow UDF, for rows beyond ASCII only)."""
    text = F.coalesce(text, F.lit(""))
    if nfkc:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)
    return strip_accents(F.lower(text))


def word_tokens(text: Column) -> Column:
    """Words: runs of letters, digits, underscores and native-script characters."""
    return F.filter(F.split(F.regexp_replace(text, NON_WORD, " "), " "), lambda t: t != "")


def fix_leet(token: Column) -> Column:
    """Digits that stand for letters, in tokens of two letters or more with one or two other characters."""
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    mixed = ~token.rlike(r"^(\p{L}+|\p{Nd}+)$")
    return F.when(mixed & (letters >= 2) & (letters >= F.length(token) - 2), F.translate(token, *T.LEET)).otherwise(token)


def canonical(token: Column, values: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(literal_map(values), token), token)


def latin(clean: Column, native) -> Column:
    """Texts in native scripts turned into Latin ones by `native`, if given; others never reach it."""
    return clean if native is None else F.when(clean.rlike(NATIVE), native(clean)).otherwise(clean)


def name_tokens(clean: Column) -> Column:
    """Canonical tokens of a clean name."""
    out = clean
    for pattern, by in T.NAME_JUNK:
        out = F.regexp_replace(out, UNICODE_WORDS + pattern, by)
    out = F.translate(F.regexp_replace(out, NON_WORD, " "), "_", " ")
    plain = F.transform(F.filter(F.split(out, " "), lambda t: t != ""), fix_leet)
    return F.transform(plain, lambda t: canonical(t, T.LEGAL_CANON))


_MARK = "\x01"
DOTTED = r"\b(?:[a-z]\.\s?){2,}(?:[a-z]\b\.?)?"


def undot(clean: Column) -> Column:
    """Dotted acronyms without their dots: s.a.r.l. becomes sarl. Matches are set apart by marks, as Spark can't rewrite a match itself."""
    parts = F.split(F.regexp_replace(clean, f"({DOTTED})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.regexp_replace(p, r"[.\s]", ""), F.lit(" "))).otherwise(p)), "")


def identity(tokens: Column, extra=()) -> Column:
    stop = literal_array([*T.NAME_STOP, *extra])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def norm_name(raw: Column, native=None, dotted: bool = False, extra_stop=(), nfkc: bool = False) -> Column:
    """struct(name, core, concat, alt) of a raw name.

    name: all canonical tokens. core: identity tokens, or all if there are none; of a record with two names, those of the first. concat: core without
    spaces. alt: identity tokens of the last of several names, else ''.
    """
    clean = basic_clean(raw, nfkc)
    if dotted:
        clean = undot(clean)
    clean = latin(clean, native)

    def of(clean: Column) -> Column:
        padded = F.concat(F.lit(" "), clean, F.lit(" "))
        # Java's split drops nothing here: limit -1 keeps empty parts
        return let(F.split(padded, T.OTHER_NAME, -1), lambda parts: let(name_tokens(clean), lambda tokens: parts_of(parts, tokens)))

    def parts_of(parts: Column, tokens: Column) -> Column:
        several = F.size(parts) > 1
        first = identity(name_tokens(F.element_at(parts, 1)), extra_stop)
        last = identity(name_tokens(F.element_at(parts, -1)), extra_stop)
        own = identity(tokens, extra_stop)
        core = F.when(several & (F.size(first) > 0), first).when(F.size(own) > 0, own).otherwise(tokens)
        return let(
            core,
            lambda c: F.struct(
                F.array_join(tokens, " ").alias("name"), F.array_join(c, " ").alias("core"), F.array_join(c, "").alias("concat"), F.when(several, F.array_join(last, " ")).otherwise("").alias("alt")
            ),
        )

    return let(clean, of)


def numbers(tokens: Column) -> Column:
    """All runs of digits in the tokens, in order, without leading zeros."""
    found = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(r"(\d+)"), 1)))
    return F.transform(found, lambda n: F.regexp_replace(n, r"^0+(?=.)", ""))


STATE_PATTERN = "|".join(sorted(T.STATES, key=lambda p: (-len(p), p)))
STATE_CODES = sorted(set(T.STATES.values()))


def departments(raw: Column) -> Column:
    """A part between commas that is the name of a department becomes its region's name."""
    key = lambda p: F.trim(F.regexp_replace(basic_clean(p), NON_WORD, " "))
    return F.array_join(F.transform(F.split(raw, ",", -1), lambda p: F.coalesce(F.concat(F.lit(" "), F.element_at(literal_map(T.DEPARTMENTS), key(p))), p)), ",")


def norm_address(raw: Column, native=None, french: bool = False, nfkc: bool = False) -> Column:
    """struct(addr, toks, nums, state) of a raw address. french: departments become regions and no two-letter code is read as a state."""
    raw = F.coalesce(raw, F.lit(""))
    clean = basic_clean(departments(raw) if french else raw, nfkc)
    clean = latin(clean, native)
    spaced = F.trim(F.regexp_replace(F.translate(clean, "_", " "), r"[^\p{L}\p{N}ऀ-ൿ]+", " "))
    states = literal_map(T.STATES)

    def marked(s: Column) -> Column:
        """Parts of the text; every second one is a state phrase."""
        return F.split(F.regexp_replace(s, rf"{UNICODE_WORDS}\b({STATE_PATTERN})\b", f"{_MARK}$1{_MARK}"), _MARK, -1)

    def of(parts: Column) -> Column:
        phrases = F.filter(parts, lambda p, i: i % 2 == 1)
        named = F.when(F.size(phrases) > 0, F.element_at(states, F.element_at(phrases, -1))).otherwise("")
        text = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit(" st8_"), F.element_at(states, p), F.lit(" "))).otherwise(p)), "")
        tokens = F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: F.when(t.startswith("st8_"), t).otherwise(canonical(t, T.ADDRESS_CANON)))
        return let(tokens, lambda toks: let(state_of(toks, named), lambda st: pieces(toks, st)))

    def state_of(toks: Column, named: Column) -> Column:
        if french:
            return named
        codes = literal_array(STATE_CODES)
        tail = F.filter(F.slice(F.reverse(toks), 1, 3), lambda t: (F.length(t) == 2) & F.array_contains(codes, t))
        return F.when(named != "", named).when(F.size(tail) > 0, F.element_at(tail, 1)).otherwise("")

    def pieces(toks: Column, state: Column) -> Column:
        stop = literal_array(T.ADDRESS_STOP)
        plain = F.filter(toks, lambda t: ~t.startswith("st8_"))
        kept = F.filter(plain, lambda t: ~t.rlike(r"^\d+$") & ~F.array_contains(stop, t))
        words = F.transform(kept, lambda t: F.when(t.rlike(r"^\d+(st|nd|rd|th)$"), t).otherwise(F.regexp_replace(t, r"\d+", "")))
        words = F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t) & (t != state))
        return F.struct(F.array_join(toks, " ").alias("addr"), F.array_join(words, " ").alias("toks"), F.array_join(numbers(plain), " ").alias("nums"), state.alias("state"))

    return let(marked(spaced), of)


def split_words(text: Column) -> Column:
    """Words of a normalised column (separated by single spaces); '' has none."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def typed_tokens(core: Column, concat: Column, alt: Column, toks: Column, nums: Column) -> Column:
    """Distinct typed tokens of a record: n: name word, p: its first four letters, c: first seven letters of the joined name, k: all of it, a: address word, #: number."""
    words = F.concat(split_words(core), split_words(alt))
    tag = lambda prefix, items: F.transform(items, lambda t: F.concat(F.lit(prefix), t))
    return F.array_distinct(
        F.concat(
            tag("n:", words),
            tag("p:", F.transform(F.filter(words, lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 4))),
            F.when(F.length(concat) >= 5, F.array(F.concat(F.lit("c:"), F.substring(concat, 1, 7)))).otherwise(F.array().cast("array<string>")),
            F.when(concat != "", F.array(F.concat(F.lit("k:"), concat))).otherwise(F.array().cast("array<string>")),
            tag("a:", split_words(toks)),
            tag("#:", split_words(nums)),
        )
    )


def role(entity_id: Column, ghost: float = 0.2, valid: float = 0.36) -> Column:
    """ghost, valid or fit, by the first 32 bits of the id's MD5."""
    share = F.conv(F.substring(F.md5(entity_id), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(share < ghost, "ghost").when(share < valid, "valid").otherwise("fit")


def city_key(text: Column) -> Column:
    """A place name without accents, punctuation and other letters; saint is st."""
    out = strip_accents(F.lower(text))
    out = F.regexp_replace(F.regexp_replace(out, r"\bsaint\b", "st"), r"\bst\.", "st")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\x00-\x7F]", ""), "[^a-z0-9]+", " "))


def components(address: Column) -> Column:
    return F.transform(F.split(F.coalesce(address, F.lit("")), ",", -1), city_key)


HOUSE_NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:\s?[-/]\s?\d+)*[a-z]?(?![\p{L}\p{N}_])|(?<=[a-z])\d+(?:[-/]\d+)*(?![\p{L}\p{N}_])"


def house_numbers(raw: Column) -> Column:
    """Composite numbers of a raw address in order (9-7, 137/17, 4809b), without inner spaces; ordinals aren't among them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(f"({HOUSE_NUMBER})"), 1)
    return F.transform(found, lambda n: F.regexp_replace(n, r"\s", ""))


def last_number(number: Column) -> Column:
    """The last digit group, nine digits at most, as a number; null without one."""
    groups = F.regexp_extract_all(number, F.lit(r"(\d+)"), 1)
    return F.when(F.size(groups) > 0, F.substring(F.element_at(groups, -1), 1, 9).cast("long"))


def first_number(raw: Column) -> Column:
    """The first number with an optional letter, '' without one."""
    return F.regexp_extract(F.lower(F.coalesce(raw, F.lit(""))), r"\d+[a-z]?", 0)


def acronym(long_core: Column, short_core: Column) -> Column:
    """Whether the short name is the initials of the long one, two to six letters."""
    short = F.replace(short_core, F.lit(" "), F.lit(""))
    initials = F.array_join(F.transform(split_words(long_core), lambda w: F.substring(w, 1, 1)), "")
    return (F.length(short) >= 2) & (F.length(short) <= 6) & short.rlike(r"^\p{L}+$") & (short == initials)


def embed_text(core: Column, alt: Column, addr: Column) -> Column:
    return F.concat(core, F.when(alt != "", F.concat(F.lit(" "), alt)).otherwise(""), F.lit(" | "), addr)


def pair_text(name: Column, addr: Column) -> Column:
    filled = lambda c, empty: F.when(c == "", empty).otherwise(c)
    return F.concat(filled(name, "no name"), F.lit(" | "), filled(addr, "no address"))


#: Scripts told apart by `dominant_script`.
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "native": r"[ऀ-ൿ&&\p{L}]", "han": r"\p{IsHan}"}


def dominant_script(text: Column) -> Column:
    """The script of most letters (the first listed among equals); 'none' without letters of these scripts."""
    counts = [F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (s, p) in enumerate(SCRIPTS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["s"]).otherwise("none")
