"""Sound patterns of words as column expressions: segments, stress, signatures and their match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import profile_map

ACUTE = "́"
VOWELS = "aeiou"
#: Precomposed Latin letters, by combining mark.
MARKED = {"̀": ("àèìòù", "aeiou"), "́": ("áéíóú", "aeiou"), "̂": ("âêîôû", "aeiou"), "̈": ("äëïöü", "aeiou"), "̃": ("ãõñ", "aon"), "̧": ("ç", "c")}
SEGMENT = r"k\p{M}*h\p{M}*|s\p{M}*h\p{M}*|t\p{M}*s\p{M}*|\p{L}\p{M}*"


def decomposed(word: Column) -> Column:
    """Lower case, with marks apart from their letters (a fixed set of Latin letters)."""
    out = F.lower(word)
    for mark, (whole, base) in MARKED.items():
        for x, y in zip(whole, base):
            out = F.replace(out, F.lit(x), F.lit(y + mark))
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(out)


def clean(word: Column) -> Column:
    """Letters and marks only; annotations in brackets and braces go first."""
    return F.regexp_replace(decomposed(F.regexp_replace(word, r"\[[^\]]*\]|\{[^}]*\}", "")), r"[^\p{L}\p{M}]", "")


def segments(cleaned: Column) -> Column:
    """Sounds in order: kh, sh and ts are one, but tsh is t and sh."""
    apart = F.regexp_replace(cleaned, r"(t\p{M}*)(s\p{M}*h)", "$1|$2")
    return F.regexp_extract_all(apart, F.lit(f"({SEGMENT})"), F.lit(1))


def base(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\p{M}", "")


def is_vowel(segment: Column) -> Column:
    return base(segment).isin(*VOWELS)


def is_stressed(segment: Column) -> Column:
    return F.contains(segment, F.lit(ACUTE))


def normal(segment: Column, profile: str = "STRICT") -> Column:
    """A segment without marks, or its representative under the profile."""
    out = base(segment)
    for x, y in profile_map(profile).items():
        out = F.when(base(segment) == x, F.lit(y)).otherwise(out)
    return out


def stressed_at(parts: Column) -> Column:
    """Place (from 1) of the last stressed vowel; 0 without one."""
    places = F.transform(parts, lambda x, i: F.when(is_vowel(x) & is_stressed(x), i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def primary_key(parts: Column, at: Column, profile: str = "STRICT") -> Column:
    """From the stressed vowel to the end, and one sound more before a final vowel; null without stress."""
    start = F.when(at == F.size(parts), F.greatest(at - 1, F.lit(1))).otherwise(at)
    return F.when(at > 0, F.array_join(F.transform(F.slice(parts, start, F.size(parts)), lambda x: normal(x, profile)), "-"))


def bridge_key(parts: Column, at: Column, profile: str = "STRICT") -> Column:
    """Consonant and stressed vowel of a word that ends in that vowel and one consonant; else null."""
    n = F.size(parts)
    fits = (at > 1) & (at == n - 1) & ~is_vowel(F.get(parts, n - 1)) & ~is_vowel(F.get(parts, at - 2))
    return F.when(fits, F.array_join(F.transform(F.slice(parts, F.greatest(at - 1, F.lit(1)), 2), lambda x: normal(x, profile)), "-"))


def extended_left(parts: Column, at: Column) -> Column:
    return (at > 1) & (at == F.size(parts))


def match_kind(p1: Column, b1: Column, p2: Column, b2: Column) -> Column:
    """FULL where the primary keys agree, BRIDGE where one's primary is the other's bridge, else null."""
    crossed = F.coalesce(p1 == b2, F.lit(False)) | F.coalesce(b1 == p2, F.lit(False))
    return F.when(p1 == p2, F.lit("FULL")).when(crossed, F.lit("BRIDGE"))
