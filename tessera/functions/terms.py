"""Index terms of text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLDS = [(chr(c), base[0]) for c in range(0xC0, 0x250) if len(base := unicodedata.normalize("NFD", chr(c).lower())) > 1 and base[0].isascii() and base[0].isalpha()]
_FROM, _TO = "".join(a for a, _ in _FOLDS), "".join(b for _, b in _FOLDS)


def folded(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), _FROM, _TO)


def terms(text: Column) -> Column:
    """Runs of letters and digits, folded; ``_`` parts terms."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: Letters that case folding turns into something else than lower case does, and what it makes of them.
_CASED = [(chr(c), chr(c).casefold()) for c in (0xDF, 0x149, 0x17F, 0x1F0, 0x390, 0x3B0, 0x3C2, 0x3D0, 0x3D1, 0x3D5, 0x3D6, 0x3F0, 0x3F1, 0x3F5, 0x587, *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18))]


def case_folded(text: Column) -> Column:
    """Lower case, and letters such as ß as case folding has them."""
    out = F.lower(text)
    single = [(a, b) for a, b in _CASED if len(b) == 1]
    out = F.translate(out, "".join(a for a, _ in single), "".join(b for _, b in single))
    for letter, folded_ in _CASED:
        if len(folded_) > 1:
            out = F.replace(out, F.lit(letter), F.lit(folded_))
    return out


def words(text: Column) -> Column:
    """The distinct words of a text, case folded, for claims; ``_`` belongs to a word."""
    return F.array_distinct(F.regexp_extract_all(case_folded(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
