"""Name normalisation as one Column expression."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a base letter + accent decomposition (fixed values).
PLAIN_LETTERS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss",
                 "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th"}
_RANGES = [(0x00C0, 0x024F), (0x1E00, 0x1EFF), (0xFF01, 0xFF5E)]


def _folding() -> tuple[dict[str, str], dict[str, str]]:
    """Accent folding derived from the Unicode data: one-letter and multi-letter results."""
    one, many = {}, {}
    for lo, hi in _RANGES:
        for code in range(lo, hi + 1):
            ch = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if base and base != ch:
                (one if len(base) == 1 else many)[ch] = base
    for ch, base in PLAIN_LETTERS.items():
        (one if len(base) == 1 else many)[ch] = base
    return one, many


_ONE, _MANY = _folding()


def normalize_name(name: Column) -> Column:
    """Accent-stripped, lower-case, punctuation-free, single-spaced; '' for NULL."""
    plain = F.octet_length(name) == F.length(name)       # ASCII only: no accents to look for
    s = F.when(plain, F.lower(name)).otherwise(_folded(name))
    s = F.regexp_replace(s, "[.'’`\"]", "")
    return F.coalesce(F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")), F.lit(""))


def _folded(name: Column) -> Column:
    """Lower-case letters without accents."""
    s = name
    s = F.translate(s, "".join(_ONE), "".join(_ONE.values()))
    # Multi-letter foldings are rare: a fold over a literal list, only on text that has such a letter.
    pairs = F.array(*[F.struct(F.lit(ch).alias("ch"), F.lit(base).alias("base")) for ch, base in _MANY.items()])
    wide = F.aggregate(pairs, s, lambda acc, x: F.replace(acc, x["ch"], x["base"]))
    s = F.when(s.rlike("[" + "".join(_MANY) + "]"), wide).otherwise(s)
    return F.lower(F.regexp_replace(s, r"\p{M}+", ""))


def compact(norm: Column) -> Column:
    return F.replace(norm, F.lit(" "), F.lit(""))


def token_sorted(norm: Column) -> Column:
    return F.array_join(F.array_sort(F.split(norm, " ")), " ")
