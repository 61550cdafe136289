"""Text keys, identifiers, masks and labels."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from fieldcheck.constants import (
    ACRONYMS, BLANKS, DIGIT_RUN_PATTERN, ID_LENGTH, MASK_CHAR, PHONE_LENGTH,
)
from fieldcheck.functions.numbers import as_col

# Latin letters without a canonical decomposition, and their plain spelling.
MULTI_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
SINGLE_LETTERS = {"ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t", "ŋ": "n"}
COMBINING_MARKS = r"[\x{0300}-\x{036f}]"


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Lower-case accented Latin letters and their base letters, from Unicode decomposition."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        if letter == letter.lower() and letter != base and "a" <= base <= "z":
            if letter not in MULTI_LETTERS:
                accented.append(letter)
                plain.append(base)
    for letter, base in SINGLE_LETTERS.items():
        accented.append(letter)
        plain.append(base)
    return "".join(accented), "".join(plain)


def fold_accents(x: Column | str) -> Column:
    """Replace accented lower-case Latin letters by plain ones."""
    x = as_col(x)
    out = x
    for letter, plain in MULTI_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.translate(out, *accent_map())
    out = F.regexp_replace(out, COMBINING_MARKS, "")
    # A text with as many bytes as characters is plain ASCII and needs no folding.
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(out)


def norm_key(x: Column | str) -> Column:
    """Matching key: lower case, accents folded, only ``a-z0-9`` kept."""
    return F.regexp_replace(fold_accents(F.lower(as_col(x))), "[^a-z0-9]", "")


def norm_key_text(x: str) -> str:
    """``norm_key`` of a driver-side value."""
    text = x.lower()
    for letter, plain in MULTI_LETTERS.items():
        text = text.replace(letter, plain)
    text = text.translate(str.maketrans(*accent_map()))
    return re.sub("[^a-z0-9]", "", text)


def norm_name(x: str) -> str:
    """Matching key of a column name."""
    return re.sub("[^a-z0-9]", "", x.lower())


def trimmed(x: Column | str) -> Column:
    """Text without blanks, tabs and line ends around it."""
    return F.btrim(as_col(x).cast("string"), F.lit(BLANKS))


def blank_to_null(x: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trimmed(x), F.lit(""))


def is_present(x: Column | str) -> Column:
    return blank_to_null(x).isNotNull()


def digits_only(x: Column | str) -> Column:
    return F.regexp_replace(as_col(x).cast("string"), "[^0-9]", "")


def normalize_phone(x: Column | str) -> Column:
    """Digits of a phone number with the country prefix ``+62`` written as ``0``."""
    compact = F.regexp_replace(as_col(x).cast("string"), r"[\s()\-]", "")
    return digits_only(F.regexp_replace(compact, r"^\+62", "0"))


def normalize_person(x: Column | str) -> Column:
    """Name with one spelling: lower case, single spaces, no accents."""
    squished = F.btrim(F.regexp_replace(F.lower(as_col(x).cast("string")), r"\s+", " "))
    return fold_accents(squished)


def salted_hash(x: Column | str, salt: str) -> Column:
    """SHA-256 hex of salt and value; NULL for NULL or empty."""
    x = as_col(x)
    return F.when(x != "", F.sha2(F.concat(F.lit(salt), x), 256))


def mask_tail(x: Column | str, keep: int) -> Column:
    """All but the last ``keep`` characters masked; short values are masked whole."""
    x = as_col(x)
    size = F.length(x)
    shown = F.when(size > keep, F.right(x, F.lit(keep))).otherwise(F.lit(""))
    hidden = F.when(size > keep, size - keep).otherwise(size)
    return F.when(x != "", F.concat(F.repeat(F.lit(MASK_CHAR), hidden), shown))


def pseudonym(hashed: Column | str, prefix: str) -> Column:
    """``D-1a2b3c4d``: a prefix and the first 8 hash characters; NULL for NULL."""
    return F.concat(F.lit(f"{prefix}-"), hash_preview(hashed))


def hash_preview(hashed: Column | str) -> Column:
    return F.substring(as_col(hashed), 1, 8)


def id_length_ok(length: Column | str) -> Column:
    return F.coalesce(as_col(length) == ID_LENGTH, F.lit(False))


def phone_length_ok(length: Column | str) -> Column:
    return F.coalesce(as_col(length).between(*PHONE_LENGTH), F.lit(False))


def has_digit_run(x: Column | str) -> Column:
    """The text holds a run of at least 10 digits."""
    return as_col(x).rlike(DIGIT_RUN_PATTERN)


def matches_or_null(x: Column | str, pattern: str) -> Column:
    x = as_col(x)
    return x.isNull() | x.rlike(pattern)


def pretty_var(x: Column | str) -> Column:
    """Display form of a variable name."""
    text = F.regexp_replace(as_col(x), r"[._]+", " ")
    text = F.regexp_replace(text, r"(?i)\bTgl\.?\b", "Tanggal")
    text = F.regexp_replace(text, r"(?i)\bNo\b", "No.")
    text = F.btrim(F.regexp_replace(text, r"\s+", " "))
    upper = F.upper(text)
    return F.when(upper.isin(ACRONYMS), upper).otherwise(F.initcap(F.lower(text)))
