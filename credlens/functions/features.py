"""Per-string features as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class bits, character classes and alphabet sizes.
LOWER, UPPER, DIGIT, SYMBOL, UNICODE = 1, 2, 4, 8, 16
CLASSES = ((LOWER, "[a-z]", 26), (UPPER, "[A-Z]", 26), (DIGIT, "[0-9]", 10), (SYMBOL, r"[\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", 33), (UNICODE, r"[^\x00-\x7F]", 100))
LABELS = ("minúsculas", "mayúsculas", "dígitos", "símbolos", "unicode")
#: Substitution characters and the letters that they stand for.
LEET, PLAIN = "4@31!|05$78", "aaeiiiosstb"
BUCKET, TOP_BUCKET = 0.5, 99999.0


def charset_mask(s: Column) -> Column:
    """Bits of the character classes that occur; control characters have none."""
    bits = [F.when(s.rlike(regex), F.lit(bit)).otherwise(0) for bit, regex, _ in CLASSES]
    return sum(bits[1:], bits[0])


def charset_size(mask: Column) -> Column:
    sizes = [F.when(mask.bitwiseAND(bit) > 0, F.lit(n)).otherwise(0) for bit, _, n in CLASSES]
    return sum(sizes[1:], sizes[0])


def charset_bits(length: Column, size: Column) -> Column:
    return F.when(size > 0, length * F.log2(size.cast("double"))).otherwise(0.0)


def composition(mask: Column) -> Column:
    """Labels of the classes in a mask, in fixed order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(bit) > 0, F.lit(label)) for (bit, _, _), label in zip(CLASSES, LABELS, strict=True)]))


def shannon_per_char(s: Column) -> Column:
    """Entropy of the characters' frequencies in bits; 0 for at most one character."""
    chars = F.split(s, "")
    n = F.length(s).cast("double")
    # The count of a character is what its removal takes away; only distinct characters are looked at.
    each = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    total = F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(s) > 1, total).otherwise(0.0)


def entropy_bucket(bits: Column) -> Column:
    return F.when(bits < 0, 0.0).otherwise(F.least(F.floor(bits / BUCKET) * BUCKET, F.lit(TOP_BUCKET)))


def is_leet(s: Column) -> Column:
    return s.rlike(r"[4@31!|05$78]")


def deleet(s: Column) -> Column:
    return F.translate(F.lower(s), LEET, PLAIN)


def substitutions(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(F.lower(s), LEET, ""))


def is_ascii_digits(s: Column) -> Column:
    return s.rlike("^[0-9]+$")


def is_word(s: Column) -> Column:
    return s.rlike(r"^\p{L}{3,}$")


def full_year(yy: Column) -> Column:
    return F.when(yy < 50, 2000 + yy).otherwise(1900 + yy)
