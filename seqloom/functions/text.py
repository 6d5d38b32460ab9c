"""Tokens, phrases and message masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The masks of messages and what they are replaced with, applied in this order.
MASKS = (
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "<:MAC:>"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "<:IP:>"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)", "<:SEQ:>"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)", "<:SEQ:>"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "<:HEX:>"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "<:NUM:>"),
    (r"(?<=executed cmd )(\".+?\")", "<:CMD:>"),
)


def masked(text: Column) -> Column:
    """Numbers, addresses and the like as placeholders. Digits are those of any script, as in Python."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, f"(?U){pattern}", mask)
    return text


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def phrases(text: Column, low: int = 1, high: int = 2) -> Column:
    """The whole text, normalised, and its n-grams of tokens; a phrase that comes up twice stands twice."""
    return phrases_of(normalised(text), tokens(text), low, high)


def phrases_of(whole: Column, own: Column, low: int = 1, high: int = 2) -> Column:
    """phrases of a normalised text and its tokens. Where these are columns of the rows, a text is searched for tokens once and not for each of its phrases."""

    def grams_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(own) - (n - 1))
        return F.when(F.size(own) >= n, F.transform(places, lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(n) for n in range(low, high + 1)]
    return F.concat(F.when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>")), *grams)


def numeric(text: Column) -> Column:
    """A finite number, or null."""
    ok = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    number = F.trim(text).try_cast("double")
    return F.when(ok & number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number)
