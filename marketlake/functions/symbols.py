"""Ticker spelling rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feed prefix and the accepted ticker pattern.
PREFIX = "A."
TICKER_PATTERN = "^[A-Z]{1,5}$"


def feed_symbol(ticker: Column) -> Column:
    """Ticker as the feed spells it: trimmed, upper case, prefixed once."""
    s = F.trim(F.upper(ticker))
    return F.when(s.startswith(PREFIX), s).otherwise(F.concat(F.lit(PREFIX), s))


def display_ticker(symbol: Column) -> Column:
    """Ticker as users see it: one leading feed prefix removed."""
    return F.regexp_replace(symbol, r"^A\.", "")


def cleaned_ticker(text: Column) -> Column:
    return F.upper(F.trim(text))


def is_valid_ticker(text: Column) -> Column:
    """Whether typed text is a ticker once trimmed and upper-cased; null counts as invalid."""
    return F.coalesce(cleaned_ticker(text).rlike(TICKER_PATTERN), F.lit(False))
