"""Word and k-gram primitives built from Spark SQL functions only.

Words are maximal runs of digits, ASCII letters and code points from U+0080 on,
after lower-casing A-Z alone. Null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the cheap built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_of(text: Column) -> Column:
    """Array of words of a text column, empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def with_gram_hashes(df: DataFrame, words: str, lengths: list[int], prefix: str = "_g") -> DataFrame:
    """Add for every length L an array column of the hashes of all L-word windows.

    Windows are hashed by doubling (1, 2, 4, ...), so a length costs a logarithmic
    number of passes; each pass is a column of its own so that Catalyst does not
    inline it twice.
    """
    need, have = max(lengths), 1
    df = df.withColumn(f"{prefix}1", F.transform(words, lambda w: F.xxhash64(w)))
    powers = [1]
    while have * 2 <= need:
        df = df.withColumn(f"{prefix}{have * 2}", _shifted(f"{prefix}{have}", f"{prefix}{have}", words, have, have))
        have *= 2
        powers.append(have)
    for length in sorted(set(lengths)):
        if length in powers:
            continue
        parts = [p for p in reversed(powers) if length & p]
        done, left = f"{prefix}{parts[0]}", parts[0]
        for p in parts[1:]:
            name = f"{prefix}{left + p}" if left + p == length else f"{prefix}t{length}_{left + p}"
            df = df.withColumn(name, _shifted(done, f"{prefix}{p}", words, left, p))
            done, left = name, left + p
    return df


def _shifted(left: str, right: str, words: str, n_left: int, n_right: int) -> Column:
    n = F.greatest(F.size(words) - F.lit(n_left + n_right - 1), F.lit(0))
    return F.zip_with(
        F.slice(F.col(left), F.lit(1), n), F.slice(F.col(right), F.lit(n_left + 1), n), lambda a, b: F.xxhash64(a, b)
    )

