"""n-grams of token arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges that are offered.
WORD_RANGES = ((1, 1), (1, 2), (1, 3))


def word_ngrams(tk: Column, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """All n-grams of the range joined by spaces, shorter ones first, each in order of place."""
    if tuple(ngram_range) not in WORD_RANGES:
        raise ValueError(f"ngram_range must be one of {WORD_RANGES}")

    def of(n: int) -> Column:
        if n == 1:
            return tk
        grams = F.transform(F.sequence(F.lit(1), F.size(tk) - (n - 1)), lambda i: F.array_join(F.slice(tk, i, n), " "))
        return F.when(F.size(tk) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(ngram_range[0], ngram_range[1] + 1)])


def char_wb_ngrams(tk: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words that are padded by one space on both sides.

    A padded word that is not longer than n is given once as a whole, for the smallest such n.
    """

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)

        def of_n(n: Column) -> Column:
            whole = F.when((n == low) | (size > n - 1), F.array(padded)).otherwise(F.array().cast("array<string>"))
            cut = F.transform(F.sequence(F.lit(1), size - n + 1), lambda p: F.substring(padded, p, n))
            return F.when(size <= n, whole).otherwise(cut)

        return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of_n))

    return F.flatten(F.transform(tk, of_word))
