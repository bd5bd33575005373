"""Text expressions: input text, tokens, stop words, n-grams. All JVM-side columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
SEPARATOR = "[SEP]"
MISSING_ABSTRACT = "None"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
NGRAM_MAX = 3


def input_text(title: Column, abstract: Column, missing: str = MISSING_ABSTRACT) -> Column:
    """Title, separator and abstract; a missing abstract is the text ``None`` unless told otherwise."""
    return F.concat(title, F.lit(SEPARATOR), F.coalesce(abstract, F.lit(missing)))


def tokens(text: Column) -> Column:
    """Runs of two or more word characters of any script, case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def default_stop_words() -> list[str]:
    """The English list that ships with Spark ML; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def kept_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Tokens outside the stop list (case-sensitive) with their place in the whole token list."""
    placed = F.transform(tokens(text), lambda word, at: F.struct(word.alias("word"), at.alias("at")))
    if not stop_words:
        return placed
    return F.filter(placed, lambda token: ~token["word"].isin(*stop_words))


def spans(kept: Column, longest: int = NGRAM_MAX) -> Column:
    """All 1..n-grams over kept tokens: array of (term, n, first, last).

    ``first`` and ``last`` are places in the whole token list, so an n-gram that closes
    over a removed stop word spans it. Short lists give no n-grams of the sizes they lack.
    """
    def of_size(n: int) -> Column:
        starts = F.when(F.size(kept) >= n, F.sequence(F.lit(0), F.size(kept) - F.lit(n)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(
            F.concat_ws(" ", *[kept[k + F.lit(j)]["word"] for j in range(n)]).alias("term"),
            F.lit(n).alias("n"),
            kept[k]["at"].alias("first"),
            kept[k + F.lit(n - 1)]["at"].alias("last"),
        ))

    return F.concat(*[of_size(n) for n in range(1, longest + 1)])


def explode_spans(docs: DataFrame, stop_words: Sequence[str] = (), longest: int = NGRAM_MAX,
                  text: str = "text") -> DataFrame:
    """One row per n-gram occurrence; the other columns of ``docs`` are carried."""
    others = [name for name in docs.columns if name != text]
    kept = docs.select(*others, kept_tokens(F.col(text), stop_words).alias("_kept"))
    return (kept
            .select(*others, F.explode(spans(F.col("_kept"), longest)).alias("_span"))
            .select(*others, "_span.term", "_span.n", "_span.first", "_span.last"))


def stop_word_table(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(word,) for word in words], "word string")
