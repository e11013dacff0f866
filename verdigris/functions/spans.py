"""Quoted passages as places in a document: half-open, from 0, in characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from verdigris.functions import text as T


def clean_quote(c: Column) -> Column:
    """Without quotes and ellipses at the ends, however many there are."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"""(?U)^(["'`“”‘’…\s]|\.\.\.)+""", ""), r"""(?U)(["'`“”‘’…\s]|\.\.\.)+$""", "")


def quote_pattern(c: Column) -> Column:
    """A pattern for the quote's words with any white space between, upper and lower case alike."""
    words = F.transform(F.split(F.trim(c), r"(?U)\s+"), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iuU)"), F.array_join(words, "\\s+"))


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
def _folded(doc: pd.Series, quote: pd.Series) -> pd.DataFrame:
    import unicodedata

    signs = {**dict.fromkeys(T.SINGLE_QUOTES, "'"), **dict.fromkeys(T.DOUBLE_QUOTES, '"'), **dict.fromkeys(T.DASHES, "-"), **dict.fromkeys(T.SPACES, " "), T.ELLIPSIS: "..."}

    def fold(text: str) -> tuple[str, list[int]]:
        out, origin = [], []
        for i, ch in enumerate(text):
            for plain in signs.get(ch) or unicodedata.normalize("NFKC", ch):
                out.append(plain)
                origin.append(i)
        return "".join(out), origin

    rows = []
    for d, q in zip(doc, quote, strict=True):
        found = None
        if d and q and q.split():
            text, origin = fold(d)
            found = re.search(r"\s+".join(map(re.escape, fold(q)[0].split())), text, re.IGNORECASE)
        rows.append((origin[found.start()], origin[found.end() - 1] + 1) if found and found.end() > found.start() else (None, None))
    return pd.DataFrame(rows, columns=["start", "stop"]).astype("Int32")


def as_written(doc: Column, quote: Column) -> Column:
    """STRUCT<start, stop, text> of the first place where the quote's own characters stand, none of them cleaned or folded.

    A quote that isn't there stays text; null if either is null.
    """
    at = F.instr(doc, quote)
    there = lambda c: F.when(at > 0, c).cast("int")
    return F.when(at.isNotNull(), F.struct(there(at - 1).alias("start"), there(at - 1 + F.length(quote)).alias("stop"), F.when(at == 0, quote).alias("text")))


def locate(doc: Column, quote: Column, folded: bool = True) -> Column:
    """STRUCT<start, stop> of a quote's first place: as written, then with other white space and case, then with both folded.

    Null if it stands nowhere.  The last step runs in Arrow batches; without ``folded`` it is left out.
    """
    q = clean_quote(quote)
    exact = F.instr(doc, q)
    found = F.regexp_substr(doc, quote_pattern(q))
    loose = F.instr(doc, found)
    pair = lambda at, size: F.struct((at - 1).cast("int").alias("start"), (at - 1 + size).cast("int").alias("stop"))
    out = F.when((F.length(q) == 0) | q.isNull() | doc.isNull(), None).when(exact > 0, pair(exact, F.length(q))).when(loose > 0, pair(loose, F.length(found)))
    if not folded:
        return out
    missed = F.when(out.isNull(), q)
    third = _folded(doc, missed)
    return F.coalesce(out, F.when(third["start"].isNotNull(), third))


def span_of_quote(doc: Column, quote: Column, folded: bool = True, word_for_word: bool = False) -> Column:
    """STRUCT<start, stop, text> for matching: a null word is an abstention, a quote that isn't there stays text and is wrong.

    With ``word_for_word`` every quote is taken :func:`as_written`.
    """
    if word_for_word:
        return as_written(doc, quote)
    at = locate(doc, quote, folded)
    return F.when(~T.is_null_word(quote), F.struct(at["start"].alias("start"), at["stop"].alias("stop"), F.when(at.isNull(), quote).alias("text")))


def quoted(doc: Column, start: Column, stop: Column) -> Column:
    """The passage at a span; null for one that reaches out of the text."""
    return F.when((start >= 0) & (stop > start) & (stop <= F.length(doc)), F.substr(doc, start + 1, stop - start))


def containing(docs: DataFrame, quotes: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Rows of ``docs`` and ``quotes`` where the text holds the quote word for word.

    A quote's inner words stand whole in a text that holds it, so quotes are joined by their longest one; quotes without an
    inner word are held against every text.
    """
    words = F.split(F.col(quote), r"[\x20\x09-\x0D]+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = quotes.withColumn("_key", F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    said = docs.withColumn("_word", F.explode(F.array_distinct(F.split(F.col(text), r"[\x20\x09-\x0D]+"))))
    by_word = said.join(keyed.where("_key is not null"), F.col("_word") == F.col("_key")).where(F.contains(F.col(text), F.col(quote))).drop("_word", "_key")
    short = docs.join(keyed.where("_key is null").drop("_key"), F.contains(F.col(text), F.col(quote)))
    return by_word.unionByName(short)
