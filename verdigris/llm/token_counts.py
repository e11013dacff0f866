"""Token counts of documents from the counts of their distinct pre-tokens; no ids are made.

1. :func:`pre_token_counts` splits every whole text as the tokenizer would before its merges, and counts pre-tokens.
2. :func:`piece_counts` runs the merges once for each distinct pre-token of the whole corpus.
3. :func:`document_counts` takes each document's pre-tokens with their frequencies and adds up frequency times pieces for
   those that are met most often, whose counts every task has: no task gets all documents of a common one.
4. :func:`count_tokens` adds the others, each of few documents, in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import least_frequent_of, text_batches, written

#: Pre-tokens whose counts every task has, and bytes that one of them has, at most: 20 MB in all.
COMMON, COMMON_BYTES = 200_000, 100
#: Pre-tokens that a task counts before it hands them on.
HELD = 100_000
_workers: dict = {}


class PreTokens:
    """Splits a text into the tokenizer's pre-tokens; special strings in it stand alone, as the tokenizer takes them.

    The byte-level pattern runs in ``regex``.  Code points that Unicode 15.1 does not know may be letters for one of the two
    libraries alone, so a text with any is split by the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: pieces are counted by pre-token for byte-level tokenizers that neither normalize nor strip")
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.marks = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.marks)) + ")") if self.marks else None

    def _split(self, text: str) -> list[str]:
        from unicodedata import category

        if text.isascii() or all(category(c) != "Cn" for c in set(text)):
            return self.words(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not any(m in text for m in self.marks):
            return self._split(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._split(part)
        return out


def _worker(path: str) -> PreTokens:
    if path not in _workers:
        _workers[path] = PreTokens(path)
    return _workers[path]


def pre_token_counts(texts: DataFrame, tokenizer_path: str, held: int = HELD) -> DataFrame:
    """(pre_token, n): how often each pre-token stands in all of ``texts`` (text without nulls).

    A task adds up in memory and hands on what it has once it holds ``held`` pre-tokens, so few rows are left to shuffle.
    """

    def split(batches):
        from collections import Counter

        import pyarrow as pa

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["pre_token", "n"])

        words, found = _worker(tokenizer_path), Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(words(value.as_py()))
                if len(found) >= held:
                    yield out(found)
                    found.clear()
        if found:
            yield out(found)

    text_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(split, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """(pre_token, n, pieces) of ``words`` (pre_token, n): the merges run once for each."""

    def count(batches):
        import pyarrow as pa

        tok = _worker(tokenizer_path).tok
        for batch in batches:
            got = tok.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(e) for e in got], pa.int64())], names=["pre_token", "n", "pieces"])

    text_batches(words.sparkSession)
    return words.select("pre_token", "n").mapInArrow(count, "pre_token string, n long, pieces long")


def document_counts(rows: DataFrame, tokenizer_path: str, known: dict[str, int]) -> DataFrame:
    """(row_id, doc_id, n_bytes, n_tokens, others) of ``rows`` (row_id, doc_id, text without nulls), a row each.

    A document's distinct pre-tokens, with their frequencies, meet the piece counts ``known``, which every task has: ``n_tokens``
    is the sum of frequency times pieces.  ``others`` holds the pre-tokens that it does not have, with their frequencies.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        words, pieces = _worker(tokenizer_path), shared.value
        for batch in batches:
            sizes, sums, ends, tokens, times = [], [], [0], [], []
            for value in batch.column(2):
                text = value.as_py()
                total = 0
                for token, n in Counter(words(text)).items():
                    k = pieces.get(token)
                    if k is None:
                        tokens.append(token)
                        times.append(n)
                    else:
                        total += n * k
                sizes.append(len(text.encode()))
                sums.append(total)
                ends.append(len(tokens))
            others = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int64())], names=["pre_token", "times"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), others], names=["row_id", "doc_id", "n_bytes", "n_tokens", "others"])

    text_batches(rows.sparkSession)
    return rows.select("row_id", "doc_id", "text").mapInArrow(count, "row_id long, doc_id long, n_bytes long, n_tokens long, others array<struct<pre_token:string,times:long>>")


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, common: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``, equal to the tokenizer's own counts.

    Null text is empty and has no tokens; rows that repeat a doc_id, and a null doc_id, are rows like any other; a text of any
    length is split whole; no rows give no rows.  Other columns of ``docs`` are ignored, whatever their names.  The counts of
    distinct pre-tokens and each row's sums are written to the shared folder, where the result reads them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    pieces = written(piece_counts(pre_token_counts(rows, tokenizer_path), tokenizer_path), "pre-tokens")
    often = (F.col("n") >= least_frequent_of(pieces, "n", common)) & (F.octet_length("pre_token") <= COMMON_BYTES)
    known = {r["pre_token"]: r["pieces"] for r in pieces.where(often).select("pre_token", "pieces").collect()}
    # a row id is made in this one pass alone and then read from the table
    sums = written(document_counts(rows.withColumn("row_id", F.monotonically_increasing_id()), tokenizer_path, known), "token-sums")
    seldom = sums.select("row_id", F.explode("others").alias("o")).select("row_id", "o.*").join(pieces.where(~often).select("pre_token", "pieces"), "pre_token")
    more = seldom.groupBy("row_id").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = sums.drop("others").join(more, "row_id", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
