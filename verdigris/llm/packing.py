"""Sequence packing: shortest-pack-first over the length histogram.

1. :func:`token_pieces` tokenizes every whole text, ends it with an end id and cuts it into pieces of at most ``window`` ids.
2. The histogram of piece lengths (at most ``window`` rows, whatever the corpus) goes to the driver, where
   :func:`shortest_pack_first` places lengths longest first and keeps counts of packing patterns instead of packs.
3. :func:`assign_sequences` ranks the pieces of each length and joins the patterns' slots back by rank.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import text_batches, text_slices, written


WINDOW = 1024
#: Pieces a rank bucket holds on average; ranks are counted in buckets, so no task ranks all pieces of a common length.
BUCKET_PIECES = 512
#: Buckets of a length at most.
BUCKETS = 4096
#: Words whose ids a worker remembers, and bytes of text that it takes at once.
CACHED_WORDS, SLICE_BYTES = 600_000, 6_000_000
_workers: dict = {}


class WordEncoder:
    """Ids of many texts at a time, equal to the tokenizer's own.

    The byte-level pattern never joins a space with what stands before it, so a text without runs of spaces is the join of
    its first word and " word" units.  Units are coded by Arrow; each distinct one is encoded once and remembered.  New
    units are joined to one string for the merges, and cut apart again by their bytes.  Where the file's merges stand in
    order of their ids, tiktoken runs them from the same vocabulary, else the tokenizer itself.  A text with two spaces in a
    row or a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, int] = {}
        self._reset()
        spec = json.loads(self.tok.to_str())
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        pre = spec.get("pre_tokenizer") or {}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        self.quick = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None and all(a < b for a, b in zip(made, made[1:])):
            import public_tokenizers
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
            chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in set(self.special)}
            self.quick = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.width[list(ranks.values())] = [len(b) for b in ranks]

    def _reset(self) -> None:
        import numpy as np

        self.cache.clear()
        self.ids, self.ends = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 15, dtype=np.int64)
        self.n_ids = self.n_units = 0

    def _room(self, array, used: int, more: int):
        import numpy as np

        return array if used + more <= len(array) else np.concatenate([array, np.zeros(max(len(array), more), dtype=array.dtype)])

    def _learn(self, units: list[str]) -> None:
        """Ids of new units, appended to ``ids`` with their ends; units begin with a space, or are the texts' first words."""
        import numpy as np

        if self.quick is None:
            got = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
            sizes, flat = np.fromiter(map(len, got), dtype=np.int64, count=len(got)), np.array([i for g in got for i in g], dtype=np.uint32)
        else:
            flat = np.array(self.quick.encode_ordinary("".join(units)), dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(np.fromiter((len(u.encode()) for u in units), dtype=np.int64, count=len(units))), side="left") + 1
            sizes = np.diff(ends, prepend=0)
        self.ids, self.ends = self._room(self.ids, self.n_ids, len(flat)), self._room(self.ends, self.n_units, len(units) + 1)
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.ends[self.n_units + 1 : self.n_units + 1 + len(units)] = self.n_ids + np.cumsum(sizes)
        self.cache.update(zip(units, range(self.n_units, self.n_units + len(units)), strict=True))
        self.n_ids += len(flat)
        self.n_units += len(units)

    def _numbers(self, units: list[str]):
        """The number of each unit in ``ends``; those not known yet are learnt."""
        import numpy as np

        cache = self.cache
        new = [u for u in units if u not in cache]
        if len(cache) + len(new) > CACHED_WORDS:
            self._reset()
            new = units
        for kind in (True, False):
            part = [u for u in new if (u[:1] == " ") == kind and u]
            for i in range(0, len(part), 20_000 if kind else 1):
                self._learn(part[i : i + (20_000 if kind else 1)])
        if "" in new:
            self.ends = self._room(self.ends, self.n_units, 2)
            self.ends[self.n_units + 1] = self.n_ids
            cache[""] = self.n_units
            self.n_units += 1
        return np.fromiter(map(cache.__getitem__, units), dtype=np.int64, count=len(units))

    def encode(self, texts) -> Iterator:
        """A numpy array of ids for each text of an Arrow string array without nulls, in order."""
        import numpy as np
        import pyarrow.compute as pc

        odd = pc.match_substring(texts, "  ")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.if_else(odd, "", texts) if odd.any() else texts
        lists = pc.split_pattern(plain, " ")
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).copy(), coded.dictionary.to_pylist()
        del lists, coded
        opening = [names[c] for c in codes[starts[:-1]]]
        units = list(dict.fromkeys(opening))
        at = {u: len(names) + i for i, u in enumerate(units)}
        codes[starts[:-1]] = [at[u] for u in opening]
        number = self._numbers([f" {n}" for n in names] + units)
        begin, end = self.ends[number], self.ends[number + 1]
        size = end - begin
        # some texts at a time, so that the positions being gathered stay few
        step = max(1, len(texts) // 8)
        for lo in range(0, len(texts), step):
            hi = min(len(texts), lo + step)
            c = codes[starts[lo] : starts[hi]]
            each = size[c]
            ends = np.concatenate([[0], np.cumsum(each)])
            got = self.ids[np.repeat(begin[c] - ends[:-1], each) + np.arange(ends[-1])]
            for i in range(lo, hi):
                if odd[i]:
                    yield np.array(self.tok.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids, dtype=np.uint32)
                else:
                    yield got[ends[starts[i] - starts[lo]] : ends[starts[i + 1] - starts[lo]]]


def token_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens and, ``with_ids``, ids array<int>) of every document.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit numbers.  Null text is empty and gives the end id
    alone; equal rows give equal pieces each; a text of any length is cut, never cropped.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if tokenizer_path not in _workers:
            _workers[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _workers[tokenizer_path]
        for batch in batches:
            keys = batch.column(0)
            for at, part in text_slices(pc.fill_null(batch.column(1), ""), SLICE_BYTES):
                who, out, held = [], [], []
                for i, ids in enumerate(encoder.encode(part)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), window):
                        piece = ids[s : s + window]
                        who.append(at + i)
                        out.append((s, len(piece), zlib.crc32(piece), len(ids)))
                        if with_ids:
                            held.append(piece.astype(np.int32))
                cols = [keys.take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))]
                if with_ids:
                    cols.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    text_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) patterns that hold each length as often as ``histogram`` says, none over ``window``.

    Lengths go longest first, each into the shortest pack that is open, if it fits there, else into a new one; packs that
    look alike are one pattern with a count.  Work and result depend on the number of lengths, not of pieces.
    """
    done: dict[tuple[int, ...], int] = defaultdict(int)
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    fills: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        fill = sum(pattern)
        if fill == window:
            done[pattern] += times
        elif times:
            if not open_packs[fill]:
                heapq.heappush(fills, fill)
            open_packs[fill][pattern] = open_packs[fill].get(pattern, 0) + times

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while fills and not open_packs[fills[0]]:
                heapq.heappop(fills)
            if fills and fills[0] + length <= window:
                fill = fills[0]
                pattern, times = next(iter(open_packs[fill].items()))
                many = min(times, left)
                if many == times:
                    del open_packs[fill][pattern]
                else:
                    open_packs[fill][pattern] = times - many
                put((*pattern, length), many)
                left -= many
            else:
                stack = window // length
                if left >= stack:
                    put((length,) * stack, left // stack)
                if left % stack:
                    put((length,) * (left % stack), 1)
                left = 0
    for held in open_packs.values():
        for pattern, times in held.items():
            done[pattern] += times
    return sorted(done.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past rank, first sequence, offset): where the pieces of a length go, by rank."""
    out, used, base = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + times, base, offset))
            used[length] += times
            offset += length
        base += times
    return out


def ranked(pieces: DataFrame, histogram: dict[int, int], order: list[str]) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... within each ``length``, each rank once.

    Ranks are counted within hashed buckets and shifted by the sizes of the buckets before, so a length that most pieces
    have is spread over many tasks.  A length has as many buckets as its pieces need, ``BUCKETS`` at most, which is also
    what the task that adds up a length's sizes gets.
    """
    spark = pieces.sparkSession
    many = [(length, min(BUCKETS, 1 + n // BUCKET_PIECES)) for length, n in histogram.items()]
    p = pieces.join(F.broadcast(spark.createDataFrame(many, "length long, buckets long")), "length")
    p = p.withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("buckets")
    sizes = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = p.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    return inner.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def assign_sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (a written table with doc_id, start, length) with ``sequence_id`` and ``offset``.

    The slots that are broadcast number at most a few per length and are bounded by ``window``, not by the data.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, window))
    by_length = spark.createDataFrame(table, "length long, first long, past long, base long, offset long")
    by_length = by_length.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "past", "base", "offset"))).alias("slots"))
    out = ranked(pieces, histogram, ["doc_id", "start", "ids_crc32"] if "ids_crc32" in pieces.columns else ["doc_id", "start"]).join(F.broadcast(by_length), "length")
    out = out.withColumn("slot", F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["past"])), F.lit(0)))
    return out.select(*pieces.columns, (F.col("slot.base") + F.col("rank") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Model inputs from pieces packed ``with_ids``: (sequence_id, input_ids, doc_ids, n_pad), padded to ``window`` unless the length is a power of two."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("ps"))
    ids = F.flatten(F.transform("ps", lambda p: p["ids"]))
    n = F.size(ids)
    pad = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(F.lit(window) - n)
    return got.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"), F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"), pad.alias("n_pad"))


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All documents packed: one row per piece with its sequence and offset there.

    Pieces are written to the shared folder, where the result reads them.  A null doc_id is an id like any other; rows that
    share an id are packed each, and their pieces can't be told apart but by sequence and offset; texts of any length are cut
    into pieces of the window; no rows give no rows.  Other columns of ``docs`` are ignored, whatever their names; pieces of equal documents differ by
    their sequence alone.
    """
    return assign_sequences(written(token_pieces(docs, tokenizer_path, doc_id, text, window, end_id, with_ids), "pieces"), window)
