"""Line dedup by an exact set-similarity join; DataFrame functions only.

A line is its set of words.  A line goes if an earlier line (smaller doc_id, then smaller line number) of any document has a
set with Jaccard similarity of ``percent``/100 or more; whether that earlier line goes too doesn't matter.

1. Every line's words are hashed once and written, 32 bits each; the steps up to the last read these hashes, not text.
2. Lines with equal sets are one: the first of them stands for all.  Two 64-bit hashes over the sorted 64-bit hashes of all its
   words say which set a line has.
3. Words are put in one order over the corpus, rare ones first.  Let two linked sets share o words and differ in e and f, so
   that e + f <= o * (100 - percent) / percent.  Of the runs of t neighbouring shared words each word of only one set breaks at
   most t - 1, so among the first (t - 1) * (e + f) + 1 runs one is clean: its words stand side by side in both sets.  Every
   set is therefore keyed by the runs in its prefix, the first words that such a run can reach to (prefix filter).  Few sets
   share a run of rare words, so groups stay small where single words would make large ones.  Words that share a place in the
   order only make keys that more sets share.
4. Keys that one set alone has, which most are, are counted by themselves and go no further.
5. A group's sets are held against the ``BEFORE`` ones before them, and later ones against the first: sizes (length filter), the
   places of the shared run (positional filter) and parities of the words' hashes, which differ in no more bits than the sets
   do in words, bound the overlap from above.  A set that can be near none of them goes no further; the others keep the
   closest by parities, so the steps below read few rows of a group.
6. Of all that a set has kept under its keys, the closest is verified on the words themselves, then the others if need be and they
   are few.
7. Sets that are still open and had more than these meet all earlier sets of their groups in a semi-join, first by the
   same bounds, then those that it leaves on the hashes of all their words.  It stops at the first that is near: no row is made
   for a pair.

Sets without a clean run of ``RUN`` words, where ``percent`` is low, take single words, as in the plain prefix.

Rarity is counted over all lines in hashed counters, up to ``BUCKETS`` of them, one byte each, which is all that is sent to
the executors.  Any order is right, a good one is fast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import BROADCAST_BYTES, drop_written, free_name, small_side, written

#: Counters at most, and words a counter has on average before there are more of them.
BUCKETS, BUCKET_WORDS = 1 << 16, 256
#: A counter's class: four for each doubling of its count, from ``LOW`` on for a word said once; it stands before a word's hash.
CLASSES, LOW, HASH_BITS = 100, 27, 24
#: Words in a run at most.
RUN = 2
#: Sizes and places from here on are not told apart by the filters, which then let a pair pass.
WIDE = 0xFFFF
#: Passes over classes of keys, at most, and bytes of a key that several sets have: a pass takes what can be broadcast, and with
#: more keys than that it shuffles its own class alone.
PASSES, KEY_BYTES = 8, 24
#: Sets before one in its group that it is held against first, and those of them that it keeps.
BEFORE, KEPT = 32, 3
#: Sets besides the closest that a line is verified against one by one.
OTHERS = 2
#: Words up to which parities in 64 classes tell sets apart; larger ones have those of half of their words beside.
SHORT = 64
#: For tables of hashes, which hardly repeat.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def class_of(n: Column) -> Column:
    return F.least(F.floor(4 * F.log2(n.cast("double"))).cast("int") + 1, F.lit(CLASSES))


def spaced(text: Column) -> Column:
    """White space other than line ends as spaces; texts that have none are not copied."""
    others = ("\t", "\x0b", "\x0c", "\r")
    has, out = F.lit(False), text
    for c in others:
        has = has | F.contains(text, F.lit(c))
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(has, out).otherwise(text)


def word_hashes(line: Column) -> Column:
    """Sorted hashes of a line's distinct words: runs of anything but ASCII white space, as written."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))))


def words_of(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(spaced(line), " "), ""))


def all_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line of (doc_id, text)."""
    lines = F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line")
    return docs.where("doc_id is not null").select("doc_id", lines)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n, h1, h2, h array<int>) of every line: its set's size, two hashes of the set, and the words' hashes."""
    h = all_lines(docs).select("doc_id", "line_no", word_hashes(F.col("line")).alias("h"))
    return h.select("doc_id", "line_no", F.size("h").alias("n"), F.xxhash64("h").alias("h1"), F.xxhash64(F.lit(1), "h").alias("h2"), F.transform("h", lambda x: F.shiftright(x, 32).cast("int")).alias("h"))


def rarity_table(hashed: DataFrame) -> tuple[bytes, int]:
    """A byte per counter, and the number of counters (a power of two that follows the words of the corpus).

    A word counts once for each line that has it; blocks of counters are put together by Spark.
    """
    total = hashed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(BUCKETS, 1 << max(12, math.ceil(math.log2(max(total, 1) / BUCKET_WORDS))))
    counts = hashed.select(F.explode("h").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(size - 1)).alias("b")).agg(class_of(F.count(F.lit(1))).alias("c"))
    empty = hashed.sparkSession.range(size).select(F.col("id").cast("int").alias("b"), F.lit(1).alias("c"))
    each = counts.unionByName(empty).groupBy("b").agg(F.max("c").alias("c"))
    in_order = lambda rows, text: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), text), "")
    block = each.groupBy(F.expr("b div 4096").alias("k")).agg(in_order(F.struct("b", "c"), lambda s: F.char(s["c"] + LOW)).alias("s"))
    one = block.agg(in_order(F.struct("k", "s"), lambda x: x["s"]).cast("binary").alias("classes"))
    return bytes(one.first()["classes"]), size


def least_size(run: int, percent: int) -> int | None:
    """Smallest size from which two linked sets always share a clean run of ``run`` words; None if there is none in practice."""
    if (run - 1) * (100 - percent) >= percent:
        return None
    clean = lambda o: o - (run - 1) >= (run - 1) * (o * (100 - percent) // percent) + 1
    # from here on the gain of a shared word outweighs what it allows to differ
    far = -(-run * percent // (percent - (run - 1) * (100 - percent))) + 1
    bad = max((o for o in range(far + 1) if not clean(o)), default=0)
    return max(1, 100 * bad // percent + 1)


def prefix_length(n: Column, run: int, percent: int) -> Column:
    """Words at the head of a set of ``n`` that the keys are made of.

    At most ``e`` words of the set are missing from a linked one, and then e + f <= (n - e) * (100 - percent) / percent: the
    last word of the first clean run stands at place (run - 1) * (e + f + 1) + 1 + e at most.
    """
    e = F.floor(n * (100 - percent) / 100)
    return F.least(F.floor((run - 1) * ((n - e) * (100 - percent) / percent + 1) + 1 + e).cast("int"), n)


def keyed_sets(lines: DataFrame, classes: bytes, size: int, percent: int) -> list[tuple[int, DataFrame]]:
    """(run, table) with (doc_id, line, flips, flops, pre array<int>) of the sets that can have a partner of another set, written.

    ``line`` packs line number and size; ``flips`` has the parities of the words' hashes in 64 classes, ``flops`` those of the
    words with a high bit, 0 for a set of few words; ``pre`` has the places of the words in the prefix, in order.
    """
    # a set without its like in size has no partner: the next larger one holds it and one word more
    kept = lines.where(100 * F.col("n").cast("long") >= percent * (F.col("n").cast("long") + 1))
    out, above = [], None
    for run in range(RUN, 0, -1):
        least = least_size(run, percent)
        if least is None:
            continue
        # sets of this run's sizes, and those that one smaller than the longer run's least size can be linked to
        part = kept.where(F.col("n") >= least)
        part = part if above is None else part.where(percent * F.col("n").cast("long") <= 100 * (above - 1))
        out.append((run, written(_keyed(part, classes, size, run, percent), "keyed", **PLAIN)))
        above = least
        if least <= 1:
            break
    return out


def _keyed(lines: DataFrame, classes: bytes, size: int, run: int, percent: int) -> DataFrame:
    # positions count from 1, so without its first byte the table is read by counter, and counter 0 reads that of 1
    table = F.lit(classes[1:])
    class_at = lambda h: F.ascii(F.substr(table, h.bitwiseAND(F.lit(size - 1)), F.lit(1)))
    # arrays that can't hold null are sorted as plain numbers
    place = lambda h: F.coalesce(F.shiftleft(class_at(h), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 32 - HASH_BITS)), F.lit(0))
    prefix = F.slice(F.sort_array(F.transform("h", place)), F.lit(1), prefix_length(F.col("n"), run, percent)).alias("pre")
    bit = lambda h, of: F.call_function("shiftleft", of.cast("long"), h)  # noqa: E731  # by the low six bits
    parity = lambda of: F.aggregate("h", F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h, of(h))))
    flips = parity(lambda h: F.lit(1))
    flops = F.when(F.col("n") > SHORT, parity(lambda h: F.shiftrightunsigned(h, 31))).otherwise(F.lit(0).cast("long"))
    line = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.shiftleft(_narrow("n"), 16))
    return lines.select("doc_id", line.alias("line"), flips.alias("flips"), flops.alias("flops"), prefix)


def keys_of(lines: DataFrame, run: int, *columns: str) -> DataFrame:
    """(columns, pos, key): the runs of the words' places in the prefix of each set of ``lines``, hashed."""
    count = F.greatest(F.size("pre") - (run - 1), F.lit(0))
    each = lines.select(*columns, "pre", F.posexplode(F.slice("pre", F.lit(1), count)).alias("pos", "place"))
    return each.select(*columns, "pos", F.xxhash64("place", *(F.get("pre", F.col("pos") + i) for i in range(1, run)), F.lit(run)).alias("key"))


def _narrow(c: str) -> Column:
    return F.least(F.col(c), F.lit(WIDE)).cast("long")


def shared_keys(keyed: list[tuple[int, DataFrame]]) -> DataFrame:
    """(key, large) of the keys that two sets or more have, written; only keys are shuffled for it.

    ``large``: more than ``BEFORE`` + 1 sets have it.
    """
    each = reduce(DataFrame.union, (keys_of(lines, run).select("key") for run, lines in keyed))
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.where("n > 1").select("key", (F.col("n") > BEFORE + 1).alias("large")), "shared", **PLAIN)


def postings(keyed: list[tuple[int, DataFrame]], shared: DataFrame, turn: int = 0, passes: int = 1) -> DataFrame:
    """(key, doc_id, at, flips, flops) of the ``shared`` keys of one of ``passes`` classes, with the other columns of ``shared``.

    ``at`` packs line number, size and place.
    """
    own = lambda df: df.where(F.pmod(F.shiftrightunsigned("key", 40), F.lit(passes)) == turn) if passes > 1 else df
    each = (keys_of(lines, run, "doc_id", "line", "flips", "flops") for run, lines in keyed)
    each = (own(keys).select("key", "doc_id", F.col("line").bitwiseOR(_narrow("pos")).alias("at"), "flips", "flops") for keys in each)
    return reduce(DataFrame.union, each).join(small_side(own(shared), KEY_BYTES), "key")


def line_no(at: str | Column) -> Column:
    return F.shiftright(at, 32).cast("int")


def possible(one: str, other: str, percent: int) -> Column:
    """:func:`can_be_near` for two sets whose columns end in ``one`` and ``other``."""
    side = lambda i: tuple(F.col(f"{c}{i}") for c in ("at", "flips", "flops"))
    return can_be_near(side(one), side(other), percent)


def differing(one, other) -> Column:
    """Parities in which two sets (at, flips, flops) differ, in 128 classes if both have them, else in 64."""
    every, high = one[1].bitwiseXOR(other[1]), one[2].bitwiseXOR(other[2])
    halves = F.bit_count(every.bitwiseXOR(high)) + F.bit_count(high)
    return F.when((one[2] == 0) | (other[2] == 0), F.bit_count(every)).otherwise(halves)


def can_be_near(one, other, percent: int) -> Column:
    """Length, positional and parity filter for two sets (at, flips, flops).

    Sizes must be near; what can be shared is what stands before and behind the key; linked sets differ in at most
    (n + m) * (100 - percent) / (100 + percent) words, each of which flips one parity.
    """
    x, y = one[0], other[0]
    n, m = (F.shiftright(c, 16).bitwiseAND(F.lit(WIDE)) for c in (x, y))
    i, j = (c.bitwiseAND(F.lit(WIDE)) for c in (x, y))
    most = F.least(i, j) + F.least(n - i, m - j)
    sized = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differing(one, other) <= (100 - percent) * (n + m))
    return (sized & ((100 + percent) * most >= percent * (n + m))) | (n == WIDE) | (m == WIDE)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Later lines (doc_id, line_no) of those ``pairs`` (d1, l1, d2, l2) whose words are similar enough."""
    words = line_words(pairs.select("d1", "l1").union(pairs.select("d2", "l2")).distinct(), docs)
    side = lambda i: words.select(F.col("d").alias(f"d{i}"), F.col("l").alias(f"l{i}"), F.col("w").alias(f"w{i}")).hint("merge")
    both = pairs.join(side(1), ["d1", "l1"]).join(side(2), ["d2", "l2"]).withColumn("both", F.size(F.array_intersect("w1", "w2")))
    same = 100 * F.col("both") >= percent * (F.size("w1") + F.size("w2") - F.col("both"))
    out = written(both.where(same).select(F.col("d2").alias("doc_id"), F.col("l2").alias("line_no")).distinct(), "later")
    drop_written(words)
    return out


def line_words(ends: DataFrame, docs: DataFrame) -> DataFrame:
    """(d, l, w array<string>) with the words of the lines (document, line number) of ``ends``, written."""
    ends = ends.toDF("d", "l")
    need = written(ends.groupBy("d").agg(F.collect_list("l").alias("ls")), "need")
    texts = docs.join(small_side(need, 48, arrays=("ls",)), docs["doc_id"] == need["d"])
    lines = F.get(F.transform(F.array(F.split("text", "\n")), lambda x: F.transform("ls", lambda l: F.struct(l.alias("l"), F.get(x, l).alias("line")))), F.lit(0))
    words = texts.select("d", F.explode(lines).alias("x")).select("d", "x.l", words_of(F.col("x.line")).alias("w"))
    words = written(words, "words")
    drop_written(need)
    return words


def repeats(hashed: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2) of every line whose set an earlier line has as well."""
    own = hashed.select("doc_id", "line_no", "h1", "h2")
    # the first document, then its first such line: plain numbers are kept in a hash table, a struct of both would be sorted
    counted = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("fd"), F.count(F.lit(1)).alias("copies"))
    sets = written(counted.where("copies > 1").select("h1", "h2", "fd"), "repeated")
    several = written(own.join(small_side(sets, 48), ["h1", "h2"]), "several")
    first = written(several.where("doc_id = fd").groupBy("h1", "h2").agg(F.min("line_no").alias("fl")), "first")
    out = several.join(small_side(first, 48), ["h1", "h2"]).where("doc_id <> fd or line_no <> fl")
    out = written(out.select("doc_id", "line_no", "h1", "h2"), "repeats")
    for t in (sets, several, first):
        drop_written(t)
    return out


def met_sets(keyed: list[tuple[int, DataFrame]], percent: int) -> list[DataFrame]:
    """(key, doc_id, at, flips, flops, line_no, near array<struct<differ, d1, l1>>, more) of sets that can be near an earlier one of their group.

    ``near`` has those of the ``BEFORE`` sets before it, and of a later place the group's first, that it can be near to, the
    closest ``KEPT`` by parities; ``more`` says that there can be others.  A set that fits none is left out if they were all
    there are.  A table for each pass over a class of keys: the shared keys of a pass can be broadcast, or if they are too
    many, all keys at once would hold too much on disk.
    """
    shared = shared_keys(keyed)
    counts = {r["large"]: r["n"] for r in shared.groupBy("large").agg(F.count(F.lit(1)).alias("n")).collect()}
    passes = min(PASSES, 1 + counts.get(False, 0) * KEY_BYTES // BROADCAST_BYTES)
    small, large = (shared.where(c).select("key") for c in ("not large", "large"))
    out = [written(_met_in_small(postings(keyed, small, turn, passes), percent), "met") for turn in range(passes)]
    if counts.get(True):
        out.append(_met_in_large(postings(keyed, large), percent))
    drop_written(shared)
    return out


#: What is known of a set under a key.
SET = ("doc_id", "at", "flips", "flops")


def ends_of(posted: DataFrame, i: int, *more: str) -> DataFrame:
    """``posted`` with ``i`` behind the names of its columns, for joins that shuffle."""
    return posted.select(*(F.col(c).alias(f"{c}{i}") for c in ("key", *SET, *more))).hint("merge")


def meet(percent: int) -> Column:
    """The first of two sets of one group is earlier and can be near; lines of repeated ids with one line number are not earlier than each other."""
    earlier = (F.col("doc_id1") < F.col("doc_id2")) | ((F.col("doc_id1") == F.col("doc_id2")) & (line_no("at1") < line_no("at2")))
    return (F.col("key1") == F.col("key2")) & earlier & possible("1", "2", percent)


def closeness() -> Column:
    this, other = (tuple(F.col(f"{c}{i}") for c in SET[1:]) for i in "21")
    return F.struct(differing(this, other).alias("differ"), F.col("doc_id1").alias("d1"), line_no("at1").alias("l1"))


def _met_in_small(posted: DataFrame, percent: int) -> DataFrame:
    """:func:`met_sets` of groups of up to ``BEFORE`` + 1 sets: each set meets all earlier ones in a join."""
    pairs = ends_of(posted, 2).join(ends_of(posted, 1), meet(percent))
    met = pairs.groupBy("key2", *(f"{c}2" for c in SET)).agg(F.sort_array(F.collect_list(closeness())).alias("near")).toDF("key", *SET, "near")
    return met.select("key", *SET, line_no("at").alias("line_no"), F.slice("near", 1, KEPT).alias("near"), (F.size("near") > KEPT).alias("more"))


def _met_in_large(posted: DataFrame, percent: int) -> DataFrame:
    """:func:`met_sets` of larger groups, written: each set meets the ``BEFORE`` ones before it, later ones also the first.

    Sets meet in blocks of ``BEFORE`` places, each with its own and the one before, so a group's work is spread over tasks.
    """
    group = Window.partitionBy("key").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = posted.select("key", *SET, F.row_number().over(group).alias("place"), F.first(F.struct(*SET)).over(group).alias("first"))
    placed = written(placed.withColumn("block", F.expr(f"place div {BEFORE}")), "placed")
    one = ends_of(placed, 1, "place", "block").withColumn("block1", F.explode(F.array(F.col("block1"), F.col("block1") + 1)))
    two = ends_of(placed, 2, "place", "block")
    beside = (F.col("block1") == F.col("block2")) & (F.col("place2") - F.col("place1")).between(1, BEFORE)
    near = two.join(one, beside & meet(percent)).select("key2", *(f"{c}2" for c in SET), "place2", closeness().alias("near"))
    late = ends_of(placed.where(F.col("place") > BEFORE + 1), 2, "place", "first")
    late = late.select("*", F.col("key2").alias("key1"), *(F.col("first2")[c].alias(f"{c}1") for c in SET))
    late = late.select("key2", *(f"{c}2" for c in SET), "place2", F.when(meet(percent), closeness()).alias("near"))
    met = near.union(late).toDF("key", *SET, "place", "near").groupBy("key", *SET, "place").agg(F.sort_array(F.collect_list("near")).alias("near"))
    more = (F.size("near") > KEPT) | (F.col("place") > BEFORE + 1)
    out = written(met.select("key", *SET, line_no("at").alias("line_no"), F.slice("near", 1, KEPT).alias("near"), more.alias("more")), "met")
    drop_written(placed)
    return out


def near_lines(met: DataFrame, keyed: list[tuple[int, DataFrame]], docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line_no) of the lines, first of their set, that an earlier line's other set is near to."""
    fits = met.where(F.size("near") > 0).groupBy(F.col("doc_id").alias("d2"), F.col("line_no").alias("l2"))
    # two columns of one row, as both are chosen alike; a struct could not be kept in a hash table
    closest = F.get("near", F.lit(0))
    best = written(fits.agg(*(F.min_by(closest[c], closest["differ"]).alias(c) for c in ("d1", "l1"))).select("d1", "l1", "d2", "l2"), "closest")
    settled = verified(best, docs, percent)

    # a line that its closest one did not settle meets the others that it has with it, each once whatever keys they share, if they are few
    still = written(without(met, settled), "open")
    rest = still.select(F.explode("near").alias("p"), F.col("doc_id").alias("d2"), F.col("line_no").alias("l2")).select("p.d1", "p.l1", "d2", "l2").distinct()
    rest = rest.join(small_side(best, 48), ["d1", "l1", "d2", "l2"], "left_anti").groupBy("d2", "l2").agg(F.collect_list(F.struct("d1", "l1")).alias("ps"))
    rest = written(rest, "rest")
    others = verified(rest.where(F.size("ps") <= OTHERS).select(F.explode("ps").alias("p"), "d2", "l2").select("p.*", "d2", "l2"), docs, percent)

    # what is still open and has more than these meets all earlier sets of its groups; the first found that is near is enough
    many = rest.where(F.size("ps") > OTHERS).select(F.col("d2").alias("doc_id"), F.col("l2").alias("line_no"), F.lit(True).alias("many"))
    last = without(still, others).join(small_side(many, 32), ["doc_id", "line_no"], "left").where("more or many")
    last = written(last.select("key", *SET, "line_no"), "last")
    found = [settled, others]
    if not last.isEmpty():
        found.append(_met_again(last, keyed, docs, percent))
    out = written(reduce(DataFrame.union, found).distinct(), "near")
    for t in (best, still, rest, last, *found):
        drop_written(t)
    return out


def without(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` of other lines than ``lines`` (doc_id, line_no)."""
    return rows.join(small_side(lines, 32), ["doc_id", "line_no"], "left_anti").select(*rows.columns)


def _met_again(still: DataFrame, keyed: list[tuple[int, DataFrame]], docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line_no) of those lines of ``still`` (key, doc_id, at, flips, flops, line_no) that an earlier set of their groups is near to."""
    keys = written(still.select("key").distinct(), "keys")
    beside = written(postings(keyed, keys).select("key", *SET, line_no("at").alias("line_no")), "beside")
    # most can be near none of those either, so that words are fetched for few
    can = ends_of(still, 2, "line_no").join(ends_of(beside, 1, "line_no"), meet(percent), "left_semi")
    can = written(can.select(*(F.col(f"{c}2").alias(c) for c in ("key", *SET, "line_no"))), "can")
    can_keys = written(can.select("key").distinct(), "keys")
    near_by = written(beside.join(small_side(can_keys, KEY_BYTES), "key", "left_semi"), "beside")
    words = line_words(can.select("doc_id", "line_no").union(near_by.select("doc_id", "line_no")).distinct(), docs)
    hashes = written(words.select(F.col("d").alias("doc_id"), F.col("l").alias("line_no"), F.transform("w", lambda w: F.xxhash64(w)).alias("w")), "hashes")
    one, two = (ends_of(df.join(hashes.hint("merge"), ["doc_id", "line_no"]), i, "line_no", "w") for df, i in ((near_by, 1), (can, 2)))
    both = F.size(F.array_intersect("w1", "w2"))
    again = two.join(one, meet(percent) & (100 * both >= percent * (F.size("w1") + F.size("w2") - both)), "left_semi")
    again = written(again.select(F.col("doc_id2").alias("doc_id"), F.col("line_no2").alias("line_no")).distinct(), "again")
    for t in (keys, beside, can, can_keys, near_by, words, hashes):
        drop_written(t)
    return again


def later_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, gone array<int>): the lines to remove from each document of (doc_id, text); documents without any are left out."""
    # hashes hardly repeat within a page, so neither a dictionary nor compression would pay
    every = written(hashed_lines(docs), "hashed", **PLAIN)
    hashed = every.where("n > 0")
    copies = repeats(hashed)
    classes, size = rarity_table(hashed)
    once = hashed.join(small_side(copies, 56), ["doc_id", "line_no", "h1", "h2"], "left_anti")
    keyed = keyed_sets(once, classes, size, percent)
    drop_written(every)
    met = met_sets(keyed, percent)
    near = near_lines(reduce(DataFrame.union, met), keyed, docs, percent)
    for t in (*met, *(t for _, t in keyed)):
        drop_written(t)
    gone = copies.select("doc_id", "line_no").union(near)
    out = written(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("gone")), "gone")
    drop_written(copies)
    drop_written(near)
    return out


def dedup_lines(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later lines taken out of ``text``, and ``n_removed``; other columns stay as they are.

    Lines end at ``\\n``.  Lines without words stay.  Null text stays null, an empty one empty; rows with a null doc_id stay
    and take no part; of rows that share a doc_id none is earlier than the other, and a line number removed in one is removed
    in all; no rows give no rows; if ``n_removed`` is taken as a name, it gets underscores in front (it is the last column).
    ``percent`` is 1 to 100.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    gone = later_lines(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), percent)
    key, drop, name = free_name(docs, "_key"), free_name(docs, "_gone"), free_name(docs, "n_removed")
    side = gone.select(F.col("doc_id").alias(key), F.col("gone").alias(drop))
    out = docs.join(small_side(side, 48, arrays=(drop,)), docs[doc_id].cast("long") == side[key], "left")
    parts = F.split(F.col(text).cast("string"), "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains(F.col(drop), i), x)), lambda x: x.isNotNull())
    new = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(drop).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(kept))
    return out.withColumn(name, n.cast("long")).withColumn(text, new).select(*docs.columns, name)
