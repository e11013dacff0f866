"""Spelling variants: words one edit apart, found by merging the trie of all words along its heavy paths.

At each node of the trie the child with most words below it is heavy, all other branches (an ending word too) are light; a
word leaves heavy paths at most log2(words) times.  Only light branches are merged, small into large, with one character
replaced or skipped:

* replaced: the character after the node becomes the heavy child's.  The branch then lies on the heavy path, and where its
  words coincide there, with the heavy child's or with each other, they differ by that one character;
* skipped: the character is left out, so the branch coincides with words that go on at the node without it; and the heavy
  child's character is put before the branch, which is the same skip on the heavy side.

So every pair one edit apart is found at exactly one node, whichever of its words is on the lighter side.  A run of one
character can be shortened anywhere with the same result; its last character alone is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import drop_written, least_frequent_of, text_batches, written

#: Nodes that are broadcast, those with most words below: 16 bytes each.
HOT_NODES = 500_000
#: Bytes of words that one Arrow batch carries back as nodes.
SLICE_CHARS = 500_000


def trie_edges(words: DataFrame) -> DataFrame:
    """(id, at, node, next) of ``words`` (id, word): at each place the prefix before it, hashed, and the character that follows, as its code point and 1, or 0 at the end.

    The hash of a prefix adds up over characters salted by their places, so time is linear in a word's length.  Prefixes that
    shared a hash would be one node, which only costs work: pairs are right for any one choice of a heavy child per node.
    """

    def edges(batches):
        import numpy as np
        import pyarrow as pa

        def mixed(x):
            with np.errstate(over="ignore"):
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        def out(ids, words):
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
            starts = np.cumsum(sizes) - sizes
            chars = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
            at = np.arange(len(chars), dtype=np.int64) - np.repeat(starts, sizes)
            steps = mixed((chars << np.uint64(32)) + at.astype(np.uint64) + np.uint64(1))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(steps, dtype=np.uint64)])[:-1]
            node = mixed(sums - np.repeat(sums[starts], sizes)).view(np.int64)
            cols = [np.repeat(np.array(ids, dtype=np.int64), sizes), at.astype(np.int32), node, (chars.astype(np.int64) + 1 - (at + 1 == np.repeat(sizes, sizes))).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "at", "node", "next"])

        for batch in batches:
            ids, words, n = [], [], 0
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                words.append(word)
                n += len(word)
                if n >= SLICE_CHARS:
                    yield out(ids, words)
                    ids, words, n = [], [], 0
            if ids:
                yield out(ids, words)

    text_batches(words.sparkSession)
    return words.select("id", "word").mapInArrow(edges, "id long, at int, node long, next int")


def light_branches(words: DataFrame, hot_nodes: int = HOT_NODES) -> DataFrame:
    """(id, at, next, heavy), characters as in :func:`trie_edges`: where each of ``words`` (id, word) leaves a heavy path, and the heavy child there.

    Of children with equally many words the one with the smallest character is heavy.  Nodes that most words pass are
    broadcast; each of the others has few words, and meets them in a shuffled join.
    """
    edges = trie_edges(words)
    children = edges.groupBy("node", "next").agg(F.count(F.lit(1)).alias("n"))
    heavy = F.max(F.when(F.col("next") > 0, F.struct("n", (-F.col("next")).alias("next")))).alias("heavy")
    nodes = children.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("branches"), heavy).where("branches > 1")
    nodes = written(nodes.select("node", "n", (-F.col("heavy.next")).alias("heavy")), "nodes")
    hot = F.col("n") >= least_frequent_of(nodes, "n", hot_nodes)
    seen = edges.join(F.broadcast(nodes.where(hot).select("node", "heavy")), "node", "left")
    seldom = seen.where("heavy IS NULL").drop("heavy").join(nodes.where(~hot).select("node", "heavy"), "node")
    return seen.where("heavy IS NOT NULL").unionByName(seldom).where("next <> heavy").select("id", "at", "next", "heavy")


def near_words(words: DataFrame, hot_nodes: int = HOT_NODES) -> DataFrame:
    """(word, n_near, best struct<minus long, word string>) of ``words`` (id, word, n) with a word one edit away.

    ``best`` is the near word of largest n, of equal ones the smallest.  Branches that coincide are grouped, and each of a
    group's words gets the group's size and best: pairs are not listed.  A group has no more words than there are
    characters, since its words differ at one place.
    """
    branches = light_branches(words, hot_nodes).groupBy("id").agg(F.collect_list(F.struct("at", "next", "heavy")).alias("branches"))
    b = branches.join(words, "id").select("word", "n", F.explode("branches").alias("b")).select("word", "n", "b.*")
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c - 1), 8, "0")), "UTF-32")
    head, tail = F.substring("word", 1, F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))
    b = b.select("word", "n", "at", "next", head.alias("head"), tail.alias("tail"), char(F.col("heavy")).alias("heavy"), F.when(F.col("next") > 0, char(F.col("next"))).otherwise("").alias("own"))
    b = written(b, "branches")
    me = F.struct((-F.col("n")).alias("minus"), "word")
    replaced = b.where("next > 0").select("word", "n", "at", F.concat("head", "heavy", "tail").alias("target"))
    skipped = b.where("next > 0 AND NOT startswith(tail, own)").select("word", "n", F.concat("head", "tail").alias("target"))
    put = b.select("word", "n", F.concat("head", "heavy", "own", "tail").alias("target"))
    # a branch's word, merged, is a word: each is near the other
    merged = replaced.drop("at").unionByName(skipped).unionByName(put).withColumnRenamed("n", "n_own")
    met = merged.join(words.select(F.col("word").alias("target"), "n"), "target")
    pair = F.array(
        F.struct("word", F.struct((-F.col("n")).alias("minus"), F.col("target").alias("word")).alias("best")),
        F.struct(F.col("target").alias("word"), F.struct((-F.col("n_own")).alias("minus"), F.col("word")).alias("best")),
    )
    direct = met.select(F.explode(pair).alias("p")).select("p.word", F.lit(1).cast("long").alias("n_near"), "p.best")
    # light branches that coincide with each other
    groups = replaced.groupBy("target", "at").agg(F.array_sort(F.collect_list(me)).alias("ms")).where(F.size("ms") > 1)
    among = groups.select(F.explode(F.transform("ms", lambda m, i: F.struct(m["word"].alias("word"), (F.size("ms") - 1).cast("long").alias("n_near"), F.get("ms", F.when(i == 0, 1).otherwise(0)).alias("best")))).alias("p"))
    return direct.unionByName(among.select("p.*")).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 5, hot_nodes: int = HOT_NODES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word string, n long).

    A word's form is its near word of largest n, if that is at least ``ratio`` (2 or more) times its own; its root is where
    its forms lead.  Rows of one word are added up, a null n is 0, a null word is none; an empty word is a word; no rows give
    no rows.  Other columns are ignored, whatever their names.  The words are written to the shared folder, where the result
    reads them.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead somewhere")
    w = words.where("word IS NOT NULL").groupBy(F.col("word").cast("string").alias("word")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    w = written(w.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(w, hot_nodes)
    form_n = -F.col("best.minus")
    is_form = form_n >= ratio * F.greatest(F.col("n"), F.lit(1))
    out = w.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    out = written(out, "forms")
    return out.join(roots(out, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, n, form) with a form, by pointers that double their reach each round.

    Each form has at least ``ratio`` times the word's n, so a chain has at most log(largest n) steps and the rounds are known.
    """
    now = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top, reach, mine = forms.agg(F.max("n")).first()[0] or 0, 1, None
    while ratio**reach <= top:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        if mine is not None:
            drop_written(mine)
        mine, reach = now, 2 * reach
    return now
