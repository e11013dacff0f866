"""Prefix trie of conversations, and what sharing prefixes would save: pointer-jumping rollup.

1. :func:`numbered_turns` gives each turn its place; a conversation may span many tasks.
2. :func:`prefix_nodes` keys the first d turns of a conversation by a digest that adds up over turns, and groups equal
   prefixes to nodes with the digest of their parent.
3. :func:`roll_up` adds leaves and savings up to all ancestors: in round k each node hands its sum to the ancestor 2^k above
   it and then points twice as far, so rounds follow the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import drop_written, parts_for, written

#: Turns of a conversation whose digests one task adds up in a row, and conversation ids of which one string is made.
BLOCK, CHUNK = 1024, 8192
_ROW_BITS = 33  # monotonically_increasing_id counts rows below this bit and partitions above it


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, h1, h2, n_bytes) of every turn, written: place 1, 2, ... by turn (null first), role and text.

    Turns are sorted by range, so one conversation may lie in several partitions; a turn's place is its row in the partition
    plus the conversation's rows in earlier ones.  ``h1`` and ``h2`` are two hashes of role and text, ``n_bytes`` is the
    text's UTF-8 length.  Null role or text is empty; rows without a conv_id belong to no conversation and are left out.
    """
    spark = turns.sparkSession
    t = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    t = t.where("conv_id IS NOT NULL")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    said = [F.octet_length("role"), F.col("role"), F.col("text")]
    t = t.repartitionByRange(parts_for(spark), *order).sortWithinPartitions(*order)
    t = written(t.select("conv_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2"), F.octet_length("text").cast("long").alias("n_bytes")), "turns")
    t = t.withColumn("part", F.shiftright("row", _ROW_BITS))
    runs = t.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = runs.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).drop("n")
    return written(t.join(before, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("first") + F.col("before") + 1).alias("place"), "h1", "h2", "n_bytes"), "places")


def with_prefix(places: DataFrame, base: Column, n_base: Column) -> DataFrame:
    """Conversations rebuilt from numbered ``places``: the first ``n_base`` turns of conversation ``base``, then a conversation's own after its first ``n_base``.

    Both columns are over ``conv_id``.  A base that is not there gives no turns, a shorter one all it has.
    """
    convs = places.groupBy("conv_id").agg(F.max("place").alias("own")).select("conv_id", "own", base.alias("base"), n_base.cast("long").alias("most"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    plan = convs.join(sizes, "base", "left").select("conv_id", "base", "most", F.least("most", F.coalesce("has", F.lit(0))).alias("taken"))
    turns = ["h1", "h2", "n_bytes"]
    most = plan.agg(F.max("taken")).first()[0] or 0
    first = plan.join(places.where(F.col("place") <= most).withColumnRenamed("conv_id", "base"), "base").where("place <= taken").select("conv_id", "place", *turns)
    own = places.join(plan, "conv_id").where("place > most").select("conv_id", (F.col("place") - F.col("most") + F.col("taken")).alias("place"), *turns)
    return first.unionByName(own)


def _salted(places: DataFrame) -> DataFrame:
    return places.select(
        "conv_id", "place", "n_bytes", F.xxhash64(F.lit(1), "place", "h1", "h2").alias("s1"), F.xxhash64(F.lit(2), "place", "h2", "h1").alias("s2"),
        F.expr(f"(place - 1) div {BLOCK}").alias("block"),
    )


def prefix_nodes(places: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, depth, p1, p2, conv_id, n_convs, own_tokens) of every distinct prefix of the numbered ``places`` of ``convs`` (conv_id).

    A prefix's key is the exclusive or of its turns' hashes salted by their places, twice 64 bits; so it is added up within
    blocks of ``BLOCK`` places and then over blocks, and no task walks through a long conversation.  The key of a prefix one
    turn shorter is its parent's; the root has key 0, 0.
    """
    salted = _salted(places)
    inner = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    runs = salted.withColumns({k: F.bit_xor(s).over(inner) for k, s in (("k1", "s1"), ("k2", "s2"))})
    later = salted.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("b1"), F.bit_xor("s2").alias("b2"))
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = later.withColumns({b: F.coalesce(F.bit_xor(b).over(outer), F.lit(0)) for b in ("b1", "b2")}).where("block > 0")
    keyed = runs.join(before, ["conv_id", "block"], "left")
    keyed = keyed.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(b, F.lit(0))) for k, b in (("k1", "b1"), ("k2", "b2"))})
    keyed = keyed.select("k1", "k2", F.col("place").alias("depth"), F.col("k1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("s2")).alias("p2"), "conv_id", "n_bytes")
    zero = F.lit(0).cast("long")
    root = convs.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "conv_id", zero.alias("n_bytes"))
    return keyed.unionByName(root).groupBy("k1", "k2", "depth").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), ((F.count(F.lit(1)) - 1) * F.min("n_bytes")).alias("own_tokens")
    )


def roll_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id, ...) with each of ``sums`` added up over the node's whole subtree.

    A node is known by its smallest member and its depth.  Before round k a node's sums hold what lies less than 2^k below it
    and ``up`` is its ancestor 2^k above; both double.  Each round adds up by ancestor before it shuffles, and is a written
    table, so that a lost executor costs one round at most.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, step, mine = nodes.withColumnRenamed("parent_conv_id", "up"), 1, None
    while step <= deepest:
        reach = now.where("up IS NOT NULL")
        more = reach.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(*(F.sum(s).alias(f"_{s}") for s in sums))
        grown = now.join(more, ["conv_id", "depth"], "left")
        grown = grown.select("conv_id", "depth", "up", *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums))
        above = now.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        now = written(grown.join(above, ["up", "depth"], "left").select("conv_id", "depth", F.col("next").alias("up"), *sums), "rollup")
        if mine is not None:
            drop_written(mine)
        mine, step = now, 2 * step
    return nodes.drop(*sums).join(now.select("conv_id", "depth", *sums), ["conv_id", "depth"])


def ends_digests(places: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the prefixes at which conversations of ``convs`` end: of their ids, ascending, joined by commas.

    Ids are joined to strings by ranges of ``CHUNK`` ids; a prefix with one range is hashed by Spark, one with more streams
    its strings, already joined, through one task in order, which holds one string at a time.
    """
    whole = _salted(places).groupBy("conv_id").agg(F.bit_xor("s1").alias("k1"), F.bit_xor("s2").alias("k2"), F.max("place").alias("depth"))
    key = ["k1", "k2", "depth"]
    ends = convs.join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in key))
    parts = ends.groupBy(*key, F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("part"))
    parts = written(parts.withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy(*key))), "ends")

    def stream(batches):
        import hashlib

        import pyarrow as pa

        now, sha = None, None
        for batch in batches:
            done = []
            for *k, _, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(part.encode())
                else:
                    sha.update(f",{part}".encode())
            yield rows(pa, done)
        if now is not None:
            yield rows(pa, [(*now, sha.hexdigest())])

    def rows(pa, done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64() if i < 3 else pa.string()) for i in range(4)], names=[*key, "ends_sha256"])

    one = parts.where("chunks = 1").select(*key, F.sha2("part", 256).alias("ends_sha256"))
    many = parts.where("chunks > 1").select(*key, "chunk", "part").repartition(*key).sortWithinPartitions(*key, "chunk")
    return one.unionByName(many.mapInArrow(stream, "k1 long, k2 long, depth long, ends_sha256 string"))


def trie(places: DataFrame, convs: DataFrame) -> DataFrame:
    """The prefix trie of numbered ``places`` (conv_id, place, h1, h2, n_bytes) over all of ``convs`` (conv_id, each once).

    Returns per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  A conversation of ``convs`` without places ends at the root; equal conversations end at one
    node; without conversations there is no node.
    """
    key = ["k1", "k2", "depth"]
    nodes = written(prefix_nodes(places, convs), "prefixes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0).cast("long"))
    tree = nodes.join(kids, key, "left").join(parents, ["p1", "p2", "depth"], "left").select(
        *key, "conv_id", "parent_conv_id", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("n_leaves"), F.col("own_tokens").alias("saved_tokens")
    )
    tree = roll_up(written(tree, "tree"), ["n_leaves", "saved_tokens"]).join(ends_digests(places, convs), key, "left")
    return tree.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
