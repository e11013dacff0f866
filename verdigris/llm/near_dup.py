"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, exact sorted-array intersection.

Two texts link when the Jaccard similarity of their sets of word n-grams is at least ``percent``/100.

* Texts with the same set are one node from the start.
* Sizes fall into bands.  A linked pair whose larger set is in a band differs in at most ``d`` n-grams, known from the band's
  sizes, so if n-grams are dealt by hash into more than ``d`` cells, some cell is equal on both sides.  A tile is (band, cell,
  hash of the cell's n-grams); a set has tiles of its own band and of every band that a larger linked set can be in.  Every
  linked pair meets in a tile, unrelated texts hardly ever do, unless a cell holds nothing but n-grams that many texts have.
* Bands have cells to spare: a set with ``s`` more of them than it and a linked one can differ in, and one, shares ``s + 1`` equal
  cells or more with each linked one.  It therefore leaves its ``s`` most common tiles of the band, in one order over the corpus:
  of a pair's equal cells the least common has ``s`` others before it on either side, so it stays on both (prefix filter).  Empty
  cells come first in that order.
* In a round, a text meets one anchor of its tiles; a pair goes on only if the bitmaps of their hashed n-grams allow it.  A bit
  is the parity of the n-grams that hash to it, so two bitmaps differ in no more bits than the sets do in n-grams: the count of
  differing bits bounds the overlap from above, and does not saturate as the set grows.  A bitmap has bits in proportion to
  what linked sets of its size can differ in; of two, the longer is folded to the shorter one's length.
* What is left is settled by the exact intersection of the two sorted arrays, for all texts that meet an anchor in one go.
* After each round, tiles whose members are all connected are done.  In the last round, members outside a tile's largest
  component meet all its members across components, block by block, so every link between different components is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import components, drop_written, free_name, small_side, text_batches, text_slices, written

#: Bands' sizes grow by this factor.
BAND = 1.25
#: Spare cells of a band: so many, and one for every so many n-grams that its linked pairs can differ in.
SPARE, SPARE_EACH = 2, 8
#: A tile's slot packs the number of its band among the set's and, below, the tiles that the set leaves in that band.
SLOT_BITS = 16
#: Bits of a bitmap for each n-gram that a linked set of the same size can differ in, up to a power of two, and bits at least: few
#: n-grams then share a bit, so near copies just below the limit are told apart before their texts meet.
SPREAD, LEAST_BITS = 16, 64
#: Rounds of anchors before blocks of tiles meet, members of a block, and texts that meet one copy of an anchor's text.
ROUNDS, BLOCK, SHARE = 2, 512, 64
#: Bits by which the count of a tile is told from others, beyond those that number the tiles.
KEY_BITS = 8
SLICE_BYTES = 4_000_000


def band_starts(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def cells_of(band: int, percent: int) -> int:
    """Cells of a band's tiles: more than its linked pairs can differ in, and some to spare."""
    top = band_starts()[band + 1] - 1
    d = 2 * top * (100 - percent) // (100 + percent)
    return d + 1 + (SPARE + d // SPARE_EACH if d else 0)


def shingle_sets(part, n: int):
    """For an Arrow string array: a sorted array of distinct 64-bit n-gram hashes per text.

    Words are runs of anything but ASCII white space, A-Z lowered; with fewer than ``n`` words the whole sequence is the one
    n-gram, without words there is none.
    """
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
    import pyarrow as pa

    offsets = np.frombuffer(part.buffers()[1], dtype=np.int32)[part.offset : part.offset + len(part) + 1]
    raw = part.buffers()[2]
    data = raw.to_pybytes()[offsets[0] : offsets[-1]].translate(table) if raw is not None else b""
    low = pa.Array.from_buffers(pa.string(), len(part), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(data)])
    lists = pc.split_pattern(low, " ")
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    digest = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in names), dtype=np.uint64, count=len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    blank = names.index("") if "" in names else -1
    keep = codes != blank
    rows, h = rows[keep], digest[codes[keep]]
    counts = np.bincount(rows, minlength=len(part))
    mul = np.uint64(0x9E3779B97F4A7C15)

    def mix(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    run = h.copy()
    for i in range(1, n):
        run[: len(h) - i] = mix(run[: len(h) - i] * mul + h[i:]) if len(h) > i else run[: len(h) - i]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(h))  # words from here to the text's end
    whole = left >= n
    out = []
    grams, owner = run[whole], rows[whole]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    cut = np.searchsorted(owner, np.arange(len(part) + 1))
    for i in range(len(part)):
        if counts[i] >= n or not counts[i]:
            out.append(grams[cut[i] : cut[i + 1]])
        else:
            words = h[ends[i] - counts[i] : ends[i]]
            out.append(np.array([xxhash.xxh64_intdigest(words.tobytes(), seed=int(counts[i]))], dtype=np.uint64))
    return out


def tile_keys(grams, percent: int, starts: list[int]):
    """64-bit tile hashes of one sorted set: of its own band, and of every band that a linked larger set can be in."""
    return slotted_tiles(grams, percent, starts)[0]


def slotted_tiles(grams, percent: int, starts: list[int]):
    """:func:`tile_keys`, and the slot of each: the band's number and how many of its tiles the set can leave."""
    import numpy as np

    size = len(grams)
    band = int(np.searchsorted(starts, size, side="right")) - 1
    spread = (grams ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    high = spread >> np.uint64(32)
    spread = (spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    spread ^= spread >> np.uint64(32)
    out, slots = [], []
    b = band
    while b == band or size * 100 >= percent * starts[b]:
        # what a linked pair of this very size can differ in leaves more to spare than what the band's largest can
        cells, top = cells_of(b, percent), min(starts[b + 1] - 1, size * 100 // percent)
        spare = cells - 1 - (size + top) * (100 - percent) // (100 + percent)
        cell = (high * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        own, at = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(spread[order], at)
        left = spare - (cells - len(own))
        if left < 0:  # more empty cells than can be left: the others stand for themselves
            empty = np.setdiff1d(np.arange(cells), own)[spare:]
            own, sums = np.concatenate([own, empty]), np.concatenate([sums, np.zeros(len(empty), dtype=np.uint64)])
        key = (sums + own.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) ^ np.uint64((b + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(key ^ (key >> np.uint64(30)))
        slots.append(np.full(len(key), (b - band) << SLOT_BITS | min(max(left, 0), (1 << SLOT_BITS) - 1), dtype=np.int32))
        b += 1
    return np.concatenate(out).view(np.int64), np.concatenate(slots)


def bitmap(grams, percent: int):
    """Parities of the n-grams by hash, as many as a power of two that leaves unlike sets apart."""
    import numpy as np

    need = SPREAD * 2 * len(grams) * (100 - percent) // (100 + percent)
    size = max(LEAST_BITS, 1 << max(0, need - 1).bit_length())
    bits = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list, words: int):
    """Bitmaps of any lengths as rows of ``words`` 64-bit words: halves of a longer one are added up by parity."""
    import numpy as np

    out = np.zeros((len(maps), words), dtype=np.uint64)
    sizes = np.fromiter(map(len, maps), dtype=np.int64, count=len(maps)) // 8
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([maps[i] for i in at]), dtype=np.uint64).reshape(len(at), size)
        while rows.shape[1] > words:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(row_id, n_shingles, set_hi, set_lo, tiles array<struct<tile, slot>>, bits) per row of (row_id, text)."""
    schema = "row_id long, n_shingles long, set_hi long, set_lo long, tiles array<struct<tile:long,slot:int>>, bits binary"

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        starts = band_starts()
        for batch in batches:
            for at, part in text_slices(pc.fill_null(batch.column(1), ""), SLICE_BYTES):
                sets = shingle_sets(part, n)
                marks = [xxhash.xxh128_digest(g.tobytes()) for g in sets]
                none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
                tiles, slots = zip(*(slotted_tiles(g, percent, starts) if len(g) else none for g in sets), strict=True)
                each = pa.StructArray.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(slots))], names=["tile", "slot"])
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tiles])]), pa.int32()), each)
                hi, lo = (np.frombuffer(b"".join(m[i : i + 8] for m in marks), dtype="<i8") for i in (0, 8))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([len(g) for g in sets], pa.int64()), pa.array(hi), pa.array(lo), flat, pa.array([bitmap(g, percent) for g in sets], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(sign, schema)


def _possible(p, q, n, m, percent: int):
    """Whether sets of ``n`` and ``m`` with bitmaps ``p`` and ``q`` can link: each differing bit is an n-gram that one set lacks."""
    import numpy as np

    differ = np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def _allowed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (a, b, na, nb, ba, bb) whose sizes and bitmaps allow a link."""

    def sift(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            words = np.array([min(len(p), len(q)) // 8 for p, q in zip(x, y, strict=True)], dtype=np.int64)
            keep = np.zeros(len(n), dtype=bool)
            for size in np.unique(words):
                at = np.flatnonzero(words == size)
                p, q = (folded([v[i] for i in at], int(size)) for v in (x, y))
                keep[at] = _possible(p, q, n[at], m[at], percent)
            yield batch.filter(pa.array(keep)).select([0, 1])

    sized = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(sift, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by exact intersection of the two texts' sorted n-grams.

    The texts that meet one ``a`` travel to it once each, in parts of about ``SHARE``; a part has one copy of that text and
    is streamed, so that only the set of ``a`` is held.
    """

    def exact(batches):
        import numpy as np
        import pyarrow as pa

        now, heads = None, []
        for batch in batches:
            a, part, b = (batch.column(i) for i in (0, 1, 2))
            where, other = list(zip(a.to_pylist(), part.to_pylist(), strict=True)), b.to_pylist()
            out_a, out_b = [], []
            for at, piece in text_slices(batch.column(3), SLICE_BYTES):
                for i, grams in enumerate(shingle_sets(piece, n), at):
                    if where[i] != now:
                        now, heads = where[i], []
                    if other[i] is None:
                        heads.append(grams)
                        continue
                    for h in heads:
                        both = len(np.intersect1d(h, grams, assume_unique=True))
                        if 100 * both >= percent * (len(h) + len(grams) - both):
                            out_a.append(now[0])
                            out_b.append(other[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts"))
    dealt = written(pairs.join(small_side(many, 24), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "dealt")
    rows = texts.where("text is not null").select("row_id", "text")
    heads = small_side(written(dealt.select("a", "part").distinct(), "heads"), 24)
    left = rows.join(heads, F.col("row_id") == F.col("a")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    right = rows.join(small_side(dealt, 32), F.col("row_id") == F.col("b")).select("a", "part", "b", "text")
    met = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = written(met.mapInArrow(exact, "a long, b long"), "links")
    drop_written(dealt)
    drop_written(heads)
    return out


def link_components(docs: DataFrame, n: int = 5, percent: int = 80, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, n_shingles, component_id) of every row: the smallest id reachable by links, itself included.

    ``percent`` is 1 to 100; the lower, the more bands a set has tiles in.  ``row_id`` should be unique; rows that share one
    are told apart by their sets, and the id stands for all of them.  A null id takes part in nothing and keeps a null
    component; null and empty texts have no n-gram and link with nothing; no rows give no rows; other columns don't matter.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
    signed = written(signatures(rows, n, percent), "signed")
    # equal sets are one node, named by its smallest id
    with_sets = signed.where("n_shingles > 0 and row_id is not null")
    sets = written(with_sets.groupBy("set_hi", "set_lo").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies")), "sets")
    copied = sets.where("copies > 1").select("set_hi", "set_lo", "node")
    nodes = with_sets.join(small_side(copied, 48), ["set_hi", "set_lo"], "left").where("node is null or node = row_id")
    if not signed.groupBy("row_id").count().where("count > 1").isEmpty():
        nodes = nodes.dropDuplicates(["row_id", "set_hi", "set_lo"])
    nodes = nodes.select("row_id", F.col("n_shingles").alias("n"), "bits", "tiles")
    # only tiles with two texts or more go on; counts are summed where tiles are read, so a tile of very many is no load.  They
    # are counted by as many of a tile's bits as let one in 256 share a count, few bytes to shuffle: such a tile goes on
    # needlessly, and common ones are told by any one order that all texts share
    bits = min(64, int(nodes.agg(F.coalesce(F.sum(F.size("tiles")), F.lit(0))).first()[0]).bit_length() + KEY_BITS)
    tiles = nodes.select("row_id", F.explode("tiles").alias("t")).select("row_id", "t.tile", "t.slot", F.shiftrightunsigned("t.tile", 64 - bits).alias("key"))
    many = written(tiles.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "many")
    # of a band's tiles a text leaves as many of the most common ones as its slot says
    common = Window.partitionBy("row_id", "slot").orderBy(F.desc("members"), "tile")
    ranked = tiles.join(small_side(many, 32), "key").withColumn("rank", F.row_number().over(common))
    every = written(ranked.where(F.col("rank") > F.col("slot").bitwiseAND((1 << SLOT_BITS) - 1)).select("row_id", "tile"), "tiles")
    # of tiles with the same members, known by their number and 128 bits over them, one says it all
    marks = (F.bit_xor(F.xxhash64("row_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row_id")).alias("y"))
    kinds = every.groupBy("tile").agg(F.count(F.lit(1)).alias("members"), *marks).where("members > 1").groupBy("members", "x", "y").agg(F.min("tile").alias("tile"))
    kinds = written(kinds.select("tile"), "kinds")
    shared = written(every.join(small_side(kinds, 24), "tile", "left_semi"), "tiles")
    met = small_side(written(shared.select("row_id").distinct(), "met"), 24)
    sizes = written(nodes.select("row_id", "n", "bits").join(met, "row_id", "left_semi"), "sizes")
    ids = written(signed.select("row_id", "n_shingles", "set_hi", "set_lo"), "ids")
    for t in (signed, many, every, kinds, met):
        drop_written(t)
    links = _links(shared, sizes, rows, n, percent)
    # an id with several texts joins their nodes
    named = ids.where("n_shingles > 0 and row_id is not null").join(small_side(copied, 48), ["set_hi", "set_lo"])
    whole = components(named.select(F.col("row_id").alias("a"), F.col("node").alias("b")).where("a <> b").union(links), "a", "b", "whole")
    for t in (shared, sizes, links):
        drop_written(t)
    out = ids.select("row_id", "n_shingles").join(whole.withColumnRenamed("node", "row_id"), "row_id", "left")
    return out.select("row_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "row_id")).otherwise(F.col("row_id")).alias("component_id"))


def _links(shared: DataFrame, sizes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all that is linked, from tiles (row_id, tile) of two members or more."""
    links = written(shared.select(F.col("row_id").alias("a"), F.col("row_id").alias("b")).limit(0), "links")
    for turn in range(ROUNDS + 1):
        if turn and links.isEmpty():
            now = shared.withColumn("comp", F.col("row_id"))
        elif turn:
            # a text's few tiles stand beside its component
            comps = components(links, "a", "b").select(F.col("node").alias("row_id"), F.col("component_id").alias("comp"))
            both = shared.unionByName(comps, allowMissingColumns=True)
            comp = F.coalesce(F.max("comp").over(Window.partitionBy("row_id")), F.col("row_id"))
            now = written(both.withColumn("comp", comp).where("tile is not null"), "now")
        else:
            now = shared.withColumn("comp", F.col("row_id"))
        pairs = _anchored(now, sizes, percent, turn) if turn < ROUNDS else written(_blocks(now, sizes, percent), "pairs")
        if pairs is None:
            drop_written(now)
            break
        if not pairs.isEmpty():
            new = _verified(pairs, rows, n, percent)
            old, links = links, written(links.union(new), "links")
            drop_written(new)
            drop_written(old)
        drop_written(pairs)
        drop_written(now)
    return links


def _anchored(now: DataFrame, sizes: DataFrame, percent: int, turn: int) -> DataFrame | None:
    """Pairs (a, b) of an anchor and a text in one of its tiles but not in its component; one anchor for a text.

    None if the members of every tile are connected.
    """
    order = F.xxhash64("row_id", F.lit(turn)) if turn else F.col("row_id")
    anchor = F.min(F.struct(order.alias("turn"), "row_id", "comp")).alias("anchor")
    tiles = now.groupBy("tile").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), anchor).where("c0 <> c1")
    tiles = tiles.select("tile", "anchor.turn", F.col("anchor.row_id").alias("other"), F.col("anchor.comp").alias("oc"))
    meet = now.join(tiles.hint("merge"), "tile").where("comp <> oc")
    # of its tiles' anchors a text meets one, the first in this round's order
    one = meet.groupBy("row_id").agg(F.min(F.struct("turn", "other"))["other"].alias("a")).select("a", F.col("row_id").alias("b"))
    one = written(one, "one")
    if one.isEmpty():
        drop_written(one)
        return None
    side = lambda x: sizes.select(F.col("row_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    out = written(_allowed(one.join(side("a"), "a").join(side("b"), "b"), percent), "allowed")
    drop_written(one)
    return out


def _blocks(now: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open tiles across components that sizes and bitmaps allow.

    A tile's largest component needs no comparison within itself: its members meet the blocks of the others alone.
    """
    per = now.groupBy("tile", "comp").agg(F.count(F.lit(1)).alias("k"))
    tiles = per.groupBy("tile").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("members"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    tiles = tiles.select("tile", F.col("main.comp").alias("main"), blocks(F.col("members") - F.col("main.k")).alias("minor"), blocks(F.col("main.k")).alias("major"))
    m = now.join(tiles.hint("merge"), "tile").join(sizes, "row_id")
    outside, dealt = F.col("comp") != F.col("main"), F.xxhash64("row_id")
    m = m.withColumn("block", F.when(outside, F.pmod(dealt, F.col("minor"))).otherwise(F.col("minor") + F.pmod(dealt, F.col("major"))).cast("int"))
    # a member goes to every pair of blocks that its own is in
    last = F.when(outside, F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1
    m = m.select("tile", "row_id", "comp", "n", "bits", "block", F.explode(F.sequence(F.lit(0), last)).alias("o"))
    m = m.withColumns({"lo": F.least("block", "o"), "hi": F.greatest("block", "o")})

    def compare(key, table):
        import numpy as np
        import pyarrow as pa

        rid, comp, size, block = (table[c].to_numpy() for c in ("row_id", "comp", "n", "block"))
        maps = table["bits"].to_pylist()
        bits = folded(maps, min(map(len, maps)) // 8)
        lo, hi = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        a, b = [], []
        for i in left:
            r = right[(comp[right] != comp[i]) & (100 * np.minimum(size[i], size[right]) >= percent * np.maximum(size[i], size[right]))]
            r = r[rid[r] > rid[i]] if lo == hi else r
            if len(r):
                ok = r[_possible(bits[i][None, :], bits[r], size[i], size[r], percent)]
                a += [rid[i]] * len(ok)
                b += rid[ok].tolist()
        return pa.table({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    out = m.groupBy("tile", "lo", "hi").applyInArrow(compare, "a long, b long")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_representatives(docs: DataFrame, n: int = 5, percent: int = 80, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that another represents: of each component the row with the smallest id stays.

    Of rows that share that id one stays, any of them.  Rows with a null id stay.  Columns and their order stay.
    """
    own, mark = free_name(docs, "component_id"), free_name(docs, "linked")
    ids = docs.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("long").alias(own)).agg(F.count(F.lit(1)).alias(mark))
    again = written(ids.where(F.col(mark) > 1).select(own), "again")
    found = link_components(docs, n, percent, row_id, text).where("component_id <> row_id").select("row_id").distinct()
    gone = written(found.select(F.col("row_id").alias(own)), "gone")
    kept = docs.join(small_side(gone, 24), docs[row_id].cast("long") == gone[own], "left_anti")
    if again.isEmpty():
        return kept
    here = lambda how: kept.join(small_side(again, 24), docs[row_id].cast("long") == again[own], how)
    return here("left_anti").unionByName(here("left_semi").dropDuplicates([row_id]))
