"""Near-duplicates, line dedup, vectors: small fixtures against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.llm import common, cover_tree, line_dedup, near_dup
from verdigris.llm.common import components


def groups(nodes, links):
    top = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text, n):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 640)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    want = {n: t for n, t in groups({x for e in edges for x in e}, edges).items()}
    got = {r["node"]: r["component_id"] for r in components(df, "a", "b").collect()}
    assert got == {n: t for n, t in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))
    assert components(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "ONE", "one two", "a b c d", "x " * 500, "x " * 700]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 260))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            texts.append(" \n".join(edit).title() if rng.random() < 0.3 else " ".join(edit))
    rng.shuffle(texts)
    df = spark.createDataFrame([(i * 3, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id int")
    sets = {i * 3: shingles(t, n) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = near_dup.link_components(df, n, percent).collect()
    assert {r["row_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = near_dup.keep_representatives(df, n, percent)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert near_dup.link_components(df.limit(0)).count() == 0


def test_cells_cover_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    starts = near_dup.band_starts()
    for _ in range(200):
        size = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = int(rng.integers(0, max(1, len(base) // 9)))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, size // 15)))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 90 * (len(base) + len(other) - both):
            assert np.intersect1d(near_dup.tile_keys(base, 90, starts), near_dup.tile_keys(other, 90, starts)).size


def plain_lines(rows, percent=80):
    lines = [(d, i, {w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x) if w}) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    return {(d, i) for k, (d, i, w) in enumerate(lines) if any((e, j) < (d, i) and 100 * len(w & v) >= percent * len(w | v) for e, j, v in lines[:k])}


def test_line_dedup(spark):
    rng = random.Random(4)
    words = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(150)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(60)]

    def line():
        x = rng.choice(pool).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            x[rng.randrange(len(x))] = rng.choice(words)
        return rng.choice(("  ", " ", "\t")).join(x)

    rows = [(i, "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 9)))) for i in range(70)] + [(100, None), (101, ""), (102, "\n\n"), (None, pool[0]), (103, "word " * 2000), (104, "word\n" * 300)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, n_removed string")
    gone = plain_lines(rows)
    for r in line_dedup.dedup_lines(df).collect():
        text = dict((d, t) for d, t in rows if d is not None).get(r["doc_id"]) if r["doc_id"] is not None else pool[0]
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (r["doc_id"], i) not in gone)
        assert r["text"] == want and r["_n_removed"] == (0 if text is None else sum(k[0] == r["doc_id"] for k in gone)) and r["n_removed"] == "s"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_one_other_word_are_no_copies(spark):
    h = F.xxhash64("w")
    words = spark.range(400_000).select(F.concat(F.lit("id"), "id").alias("w")).groupBy(F.shiftrightunsigned(h, 40).alias("top"), h.bitwiseAND(127).alias("low")).agg(F.collect_list("w").alias("ws")).where("size(ws) > 1")
    pairs = [r["ws"][:2] for r in words.collect()]
    assert len(pairs) > 5
    rows = [(i, "\n".join(f"{p[i]} of{k}" for k, p in enumerate(pairs))) for i in (0, 1)] + [(2, f"of0 {pairs[0][0]}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: rows[1][1], 2: ""}


def test_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    x = [*(base[rng.integers(0, 12)] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.25]) for _ in range(240)), *rng.normal(size=(60, 24))]
    rows = [(i, [float(v) for v in vec]) for i, vec in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [1.0, None] * 12), (1005, rows[0][1]), (1006, rows[0][1]), (1007, [1.0, 2.0]), (1008, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, kept int")
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = [(a, b) for k, (a, u) in enumerate(good) for b, v in good[k + 1 :] if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.95]
    top = groups([i for i, _ in rows if i is not None], links)
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "PIVOTS", 32)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.link_vectors(df).collect()}
    for i, _ in rows:
        if i is not None:
            assert got[i] == (sum(i in e for e in links), top[i], top[i] == i), i
    assert got[None][0] == 0
    assert cover_tree.link_vectors(df.limit(0)).count() == 0
    single = df.where("vec_id < 40").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert cover_tree.link_vectors(single).count() == 40


@pytest.mark.parametrize("percent", [50, 70, 100])
def test_line_dedup_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(40)]
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(12)]

    def line():
        x = list(rng.choice(pool))
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = rng.choice(words)
        return " ".join(x)

    rows = [(i, "\n".join(line() for _ in range(6))) for i in range(40)]
    gone = plain_lines(rows, percent)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_linked_sets_share_a_key():
    rng = random.Random(6)
    length = lambda n, run, p: min(n, int((run - 1) * ((n - n * (100 - p) // 100) * (100 - p) / p + 1) + 1 + n * (100 - p) // 100))
    met = 0
    for _ in range(20_000):
        p, shared, one, other = rng.choice((50, 67, 70, 80, 90)), rng.randint(1, 40), rng.randint(0, 9), rng.randint(0, 9)
        order = ["both"] * shared + ["one"] * one + ["other"] * other
        rng.shuffle(order)
        a, b = ([i for i, x in enumerate(order) if x in ("both", name)] for name in ("one", "other"))
        for run in (1, 2, 3):
            least = line_dedup.least_size(run, p)
            if least is not None and 100 * shared >= p * len(order) and min(len(a), len(b)) >= least:
                keys = [{tuple(x[i : i + run]) for i in range(length(len(x), run, p) - run + 1)} for x in (a, b)]
                assert keys[0] & keys[1]
                met += 1
    assert met > 1000


def test_line_dedup_of_repeated_ids(spark):
    rows = [(1, "a b c d e\nx y z"), (1, "p q r s t\nx y z"), (2, "a b c d e\np q r s t\nnew words here"), (3, None), (3, "x y z")]
    got = sorted((r["doc_id"], r["text"] or "", r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a b c d e\nx y z", 0), (1, "p q r s t\nx y z", 0), (2, "new words here", 2), (3, "", 0), (3, "", 1)]


@pytest.mark.parametrize("percent", [50, 79])
def test_near_duplicates_far_apart_in_size(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for cut in (1.0, 0.9, 0.8, 0.7, 0.6, 0.52):
            rows.append((len(rows), " ".join(base[: int(len(base) * cut)])))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = near_dup.link_components(spark.createDataFrame(rows, "row_id long, text string"), 3, percent, "row_id").collect()
    assert {r["row_id"]: r["component_id"] for r in got} == groups(sets, links)


def test_one_row_of_a_repeated_representative_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, None), (4, None)]
    kept = near_dup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 4]


def test_folded_bitmaps_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        percent = max(1, 100 * both // (len(a) + len(b) - both))
        maps = [near_dup.bitmap(a, percent), near_dup.bitmap(b, percent)]
        p, q = near_dup.folded(maps, min(map(len, maps)) // 8)
        if 100 * both >= percent * (len(a) + len(b) - both):
            assert near_dup._possible(p, q, len(a), len(b), percent)
    a, b = (np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64)) for _ in "ab")
    b = np.unique(np.concatenate([b, a[:600]]))
    maps = [near_dup.bitmap(x, 80) for x in (a, b)]
    p, q = near_dup.folded(maps, min(map(len, maps)) // 8)
    assert not near_dup._possible(p, q, len(a), len(b), 80)


def test_blocks_of_clustered_vectors_hardly_meet(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = cover_tree.unit(rng.normal(size=(300, 64)))
    x = cover_tree.unit(np.repeat(centres, 40, axis=0) + rng.normal(size=(12_000, 64)) * 0.02)
    pivots = cover_tree.unit(centres)
    dots = x @ pivots.T
    near = dots.argmax(axis=1)
    far = np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1)))
    monkeypatch.setattr(cover_tree, "BLOCK", 256)
    kind = (far[:, None] > np.array(cover_tree.SHELLS)).sum(axis=1)
    stats = [(int(p), int(k), int(m.sum()), float(far[m].min()), float(far[m].max())) for p in range(300) for k in range(3) if (m := (near == p) & (kind == k)).any()]
    shells, meets = cover_tree.top_tiles(pivots, stats, 0.316)
    n = 1 + max(c for *_, c, _ in shells)
    assert n > 30 and len(meets) < 0.1 * n * n, (n, len(meets))
    # every pair within reach is in blocks that meet
    cell = {(p, k): c for p, k, c, _ in shells}
    own = np.array([cell[int(p), int(k)] for p, k in zip(near, kind)])
    met = {(i, j) for i, j, _ in meets}
    some = rng.integers(0, len(x), 400)
    for i in some:
        for j in np.flatnonzero(x @ x[i] >= 0.95):
            assert (own[i], own[j]) in met


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_blocks_that_all_meet_are_not_copied(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x[2000:2400] = x[:400] + rng.normal(size=(400, 32)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "PIVOTS", 32)
    monkeypatch.setattr(cover_tree, "STRIP", 200_000, raising=False)
    monkeypatch.setattr(cover_tree, "MERGE", 2, raising=False)
    before = shuffled_bytes(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.link_vectors(df).collect()}
    moved = shuffled_bytes(spark) - before
    u = cover_tree.unit(x.astype(np.float32))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    top = groups(range(3000), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    assert got == {i: (int(near[i].sum()), top[i]) for i in range(3000)}
    assert moved < 10 * x.astype(np.float32).nbytes, moved


def test_bitmaps_tell_near_sets_below_the_limit_apart():
    import numpy as np

    rng = np.random.default_rng(12)
    passed = 0
    for _ in range(200):
        base = rng.integers(0, 2**63, 150 + 11).astype(np.uint64)  # 139 of 161 n-grams are shared: 86 %
        a, b = np.sort(base[:150]), np.sort(base[11:])
        maps = [near_dup.bitmap(x, 90) for x in (a, b)]
        p, q = near_dup.folded(maps, min(map(len, maps)) // 8)
        passed += bool(near_dup._possible(p, q, len(a), len(b), 90))
    assert passed < 20, passed


def test_lines_just_below_the_limit_do_not_all_pair(spark, monkeypatch):
    rng = random.Random(15)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        x = list(base)
        for k in rng.sample(range(60), 4):
            x[k] = f"u{i}x{k}"
        rows.append((i, " ".join(x)))
    rows += [(500 + i, rows[i][1] + " more") for i in range(0, 150, 10)]
    met, plain = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *rest: (met.append(pairs.count()), plain(pairs, *rest))[1])
    monkeypatch.setattr(line_dedup, "PASS_WORDS", 3000, raising=False)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = plain_lines(rows)
    assert {r["doc_id"] for r in got if r["n_removed"]} == {d for d, _ in gone} and len(gone) >= 15
    assert sum(met) < 4 * len(rows), met


def test_tiles_left_by_either_side_leave_linked_pairs_one():
    import numpy as np

    rng = np.random.default_rng(21)
    starts, common, met = near_dup.band_starts(), rng.integers(0, 2**63, 40).astype(np.uint64), 0
    for turn in range(400):
        percent, size = (50, 67, 80, 90)[turn % 4], int(rng.integers(1, 260))
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        far = size * (100 - percent) // (100 + percent)
        one, other = (np.unique(np.concatenate([base, common[: int(rng.integers(0, 4))], rng.integers(0, 2**63, int(rng.integers(0, far + 1))).astype(np.uint64)])) for _ in "ab")
        both = len(np.intersect1d(one, other))
        if 100 * both < percent * (len(one) + len(other) - both):
            continue
        met += 1
        tiles = [near_dup.slotted_tiles(x, percent, starts) for x in (one, other)]
        # any order that both sides read alike: here by the tile's own hash
        kept = []
        for keys, slots in tiles:
            stay = set()
            for slot in np.unique(slots):
                stay |= set(sorted(keys[slots == slot].tolist())[int(slot) & (1 << near_dup.SLOT_BITS) - 1 :])
            kept.append(stay)
        assert kept[0] & kept[1]
    assert met > 200


def test_texts_that_share_a_common_passage_do_not_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(31)
    passage = " ".join(f"p{k}" for k in range(14))
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)) + " " + passage) for i in range(600)]
    rows += [(1000 + i, rows[i][1].replace(" p13", " other")) for i in range(0, 600, 50)]
    met, plain = [], near_dup._blocks
    monkeypatch.setattr(near_dup, "_blocks", lambda now, *rest: (met.append(now.count()), plain(now, *rest))[1])
    got = {r["row_id"]: r["component_id"] for r in near_dup.link_components(spark.createDataFrame(rows, "row_id long, text string"), 5, 80, "row_id").collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert sum(met) < len(rows), met


def test_keys_of_one_set_alone_are_not_sorted(spark, monkeypatch):
    rng = random.Random(41)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(10))) for i in range(100)]
    rows += [(1000 + i, rows[i][1].split("\n")[0] + " more") for i in range(0, 100, 10)]
    met, plain = [], line_dedup.postings
    monkeypatch.setattr(line_dedup, "postings", lambda *a: (met.append(plain(*a).count()), plain(*a))[1])
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert got == {1000 + i for i in range(0, 100, 10)}
    assert sum(met) < 1000, met


def test_lines_that_share_keys_and_are_no_copies_go_no_further(spark, monkeypatch):
    rng = random.Random(43)
    rows = [(12 * g + i, " ".join([f"g{g}a", f"g{g}b", *(f"w{rng.randrange(300)}" for _ in range(30))])) for g in range(20) for i in range(12)]
    rows += [(1000 + g, rows[12 * g][1] + " more") for g in range(0, 20, 4)]
    met, plain = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, label, **o: (out := plain(df, label, **o), label == "met" and met.append(out.count()))[0])
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert got == {d for d, _ in plain_lines(rows)} == {1000 + g for g in range(0, 20, 4)}
    assert sum(met) < 100, met


def test_lines_at_the_end_of_a_large_group_meet_all_before_them(spark, monkeypatch):
    rng = random.Random(44)
    monkeypatch.setattr(line_dedup, "BEFORE", 2)
    monkeypatch.setattr(line_dedup, "KEPT", 1)
    rows = [(i, " ".join(["ga", "gb", *(f"w{rng.randrange(300)}" for _ in range(n))])) for i, n in enumerate([30, 80, 100] * 14)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(3, 42, 5)]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert got == {d for d, _ in plain_lines(rows)} >= {1000 + i for i in range(3, 42, 5)}


@pytest.mark.parametrize("before", [32, 4])
def test_sets_of_a_group_are_not_gathered_around_each_set(spark, monkeypatch, before):
    """Groups of 12 sets, small or large by ``BEFORE``: pairs come from joins, and no window holds a list of sets for each row."""
    rng = random.Random(45)
    monkeypatch.setattr(line_dedup, "BEFORE", before)
    rows = [(12 * g + i, " ".join([f"g{g}a", f"g{g}b", *(f"w{rng.randrange(300)}" for _ in range(30))])) for g in range(10) for i in range(12)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 120, 7)]
    plans, plain = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, label, **o: (plans.append(df._jdf.queryExecution().toString()) if label in ("met", "placed") else None, plain(df, label, **o))[1])
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    assert got == {d for d, _ in plain_lines(rows)} >= {1000 + i for i in range(0, 120, 7)}
    windows = [line for plan in plans for line in plan.split("\n") if "Window [" in line]
    assert plans and not any("collect_list" in line for line in windows) and bool(windows) == (before == 4)


def test_the_first_of_equal_lines_stays_and_sets_are_counted_unsorted(spark, monkeypatch):
    plans, plain = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, label, **o: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if label == "repeated" else None, plain(df, label, **o))[1])
    rows = [(5, "b c a\nx y z\na b c"), (2, "q\nz y x\na c b\nz x y"), (9, "c b a"), (-3, "other words here\nb a c"), (2, "q\nx z y")]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-3, "other words here\nb a c", 0), (2, "q\nx z y", 0), (2, "q\nz y x", 2), (5, "", 3), (9, "", 1)]
    assert plans and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("few", [None, 64])
def test_wide_clusters_are_compared_in_bounded_memory(monkeypatch, few):
    """All pairs of two blocks lie near the threshold: no list of them is held, and links are those of all pairs."""
    import tracemalloc

    import numpy as np

    rng, n = np.random.default_rng(3), 1200 if few is None else 150
    if few:
        monkeypatch.setattr(cover_tree, "PAIRS", few)
    centre = rng.normal(size=64)
    x, y = (cover_tree.unit(centre / np.linalg.norm(centre) + 0.03 * rng.normal(size=(n, 64))) for _ in range(2))
    tree_x, tree_y = cover_tree.Tree(x), cover_tree.Tree(y)
    within, between = cover_tree.Links(n, np.ones(n, dtype=np.int64)), cover_tree.Links(2 * n, np.ones(2 * n, dtype=np.int64))
    tracemalloc.start()
    cover_tree.traverse(x, x, tree_x, tree_x, 0, 0.95, within)
    cover_tree.traverse(x, y, tree_x, tree_y, n, 0.95, between)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (within.count == (x @ x.T >= 0.95).sum(axis=1) - 1).all()
    assert (between.count == np.concatenate([(x @ y.T >= 0.95).sum(axis=1), (x @ y.T >= 0.95).sum(axis=0)])).all()
    assert peak < 100_000_000
