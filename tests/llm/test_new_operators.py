"""Spelling variants, prefix trie, token counts: small fixtures against plain versions."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verdigris.llm import prefix_trie, queries, spelling, token_counts
from verdigris.llm.queries import tokenizer_path


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts: dict[str, int], ratio: int) -> set:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * max(1, counts[w]) else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


def words_of(rng: random.Random, n: int, alphabet: str, most: int) -> dict[str, int]:
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))): rng.choice([0, 1, 2, 5, 5, 30, 30, 200, 5_000]) for _ in range(n)}


@pytest.mark.parametrize(("alphabet", "most", "hot"), [("ab", 7, 10**6), ("ab", 7, 2), ("abc", 5, 0), ("aé\0😀", 4, 3)])
def test_variants(spark, alphabet, most, hot):
    counts = words_of(random.Random(alphabet + str(hot)), 150, alphabet, most)
    rows = [(w, n, "x") for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n long, root string").repartition(3)
    got = [tuple(r) for r in spelling.variants(df, 5, hot).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(counts) and set(got) == plain_variants(counts, 5)


def test_variants_of_odd_rows(spark):
    long = "a" * 60_000
    rows = [(None, 9), ("", None), ("b", 3), ("b", 4), ("bb", 40), (long, 2), (long + "b", 50), (long[1:], 1), ("x" + long, 1)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == 7
    assert (got[""]["n"], got[""]["form"], got[""]["root"]) == (0, "b", "bb") and (got["b"]["n"], got["b"]["form"]) == (7, "bb")
    assert got[long]["n_near"] == 3 and got[long]["form"] == long + "b" and got[long[1:]]["n_near"] == 1 and got[long[1:]]["form"] is None
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling.variants(spark.createDataFrame(rows, "word string, n long"), 1)


def test_chains_end_at_their_root(spark):
    counts = {"z" * (i + 1): 5**i for i in range(12)}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"z" * 12}


def test_light_branches_are_few(spark):
    counts = words_of(random.Random(8), 3_000, "abcdefg", 9)
    words = spark.createDataFrame(list(enumerate(counts)), "id long, word string")
    most = spelling.light_branches(words).groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= len(counts).bit_length()


def test_near_words_of_one_place_are_not_listed_as_pairs(spark):
    counts = {f"stem{chr(0x4E00 + i)}end": i + 1 for i in range(400)}
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts.items())], "id long, word string, n long")
    got = {r["word"]: (r["n_near"], r["best"]["word"]) for r in spelling.near_words(words).collect()}
    top, second = max(counts, key=counts.get), max((w for w in counts if counts[w] < 400), key=counts.get)
    assert all(got[w] == (399, second if w == top else top) for w in counts)


def test_query_words_follow_the_contract(spark, tmp_path):
    import zlib

    rng = random.Random(4)
    stems = ["Größen", "ÀBCDEF", "running", "runing", "abcde", "abcdef", "Gebäudeteil"]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice([",", "", " 7"]) for _ in range(60))) for i in range(80)] + [(90, None), (91, ""), (91, "running " * 400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import re

    counts = defaultdict(int)
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = queries.op11_spelling_variants(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == plain_variants(counts, 5)


def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> set:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own
    out = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sorted_turns(rows):
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in by_conv.items()}


def random_log(rng: random.Random, convs: int):
    rows = []
    for c in rng.sample(range(-10, 3 * convs), convs):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None, "assistant"]), rng.choice(["", None, "a", "a", "ä", "bb"])))
    rows += [(2, i, "user", f"t{i % 3}") for i in range(300)]  # one conversation of a third of all turns
    return rows + rows[:40] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize(("block", "chunk"), [(1024, 8192), (7, 3)])
def test_trie(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = random_log(random.Random(block), 60)
    log = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    places = prefix_trie.numbered_turns(log)
    got = prefix_trie.trie(places, places.select("conv_id").distinct()).select(*COLUMNS).collect()
    want = plain_trie(sorted_turns(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_query_rebuilds_conversations(spark, tmp_path):
    import zlib

    rows = [r for r in random_log(random.Random(3), 80) if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = sorted_turns(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in built.values())
    got = queries.op12_conversation_trie(spark, str(tmp_path)).select(*COLUMNS).collect()
    want = plain_trie(built)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_nothing(spark):
    places = prefix_trie.numbered_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.trie(places, places.select("conv_id").distinct()).count() == 0
    only = spark.createDataFrame([(5,), (7,)], "conv_id long")
    assert [tuple(r) for r in prefix_trie.trie(places, only).select(*COLUMNS).collect()] == list(plain_trie({5: [], 7: []}))


def test_places_of_a_conversation_over_many_partitions(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(2_000)] + [(0, 0, "user", "x"), (2, 0, "user", "y")]
    random.Random(1).shuffle(rows)
    places = prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    assert places.where("conv_id = 1").agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (1, 2_000, 2_000)


def test_rounds_follow_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    real = prefix_trie.written
    monkeypatch.setattr(prefix_trie, "written", lambda df, label, **o: rounds.append(label) or real(df, label, **o))
    nodes = spark.range(501).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("depth"), F.when(F.col("id") > 0, 1).cast("long").alias("parent_conv_id"), F.lit(1).cast("long").alias("n"))
    got = {r["depth"]: r["n"] for r in prefix_trie.roll_up(nodes, ["n"]).collect()}
    assert got == {d: 501 - d for d in range(501)} and rounds == ["rollup"] * 9


ODD = ["", None, "a", "   three", "x \n\n y\t ", "don't they're", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "日本 語　w", "՘࢏ letters\U0001df24 new", "é ‍﻿",
       "=" * 5_000, "word " * 30_000, "a" * 20_000, "\0 \x1f\x85\xa0 z"]


@pytest.mark.parametrize("common", [200_000, 3, 0])
def test_token_counts(spark, common):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(common)
    letters = "ab Z'sé\n\t 12!?  　​日<|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    rows = [(i // 2, t, 1, "x") for i, t in enumerate(texts)] + [(None, "two words", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, row_id string").repartition(3)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, tokenizer_path(), common=common).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path()).count() == 0


def test_frequencies_meet_pieces(spark):
    rows = spark.createDataFrame([(1, 7, "the cat the cat the"), (2, 8, "the dog"), (3, None, "")], "row_id long, doc_id long, text string")
    for held in (1, 100):
        counted = token_counts.pre_token_counts(rows.repartition(2), tokenizer_path(), held)
        assert {r["pre_token"]: r["n"] for r in counted.collect()} == {"the": 2, " cat": 2, " the": 2, " dog": 1}
    got = {r["row_id"]: (r["doc_id"], r["n_bytes"], r["n_tokens"], {tuple(o) for o in r["others"]}) for r in token_counts.document_counts(rows, tokenizer_path(), {"the": 10, " cat": 100}).collect()}
    assert got == {1: (7, 19, 210, {(" the", 2)}), 2: (8, 7, 10, {(" dog", 1)}), 3: (None, 0, 0, set())}


def test_pre_tokens_need_a_byte_level_file():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PreTokens(public_tokenizers.path("word_bpe_49k.json"))


def test_splitting_equals_the_tokenizers(spark):
    words = token_counts.PreTokens(tokenizer_path())
    rng = random.Random(11)
    for _ in range(3_000):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3100), rng.randrange(0xE000, 0x110000), 32, 10])) for _ in range(12))
        text = text.encode("utf-8", "ignore").decode()
        assert words(text) == [text[a:b] for _, (a, b) in words.tok.pre_tokenizer.pre_tokenize_str(text)], ascii(text)
