"""The whole pipeline against a plain version of each stage."""

import random
import re
import zlib

from test_similarity_operators import groups, plain_lines, shingles
from test_small_operators import plain_mix

import corpus_pipeline as P
from verdigris.llm import quality
from verdigris.llm.queries import WEIGHTS, tokenizer_path


def plain_pipeline(rows):
    rows = [r for r in rows if not any(rule.rejects(quality.Counts(r[1])) for rule in quality.RULES)]
    gone = plain_lines([r[:2] for r in rows], P.LINES)
    kept = []
    for d, t, lang, src in rows:
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if re.search(r"[^\x20\x09-\x0D]", text):
            kept.append((d, text, lang, src))
    sets = {r[0]: shingles(r[1], P.SHINGLE) for r in kept}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= P.SIMILAR * len(sets[a] | sets[b])]
    top = groups(sets, links)
    kept = [r for r in kept if top[r[0]] == r[0]]
    domains = list(WEIGHTS["domain"])
    stock = [(d, domains[int(src[3:]) % 4], lang, src, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t, lang, src in kept]
    weights = WEIGHTS | {"source": None}
    taken = plain_mix(stock, weights, P.SHARE, 1, P.SEED)
    return {d: t for d, t, _, _ in kept if d in taken}


def test_run(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfgmnprt" for b in ("a", "en", "or", "ist", "ule", "ama", "ic", "ork", "ath", "ind")]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 30))) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines)), rng.choice(pool))
        if rng.random() < 0.15:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        rows.append((i, "\n".join(lines), rng.choice(["en", "en", "de"]), f"src{rng.choice([0, 0, 0, 1, 2, 7])}"))
    # copies whose lines are cut otherwise, so that only their shingles show them
    rows += [(200 + i, " ".join(rows[i][1].split()), rows[i][2], rows[i][3]) for i in range(0, 40, 3)] + [(300, None, "en", "src0"), (301, "", "en", "src1"), (302, rows[5][1], "de", "src1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline(rows)
    got = P.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {d: tok.encode(t, add_special_tokens=False).ids + [0] for d, t in want.items()}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert set(pieces) == set(want)
    for d, rs in pieces.items():
        rs.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rs] == [sum(x["length"] for x in rs[:i]) for i in range(len(rs))] and sum(r["length"] for r in rs) == len(ids[d])
    for rs in sequences.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:i]) for i in range(len(rs))] and sum(r["length"] for r in rs) <= 1024


def test_stages_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0, name
        if name != P.STAGES[-1][0]:
            assert out.columns == none.columns


def test_stages_on_odd_rows(spark):
    """Columns with the stages' own names, repeated ids, a very long text, nulls: columns stay, and no stage fails."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long = "\n".join(text(40) for _ in range(400))
    rows = [(i, text(80), "en", "src0", 1, False, "x", 5) for i in range(20)] + [(3, rows_text := text(90), "en", "src0", 1, False, "x", 5), (3, rows_text, "en", "src0", 1, False, "x", 5), (50, long, None, None, None, None, None, None), (None, text(70), "de", "src1", 1, True, "y", 6), (51, None, "en", "src2", 0, True, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_removed string, length long")
    docs = df
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), df.schema)
        assert docs.columns == df.columns, name
        if name == "n-gram Jaccard join":
            assert docs.where("doc_id = 3").count() == 1 and docs.where("doc_id is null").count() == 1
    assert P.packing_stage(spark, docs, "").count() >= docs.count()
