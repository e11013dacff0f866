"""Toxicity by class-conditional Kneser-Ney models.

A word is scored character by character.  Each class has its own counts of n-grams of ``ORDERS[0]`` characters (with the
word's edges); what a class has not seen is smoothed by absolute discounting through counts that the classes share: how
many different n-grams end in a shorter one.  Evidence is always the difference of the two log-likelihoods of a run of words,
divided by their number: of the whole text, of the whole text without what a word may differ by chance (``MARGINS``), and of
its most toxic stretch of each of ``STRETCHES`` words, so that neither a long text hides a short insult nor an expression of
several words counts word by word alone.  A logistic fit of these differences and nothing else turns them into a score.  The fit takes a bounded sample of training rows and the evidence of a
model that hasn't counted them; the model that scores counts them too.

Corpus counts cover all training rows, whatever their number: words are counted exactly by a shuffle, and so are the
n-grams of the distinct words.  The model that is broadcast has one row for each n-gram and context that was counted, under
its whole 64-bit hash, so it grows with them and no two share a counter: 16 bytes an n-gram of the first order, 24 a context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import drop_written, small_side, text_batches, text_slices, written

#: Characters in a class's n-grams, then in the shared backoff counts.
ORDERS = (6, 4, 2, 1)
DISCOUNT = 0.75
#: Probability of a character that no count knows.
FLOOR = 1 / 200
#: Evidence of one word, in nats, that is taken for chance.
MARGINS = (1.0, 3.0)
#: Words in the stretches that are compared, and the most that evidence counts, in nats a word.
STRETCHES, MOST = (1, 2, 4, 8), 12.0
#: Labelled documents that the logistic fit takes, about, where there are more; the counts take all.
CALIBRATION_ROWS = 20_000
SLICE_BYTES = 8_000_000


def split_words(part):
    """(row of each word, codes, distinct words) of an Arrow string array: runs of letters, lower case."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(pc.utf8_lower(part), r"[^\p{L}]+")
    coded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    empty = names.index("") if "" in names else -1
    keep = codes != empty
    return rows[keep], codes[keep], names


def ngrams(words: list[str]):
    """Hashes of the n-grams that end at each character: (word of each, {order: (n-gram, context)}).

    Words are bounded by ^ and $; the first ^ ends no n-gram.  An n-gram that would reach past ^ is the whole prefix.
    """
    import numpy as np

    text = "".join([f"^{w}$" for w in words])
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    mul, add = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)

    def mixed(h):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    run, runs = (points + np.uint64(1)) * mul + add, {}
    runs[0] = np.zeros_like(points)
    runs[1] = run
    for k in range(2, max(ORDERS) + 1):
        longer = np.roll(runs[k - 1], 1) * mul + (points + np.uint64(1)) * add + (np.roll(runs[k - 1], 1) >> np.uint64(31))
        runs[k] = np.where(place >= k - 1, longer, runs[k - 1])
    at = place > 0
    before = {k: np.roll(runs[k - 1], 1) if k > 1 else runs[0] for k in ORDERS}
    return word[at], {k: (mixed(runs[k][at] + np.uint64(k if k < ORDERS[0] else 0)), mixed(before[k][at] + np.uint64(100 + (k if k < ORDERS[0] else 0)))) for k in ORDERS}


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, n0, n1): how often ordinary and toxic rows of ``labelled`` (text, toxic) say each word."""

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, part in text_slices(pc.fill_null(batch.column(0), ""), SLICE_BYTES):
                rows, codes, names = split_words(part)
                yes = toxic[at + rows]
                n = [np.bincount(codes[m], minlength=len(names)) for m in (~yes, yes)]
                keep = np.flatnonzero(n[0] + n[1])
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.string()), *(pa.array(x[keep], pa.int64()) for x in n)], names=["word", "n0", "n1"])

    out = labelled.select("text", F.col("toxic").cast("boolean").alias("toxic")).mapInArrow(count, "word string, n0 long, n1 long")
    return out.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def ngram_types(counts: DataFrame) -> DataFrame:
    """The distinct n-grams of the first order with their counts by class and the hashes of their shorter endings."""
    names = [f"{a}{k}" for k in ORDERS for a in "gh"]

    def split(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            word, grams = ngrams(batch.column(0).to_pylist())
            _, first, back = np.unique(grams[ORDERS[0]][0], return_index=True, return_inverse=True)
            n = [np.bincount(back, weights=batch.column(i).to_numpy()[word], minlength=len(first)).astype(np.int64) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for k in ORDERS for x in grams[k]), *map(pa.array, n)], names=[*names, "n0", "n1"])

    rows = counts.mapInArrow(split, ", ".join(f"{n} long" for n in [*names, "n0", "n1"]))
    return rows.groupBy(names[0]).agg(*(F.first(n).alias(n) for n in names[1:]), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(labelled: DataFrame) -> dict:
    """Tables (sorted hashes, counts) of n-grams and contexts, from labelled rows (text, toxic)."""
    import numpy as np

    types = written(ngram_types(word_counts(labelled)), "kn")
    top = ORDERS[0]

    def gathered(df: DataFrame, key: str, columns: list[str]) -> tuple:
        got = df.select(key, *columns).toArrow()
        keys = got[key].to_numpy()
        order = np.argsort(keys)
        counts = [got[c].to_numpy()[order] for c in columns]
        return keys[order], [c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c for c in counts]

    model = {"n": gathered(types, f"g{top}", ["n0", "n1"])}
    seen = [F.sum((F.col(c) > 0).cast("long")) for c in ("n0", "n1")]
    model["h"] = gathered(types.groupBy(f"h{top}").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), seen[0].alias("t0"), seen[1].alias("t1")), f"h{top}", ["n0", "n1", "t0", "t1"])
    model["shared"] = {}
    for k in ORDERS[1:]:
        ends = types.groupBy(f"g{k}").agg(F.first(f"h{k}").alias(f"h{k}"), F.count(F.lit(1)).alias("n"))
        model["shared"][k] = gathered(ends, f"g{k}", ["n"]), gathered(ends.groupBy(f"h{k}").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t")), f"h{k}", ["n", "t"])
    drop_written(types)
    return model


def looked_up(table: tuple, keys):
    """The counts of ``keys`` in a table of :func:`train`, a row for each column; 0 for what it doesn't have."""
    import numpy as np

    known, counts = table
    if not len(known):
        return np.zeros((len(counts), len(keys)))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return np.array([np.where(hit, c[at], 0) for c in counts], dtype=np.float64)


def evidence(model: dict, words: list[str]):
    """Toxic minus ordinary log-likelihood of each word."""
    import numpy as np

    if not words:
        return np.zeros(0)
    word, grams = ngrams(words)
    # an n-gram of the first order settles the shorter ones
    _, first, back = np.unique(grams[ORDERS[0]][0], return_index=True, return_inverse=True)
    p = np.full(len(first), FLOOR)
    for k in reversed(ORDERS[1:]):
        g, h = (x[first] for x in grams[k])
        (n,), (whole, types) = looked_up(model["shared"][k][0], g), looked_up(model["shared"][k][1], h)
        p = np.where(whole > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types * p) / np.maximum(whole, 1), p)
    g, h = (x[first] for x in grams[ORDERS[0]])
    n, context = looked_up(model["n"], g), looked_up(model["h"], h)
    both = []
    for c in (0, 1):
        whole = context[c]
        both.append(np.where(whole > 0, (np.maximum(n[c] - DISCOUNT, 0) + DISCOUNT * context[2 + c] * p) / np.maximum(whole, 1), p))
    return np.bincount(word, weights=np.log(both[1] / both[0])[back], minlength=len(words))


def features(model: dict, part):
    """Rows of features of an Arrow array of texts: length-normalised evidence of the whole and of the strongest stretches."""
    import numpy as np

    rows, codes, names = split_words(part)
    each = evidence(model, names)[codes]
    n = np.bincount(rows, minlength=len(part))
    by_word = lambda x: np.bincount(rows, weights=x, minlength=len(part)) / np.maximum(n, 1)
    mean = by_word(each)
    total = np.concatenate([[0.0], np.cumsum(each)])
    out = [np.ones(len(part)), np.clip(mean, -1, 1), *(np.log1p(100 * by_word(np.maximum(each - m, 0))) for m in MARGINS)]
    for k in STRETCHES:
        # a text with fewer words is one stretch
        best = np.where(n < k, mean, -np.inf)
        start = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :]) if len(rows) >= k else np.zeros(0, dtype=np.int64)
        np.maximum.at(best, rows[start], (total[start + k] - total[start]) / k)
        out.append(np.clip(best, -MOST, MOST) / 4)
    return np.stack(out, axis=1)


def fit_logistic(x, y, ridge: float = 1.0, steps: int = 30):
    """Weights by Newton's method; with one class or no rows, the base rate alone."""
    import numpy as np

    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -4.0 if not len(y) or not y.max() else 4.0
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = 5, held_out: int = 0, calibration_fold: int = 4, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A row's fold is crc32(doc_id as text) mod ``folds``.  Labels of fold ``held_out`` are never read; all others are counted.
    About ``calibration_rows`` documents of ``calibration_fold``, drawn by hash, fit the logistic step, or all if there are
    fewer.  Null and empty texts have no evidence and get a score too; texts of any length are read whole; a null label counts
    as none, and a document with two as toxic if one says so; a null doc_id has fold crc32('') and no label; repeated rows are scored each; without labels every score is low.
    """
    spark = docs.sparkSession
    text_batches(spark)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(fold != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = rows.join(small_side(known, 24), "doc_id")
    n_back = known.where(fold == calibration_fold).count()
    share = min(1.0, calibration_rows / max(n_back, 1))
    drawn = (fold == calibration_fold) & (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    back = labelled.where(drawn)
    without = spark.sparkContext.broadcast(train(labelled.where(~drawn)))

    def probe(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at, part in text_slices(pc.fill_null(batch.column(0), ""), SLICE_BYTES):
                x = features(without.value, part)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(at, len(part))], names=["x", "y"])

    import numpy as np

    got = back.select("text", F.col("toxic").cast("double").alias("y")).mapInArrow(probe, "x array<double>, y double").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, 2 + len(MARGINS) + len(STRETCHES))
    weights = fit_logistic(x, np.array(got["y"].to_pylist(), dtype=np.float64))
    without.destroy()
    model = spark.sparkContext.broadcast(train(labelled))

    def score(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at, part in text_slices(pc.fill_null(batch.column(2), ""), SLICE_BYTES):
                s = 1 / (1 + np.exp(-np.clip(features(model.value, part) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", (fold == held_out).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
