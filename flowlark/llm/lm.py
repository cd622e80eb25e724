"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(word | class). A word's class is its
suffix's hash with its frequency band; the end of a text and the unknown word are
classes of their own. P(class | history) is a softmax over hashed weights of
three features: the previous word, the previous two, and the word before the
previous one (skip). P(word | class) is the softmax of the word's own weight,
whose maximum-likelihood value is the relative frequency in the class.

Counts come from all training documents through the distinct-word table, and
the number of hashed rows a feature follows from them: it grows with the square
root of the training tokens. Weights start from the features' class counts and
are trained by distributed gradient steps: the chunks of training text are dealt
into BATCHES at random; each step, tasks compute on one batch by how much what
the model expects of every feature and class differs from what is there (the
gradient of the log-likelihood), the sums are added by slices of the weight
table, and the driver moves the weights, by a step scaled by each weight's
count. An epoch sees every training token once. All passes are numpy batches
over packed positions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import crc_bucket, materialise, release, shuffle_partitions, trimmed, words_of
from flowlark.llm.wordblocks import BLOCK_CHARS, block_tables, checksum, joined, meet, record_batch

SUFFIXES = 24
BANDS = 3
END, UNKNOWN = SUFFIXES * BANDS, SUFFIXES * BANDS + 1
CLASSES = SUFFIXES * BANDS + 2
FEATURES = 3
#: Hashed rows a feature: at least so many, and the square root of the training tokens (see table_rows).
ROWS = 4096
CONTEXTS = (1 << 22) - 1
SLICES = 48
STEP_TOKENS = 16_384
#: The training chunks are dealt into so many batches, one a gradient step; EPOCHS times all of them.
BATCHES = 4
EPOCHS = 1
RATE = 1.0
#: Weights are drawn to their start as if each had been seen so often.
DAMPING = 20
#: Row groups of the token table, so that its reads are split evenly.
GROUP_BYTES = 4 << 20
_END_WORD = " "  # no word has a blank


def table_rows(n: int) -> int:
    """Hashed rows a feature for n training tokens: the largest power of two up to the square root of n, ROWS at least."""
    return max(ROWS, 1 << (max(n, 1).bit_length() - 1) // 2)


def tokens(text: str) -> list[str]:
    """Words with A-Z in lower case (no other letter changes), then the end."""
    return [*words_of(text.encode().lower().decode()), _END_WORD]


def _band_hist(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


COUNT_SCHEMA = "block long, part int, check long, a binary, b binary"


def _count(batches):
    """Rows sorted by part: each word's count over all blocks goes back to every block that has the word, with its hashes; then the part's statistics."""

    def flush(part, rows):
        total: dict[str, int] = {}
        for _, words, counts, _ in rows:
            for w, n in zip(words, counts, strict=True):
                total[w] = total.get(w, 0) + n
        code = {w: 255 if w == _END_WORD else zlib.crc32(w[-2:].encode()) % SUFFIXES for w in total}
        out = []
        for block, words, _, check in rows:
            c = np.fromiter((total[w] for w in words), dtype="<i8", count=len(words))
            f = np.fromiter(((1 + zlib.crc32(w.encode()) % CONTEXTS) << 8 | code[w] for w in words), dtype="<u4", count=len(words))
            out.append((block, part, check, c.tobytes(), f.tobytes()))
        c = np.fromiter(total.values(), dtype=np.int64, count=len(total))
        s = np.fromiter(code.values(), dtype=np.int64, count=len(code))
        known = (c > 0) & (s < 255)
        hist = np.bincount(s[known] * 64 + _band_hist(c[known]), weights=c[known], minlength=SUFFIXES * 64)
        stats = np.array([c.sum(), (c > 0).sum(), (c == 1).sum(), c[s == 255].sum(), *hist], dtype="<f8")
        return [*out, (-1, part, 0, stats.tobytes(), b"")]

    at, rows = None, []
    for b in batches:
        for block, part, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != at and rows:
                yield record_batch(flush(at, rows), COUNT_SCHEMA)
                rows = []
            at = part
            rows.append((block, words.decode().split("\n"), np.frombuffer(counts, dtype="<i4").tolist(), int(np.uint64(checksum(words)).view(np.int64))))
    if rows:
        yield record_batch(flush(at, rows), COUNT_SCHEMA)


class Statistics:
    """Totals over the training tokens, and the classes they give."""

    def __init__(self, rows: list[bytes]) -> None:
        s = np.sum([np.frombuffer(r, dtype="<f8") for r in rows], axis=0) if rows else np.zeros(4 + SUFFIXES * 64)
        self.n, self.v, once, ends = (int(x) for x in s[:4])
        hist = s[4:].reshape(SUFFIXES, 64)
        mass = np.cumsum(hist.sum(0))
        self.cuts = [int(np.searchsorted(mass, mass[-1] * i / BANDS)) for i in range(1, BANDS)]
        band = np.searchsorted(self.cuts, np.arange(64), side="left")
        self.mass = np.zeros(CLASSES)
        for b in range(BANDS):
            self.mass[np.arange(SUFFIXES) * BANDS + b] = hist[:, band == b].sum(1)
        self.mass[END] = ends
        # a word seen once stands for the unseen half of the time
        self.prior = self.mass.copy()
        self.prior[UNKNOWN] = 0.5 * once
        self.prior = (self.prior + 0.5) / (self.prior + 0.5).sum()

    def describe(self, c: np.ndarray, f: np.ndarray):
        """Per word: class, context hash, log10 base probability, log10 probability in its class."""
        s = (f & 255).astype(np.int64)
        cls = np.minimum(s, SUFFIXES - 1) * BANDS + np.searchsorted(self.cuts, _band_hist(c), side="left")
        cls[s == 255] = END
        cls[c == 0] = UNKNOWN
        base = np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))
        own = np.where(cls < END, np.log10(np.maximum(c, 1) / np.maximum(self.mass[cls], 1)), 0.0)
        return cls.astype(np.uint8), f >> 8, base, own


def _added(batches):
    """The sum of the statistics that come to this task."""
    total = None
    for b in batches:
        for a in b.column(0).to_pylist():
            x = np.frombuffer(a, dtype="<f8")
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["a"])


TOKEN_SCHEMA = "batch int, ids binary, flags binary, lens binary, sums binary, classes binary, contexts binary"


def _pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def _assemble(stats: Statistics):
    def build(a, b):
        c = np.frombuffer(b"".join(a), dtype="<i8")
        return c, *stats.describe(c, np.frombuffer(b"".join(b), dtype="<u4"))

    @trimmed
    def run(batches):
        for (c, cls, ctx, base, own), ids, flags, lens, at in joined(batches, build):
            starts = np.cumsum(lens) - lens  # never empty: each text has its end
            sums = np.stack([np.add.reduceat(base[at], starts), np.add.reduceat(own[at], starts), np.add.reduceat((c[at] > 0).astype(float), starts)])
            once = (c[at] == 1) & (cls[at] != END)
            batch = zlib.crc32(ids.tobytes()) % BATCHES  # the same in every run
            yield record_batch([(batch, ids.tobytes(), flags.tobytes(), lens.astype("<i4").tobytes(), sums.astype("<f8").tobytes(), _pack(cls[at]), _pack((ctx[at] | once.astype("<u4") << 31).astype("<u4")))], TOKEN_SCHEMA)

    return run


def _chunks(batches, size: int):
    """ids, flags, lens, sums, classes, seen-once flags, and the three feature rows (of size rows each) of every token."""
    for b in batches:
        for _, ids, flags, lens, sums, classes, contexts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lens = np.frombuffer(lens, dtype="<i4").astype(np.int64)
            x = _unpack(contexts, "<u4")
            once, ctx = x >> 31 == 1, (x & 0x7FFFFFFF).astype(np.int64)
            start = np.cumsum(lens) - lens
            p1 = np.concatenate(([0], ctx[:-1]))
            p1[start] = 0
            p2 = np.concatenate(([0], p1[:-1]))
            p2[start] = 0
            pair = ((p1 * 0x9E3779B1 + p2 * 0x85EBCA6B) >> 7) % 0x7FFFFFFF
            rows = np.stack([p1 % size, size + pair % size, 2 * size + p2 % size])
            yield np.frombuffer(ids, dtype="<i8"), np.frombuffer(flags, dtype=np.uint8), lens, np.frombuffer(sums, dtype="<f8").reshape(3, -1), _unpack(classes, np.uint8).astype(np.int64), once, rows


def _probabilities(theta: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(theta, rows[0], axis=0)
    z += np.take(theta, rows[1], axis=0)
    z += np.take(theta, rows[2], axis=0)
    z += bias
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], dtype=z.dtype)))[:, None]
    return z


def _slices(table: np.ndarray):
    for k, part in enumerate(np.array_split(table.astype("<f4"), SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "sums"])


def _training(batches, size: int):
    """Classes, seen-once flags and feature rows of the training tokens, in pieces of many tokens a row."""
    step = 8 * size
    for _, flags, lens, _, cls, once, rows in _chunks(batches, size):
        use = np.repeat(flags & 1 == 1, lens)
        cls, once, rows = cls[use], once[use], rows[:, use]
        for a in range(0, len(cls), step):
            yield cls[a : a + step], once[a : a + step], rows[:, a : a + step]


def _add_seen(out: np.ndarray, cls: np.ndarray, once: np.ndarray, rows: np.ndarray) -> None:
    """Adds how often each feature row meets each class; a word seen once is half its class, half unknown. out is flat."""
    w = np.where(once, 0.5, 1.0)
    for r in rows:
        at = np.concatenate([r * CLASSES + cls, r[once] * CLASSES + UNKNOWN])
        np.add.at(out, at, np.concatenate([w, np.full(int(once.sum()), 0.5)]))


def _observed(size: int):
    @trimmed
    def run(batches):
        out = np.zeros(FEATURES * size * CLASSES)
        for cls, once, rows in _training(batches, size):
            _add_seen(out, cls, once, rows)
        yield from _slices(out.reshape(-1, CLASSES))

    return run


def _gradient(theta, bias, size: int):
    """What is there less what the model expects, for every feature row and class."""

    @trimmed
    def run(batches):
        t, b = theta.value, bias.value
        seen = np.zeros(FEATURES * size * CLASSES)
        expected = np.zeros((FEATURES, CLASSES, size))
        for cls, once, rows in _training(batches, size):
            _add_seen(seen, cls, once, rows)
            p = np.ascontiguousarray(_probabilities(t, b, rows).T)
            for f, x in enumerate(rows):
                x = x - f * size
                for c in range(CLASSES):
                    expected[f, c] += np.bincount(x, p[c], size)
        yield from _slices(seen.reshape(-1, CLASSES) - expected.transpose(0, 2, 1).reshape(-1, CLASSES))

    return run


def _total(batches):
    """Sums of the slices that come to this task, one table a slice."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(s, dtype="<f4").astype(np.float64)
            if k in sums:
                sums[k] += x
            else:
                sums[k] = x
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["slice", "sums"])


def _gather(data: DataFrame, step, size: int) -> np.ndarray:
    """The sum over all tasks of a weight-sized table: added slice by slice, collected once (its size is the model's)."""
    rows = data.mapInArrow(step, "slice int, sums binary").repartition(min(SLICES, shuffle_partitions(data.sparkSession)), "slice").mapInArrow(_total, "slice int, sums binary").collect()
    out = np.zeros((FEATURES * size, CLASSES))
    for k, part in enumerate(np.array_split(np.arange(FEATURES * size), SLICES)):
        for r in rows:
            if r["slice"] == k:
                out[part] = np.frombuffer(r["sums"], dtype="<f4").reshape(-1, CLASSES)
    return out


def fit(data: DataFrame, stats: Statistics, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature rows x classes) and class biases."""
    sc = data.sparkSession.sparkContext
    size = table_rows(stats.n)
    bias = np.log(stats.prior).astype(np.float32)
    # a task sends a whole table: it gets tokens for many, and all cores a task as far as that allows
    parts = data.rdd.getNumPartitions()
    tasks = lambda n: min(parts, max(min(sc.defaultParallelism, 16), n // (size * 256)))
    seen = _gather(data.coalesce(tasks(stats.n)), _observed(size), size)
    n = seen.sum(1, keepdims=True)
    theta = np.log((seen + DAMPING * stats.prior) / ((n + DAMPING) * stats.prior)) / FEATURES
    start = theta.copy()
    for k in range(epochs * BATCHES):
        t, b = sc.broadcast(theta.astype(np.float32)), sc.broadcast(bias)
        some = data.where(F.col("batch") == k % BATCHES).coalesce(tasks(stats.n // BATCHES))
        g = _gather(some, _gradient(t, b, size), size) * BATCHES - DAMPING / 4 * (theta - start)
        theta += RATE / FEATURES * g / (np.maximum(seen, np.abs(g)) + DAMPING)
        t.unpersist()
    return theta.astype(np.float32), bias


def _score(theta, bias):
    @trimmed
    def run(batches):
        t, b = theta.value, bias.value
        for ids, flags, lens, sums, cls, _, rows in _chunks(batches, len(t) // FEATURES):
            log = np.empty(rows.shape[1])
            for a in range(0, rows.shape[1], STEP_TOKENS):
                p = _probabilities(t, b, rows[:, a : a + STEP_TOKENS])
                log[a : a + STEP_TOKENS] = np.log10(np.maximum(p[np.arange(len(p)), cls[a : a + STEP_TOKENS]], 1e-30))
            score = np.add.reduceat(log, np.cumsum(lens) - lens) + sums[1]
            null = (flags & 2).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array((flags == 0).tolist(), pa.bool_()), pa.array(lens, pa.int64()), pa.array(sums[2].astype(np.int64), pa.int64()), pa.array(sums[0], pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, learn: Column | None = None, epochs: int = EPOCHS, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    learn says which rows train (default: crc32(doc_id as text) mod 10 is not
    0); held_out rows are those that do not, but for null doc_ids, which neither
    train nor are held out. score is log10 P(text) of the model, base_score that
    of smoothed word frequencies. A null or empty text is its end alone. Without
    training rows every word is unknown.
    """
    spark = docs.sparkSession
    flag = crc_bucket(F.col("doc_id"), 10) != 0 if learn is None else learn
    flag = F.when(F.col("doc_id").isNull(), False).otherwise(flag)
    parts = max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    words, texts = block_tables(docs, parts, tokens, flag, chars)
    words = words.repartition(parts, "part").sortWithinPartitions("part", "block")
    found = materialise(words.mapInArrow(_count, COUNT_SCHEMA), "counts")
    partly = found.where("block = -1").select("a").mapInArrow(_added, "a binary").repartition(SLICES).mapInArrow(_added, "a binary")
    stats = Statistics([r["a"] for r in partly.collect()])  # a row a task of the last stage
    data = materialise(meet(found.where("block >= 0"), texts, parts).mapInArrow(_assemble(stats), TOKEN_SCHEMA), "tokens", GROUP_BYTES)
    release(found)
    theta, bias = (spark.sparkContext.broadcast(x) for x in fit(data, stats, epochs))
    scored = data.mapInArrow(_score(theta, bias), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(stats.n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
