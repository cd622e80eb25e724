"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed rows for the word and its first three,
four and five letters. Filters of width one to three run over the words, the
maximum of each over the whole text goes through a ReLU into a logistic unit.
All weights start at random; training is by minibatches, with Adagrad steps, on a
bounded sample of labelled rows. Each language's
decision threshold comes from all usable labelled rows, counted by label,
language and logit, and is mapped to the same score. The language is guessed from
the text's function words, never read from a column.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import bounded_batches, crc_bucket, materialise, trimmed

ROWS = 1 << 17
DIM = 8
FILTERS = 4
WIDTHS = (1, 2, 3)
COLUMNS = FILTERS * sum(WIDTHS)
#: At most so many labelled documents of each label are collected for training, those with the least hashed ids.
SAMPLE = 3000
THRESHOLD = 0.7
#: Logits are counted in steps of 1 / STEPS between -LARGEST and LARGEST, so that the counts are bounded at any input size.
STEPS = 64
LARGEST = 64
PAD = 3  # zero words after a text: every filter has a position, also in an empty one

# Frequent function words of the languages that have a threshold of their own.
FUNCTION_WORDS = (
    frozenset("the of and to in is that for on with are was by this it be as at".split()),
    frozenset("le la les des et du une est dans que pour qui par sur au ce".split()),
    frozenset("der die das und den von zu mit dem ist im nicht auf ein eine".split()),
    frozenset("el los las y del que por con una es se al lo como su".split()),
)
_WORD = re.compile(r"\w+")


def _rows(word: str) -> tuple[int, ...]:
    """Hashed rows of a lower-case word; row 0 is always zero."""
    keys = (f"w{word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}")
    return tuple(1 + xxhash.xxh32_intdigest(k.encode()) % (ROWS - 1) for k in keys)


def _tongue(word: str) -> int:
    """Bits of the languages that have the word."""
    return sum(1 << i for i, s in enumerate(FUNCTION_WORDS) if word in s)


class _Words(dict):
    def __init__(self) -> None:
        self.rows: list[tuple[int, ...]] = []
        self.tongue: list[int] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self.rows)
        self.rows.append(_rows(word))
        self.tongue.append(_tongue(word))
        return i


def _language(words: np.ndarray, tongue: np.ndarray) -> int:
    """Index of the language with most function words, the last index + 1 if there are none."""
    bits = tongue[words]
    n = [int(((bits >> i) & 1).sum()) for i in range(len(FUNCTION_WORDS))]
    return int(np.argmax(n)) if any(n) else len(n)


class TextCNN:
    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.02, (ROWS, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = [r.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.v = np.full(FILTERS * len(WIDTHS), 0.5, dtype=np.float32)
        self.c = np.float32(-1.0)
        self.limit = np.zeros(len(FUNCTION_WORDS) + 1)
        self.learnt: frozenset[int] = frozenset()

    def _conv(self, x: np.ndarray) -> np.ndarray:
        """Responses at each position, for x with PAD zero rows at the end."""
        n = len(x) - PAD
        out = np.empty((n, FILTERS * len(WIDTHS)), dtype=np.float32)
        for i, (k, w) in enumerate(zip(WIDTHS, self.w, strict=True)):
            out[:, i * FILTERS : (i + 1) * FILTERS] = sum(x[j : j + n] @ w[j] for j in range(k))
        return out

    def fit(self, texts: list[str], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.1, seed: int = 1) -> TextCNN:
        """Three quarters of the examples train, the rest calibrates the thresholds (train() does that again over all rows)."""
        if not texts or len(set(labels)) < 2:
            return self
        words = _Words()
        docs = [np.fromiter(map(words.__getitem__, _WORD.findall(t.lower())), dtype=np.int64) for t in texts]
        table, tongue = np.array(words.rows or [(0, 0, 0, 0)]), np.array(words.tongue or [0])
        y = np.array(labels, dtype=np.float32)
        part = np.array([xxhash.xxh32_intdigest(t.encode()) % 4 for t in texts])
        train = np.flatnonzero(part > 0) if len(set(labels[i] for i in np.flatnonzero(part > 0))) == 2 else np.arange(len(y))
        n1, n0 = y[train].sum(), len(train) - y[train].sum()
        pos = n0 / max(n1, 1)
        r = np.random.default_rng(seed)
        ge = np.full((ROWS, 1), 1e-2, dtype=np.float32)
        gw = [np.full_like(w, 1e-2) for w in self.w]
        gv, gc = np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            order = r.permutation(train)
            for a in range(0, len(order), batch):
                ids = order[a : a + batch]
                rows = np.concatenate([np.concatenate([table[docs[i]].reshape(-1, 4), np.zeros((PAD, 4), dtype=np.int64)]) for i in ids])
                start = np.concatenate(([0], np.cumsum([len(docs[i]) + PAD for i in ids])))
                x = self.e[rows].sum(1)
                x = np.concatenate([x, np.zeros((PAD, DIM), dtype=np.float32)])
                act = self._conv(x)
                # a filter of width k stops k - 1 rows before the text's padding ends, so that no other text is seen
                at = np.stack([np.concatenate([act[s : z - k + 1, i * FILTERS : (i + 1) * FILTERS].argmax(0) + s for i, k in enumerate(WIDTHS)]) for s, z in zip(start[:-1], start[1:], strict=True)])
                h = np.take_along_axis(act, at, 0)
                up = h > 0
                h = h * up
                p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
                d = (p - y[ids]) * np.where(y[ids] > 0, pos, 1) / len(ids)
                dh = d[:, None] * self.v * up
                g = d @ h
                gv += g * g
                self.v -= rate * g / np.sqrt(gv)
                s = float(d.sum())
                gc += s * s
                self.c -= np.float32(rate * s / np.sqrt(gc))
                touched, grads = [], []
                for i, k in enumerate(WIDTHS):
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    for j in range(k):
                        where = at[:, cols] + j
                        g = np.einsum("nf,nfd->df", dh[:, cols], x[where])
                        touched.append(where.ravel())
                        grads.append((dh[:, cols][:, :, None] * self.w[i][j].T[None]).reshape(-1, DIM))
                        gw[i][j] += g * g
                        self.w[i][j] -= rate * g / np.sqrt(gw[i][j])
                where, grad = np.concatenate(touched), np.concatenate(grads)
                ok = where < len(rows)
                flat, inv = np.unique(rows[where[ok]].ravel(), return_inverse=True)
                total = np.zeros((len(flat), DIM), dtype=np.float32)
                np.add.at(total, inv.ravel(), np.repeat(grad[ok], 4, axis=0))
                ge[flat] += (total**2).sum(1, keepdims=True)
                self.e[flat] -= rate * total / np.sqrt(ge[flat])
                self.e[0] = 0
        self.learnt = frozenset(_key(texts[i]) for i in train)
        parts = self._words(table)
        counts = Counter((labels[i], _language(docs[i], tongue), int(_step(self._logit(parts, docs[i]))), _key(texts[i]) in self.learnt) for i in range(len(y)))
        return self.calibrate([(*k, n) for k, n in counts.items()])

    def calibrate(self, counts: list[tuple[int, int, int, bool, int]]) -> TextCNN:
        """Sets the thresholds from rows (label, language, logit in steps, whether the text trained the net, number of rows).

        What trained the net has logits that are too good, so logits are taken
        from the other rows, weighted to the number of all rows of their label
        and language. Without other rows of both labels, all logits are taken.
        """
        if not counts:
            return self
        y, tongue, step, learnt, n = np.array(counts, dtype=np.int64).T
        use = learnt == 0
        if len(set(y[use])) < 2:
            use = np.ones(len(y), dtype=bool)
        if len(set(y[use])) < 2:
            return self

        def best(own: np.ndarray) -> float:
            total = [n[own & (y == k)].sum() / max(n[own & use & (y == k)].sum(), 1) for k in (0, 1)]
            at = own & use
            z, inv = np.unique(-step[at], return_inverse=True)
            weight = [np.bincount(inv, n[at] * (y[at] == k) * total[k], len(z)) for k in (0, 1)]
            return _threshold(-z / STEPS, weight[1], weight[0])

        self.limit[:] = best(np.ones(len(y), dtype=bool))
        for k in range(len(self.limit)):
            own = tongue == k
            if all(n[own & use & (y == v)].sum() >= 10 for v in (0, 1)):
                self.limit[k] = best(own)
        return self

    def _words(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to the filters at each offset: (words, COLUMNS)."""
        x = self.e[rows].sum(1)
        return np.concatenate([x @ w[j] for w in self.w for j in range(len(w))], axis=1)

    def _logit(self, parts: np.ndarray, words: np.ndarray) -> float:
        g = np.zeros((len(words) + PAD, COLUMNS), dtype=np.float32)
        g[: len(words)] = parts[words]
        n, col, top = len(words), 0, []
        for k in WIDTHS:
            s = g[: n + PAD - k + 1, col : col + FILTERS]
            for j in range(1, k):
                s = s + g[j : j + len(s), col + j * FILTERS : col + (j + 1) * FILTERS]
            top.append(s.max(0))
            col += k * FILTERS
        return float(np.maximum(np.concatenate(top), 0) @ self.v + self.c)

    def marker(self, most: int = 100_000):
        """A function from texts to their logits and languages. It keeps at most so many words."""
        state: dict = {}

        def fresh() -> None:
            state.update(words=_Words(), parts=np.zeros((0, COLUMNS), dtype=np.float32), tongue=np.zeros(0, dtype=np.int64))

        fresh()

        def mark(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if len(state["words"].rows) > most:
                fresh()
            words = state["words"]
            docs = [np.fromiter(map(words.__getitem__, _WORD.findall(t.lower())), dtype=np.int64) for t in texts]
            n = len(state["parts"])
            if len(words.rows) > n:
                state["parts"] = np.concatenate([state["parts"], self._words(np.array(words.rows[n:]))])
                state["tongue"] = np.concatenate([state["tongue"], np.array(words.tongue[n:], dtype=np.int64)])
            return np.array([self._logit(state["parts"], d) for d in docs], dtype=np.float64), np.array([_language(d, state["tongue"]) for d in docs], dtype=np.int32)

        return mark

    def scorer(self, most: int = 100_000):
        """A function from texts to scores in 0 to 1, where THRESHOLD is each language's threshold. It keeps at most so many words."""
        mark = self.marker(most)

        def score(texts: list[str]) -> np.ndarray:
            logits, tongues = mark(texts)
            return _mapped(logits, tongues, self.limit)

        return score


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def _step(logits):
    return np.rint(np.clip(np.asarray(logits, dtype=np.float64), -LARGEST, LARGEST) * STEPS).astype(np.int32)


def _mapped(logits: np.ndarray, tongues: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Scores in 0 to 1, THRESHOLD at each language's threshold."""
    return 1 / (1 + np.exp(-np.clip(logits - limit[tongues] + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def _threshold(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Of distinct logits z, the highest first, and the rows of each: the cut with the best F1, in the middle of the gap below it."""
    hit = np.cumsum(toxic)
    f1 = 2 * hit / (hit + np.cumsum(clean) + toxic.sum())
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def _labelled(labels: DataFrame, label: str = "toxic", usable=None) -> DataFrame:
    """doc_id and y of all labelled documents, once each."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, usable=None) -> list[tuple[str, int]]:
    """At most `sample` (text, label) rows of each label, those with the least hashed doc_ids; ids are chosen before texts are read."""
    rows = _labelled(labels, label, usable)
    ids = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = ids[0].unionByName(ids[1]).select(F.col("doc_id").alias("t_id"), "y")
    got = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("t_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").dropDuplicates(["doc_id"]).collect()
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]


def _usable(held_out_part: int | None):
    return None if held_out_part is None else crc_bucket(F.col("doc_id"), 3) != held_out_part


def _net(docs: DataFrame, labels: DataFrame, held_out_part: int | None, sample: int) -> TextCNN:
    """The net, with thresholds from its sample only."""
    rows = training_rows(docs, labels, sample=sample, usable=_usable(held_out_part))
    return TextCNN().fit([t for t, _ in rows], [y for _, y in rows])


def _marks(docs: DataFrame, model: TextCNN) -> DataFrame:
    """doc_id, logit, tongue (index of the language) and learnt (whether the text trained the net), a row per row; a map."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fitted = spark.sparkContext.broadcast(model)

    @trimmed
    def run(batches):
        mark, learnt = fitted.value.marker(), fitted.value.learnt
        for b in batches:
            texts = b.column(1).to_pylist()
            logits, tongues = mark(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logits, pa.float64()), pa.array(tongues, pa.int32()), pa.array([_key(t) in learnt for t in texts], pa.bool_())], names=["doc_id", "logit", "tongue", "learnt"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, logit double, tongue int, learnt boolean")


def _calibrated(model: TextCNN, marks: DataFrame, labels: DataFrame, held_out_part: int | None) -> TextCNN:
    """model with thresholds from all usable labelled rows. The join has no texts; as many counts as there are logit steps come to the driver at most."""
    rows = _labelled(labels, usable=_usable(held_out_part)).select(F.col("doc_id").alias("l_id"), "y")
    step = F.rint(F.greatest(F.least(F.col("logit"), F.lit(float(LARGEST))), F.lit(float(-LARGEST))) * STEPS).cast("int").alias("step")
    counts = marks.join(rows, F.col("doc_id") == F.col("l_id")).groupBy("y", "tongue", step, "learnt").count().collect()
    return model.calibrate([tuple(r) for r in counts])


def train(docs: DataFrame, labels: DataFrame, held_out_part: int | None = 1, sample: int = SAMPLE) -> TextCNN:
    """The classifier, from labelled rows with crc32(doc_id as text) mod 3 other than held_out_part: the net is trained on the driver on at most `sample` rows of each label, the thresholds come from all rows."""
    model = _net(docs, labels, held_out_part, sample)
    usable = F.col("doc_id").isNotNull() if held_out_part is None else _usable(held_out_part)
    return _calibrated(model, _marks(docs.where(usable), model), labels, held_out_part)


def score(docs: DataFrame, model: TextCNN, text: str = "text", out: str = "score") -> DataFrame:
    """docs plus the score of each whole text (null or empty: that of no words). Rows stay as they are; a column named out is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    bounded_batches(spark)
    df = docs.select([F.col(f"`{c}`") for c in docs.columns if c != out])
    i = df.columns.index(text)
    fitted = spark.sparkContext.broadcast(model)  # ROWS x DIM floats: 4 MB

    @trimmed
    def run(batches):
        rate = fitted.value.scorer()
        for b in batches:
            s = rate([t or "" for t in b.column(i).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; without labels of both kinds every score is that of an untrained net.

    A null doc_id is never held out and never a training row; null and empty
    texts get the score of no words; repeated rows each get a row.
    """
    part = 1
    model = _net(docs, labels, part, SAMPLE)
    marks = materialise(_marks(docs, model), "toxicity")
    limit = _calibrated(model, marks, labels, part).limit

    def run(batches):
        for b in batches:
            s = _mapped(b.column(1).to_numpy(), b.column(2).to_numpy(), limit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == part, F.lit(False))
    scored = marks.select("doc_id", "logit", "tongue").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
