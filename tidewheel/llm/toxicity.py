"""Toxicity by a convolutional text classifier in numpy.

Words (A-Z lower-cased, without signs) are embedded by the sum of hashed rows:
two of the word, so that two words look alike only if both meet, and one for
each of its beginnings of ``HEADS`` bytes, so that inflected forms are known too.  Filters
of several widths slide over the text, each keeps its largest response, and a
logistic layer weighs those.  The model is fitted on all labelled rows.  They
are dealt by a hash of their ids into parts of some ``PART_ROWS``: one part trains a first model, all others train
on from it, and their models are averaged: of a row of the embeddings, those of the parts that have met it.  Results do
not depend on partitions.  Scoring reads every whole text, once, in Arrow batches, with no shuffle.

A decision threshold is calibrated for each language on a fifth of all labelled rows, set
aside (a language with less than ``LEAST_LABELS`` of either label there has the common one), and scores are shifted by it so that 0.5 is the threshold everywhere.  The
language is guessed from the text by word counts; the table's own column is only what the guess learns from.

Defined results: null and empty texts have no words and get the score of a
text without any response; repeated rows and null ids are scored row by row;
repeated labels of one id count once, toxic if any says so; of an id with several texts the longest, then the least teaches; rows without a
label teach nothing; without labels of both kinds every score is 0; very long texts are scored whole; of equally good thresholds the
one next to 0 is taken; an empty table gives an
empty result; extra input columns are dropped by ``scores`` and kept, whatever their names, by ``without_toxic``.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import textkit
from tidewheel.llm.scratch import doc_hash, free, numbered, save, small_batches
from tidewheel.operators.stats import running_sums

#: Log2 of embedding rows; embedding size; filter widths; filters of each; passes of the first part over its rows, and of the others.
BITS, DIM, WIDTHS, FILTERS, EPOCHS, LATER = 17, 8, (1, 2, 3), 8, 6, 2
#: Labelled rows of a part, and bytes of their texts, on average at most; labelled ids that are sent to the texts (more meet them by a shuffle); blocks of the embeddings.
PART_ROWS, PART_BYTES, SENT_IDS, BLOCKS = 6000, 32 << 20, 1 << 20, 16
BATCH, RATE, POSITIVE_WEIGHT, DROPPED, SEED = 64, 0.05, 1.5, 0.3, 7
#: Rows of each label that a language needs among those set aside for a threshold of its own.
LEAST_LABELS = 5
HEADS, PAD = (4, 5, 6, 7), max(WIDTHS) - 1


def rows_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, row offsets) of runs of rows; a column of hashes for each word: itself, then its heads."""
    with np.errstate(over="ignore"):
        for _, data, offsets in textkit.chunks(texts):
            hashes, starts, ends, bounds = textkit.words(data, offsets, textkit.SIGNS)
            yield np.vstack([hashes[None], textkit.heads(data, starts, ends, HEADS)]), bounds


def padded(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows for each position, row starts, and which positions are words: rows end in PAD blanks."""
    n, rows = np.diff(bounds), len(bounds) - 1
    starts = bounds[:-1] + PAD * np.arange(rows)
    at = np.arange(hashes.shape[1]) + PAD * np.repeat(np.arange(rows), n)
    size = hashes.shape[1] + PAD * rows
    ids = np.full((len(hashes) + 1, size), 1 << BITS, dtype=np.int64)
    ids[:-1, at] = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    ids[-1, at] = (hashes[0] & np.uint64((1 << BITS) - 1)).astype(np.int64)
    is_word = np.zeros(size, dtype=bool)
    is_word[at] = True
    return ids, starts, is_word


class Cnn:
    """Hashed embeddings, filters of several widths, max pooling, a logistic layer."""

    def __init__(self, rng: np.random.Generator):
        self.table = np.zeros(((1 << BITS) + 1, DIM), dtype=np.float32)
        self.table[:-1] = rng.normal(0, 0.1, (1 << BITS, DIM))
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(-2)
        self.squares: dict = {}
        self.rng = rng

    def rest(self) -> list[np.ndarray]:
        """All weights but the embeddings, and their sums of squares."""
        names = ["bias", *[f"filter{k}" for k in range(len(WIDTHS))], "out"]
        own = [self.bias, *self.filters, self.out]
        return [*own, *[self.squares.get(n, np.full_like(x, 1e-6)) for n, x in zip(names, own, strict=True)], np.array([self.shift])]

    def set_rest(self, flat: np.ndarray) -> None:
        shapes = [x.shape for x in self.rest()]
        parts = [x.reshape(shape).copy() for x, shape in zip(np.split(flat, np.cumsum([math.prod(x) for x in shapes])[:-1]), shapes, strict=True)]
        k = len(WIDTHS) + 2
        self.bias, *self.filters, self.out = parts[:k]
        self.squares |= dict(zip(["bias", *[f"filter{i}" for i in range(k - 2)], "out"], parts[k:-1], strict=True))
        self.shift = np.float32(parts[-1][0])

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[ids[0]]
        for h in ids[1:]:
            x = x + self.table[h]
        return x

    def responses(self, ids: np.ndarray, is_word: np.ndarray) -> list[np.ndarray]:
        x = self.vectors(ids)
        found = []
        for f, b, w in zip(self.filters, self.bias, WIDTHS, strict=True):
            y = x @ f[0] + b
            for j in range(1, w):
                y[:-j] += x[j:] @ f[j]
            y[~is_word] = 0
            found.append(np.maximum(y, 0, out=y))
        return found

    def logits(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        ids, starts, is_word = padded(hashes, bounds)
        pooled = [np.maximum.reduceat(y, starts, axis=0) for y in self.responses(ids, is_word)]
        return np.concatenate(pooled, axis=1) @ self.out + self.shift

    def _step(self, name: str, value: np.ndarray, grad: np.ndarray, rows=...) -> None:
        """Adagrad on the given rows."""
        seen = self.squares.setdefault(name, np.full_like(value, 1e-6))
        seen[rows] += grad**2
        value[rows] -= RATE * grad / np.sqrt(seen[rows])

    def learn(self, hashes: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> None:
        ids, starts, is_word = padded(hashes, bounds)
        # Words that occur once would be learned by heart: at random places only some rows of a word are seen.
        ids = np.where(self.rng.random(ids.shape) < DROPPED, 1 << BITS, ids)
        found = self.responses(ids, is_word)
        pooled = np.concatenate([np.maximum.reduceat(y, starts, axis=0) for y in found], axis=1)
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.shift)))
        d = (p - toxic) * np.where(toxic == 1, POSITIVE_WEIGHT, 1) / len(toxic)
        back = np.outer(d, self.out) * (pooled > 0)
        ends = np.append(starts[1:], len(is_word))
        touched, grads, filter_grads = [], [], []
        for k, (f, w) in enumerate(zip(self.filters, WIDTHS, strict=True)):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            at = np.stack([starts[i] + found[k][starts[i] : ends[i]].argmax(axis=0) for i in range(len(starts))])
            fg = np.zeros_like(f)
            for j in range(w):
                pos = np.minimum(at + j, len(is_word) - 1)
                x = self.vectors(ids[:, pos])
                fg[j] = np.einsum("bf,bfd->df", own, x)
                g = own[:, :, None] * f[j].T[None]
                for h in ids:
                    touched.append(h[pos].ravel())
                    grads.append(g.reshape(-1, DIM))
            filter_grads.append(fg)
        self._step("bias", self.bias, np.stack([back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]))
        for k, fg in enumerate(filter_grads):
            self._step(f"filter{k}", self.filters[k], fg)
        self._step("out", self.out, d @ pooled)
        self.shift -= np.float32(RATE * d.sum())
        every, where = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(every), DIM), dtype=np.float32)
        np.add.at(total, where, np.concatenate(grads))
        self._step("table", self.table, total[every < 1 << BITS], every[every < 1 << BITS])


class Model:
    """The classifier, the language guess and the threshold of each language."""

    def __init__(self, cnn: Cnn, counts: dict[str, np.ndarray]):
        self.cnn, self.langs = cnn, sorted(counts)
        n = np.stack([counts[x] for x in self.langs], axis=1) + 0.5 if counts else np.full((1 << 15, 1), 0.5)
        self.words_by_lang = np.log(n / n.sum(axis=0)).astype(np.float32)
        self.cuts = np.zeros(n.shape[1], dtype=np.float32)

    def calibrate(self, best: dict[int, tuple[float, int, int]]) -> None:
        """Take the thresholds of ``best_cuts``."""
        every, bad, n = best.get(-1, (0.0, 0, 0))
        every = every if 0 < bad < n else 0.0
        for i in range(len(self.cuts)):
            own, bad, n = best.get(i, (0.0, 0, 0))
            self.cuts[i] = own if min(bad, n - bad) >= LEAST_LABELS else every

    @staticmethod
    def _best(logits: np.ndarray, toxic: np.ndarray, otherwise: float) -> float:
        """The cut with the fewest errors, midway between neighbours; ties go to the one next to 0.  The plain form of ``best_cuts``."""
        if not toxic.any() or toxic.all():
            return otherwise
        order = np.argsort(logits)
        x, y = logits[order], toxic[order]
        mids = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(y == 0)])[-1] - np.concatenate([[0], np.cumsum(y == 0)])
        between = np.concatenate([[True], x[1:] != x[:-1], [True]])  # no cut parts equal logits
        best = np.flatnonzero(between & (errors == errors[between].min()))
        return float(mids[best[np.argmin(np.abs(mids[best]))]])

    def raw(self, doc: np.ndarray) -> tuple[float, int]:
        """The logit of one text and its likeliest language."""
        bounds = np.array([0, doc.shape[1]])
        return float(self.cnn.logits(doc, bounds)[0]), int(self.guess(doc, bounds)[0])

    def guess(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The likeliest language of each row by its words."""
        each = np.vstack([self.words_by_lang[(hashes[0] >> np.uint64(49)).astype(np.int64)], np.zeros((1, self.words_by_lang.shape[1]), dtype=np.float32)])
        total = np.add.reduceat(each, bounds[:-1], axis=0, dtype=np.float64)
        total[np.diff(bounds) == 0] = 0
        return total.argmax(axis=1)

    def scores(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = self.cnn.logits(hashes, bounds).astype(np.float64) - self.cuts[self.guess(hashes, bounds)]
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The saved (key, text, lang, toxic, aside): one row for each labelled id that may be learned from."""
    named = labels.where("toxic is not null and doc_id is not null").where(doc_hash("doc_id") % 5 != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).where(F.col("doc_id").isNotNull() & (doc_hash("doc_id") % 5 != 0))
    met = texts.join(F.broadcast(named) if named.count() <= SENT_IDS else named, "doc_id")
    chosen = F.struct((-F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), "text", "lang")
    one = met.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(chosen).alias("d"))
    return save(one.select(F.xxhash64("doc_id").alias("key"), "d.text", "d.lang", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0).alias("aside")), "labelled")


def _docs(texts: pa.Array) -> list[np.ndarray]:
    return [h[:, a:b] for h, bounds in rows_of(texts) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


TRAINED = "part long, name string, found binary"


def _train_part(start) -> Callable:
    """What a part teaches, by name: embedding rows that it has met, with a count of 1 for each, the other weights, and words by language.

    The embeddings' sums of squares go along from the first part only, as nothing is trained after the others.
    """

    def train_part(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("key")
        docs, toxic, lang = _docs(rows.column("text").combine_chunks()), rows.column("toxic").to_numpy().astype(np.float32), rows.column("lang").to_pylist()
        train = np.flatnonzero(~rows.column("aside").to_numpy())
        rng = np.random.default_rng([SEED, key[0].as_py()])
        first = start.value is None
        cnn = Cnn(rng) if first else copy.deepcopy(start.value)
        cnn.rng = rng
        before = None if first else start.value.squares["table"]
        for _ in range(EPOCHS if first else LATER):
            order = rng.permutation(train)
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                bounds = np.concatenate([[0], np.cumsum([docs[j].shape[1] for j in part])])
                cnn.learn(np.concatenate([docs[j] for j in part], axis=1), bounds, toxic[part])
        found = {}
        if len(train):
            met = np.ones(1 << BITS) if first else (cnn.squares["table"][:-1] != before[:-1]).any(axis=1)
            learned = [cnn.table[:-1], cnn.squares["table"][:-1]] if first else [cnn.table[:-1]]
            sums = np.column_stack([*[x * met[:, None] for x in learned], met])
            found = {f"table {k}": x for k, x in enumerate(np.split(sums, BLOCKS))} | {"rest": np.append(np.concatenate([x.ravel() for x in cnn.rest()]), 1)}
        for x in sorted({x for x in lang if x is not None}):
            words = [(h[0] >> np.uint64(49)).astype(np.int64) for h, own in zip(docs, lang, strict=True) if own == x]
            found[f"lang {x}"] = np.bincount(np.concatenate(words), minlength=1 << 15)
        part = pa.array([key[0].as_py()] * len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([part, pa.array(list(found), pa.string()), pa.array([x.astype("<f8").tobytes() for x in found.values()], pa.binary())], ["part", "name", "found"])

    return train_part


def _mean(name: str, total: np.ndarray, width: int) -> np.ndarray:
    """What the driver gets of a sum over all parts: averages in single precision, with a 1 after each embedding row that was met; of a language its counts."""
    if name.startswith("lang "):
        return total
    rows = total.reshape(-1, width if name.startswith("table ") else len(total))
    return np.column_stack([rows[:, :-1] / np.maximum(rows[:, -1:], 1), rows[:, -1:] > 0]).astype("<f4")


def _added(width: int, last: bool) -> Callable:
    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, name = None, key[1].as_py()
        for batch in batches:
            for x in batch.column("found"):
                own = np.frombuffer(x.as_py(), dtype="<f8")
                total = own if total is None else total + own
        found = _mean(name, total, width) if last else total
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([name]), pa.array([found.tobytes()], pa.binary())], ["part", "name", "found"])

    return added


def _taught(rows: DataFrame, parts: int, start: Cnn | None) -> dict[str, np.ndarray]:
    """The averages over the parts of ``rows``: a row for each block of the model, and counts for each language."""
    shared = rows.sparkSession.sparkContext.broadcast(start)
    tasks, width = 1 if parts == 1 else 3 * parts, (2 * DIM if start is None else DIM) + 1  # with more tasks than parts few have two
    found = rows.repartition(tasks, "part").groupBy("part").applyInArrow(_train_part(shared), TRAINED)
    # No task adds up more than the root of the number of parts.
    for groups, last in ((max(1, math.isqrt(parts)), False), (1, True)):
        found = found.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part", "name").applyInArrow(_added(width, last), TRAINED)
    means = {r["name"]: np.frombuffer(r["found"], dtype="<f8" if r["name"].startswith("lang ") else "<f4") for r in found.collect()}
    shared.destroy()
    return means


def _averaged(cnn: Cnn, means: dict[str, np.ndarray]) -> Cnn:
    """``cnn`` with the averages of what parts have learned, which are taken out of ``means``; rows of the embeddings that none has met stay."""
    if "rest" not in means:
        return cnn
    size = (1 << BITS) // BLOCKS
    for k in range(BLOCKS):
        table = means.pop(f"table {k}").reshape(size, -1)
        met = np.flatnonzero(table[:, -1])
        cnn.table[k * size + met] = table[met, :DIM]
        if table.shape[1] > DIM + 1:
            cnn.squares.setdefault("table", np.full_like(cnn.table, 1e-6))[k * size + met] = table[met, DIM:-1]
    cnn.set_rest(means.pop("rest")[:-1])
    return cnn


def _judged(model) -> Callable:
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [model.value.raw(d) for d in _docs(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in found], pa.int32()), pa.array([x[0] for x in found], pa.float64()), batch.column("toxic")], ["lang", "logit", "toxic"])

    return judged


def best_cuts(found: DataFrame) -> dict[int, tuple[float, int, int]]:
    """By language, and for all as -1: the cut of (lang, logit, toxic) with the fewest errors, toxic rows, rows.

    A cut lies midway between neighbours, or by 1 outside of all; of equally good ones the one next to 0 is taken.  Errors are running sums over the logits;
    a cut is known by the rows below it, so the two logits around it meet without a window over a language.  What is collected has a row for each language.
    """
    c, n = F.col, F.lit(None).cast("double")
    every = found.select(F.explode(F.array("lang", F.lit(-1))).alias("lang"), "logit", "toxic")
    sums = running_sums(every, "logit", {"bad": F.sum("toxic"), "n": F.count("*")}, ("lang",))
    total = sums.groupBy("lang").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    under = sums.select("lang", c("n_before").alias("at"), c("bad_before").alias("missed"), n.alias("low"), c("logit").alias("high"))
    over = sums.select("lang", (c("n_before") + c("n")).alias("at"), (c("bad_before") + c("bad")).alias("missed"), c("logit").alias("low"), n.alias("high"))
    cuts = under.unionByName(over).groupBy("lang", "at").agg(*[F.max(x).alias(x) for x in ("missed", "low", "high")]).join(F.broadcast(total), "lang")
    middle = F.when(c("low").isNull(), c("high") - 1).when(c("high").isNull(), c("low") + 1).otherwise((c("low") + c("high")) / 2)
    errors = c("missed") + (c("n") - c("bad")) - (c("at") - c("missed"))
    best = cuts.groupBy("lang").agg(F.min(F.struct(errors, F.abs(middle), middle.alias("cut"))).alias("best"), F.max("bad").alias("bad"), F.max("n").alias("n"))
    return {r["lang"]: (r["cut"], r["bad"], r["n"]) for r in best.select("lang", "best.cut", "bad", "n").collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of all labelled rows; None without both kinds of label."""
    rows = _labelled(docs, labels, id_col, text_col)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("toxic").alias("kinds")).first()
    if size["kinds"] < 2:
        free(rows)
        return None
    parts = max(1, math.ceil(size["n"] / PART_ROWS), math.ceil((size["bytes"] or 0) / PART_BYTES))
    dealt = rows.withColumn("part", F.pmod("key", F.lit(parts)))
    # Once the averages are in the model only the counts of languages are held.
    counts = [_taught(dealt.where("part = 0"), 1, None)]
    cnn = _averaged(Cnn(np.random.default_rng(SEED)), counts[0])
    if parts > 1:
        counts.append(_taught(dealt.where("part > 0"), parts, cnn))
        cnn = _averaged(cnn, counts[1])
    cnn.squares, cnn.rng = {}, None
    names = {x for found in counts for x in found if x.startswith("lang ")}
    model = Model(cnn, {x[5:]: sum(found[x] for found in counts if x in found) for x in names})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model.calibrate(best_cuts(rows.where("aside").select("text", "toxic").mapInArrow(_judged(shared), "lang int, logit double, toxic int")))
    shared.destroy()
    free(rows)
    return model


def _score(model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.scores(h, b) for h, b in rows_of(batch.column(batch.num_columns - 1))]
            flat = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flat, pa.float64())], [*batch.schema.names[:-1], "score"])

    return score


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, numbered, and ``score``, 0 to 1."""
    model = fit(docs, labels, id_col, text_col)
    small_batches(docs.sparkSession)
    rows, (text, *kept) = numbered(docs, text_col, *keep)
    if model is None:
        return rows.select(*kept, F.lit(0.0).alias("score"))
    schema = rows.select(*kept).schema.add("score", "double")
    return rows.select(*kept, F.col(text).alias("text")).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1)."""
    return _scored(docs, labels, [id_col], id_col, text_col).toDF("doc_id", "score")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below one half, with all their columns unchanged."""
    return _scored(docs, labels, docs.columns, id_col, text_col).where("score < 0.5").drop("score").toDF(*docs.columns)
