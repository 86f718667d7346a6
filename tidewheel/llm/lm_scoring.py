"""Language-model scoring with a causal self-attention model, trained in numpy on subword ids.

The model: one layer of masked self-attention over a learned table of embeddings, queries,
keys and values with a bias for each distance, and a softmax in two levels (class, then id in its class) over the ``VOCAB``
most frequent ids; the rest share the probability of one more id by their counts
(one more than the true ones), so that all ids have one and all together 1.  A text is scored in overlapping windows of
``CONTEXT + STEP`` inputs: each window scores its last ``STEP`` positions, so every id is scored once and sees at
least ``CONTEXT`` ids before it, as far as there are so many.

Texts are encoded once.  The counts of ids over all training texts give the vocabulary.
Training texts are dealt out by a hash of id and text into parts of about ``PART_TEXTS``, in
one order, whatever partitions they come in.  One part trains a first model; from that all other parts go on, and their
models are averaged, weighted by their windows.  The first model takes ``LEAST`` steps at least, so where its part has few windows
it goes over them again, ``PASSES`` times at most; all other windows are learned from once.  So all windows of all training texts are learned from,
the result does not depend on how the table is partitioned, and the driver gets one model.

The base score needs the training count of every word.  Counts are exact and
stay distributed: the ``TOP`` most frequent words, a bounded table, are looked
up in the tasks, all others by a join on the word's 64-bit hash, after
equal words of a text are put together.

Defined results: null and empty texts have only the end; rows with null or
repeated ids are scored row by row; rows that repeat an id and a text count for each row, but train the model once;
without training rows every word is unknown
and the model gives all ids the same probability; very long texts are read whole, window by window; an empty table gives an empty result; extra
input columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import subwords, textkit
from tidewheel.llm.scratch import doc_hash, free, save, small_batches

#: Ids with a probability of their own, in CLASSES equal classes; sizes of embeddings and values, of queries and keys; inputs before the scored ones; scored ones.
VOCAB, CLASSES, DIM, HEAD, CONTEXT, STEP = 2304, 48, 24, 8, 8, 24
#: Training texts of a part; windows scored at once; windows of a step; windows that are mixed; counts kept in the tasks; texts handled at once.
PART_TEXTS, BATCH, FEW, MIXED, TOP, ROWS = 4096, 256, 64, 1 << 14, 1 << 16, 500
#: The first model's least steps, and how often it goes over its windows at most for that.
LEAST, PASSES = 3000, 16
LEARN, SEED = 5e-2, 5
SPAN, EACH, WIDTH = CONTEXT + STEP, VOCAB // CLASSES, 2 * (DIM + HEAD)
E, Q, K, V = (slice(a, b) for a, b in ((0, DIM), (DIM, DIM + HEAD), (DIM + HEAD, DIM + 2 * HEAD), (DIM + 2 * HEAD, WIDTH)))
_END = np.uint64(0)  # stands for the end among word hashes
_NEVER = np.float32(-1e9)


def shares(x: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Turn logits into their softmax over the last axis, in place; returns the log of the picked ones' shares.

    picked: logits, one of each row.  If all are far from where exp leaves its range no row needs its maximum
    taken off: a row's sum is at least exp of its picked logit and finite.
    """
    if x.size and not (x.max() < 60 and picked.min() > -60):
        top = x.max(axis=-1)
        x -= top[..., None]
        picked = picked - top
    np.exp(x, out=x)
    total = np.matmul(x, np.ones((x.shape[-1], 1), dtype=x.dtype))
    x *= 1 / total
    return picked - np.log(total[..., 0])


class Attention:
    """Parameters by name, forward and backward passes."""

    def __init__(self, counts: np.ndarray):
        """counts: of every id in the training texts.  Number 0 stands for all ids without a number of their own, VOCAB for what comes before a text."""
        rng, order = np.random.default_rng(SEED), np.argsort(-counts, kind="stable")
        ids = order[counts[order] > 0][: VOCAB - 1]
        self.number = np.zeros(len(counts), dtype=np.uint16)
        self.number[ids] = np.arange(1, len(ids) + 1)
        weight = (self.number == 0) * (counts + 1.0)
        self.share = np.where(weight > 0, np.log(np.maximum(weight, 1) / max(1.0, weight.sum())), 0)
        seen = np.zeros(VOCAB)
        np.add.at(seen, self.number, counts + 1.0)
        seen = seen.reshape(CLASSES, EACH)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        # Numbers that no id has, and classes of such, never get a probability; the others begin at their frequency.
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1) / seen.sum()), _NEVER).astype(np.float32)
        # The last column of an output's weights is its bias.
        biased = lambda w, b: np.concatenate([w, b[..., None]], axis=-1)
        self.p = {"t": draw(VOCAB + 1, WIDTH), "near": np.zeros(SPAN, dtype=np.float32), "c": biased(draw(CLASSES, DIM), log(seen.sum(axis=1))), "w": biased(draw(CLASSES, EACH, DIM), log(seen))}
        self.squares = {n: np.full_like(v, 1e-6) for n, v in self.p.items()}
        distance = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None]
        self.distance, self.future = np.maximum(distance, 0), distance < 0

    def windows(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (windows x SPAN), targets (windows x STEP; -1 past the end) and the row of each window."""
        n = np.diff(bounds)
        size = -(-n // STEP)
        row = np.repeat(np.arange(len(n)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        pad = lambda k: np.full(k, VOCAB, dtype=np.uint16)
        flat = np.concatenate([pad(CONTEXT + 1), self.number[ids], pad(STEP)])
        at = bounds[row] + nth * STEP
        x = flat[at[:, None] + np.arange(SPAN)]
        place = nth[:, None] * STEP + np.arange(-CONTEXT - 1, STEP - 1)
        x[(place < 0) | (place >= n[row][:, None])] = VOCAB
        y = flat[at[:, None] + CONTEXT + 1 + np.arange(STEP)].astype(np.int32)
        y[np.arange(STEP) >= (n[row] - nth * STEP)[:, None]] = -1
        return x, y, row

    def attend(self, x: np.ndarray) -> tuple:
        t = np.take(self.p["t"], x.ravel(), axis=0).reshape(len(x), SPAN, WIDTH)
        q, k, v = t[:, CONTEXT:, Q], t[:, :, K], t[:, :, V]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += np.where(self.future, _NEVER, self.p["near"][self.distance])
        # Each position sees itself, so its own logit is a bound below.
        shares(a, a[:, np.arange(STEP), np.arange(CONTEXT, SPAN)])
        h = np.empty((len(x), STEP, DIM + 1), dtype=a.dtype)
        h[:, :, DIM] = 1
        np.matmul(a, v, out=h[:, :, :DIM])
        h[:, :, :DIM] += t[:, CONTEXT:, E]
        return q, k, v, a, h

    def predict(self, h: np.ndarray, target: np.ndarray, back: bool = False) -> tuple:
        """Log probabilities of the targets; if asked, also the gradients of their mean loss by the output's parameters and by h."""
        p, n, every = self.p, len(target), np.arange(len(target))
        cls = (target // EACH).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        z, cls = h[order], cls[order].astype(np.int64)
        place, cuts = target[order] - cls * EACH, np.searchsorted(cls, np.arange(CLASSES + 1))
        mine = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c + 1] > cuts[c]]
        outer, inner = z @ p["c"].T, np.empty((n, EACH), dtype=z.dtype)
        for c, s in mine:
            np.matmul(z[s], p["w"][c].T, out=inner[s])
        found = np.zeros(n, dtype=z.dtype)
        for x, at in ((outer, cls), (inner, place)):
            found += shares(x, x[every, at])
            if back:
                x[every, at] -= 1
        out = np.empty_like(found)
        out[order] = found
        if not back:
            return (out,)
        z *= z.dtype.type(1 / max(1, n))
        g = {"c": outer.T @ z, "w": np.zeros_like(p["w"])}
        dz = outer @ p["c"][:, :DIM]
        for c, s in mine:
            g["w"][c] = inner[s].T @ z[s]
            dz[s] += inner[s] @ p["w"][c, :, :DIM]
        dz *= z.dtype.type(1 / max(1, n))
        dh = np.empty_like(dz)
        dh[order] = dz
        return out, g, dh

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets' numbers, 0 past the end."""
        out = np.zeros(y.shape)
        for i in range(0, len(x), BATCH):
            on = y[i : i + BATCH] >= 0
            out[i : i + BATCH][on] = self.predict(self.attend(x[i : i + BATCH])[-1][on], y[i : i + BATCH][on])[0]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the targets, by parameter."""
        on = y >= 0
        q, k, v, a, whole = self.attend(x)
        _, g, d = self.predict(whole[on], y[on], back=True)
        dh = np.zeros((*whole.shape[:2], DIM), dtype=whole.dtype)
        dh[on] = d
        dt = np.empty((len(x), SPAN, WIDTH), dtype=whole.dtype)
        dt[:, :CONTEXT] = 0
        dt[:, CONTEXT:, E] = dh
        dt[:, :, V] = np.matmul(a.transpose(0, 2, 1), dh)
        da = np.matmul(dh, v.transpose(0, 2, 1))
        da -= (da * a).sum(axis=2, keepdims=True)
        da *= a
        g["near"] = np.bincount(self.distance.ravel(), (da.sum(axis=0) * ~self.future).ravel(), SPAN).astype(whole.dtype)
        dt[:, CONTEXT:, Q] = np.matmul(da, k)
        dt[:, :, K] = np.matmul(da.transpose(0, 2, 1), q)
        # Rows of the table are summed up by number, in order.
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
        g["t"] = np.zeros_like(self.p["t"])
        g["t"][flat[order][first]] = np.add.reduceat(dt.reshape(-1, WIDTH)[order], first, axis=0)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, nth: int = 0) -> None:
        """Adagrad over every window once, in a fixed random order, another one for each pass."""
        mixed = np.random.default_rng(SEED + nth).permutation(len(x))
        for i in range(0, len(x), FEW):
            pick = mixed[i : i + FEW]
            for n, g in self.gradients(x[pick], y[pick]).items():
                self.squares[n] += g * g
                g *= g.dtype.type(LEARN)
                g /= np.sqrt(self.squares[n])
                self.p[n] -= g

    def packed(self) -> bytes:
        return np.concatenate([v.ravel() for d in (self.p, self.squares) for v in d.values()]).astype("<f4").tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.squares):
            for n, v in d.items():
                d[n] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size


def encode(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text and its end, and row offsets."""
    ids, bounds = subwords.coder(path).encode(texts)
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _encoded(path: str, end_id: int) -> Callable:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = packing(len(subwords.coder(path).closes))
        met: set[int] = set()  # rows that repeat an id and a text need not travel again
        for batch in parts(batches):
            ids, bounds = encode(batch.column("text"), path, end_id)
            data = pa.py_buffer(ids.astype(kind).tobytes())
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(kind.itemsize * bounds.astype(np.int64)), data]).cast(pa.binary())
            again = []
            for key in batch.column("key").to_pylist():
                again.append(key in met)
                met.add(key)
            learn = np.asarray(batch.column("learn").to_pylist(), dtype=bool) & ~np.array(again, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(learn), column], ["key", "learn", "ids"])

    return encoded


def packing(total: int) -> np.dtype:
    """How so many different ids are packed."""
    return np.dtype("<u2" if total <= 1 << 16 else "<u4")


def _flat(column: pa.Array, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and row offsets of a column of packed ids."""
    kind = packing(total)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]) // kind.itemsize


def _id_counts(total: int) -> Callable:
    def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(total, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_flat(batch.column("ids"), total)[0], minlength=total)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], ["id", "n"])

    return id_counts


def id_counts(training: DataFrame, total: int) -> np.ndarray:
    """How often each of the tokenizer's ids occurs in all training texts."""
    rows = training.select("ids").mapInArrow(_id_counts(total), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(total, dtype=np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _trained(model: Attention, start: bytes, rows: Iterator[tuple[np.ndarray, np.ndarray]], again: bool = False) -> int:
    """Train from ``start`` on all windows of the texts, in their order, however they are batched; returns the number of windows.

    ``again``: go over them until there were LEAST steps, at most PASSES times.  Only texts of fewer windows are held for that.
    """
    model.unpack(np.frombuffer(start, dtype="<f4"))
    held: list | None = [] if again else None

    def once(texts: Iterator[tuple[np.ndarray, np.ndarray]], nth: int) -> int:
        nonlocal held
        x, y, seen = [], [], 0
        for ids, bounds in texts:
            if held is not None and not nth:
                held.append((ids.copy(), bounds))
            for kept, new in zip((x, y), model.windows(ids, bounds), strict=False):
                kept.append(new)
            while sum(map(len, x)) >= MIXED:
                x, y = ([np.concatenate(v)] for v in (x, y))
                model.train(x[0][:MIXED], y[0][:MIXED], nth)
                x, y, seen = [x[0][MIXED:]], [y[0][MIXED:]], seen + MIXED
            if seen >= LEAST * FEW:
                held = None
        left = sum(map(len, x))
        if left:
            model.train(np.concatenate(x), np.concatenate(y), nth)
        return seen + left

    n = once(rows, 0)
    for nth in range(1, min(PASSES, -(-LEAST * FEW // n)) if held and n else 1):
        once(iter(held), nth)
    return n


def _train_parts(model, first_model: bool = False) -> Callable:
    def train_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The allocator keeps blocks up to the largest one that was ever freed: without this every large array is mapped anew.
        np.empty(31 << 20, dtype=np.uint8)
        own, start = model.value
        now, rest = None, iter([])

        def of_part() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The texts of the part ``now``, each key once; sets ``now`` to the next one, or to None."""
            nonlocal now, rest
            part, last = now, None
            now = None
            for batch in rest:
                number, keys = batch.column("part").to_numpy(), batch.column("key").to_numpy()
                n = int(np.searchsorted(number, part, side="right"))
                new = np.diff(keys[:n], prepend=keys[:1]) != 0
                new[:1] = last is None or keys[0] != last
                last = keys[n - 1] if n else last
                yield _flat(batch.column("ids").slice(0, n).filter(pa.array(new)), len(own.number))
                if n < batch.num_rows:
                    now, left, more = int(number[n]), batch.slice(n), rest
                    rest = (b for group in ([left], more) for b in group)
                    return

        for first in batches:
            if first.num_rows:
                now, rest = int(first.column("part")[0].as_py()), (b for group in ([first], batches) for b in group if b.num_rows)
                break
        while now is not None:
            part, seen = now, _trained(own, start, of_part(), first_model)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([own.packed()], pa.binary())], ["part", "weight", "model"])

    return train_parts


def _average(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0.0
    for batch in rows:
        for w, m in zip(batch.column("weight").to_pylist(), batch.column("model"), strict=True):
            own = np.frombuffer(m.as_py(), dtype="<f4").astype(np.float64) * w
            total, weight = own if total is None else total + own, weight + w
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([weight]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], ["part", "weight", "model"])


SCHEMA = "part long, weight double, model binary"


def fit(training: DataFrame, total: int, part_texts: int | None = None) -> Attention:
    """The model of all training texts (saved, columns key, ids; rows of one key are one text).  total: of the tokenizer's ids."""
    model = Attention(id_counts(training, total))
    n = math.ceil(training.select("key").distinct().count() / (part_texts or PART_TEXTS))
    texts = training.select(F.pmod(F.xxhash64("key"), F.lit(max(1, n))).alias("part"), "key", "ids")
    for first, some, tasks in ((True, texts.where("part = 0"), 1), (False, texts.where("part > 0"), 3 * n)):  # with more tasks than parts few have two
        shared = training.sparkSession.sparkContext.broadcast((model, model.packed()))
        trained = some.repartition(tasks, "part").sortWithinPartitions("part", "key").mapInArrow(_train_parts(shared, first), SCHEMA)
        for groups in (max(16, math.isqrt(n)), 16):  # no task adds up more than the root of the number of parts
            trained = trained.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(_average, SCHEMA)
        merged = sorted(trained.collect(), key=lambda r: r["part"])  # 16 rows at most
        if merged:
            weights = np.array([r["weight"] for r in merged])
            model.unpack(sum(np.frombuffer(r["model"], dtype="<f4") * w for r, w in zip(merged, weights / weights.sum(), strict=True)))
        shared.destroy()
    return model


def _text_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    with np.errstate(over="ignore"):
        for _, data, offsets in textkit.chunks(texts):
            hashes, _, _, bounds = textkit.words(data, offsets)
            yield np.where(hashes == _END, np.uint64(1), hashes), bounds


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 4 * ROWS):
        found = [h for h, _ in _text_words(batch.column("text"))]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), return_counts=True)
        h, n = np.append(h, _END), np.append(n, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _base(top) -> Callable:
    def base_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = top.value
        end = int(_lookup(np.zeros(1, dtype=np.uint64), words, counts)[0])
        for batch in parts(batches, 4 * ROWS):
            tokens, known, base, lists, sizes = ([] for _ in range(5))
            for h, b in _text_words(batch.column("text")):
                c = _lookup(h, words, counts)
                rows = len(b) - 1
                of = np.repeat(np.arange(rows), np.diff(b))
                tokens.append(np.diff(b) + 1)
                known.append(np.bincount(of, c > 0, rows) + (end > 0))
                base.append(np.bincount(of, np.log10(c + 1), rows) + np.log10(end + 1))
                lists.append(h[c == 0])
                sizes.append(np.bincount(of, c == 0, rows))
            tokens, known, base, sizes = (np.concatenate(v) if v else np.zeros(0) for v in (tokens, known, base, sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            rare = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).view(np.int64) if lists else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float)), rare], ["doc_id", "key", "n_tokens", "known", "base", "rare"]
            )

    return base_scores


def _score(model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(31 << 20, dtype=np.uint8)  # as in training
        attention = model.value
        for batch in parts(batches):
            ids, bounds = _flat(batch.column("ids"), len(attention.number))
            x, y, row = attention.windows(ids, bounds)
            total = np.bincount(row, attention.log_probs(x, y).sum(axis=1), batch.num_rows)
            total = total + np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(bounds)), attention.share[ids], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(total / np.log(10))], ["key", "score"])

    return score


def _lookup(h: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of those hashes that the sorted table has, else 0."""
    if not len(words):
        return np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, counts[at], 0)


def score_texts(docs: DataFrame, path: str, training: Column | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.  training: which rows to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    training = doc_hash(id_col) % 7 != 2 if training is None else training
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"), training.alias("learn"))
    counts = save(keyed.where("learn").select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = counts.orderBy(F.desc(F.col("word") == 0), F.desc("n"), "word").limit(TOP).toArrow()  # the end is always there
    words = often.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    top = spark.sparkContext.broadcast((words[order], often.column("n").to_numpy()[order]))
    encoded = save(keyed.select("key", "text", "learn").mapInArrow(_encoded(path, end_id), "key long, learn boolean, ids binary"), "encoded", compression="zstd")
    model = spark.sparkContext.broadcast(fit(encoded.where("learn").select("key", "ids"), subwords.coder(path).tokenizer.get_vocab_size()))
    scores = save(encoded.select("key", "ids").mapInArrow(_score(model), "key long, score double"), "scores")
    free(encoded)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    based = keyed.select("doc_id", "key", "text").mapInArrow(_base(top), f"doc_id {kind}, key long, n_tokens long, known long, base double, rare array<long>")
    based = save(based, "based", compression="zstd")
    model.destroy()
    top.destroy()
    # Rows that are equal in id and text have one key, and each takes its share of what the key sums up to.
    rare = based.select("key", F.explode("rare").alias("word"))
    met = rare.join(counts, "word").select("key", F.lit(1).alias("more_known"), F.log10(F.col("n") + 1).alias("more"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("copies"))
    own = scores.select("key", F.lit(0).alias("more_known"), F.lit(0.0).alias("more"), "score", F.lit(1).alias("copies"))
    extra = met.unionByName(own).groupBy("key").agg(F.sum("more_known").alias("more_known"), F.sum("more").alias("more"), F.max("score").alias("score"), F.sum("copies").alias("copies"))
    out = based.drop("rare").join(extra, "key")
    share = lambda c: F.col(c) / F.col("copies")
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.round(share("more_known"))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + share("more") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), "score"
    )
