"""Language identification by a linear-chain conditional random field.

Every word of a text gets a language.  Its features are the hashed word itself
(a lexicon), its first and last 2 to 4 bytes (affixes) and its byte 2- and
3-grams; weights are learned together with transitions between the languages of neighbouring
words, from texts that mix runs of words of several documents, as code-switched
text does.  Forward-backward gives each word's probabilities, and a
document's are their mean.

The model is fitted on at most ``SAMPLE`` rows of ``SAMPLE_BYTES``, taken by the least hash of
their ids.  Scoring reads every whole text once, in Arrow batches, with no
shuffle.  A text is laid out in blocks of words; each block's product of step
matrices carries the messages across it, so the steps of one long text run
side by side too, and the result is that of a plain forward-backward pass.

Defined results: null texts, and texts without a letter, are ``und`` with score
0; repeated rows and null ids are judged row by row; without rows to learn
from all texts are ``und``; very long texts are read whole; of equally likely languages the first by name
is taken; an empty table gives an empty result; extra input
columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import textkit
from tidewheel.llm.sampling import fitted, of_ids
from tidewheel.llm.scratch import doc_hash, small_batches

#: Rows to learn from, and bytes of their texts; log2 of weight rows; bytes of affixes and of n-grams; mixed texts a step, words in each, steps.
SAMPLE, SAMPLE_BYTES, BITS, AFFIXES, GRAMS, MIXED, LENGTH, STEPS = 2000, 64 << 20, 17, (2, 3, 4), (2, 3), 64, 48, 150
RATE, BLOCK, SEED = 0.3, 32, 11


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word a column of hashed word and affix ids; n-gram ids, where each word's begin, and row offsets of words."""
    hashes, starts, ends, bounds = textkit.words(data, offsets, textkit.SIGNS)
    total = textkit.byte_sums(data)
    low = np.uint64((1 << BITS) - 1)

    def ids(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return (textkit.mix(textkit.parts(total, a, b) + np.uint64(salt)) & low).astype(np.int64)

    fixed = [(hashes & low).astype(np.int64)]
    for n in AFFIXES:
        fixed += [ids(starts, np.minimum(starts + n, ends), n), ids(np.maximum(ends - n, starts), ends, 16 + n)]
    size = ends - starts
    counts = np.stack([np.maximum(size - n + 1, 0) for n in GRAMS]) if len(starts) else np.zeros((len(GRAMS), 0), dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    grams = np.zeros(begins[-1], dtype=np.int64)
    shift = np.zeros(len(starts), dtype=np.int64)
    for n, c in zip(GRAMS, counts, strict=True):
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        a = np.repeat(starts, c) + nth
        grams[np.repeat(begins[:-1] + shift, c) + nth] = ids(a, a + n, 32 + n)
        shift += c
    return np.stack(fixed), grams, begins, bounds


class Crf:
    """Emission weights by hashed feature and transition weights, for the languages of ``langs``."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.weights = np.zeros((1 << BITS, len(langs)), dtype=np.float32)
        self.moves = np.eye(len(langs), dtype=np.float32)

    def emissions(self, fixed: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Per word the summed weights of its features; n-grams count by their mean."""
        e = self.weights[fixed[0]]
        for f in fixed[1:]:
            e = e + self.weights[f]
        n = np.diff(begins)
        has = n > 0
        if has.any():
            e[has] += np.add.reduceat(self.weights[grams], begins[:-1][has], axis=0) / n[has, None]
        return e

    def posteriors(self, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per word the probability of each language, by forward-backward within each row."""
        n, k = np.diff(bounds), len(self.langs)
        blocks = -(-n // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        p = np.ones((first[-1] * BLOCK, k))
        row = np.repeat(np.arange(len(n)), n)
        at = first[row] * BLOCK + np.arange(len(row)) - bounds[row]
        p[at] = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-12
        real = np.zeros(len(p), dtype=bool)
        real[at] = True
        p, real = p.reshape(-1, BLOCK, k), real.reshape(-1, BLOCK)
        move = np.exp(self.moves.astype(np.float64))
        across = np.broadcast_to(np.eye(k), (len(p), k, k)).copy()
        for t in range(BLOCK):
            step = np.matmul(across, move) * p[:, t, None, :]
            across = np.where(real[:, t, None, None], step / step.max(axis=(1, 2), keepdims=True), across)
        enter, leave = np.ones((len(p), k)), np.ones((len(p), k))
        for j in range(1, int(blocks.max(initial=0))):
            on = first[:-1][blocks > j] + j
            x = np.einsum("bi,bij->bj", enter[on - 1], across[on - 1])
            enter[on] = x / x.sum(axis=1, keepdims=True)
            on = first[1:][blocks > j] - 1 - j
            x = np.einsum("bij,bj->bi", across[on + 1], leave[on + 1])
            leave[on] = x / x.sum(axis=1, keepdims=True)
        ahead = np.empty_like(p)
        x = enter
        for t in range(BLOCK):
            x = (x @ move) * p[:, t]
            x = x / x.sum(axis=1, keepdims=True)
            ahead[:, t] = x
        x = leave
        for t in range(BLOCK - 1, -1, -1):
            ahead[:, t] *= x
            y = (p[:, t] * x) @ move.T
            x = np.where(real[:, t, None], y / y.sum(axis=1, keepdims=True), x)
        found = ahead.reshape(-1, k)[at]
        return found / found.sum(axis=1, keepdims=True)

    def marginals(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts of one length (texts x words x languages): each word's probabilities, and the expected number of each move.

        As in ``posteriors`` a move leads to the first word too, from any language.
        """
        p = np.exp(emissions - emissions.max(axis=2, keepdims=True))
        move, n = np.exp(self.moves.astype(np.float64)), p.shape[1]
        ahead, back = np.empty_like(p), np.ones_like(p)
        x = move.sum(axis=0) * p[:, 0]
        ahead[:, 0] = x / x.sum(axis=1, keepdims=True)
        for t in range(1, n):
            x = (ahead[:, t - 1] @ move) * p[:, t]
            ahead[:, t] = x / x.sum(axis=1, keepdims=True)
            y = (p[:, n - t] * back[:, n - t]) @ move.T
            back[:, n - t - 1] = y / y.sum(axis=1, keepdims=True)
        each = ahead * back
        pairs = ahead[:, :-1, :, None] * move * (p * back)[:, 1:, None, :]
        each /= each.sum(axis=2, keepdims=True)
        return each, (pairs / pairs.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1)) + move / move.sum(axis=0) * each[:, 0].sum(axis=0)

    def loss(self, emissions: np.ndarray, gold: np.ndarray) -> float:
        """Minus the log probability of the languages ``gold`` (texts x words), summed over texts."""
        enter = np.log(np.exp(self.moves.astype(np.float64)).sum(axis=0))
        right = np.take_along_axis(emissions, gold[:, :, None], axis=2).sum() + self.moves[gold[:, :-1], gold[:, 1:]].sum() + enter[gold[:, 0]].sum()
        x = emissions[:, 0] + enter
        for t in range(1, emissions.shape[1]):
            step = x[:, :, None] + self.moves
            top = step.max(axis=1, keepdims=True)
            x = (np.log(np.exp(step - top).sum(axis=1)) + top[:, 0]) + emissions[:, t]
        top = x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]).sum() - right)

    def gradients(self, emissions: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``loss`` by emissions and by moves."""
        p, moved = self.marginals(emissions)
        np.put_along_axis(p, gold[:, :, None], np.take_along_axis(p, gold[:, :, None], axis=2) - 1, axis=2)
        np.add.at(moved, (gold[:, :-1], gold[:, 1:]), -1)
        move = np.exp(self.moves.astype(np.float64))
        return p, moved - move / move.sum(axis=0) * np.bincount(gold[:, 0], minlength=len(move))

    def learn(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], gold: np.ndarray) -> None:
        """Adagrad steps on texts that mix runs of 4 to 24 words of several documents."""
        rng = np.random.default_rng(SEED)
        by_lang = [np.flatnonzero(gold == y) for y in range(len(self.langs))]
        seen, seen_moves = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1.0)
        for _ in range(STEPS):
            picks: list[tuple[int, int]] = []
            while len(picks) < MIXED * LENGTH:
                own = by_lang[rng.integers(len(self.langs))]
                d = int(own[rng.integers(len(own))])
                size = docs[d][0].shape[1]
                run = int(rng.integers(4, 25))
                a = int(rng.integers(max(1, size - run)))
                picks += [(d, i) for i in range(a, min(a + run, size))]
            picks = picks[: MIXED * LENGTH]
            y = gold[[d for d, _ in picks]]
            fixed = np.stack([docs[d][0][:, i] for d, i in picks], axis=1)
            parts = [docs[d][1][docs[d][2][i] : docs[d][2][i + 1]] for d, i in picks]
            n = np.array([len(g) for g in parts])
            begins, grams = np.concatenate([[0], np.cumsum(n)]), np.concatenate(parts)
            by_word, by_move = self.gradients(self.emissions(fixed, grams, begins).reshape(MIXED, LENGTH, -1), y.reshape(MIXED, LENGTH))
            grad = by_word.reshape(len(y), -1)
            ids = np.concatenate([*fixed, grams])
            each = np.concatenate([*[grad] * len(fixed), np.repeat(grad / np.maximum(n, 1)[:, None], n, axis=0)])
            rows, where = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(where, each[:, c], len(rows)) for c in range(len(self.langs))], axis=1).astype(np.float32) / MIXED
            seen[rows] += g**2
            self.weights[rows] -= RATE * g / np.sqrt(seen[rows])
            g = by_move / (MIXED * LENGTH)
            seen_moves += g**2
            self.moves -= (RATE * g / np.sqrt(seen_moves)).astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """A model of a bounded sample of the rows whose language is known; None without any."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    known = known.where(doc_hash("doc_id") % 5 != 0).where(F.col("text").rlike(r"\p{L}"))
    # Ids first, so that the sort carries no texts.
    ids = known.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return fitted(of_ids(known, ids, SAMPLE_BYTES), _of_rows)


def _of_rows(rows: pa.Table) -> Crf | None:
    docs_, gold = [], []
    langs = sorted(set(rows.column("lang").to_pylist()))
    at = 0
    with np.errstate(over="ignore"):
        for _, data, offsets in textkit.chunks(rows.column("text")):
            fixed, grams, begins, bounds = features(data, offsets)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    docs_.append((fixed[:, a:b], grams[begins[a] : begins[b]], begins[a : b + 1] - begins[a]))
                    gold.append(langs.index(rows.column("lang")[at].as_py()))
                at += 1
        if not docs_:
            return None
        langs = [x for i, x in enumerate(langs) if i in set(gold)]
        old = sorted(set(gold))
        model = Crf(langs)
        model.learn(docs_, np.array([old.index(g) for g in gold]))
    return model


def _label(model) -> Callable:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            best, score, shares = [], [], []
            with np.errstate(over="ignore"):
                for _, data, offsets in textkit.chunks(batch.column("text")):
                    fixed, grams, begins, bounds = features(data, offsets)
                    n = np.diff(bounds)
                    mean = np.zeros((len(n), len(crf.langs)))
                    if len(begins) > 1:
                        p = np.vstack([crf.posteriors(crf.emissions(fixed, grams, begins), bounds), np.zeros((1, len(crf.langs)))])
                        mean = np.add.reduceat(p, bounds[:-1], axis=0) * (n > 0)[:, None] / np.maximum(n, 1)[:, None]
                    best.append(mean.argmax(axis=1))
                    score.append(mean.max(axis=1))
                    shares.append(mean)
            none = np.zeros(0)
            best, score = (np.concatenate(x) if x else none for x in (best, score))
            flat = np.concatenate(shares).ravel() if shares else none
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(crf.langs)), pa.array(flat, pa.float64()))
            named = pa.array([crf.langs[int(i)] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), named, pa.array(np.clip(score, 0, 1)), lists], ["doc_id", "lettered", "best", "best_score", "shares"])

    return label


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang_pred, score, shares (a map from each language to its mean probability)."""
    model = fit(docs, id_col, text_col, lang_col)
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return narrow.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,double>").alias("shares"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    found = narrow.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, lettered boolean, best string, best_score double, shares array<double>")
    shares = F.map_from_arrays(F.array(*map(F.lit, model.langs)), "shares")
    return found.select("doc_id", F.when(F.col("lettered"), F.col("best")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("best_score")).otherwise(0.0).alias("score"), F.when(F.col("lettered"), shares).alias("shares"))
