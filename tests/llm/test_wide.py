"""Phrases, line dedup and manifests against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidewheel.llm import collocations, line_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, items):
    return spark.createDataFrame([(i, t, x, "s", None if t is None else len(t)) for i, t, x in items], SCHEMA)


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


# Phrases


def brute_phrases(items, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in items:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in often.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return out


def phrase_texts(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "New", "York", "état", "日本", "x y", "in", "spite", "by", "way"] + [f"w{i}" for i in range(40)]
    fixed = ["in spite of the", "New York", "by the way", "NEW york"]
    items = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        seps = [rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for _ in parts]
        items.append((i, "".join(x for p in zip(parts, seps, strict=True) for x in p), rng.choice(["en", "en", "fr", None])))
    # repeated rows, texts without a word, a null, a language that is called und, and one run over and over
    return [*items, items[0], items[0], (500, None, "en"), (501, "", None), (502, " ,\t.\n", "fr"), (503, "the way", "und"), (504, "und so " * 400, "de"), (None, "the way", "en")]


@pytest.mark.parametrize("top", [5, None])
def test_collocations(spark, top):
    items = phrase_texts()
    got = collocations.collocations(docs_of(spark, items).repartition(5), least=6, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(items, 6, 80, top)
    assert len(want) > 10 and any(" " in w[2] and len(w[2].split(" ")) == 4 for w in want)
    same(map(tuple, got.collect()), want)


def test_collocations_with_full_summaries(spark, monkeypatch):
    """Small stretches and few counters: summaries must take counts off, and nothing frequent may be lost."""
    for name, value in (("HELD", 1 << 9), ("MERGED", 1 << 8), ("ROOM", 1), ("MASS", 1 << 12), ("EACH", 2)):
        monkeypatch.setattr(collocations, name, value)
    items = phrase_texts(5, 300)
    same(map(tuple, collocations.collocations(docs_of(spark, items).repartition(3), least=9).collect()), brute_phrases(items, 9, 80, 2000))


@pytest.mark.parametrize("seed", range(8))
def test_summaries_keep_what_is_frequent(seed):
    rng = np.random.default_rng(seed)
    least, values = 10, (rng.zipf(1.3, 20000) % 5000).astype(np.uint32)
    room, truth = collocations.Summary.empty(len(values) // least + 1), Counter(values.tolist())
    for part in np.array_split(values, 40):
        k, n = np.unique(part, return_counts=True)
        room.merge([k], [n])
        assert len(room.keys) <= room.capacity
    assert room.lost > 0
    found = set(room.survivors(least).tolist())
    assert {k for k, c in truth.items() if c >= least} <= found < set(truth)
    assert all(c <= truth[k] <= c + room.lost for k, c in zip(room.keys.tolist(), room.counts.tolist(), strict=True))


def test_packed_keys():
    for n in (1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))
        assert (collocations.unpacked(collocations.packed(keys), len(keys)) == keys).all()


def test_long_products_are_exact(spark):
    """2,000,000 a passes 64 bits; the floor must not be one of doubles."""
    a, l, r = 9_007_199_254_740_993, 9_007_199_254_740_993, 27_021_597_764_222_979
    runs = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "", 0, l + r)], "lang string, phrase string, words int, f long")
    assert collocations.scored(runs, 4, 80, None).first()["score"] == 2_000_000 * a // (l + r)


def test_collocations_empty_and_clashing(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    odd = docs_of(spark, phrase_texts()).select("*", *[F.lit(1).alias(x) for x in ("phrase", "n", "f", "p", "key")])
    assert len(collocations.collocations(odd, least=6).collect()) == len(brute_phrases(phrase_texts(), 6, 80, 2000))


def test_phrases_of_a_very_long_text(spark):
    items = [(1, "one two three. " * 100_000, "en"), (2, "word" * 300_000, "en")]
    same(map(tuple, collocations.collocations(docs_of(spark, items)).collect()), brute_phrases(items, 30, 80, 2000))


# Lines


def brute_lines(items, least=10, copies=2):
    strip = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    big = (1 << 63) - 1
    rows, first = Counter(), {}
    for i, text, _ in items:
        for k in {strip(x) for x in (text or "").split("\n")}:
            rows[k] += 1
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, text, _ in items:
        lines = (text or "").split("\n")
        gone = [len(strip(x)) >= least and rows[strip(x)] >= copies and first[strip(x)] != (big if i is None else i) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, kept if text is not None else None, len(lines), sum(gone)))
    return out


def line_texts(seed=1, n=80):
    rng = random.Random(seed)
    pool = [f"A line that many share, number {i}" for i in range(12)] + ["short", "0123456789", "012345678", "éééééééééé", "ééééé", "", "   ", "\r", "日本語日本語日本語日本", "\x85 not white space here"]
    items = []
    for i in range(n):
        lines = [rng.choice([" ", "\t", "", "\x0b"]) + (rng.choice(pool) if rng.random() < 0.6 else f"only here {i} {rng.random()}") + rng.choice(["", " ", "\r", "  \x0c"]) for _ in range(rng.randint(1, 9))]
        items.append((rng.randint(0, 200), "\n".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in lines), "en"))
    items += [(300, None, "en"), (301, "", None), (302, "\n\n", "en"), (303, pool[0] + "\n" + pool[0], "en"), (None, pool[1] + "\nonly the null has this one", "en"), (None, pool[2], "en")]
    return [*items, items[0], (items[1][0], pool[3], "en"), (999, "a" * 200_000 + "\n" + pool[0], "en"), (1000, "a" * 200_000 + "\nrest of it", "en")]


@pytest.mark.parametrize("copies", [2, 5])
def test_line_dedup(spark, copies):
    items = line_texts()
    got = line_dedup.dedup_lines(docs_of(spark, items).repartition(4), copies=copies)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    want = brute_lines(items, 10, copies)
    assert 20 < sum(w[3] for w in want)
    same(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), want)


def test_line_dedup_in_groups_and_small_stretches(spark, monkeypatch):
    for name, value in (("SHARD", 4), ("GROUP", 300), ("STRETCH", 200), ("HELD", 8)):
        monkeypatch.setattr(line_dedup, name, value)
    items = line_texts(7, 300)
    same(map(tuple, line_dedup.dedup_lines(docs_of(spark, items).repartition(3)).select("doc_id", "text", "n_lines", "n_dropped").collect()), brute_lines(items))


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).collect() == []
    alone = line_dedup.dedup_lines(docs_of(spark, [(1, "nothing repeats here", "en"), (2, None, None)]))
    same([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in alone.collect()], [(1, "nothing repeats here", 1, 0), (2, None, 1, 0)])
    clash = docs_of(spark, line_texts()).select("*", *[F.lit("x").alias(x) for x in ("n_lines", "k", "c0", "_gone", "lo")])
    got = line_dedup.dedup_lines(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "k", "c0", "_gone", "lo", "n_lines", "n_dropped"]
    same(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), brute_lines(line_texts()))


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))[:n] << np.uint64(1)
    rows = []
    for shard in (0, 1):
        own = keys[keys >> np.uint64(63) == shard]
        if len(own):
            sizes, bits, order = line_dedup.perfect(own)
            assert sorted(order.tolist()) == list(range(len(own)))
            low, high = line_dedup._prints(own[order])
            rows.append({"shard": shard, "sizes": sizes, "bits": np.packbits(bits, bitorder="little").tobytes(), "low": low.tobytes(), "high": high.tobytes(), "documents": np.full(len(own), 2, dtype=np.uint32).tobytes(), "least": own[order].astype(np.int64).tobytes()})
    index = line_dedup.Index.of(rows, 63)
    slots = index.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (index.least[slots] == keys.astype(np.int64)).all()
    assert (index.slots(keys + np.uint64(1)) == -1).all()
    assert len(index.bits) * 8 <= 5 * len(keys) + 64 * 40


def test_split_lines():
    texts = ["a\n\n b ", None, "", "\n", "é\n" * 3]
    own = line_dedup.split_lines(pa.array(texts), 1)
    assert np.diff(own.bounds).tolist() == [len((t or "").split("\n")) for t in texts]
    assert [own.data[a:b].tobytes().decode() for a, b in zip(own.starts, own.ends, strict=True)] == [x for t in texts for x in (t or "").split("\n")]


# Manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j in range(len(run)):
                for m in members[a + j]:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H(*run))
            under.append([m for x in members[a : a + 8] for m in x])
        nodes, members = above, under
    return nodes[0], paths


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        other = text if text is None or zlib.crc32(("" if i is None else str(i)).encode()) % 3 else lowered(text)
        by[lang].append((-1 if i is None else i, H(*map(field, (i, source, lang, n, text))), H(*map(field, (i, source, lang, n, other))), i))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([r[1] for r in sorted(by[x], key=lambda r: r[:2])]) for x in langs}
    root, tops = brute_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, leaf, other, i), own in zip(sorted(by[x], key=lambda r: r[:2]), trees[x][1], strict=True):
            folded = other
            for a, b in own + top:
                folded = H(a, folded, b)
            out.append((i, leaf, trees[x][0], root, H("".join(a + b for a, b in own + top)), folded, folded == root))
    return out


def leaf_rows(seed=2, sizes=(("en", 140), ("fr", 65), ("de", 8), ("es", 9), ("", 1), ("日本", 2), (None, 3), ("é", 1))):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes:
        for _ in range(n):
            text = rng.choice([None, "", "Some Text", "état É", "lower only", "x" * 5000])
            rows.append((rng.choice([None, rng.randint(0, 10**12), rng.randint(0, 40)]), text, lang, rng.choice([None, "src", ""]), None if text is None else len(text)))
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("tier", [1, 2, 5])
def test_manifest(spark, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    rows = leaf_rows()
    got = merkle.tampered_check(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute_manifest(rows)
    assert {w[-1] for w in want} == {True, False}
    same(map(tuple, got), want)


@pytest.mark.parametrize("sizes", [(("en", 1),), (("en", 8),), (("en", 9),), ((None, 1), ("en", 1)), tuple((f"l{i}", 1) for i in range(70))])
def test_manifests_of_few_leaves_or_many_groups(spark, sizes):
    rows = leaf_rows(4, sizes)[: sum(n for _, n in sizes)]
    same(map(tuple, merkle.tampered_check(spark.createDataFrame(rows, SCHEMA)).collect()), brute_manifest(rows))


def test_manifest_edges(spark):
    assert merkle.tampered_check(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = leaf_rows(5, (("en", 20), (None, 4)))
    clash = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(x) for x in ("g", "i", "n", "h", "key", "path", "root", "m", "b1")])
    same(map(tuple, merkle.tampered_check(clash).collect()), brute_manifest(rows))
    kept = merkle.manifest(clash, "lang", "doc_id", ["doc_id", "text"])
    assert kept.columns == ["doc_id", "lang", "leaf", "altered_leaf", "path", "subroot", "root"]
    assert sorted(map(str, (r["lang"] for r in kept.collect()))) == sorted(str(r[2]) for r in rows)
    made = kept.select(F.col("root") == merkle.fold(F.col("leaf"), F.col("path")))
    assert all(r[0] for r in made.collect())
