"""Operators against brute force, round trips and edge cases on small inputs."""

import math
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tidewheel.llm import decontamination, jaccard_join, language_id, license_scan, lm_scoring, packing, quality_rules, sharding, subwords, textkit, toxicity, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, items):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in items], SCHEMA)


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def near_copies(seed=0):
    """Texts with a group of near copies, exact copies, a shared passage, nulls, blanks, repeated ids and a long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(120)]
    shared = " ".join(word() for _ in range(30))
    items = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        items.append((i, " ".join(w)))
    items += [(100 + i, " ".join(word() for _ in range(rng.randint(1, 60))) + " " + shared) for i in range(30)]
    items += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE  two"), (205, "one two three"), (3, "another text under a used id"), (None, items[0][1]), (206, shared), (207, shared), (207, shared)]
    return [*items, (300, " ".join(word() for _ in range(20000)))]


def brute_components(items, k, percent):
    sets = []
    for _, t in items:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(items)):
        groups[find(i)].append(i)
    least = {i: min((items[j][0] for j in g if items[j][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((items[i][0], len(sets[i]), least[i] if sets[i] else items[i][0]) for i in range(len(items))), key=str), groups, sets


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, k, percent):
    items = near_copies()
    want, _, _ = brute_components(items, k, percent)
    got = jaccard_join.jaccard_classes(docs_of(spark, items), k, percent, sketch_bits=12).collect()
    assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in got), key=str) == want


def test_keep_one(spark):
    items = near_copies(1)
    _, groups, sets = brute_components(items, 5, 80)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs_of(spark, items)).collect()]
    with_words = [g for g in groups.values() if sets[g[0]]]
    blank = [x for x in items if not words_of(x[1])]
    assert len(kept) == len(with_words) + len(blank)
    for g in with_words:
        assert sum((items[i][0], items[i][1]) in kept for i in {(items[j][0], items[j][1]): j for j in g}.values()) == 1


def test_jaccard_join_empty(spark):
    assert jaccard_join.jaccard_classes(docs_of(spark, []), 4, 85).count() == 0


def test_prefix_filter_keeps_links():
    """The first n - overlap + l shingles of a linked pair share l, and every shared one of them is within both reaches."""
    rng = np.random.default_rng(0)
    counts, met = rng.integers(1, 9, 400), 0
    for _ in range(300):
        a = rng.choice(400, rng.integers(20, 60), replace=False)
        b = np.concatenate([rng.choice(a, len(a) - rng.integers(0, 5), replace=False), np.arange(400, 400 + rng.integers(0, 4))])
        full = np.concatenate([counts, [1] * 4])
        (la, pa_), (lb, pb) = (jaccard_join.prefix(np.sort(x).astype(np.uint64), full[np.sort(x)], 0, 85) for x in (a, b))
        both = len(set(a) & set(b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            met += 1
            overlap, least = -(-85 * (len(a) + len(b)) // 185), min(la, lb)
            heads = [p[: len(x) - overlap + least].tolist() for p, x in ((pa_, a), (pb, b))]
            shared = set(heads[0]) & set(heads[1])
            assert len(shared) >= least
            for x, y, p, m in ((a, b, pa_, la), (b, a, pb, lb)):
                assert all((185 * (len(x) + m - 1 - p.tolist().index(t))) // 85 - len(x) >= len(y) for t in shared)
    assert met > 100


def test_jaccard_join_of_groups_near_the_threshold(spark):
    """Copies with so many changes that some link with their source, some only with each other and some with nothing; sizes differ."""
    rng = random.Random(12)
    base, items = [f"b{i}" for i in range(150)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 400)}"
            else:
                del w[rng.randrange(len(w))]
        items.append((i, " ".join(w)))
    want, groups, _ = brute_components(items, 4, 85)
    assert 5 < len(groups) < 140
    got = jaccard_join.jaccard_classes(docs_of(spark, items), 4, 85, sketch_bits=10).collect()
    assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in got), key=str) == want


def test_keep_one_keeps_clashing_columns(spark):
    names = ["_own", "_key", "_stay", "key", "n", "comp", "doc.id"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in ((1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, ""), (4, "other words"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[0] != 2), key=str)


def test_words_and_shingles():
    texts = ["The CAT\tsat  on", None, "", "a", "É x\x0by"]
    for _, data, offsets in textkit.chunks(pa.array(texts)):
        h, s, e, b = textkit.words(data, offsets)
        raw = bytes(data)
        assert [[raw[s[i] : e[i]].decode() for i in range(x, y)] for x, y in zip(b[:-1], b[1:], strict=True)] == [["The", "CAT", "sat", "on"], [], [], ["a"], ["É", "x", "y"]]
    one, two = textkit.shingle_sets(pa.array(["x The Cat", "the cat"]), 2)
    assert len(one) == 2 and len(two) == 1 and two[0] in one


def test_subwords_match_the_tokenizer():
    coder = subwords.coder(PATH)
    texts = ["It's  DON'T we'll 12ab éa  x İstanbul ΣΑΣ 日本 <|endoftext|> 's", None, "", " \t\n", "plain words, here. über %%% façade!!", "x" * 500]
    ids, bounds = coder.encode(pa.array(texts).slice(0))
    whole = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [w.ids for w in whole]


def test_packing(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(900, None), (900, ""), (None, "tail"), (901, "word " * 300)]
    got = packing.pack(docs_of(spark, items), PATH, capacity=64).collect()
    coder = subwords.coder(PATH).tokenizer
    want = []
    for i, t in items:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, p, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for p, a in enumerate(range(0, len(ids), 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1


def test_fullest_is_the_best_subset():
    rng = random.Random(5)
    for _ in range(100):
        counts = np.zeros(31, dtype=np.int64)
        for _ in range(rng.randint(0, 6)):
            counts[rng.randint(1, 30)] += 1
        room, sums = rng.randint(1, 30), {0}
        for s in np.repeat(np.arange(31), counts).tolist():
            sums |= {x + s for x in sums if x + s <= room}
        used = packing.fullest(counts, room)
        assert sum(s * n for s, n in used) == max(sums) and all(n <= counts[s] for s, n in used)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 41, 1000])
def test_sharding(spark, n):
    df = docs_of(spark, [(i % 997, f"text {i % 50}") for i in range(n)] + [(None, None)] * (n > 2))
    got = sharding.shard_rows(df, shards=7).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) in {(16, 0)} | {(16 + len(f"text {i}"), zlib.crc32(f"text {i}".encode())) for i in range(50)}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert not slots or max(map(len, slots.values())) - min([len(s) for s in slots.values()] + [0] * (len(slots) < min(7, len(got)))) <= 1


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 5, 16, 100, 1000):
        got = spark.range(n).select(sharding.permute(F.col("id"), n, 9).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))
    a, b = (spark.range(1000).select(sharding.permute(F.col("id"), 1000, k).alias("p")).collect() for k in (1, 2))
    assert a != b


@pytest.mark.parametrize("n, key", [(1, 3), (2, 3), (50, 3), (997, 12345)])
def test_feistel_against_plain_rounds(spark, n, key):
    """The rounds and the walk in plain integers, with an independent xxHash."""
    long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    int_ = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<i", v), seed)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)

    def once(x):
        left, right = divmod(x, b)
        for j in range(sharding.ROUNDS):
            if j % 2 == 0:
                left = (left + signed(int_(key, int_(j, long(right, 42)))) % a) % a
            else:
                right = (right + signed(int_(key, int_(j, long(left, 42)))) % b) % b
        return left * b + right

    def walked(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    got = spark.range(n).select("id", sharding.permute(F.col("id"), n, key).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == {i: walked(i) for i in range(n)}


def brute_rules(text):
    text = text or ""
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    wins, covered = defaultdict(list), set()
    for i in range(len(w) - 7):
        wins[tuple(w[i : i + 8])].append(i)
    for at in wins.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "  \n\n ", "same line\nsame line\nother #1 | <b>", "ü é\x0bz " * 12, "x y z " * 3000, "a b c d e f g h a b c d e f g h"]
    book = quality_rules.ledger(docs_of(spark, list(enumerate(texts))))
    for r in book.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(r["text"]), r["text"]
    cut = {(r["policy"], r["version"], r["rule"]): r for r in quality_rules.ablations(book).collect()}
    kept = book.where(quality_rules.passes(quality_rules.POLICIES[-1])).count()
    assert {r["kept"] for k, r in cut.items() if k[:2] == ("web", 2)} == {kept}
    assert quality_rules.ledger(docs_of(spark, [])).count() == 0


def test_tiles_against_brute_force():
    rng = random.Random(1)

    def brute(item, text, least):
        least, fi, ft, out = max(1, min(least, len(item))), [True] * len(item), [True] * len(text), []
        while True:
            best, found = 0, []
            for i in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and fi[i + n] and ft[t + n]:
                        n += 1
                    if n > best:
                        best, found = n, [(i, t)]
                    elif n and n == best:
                        found.append((i, t))
            if best < least:
                return out
            for i, t in found:
                if all(fi[i : i + best]) and all(ft[t : t + best]):
                    for k in range(best):
                        fi[i + k] = ft[t + k] = False
                    out.append((i, t, best))

    h = lambda z: textkit.mix(np.array(z, dtype=np.uint64) + np.uint64(1))
    for _ in range(150):
        v = rng.choice([2, 3, 20])
        item, text = ([rng.randrange(v) for _ in range(rng.randrange(a, b))] for a, b in ((1, 30), (0, 40)))
        text += item[len(item) // 2 :] + [99] + item[: len(item) // 2]
        assert decontamination.tiles(h(item), h(text), 3) == brute(item, text, 3)


def test_tiles_of_long_repetitive_texts():
    """A short period over and over: linear in the number of places, and no tile overlaps another."""
    item, text = np.tile(np.arange(1, 4, dtype=np.uint64), 700), np.tile(np.arange(1, 4, dtype=np.uint64), 9000)
    found = decontamination.tiles(textkit.mix(item), textkit.mix(text), 8)
    assert found[0] == (0, 0, 2100) and len(found) == 1
    mixed = np.concatenate([np.append(np.full(9, 7, dtype=np.uint64), np.uint64(100 + i)) for i in range(1500)])
    found = decontamination.tiles(textkit.mix(np.full(900, 7, dtype=np.uint64)), textkit.mix(mixed), 8)
    assert sum(n for _, _, n in found) == 900 and all(n == 9 for _, _, n in found)


def test_short_items_that_are_edited_or_cut(spark):
    words = [f"v{i}" for i in range(15)]
    edited = " ".join(["a", *words[:7], "other", *words[8:], "b"])
    thrice = " ".join(["x", *words[10:], "y", *words[:5], "z", *words[5:10]])
    docs = docs_of(spark, [(1, edited), (2, thrice), (3, " ".join(words[:6])), (4, "one word"), (5, "one two three four")])
    bench = spark.createDataFrame([(0, " ".join(words)), (1, "word"), (2, "one two three four")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()} == {(1, 0), (2, 0), (5, 2)}


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(9)]
    docs, bench = docs_of(spark, [(i, f"a {t} b") for i, t in enumerate(items)]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()) == [(i, i) for i in range(9)]


def test_decontamination(spark):
    words = [f"w{i}" for i in range(200)]
    item = " ".join(words[:40])
    moved = " ".join(["x", *words[20:40], "middle", *words[:20], "y"])
    little = " ".join([*words[:12], *words[100:150]])
    docs = docs_of(spark, [(1, "a " + item.upper() + " b"), (2, moved), (3, little), (4, None), (5, ""), (2, "clean"), (None, item), (6, "a short item here")])
    bench = spark.createDataFrame([(0, item), (1, "a short item here"), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (None, 0), (6, 1)}
    assert got[2, 0]["covered_words"] == 40 and len(got[2, 0]["tiles"]) == 2
    assert sorted(((r["doc_id"], r["text"]) for r in decontamination.clean(docs, bench).collect()), key=str) == sorted([(3, little), (4, None), (5, ""), (2, "clean")], key=str)
    assert decontamination.clean(docs, bench.limit(0)).count() == 8 and decontamination.leaks(docs.limit(0), bench).count() == 0


def test_url_filter(spark):
    R = url_filter.Rule
    rules = [R("block", "com", "/en/"), R("allow", "example.com", "/en/7"), R("block", "net")]
    urls = ["http://A.Example.COM/en/71?q", "https://b.com/en/", "https://b.com/en", "ftp://x.net", "x.net/a", None, "http://bad.org/", "http://sub.bad.org/p#f", "http://notbad.org/", "http://x.y://z.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, ("bad.org",)).collect()}
    assert got == {
        0: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("b.com", "/en/", "com/en/", "block"), 2: ("b.com", "/en", None, "allow"), 3: ("x.net", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("bad.org", "/", None, "block"), 7: ("sub.bad.org", "/p", None, "block"), 8: ("notbad.org", "/", None, "allow"), 9: ("x.y:", "//z.net/", None, "allow"),
    }
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def brute_verdict(url, rules, blocked):
    head, mark, rest = (url or "").partition("://")
    end = next((i for i, x in enumerate(rest) if x in "/?#"), len(rest))
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in rest[:end]) if mark else ""
    path = rest[end:].partition("?")[0].partition("#")[0] if mark else ""
    under = lambda h: bool(host) and (host == h or host.endswith("." + h))
    fit = sorted((r for r in rules if under(r.host) and path.startswith(r.path)), key=lambda r: -len(r.name))
    return host, path, fit[0].name if fit else None, fit[0].verdict if fit else "block" if any(map(under, blocked)) else "allow"


@pytest.mark.parametrize("most", [1 << 26, 300])
def test_url_filter_against_brute_force(spark, monkeypatch, most):
    """Repeated rows, null ids, long urls and hosts with many dots; a list in one cascade and in many."""
    monkeypatch.setattr(url_filter, "MOST_BYTES", most)
    rng = random.Random(7)
    R = url_filter.Rule
    rules = [R("block", "com", "/en/"), R("allow", "b.com", "/en/7"), R("block", "net"), R("allow", "a.net", "/x")]
    blocked = [f"h{i}.org" for i in range(200)]
    hosts = ["a.b.com", "B.com", "a.net", "x.a.net", "net", ".net", "com.", "h7.org", "w.h9.org", "xh9.org", "h300.org", "." * 300 + "com", "a." * 2000 + "b.com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/77', '/x/y', '/en/' + 'z' * 5000, '?q=/en/', '#/x'])}" for _ in range(300)] + [None, "", "://", "no host", "http://"]
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)] + [(1, urls[1]), (1, urls[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS keys", "4 AS held")
    listed = spark.createDataFrame([(h,) for h in blocked], "host string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages, rules, listed).collect()), key=str)
    assert got == sorted(((i, *brute_verdict(u, rules, blocked)) for i, u in rows), key=str)


def test_cascade_is_exact(spark):
    listed, universe = spark.range(0, 4000, 7).select(F.xxhash64("id").alias("key")), spark.range(20000).select(F.xxhash64("id").alias("key"))
    cascade = url_filter.build(listed, universe)
    keys = np.array([r["key"] for r in universe.collect()], dtype=np.int64)
    assert set(keys[cascade.listed(keys)].tolist()) == {r["key"] for r in listed.collect()} and len(cascade.levels) > 1


def test_forward_backward_against_plain_pass():
    rng = np.random.default_rng(0)
    crf = language_id.Crf(["a", "b", "c"])
    crf.moves = rng.normal(size=(3, 3)).astype(np.float32)
    sizes = [1, 0, 31, 32, 33, 200]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(size=(bounds[-1], 3))
    got = crf.posteriors(e, bounds)
    move = np.exp(crf.moves.astype(float))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        p = np.exp(e[a:b])
        f, x = [], np.ones(3)
        for t in range(b - a):
            x = (x @ move) * p[t]
            x /= x.sum()
            f.append(x)
        y, out = np.ones(3), []
        for t in range(b - a - 1, -1, -1):
            out.append(f[t] * y)
            y = move @ (p[t] * y)
            y /= y.sum()
        want = np.array(out[::-1])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_crf_gradients():
    rng = np.random.default_rng(1)
    crf = language_id.Crf(["a", "b", "c"])
    crf.moves = rng.normal(size=(3, 3))
    e, gold = rng.normal(size=(4, 12, 3)), rng.integers(0, 3, (4, 12))
    by_word, by_move = crf.gradients(e, gold)
    p, _ = crf.marginals(e)
    assert np.allclose(p.reshape(-1, 3), crf.posteriors(e.reshape(-1, 3), np.arange(5) * 12))
    for v, g in ((e, by_word), (crf.moves, by_move)):
        for at in np.ndindex(*v.shape):
            old = v[at]
            v[at] = old + 1e-5
            up = crf.loss(e, gold)
            v[at] = old - 1e-5
            down = crf.loss(e, gold)
            v[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_language_id(spark):
    rng = random.Random(4)
    one, two = [f"the{x}ing" for x in "abcdefgh"], [f"der{x}ung" for x in "abcdefgh"]
    text = lambda v: " ".join(rng.choice(v) for _ in range(30))
    data = [(i, text(one if i % 2 else two), "en" if i % 2 else "de") for i in range(200)] + [(500, None, "en"), (501, "12 ... 3", "en"), (502, "", None), (None, text(one), "en"), (503, "—", None), (503, text(two) * 200, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language_id.identify(df).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 500}
    held_out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held_out) > 20 and all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in held_out)
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(200))
    assert [r["lang_pred"] for r in got if r["doc_id"] in (500, 501, 502)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    data, marks = [], []
    for i in range(600):
        w = [word() for _ in range(40)]
        if i % 5 == 0:
            w[rng.randrange(40)], w[rng.randrange(40)] = "zzzbad", "zzzworse!"
        data.append((i, " ".join(w)))
        marks.append((i, int(i % 5 == 0)))
    docs, labels = docs_of(spark, [*data, (900, None), (901, ""), (None, "zzzbad zzzworse")]), spark.createDataFrame([*marks, (1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    held_out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held_out)
    assert len(held_out) > 80 and right >= len(held_out) - 4
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
    clean = toxicity.without_toxic(docs.withColumns({"score": F.lit("mine"), "_score": F.lit(1), "c0": F.lit(2)}), labels)
    assert clean.columns == [*docs.columns, "score", "_score", "c0"] and {tuple(r)[-3:] for r in clean.collect()} == {("mine", 1, 2)}


def test_toxicity_against_a_plain_pass():
    """Scores of texts of 0, 1, 2 and more words, and of a very long one, by loops over filters and places."""
    rng = np.random.default_rng(2)
    cnn = toxicity.Cnn(rng)
    cnn.bias = rng.normal(size=cnn.bias.shape).astype(np.float32)
    texts = ["", "one", "two words", "Some more words, and more!", "long " * 5000 + "end"]
    (hashes, bounds), low = next(toxicity.rows_of(pa.array(texts))), (1 << toxicity.BITS) - 1
    got = cnn.logits(hashes, bounds)
    for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        x = [sum(cnn.table[int(h >> np.uint64(64 - toxicity.BITS))] for h in w) + cnn.table[int(w[0]) & low] for w in hashes[:, a:b].T] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        pooled = []
        for k, width in enumerate(toxicity.WIDTHS):
            y = [sum(x[i + j] @ cnn.filters[k][j] for j in range(width)) + cnn.bias[k] for i in range(b - a)]
            pooled += [max(0, *(v[f] for v in y)) if y else 0 for f in range(toxicity.FILTERS)]
        assert got[r] == pytest.approx(np.dot(pooled, cnn.out) + cnn.shift, rel=1e-3, abs=1e-4)


def test_toxicity_threshold_takes_the_fewest_errors():
    x, y = np.array([-2.0, -1, 0.5, 1, 2]), np.array([0, 0, 0, 1, 1])
    assert toxicity.Model._best(x, y, 9.0) == pytest.approx(0.75)
    assert toxicity.Model._best(x, y * 0, 9.0) == 9.0
    assert toxicity.Model._best(np.array([1.0, 1, 1]), np.array([0, 1, 1]), 9.0) == pytest.approx(0)  # of ties the nearest to 0


def attention(counts, **p):
    model = lm_scoring.Attention(np.asarray(counts))
    model.p = {n: v.astype(np.float64) for n, v in model.p.items()}
    return model


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = attention([3] * 50 + [0] * 10)
    ids, bounds = rng.integers(0, 60, 170), np.array([0, 5, 5, 170])
    x, y, row = model.windows(ids, bounds)
    assert np.bincount(row, (y >= 0).sum(axis=1), 3).tolist() == [5, 0, 165]
    loss = lambda: -model.log_probs(x, y).sum() / (y >= 0).sum()
    g = model.gradients(x, y)
    for name in ("t", "near", "c", "w"):
        v = model.p[name]
        for at in np.argsort(-np.abs(g[name]), axis=None)[:5]:
            at = np.unravel_index(at, v.shape)
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            down = loss()
            v[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-8), name


@pytest.mark.parametrize("counts", [[5] * 50 + [0] * 2450, np.arange(5000), [7] * 40, np.zeros(30)])
def test_attention_is_a_distribution(counts):
    counts = np.asarray(counts, dtype=np.int64)
    model = attention(counts)
    ids = np.concatenate([np.append([3, 7, 1], i) for i in range(len(counts))])
    x, y, row = model.windows(ids, np.arange(len(counts) + 1) * 4)
    p = np.exp(model.log_probs(x, y)[:, 3] + model.share)
    assert p.sum() == pytest.approx(1) and p.min() > 0


def test_attention_windows_against_one_pass():
    """Every id is scored as by a plain pass over the ids before it, as far as its window goes back."""
    rng, model = np.random.default_rng(3), attention(np.arange(1, 400))
    ids = rng.integers(0, 400, 100)
    x, y, _ = model.windows(ids[ids < 399], np.array([0, (ids < 399).sum()]))
    got = model.log_probs(x, y)[y >= 0]
    z, p = model.number[ids[ids < 399]].astype(int), model.p
    for i in range(len(z)):
        first = i - i % lm_scoring.STEP - lm_scoring.CONTEXT - 1
        context = [z[j] if j >= 0 else lm_scoring.VOCAB for j in range(first, i)]
        q, k, v = p["t"][context[-1]][lm_scoring.Q], p["t"][context][:, lm_scoring.K], p["t"][context][:, lm_scoring.V]
        a = np.exp(k @ q + p["near"][np.arange(len(context))[::-1]])
        h = np.append(p["t"][context[-1]][lm_scoring.E] + (a / a.sum()) @ v, 1)
        soft = lambda x: x - np.log(np.exp(x).sum())
        c, e = divmod(z[i], lm_scoring.EACH)
        assert got[i] == pytest.approx(soft(h @ p["c"].T)[c] + soft(h @ p["w"][c].T)[e])


def lm_texts(n=60):
    rng = random.Random(5)
    return [" ".join(rng.choice(("cat", "house", "river", "window")) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def lm_rows(spark, texts, partitions=1):
    raw = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "key long, text string, learn boolean").repartition(partitions)
    return raw.mapInArrow(lm_scoring._encoded(PATH, 1), "key long, learn boolean, ids binary").select("key", "ids")


def test_lm_does_not_depend_on_partitions(spark):
    texts = lm_texts()
    one, eight = (lm_scoring.fit(lm_rows(spark, texts, n), 49408, part_texts=7) for n in (1, 8))
    assert all(np.allclose(one.p[n], eight.p[n], atol=1e-6) for n in one.p)
    ids, bounds = lm_scoring.encode(pa.array(texts), PATH, 1)
    assert np.array_equal(lm_scoring.id_counts(lm_rows(spark, texts, 3), 49408), np.bincount(ids, minlength=49408))
    x, y, _ = one.windows(ids, bounds)
    untrained = lm_scoring.Attention(np.bincount(ids, minlength=49408))
    assert one.log_probs(x, y).sum() > untrained.log_probs(x, y).sum()


def test_lm_trains_on_every_window_once(monkeypatch):
    """Windows of every text, in the order of keys and however batched; repeated keys once."""
    met = []
    monkeypatch.setattr(lm_scoring.Attention, "gradients", lambda self, x, y: met.append(x.copy()) or {})
    texts = lm_texts(400)
    model = lm_scoring.Attention(np.bincount(lm_scoring.encode(pa.array(texts), PATH, 1)[0], minlength=49408))
    want = model.windows(*lm_scoring.encode(pa.array(texts[:250]), PATH, 1))[0], model.windows(*lm_scoring.encode(pa.array(texts[250:]), PATH, 1))[0]
    whole = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([True] * 400), pa.array(texts)], ["key", "learn", "text"])
    rows = pa.Table.from_batches(lm_scoring._encoded(PATH, 1)(iter([whole]))).combine_chunks()
    rows = rows.append_column("part", pa.array([0] * 250 + [3] * 150)).take([*range(10), 9, *range(10, 400)])
    start = type("B", (), {"value": (model, model.packed())})
    seen = []
    for step in (7, 100, 401):
        met.clear()
        out = pa.Table.from_batches(lm_scoring._train_parts(start)(iter(rows.to_batches(max_chunksize=step))))
        assert out.column("part").to_pylist() == [0, 3] and out.column("weight").to_pylist() == [len(w) for w in want]
        assert sorted(map(bytes, np.concatenate(met))) == sorted(map(bytes, np.concatenate(want)))
        seen.append(np.concatenate(met))
    assert all(np.array_equal(seen[0], x) for x in seen)


def test_lm_goes_over_few_windows_again(monkeypatch):
    """The first model takes its least steps, all others see each window once; what is held for that is bounded."""
    met = []
    monkeypatch.setattr(lm_scoring.Attention, "gradients", lambda self, x, y: met.append(len(x)) or {})
    texts = lm_texts(300)
    ids, bounds = lm_scoring.encode(pa.array(texts), PATH, 1)
    model = lm_scoring.Attention(np.bincount(ids, minlength=49408))
    n = len(model.windows(ids, bounds)[0])
    halves = lambda: iter([(ids[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in ((0, 120), (120, 300))])
    for again, least, passes, want in ((False, 10**6, 16, 1), (True, 10**6, 3, 3), (True, 1, 16, 1), (True, -(-2 * n // lm_scoring.FEW), 16, 3), (True, 10**6, 16, 16)):
        monkeypatch.setattr(lm_scoring, "LEAST", least)
        monkeypatch.setattr(lm_scoring, "PASSES", passes)
        met.clear()
        assert lm_scoring._trained(model, model.packed(), halves(), again) == n
        assert sum(met) == want * n


def test_lm_beats_the_base_and_its_own_start(spark):
    """Held-out texts of sf0.01, by log10 probability a token."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [r for r in lm_scoring.score_texts(docs, PATH).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    tokens, base, score = (sum(r[x] for r in rows) for x in ("n_tokens", "base_score", "score"))
    assert len(rows) > 100 and score / tokens > base / tokens + 0.02
    texts = docs.toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in texts["doc_id"]])
    ids, bounds = lm_scoring.encode(pa.array(texts["text"][~held]), PATH, 1)
    start = lm_scoring.Attention(np.bincount(ids, minlength=49408))
    ids, bounds = lm_scoring.encode(pa.array(texts["text"][held]), PATH, 1)
    x, y, _ = start.windows(ids, bounds)
    untrained = (start.log_probs(x, y).sum() + start.share[ids].sum()) / np.log(10)
    assert score > untrained + 0.5 * tokens


def test_lm_shares():
    for top in (1.0, 500.0):
        x = np.array([[top, 0, -1e9], [0, 0, 0]])
        want = np.log(np.array([1 / (1 + np.exp(-top)), 1 / 3]))
        assert lm_scoring.shares(x, x[:, 0].copy()) == pytest.approx(want) and x.sum(axis=1) == pytest.approx(1)


def test_lm_softmax_does_not_depend_on_other_rows():
    model = attention([3] * 50)
    model.p["t"][1, lm_scoring.Q], model.p["t"][1, lm_scoring.K] = 40, 40
    ids = np.array([0] * 12 + [9] * 12)
    x, y, _ = model.windows(ids, np.array([0, 12, 24]))
    assert model.attend(x)[3].sum(axis=2) == pytest.approx(1)
    assert model.log_probs(x, y)[1] == pytest.approx(model.log_probs(x[1:], y[1:])[0])


def test_lm_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TOP", 4)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(("The", "cat", "sat", "mat", f"w{i}")) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(500, None), (None, "the cat"), (7, "cat cat"), (7, "cat cat"), (501, "mat " * 3000)]
    got = lm_scoring.score_texts(docs_of(spark, items), PATH).collect()
    count = defaultdict(int)
    for i, t in items:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            for w in [*words_of(t), None]:
                count[w] += 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(words_of(t)) + 1, sum(count[w] > 0 for w in [*words_of(t), None]), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in [*words_of(t), None]), 4)) for i, t in items)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    filler = "plain words about nothing in particular that go on and on " * 5
    data = [(1, "a/b/LICENSE", mit), (2, "a/b/c/x.txt", filler), (3, "a/x.txt", filler), (4, "a/b/y.txt", f"{filler}\n{gpl}\n{filler}"), (5, None, None), (6, "a/b/z.txt", ""), (7, "a/b/c/LICENSE", gpl), (7, "a/b/c/LICENSE", gpl), (8, "q/r.txt", "MIT is a school")]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["how"], r["from_dir"]) for r in license_scan.scan(df).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "a/b/c"), 3: (None, "none", None), 4: ("GPL-3.0", "header", None), 5: (None, "none", None), 6: ("MIT", "inherited", "a/b"), 7: ("GPL-3.0", "file", None), 8: (None, "none", None)}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_licences_in_spans(spark):
    filler = "plain words about nothing in particular that go on and on " * 5
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    texts = {
        1: ("Copyright (c) 2020 Example Inc. All rights reserved.", "all-rights-reserved"),
        2: (f"{filler} all of it is released under the MIT License by its authors, {filler}", "MIT"),
        3: (f"{filler} the photos are licensed under CC BY-NC 4.0 unless stated otherwise {filler}", "CC-BY-NC-4.0"),
        4: (gpl + filler, "GPL-3.0"),
        5: ("The MIT License (MIT)\n\n" + filler, "MIT"),
        6: ("MIT is a school, all human rights count, and a license is a paper", None),
        7: (license_scan.FULL["MIT"].replace("MIT License", "MIT License\n\nCopyright (c) 2021 Jane Example\n\n"), "MIT"),
        8: (f"{filler}\nThis Source Code Form is subject to the terms\nof the Mozilla Public License, v. 2.0.\n{filler}", "MPL-2.0"),
    }
    rows = [(i, f"d{i}/x", t) for i, (t, _) in texts.items()] + [(i, f"e{i}/x", filler) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in license_scan.scan(df).collect()}
    assert {i: got[i][0] for i in texts} == {i: name for i, (_, name) in texts.items()}
    assert got[7][1] == "file" and got[4][1] == "header" and all(got[i] == (None, "none") for i in range(100, 300))


def test_licence_words_that_are_needed():
    v = {t: 0.5 for t in "abcd"}
    assert len(license_scan.telling([v], {t: 1.0 for t in v}, 0.6)) == 3


def brute_licence(text, idf, unseen):
    """(name, score) of the best span by plain loops over all of them."""
    words = lambda x: re.findall(license_scan.TERM, x.lower())

    def cosine(span, template):
        v = license_scan.vector(template, idf)
        size = math.sqrt(sum((span.count(w) * idf.get(w, unseen)) ** 2 for w in set(span)))
        return sum(v.get(w, 0) * idf.get(w, 0) for w in span) / size if size else 0

    found, every = [], words(text)
    for line in text.split("\n"):
        found += [(cosine(words(line), x), n) for n, x in license_scan.TEMPLATES.items()]
    for name, x in [*license_scan.TEMPLATES.items(), *((n, x) for n, group in license_scan.NOTICES.items() for x in group)]:
        n = len(words(x))
        for i in (i for i, w in enumerate(every) if w in words(x)):
            span = every[min(i, max(0, len(every) - n)) :][:n]
            if n > license_scan.SHORT or set(words(x)) <= set(span):
                found.append((cosine(span, x), name))
    found += [(cosine(every, x), n) for n, x in license_scan.FULL.items() if len(every) <= 2 * len(words(x))]
    good = [(round(c, 9), n) for c, n in found if round(c, 9) >= license_scan.THRESHOLD]
    return min(good, key=lambda x: (-x[0], x[1]))[::-1] if good else (None, None)


def test_licences_against_brute_force(spark):
    """Notices whole, cut, shuffled and inside other words; ties; a long text; columns with clashing names."""
    rng = random.Random(11)
    notices = [*license_scan.TEMPLATES.values(), *(x for group in license_scan.NOTICES.values() for x in group)]
    texts = []
    for _ in range(60):
        w = rng.choice(notices).split(" ")
        kind = rng.randint(0, 3)
        w = w[: rng.randint(1, len(w))] if kind == 0 else w[::2] + w[1::2] if kind == 1 else [x for y in w for x in ([y, "word"] if rng.random() < 0.2 else [y])] if kind == 2 else w
        filler = [rng.choice(("some", "plain", "words", "the", "of", "license", "software")) for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(filler[:10]) + rng.choice(("\n", " ")) + rng.choice((" ", "\n")).join(w) + rng.choice(("\n", " ")) + " ".join(filler[10:]))
    texts += ["", "All rights reserved. Released under the MIT License.", "filler " * 4000 + "\nReleased under the MIT License."]
    df = spark.createDataFrame([(i, f"d{i}/x", t, "mine", 1) for i, t in enumerate(texts)], "doc_id long, path string, text string, own string, dir int")
    templates = [x for _, x in [*license_scan.TEMPLATES.items(), *((n, x) for n, group in license_scan.NOTICES.items() for x in group), *license_scan.FULL.items()]]
    idf, unseen = license_scan.weights(df, "text", templates)
    got = {r["doc_id"]: (r["licence"], r["score"]) for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        name, score = brute_licence(t, idf, unseen)
        assert got[i][0] == name and (score is None or got[i][1] == pytest.approx(score, abs=2e-9)), t


def test_clashing_columns_change_nothing(spark):
    """Every operator that drops extra columns, on a table that has columns with the names it uses inside."""
    rng = random.Random(13)
    items = [(i, " ".join(rng.choice(("one", "two", "tree", "house", "bad")) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(None, None), (3, ""), (5, "ties"), (5, "ties"), (50, "long text " * 6000)]
    docs = docs_of(spark, items)
    names = "key learn n comp token tokens matches place rep node ids part word more copies base known rare score held best shares lettered bytes all nth piece start length local rank first size text_crc32 row_number shard slot keys host path rule own dir c0 c1 _key _at _p _part".split()
    more = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)], F.lit(1).alias("dotted.name"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(0, items[1][1])], "item_id long, text string")
    runs = {
        "op1": lambda d: jaccard_join.jaccard_classes(d, 4, 85, sketch_bits=10), "op2": lambda d: lm_scoring.score_texts(d, PATH), "op4": lambda d: language_id.identify(d).drop("shares"), "op5": lambda d: packing.pack(d, PATH).groupBy("doc_id", "piece", "length", "ids_crc32").count(),
        "op6": lambda d: decontamination.leaks(d, bench), "op7": lambda d: license_scan.scan(d.withColumn("path", F.lit("a/b"))), "op8": lambda d: sharding.shard_rows(d, 4), "op9": lambda d: toxicity.scores(d, labels),
    }
    plain = lambda rows: sorted((tuple(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)
    for name, run in runs.items():
        one, two = run(docs), run(more)
        assert one.columns == two.columns, name
        assert plain(one.collect()) == plain(two.collect()), name
