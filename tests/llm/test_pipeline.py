"""The pipeline against a plain version of every stage."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_rules, words_of
from tidewheel.llm import subwords


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    docs = []
    for i in range(300):
        t = text(rng.randint(25, 60))
        if i % 6 == 0:
            w = t.split(" ")
            w[3], w[9] = "zzzbad", "zzzworse"
            t = " ".join(w)
        docs.append((i, t))
    docs += [(400 + i, docs[1][1] + f" tail{i}") for i in range(5)]
    docs += [(500, "too short"), (501, text(30).replace(" ", " ### ")), (502, text(10) + " " + item[len(item) // 2 :] + " x " + item[: len(item) // 2]), (503, None), (504, ""), (None, text(30)), (7, docs[7][1])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages_keep_their_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "decontamination", "packing"]
    assert corpus_pipeline.apply_rules(spark, docs, path).columns == docs.columns


#: Names that the operators use inside, or once did.
CLASHES = ["failed", "n_words", "word_chars", "w", "l", "_w", "_own", "_key", "_stay", "key", "stay", "id", "alone", "nth", "score", "_score", "_gone", "_mark", "gone", "mark", "c0", "c1", "n", "comp", "doc.id", "Tokens"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_columns_alone(spark, folder, name):
    """Columns with any name come through with their values; rows stay as without them."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit(""))).alias(c) for c in CLASHES])
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, got = stage(spark, docs, path), stage(spark, more, path)
    if name == "packing":
        assert got.columns == plain.columns and got.count() == plain.count()
        return
    assert got.columns == more.columns
    rows = [tuple(r) for r in got.collect()]
    assert all(r[5 + i] == f"{c} {r[1] or ''}" for r in rows for i, c in enumerate(CLASHES))
    assert sorted((r[:5] for r in rows), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_pipeline(spark, folder):
    path, docs = folder
    left = [(i, t) for i, t in docs if "zzzbad" not in (t or "")]
    left = [(i, t) for i, t in left if (r := brute_rules(t))[0] >= 20 and 100 * r[4] <= 30 * r[0] and 100 * r[2] <= 20 * r[0]]
    _, groups, _ = brute_components(left, 5, 80)
    left = [min((left[j] for j in g), key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    left = [(i, t) for i, t in left if i != 502]
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted({str(r["doc_id"]) for r in got}) == sorted({str(i) for i, _ in left})
    coder = subwords.coder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = sum(len(coder.encode(t, add_special_tokens=False).ids) + 1 for _, t in left)
    assert sum(r["length"] for r in got) == want and all(words_of(t) for _, t in left)
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
