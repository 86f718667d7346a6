"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidewheel.llm import collocations, decontamination, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, merkle, packing, quality_rules, sharding, toxicity, twins, url_filter
from tidewheel.llm.scratch import doc_hash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their 4-word shingle set and their component at a similarity of 0.85."""
    found = jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the model's and the base's log10 probability."""
    scored = lm_scoring.score_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return scored.select("doc_id", (doc_hash() % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The rules of the url filter, and host names that are blocked under every ending.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{n}.example.{e}" for n in BLOCKED_NAMES for e in ("com", "net", "org"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls judged by the rules, and by the list of blocked hosts where none fits."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), [url_filter.Rule(*r) for r in URL_RULES], BLOCKED_HOSTS)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their language."""
    found = language_id.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (doc_hash() % 5 == 0).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it leaks, of all documents and items."""
    found = decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered_words", "item_words", F.size("tiles").cast("long").alias("n_tiles"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited.

    Paths are made from the table: source, language, a folder of 64 ids; the first
    id of each folder stands one level higher.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 64 != 0, F.concat(F.lit("/"), F.floor(F.col("doc_id") / 64).cast("string"))).otherwise("")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.coalesce(folder, F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return license_scan.scan(docs.select("doc_id", "text", path.alias("path")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards whose row counts differ by one at most."""
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity score."""
    docs, labels = (_table(spark, sf_dir, x) for x in ("documents", "labels"))
    scored = toxicity.scores(docs, labels)
    return scored.select("doc_id", (doc_hash() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents, with the verdict of the newest policy."""
    book = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    base, newest = quality_rules.POLICIES[0], quality_rules.POLICIES[-1]
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes(base)).alias("base_failed"), quality_rules.passes(newest).alias("kept"), "failed"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language, of all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stay in another one, as digests."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a manifest by language, with the roots that tampered texts lead to."""
    return merkle.tampered_check(_table(spark, sf_dir, "documents"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects over all documents, alone and with others, and what stays without it."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


SQL: dict[str, str] = {
    "op3_url_filter": """
WITH r(verdict, host, path) AS (VALUES """
    + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    + """), b(host) AS (VALUES """
    + ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    + r"""),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
f AS (SELECT rid, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC) AS k
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE u.host = b.host OR ends_with(u.host, '.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON f.rid = u.rid AND f.k = 1""",
    "op1_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (
        SELECT rid, list_slice(ws, i, i + 3) AS sh FROM d, unnest(range(1, len(ws) - 2)) AS t(i) WHERE len(ws) >= 4
        UNION ALL SELECT rid, ws FROM d WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.rid < y.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid AS node, rid AS root FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (rid)
JOIN (SELECT r.node, min(m.doc_id) AS component_id FROM r JOIN d m ON m.rid = r.root GROUP BY r.node) c ON c.node = d.rid""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS win FROM w, unnest(range(1, len(ws) - 6)) AS t(i) WHERE len(ws) >= 8),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, i - prev))::BIGINT AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8) AS prev FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(text, '!!')) AS n_shouts,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_shouts > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_stutters > 30 * n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
}

SQL |= {"op11_collocations": twins.PHRASES, "op12_line_dedup": twins.LINES, "op13_merkle_manifest": twins.MERKLE}

_bits = lambda names: sum(1 << quality_rules.NAMES.index(n) for n in names)
_CASES = ", ".join(f"('{p.name}', {p.version}, '{n}', {_bits(p.rejects)}, {_bits([n])})" for p in quality_rules.POLICIES for n in p.rejects)
SQL["rule_ablations"] = f"""WITH book AS ({SQL["op10_quality_rules"]}), c(policy, version, rule, mask, bit) AS (VALUES {_CASES})
SELECT policy, version, rule, count(*) FILTER ((failed & mask & bit) <> 0) AS rejected, count(*) FILTER ((failed & mask) = bit) AS rejected_alone, count(*) FILTER ((failed & mask) = 0) AS kept,
  count(*) FILTER ((failed & xor(mask, bit)) = 0) AS kept_without FROM book, c GROUP BY ALL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_jaccard_join": op1_jaccard_join, "op2_lm_scoring": op2_lm_scoring, "op3_url_filter": op3_url_filter, "op4_language_id": op4_language_id, "op5_packing": op5_packing, "op6_decontamination": op6_decontamination, "op7_license_scan": op7_license_scan, "op8_sharding": op8_sharding, "op9_toxicity": op9_toxicity, "op10_quality_rules": op10_quality_rules, "op11_collocations": op11_collocations, "op12_line_dedup": op12_line_dedup, "op13_merkle_manifest": op13_merkle_manifest, "rule_ablations": rule_ablations}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
