"""SQL twins of the phrase, line and manifest queries, for DuckDB."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _levels(name: str, nodes: str, levels: int) -> str:
    """CTEs of a tree over ``nodes`` (g, i, n, h): name0, name1, ... with the siblings left and right of each node."""
    out = []
    for k in range(levels):
        below = nodes if not k else f"(SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1} GROUP BY g, i // 8)"
        side = lambda a, b: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {a} AND {b}), '')"
        out.append(f"{name}{k} AS (SELECT *, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r FROM {below})")
    return ",\n".join(out)


def _folded(name: str, nodes: str, levels: int) -> str:
    """CTEs that carry ``h`` (folded) and ``proof`` from the rows of ``nodes`` (g, i, h, proof, ...) to the top of a tree."""
    out, last = [], nodes
    for k in range(levels):
        out.append(
            f"{name}f{k} AS (SELECT x.* REPLACE (CASE WHEN t.n > 1 THEN sha256(t.l || x.h || t.r) ELSE x.h END AS h, CASE WHEN t.n > 1 THEN x.proof || t.l || t.r ELSE x.proof END AS proof) FROM {last} x JOIN {name}{k} t ON t.g = x.g AND t.i = x.i // {8**k})"
        )
        last = f"{name}f{k}"
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR))::VARCHAR || ':' || CAST({value} AS VARCHAR), '-')"


_HEAD = " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars"))
_ID = "coalesce(CAST(doc_id AS VARCHAR), '')"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({_ID}) + 1), lambda i: ascii({_ID}[i])::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"

#: Trees of up to 8 ** 7 leaves a language and 8 ** 3 languages.
MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_HEAD} AS head, text, translate(text, '{UP}', '{LOW}') AS low, {_CRC} AS c FROM documents),
v AS (SELECT doc_id, g, sha256(head || {_field("text")}) AS leaf, CASE WHEN c % 3 = 0 THEN sha256(head || {_field("low")}) END AS other FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM v),
{_levels("a", "(SELECT g, i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM o)", 8)},
s AS (SELECT g AS key, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a7),
{_levels("b", "(SELECT 1 AS g, i, n, h FROM s)", 4)},
x AS (SELECT doc_id, g, i, leaf, coalesce(other, leaf) AS h, '' AS proof FROM o),
{_folded("a", "x", 7)},
y AS (SELECT f.doc_id, f.leaf, s.h AS subroot, 1 AS g, s.i AS i, f.h, f.proof FROM af6 f JOIN s ON s.key = f.g),
{_folded("b", "y", 3)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified FROM bf2 f, (SELECT h AS root FROM b3)"""


#: Every contiguous run of one to four words inside a piece, counted by language.
PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS ph FROM (SELECT lang, ws, unnest(range(1, 5)) AS k FROM w), unnest(range(1, len(ws) - k + 2)) AS t(i)),
f AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT f.lang, f.ph, f.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * f.f) // (l.f + r.f) AS score
      FROM f, unnest(range(1, f.k)) AS t(j), f l, f r
      WHERE f.k >= 2 AND l.lang = f.lang AND l.ph = list_slice(f.ph, 1, j) AND r.lang = f.lang AND r.ph = list_slice(f.ph, j + 1, f.k)),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
inside AS (SELECT lang, list_slice(ph, i, i + m - 1) AS ph, max(f) AS longer FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.ph, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN inside USING (lang, ph) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""

#: Lines by key; white space is stripped at both ends of each.
LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, id, i, ls[i] AS line, translate(trim(ls[i], {SPACE}), '{UP}', '{LOW}') AS key FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
k AS (SELECT key, min(id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT rid) >= 2),
j AS (SELECT l.*, first IS NOT NULL AND first <> id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY rid, doc_id"""
