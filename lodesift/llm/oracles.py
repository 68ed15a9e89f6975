"""DuckDB SQL of the queries on manifests, benchmarks and vector codes."""

from __future__ import annotations

_BITS = 'list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), \'\'), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))), lambda a, b: xor((CASE WHEN b < 0 THEN a ELSE xor(a, b) END) >> 1, 3988292384 * ((CASE WHEN b < 0 THEN a ELSE xor(a, b) END) & 1)))'
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: The complement of a CRC-32 is even where the register before it is odd.
_ODD = f"({_BITS}) & 1 = 1"
_GROW = "SELECT level + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {0}) WHERE c > 1 GROUP BY level, g, pos // 3"
MERKLE = (
    f"WITH RECURSIVE l AS (SELECT *, {_LEAF.format(text='text')} AS leaf, CASE WHEN {_ODD} THEN {_LEAF.format(text='replace(text, chr(10), chr(0))').replace('chr(0)', chr(39) * 2)} END AS other FROM documents), "
    "p AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM l), "
    f"t(level, g, pos, h) AS (SELECT 0::BIGINT, g, pos, leaf FROM p UNION ALL {_GROW.format('t')}), "
    "d AS (SELECT g, max(level) AS depth FROM t GROUP BY g), s AS (SELECT g, h FROM t JOIN d USING (g) WHERE level = depth), "
    f"u(level, g, pos, h) AS (SELECT 0::BIGINT, 0::BIGINT, g, h FROM s UNION ALL {_GROW.format('u')}), "
    "e AS (SELECT max(level) AS depth FROM u), r AS (SELECT h AS root FROM u, e WHERE level = depth), "
    "k AS (SELECT rid, g, 0 AS up, i AS level, pos // CAST(pow(3, i) AS BIGINT) AS pos FROM p JOIN d USING (g), unnest(range(depth)) AS x(i) UNION ALL SELECT rid, 0, 1, i, g // CAST(pow(3, i) AS BIGINT) FROM p, e, unnest(range(depth)) AS x(i)), "
    "n AS (SELECT 0 AS up, * FROM t UNION ALL SELECT 1, * FROM u), "
    "a AS (SELECT rid, up, level, coalesce(string_agg(h, '' ORDER BY n.pos) FILTER (n.pos < k.pos), '') AS b, coalesce(string_agg(h, '' ORDER BY n.pos) FILTER (n.pos > k.pos), '') AS c FROM k JOIN n USING (up, g, level) WHERE n.pos // 3 = k.pos // 3 GROUP BY rid, up, level), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY up, level) AS step, count(*) OVER (PARTITION BY rid) AS steps FROM a), "
    "f(rid, step, h) AS (SELECT rid, 0::BIGINT, coalesce(other, leaf) FROM p UNION ALL SELECT f.rid, f.step + 1, sha256(o.b || f.h || o.c) FROM f JOIN o ON o.rid = f.rid AND o.step = f.step + 1), "
    "z AS (SELECT rid, arg_max(h, step) AS folded_root FROM f GROUP BY rid), y AS (SELECT rid, string_agg(b || c, '' ORDER BY step) AS w FROM o GROUP BY rid) "
    "SELECT doc_id, leaf, s.h AS subroot, root, sha256(coalesce(w, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN s USING (g) JOIN z USING (rid) LEFT JOIN y USING (rid), r"
)

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = (
    f"WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark), c AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0 AND item IS NOT NULL), "
    "g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS v FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM c)), "
    f"d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), k AS (SELECT DISTINCT n FROM g), "
    "o AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS v FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN k ON len(w) >= n)), "
    "h AS (SELECT r, i, n, item FROM o JOIN g USING (n, v)), x AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r), "
    "y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r) "
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)"
)


def codes(rounds: int = 2, parts: int = 16, entries: int = 64, scale: int = 256) -> str:
    """Plain rounds of Lloyd: every part against every entry."""
    near = "SELECT r, p, arg_min(e, d * 1024 + e) AS e, min(d) AS d FROM (SELECT r, v.p, e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{0} AS c USING (p)) GROUP BY r, p"
    down = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [
        f"a AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT r, p, w[p * (len(w) // {parts}) + 1 : (p + 1) * (len(w) // {parts})] AS x FROM a, unnest(range({parts})) AS q(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM v WHERE r <= {entries})",
    ]
    for k in range(rounds):
        steps += [
            f"n{k} AS MATERIALIZED ({near.format(k)})",
            f"m{k} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM n{k} JOIN v USING (r, p)) GROUP BY p, e, i)",
            f"u{k} AS (SELECT p, e, list({down} ORDER BY i) AS x FROM m{k} GROUP BY p, e)",
            f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.x, c.x) AS x FROM c{k} AS c LEFT JOIN u{k} AS u USING (p, e))",
        ]
    steps += [
        f"f AS MATERIALIZED ({near.format(rounds)})",
        "g AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM a JOIN g USING (r), h"


CODES = codes()
