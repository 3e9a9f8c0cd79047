"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row: the 256 entries of the CRC-32 table, by eight shifts each.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; `tab` must be in scope."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    data = f"list_transform(range(1, 1 + octet_length(encode({text}))), lambda i: CAST(16 * {digit('2 * i - 1')} + {digit('2 * i')} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c // 256)), 4294967295)"


def importance(seed: int = 2024, buckets: int = 10_000, least: int = 20, percent: int = 10) -> str:
    def cut(table: str, key: str) -> str:
        return f"SELECT {key} AS k, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"

    return f"""WITH {_CRC_TABLE}, d AS (SELECT row_number() OVER () AS r, * FROM documents), dw AS ({cut('d', 'r')}), bw AS ({cut('benchmark', 'item_id')}),
v AS (SELECT w, {_crc('w')} % {buckets} AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), crc),
db AS (SELECT k, b, count(*) AS c FROM dw JOIN v USING (w) GROUP BY k, b), s AS (SELECT b, CAST(sum(c) AS BIGINT) AS n FROM db GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {buckets}) / ((s.n + 1)::DOUBLE * (t_all + {buckets})))) AS gain FROM s LEFT JOIN t USING (b), sums),
w AS (SELECT k, CAST(sum(c) AS BIGINT) AS n, CAST(floor(sum(c * gain) / sum(c)) AS BIGINT) AS weight FROM db JOIN g USING (b) GROUP BY k),
h AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 1)) - 1)::BIGINT)), lambda x, y: 16 * x + y) AS h FROM d LEFT JOIN w ON w.k = d.r),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS able FROM o WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * able // 100 THEN place END AS rank FROM o LEFT JOIN p USING (r)"""


def merkle(fan: int = 16) -> str:
    def part(column: str) -> str:
        return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column}, '-')"

    def tree(name: str, start: str) -> str:
        return f"{name} AS ({start} UNION ALL SELECT g, level + 1, pos // {fan}, (n + {fan - 1}) // {fan}, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // {fan}, n)"

    def siblings(name: str, of: str) -> str:
        run = f"(PARTITION BY g, level, pos // {fan} ORDER BY pos ROWS BETWEEN"
        return f"{name} AS (SELECT g, level, pos, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS s FROM {of} WHERE n > 1)"

    def above(key: str, nodes: str, found: str, same: str) -> str:
        return f"SELECT x.{key}, list(y.s ORDER BY y.level) AS path FROM {nodes} x JOIN {found} y ON {same} AND y.pos = x.pos // CAST(pow({fan}, y.level) AS BIGINT) GROUP BY x.{key}"

    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{_UP}', '{_LOW}')"
    return f"""WITH RECURSIVE {_CRC_TABLE}, d AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({head} || {part('text')}) AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({head} || {part(lower)}) END AS changed FROM documents, crc),
e AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM e),
{tree('own', 'SELECT g, 0 AS level, pos, n, leaf AS h FROM f')},
subroots AS (SELECT g, h FROM own WHERE n = 1), tops AS (SELECT g AS of, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, h FROM subroots),
{tree('over', "SELECT '' AS g, 0 AS level, pos, n, h FROM tops")}, {siblings('own_s', 'own')}, {siblings('over_s', 'over')},
inner_p AS ({above('r', 'f', 'own_s', 'y.g = x.g')}), outer_p AS ({above('of', 'tops', 'over_s', 'true')}),
a AS (SELECT doc_id, leaf, changed, t.h AS subroot, (SELECT h FROM over WHERE n = 1) AS root, list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path FROM f JOIN tops t ON t.of = f.g LEFT JOIN inner_p i ON i.r = f.r LEFT JOIN outer_p o ON o.of = f.g),
b AS (SELECT *, sha256(array_to_string(list_transform(path, lambda x: replace(x, '|', '')), '')) AS proof_sha256, list_reduce(list_prepend(coalesce(changed, leaf), path), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM b"""
