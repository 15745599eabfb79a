"""SQL equivalents that take more than a few lines."""

from __future__ import annotations

from tallywarden.llm import merkle, prefix_trie


def crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, as an unsigned number."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i: {step})"
    values = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {values}, lambda a, b: {byte}), 4294967295)"


def _climb(name: str, nodes: str, levels: int) -> str:
    """CTEs ``{name}_0`` .. with tree, pos, node and n, the nodes left in the tree; a lone node stays as it is."""
    parts = [f"{name}_0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({nodes}))"]
    for k in range(levels):
        parts.append(
            f"{name}_runs_{k} AS (SELECT tree, pos // {merkle.ARITY} AS run, any_value(n) AS n, list(node ORDER BY pos) AS nodes "
            f"FROM {name}_{k} GROUP BY tree, run)"
        )
        parts.append(
            f"{name}_{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, run AS pos, "
            f"CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {name}_runs_{k}))"
        )
    return ",\n".join(parts)


def _follow(name: str, start: str, climb: str, levels: int) -> str:
    """CTEs ``{name}_0`` .. that take rows with tree, pos, folded and proof up the tree."""
    parts = [f"{name}_0 AS ({start})"]
    for k in range(levels):
        slot = f"d.pos % {merkle.ARITY}"
        before = f"array_to_string(r.nodes[1:{slot}], '')"
        after = f"array_to_string(r.nodes[{slot} + 2:], '')"
        parts.append(
            f"{name}_{k + 1} AS (SELECT d.* REPLACE (d.pos // {merkle.ARITY} AS pos, "
            f"CASE WHEN r.n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded, "
            f"CASE WHEN r.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof) "
            f"FROM {name}_{k} d JOIN {climb}_runs_{k} r ON r.tree = d.tree AND r.run = d.pos // {merkle.ARITY})"
        )
    return ",\n".join(parts)


def merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """``merkle.manifest`` for up to 8^levels rows a part and 8^upper parts."""

    def leaf(text: str) -> str:
        values = {c: c for c in merkle.COVERED} | {"text": text}
        fields = (f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values.values())
        return f"sha256({' || '.join(fields)})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = f"doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 3 = 0"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf(f'CASE WHEN {hit} THEN {low} ELSE text END')} AS checked
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{_climb('part', 'SELECT tree, pos, leaf AS node FROM placed', levels)},
subroots AS (SELECT tree AS part, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM part_{levels}),
{_climb('top', "SELECT '' AS tree, pos, node FROM subroots", upper)},
{_follow('doc', "SELECT doc_id, tree, pos, leaf, checked AS folded, '' AS proof FROM placed", 'part', levels)},
{_follow('high', f"SELECT doc_id, '' AS tree, s.pos AS pos, leaf, s.node AS subroot, folded, proof FROM doc_{levels} d JOIN subroots s ON s.part = d.tree", 'top', upper)}
SELECT doc_id, leaf, subroot, t.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.node AS verified
FROM high_{upper} JOIN top_{upper} t ON true"""


def trie_sql() -> str:
    """``prefix_trie.rebuilt_trie``; a node is named by the digests of its turns in a row."""
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, md5(length(role) || '|' || role || text) AS key, strlen(text) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM said),
ids AS (
  SELECT conv_id, conv_id - conv_id % {prefix_trie.BLOCK} AS base,
    {crc32_sql('conv_id::VARCHAR')} % {prefix_trie.MOST_BORROWED + 1} AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT i.conv_id, 0 AS part, n, key, size FROM ids i JOIN own o ON o.conv_id = i.base WHERE n <= h
  UNION ALL SELECT i.conv_id, 1, n, key, size FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE n > h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS pos FROM turns),
steps AS (
  SELECT conv_id, pos, size, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
    pos = count(*) OVER (PARTITION BY conv_id) AS last FROM placed
  UNION ALL SELECT conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM placed p WHERE p.conv_id = i.conv_id) FROM ids i),
nodes AS (
  SELECT path, any_value(pos) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM steps GROUP BY path),
children AS (SELECT path[1:-33] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT d.*, coalesce(c.n, 0) AS n_children FROM nodes d LEFT JOIN children c USING (path)),
sums AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens
  FROM counted a JOIN counted b ON b.depth >= a.depth AND starts_with(b.path, a.path) GROUP BY a.path)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:-33]"""
