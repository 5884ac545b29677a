"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

# Levels come from sources in the order in which they fill up: the level that all
# sources from one on would share, and the first that stays below its limit there.
MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, {WORDS} AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k, hash(text) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0) AS full_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
         1.5::DOUBLE * sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY source_size / weight::DOUBLE, source IS NULL, source) AS turn
  FROM sources
  WINDOW w AS (ORDER BY source_size / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((total - full_before) / weight_left, turn) AS level FROM filling WHERE (total - full_before) / weight_left * weight < most
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM filling, level
), running AS (
  SELECT s.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, size, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (passes * size + greatest(0, least(size, floor(target) - passes * source_size - before)))::BIGINT AS taken
FROM running
"""

# All pairs that share a shingle; documents are nodes, and the smallest id reachable is the component.
NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sized AS (
  SELECT doc_id, len(s)::BIGINT AS n, s FROM shingles
), items AS (
  SELECT doc_id, n, unnest(s) AS x FROM sized
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, s.n AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sized s JOIN least l ON s.doc_id = l.node
"""

ORACLE: dict[str, str] = {"op2_mix_sources": MIX, "op9_near_dups": NEAR}


def _crc32(value: str) -> str:
    """Unsigned CRC-32 of a short string, bit by bit."""
    bits = f"list_transform(range(8 * strlen({value})), lambda i: (ascii(substr({value}, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)"
    step = "lambda crc, bit: CASE WHEN (crc + bit) % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END"
    return f"xor(4294967295, list_reduce(list_transform({bits}, lambda b: b::BIGINT), {step}, 4294967295::BIGINT))"


# Levels of a tree that the SQL spells out; a level above the root leaves it as it is.
_LANG_LEVELS, _TOP_LEVELS = 8, 3


def _merkle() -> str:
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""leaves AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM documents
), t0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), n0 AS (
  SELECT lang, pos, leaf AS digest FROM t0
)"""]

    def level(name: str, k: int, by: str) -> None:
        own = f"PARTITION BY {by}pos // 8 ORDER BY pos"
        parts.append(f"""{name}s{k} AS (
  SELECT *, count(*) OVER ({('PARTITION BY ' + by.rstrip(', ')) if by else ''}) > 1 AS hashed,
    coalesce(string_agg(digest, '') OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER ({own} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT {by}pos // 8 AS pos, CASE WHEN any_value(hashed) THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
  FROM {name}s{k} GROUP BY {by}pos // 8
)""")

    for k in range(_LANG_LEVELS):
        level("n", k, "lang, ")
    parts.append(f"m0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, digest FROM n{_LANG_LEVELS})")
    for k in range(_TOP_LEVELS):
        level("m", k, "")
    parts.append(f"""f0 AS (
  SELECT t.*, s.digest AS subroot, r.digest AS root, s.pos AS top, '' AS proof, t.changed AS fold
  FROM t0 t JOIN m0 s ON t.lang IS NOT DISTINCT FROM s.lang CROSS JOIN m{_TOP_LEVELS} r
)""")
    steps = [(f"ns{k}", f"s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos // {8**k}") for k in range(_LANG_LEVELS)]
    steps += [(f"ms{k}", f"s.pos = f.top // {8**k}") for k in range(_TOP_LEVELS)]
    for i, (table, match) in enumerate(steps):
        parts.append(f"""f{i + 1} AS (
  SELECT f.* REPLACE (CASE WHEN s.hashed THEN f.proof || s.before || s.after ELSE f.proof END AS proof,
                      CASE WHEN s.hashed THEN sha256(s.before || f.fold || s.after) ELSE f.fold END AS fold)
  FROM f{i} f JOIN {table} s ON {match}
)""")
    return "WITH " + ", ".join(parts) + (
        f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{len(steps)}")


# Sequences themselves are the keys; a node lies below all shorter starts of its smallest member.
TRIE = f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), sized AS (
  SELECT *, ({_crc32('conv_id::VARCHAR')} % 9)::INT AS h FROM turns
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t FROM sized c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5
), starts AS (
  SELECT conv_id, d, t[1:d] AS node, len(t) = d AS ends FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM built)
), nodes AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(strlen(any_value(node)[-1].text), 0) AS saved
  FROM starts GROUP BY node
), kids AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT m.node[1:a.d] AS node, sum(m.saved)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes m LEFT JOIN kids k ON k.node = m.node, (SELECT unnest(range(1000)) AS d) a WHERE a.d <= m.depth GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
       b.saved AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN kids k ON k.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""

ORACLE |= {"op12_merkle_manifest": _merkle(), "op13_prefix_trie": TRIE}
