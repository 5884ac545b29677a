"""The same queries as SQL text, for a second engine to check the results."""

from __future__ import annotations

from ..functions import fixed_values as V
from ..sources import fixtures as X
from .sql_tables import AS_OF, growth, half_even, quote, retrievability, step, tag_case, time, with_tables

ORACLE: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    ORACLE[name] = with_tables(body)


# --- scans, sources, sinks ---------------------------------------------------------

sql("scan_nodes", "SELECT owner_id, id, parent_id, name FROM live")
_ACCEPTED = "json_type(item, '$.id') = 'VARCHAR' AND json_type(item, '$.name') = 'VARCHAR'"
sql("ingest_json_records", f"""
    SELECT source, item->>'$.id' AS id, item->>'$.name' AS name,
           CASE WHEN json_type(item, '$.content') = 'VARCHAR' THEN item->>'$.content' ELSE '' END AS content,
           nullif(item->>'$.parentId', '') AS parent_id,
           CASE WHEN json_type(item, '$.sortOrder') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(item->>'$.sortOrder' AS DOUBLE)
                ELSE (row_number() OVER (PARTITION BY source ORDER BY spot) - 1)::DOUBLE END AS sort_order
    FROM array_items WHERE {_ACCEPTED}""")
sql("ingest_json_rejects", f"""
    SELECT source, 'missing_id_or_name' AS reason FROM array_items WHERE NOT coalesce({_ACCEPTED}, FALSE)
    UNION ALL SELECT source, 'not_an_array' FROM raw_node_arrays WHERE NOT json_valid(raw)""")


def _legacy_time(n: str, kinds: int) -> str:
    day = f"'2023-05-' || lpad(({n} % 28 + 1)::VARCHAR, 2, '0')"
    return f"CASE {n} % {kinds} WHEN 0 THEN {day} || ' 07:08:09' WHEN 1 THEN {day} || ' 05:08:09' END"


sql("import_legacy_nodes", f"""
    SELECT p_partkey::VARCHAR AS id, p_brand AS owner_id, p_name AS name,
           CASE p_partkey % 3 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '{{"other":1}}' ELSE p_name END AS content,
           CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey - 1)::VARCHAR END AS parent_id,
           CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 5)::DOUBLE ELSE 0::DOUBLE END AS sort_order,
           CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE {quote(V.OTHER_TAG)} END AS domain_tag, p_partkey % 7 = 0 AS is_deleted,
           CASE WHEN p_partkey % 3 <> 2 THEN p_partkey % 6 ELSE 0 END AS depth,
           CASE WHEN p_partkey % 5 <> 1 THEN (p_partkey % 9) / 8::DOUBLE ELSE 0::DOUBLE END AS mastery_score,
           {_legacy_time("p_partkey", 4)} AS created_at, {_legacy_time("(p_partkey + 1)", 4)} AS updated_at
    FROM part""")
sql("import_legacy_edges", """
    SELECT (p_partkey - 1)::VARCHAR AS parent_id, p_partkey::VARCHAR AS child_id,
           CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 5)::DOUBLE ELSE 0::DOUBLE END AS sort_order,
           CASE WHEN p_partkey % 3 = 0 THEN 'related' ELSE 'parent-child' END AS relationship_type
    FROM part""")
sql("import_legacy_records", f"""
    SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR AS id, l_partkey::VARCHAR AS node_id, 'src' || (l_suppkey % 20) AS owner_id,
           NULL::VARCHAR AS question_id, l_returnflag = 'A' AS is_correct, {_legacy_time("(l_orderkey * 10 + l_linenumber)", 5)} AS answered_at
    FROM lineitem""")
sql("insert_ignore", """
    SELECT order_key, line, question_id, price FROM records
    WHERE (order_key, line) NOT IN (SELECT (order_key, line) FROM records WHERE NOT is_correct)
    QUALIFY row_number() OVER (PARTITION BY order_key, line ORDER BY question_id, price) = 1""")
sql("append_sink", "SELECT owner_id, is_correct, count(*) AS n FROM records GROUP BY ALL")
sql("upsert_by_key", """
    SELECT owner_id, id, name, CASE WHEN review_state = 'relearning' THEN stability + 1 ELSE stability END AS stability,
           CASE WHEN review_state = 'relearning' AND stability > 9 THEN 9 ELSE review_count END AS review_count
    FROM states""")
sql("evolve_schema", """
    SELECT id, owner_id, 0::DOUBLE AS mastery_score, 0::BIGINT AS depth, 0::DOUBLE AS stability, 0.3::DOUBLE AS difficulty,
           0::BIGINT AS review_count, 'new' AS review_state, NULL::VARCHAR AS last_review_at FROM nodes""")
sql("import_report", """
    SELECT 'nodes' AS table_name, count(*) AS n_rows FROM nodes
    UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'records', count(*) FROM records""")

# --- projections, filters ------------------------------------------------------------

sql("live_nodes", "SELECT owner_id, id, name, sort_order FROM live")
sql("root_nodes", "SELECT owner_id, id, name FROM live WHERE parent_id IS NULL")
sql("node_view", """SELECT id, name, coalesce(content, '') AS content, parent_id AS "parentId", sort_order AS "sortOrder" FROM nodes""")
sql("falsy_default", """
    SELECT id, stability, CASE WHEN difficulty = 0 THEN 0.3::DOUBLE ELSE difficulty END AS difficulty, review_count,
           coalesce(review_state, 'new') AS review_state FROM states""")
sql("null_safe_parent_match", """
    SELECT n.owner_id, n.id, n.parent_id FROM nodes n
    WHERE EXISTS (SELECT 1 FROM nodes w WHERE w.is_deleted AND w.owner_id = n.owner_id AND w.parent_id IS NOT DISTINCT FROM n.parent_id)""")
_DUE = f"(stability <= 0 OR last_review_at IS NULL OR next_review_at <= {AS_OF})"
sql("due_predicate", f"SELECT owner_id, id FROM states WHERE {_DUE}")
sql("reviewed_on_day", f"""
    SELECT owner_id, id, {time("last_review_at")} AS last_review_at FROM states
    WHERE {time("last_review_at")} LIKE '2024-01-27%'""")
sql("valid_rating", """
    SELECT event_id, rating::BIGINT AS rating, CASE WHEN rating BETWEEN 1 AND 4 THEN 'ok' ELSE 'rejected' END AS status FROM node_reviews""")
sql("clean_names", """
    SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE name || ' x' END AS name,
           CASE WHEN id % 5 = 0 THEN 'empty' ELSE 'ok' END AS status FROM nodes""")
sql("question_detail", f"""
    SELECT owner_id, id, node_id, question, options, correct_index, question_type, difficulty, {time("created_at")} AS created_at
    FROM questions WHERE (owner_id, id) IN (SELECT (owner_id, question_id) FROM records WHERE NOT is_correct)""")
sql("non_blank_content", r"""
    SELECT owner_id, id FROM nodes WHERE id % 4 <> 1 AND length(regexp_replace(content, '\s', '', 'g')) > 0""")

# --- joins -----------------------------------------------------------------------------

sql("parent_link", "SELECT owner_id, id, parent_id, up, parent_id IS NOT NULL AND up IS NULL AS is_orphan FROM links")
sql("orphan_nodes", "SELECT owner_id, id, parent_id FROM links WHERE parent_id IS NOT NULL AND up IS NULL")
sql("owned_events", """
    SELECT r.event_id, r.owner_id, r.node_id, CASE WHEN l.id IS NULL THEN 'rejected' ELSE 'ok' END AS status
    FROM node_reviews r LEFT JOIN live l ON l.owner_id = r.owner_id AND l.id = r.node_id""")
sql("missing_owners", "SELECT DISTINCT owner_id FROM live WHERE owner_id NOT IN (SELECT id FROM users)")
sql("owners_minus_users", "SELECT owner_id FROM live EXCEPT SELECT id FROM users")
sql("question_latest_attempt", """
    SELECT q.owner_id, q.id, q.node_id, q.question, q.question_type, a.is_correct IS NOT NULL AS answered,
           coalesce(a.is_correct, FALSE) AS last_correct
    FROM questions q LEFT JOIN last_attempt a ON a.question_id = q.id AND a.owner_id = q.owner_id""")
sql("latest_per_key", f"""
    SELECT owner_id, question_id, order_key, line, is_correct, {time("answered_at")} AS answered_at FROM last_attempt""")
sql("wrong_questions", f"""
    SELECT owner_id, id, question, {time("last_wrong_at")} AS last_wrong_at,
           row_number() OVER (PARTITION BY owner_id ORDER BY last_wrong_at DESC, id) AS rank
    FROM (SELECT q.owner_id, q.id, q.question, max(r.answered_at) AS last_wrong_at
          FROM questions q JOIN records r ON r.question_id = q.id WHERE NOT r.is_correct GROUP BY ALL)
    QUALIFY rank <= 20""")
sql("question_counts", """
    SELECT l.owner_id, l.id, (SELECT count(*) FROM questions q WHERE q.owner_id = l.owner_id AND q.node_id = l.id) AS question_count FROM live l""")
sql("grade_answers", """
    SELECT r.owner_id, q.question_type, q.question_type = 'short_answer' OR r.chosen_index = q.correct_index AS graded, count(*) AS n
    FROM records r JOIN questions q ON q.id = r.question_id GROUP BY ALL""")
sql("sibling_conflicts", """
    SELECT n.id + 1000000 AS seq, n.owner_id, n.parent_id, 'n' || (n.id % 3) AS name FROM nodes n
    WHERE EXISTS (SELECT 1 FROM live s WHERE s.owner_id = n.owner_id AND s.parent_id = n.parent_id AND s.name = 'n' || (n.id % 3))""")
sql("sibling_name_clashes", """
    SELECT owner_id, parent_id, name, count(*) AS n FROM live WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
sql("match_parent", "SELECT owner_id, wanted, parent_id, is_root FROM matches")
sql("keyword_match", " UNION ALL ".join(
    f"SELECT owner_id, id, {quote(domain)} AS domain, {prio}::BIGINT AS prio FROM taggable WHERE "
    + " OR ".join(f"contains(body, {quote(w)})" for w in words)
    for prio, (domain, words) in enumerate(X.TAG_RULES.items(), start=1)))
_RULES = """
    WITH rules AS (
      SELECT doc_id AS prio, 'd' || (doc_id % 50) AS domain, lower(substr(text, 11, 9)) AS keyword FROM documents
    ), bodies AS (
      SELECT owner_id, id, lower(coalesce(name, '') || ' ' || coalesce(content, '')) AS body FROM nodes
    ), hits AS (
      SELECT DISTINCT b.owner_id, b.id, r.domain FROM bodies b JOIN rules r ON contains(b.body, r.keyword)
    ), prios AS (
      SELECT domain, min(prio) AS prio FROM rules WHERE keyword IS NOT NULL GROUP BY domain
    )"""
sql("keyword_match_table", f"SELECT * FROM ({_RULES} SELECT owner_id, id, h.domain, prio FROM hits h JOIN prios p ON p.domain = h.domain)")
sql("tag_nodes_by_table", f"""
    SELECT * FROM ({_RULES}
      SELECT b.owner_id, b.id, coalesce(min_by(h.domain, (p.prio, h.domain)), {quote(V.OTHER_TAG)}) AS tag
      FROM bodies b LEFT JOIN (hits h JOIN prios p ON p.domain = h.domain) ON h.owner_id = b.owner_id AND h.id = b.id
      GROUP BY b.owner_id, b.id)""")
sql("move_conflicts", "SELECT owner_id, id, new_parent_id, reason FROM judged_moves")

# --- hierarchy ----------------------------------------------------------------------------

sql("node_depth", "SELECT owner_id, id, depth, FALSE AS in_cycle FROM tree")
sql("node_depth_deep", "SELECT owner_id, id, depth, FALSE AS in_cycle FROM deep_tree")
sql("node_depth_cyclic", """
    SELECT l.owner_id, l.id, t.depth, t.id IS NULL AS in_cycle FROM cyclic_links l LEFT JOIN cyclic_tree t ON t.id = l.id""")
sql("tree_root", "SELECT owner_id, id, root AS root_id FROM tree")
sql("ancestor_path", "SELECT owner_id, id, path FROM full_path")
sql("ancestor_path_cyclic", "SELECT owner_id, id, path FROM full_cyclic_path")
sql("descendant_closure", "SELECT owner_id, ancestor, descendant, distance FROM closure")
sql("is_descendant", """
    SELECT l.owner_id, l.id AS candidate, l.id % 20 + 20 * (l.id % 7) AS ancestor,
           EXISTS (SELECT 1 FROM closure c WHERE c.ancestor = l.id % 20 + 20 * (l.id % 7) AND c.descendant = l.id) AS is_descendant
    FROM live l""")
sql("blocked_move_targets", "SELECT owner_id, ancestor AS id, descendant AS blocked_id FROM members WHERE ancestor IN (SELECT id FROM moves)")
sql("self_union_descendants", "SELECT owner_id, ancestor, descendant, distance FROM members")
sql("child_count", """
    SELECT l.owner_id, l.id, coalesce(c.n, 0) AS child_count FROM live l LEFT JOIN children c ON c.owner_id = l.owner_id AND c.id = l.id""")
sql("subtree_size", "SELECT owner_id, id, subtree_size FROM sizes")
sql("subtree_height", """
    SELECT n.owner_id, n.id, coalesce(max(c.distance), 0) AS height FROM deep_nodes n LEFT JOIN deep_closure c ON c.ancestor = n.id GROUP BY ALL""")
sql("subtree_leaf_count", """
    SELECT v.owner_id, v.id, v.leaves,
           round(CASE WHEN c.id IS NULL THEN 1::DOUBLE
                 ELSE greatest(1::DOUBLE, 8 * pow(v.leaves / max(v.leaves) OVER (PARTITION BY v.owner_id)::DOUBLE, 0.6::DOUBLE)) END, 6) AS weight
    FROM leaves v LEFT JOIN children c ON c.id = v.id""")
sql("preorder_rows", "SELECT owner_id, id, level, pos, array_to_string(path_key, '/') AS path_key FROM preorder")
sql("reachable_nodes", "SELECT owner_id, id, depth FROM cyclic_tree")
sql("node_context", """
    SELECT l.owner_id, l.id, l.name, p.path, 0::BIGINT AS page, coalesce(k.children, '') AS children
    FROM live l JOIN full_path p ON p.id = l.id
    LEFT JOIN (SELECT owner_id, parent_id, string_agg(id || ':' || name, ',' ORDER BY sort_order, name, id) AS children
               FROM live WHERE parent_id IS NOT NULL GROUP BY ALL) k ON k.owner_id = l.owner_id AND k.parent_id = l.id""")
sql("root_context", """
    SELECT owner_id, (place - 1) // 2 AS page, string_agg(id, ',' ORDER BY place) AS children
    FROM (SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY sort_order, name, id) AS place FROM live WHERE parent_id IS NULL)
    GROUP BY ALL""")


def _documents(node: str, part_chars: int = 1_000_000) -> str:
    """Texts of subtrees, each cut every ``part_chars`` characters, and how many nodes begin in each part."""
    members = "members m JOIN preorder d ON d.id = m.descendant JOIN live l ON l.id = m.descendant"
    return f"""
    SELECT t.owner_id, t.id, t.part, substr(t.text, {part_chars} * t.part + 1, {part_chars}) AS text, coalesce(b.n, 0) AS n_nodes
    FROM (SELECT owner_id, id, text, unnest(range(greatest(1, (length(text) + {part_chars - 1}) // {part_chars}))) AS part
          FROM (SELECT m.owner_id, m.ancestor AS id, string_agg({node}, chr(10) || '---' || chr(10) ORDER BY d.pos) AS text FROM {members} GROUP BY ALL)) t
    LEFT JOIN (SELECT id, begun // {part_chars} AS part, count(*) AS n
               FROM (SELECT m.ancestor AS id, sum(length({node}) + 5) OVER (PARTITION BY m.ancestor ORDER BY d.pos) - length({node}) - 5 AS begun FROM {members})
               GROUP BY ALL) b ON b.id = t.id AND b.part = t.part"""


_RENDERED = "l.name || '=' || l.content"
for _name, _docs in {"subtree_documents": _documents(_RENDERED), "subtree_documents_parts": _documents(_RENDERED, 3000)}.items():
    sql(_name, f"SELECT owner_id, id, part, md5(text) AS text_md5, length(text) AS n_chars, n_nodes FROM ({_docs})")
sql("derive_edges", """
    SELECT up AS parent_id, id AS child_id, sort_order, 'parent-child' AS relationship_type FROM links WHERE up IS NOT NULL""")
_DERIVED = "SELECT up AS parent_id, id AS child_id, sort_order FROM links WHERE up IS NOT NULL"
_STORED = "SELECT parent_id, child_id, sort_order FROM edges"
sql("edge_drift", f"""
    SELECT *, 'missing' AS drift FROM ({_DERIVED} EXCEPT ALL {_STORED})
    UNION ALL SELECT *, 'extra' FROM ({_STORED} EXCEPT ALL {_DERIVED})""")
sql("inherit_root_fields", """
    SELECT t.owner_id, t.id, t.root AS root_id, round(r.mastery, 6) AS root_mastery, r.name AS root_name
    FROM tree t JOIN decayed r ON r.id = t.root""")

# --- restructure ------------------------------------------------------------------------------

sql("apply_creates", """
    SELECT j.seq, j.owner_id, j.parent_id, j.name,
           CASE WHEN j.final_reason = 'ok' THEN coalesce(n.next_order, 0) - 1
             + row_number() OVER (PARTITION BY j.owner_id, j.parent_id, j.final_reason ORDER BY j.seq) END AS sort_order,
           j.final_reason AS reason
    FROM judged_creates j LEFT JOIN next_orders n ON n.owner_id = j.owner_id AND n.parent_id IS NOT DISTINCT FROM j.parent_id""")
sql("apply_content_updates", f"""
    SELECT n.owner_id, n.id, md5(CASE WHEN u.id IS NULL THEN n.content ELSE u.content END) AS content_md5, {time("u.written_at")} AS updated_at
    FROM nodes n LEFT JOIN (
        SELECT r.owner_id, r.node_id AS id, 'v' || arg_max(r.event_id, (r.reviewed_at, r.event_id)) AS content, max(r.reviewed_at) AS written_at
        FROM node_reviews r JOIN live l ON l.owner_id = r.owner_id AND l.id = r.node_id GROUP BY ALL) u
      ON u.owner_id = n.owner_id AND u.id = n.id""")
sql("apply_cascade_delete", """
    SELECT owner_id, id, is_deleted OR id IN (SELECT descendant FROM members WHERE ancestor IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS is_deleted FROM nodes""")
sql("apply_cascade_delete_cyclic", """
    SELECT owner_id, id, is_deleted OR id IN (SELECT id FROM cyclic_reach WHERE met IN (SELECT doc_id FROM labels WHERE quality = 0)) AS is_deleted
    FROM cyclic_nodes""")
sql("apply_promote_delete", """
    SELECT n.owner_id, n.id, CASE WHEN p.id IS NULL THEN n.parent_id ELSE p.target END AS parent_id,
           CASE WHEN p.id IS NULL THEN n.sort_order ELSE p.sort_order END AS sort_order, n.is_deleted OR n.id IN (SELECT id FROM dropped) AS is_deleted
    FROM nodes n LEFT JOIN promoted_at p ON p.id = n.id""")
sql("apply_moves", f"""
    SELECT n.owner_id, n.id, CASE WHEN a.id IS NULL THEN n.parent_id ELSE a.new_parent_id END AS parent_id,
           CASE WHEN a.id IS NULL THEN n.sort_order ELSE a.sort_order END AS sort_order,
           {time(f"CASE WHEN a.id IS NULL THEN {AS_OF} ELSE {AS_OF} + to_seconds(a.id) END")} AS updated_at
    FROM nodes n LEFT JOIN arrivals a ON a.id = n.id""")
sql("next_sort_order", "SELECT owner_id, parent_id, next_order FROM next_orders")
sql("normalize_sibling_order", """
    SELECT owner_id, id, parent_id,
           (row_number() OVER (PARTITION BY owner_id, parent_id ORDER BY sort_order, name, id) - 1)::DOUBLE AS sort_order FROM live""")
sql("append_order", """
    SELECT n.id * 3 AS seq, n.owner_id, n.parent_id,
           coalesce(o.next_order, 0) + row_number() OVER (PARTITION BY n.owner_id, n.parent_id ORDER BY n.id) - 1 AS sort_order
    FROM nodes n LEFT JOIN next_orders o ON o.owner_id = n.owner_id AND o.parent_id IS NOT DISTINCT FROM n.parent_id""")
sql("place_generated_nodes", "SELECT seq, owner_id, name, sort_order, is_new_root, reason FROM placed")
sql("placement_summary", """
    SELECT owner_id, count(*) FILTER (reason = 'ok') AS created, count(*) FILTER (reason <> 'ok') AS skipped FROM placed GROUP BY owner_id""")
sql("place_extracted_nodes", f"""
    SELECT w.seq, w.owner_id, CASE WHEN nth <= 2 THEN w.parent_id END AS parent_id,
           CASE nth WHEN 2 THEN w.name || {quote(V.DUPLICATE_NAME_SUFFIX)} ELSE w.name END AS name,
           CASE WHEN nth <= 2 THEN coalesce(o.next_order, 0) - 1
             + row_number() OVER (PARTITION BY w.owner_id, w.parent_id, nth <= 2 ORDER BY w.seq) END AS sort_order,
           CASE WHEN nth <= 2 THEN 'ok' ELSE 'name_taken_twice' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, parent_id, name ORDER BY seq) AS nth
          FROM (SELECT p_partkey AS seq, p_brand AS owner_id, ((p_partkey - p_partkey % 4) // 16) * 16 AS parent_id,
                       's' || (p_partkey % 2) AS name FROM part)) w
    LEFT JOIN named_next o ON o.owner_id = w.owner_id AND o.parent_id = w.parent_id""")

# --- aggregations ----------------------------------------------------------------------------

sql("tag_nodes", "SELECT owner_id, id, tag FROM tagged")
sql("tag_nodes_default_rules", f"""
    SELECT owner_id, id, {tag_case(V.DOMAIN_KEYWORDS, "body", V.OTHER_TAG)} AS tag
    FROM (SELECT owner_id, id, lower(name || ' ' || content) AS body FROM nodes)""")
sql("tag_counts", "SELECT owner_id, tag, count(*) AS n FROM tagged GROUP BY ALL")
sql("domain_distribution", "SELECT owner_id, tag, n, share FROM shares")
sql("dominant_style", "SELECT o.owner_id, coalesce(arg_min(r.style, r.prio), 'default') AS style FROM (SELECT DISTINCT owner_id FROM taggable) o "
    "LEFT JOIN shares s ON s.owner_id = o.owner_id LEFT JOIN (VALUES "
    + ", ".join(f"({i}, {quote(t)}, {limit}::DOUBLE, {quote(style)})" for i, (t, limit, style) in enumerate(X.STYLE_RULES))
    + ") r(prio, tag, threshold, style) ON r.tag = s.tag AND s.share > r.threshold GROUP BY o.owner_id")
sql("share_of_total", """
    SELECT owner_id, difficulty, n, round(n / sum(n) OVER (PARTITION BY owner_id)::DOUBLE, 6) AS share
    FROM (SELECT owner_id, difficulty, count(*) AS n FROM questions GROUP BY ALL)""")


def _stats(source: str, as_of: str) -> str:
    return f"""
    SELECT owner_id, count(*) AS total_nodes,
           count(*) FILTER (stability <= 0 OR last_review_at IS NULL OR next_review_at <= {as_of}) AS due_count,
           count(*) FILTER (last_review_at::DATE = ({as_of})::DATE) AS today_reviewed,
           {half_even("coalesce(avg(stability) FILTER (stability > 0), 0::DOUBLE)", 2)} AS avg_stability,
           count(*) FILTER (review_state = 'new' OR review_state IS NULL) AS new_count
    FROM {source} GROUP BY owner_id"""


_NEXT_SECOND = (
    "make_timestamp((floor(least(epoch(last_review_at) + stability * 0.10536::DOUBLE * 86400, 253402300799::DOUBLE)) * 1000000)::BIGINT)"
)
sql("review_stats", _stats("(SELECT * FROM states WHERE NOT is_deleted)", AS_OF))
sql("review_stats_from_log", _stats(f"(SELECT *, {_NEXT_SECOND} AS next_review_at FROM final)", "TIMESTAMP '2024-01-30 12:00:00'"))
sql("quiz_node_stats", """
    SELECT owner_id, id, name, mastery_score, stability, difficulty, review_count, review_state, question_count FROM node_stats""")
sql("quiz_totals", """
    SELECT coalesce(q.owner_id, a.owner_id) AS owner_id, coalesce(q.n, 0) AS total_questions, coalesce(a.n, 0) AS total_answers
    FROM (SELECT owner_id, count(*) AS n FROM questions GROUP BY ALL) q
    FULL JOIN (SELECT owner_id, count(*) AS n FROM records GROUP BY ALL) a ON a.owner_id = q.owner_id""")
sql("learner_kpis", """
    SELECT owner_id, total_nodes, reviewed_nodes, round(coverage, 6) AS coverage, round(avg_mastery, 6) AS avg_mastery, avg_stability_days
    FROM kpis""")
_BANDS = " ".join(f"WHEN coverage < {c}::DOUBLE OR avg_stability_days < {s} THEN {quote(label)}" for c, s, label in V.GROWTH_STAGES)
sql("growth_stage", f"""
    SELECT owner_id, CASE WHEN coverage = 0 THEN {quote(V.GROWTH_STAGE_NONE)} {_BANDS} ELSE {quote(V.GROWTH_STAGE_FULL)} END AS stage FROM kpis""")
sql("root_stats", """
    SELECT owner_id, id, name, descendants, height, subtree_size, stability, difficulty, review_count, review_state,
           round(mastery_score, 6) AS mastery_score FROM roots""")
sql("forest_health", """
    SELECT owner_id, avg_stability, avg_mastery, review_coverage, reviewed_nodes, total_nodes, growth_multiplier FROM health""")
sql("growth_multiplier", f"""SELECT id, round({growth("stability", "((id % 11) / 10::DOUBLE)")}, 6) AS growth_multiplier FROM states""")
sql("shape_ratios", """
    SELECT r.owner_id, count(*) AS n_roots, max(r.height) AS max_depth, o.total_nodes,
           round(greatest(0.1::DOUBLE, least(10::DOUBLE, count(*) / greatest(max(r.height), 1)::DOUBLE)), 6) AS width_depth_ratio,
           round(max(r.subtree_size) / o.total_nodes::DOUBLE, 6) AS max_subtree_ratio
    FROM roots r JOIN owner_sizes o USING (owner_id) GROUP BY r.owner_id, o.total_nodes""")
sql("node_depth_ratio", """
    SELECT owner_id, round(CASE WHEN max(depth) > 0 THEN count(*) / max(depth)::DOUBLE ELSE 1::DOUBLE END, 6) AS node_depth_ratio
    FROM tree GROUP BY owner_id""")
sql("activity_rate", """
    SELECT owner_id, round(count(*) FILTER (mastery_score > 0) / count(*)::DOUBLE, 6) AS activity_rate FROM node_stats GROUP BY owner_id""")
sql("size_tier", """
    SELECT owner_id, count(*) AS node_count,
           (CASE WHEN count(*) < 20 THEN 0 WHEN count(*) < 80 THEN 1 WHEN count(*) < 300 THEN 2 ELSE 3 END)::BIGINT AS tier
    FROM node_stats GROUP BY owner_id""")
sql("proportional_ranges", """
    SELECT owner_id, id, subtree_size, round(-pi() + 2 * pi() * (upto - subtree_size) / whole, 6) AS angle_start,
           round(-pi() + 2 * pi() * upto / whole, 6) AS angle_end,
           greatest(3, floor(budget * subtree_size / whole))::BIGINT AS quota
    FROM (SELECT r.owner_id, r.id, r.subtree_size, sum(r.subtree_size) OVER (PARTITION BY r.owner_id ORDER BY r.id)::DOUBLE AS upto,
                 sum(r.subtree_size) OVER (PARTITION BY r.owner_id)::DOUBLE AS whole,
                 least(500, floor((50 + 3 * h.total_nodes) * h.growth_multiplier)) AS budget
          FROM roots r JOIN health h USING (owner_id))""")

# --- windows, top-k -----------------------------------------------------------------------------

sql("sibling_rank", """
    SELECT owner_id, id, parent_id, row_number() OVER (PARTITION BY owner_id, parent_id ORDER BY sort_order, name, id) AS position FROM live""")
sql("due_queue", f"""
    SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY stability > 0, retrievability, id) AS rank
    FROM (SELECT owner_id, id, name, md5(content) AS content_md5, {half_even("mastery", 4)} AS retrievability, {half_even("stability", 4)} AS stability,
                 {half_even("difficulty", 4)} AS difficulty, review_count, review_state, {time("next_review_at")} AS next_review_at
          FROM decayed WHERE NOT is_deleted)
    QUALIFY rank <= 20""")
sql("weak_nodes", """
    SELECT owner_id, id, mastery_score, row_number() OVER (PARTITION BY owner_id ORDER BY mastery_score, id) AS rank
    FROM node_stats WHERE review_count > 0 AND mastery_score < 1 QUALIFY rank <= 5""")
sql("questions_newest_first", f"""
    SELECT owner_id, id, question, {time("created_at")} AS created_at FROM questions ORDER BY questions.created_at DESC, id""")
sql("children_in_order", """
    SELECT owner_id, parent_id, id, sort_order, name FROM live ORDER BY owner_id, parent_id NULLS FIRST, sort_order, name, id""")
sql("first_n_per_batch", """SELECT id, position, q->>'$.question' AS question FROM batch_items WHERE position < 2""")
sql("page_of_children", """
    SELECT owner_id, id, parent_id, row_number() OVER (PARTITION BY owner_id, parent_id ORDER BY sort_order, name, id) AS position
    FROM live QUALIFY position BETWEEN 2 AND 3""")

# --- scalars, generated text ---------------------------------------------------------------------

sql("retrievability", f"""SELECT id, round({retrievability("stability", "last_review_at")}, 6) AS retrievability FROM states""")
_S, _D, _T = step("s", "d", "c", "t", "rating")
sql("fsrs_step", f"""
    SELECT event_id, round({_S}, 6) AS stability, round({_D}, 6) AS difficulty, c + 1 AS review_count, {_T} AS review_state,
           {time("reviewed_at")} AS last_review_at
    FROM (SELECT event_id, rating, reviewed_at, (event_id % 9) * 0.5::DOUBLE AS s, 0.05::DOUBLE + (event_id % 10) / 10::DOUBLE AS d,
                 event_id % 4 AS c, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'review' ELSE 'relearning' END AS t FROM reviews)""")
sql("next_review_at", f"""SELECT id, {time(_NEXT_SECOND)} AS next_review_at FROM states WHERE last_review_at IS NOT NULL""")
sql("answer_to_rating", "SELECT is_correct, (CASE WHEN is_correct THEN 3 ELSE 1 END)::BIGINT AS rating, count(*) AS n FROM records GROUP BY ALL")
sql("format_stability", f"""
    SELECT id, CASE WHEN x <= 0 THEN {quote(V.STABILITY_UNSEEN)} WHEN x < 1 THEN floor(x * 24 + 0.5)::BIGINT || {quote(V.STABILITY_HOURS)}
        WHEN x < 30 THEN floor(x + 0.5)::BIGINT || {quote(V.STABILITY_DAYS)}
        ELSE floor(x / 30 + 0.5)::BIGINT || {quote(V.STABILITY_MONTHS)} END AS label
    FROM (SELECT id, stability * stability / 4 AS x FROM states)""")
_LABELS = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in V.TYPE_LABELS.items())
sql("type_label", f"""
    SELECT id, CASE CASE WHEN id % 5 = 0 THEN 'essay' ELSE question_type END {_LABELS} ELSE {quote(V.DEFAULT_TYPE_LABEL)} END AS type_label FROM questions""")
sql("question_list", f"""
    SELECT q.owner_id, q.node_id, row_number() OVER (PARTITION BY q.owner_id, q.node_id ORDER BY q.created_at DESC, q.id) AS position, q.id, q.question,
           CASE q.id % 3 WHEN 0 THEN 'A,B,C,D' END AS choices, CASE q.id % 3 WHEN 2 THEN q.question END AS reference_answer,
           CASE q.id % 3 WHEN 2 THEN 'k1,k2' END AS keywords, CASE q.id % 3 WHEN 1 THEN q.options END AS raw, 'see ' || p.p_type AS explanation,
           q.question_type, CASE q.question_type {_LABELS} ELSE {quote(V.DEFAULT_TYPE_LABEL)} END AS type_label, q.difficulty,
           {time("q.created_at")} AS created_at, a.is_correct IS NOT NULL AS answered, coalesce(a.is_correct, FALSE) AS last_correct
    FROM questions q JOIN part p ON p.p_partkey = q.id LEFT JOIN last_attempt a ON a.question_id = q.id AND a.owner_id = q.owner_id""")
sql("decode_options", """
    SELECT id, CASE id % 3 WHEN 0 THEN 'A,B,C,D' END AS choices, CASE id % 3 WHEN 2 THEN question END AS reference_answer,
           CASE id % 3 WHEN 2 THEN 'k1,k2' END AS keywords, CASE id % 3 WHEN 1 THEN options END AS raw FROM questions""")
sql("extract_json", "SELECT id, j IS NOT NULL AS found, j->>'$.question' AS question FROM question_json")
_PAIR = quote(",".join(V.TRUE_FALSE_CHOICES))
sql("validate_questions", f"""
    SELECT id, question_type, j->>'$.question' AS question,
           CASE question_type WHEN 'single_choice' THEN array_to_string(from_json(j->'$.options', '["VARCHAR"]'), ',')
                WHEN 'true_false' THEN {_PAIR} END AS choices,
           CASE question_type WHEN 'short_answer' THEN j->>'$.reference_answer' END AS reference_answer,
           CASE question_type WHEN 'short_answer' THEN array_to_string(from_json(j->'$.keywords', '["VARCHAR"]'), ',') END AS keywords,
           CASE question_type WHEN 'short_answer' THEN 0 ELSE CAST(j->>'$.correct_index' AS BIGINT) END AS correct_index,
           coalesce(j->>'$.explanation', j->>'$.reference_answer') AS explanation,
           CASE question_type {_LABELS} END AS type_label
    FROM judged WHERE reason IS NULL""")
sql("validate_questions_rejects", "SELECT id, question_type, reason FROM judged WHERE reason IS NOT NULL")
sql("explode_question_batch", f"""
    SELECT id, position, q->>'$.question' AS question,
           CASE position WHEN 1 THEN {_PAIR} WHEN 2 THEN NULL ELSE array_to_string(from_json(q->'$.options', '["VARCHAR"]'), ',') END AS choices,
           q->>'$.reference_answer' AS reference_answer, CASE position WHEN 2 THEN 'k1' END AS keywords,
           CASE position WHEN 0 THEN 2 ELSE 0 END::BIGINT AS correct_index,
           coalesce(q->>'$.explanation', q->>'$.reference_answer', '') AS explanation,
           CASE position WHEN 1 THEN 'true_false' WHEN 2 THEN 'short_answer' ELSE 'single_choice' END AS question_type,
           coalesce(q->>'$.difficulty', 'medium') AS difficulty
    FROM batch_items""")
sql("explode_question_batch_rejects", "SELECT id, reason FROM batch_judged WHERE reason IS NOT NULL")
sql("explode_suggestions", """
    SELECT id, position, q->>'$.name' AS name, q->>'$.content' AS content, q->>'$.suggested_parent' AS suggested_parent
    FROM (SELECT id, unnest(range(2)) AS position, unnest(from_json(j->'$.nodes', '["JSON"]')) AS q FROM suggestion_json WHERE id % 4 < 2)""")
sql("explode_suggestions_rejects", """
    SELECT id, CASE json_type(j) WHEN 'OBJECT' THEN 'missing_key' ELSE 'missing_nodes' END AS reason FROM suggestion_json WHERE id % 4 >= 2""")
_NODE_TEXT = f"{quote(V.PROMPT_NAME)} || l.name || CASE WHEN l.content <> '' THEN chr(10) || {quote(V.PROMPT_CONTENT)} || l.content ELSE '' END"


def _head(types: str) -> str:
    return f"{quote(V.PROMPT_TYPES_HEAD + types + V.PROMPT_TYPES_TAIL.strip())} || chr(10) || chr(10)"


sql("build_prompts", f"SELECT owner_id, id, md5({_head('single_choice、true_false')} || {_NODE_TEXT}) AS prompt_md5 FROM live l")
sql("build_subtree_prompts", f"""
    SELECT owner_id, id, part, md5(CASE part WHEN 0 THEN {_head("short_answer")} ELSE '' END || text) AS prompt_md5 FROM ({_documents(_NODE_TEXT)})""")

# --- logs and streams -------------------------------------------------------------------------------


def _state(source: str, *first: str) -> str:
    return f"""
    SELECT {", ".join(first)}, floor(stability * 1000000 + 0.5) / 1000000 AS stability, floor(difficulty * 1000000 + 0.5) / 1000000 AS difficulty, review_count, review_state,
           {time("last_review_at")} AS last_review_at, {time(_NEXT_SECOND)} AS next_review_at FROM {source}"""


sql("review_log", "SELECT owner_id, rating::BIGINT AS rating, count(*) AS n FROM both_logs GROUP BY ALL")
sql("recall_state_fold", _state("final", "owner_id", "node_id"))
_NEW = {c: f"CASE WHEN a.node_id IS NULL THEN s.{c} ELSE a.{c} END" for c in ("stability", "difficulty", "review_count", "review_state", "last_review_at")}
sql("apply_reviews", f"""
    SELECT s.owner_id, s.id, floor({_NEW["stability"]} * 1000000 + 0.5) / 1000000 AS stability,
           floor({_NEW["difficulty"]} * 1000000 + 0.5) / 1000000 AS difficulty, ({_NEW["review_count"]})::BIGINT AS review_count,
           {_NEW["review_state"]} AS review_state, {time(_NEW["last_review_at"])} AS last_review_at,
           {time("CASE WHEN a.node_id IS NULL THEN s.next_review_at ELSE a.due END")} AS next_review_at,
           CASE WHEN a.node_id IS NULL THEN 0.25::DOUBLE ELSE 1::DOUBLE END AS mastery_score, {time("a.last_review_at")} AS updated_at
    FROM states s LEFT JOIN (SELECT *, {_NEXT_SECOND} AS due FROM applied) a ON a.owner_id = s.owner_id AND a.node_id = s.id""")
sql("apply_reviews_rejects", "SELECT event_id, owner_id, node_id, reason FROM judged_reviews WHERE reason IS NOT NULL")
sql("recall_state_fold_mixed_log", f"""
    SELECT owner_id, node_id, round(ln(stability), 6) AS log_stability, floor(difficulty * 1000000 + 0.5) / 1000000 AS difficulty, review_count, review_state,
           {time("last_review_at")} AS last_review_at FROM mixed_final""")
sql("recall_state_history", _state("fold", "owner_id", "node_id", "event_id"))
sql("daily_review_counts", "SELECT owner_id, strftime(reviewed_at, '%Y-%m-%d') AS day, count(*) AS reviews FROM reviews GROUP BY ALL")
sql("recall_state_fold_blocks", _state("final", "owner_id", "node_id"))
sql("recall_state_history_blocks", _state("fold", "owner_id", "node_id", "event_id"))
_LATE_DAY = "coalesce(epoch_us(date_trunc('day', reviewed_at)) + 86400000000 <= mark, FALSE)"
for _name in ("recall_state_stream", "recall_state_stream_keyed"):
    sql(_name, _state("timely_final", "owner_id", "node_id"))
    sql(f"{_name}_late", f"SELECT owner_id, node_id, event_id, {time('reviewed_at')} AS reviewed_at FROM late_reviews")
sql("daily_review_counts_stream", f"""
    SELECT owner_id, strftime(reviewed_at, '%Y-%m-%d') AS day, count(*) AS reviews FROM marked_reviews WHERE NOT {_LATE_DAY} GROUP BY ALL""")
sql("daily_review_counts_late", f"SELECT owner_id, event_id, strftime(reviewed_at, '%Y-%m-%d') AS day FROM marked_reviews WHERE {_LATE_DAY}")
sql("stream_insert_ignore", "SELECT DISTINCT order_key, line FROM records")
sql("stream_insert_into_table", """
    SELECT order_key, line, question_id, price FROM record_arrivals
    QUALIFY row_number() OVER (PARTITION BY order_key, line ORDER BY part, question_id, price) = 1""")
sql("stream_wrong_attempts", f"""
    SELECT q.owner_id, r.question_id, count(*) AS n, {time("max(r.answered_at)")} AS last_wrong_at
    FROM records r JOIN questions q ON q.id = r.question_id WHERE NOT r.is_correct GROUP BY ALL""")
