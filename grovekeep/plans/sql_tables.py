"""Common tables of the SQL counterparts: a query's SQL starts with those it names."""

from __future__ import annotations

import re

from ..functions import fixed_values as V
from ..sources import fixtures as X

AS_OF = f"TIMESTAMP '{X.AS_OF}'"


def half_even(x: str, n: int) -> str:
    return f"CASE WHEN abs(({x}) * {2 ** (n + 1)}) % 2 = 1 THEN round_even({x}, {n}) ELSE round({x}, {n}) END"


def time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def retrievability(stability: str, last: str, as_of: str = AS_OF) -> str:
    days = f"greatest(0::DOUBLE, (epoch_us({as_of}) - epoch_us({last})) / 86400000000::DOUBLE)"
    return f"CASE WHEN {stability} > 0 AND {last} IS NOT NULL THEN exp(-{days} / {stability}) ELSE 0::DOUBLE END"


# --- common tables, in order of dependence ---------------------------------------

TABLES: dict[str, str] = {}

TABLES["nodes"] = """
    SELECT doc_id AS id, source AS owner_id,
           CASE WHEN doc_id // 20 >= 3 THEN doc_id % 20 + 20 * ((doc_id // 20 - 3) // 3) END AS parent_id,
           'n' || ((doc_id // 20) % 2) AS name, text AS content,
           (doc_id % 5)::DOUBLE AS sort_order, doc_id % 17 = 5 AS is_deleted
    FROM documents"""
TABLES["deep_nodes"] = """
    SELECT doc_id AS id, source AS owner_id,
           CASE WHEN doc_id // 20 - 1 - (doc_id // 20) % 5 >= 0
                THEN doc_id % 20 + 20 * (doc_id // 20 - 1 - (doc_id // 20) % 5) END AS parent_id,
           'n' || (doc_id // 20) AS name, (doc_id % 5)::DOUBLE AS sort_order, FALSE AS is_deleted
    FROM documents"""
TABLES["cyclic_nodes"] = """
    SELECT id, owner_id, CASE WHEN id < 10 THEN id + 60 ELSE parent_id END AS parent_id, name, sort_order, is_deleted
    FROM nodes"""
TABLES["live"] = "SELECT * FROM nodes WHERE NOT is_deleted"


def _links(source: str) -> str:
    return f"""
    SELECT c.*, p.id AS up FROM (SELECT * FROM {source} WHERE NOT is_deleted) c
    LEFT JOIN (SELECT owner_id, id FROM {source} WHERE NOT is_deleted) p
      ON p.owner_id = c.owner_id AND p.id = c.parent_id"""


def _tree(links: str, name: str) -> str:
    return f"""
    SELECT owner_id, id, id AS root, 0::BIGINT AS depth FROM {links} WHERE up IS NULL
    UNION ALL
    SELECT l.owner_id, l.id, t.root, t.depth + 1 FROM {links} l JOIN {name} t ON l.up = t.id"""


def _closure(links: str, name: str) -> str:
    return f"""
    SELECT owner_id, up AS ancestor, id AS descendant, 1::BIGINT AS distance FROM {links} WHERE up IS NOT NULL
    UNION ALL
    SELECT c.owner_id, l.up, c.descendant, c.distance + 1 FROM {name} c JOIN {links} l ON c.ancestor = l.id WHERE l.up IS NOT NULL"""


TABLES["links"] = _links("nodes")
TABLES["deep_links"] = _links("deep_nodes")
TABLES["cyclic_links"] = _links("cyclic_nodes")
TABLES["tree"] = _tree("links", "tree")
TABLES["deep_tree"] = _tree("deep_links", "deep_tree")
TABLES["cyclic_tree"] = _tree("cyclic_links", "cyclic_tree")
TABLES["closure"] = _closure("links", "closure")
TABLES["deep_closure"] = _closure("deep_links", "deep_closure")
TABLES["members"] = """
    SELECT * FROM closure UNION ALL SELECT owner_id, id, id, 0::BIGINT FROM live"""
TABLES["path"] = """
    SELECT owner_id, id, parent_id AS next, [id] AS path FROM nodes
    UNION ALL
    SELECT p.owner_id, p.id, n.parent_id, list_prepend(n.id, p.path) FROM path p JOIN nodes n ON n.id = p.next"""
TABLES["cyclic_path"] = """
    SELECT owner_id, id, parent_id AS next, [id] AS path FROM cyclic_nodes
    UNION ALL
    SELECT p.owner_id, p.id, n.parent_id, list_prepend(n.id, p.path) FROM cyclic_path p JOIN cyclic_nodes n ON n.id = p.next
    WHERE NOT list_contains(p.path, n.id)"""
TABLES["cyclic_reach"] = """
    SELECT id, id AS met FROM cyclic_links
    UNION
    SELECT r.id, l.up FROM cyclic_reach r JOIN cyclic_links l ON l.id = r.met WHERE l.up IS NOT NULL"""
TABLES["full_path"] = """
    SELECT owner_id, id, array_to_string(path, '/') AS path FROM path
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) = 1"""
TABLES["full_cyclic_path"] = """
    SELECT owner_id, id, array_to_string(path, '/') AS path FROM cyclic_path
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path) DESC) = 1"""
TABLES["children"] = """
    SELECT owner_id, parent_id AS id, count(*) AS n FROM live WHERE parent_id IS NOT NULL GROUP BY ALL"""
TABLES["shown"] = """
    SELECT owner_id, id, up, name, row_number() OVER (PARTITION BY owner_id, up ORDER BY sort_order, name, id) AS place FROM links"""
TABLES["walk"] = """
    SELECT owner_id, id, 0::BIGINT AS level, [place] AS path_key FROM shown WHERE up IS NULL
    UNION ALL
    SELECT s.owner_id, s.id, w.level + 1, list_append(w.path_key, s.place) FROM shown s JOIN walk w ON s.up = w.id"""
TABLES["preorder"] = """
    SELECT owner_id, id, level, row_number() OVER (PARTITION BY owner_id ORDER BY path_key) - 1 AS pos, path_key FROM walk"""
TABLES["states"] = f"""
    SELECT *, CASE WHEN last_review_at IS NOT NULL
                   THEN last_review_at + to_seconds(floor(stability * 86400)::BIGINT) END AS next_review_at
    FROM (SELECT *,
        CASE WHEN id % 4 <> 0 THEN (id % 13) * 1.5::DOUBLE ELSE 0::DOUBLE END AS stability,
        (id % 10) / 10::DOUBLE AS difficulty,
        CASE WHEN id % 4 <> 0 THEN id % 6 ELSE 0 END AS review_count,
        CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'new' END
             WHEN id % 3 = 0 THEN 'relearning' ELSE 'review' END AS review_state,
        CASE WHEN id % 4 <> 0 THEN {AS_OF} - to_days((id % 30)::INTEGER) END AS last_review_at
      FROM nodes)"""
TABLES["decayed"] = f"""
    SELECT owner_id, id, name, content, parent_id, is_deleted, stability,
           CASE WHEN difficulty = 0 THEN 0.3::DOUBLE ELSE difficulty END AS difficulty,
           review_count, coalesce(review_state, 'new') AS review_state, last_review_at, next_review_at,
           {retrievability("stability", "last_review_at")} AS mastery
    FROM states"""
TABLES["edges"] = """
    SELECT parent_id, id AS child_id, CASE WHEN id % 23 = 7 THEN 99::DOUBLE ELSE sort_order END AS sort_order
    FROM nodes WHERE parent_id IS NOT NULL AND id % 11 <> 3"""
TABLES["users"] = "SELECT 'src' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0"
TABLES["reviews"] = """
    SELECT event_id, user_id AS owner_id, CAST(props->>'$.k' AS BIGINT) % 8 AS node_id,
           CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END AS rating, ts AS reviewed_at
    FROM events"""
TABLES["node_reviews"] = """
    SELECT event_id, 'src' || ((CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id // 10 END) % 20) AS owner_id,
           event_id // 10 AS node_id, (event_id % 6)::INTEGER AS rating, ts AS reviewed_at
    FROM events"""
TABLES["questions"] = f"""
    SELECT p_partkey AS id, p_partkey % 500 AS node_id, 'src' || (p_partkey % 20) AS owner_id, p_name AS question,
           CASE p_partkey % 3 WHEN 0 THEN '["A","B","C","D"]' WHEN 1 THEN 'not json'
                ELSE '{{"reference_answer":"' || p_name || '","keywords":["k1","k2"]}}' END AS options,
           CASE p_partkey % 3 WHEN 0 THEN p_partkey % 4 WHEN 1 THEN p_partkey % 2 ELSE 0 END AS correct_index,
           CASE p_partkey % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'true_false' ELSE 'short_answer' END AS question_type,
           CASE WHEN p_size < 17 THEN 'easy' WHEN p_size < 34 THEN 'medium' ELSE 'hard' END AS difficulty,
           {AS_OF} - to_days(((p_partkey * 7) % 365)::INTEGER) AS created_at
    FROM part"""
TABLES["records"] = """
    SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line, l_extendedprice AS price, l_partkey AS question_id,
           'src' || (l_suppkey % 20) AS owner_id, l_linenumber % 4 AS chosen_index, l_returnflag <> 'R' AS is_correct,
           l_shipdate AS answered_at
    FROM lineitem"""
TABLES["last_attempt"] = """
    SELECT * FROM records
    QUALIFY row_number() OVER (PARTITION BY question_id, owner_id ORDER BY answered_at DESC, order_key DESC, line DESC, price DESC) = 1"""
TABLES["taggable"] = "SELECT p_partkey AS id, p_brand AS owner_id, lower(p_name || ' ' || p_type) AS body FROM part"


def tag_case(rules: dict[str, list[str]], text: str, other: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, {quote(w.lower())})" for w in words) + f" THEN {quote(domain)}"
        for domain, words in rules.items()
    )
    return f"CASE {arms} ELSE {quote(other)} END"


TABLES["tagged"] = f"SELECT owner_id, id, {tag_case(X.TAG_RULES, 'body', X.OTHER)} AS tag FROM taggable"
TABLES["shares"] = f"""
    SELECT owner_id, tag, n, {half_even("n / sum(n) OVER (PARTITION BY owner_id)::DOUBLE", 4)} AS share
    FROM (SELECT owner_id, tag, count(*) AS n FROM tagged GROUP BY ALL)"""
TABLES["named_nodes"] = """
    SELECT p_partkey AS id, p_brand AS owner_id, CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 3 END AS parent_id,
           upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' '
             || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' ' || (p_partkey % 7) AS name,
           (p_partkey % 5)::DOUBLE AS sort_order, p_partkey % 17 = 5 AS is_deleted
    FROM part"""
TABLES["suggestions"] = """
    SELECT p_partkey AS seq, p_brand AS owner_id, 's' || (p_partkey % 3) AS name,
           CASE p_partkey % 5 WHEN 0 THEN 'all about ' || p_name || ' 3 and more' WHEN 1 THEN upper(split_part(p_name, ' ', 1))
                WHEN 2 THEN 'topic ' || (p_partkey % 3) WHEN 3 THEN split_part(p_name, ' ', -1)
                ELSE CASE WHEN p_partkey % 10 = 9 THEN 'About S' || (p_partkey % 3) || ' here' ELSE '' END END AS suggested_parent,
           p_partkey // 200 AS response
    FROM part"""
TABLES["matches"] = """
    SELECT s.owner_id, s.wanted, arg_min(n.id, (n.parent_id IS NOT NULL)::BIGINT * 1000000000000 + n.id) AS parent_id,
           min((n.parent_id IS NOT NULL)::BIGINT) = 0 AS is_root
    FROM (SELECT DISTINCT owner_id, lower(suggested_parent) AS wanted FROM suggestions) s
    JOIN (SELECT * FROM named_nodes WHERE NOT is_deleted) n
      ON n.owner_id = s.owner_id AND (contains(lower(n.name), s.wanted) OR contains(s.wanted, lower(n.name)))
    GROUP BY ALL"""
TABLES["asked"] = """
    SELECT s.*, lower(s.suggested_parent) AS wanted, m.parent_id AS found, coalesce(m.is_root, FALSE) AS in_root,
           row_number() OVER (PARTITION BY s.owner_id, response ORDER BY seq) AS rn
    FROM suggestions s LEFT JOIN matches m ON m.owner_id = s.owner_id AND m.wanted = lower(s.suggested_parent)"""
# One suggestion of every response after another, with the list of what the response has made.
_MADE = "STRUCT(label VARCHAR, root BOOLEAN, key VARCHAR, parent VARCHAR, name VARCHAR, chain BIGINT[])[]"
_FITS = "list_filter(p.made, lambda m: contains(m.label, a.wanted) OR contains(a.wanted, m.label))"
_SUFFIXED = f"name || {quote(V.DUPLICATE_NAME_SUFFIX)}"
TABLES["aiming"] = f"""
    SELECT DISTINCT owner_id, response, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS name, NULL::VARCHAR AS wanted, NULL::VARCHAR AS suggested_parent,
           NULL::BIGINT AS found, NULL::VARCHAR AS target, NULL::BIGINT[] AS chain, FALSE AS fresh, NULL::VARCHAR AS own, []::{_MADE} AS made
    FROM suggestions
    UNION ALL
    SELECT owner_id, response, rn, seq, name, wanted, suggested_parent, found, target, chain, fresh, own,
           made || CASE WHEN fresh THEN [(wanted, TRUE, target, '', suggested_parent, []::BIGINT[])]::{_MADE} ELSE []::{_MADE} END
                || CASE WHEN own IS NOT NULL THEN [(lower(own), FALSE, 'i' || seq, target, own, chain || [seq])]::{_MADE} ELSE []::{_MADE} END
    FROM (SELECT *, CASE WHEN NOT list_contains(names, name) THEN name WHEN NOT list_contains(names, {_SUFFIXED}) THEN {_SUFFIXED} END AS own
      FROM (SELECT *, list_transform(list_filter(made, lambda m: m.parent = target), lambda m: m.name) AS names
        FROM (SELECT *, coalesce(place.key, CASE WHEN found IS NOT NULL THEN 'n' || found ELSE 'r' || wanted END) AS target,
                     coalesce(place.chain, []::BIGINT[]) AS chain, place IS NULL AND found IS NULL AS fresh
          FROM (SELECT a.owner_id, a.response, a.rn, a.seq, a.name, a.wanted, a.suggested_parent, a.found, p.made,
                       CASE WHEN in_root THEN NULL WHEN len(list_filter({_FITS}, lambda m: m.root)) > 0 THEN list_filter({_FITS}, lambda m: m.root)[1]
                            WHEN a.found IS NULL THEN ({_FITS})[1] END AS place
                FROM aiming p JOIN asked a ON a.owner_id = p.owner_id AND a.response = p.response AND a.rn = p.rn + 1))))"""
TABLES["aimed"] = "SELECT * FROM aiming WHERE rn > 0"
TABLES["ranked"] = """
    SELECT *, row_number() OVER (PARTITION BY owner_id, target, name ORDER BY seq) AS nth FROM aimed WHERE own IS NOT NULL"""
TABLES["named"] = f"""
    SELECT *, nth > 2 AS unnamed, list_has_any(chain, (SELECT coalesce(list(seq), []) FROM ranked WHERE nth > 2)) AS orphaned,
           CASE nth WHEN 1 THEN name WHEN 2 THEN {_SUFFIXED} END AS final_name FROM ranked"""
TABLES["named_next"] = """
    SELECT owner_id, parent_id, max(sort_order) + 1 AS next_order FROM named_nodes GROUP BY ALL"""
TABLES["new_roots"] = """
    SELECT f.seq, f.owner_id, f.name,
           coalesce(n.next_order, 0) + row_number() OVER (PARTITION BY f.owner_id ORDER BY f.seq) - 1 AS sort_order
    FROM (SELECT owner_id, wanted, min(seq) AS seq, arg_min(suggested_parent, seq) AS name FROM aimed WHERE fresh GROUP BY ALL) f
    LEFT JOIN named_next n ON n.owner_id = f.owner_id AND n.parent_id IS NULL"""
TABLES["placed"] = """
    SELECT seq, owner_id, name, sort_order, TRUE AS is_new_root, 'ok' AS reason FROM new_roots
    UNION ALL
    SELECT d.seq, d.owner_id, d.final_name,
           coalesce(n.next_order, 0) + row_number() OVER (PARTITION BY d.owner_id, d.target ORDER BY d.seq) - 1, FALSE, 'ok'
    FROM (SELECT * FROM named WHERE NOT unnamed AND NOT orphaned) d
    LEFT JOIN named_next n ON n.owner_id = d.owner_id AND 'n' || n.parent_id = d.target
    UNION ALL
    SELECT seq, owner_id, name, NULL, FALSE, 'name_taken_twice' FROM named WHERE unnamed
    UNION ALL
    SELECT seq, owner_id, name, NULL, FALSE, 'parent_skipped' FROM named WHERE orphaned AND NOT unnamed
    UNION ALL
    SELECT seq, owner_id, name, NULL, FALSE, 'name_taken_twice' FROM aimed WHERE own IS NULL"""
TABLES["node_stats"] = f"""
    SELECT d.owner_id, d.id, d.name, {half_even("d.mastery", 4)} AS mastery_score, {half_even("d.stability", 4)} AS stability,
           {half_even("d.difficulty", 4)} AS difficulty, d.review_count, d.review_state, coalesce(q.n, 0) AS question_count
    FROM decayed d
    LEFT JOIN (SELECT owner_id, node_id, count(*) AS n FROM questions GROUP BY ALL) q ON q.owner_id = d.owner_id AND q.node_id = d.id
    WHERE NOT d.is_deleted"""
TABLES["kpis"] = """
    SELECT owner_id, count(*) AS total_nodes, count(*) FILTER (review_count > 0) AS reviewed_nodes,
           count(*) FILTER (review_count > 0) / count(*)::DOUBLE AS coverage,
           coalesce(avg(mastery_score) FILTER (review_count > 0), 0) AS avg_mastery,
           floor(coalesce(avg(stability) FILTER (stability > 0), 0) * 10 + 0.5) / 10 AS avg_stability_days
    FROM node_stats GROUP BY owner_id"""
TABLES["sizes"] = """
    SELECT owner_id, ancestor AS id, count(*) AS subtree_size, max(distance) AS height FROM members GROUP BY ALL"""
TABLES["leaves"] = """
    SELECT m.owner_id, m.ancestor AS id, count(*) AS leaves FROM members m
    LEFT JOIN children c ON c.id = m.descendant WHERE c.id IS NULL GROUP BY ALL"""
TABLES["roots"] = """
    SELECT d.owner_id, d.id, d.name, z.subtree_size - 1 AS descendants, z.height, z.subtree_size, d.stability, d.difficulty,
           d.review_count, d.review_state, d.mastery AS mastery_score
    FROM decayed d JOIN sizes z ON z.id = d.id JOIN tree t ON t.id = d.id
    WHERE NOT d.is_deleted AND t.depth = 0
      AND (d.parent_id IS NULL OR d.owner_id NOT IN (SELECT owner_id FROM live WHERE parent_id IS NULL))"""
TABLES["owner_sizes"] = "SELECT owner_id, count(*) AS total_nodes FROM live GROUP BY ALL"
TABLES["health_base"] = f"""
    SELECT owner_id, {half_even("avg(stability)", 2)} AS avg_stability, {half_even("avg(mastery_score)", 4)} AS avg_mastery,
           {half_even("count(*) FILTER (review_count > 0) / count(*)::DOUBLE", 4)} AS review_coverage,
           count(*) FILTER (review_count > 0) AS reviewed_nodes
    FROM roots GROUP BY owner_id"""


def growth(stability: str, coverage: str) -> str:
    norm = f"CASE WHEN {stability} > 0 THEN least(1::DOUBLE, ln(1 + {stability}) / ln(31::DOUBLE)) ELSE 0::DOUBLE END"
    return f"0.3::DOUBLE + 2.2::DOUBLE * (0.3::DOUBLE * {coverage} + 0.7::DOUBLE * {norm})"


TABLES["health"] = f"""
    SELECT h.*, o.total_nodes, {half_even(growth("h.avg_stability", "h.review_coverage"), 4)} AS growth_multiplier
    FROM health_base h JOIN owner_sizes o USING (owner_id)"""


def step(stability: str, difficulty: str, count: str, state: str, r: str) -> tuple[str, str, str]:
    first = f"CASE {r} WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1::DOUBLE WHEN 3 THEN 2::DOUBLE ELSE 4::DOUBLE END"
    later = (
        f"CASE {r} WHEN 1 THEN greatest(0.5::DOUBLE, {stability} * 0.5::DOUBLE) WHEN 2 THEN {stability} * 1.3::DOUBLE "
        f"WHEN 3 THEN {stability} * 2.5::DOUBLE ELSE {stability} * 4::DOUBLE END"
    )
    s = f"CASE WHEN {count} = 0 OR {stability} <= 0 THEN {first} ELSE {later} END"
    d = f"greatest(0.01::DOUBLE, least(1::DOUBLE, {difficulty} + 0.15::DOUBLE * (3 - {r}) * (1::DOUBLE - {difficulty})))"
    t = (
        f"CASE WHEN {state} = 'new' THEN 'review' WHEN {r} = 1 THEN 'relearning' "
        f"WHEN {state} = 'relearning' AND {r} >= 3 THEN 'review' ELSE {state} END"
    )
    return s, d, t


def _fold(log: str, name: str) -> str:
    s0, _, t0 = step("0::DOUBLE", "0.3::DOUBLE", "0", "'new'", "rating")
    s1, _, t1 = step("f.stability", "f.difficulty", "f.review_count", "f.review_state", "l.rating")
    # The gap, 1 - difficulty, is carried: a review multiplies and caps it.
    g0, g1 = (f"least(0.99::DOUBLE, (1 - 0.15::DOUBLE * (3 - {r})) * {g})" for r, g in (("rating", "0.7::DOUBLE"), ("l.rating", "f.gap")))
    return f"""
    SELECT owner_id, node_id, event_id, rn, {s0} AS stability, 1 - {g0} AS difficulty, 1::BIGINT AS review_count,
           {t0} AS review_state, date_trunc('second', reviewed_at) AS last_review_at, {g0} AS gap
    FROM {log} WHERE rn = 1
    UNION ALL
    SELECT l.owner_id, l.node_id, l.event_id, l.rn, {s1}, 1 - {g1}, f.review_count + 1, {t1}, date_trunc('second', l.reviewed_at), {g1}
    FROM {name} f JOIN {log} l ON l.owner_id = f.owner_id AND l.node_id = f.node_id AND l.rn = f.rn + 1"""


_RANKED = "row_number() OVER (PARTITION BY owner_id, node_id ORDER BY reviewed_at, event_id) AS rn"
TABLES["log"] = f"SELECT *, {_RANKED} FROM reviews"
TABLES["both_logs"] = """
    SELECT event_id, owner_id, node_id, rating, reviewed_at FROM reviews
    UNION ALL
    SELECT event_id + 1000000000, owner_id, node_id, CASE WHEN rating <> 1 THEN 3 ELSE 1 END,
           date_trunc('second', reviewed_at) + INTERVAL 1 HOUR FROM reviews"""
TABLES["mixed_log"] = f"SELECT *, {_RANKED} FROM both_logs"
TABLES["fold"] = _fold("log", "fold")
TABLES["mixed_fold"] = _fold("mixed_log", "mixed_fold")


def _last(fold: str) -> str:
    return f"SELECT * FROM {fold} QUALIFY row_number() OVER (PARTITION BY owner_id, node_id ORDER BY rn DESC) = 1"


# The stream's arrivals: a review is late if the mark, an hour behind the newest one of earlier arrivals, has passed it.
TABLES["review_arrivals"] = """
    SELECT r.*, CASE WHEN event_id % 40 = 11 THEN 3 ELSE least(3, (epoch_us(reviewed_at) - low) * 4 // (high - low + 1)) END AS part
    FROM reviews r, (SELECT min(epoch_us(reviewed_at)) AS low, max(epoch_us(reviewed_at)) AS high FROM reviews)"""
TABLES["record_arrivals"] = """
    SELECT r.*, least(3, (epoch_us(answered_at::TIMESTAMP) - low) * 4 // (high - low + 1)) AS part
    FROM records r, (SELECT min(epoch_us(answered_at::TIMESTAMP)) AS low, max(epoch_us(answered_at::TIMESTAMP)) AS high FROM records)"""
TABLES["marked_reviews"] = """
    SELECT a.*, m.mark FROM review_arrivals a JOIN (
      SELECT part, max(max(epoch_us(reviewed_at))) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS mark
      FROM review_arrivals GROUP BY part) m ON m.part = a.part"""
TABLES["late_reviews"] = "SELECT * FROM marked_reviews WHERE coalesce(epoch_us(reviewed_at) < mark, FALSE)"
TABLES["timely_log"] = f"SELECT *, {_RANKED} FROM marked_reviews WHERE NOT coalesce(epoch_us(reviewed_at) < mark, FALSE)"
TABLES["timely_fold"] = _fold("timely_log", "timely_fold")
TABLES["timely_final"] = _last("timely_fold")
TABLES["judged_reviews"] = """
    SELECT r.*, CASE WHEN l.id IS NULL THEN 'node_not_found' WHEN r.rating NOT BETWEEN 1 AND 4 THEN 'invalid_rating' END AS reason
    FROM node_reviews r LEFT JOIN live l ON l.owner_id = r.owner_id AND l.id = r.node_id"""
TABLES["applied_log"] = f"SELECT *, {_RANKED} FROM judged_reviews WHERE reason IS NULL"
_S, _, _T = step("f.stability", "f.difficulty", "f.review_count", "f.review_state", "l.rating")
_G = "least(0.99::DOUBLE, (1 - 0.15::DOUBLE * (3 - l.rating)) * f.gap)"
TABLES["applied_fold"] = f"""
    SELECT owner_id, id AS node_id, 0::BIGINT AS rn, stability, difficulty, review_count::BIGINT AS review_count, review_state, last_review_at,
           1 - difficulty AS gap
    FROM decayed WHERE (owner_id, id) IN (SELECT (owner_id, node_id) FROM applied_log)
    UNION ALL
    SELECT l.owner_id, l.node_id, l.rn, {_S}, 1 - {_G}, f.review_count + 1, {_T}, date_trunc('second', l.reviewed_at), {_G}
    FROM applied_fold f JOIN applied_log l ON l.owner_id = f.owner_id AND l.node_id = f.node_id AND l.rn = f.rn + 1"""
TABLES["applied"] = _last("applied_fold")
TABLES["final"] = _last("fold")
TABLES["mixed_final"] = _last("mixed_fold")

TABLES["raw_questions"] = """
    SELECT p_partkey AS id,
           CASE WHEN p_partkey % 10 = 7 THEN 'true_false' WHEN p_partkey % 10 >= 8 THEN 'short_answer' ELSE 'single_choice' END AS question_type,
           CASE p_partkey % 10
             WHEN 0 THEN body WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done'
             WHEN 2 THEN '```' || chr(10) || body || chr(10) || '```' WHEN 3 THEN 'no json about ' || p_name
             WHEN 4 THEN '{"question":"q","options":["A","B","C","D"],"correct_index":1}'
             WHEN 5 THEN '{"question":"q","options":["A","B","C"],"correct_index":1,"explanation":"e"}'
             WHEN 6 THEN '{"question":"q","options":["A","B","C","D"],"correct_index":7,"explanation":"e"}'
             WHEN 7 THEN '{"question":"' || p_name || '","correct_index":1,"explanation":"t"}'
             WHEN 8 THEN '{"question":"' || p_name || '","reference_answer":"r","keywords":["k"]}'
             ELSE '{"question":"q","reference_answer":"r","keywords":"none"}' END AS raw
    FROM (SELECT *, '{"question":"' || p_name || '?","options":["A","B","C","D"],"correct_index":' || (p_partkey % 4)
                    || ',"explanation":"e"}' AS body FROM part)"""
TABLES["raw_batches"] = """
    SELECT p_partkey AS id,
           CASE p_partkey % 5 WHEN 0 THEN mixed WHEN 1 THEN '```json' || chr(10) || mixed || chr(10) || '```'
             WHEN 2 THEN '{"questions":"none"}' WHEN 3 THEN '{"questions":[{"question":"q"}]}' ELSE p_name END AS raw
    FROM (SELECT *, '{"questions":[{"question":"' || p_name || ' one","options":["A","B","C","D"],"correct_index":2,"explanation":"x"},'
            || '{"question":"two","question_type":"true_false","correct_index":5},'
            || '{"question":"three","question_type":"short_answer","reference_answer":"ra","keywords":["k1"]},'
            || '{"question":"four","options":["A","B"],"difficulty":"hard","question_type":"essay"}]}' AS mixed FROM part)"""
TABLES["raw_suggestions"] = """
    SELECT p_partkey AS id,
           CASE p_partkey % 4 WHEN 0 THEN good WHEN 1 THEN 'Here' || chr(10) || '```' || chr(10) || good || chr(10) || '```'
             WHEN 2 THEN '{"nodes":[{"name":"a","content":"b"}]}' ELSE '[]' END AS raw
    FROM (SELECT *, '{"nodes":[{"name":"' || p_name || '","content":"c1","suggested_parent":"' || p_type
            || '"},{"name":"second","content":"c2","suggested_parent":"p"}]}' AS good FROM part)"""
TABLES["raw_node_arrays"] = """
    SELECT p_partkey AS source, CASE WHEN p_partkey % 9 = 4 THEN 'broken ' || p_partkey ELSE
        '[{"id":"a' || p_partkey || '","name":"' || p_name || '","content":"c","parentId":"","sortOrder":4},{"id":"b' || p_partkey
        || '","name":"x","parentId":"a' || p_partkey || '"},{"id":7,"name":"y"},{"name":"z"},{"id":"c' || p_partkey
        || '","name":"w","content":5,"sortOrder":"no"}]' END AS raw
    FROM part"""


def _json_of(source: str) -> str:
    fenced = r"nullif(regexp_extract(raw, '```(?:json)?\s*\n?(.*?)\n?\s*```', 1, 's'), '')"
    return f"SELECT *, CASE WHEN json_valid(raw) THEN raw WHEN json_valid({fenced}) THEN {fenced} END::JSON AS j FROM {source}"


TABLES["question_json"] = _json_of("raw_questions")
TABLES["judged"] = """
    SELECT *, CASE WHEN j IS NULL THEN 'not_json'
        WHEN question_type = 'single_choice' AND NOT (json_exists(j, '$.question') AND json_exists(j, '$.options')
             AND json_exists(j, '$.correct_index') AND json_exists(j, '$.explanation')) THEN 'missing_key'
        WHEN question_type = 'single_choice' AND json_array_length(j, '$.options') <> 4 THEN 'options_not_four'
        WHEN question_type <> 'short_answer' AND NOT CAST(j->>'$.correct_index' AS INTEGER)
             BETWEEN 0 AND CASE question_type WHEN 'true_false' THEN 1 ELSE 3 END THEN 'index_out_of_range'
        WHEN question_type = 'short_answer' AND json_type(j, '$.keywords') <> 'ARRAY' THEN 'keywords_not_list' END AS reason
    FROM question_json"""
TABLES["batch_json"] = _json_of("raw_batches")
TABLES["batch_judged"] = """
    SELECT *, CASE WHEN j IS NULL THEN 'not_json' WHEN json_type(j, '$.questions') <> 'ARRAY' THEN 'no_question_list'
        WHEN id % 5 = 3 THEN 'missing_options' END AS reason
    FROM batch_json"""
TABLES["batch_items"] = """
    SELECT id, unnest(range(4)) AS position, unnest(from_json(j->'$.questions', '["JSON"]')) AS q FROM batch_judged WHERE reason IS NULL"""
TABLES["suggestion_json"] = _json_of("raw_suggestions")
TABLES["array_items"] = """
    SELECT source, unnest(from_json(raw, '["JSON"]')) AS item, unnest(range(json_array_length(raw)::BIGINT)) AS spot
    FROM (SELECT * FROM raw_node_arrays WHERE json_valid(raw))"""

TABLES["moves"] = """
    SELECT id AS seq, owner_id, id, CASE id % 4 WHEN 0 THEN id + 60 WHEN 1 THEN id - 20 WHEN 2 THEN id + 20 END AS new_parent_id
    FROM nodes WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)"""
TABLES["judged_moves"] = """
    SELECT m.*, h.name, CASE
        WHEN h.id IS NULL THEN 'node_not_found'
        WHEN h.parent_id IS NOT DISTINCT FROM m.new_parent_id THEN 'no_op'
        WHEN m.new_parent_id IS NOT NULL AND t.id IS NULL THEN 'parent_not_found'
        WHEN m.id = m.new_parent_id OR EXISTS (SELECT 1 FROM closure c WHERE c.ancestor = m.id AND c.descendant = m.new_parent_id) THEN 'own_descendant'
        WHEN EXISTS (SELECT 1 FROM live s WHERE s.owner_id = m.owner_id AND s.parent_id = m.new_parent_id AND s.name = h.name) THEN 'name_taken'
        ELSE 'ok' END AS reason
    FROM moves m LEFT JOIN live h ON h.owner_id = m.owner_id AND h.id = m.id
    LEFT JOIN live t ON t.owner_id = m.owner_id AND t.id = m.new_parent_id"""
TABLES["accepted"] = """
    SELECT * FROM judged_moves WHERE reason = 'ok'
    QUALIFY new_parent_id IS NULL OR row_number() OVER (PARTITION BY owner_id, new_parent_id, name ORDER BY seq) = 1"""


def _pointers(accepted: str) -> str:
    return f"""
    SELECT l.id, CASE WHEN a.id IS NOT NULL THEN a.new_parent_id ELSE l.up END AS up FROM links l LEFT JOIN {accepted} a ON a.id = l.id"""


def _chase(pointers: str, name: str, accepted: str) -> str:
    return f"""
    SELECT p.id AS start, p.up AS cur FROM {pointers} p JOIN {accepted} a ON a.id = p.id WHERE p.up IS NOT NULL
    UNION
    SELECT c.start, p.up FROM {name} c JOIN {pointers} p ON p.id = c.cur WHERE p.up IS NOT NULL"""


TABLES["pointers"] = _pointers("accepted")
TABLES["chase"] = _chase("pointers", "chase", "accepted")
TABLES["accepted2"] = "SELECT * FROM accepted WHERE id NOT IN (SELECT start FROM chase WHERE start = cur)"
TABLES["pointers2"] = _pointers("accepted2")
TABLES["chase2"] = _chase("pointers2", "chase2", "accepted2")
TABLES["accepted3"] = "SELECT * FROM accepted2 WHERE id NOT IN (SELECT start FROM chase2 WHERE start = cur)"
TABLES["next_orders"] = "SELECT owner_id, parent_id, max(sort_order) + 1 AS next_order FROM live GROUP BY ALL"
TABLES["arrivals"] = """
    SELECT a.id, a.new_parent_id, coalesce(n.next_order, 0)
             + row_number() OVER (PARTITION BY a.owner_id, a.new_parent_id ORDER BY a.seq) - 1 AS sort_order
    FROM accepted3 a LEFT JOIN next_orders n ON n.owner_id = a.owner_id AND n.parent_id IS NOT DISTINCT FROM a.new_parent_id"""
TABLES["dropped"] = "SELECT * FROM links WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)"
TABLES["landing"] = """
    SELECT id AS start, id AS cur FROM dropped
    UNION ALL
    SELECT l.start, d.up FROM landing l JOIN dropped d ON d.id = l.cur WHERE d.up IS NOT NULL"""
TABLES["landed"] = """
    SELECT l.start, CASE WHEN d.id IS NULL THEN l.cur ELSE d.parent_id END AS target
    FROM landing l LEFT JOIN dropped d ON d.id = l.cur WHERE d.id IS NULL OR d.up IS NULL"""
TABLES["promoted"] = """
    SELECT k.owner_id, k.id, g.target, k.sort_order, k.name FROM links k JOIN landed g ON g.start = k.up WHERE k.id NOT IN (SELECT id FROM dropped)"""
TABLES["promoted_at"] = """
    SELECT p.id, p.target, coalesce(n.next_order, 0)
             + row_number() OVER (PARTITION BY p.owner_id, p.target ORDER BY p.sort_order, p.name, p.id) - 1 AS sort_order
    FROM promoted p
    LEFT JOIN (SELECT owner_id, parent_id, max(sort_order) + 1 AS next_order FROM live WHERE id NOT IN (SELECT id FROM dropped) GROUP BY ALL) n
      ON n.owner_id = p.owner_id AND n.parent_id IS NOT DISTINCT FROM p.target"""
TABLES["creates"] = r"""
    SELECT id AS seq, owner_id, parent_id, CASE WHEN id % 6 = 0 THEN '' ELSE 'n' || (id % 4) END AS name FROM nodes"""
TABLES["judged_creates"] = """
    SELECT *, CASE WHEN reason = 'ok' AND parent_id IS NOT NULL
                    AND row_number() OVER (PARTITION BY owner_id, parent_id, name, reason ORDER BY seq) > 1
                   THEN 'name_taken_in_batch' ELSE reason END AS final_reason
    FROM (SELECT c.*, CASE WHEN name = '' THEN 'empty_name'
            WHEN EXISTS (SELECT 1 FROM live s WHERE s.owner_id = c.owner_id AND s.parent_id = c.parent_id AND s.name = c.name) THEN 'name_taken'
            ELSE 'ok' END AS reason FROM creates c)"""



def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", text))


def _needed(text: str) -> list[str]:
    """Common tables named in ``text``, those they name included, in order."""
    found: set[str] = set()
    queue = [text]
    while queue:
        for name in _words(queue.pop()) & TABLES.keys() - found:
            found.add(name)
            queue.append(TABLES[name])
    return [name for name in TABLES if name in found]


def with_tables(body: str) -> str:
    names = _needed(body)
    if not names:
        return body
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in names)
    return f"WITH RECURSIVE {ctes}\n{body}"
