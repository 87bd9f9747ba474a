"""The same questions as DuckDB SQL, written against the tables alone."""

from __future__ import annotations

MENTION = """
mention AS (
  SELECT e.event_id AS idx, 's' || e.event_id AS id, 'user ' || e.user_id || ' ' || e.event_type || ' ' || p.p_name AS sentence,
         'user ' || e.user_id AS subject, p.p_name AS object,
         CASE WHEN e.event_type = 'error' THEN 'no_relation' ELSE 'usr:' || e.event_type END AS relation,
         lower(c.c_mktsegment) AS subj_type, lower(p.p_type) AS obj_type, e.event_type
  FROM events e JOIN customer c ON e.user_id = c.c_custkey
  JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS INT)),
sample AS (SELECT * FROM mention WHERE relation <> 'no_relation'),
pred AS (
  SELECT idx, CASE WHEN idx % 19 <> 0 THEN id END AS id, CASE WHEN idx % 19 <> 0 THEN sentence END AS sentence,
         CASE WHEN idx % 13 = 0 THEN upper(subject) ELSE subject END AS subject,
         CASE WHEN idx % 23 = 0 THEN 'someone else' ELSE object END AS object,
         CASE idx % 10 WHEN 7 THEN 'related_to_' || event_type WHEN 8 THEN 'new_relation' WHEN 9 THEN 'classification_failed' ELSE relation END AS relation,
         subj_type, CASE WHEN idx % 17 <> 0 THEN obj_type END AS obj_type
  FROM sample),
onto AS (
  SELECT row_number() OVER (ORDER BY relation, subj_type, obj_type) - 1 AS ont_idx, relation, subj_type AS domain_type, obj_type AS range_type
  FROM (SELECT DISTINCT relation, subj_type, obj_type FROM sample)),
hidden AS (
  SELECT relation FROM (SELECT relation, row_number() OVER (ORDER BY md5(relation || '42'), relation) AS place,
                               greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS wanted
                        FROM (SELECT DISTINCT relation FROM onto)) WHERE place <= wanted),
known_onto AS (SELECT * FROM onto WHERE relation NOT IN (SELECT relation FROM hidden)),
hidden_onto AS (SELECT * FROM onto WHERE relation IN (SELECT relation FROM hidden))"""

VECTORS = """,
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nvec AS (SELECT count(*) AS n FROM embeddings),
sig AS (SELECT DISTINCT subj_type, relation, obj_type,
               md5(coalesce(subj_type, chr(0)) || '|' || coalesce(relation, chr(0)) || '|' || coalesce(obj_type, chr(0))) AS sig_id,
               'A ' || coalesce(subj_type, 'None') || ' has the relation ''' || relation || ''' with a ' || coalesce(obj_type, 'None') || '.' AS triple_text,
               'Relation: ' || relation AS relation_text, 'Entity Type: ' || subj_type AS subject_text, 'Entity Type: ' || obj_type AS object_text
        FROM pred),
ent AS (SELECT ont_idx, relation, domain_type, range_type,
               'A ' || domain_type || ' has the relation ''' || relation || ''' with a ' || range_type || '.' AS triple_text,
               'Relation: ' || relation AS relation_text, 'Entity Type: ' || domain_type AS subject_text, 'Entity Type: ' || range_type AS object_text
        FROM known_onto),
txt AS (SELECT DISTINCT unnest([triple_text, relation_text, subject_text, object_text]) AS t FROM sig
        UNION SELECT DISTINCT unnest([triple_text, relation_text, subject_text, object_text]) FROM ent),
emb AS (SELECT t, e FROM txt, nvec JOIN vec ON vec_id = CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % n WHERE t IS NOT NULL),
sige AS (SELECT s.*, a.e AS te, b.e AS re, c.e AS se, d.e AS oe FROM sig s LEFT JOIN emb a ON a.t = triple_text LEFT JOIN emb b ON b.t = relation_text
         LEFT JOIN emb c ON c.t = subject_text LEFT JOIN emb d ON d.t = object_text),
ente AS (SELECT s.*, a.e AS te, b.e AS re, c.e AS se, d.e AS oe FROM ent s LEFT JOIN emb a ON a.t = triple_text LEFT JOIN emb b ON b.t = relation_text
         LEFT JOIN emb c ON c.t = subject_text LEFT JOIN emb d ON d.t = object_text),
sims AS (SELECT s.sig_id, s.subj_type, s.relation, s.obj_type, o.ont_idx, o.domain_type, o.range_type,
                coalesce(list_dot_product(s.te, o.te), 0) AS sim_triple, coalesce(list_dot_product(s.re, o.re), 0) AS sim_relation,
                coalesce(list_dot_product(s.se, o.se), 0) AS sim_subject, coalesce(list_dot_product(s.oe, o.oe), 0) AS sim_object
         FROM sige s, ente o),
best AS (SELECT * FROM (SELECT *, round((sim_triple + sim_relation + sim_subject + sim_object) / 4, 9) AS best_score FROM sims)
         QUALIFY row_number() OVER (PARTITION BY sig_id ORDER BY best_score DESC, ont_idx) = 1),
cls AS (SELECT domain_type AS class FROM known_onto UNION SELECT range_type FROM known_onto),
matched AS (SELECT *, best_score >= 0.9 AS near,
                   coalesce(subj_type IN (SELECT class FROM cls) AND obj_type IN (SELECT class FROM cls) AND (subj_type <> domain_type OR obj_type <> range_type), false) AS viol
            FROM best),
results AS (
  SELECT p.idx AS classified_idx, p.id AS sentence_id, CASE WHEN near THEN m.ont_idx END AS matched_ontology_idx,
         CASE WHEN near AND NOT viol THEN 'known_triple' WHEN near THEN 'constraint_violation' ELSE 'new_triple_candidate' END AS match_type,
         near AND viol AS constraint_violation, NOT (near AND NOT viol) AS to_cluster,
         CASE WHEN near AND viol THEN 'constraint' WHEN NOT near THEN 'relation' END AS cluster_mode, round(best_score, 6) AS best_score,
         round(sim_triple, 6) AS triple_similarity, round(sim_relation, 6) AS relation_similarity,
         CASE WHEN p.subj_type IS NOT NULL THEN round(sim_subject, 6) END AS subject_similarity, CASE WHEN p.obj_type IS NOT NULL THEN round(sim_object, 6) END AS object_similarity
  FROM pred p JOIN matched m ON p.relation = m.relation AND p.subj_type IS NOT DISTINCT FROM m.subj_type AND p.obj_type IS NOT DISTINCT FROM m.obj_type)"""

CLUSTERS = """,
un AS (SELECT p.*, coalesce(p.subj_type, 'None') || ':' || coalesce(p.obj_type, 'None') AS type_sig, r.cluster_mode, x.e
       FROM pred p JOIN results r ON r.classified_idx = p.idx AND r.to_cluster JOIN emb x ON x.t = 'Relation: ' || p.relation),
lab AS (SELECT type_sig, cluster_mode, relation, count(*) AS c, any_value(e) AS e FROM un GROUP BY ALL EXCLUDE (e)),
prs AS (SELECT a.type_sig, a.cluster_mode, a.relation AS a, b.relation AS b, CASE WHEN a.relation = b.relation THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END AS pairs,
               CASE WHEN a.relation = b.relation THEN 1.0::DOUBLE ELSE round(list_dot_product(a.e, b.e), 9) END AS sim
        FROM lab a JOIN lab b ON a.type_sig = b.type_sig AND a.cluster_mode = b.cluster_mode AND a.relation <= b.relation),
rowpairs AS (SELECT type_sig, cluster_mode, sim FROM prs, range(0, pairs)),
lim AS (SELECT type_sig, cluster_mode, greatest(0.05, quantile_cont(sim, 0.25)) AS threshold FROM rowpairs GROUP BY 1, 2),
edg AS (SELECT p.*, threshold FROM prs p JOIN lim USING (type_sig, cluster_mode) WHERE pairs > 0 AND sim >= threshold)"""
CLUSTERS = CLUSTERS.replace("GROUP BY ALL EXCLUDE (e)", "GROUP BY type_sig, cluster_mode, relation")

COMPONENTS = """,
reach(type_sig, cluster_mode, node, other) AS (
  SELECT type_sig, cluster_mode, relation, relation FROM lab
  UNION SELECT r.type_sig, r.cluster_mode, r.node, CASE WHEN g.a = r.other THEN g.b ELSE g.a END
  FROM reach r JOIN edg g ON g.type_sig = r.type_sig AND g.cluster_mode = r.cluster_mode AND (g.a = r.other OR g.b = r.other)),
part_ AS (SELECT type_sig, cluster_mode, node AS relation, min(other) AS part FROM reach GROUP BY 1, 2, 3),
member AS (SELECT u.*, part FROM un u JOIN part_ USING (type_sig, cluster_mode, relation)),
numbered AS (SELECT type_sig, cluster_mode, part, row_number() OVER (ORDER BY cf, f) - 1 AS cluster_id
             FROM (SELECT type_sig, cluster_mode, part, min(idx) AS f, min(min(idx)) OVER (PARTITION BY type_sig, cluster_mode) AS cf FROM member GROUP BY 1, 2, 3)),
clu AS (SELECT m.*, cluster_id FROM member m JOIN numbered USING (type_sig, cluster_mode, part)),
clab AS (SELECT cluster_id, relation, count(*) AS c, any_value(e) AS e FROM clu GROUP BY 1, 2),
cprs AS (SELECT a.cluster_id, CASE WHEN a.relation = b.relation THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END AS pairs,
                CASE WHEN a.relation = b.relation THEN 1.0::DOUBLE ELSE round(list_dot_product(a.e, b.e), 9) END AS sim
         FROM clab a JOIN clab b ON a.cluster_id = b.cluster_id AND a.relation <= b.relation),
csim AS (SELECT cluster_id, sum(sim * pairs) / sum(pairs) AS mean_sim, min(sim) AS min_sim, max(sim) AS max_sim FROM cprs WHERE pairs > 0 GROUP BY 1),
csize AS (SELECT cluster_id, count(*) AS n FROM clu GROUP BY 1)"""

CAND = """,
ev0 AS (SELECT * FROM pred WHERE obj_type IS NOT NULL AND relation NOT LIKE 'usr:%'),
cand AS (SELECT row_number() OVER (ORDER BY subj_type, obj_type) - 1 AS cluster_id, subj_type, obj_type, count(*) AS cluster_size FROM ev0 GROUP BY subj_type, obj_type),
cands AS (SELECT *, 'rel_' || cluster_id AS name, CASE WHEN cluster_id % 5 = 4 THEN 'NOWHERE' ELSE upper(subj_type) END AS domain, upper(obj_type) AS range,
                 cluster_size % 7 = 0 AS existing_match, CASE cluster_size % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS confidence FROM cand),
ev AS (SELECT e.*, cluster_id FROM ev0 e JOIN cand USING (subj_type, obj_type)),
allcls AS (SELECT upper(domain_type) AS class FROM onto UNION SELECT upper(range_type) FROM onto),
judged AS (SELECT *, CASE WHEN existing_match THEN 'existing_match' WHEN domain NOT IN (SELECT class FROM allcls) THEN 'invalid_domain'
                          WHEN range NOT IN (SELECT class FROM allcls) THEN 'invalid_range' WHEN confidence = 'Low' THEN 'low_confidence' ELSE 'accepted' END AS reason FROM cands)"""

SCORED = """
scored AS (SELECT vec_id AS idx, CAST(label AS BIGINT) AS pred, 'c' || (vec_id % 7) AS "true", vec_id % 11 = 0 AS aligned FROM embeddings),
tab AS (SELECT pred, "true", count(*) AS n FROM scored GROUP BY 1, 2),
mar AS (SELECT *, sum(n) OVER (PARTITION BY pred)::DOUBLE AS a, sum(n) OVER (PARTITION BY "true")::DOUBLE AS b, sum(n) OVER ()::DOUBLE AS t FROM tab)"""

EMB = """
v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dims AS (SELECT label, i, avg(e[i]) AS m, count(*) AS size FROM v, range(1, 65) r(i) GROUP BY 1, 2),
cen AS (SELECT label, max(size) AS size, list(m ORDER BY i) AS c FROM dims GROUP BY 1),
sca AS (SELECT v.label, avg(list_distance(e, c)) AS s, sum(list_distance(e, c) ** 2) AS w, any_value(size) AS size, any_value(c) AS c FROM v JOIN cen USING (label) GROUP BY 1),
cp AS (SELECT a.label, a.s AS s1, b.s AS s2, list_distance(a.c, b.c) AS d FROM sca a JOIN sca b ON a.label <> b.label)"""

SILHOUETTE = """,
d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, avg(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
r AS (SELECT i, min(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM d GROUP BY 1),
sil AS (SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM r)"""

BUNDLE = """,
dab AS (SELECT round(avg(x), 6) AS davies_bouldin FROM (SELECT label, max((s1 + s2) / d) AS x FROM cp GROUP BY 1)),
g AS (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) r(i) GROUP BY 1), gm AS (SELECT list(m ORDER BY i) AS c FROM g),
cah AS (SELECT round((sum(s.size * list_distance(s.c, gm.c) ** 2) / (count(*) - 1)) / (sum(w) / ((SELECT count(*) FROM v) - count(*))), 6) AS calinski_harabasz FROM sca s, gm),
den AS (SELECT round((SELECT avg(s) FROM sca) / ((SELECT avg(d) FROM cp) + 1e-8), 6) AS density_separation)"""

TYPE_PAIRS = """,
h0 AS (SELECT vec_id, CASE WHEN vec_id % 5 <> 4 THEN 'p' || (vec_id % 5) ELSE 'UNK:UNK' END AS pair, label % 3 AS label, e FROM v),
h AS (SELECT * FROM h0 QUALIFY count(*) OVER (PARTITION BY pair, label) > 1),
sz AS (SELECT pair, count(*) AS n_samples, count(DISTINCT label) AS n_clusters FROM h GROUP BY 1 HAVING count(*) >= 3),
d AS (SELECT a.pair, a.vec_id AS i, a.label AS li, b.label AS lj, avg(list_distance(a.e, b.e)) AS d FROM h a JOIN h b ON a.pair = b.pair AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
r AS (SELECT pair, i, min(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM d GROUP BY 1, 2),
sil AS (SELECT pair, avg(coalesce((b - a) / greatest(a, b), 0)) AS x FROM r GROUP BY 1),
dm AS (SELECT pair, label, i, avg(e[i]) AS m, count(*) AS size FROM h, range(1, 65) q(i) GROUP BY 1, 2, 3),
ce AS (SELECT pair, label, max(size) AS size, list(m ORDER BY i) AS c FROM dm GROUP BY 1, 2),
sc AS (SELECT pair, label, avg(list_distance(e, c)) AS s, sum(list_distance(e, c) ** 2) AS w, any_value(size) AS size, any_value(c) AS c FROM h JOIN ce USING (pair, label) GROUP BY 1, 2),
cq AS (SELECT a.pair, a.label, a.s AS s1, b.s AS s2, list_distance(a.c, b.c) AS d FROM sc a JOIN sc b ON a.pair = b.pair AND a.label <> b.label),
db AS (SELECT pair, avg(x) AS x FROM (SELECT pair, label, max((s1 + s2) / d) AS x FROM cq GROUP BY 1, 2) GROUP BY 1),
gm AS (SELECT pair, list(m ORDER BY i) AS g FROM (SELECT pair, i, avg(e[i]) AS m FROM h, range(1, 65) q(i) GROUP BY 1, 2) GROUP BY 1),
ch AS (SELECT pair, (sum(size * list_distance(c, g) ** 2) / nullif(count(*) - 1, 0)) / (sum(w) / nullif(any_value(n_samples) - count(*), 0)) AS x FROM sc JOIN gm USING (pair) JOIN sz USING (pair) GROUP BY 1),
wi AS (SELECT a.pair, max(1 - list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8))) AS wide
       FROM h a JOIN h b ON a.pair = b.pair AND a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
nr AS (SELECT pair, min(d) AS near FROM cq GROUP BY 1),
tp AS (SELECT pair, CASE WHEN n_clusters > 1 AND n_clusters < n_samples THEN round(sil.x, 6) END AS silhouette, CASE WHEN n_clusters > 1 AND n_clusters < n_samples THEN round(ch.x, 6) END AS calinski_harabasz,
              CASE WHEN n_clusters > 1 AND n_clusters < n_samples THEN round(db.x, 6) END AS davies_bouldin, round(near / wide, 6) AS dunn, n_samples, n_clusters
       FROM sz LEFT JOIN sil USING (pair) LEFT JOIN ch USING (pair) LEFT JOIN db USING (pair) LEFT JOIN nr USING (pair) LEFT JOIN wi USING (pair))"""

REPORT = """,
rel AS (SELECT type_sig, relation, count(*) AS c, any_value(e) AS e FROM un GROUP BY 1, 2),
rprs AS (SELECT a.type_sig, a.relation AS a, b.relation AS b, CASE WHEN a.relation = b.relation THEN a.c * (a.c - 1) // 2 ELSE a.c * b.c END AS pairs,
                CASE WHEN a.relation = b.relation THEN 1.0::DOUBLE ELSE (greatest(-1, least(1, round(list_cosine_similarity(a.e, b.e), 9))) + 1) / 2 END AS sim
         FROM rel a JOIN rel b ON a.type_sig = b.type_sig AND a.relation <= b.relation),
rsim AS (SELECT type_sig, sum(sim * pairs) / sum(pairs) AS mean_sim, min(sim) AS min_sim, max(sim) AS max_sim FROM rprs WHERE pairs > 0 GROUP BY 1),
redg AS (SELECT * FROM rprs WHERE pairs > 0 AND sim >= 0.65),
rnode AS (SELECT type_sig, a AS node FROM redg UNION SELECT type_sig, b FROM redg),
rreach(type_sig, node, other) AS (
  SELECT type_sig, node, node FROM rnode
  UNION SELECT r.type_sig, r.node, CASE WHEN g.a = r.other THEN g.b ELSE g.a END FROM rreach r JOIN redg g ON g.type_sig = r.type_sig AND (g.a = r.other OR g.b = r.other)),
rcomp AS (SELECT type_sig, count(DISTINCT part) AS components FROM (SELECT type_sig, node, min(other) AS part FROM rreach GROUP BY 1, 2) GROUP BY 1)"""

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
FUZZY = "coalesce(length({0}) > 0 AND length({1}) > 0 AND (contains(lower(trim({1})), lower(trim({0}))) OR contains(lower(trim({0})), lower(trim({1})))), false)"
MEANINGFUL = r"coalesce(length({0}) > 2 AND NOT regexp_matches(lower(trim({0})), '^new_relation|^unknown|^relation$|^error|^temp|^none|^null|^\w+_to_\w+$') AND length({0}) - length(replace({0}, '_', '')) <= 2, false)"


def m(body: str) -> str:
    return f"WITH {MENTION}\n{body}"


def a(body: str) -> str:
    return f"WITH {MENTION}{VECTORS}\n{body}"


def k(body: str) -> str:
    return f"WITH RECURSIVE {MENTION}{VECTORS}{CLUSTERS}{COMPONENTS}\n{body}"


def c(body: str) -> str:
    return f"WITH {MENTION}{CAND}\n{body}"


def s(body: str) -> str:
    return f"WITH {SCORED}\n{body}"


def e(body: str) -> str:
    return f"WITH {EMB}\n{body}"


SUBSET = "pred >= 0 AND \"true\" <> '' AND NOT aligned"
EVAL = f"""ev AS (
  SELECT s.id AS key, EXISTS (SELECT 1 FROM known_onto o WHERE o.relation = s.relation AND o.domain_type = s.subj_type AND o.range_type = s.obj_type) AS is_known,
         {FUZZY.format("p.subject", "s.subject")} AND {FUZZY.format("p.object", "s.object")} AS entity_ok, p.relation = s.relation AS exact, {MEANINGFUL.format("p.relation")} AS meaningful
  FROM sample s JOIN pred p ON p.id = s.id)"""

SQL: dict[str, str] = {
    "load_filter_no_relation": m("SELECT idx, id, subject, relation, object FROM sample"),
    "span_slice_join": """
        WITH t AS (SELECT doc_id, text, string_split(text, ' ') AS tok FROM documents WHERE doc_id % 9 <> 0)
        SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_slice(tok, doc_id % 5 + 1, doc_id % 5 + 2), ' ') AS subject,
               coalesce(array_to_string(list_slice(tok, doc_id % 7 + 4, doc_id % 7 + 3 + doc_id % 4), ' '), '') AS object, md5(text) AS sentence_md5 FROM t""",
    "normalise_types": "SELECT p_partkey, lower(p_type) AS lower_type, upper(p_type) AS upper_type, ' ' || chr(9) || p_type || chr(10) AS with_default FROM part",
    "flatten_triple": m("SELECT id AS sentence_id, sentence, subject, subj_type, relation, object, obj_type FROM pred"),
    "fuzzy_entity_match": m(f"SELECT s.idx, {FUZZY.format('p.subject', 's.subject')} AS subject_ok, {FUZZY.format('p.object', 's.object')} AS object_ok FROM sample s JOIN pred p USING (idx)"),
    "meaningful_relation": m(f"SELECT relation, count(*) AS n, {MEANINGFUL.format('relation')} AS meaningful FROM pred GROUP BY relation"),
    "schema_extract": m("SELECT upper(subj_type) AS domain, upper(obj_type) AS range, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM sample GROUP BY 1, 2"),
    "schema_summary": m("""SELECT count(DISTINCT d) AS n_domains, count(DISTINCT d || '/' || r) AS n_pairs, count(DISTINCT d || '/' || r || '/' || relation) AS n_labels,
        (SELECT count(*) FROM sample WHERE idx % 17 = 0) AS n_skipped
        FROM (SELECT upper(subj_type) AS d, upper(obj_type) AS r, relation FROM sample WHERE idx % 17 <> 0)"""),
    "schema_explode": m("SELECT row_number() OVER (ORDER BY domain_type, range_type, relation) - 1 AS ont_idx, relation, domain_type, range_type FROM onto"),
    "relation_variants": m("SELECT relation, count(*) AS n_variants FROM onto GROUP BY 1 HAVING count(*) > 1"),
    "ontology_split": m("SELECT *, 'known' AS part FROM known_onto UNION ALL SELECT *, 'hidden' FROM hidden_onto"),
    "split_metadata": m("""SELECT (SELECT count(DISTINCT relation) FROM known_onto) AS n_known_relations, (SELECT count(*) FROM hidden) AS n_hidden_relations,
        (SELECT count(*) FROM known_onto) AS n_known_entries, (SELECT count(*) FROM hidden_onto) AS n_hidden_entries, 'hash' AS split_mode,
        (SELECT string_agg(relation, ',' ORDER BY relation) FROM hidden) AS hidden_relations,
        round((SELECT count(*) FROM hidden) / (SELECT count(DISTINCT relation) FROM onto)::DOUBLE, 6) AS hidden_split_ratio"""),
    "split_validate": m("""SELECT (SELECT count(*) FROM known_onto) + (SELECT count(*) FROM hidden_onto) = (SELECT count(*) FROM onto) AS entries_conserved,
        NOT EXISTS (SELECT ont_idx FROM known_onto INTERSECT SELECT ont_idx FROM hidden_onto) AS entries_disjoint,
        NOT EXISTS (SELECT relation FROM known_onto INTERSECT SELECT relation FROM hidden_onto) AS labels_separate"""),
    "class_set_known": m("SELECT domain_type AS class FROM known_onto UNION SELECT range_type FROM known_onto"),
    "class_set_full": m("SELECT upper(domain_type) AS class FROM onto UNION SELECT upper(range_type) FROM onto"),
    "hidden_labels": m("SELECT relation FROM hidden"),
    "sample_known_hidden": m("SELECT id, relation, relation IN (SELECT relation FROM hidden) AS is_hidden, md5(id || '42') AS shuffle_key FROM sample"),
    "same_type_relations": c("""SELECT cluster_id, coalesce((SELECT string_agg(DISTINCT relation, ',' ORDER BY relation) FROM known_onto o
        WHERE o.domain_type = cands.subj_type AND o.range_type = cands.obj_type), '') AS same_type_relations FROM cands"""),
    "prompt_classification": m("""SELECT id, md5('Sentence: ' || sentence || chr(10) || 'Subject: ' || subject || ' (' || subj_type || ')' || chr(10) || 'Object: ' || object || ' (' || obj_type || ')' || chr(10) || 'Relations:' || chr(10)
        || (SELECT string_agg('- ' || relation || ': from ' || domain_type || ' to ' || range_type, chr(10) ORDER BY ont_idx) FROM known_onto)
        || chr(10) || 'Answer with one JSON object: {"subject": ..., "relation": ..., "object": ...}') AS prompt_md5 FROM sample"""),
    "classification_join": m("SELECT s.id AS key, s.relation AS s_relation, p.relation AS o_relation, p.subject AS o_subject FROM sample s JOIN pred p ON p.id = s.id"),
    "classification_metrics": m(f""", {EVAL}
        SELECT CASE WHEN grouping(is_known) = 1 THEN 'overall' WHEN is_known THEN 'known' ELSE 'hidden' END AS part, count(*) AS n,
               round(avg(entity_ok::INT), 6) AS entity_accuracy, round(avg(exact::INT), 6) AS relation_exact_match, round(avg(meaningful::INT), 6) AS relation_classification_rate,
               round(avg((CASE WHEN is_known THEN exact ELSE meaningful END)::INT), 6) AS success_rate
        FROM ev GROUP BY GROUPING SETS ((is_known), ())"""),
    "resume_anti_join": m("SELECT id FROM sample WHERE id NOT IN (SELECT id FROM pred WHERE idx % 3 = 0 AND id IS NOT NULL)"),
    "embedding_texts": a("SELECT triple_text, relation_text, subject_text, object_text FROM sig"),
    "embed_distinct": m(""", nvec AS (SELECT count(*) AS n FROM embeddings),
        t AS (SELECT DISTINCT unnest(['A ' || domain_type || ' has the relation ''' || relation || ''' with a ' || range_type || '.', 'Relation: ' || relation, 'Entity Type: ' || domain_type, 'Entity Type: ' || range_type]) AS text FROM onto)
        SELECT text, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::INT AS dim FROM t, nvec JOIN embeddings ON vec_id = CAST('0x' || substr(md5(text), 1, 6) AS BIGINT) % n"""),
    "l2_normalise": """WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * (vec_id % 4)) AS e FROM embeddings),
        y AS (SELECT vec_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) AS l FROM x)
        SELECT vec_id, round(sqrt(list_dot_product(e, e)) / l, 6) AS length, CASE WHEN e[3] = 0 THEN 0.0::DOUBLE ELSE round(e[3] / l, 6) END AS third FROM y""",
    "mean_pool": """SELECT CAST(label AS BIGINT) AS label, round(sum(CASE WHEN vec_id % 3 <> 0 THEN embedding[1]::DOUBLE ELSE 0 END) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 6) AS first,
        round(arg_max(embedding[1]::DOUBLE, vec_id) FILTER (vec_id % 3 <> 0), 6) AS last_first FROM embeddings GROUP BY label""",
    "sim_triple_ontology": a("SELECT sig_id, ont_idx, round(sim_triple, 6) AS sim_triple, round(sim_relation, 6) AS sim_relation, round(sim_subject, 6) AS sim_subject, round(sim_object, 6) AS sim_object FROM sims"),
    "align_argmax": a("SELECT sig_id, ont_idx, round(best_score, 6) AS best_score FROM best"),
    "align_results": a("SELECT * FROM results"),
    "align_stats": a("SELECT count(*) AS total, count(*) FILTER (match_type = 'known_triple') AS aligned, count(*) FILTER (to_cluster) AS to_cluster, count(*) FILTER (constraint_violation) AS violations FROM results"),
    "align_metrics": a(""", j AS (SELECT r.match_type = 'known_triple' AS al, EXISTS (SELECT 1 FROM known_onto o WHERE o.relation = s.relation AND o.domain_type = s.subj_type AND o.range_type = s.obj_type) AS kn
             FROM results r JOIN sample s ON s.idx = r.classified_idx),
        n AS (SELECT count(*) FILTER (al AND kn) AS tp, count(*) FILTER (al AND NOT kn) AS fp, count(*) FILTER (NOT al AND kn) AS fn, count(*) FILTER (NOT al AND NOT kn) AS tn FROM j),
        q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re FROM n)
        SELECT tp, fp, fn, tn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity FROM q"""),
    "sim_inter_triple": e("SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id"),
    "sim_inter_views": a("""SELECT * FROM (SELECT coalesce(a.subj_type, 'None') || ':' || coalesce(a.obj_type, 'None') AS type_sig, a.sig_id AS i, b.sig_id AS j,
        round(coalesce(list_dot_product(a.te, b.te), 0), 6) AS sim_triple, round(coalesce(list_dot_product(a.re, b.re), 0), 6) AS sim_relation,
        round(coalesce(list_dot_product(a.se, b.se), 0), 6) AS sim_subject, round(coalesce(list_dot_product(a.oe, b.oe), 0), 6) AS sim_object
        FROM sige a JOIN sige b ON a.subj_type IS NOT DISTINCT FROM b.subj_type AND a.obj_type IS NOT DISTINCT FROM b.obj_type AND a.sig_id < b.sig_id)"""),
    "cosine_normalise": e("""SELECT a.vec_id AS i, b.vec_id AS j, round((greatest(-1, least(1, 2 * list_dot_product(a.e, b.e) / sqrt(greatest(2 * list_dot_product(a.e, a.e), 1e-6) * greatest(2 * list_dot_product(b.e, b.e), 1e-6)))) + 1) / 2, 6) AS value
        FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id"""),
    "cosine_distance": e("""SELECT a.vec_id AS i, b.vec_id AS j, round(1 - list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)), 6) AS distance
        FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id"""),
    "type_stratify": m("""SELECT type_sig, n, first_idx, row_number() OVER (ORDER BY first_idx) - 1 AS group_no
        FROM (SELECT coalesce(subj_type, 'None') || ':' || coalesce(obj_type, 'None') AS type_sig, count(*) AS n, min(idx) AS first_idx FROM pred GROUP BY 1)"""),
    "graph_split_edges": k("SELECT type_sig, cluster_mode, a, b, pairs, round(sim, 6) AS sim, round(threshold, 6) AS threshold FROM edg"),
    "graph_split_components": k("SELECT idx, type_sig, relation, cluster_id FROM clu"),
    "cluster_quality": k("SELECT sum(n)::BIGINT AS total_items, count(*) AS total_clusters, round(avg(n), 6) AS avg_cluster_size, round(avg(mean_sim), 6) AS avg_within_cluster_similarity FROM csize JOIN csim USING (cluster_id)"),
    "cluster_similarity": k("SELECT cluster_id, n, round(mean_sim, 6) AS mean_sim, round(min_sim, 6) AS min_sim, round(max_sim, 6) AS max_sim FROM csize JOIN csim USING (cluster_id)"),
    "cluster_report_top5": k("""SELECT type_sig AS cluster_id, relation, n, rank::INT AS rank FROM (SELECT type_sig, relation, count(*) AS n, row_number() OVER (PARTITION BY type_sig ORDER BY count(*) DESC, relation) AS rank FROM un GROUP BY 1, 2) WHERE rank <= 5"""),
    "cluster_report": k(REPORT + """ SELECT type_sig AS cluster_id, sum(c)::BIGINT AS n, count(*) AS n_relations, round(any_value(mean_sim), 6) AS mean_sim,
        round(any_value(min_sim), 6) AS min_sim, round(any_value(max_sim), 6) AS max_sim, coalesce(any_value(components), 0) AS components
        FROM rel LEFT JOIN rsim USING (type_sig) LEFT JOIN rcomp USING (type_sig) GROUP BY 1"""),
    "graph_split_default": k("SELECT idx, type_sig, relation, cluster_id FROM clu").replace("greatest(0.05,", "greatest(0.60,"),
    "cluster_summary": k("""SELECT cluster_mode, sum(n)::BIGINT AS items, count(*) AS clusters, count(*) FILTER (n = 1) AS singletons
        FROM (SELECT cluster_mode, type_sig || relation AS cl, count(*) AS n FROM un GROUP BY 1, 2) GROUP BY 1"""),
    "singleton_merge_onepass": k(""", coded AS (SELECT *, CAST('0x' || substr(md5(type_sig || '/' || relation), 1, 8) AS BIGINT) * 2 + CASE WHEN row_number() OVER (PARTITION BY type_sig, relation ORDER BY idx) = 1 THEN 1 ELSE 0 END AS cid FROM un),
        sized AS (SELECT *, count(*) OVER (PARTITION BY cid) AS n FROM coded),
        large AS (SELECT cid, relation, count(*) AS c, any_value(e) AS e FROM sized WHERE n > 1 GROUP BY 1, 2),
        name AS (SELECT relation, any_value(e) AS e FROM sized WHERE n = 1 GROUP BY 1),
        score AS (SELECT name.relation, cid, sum(round(list_dot_product(name.e, large.e), 9) * c) / sum(c) AS score FROM name, large GROUP BY 1, 2),
        target AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY relation ORDER BY round(score, 9) DESC, cid) = 1)
        SELECT idx, t.cid AS target FROM sized s JOIN target t USING (relation) WHERE n = 1 AND score > 0.8"""),
    "ground_truth_lookup": m('SELECT p.idx, s.relation AS "true" FROM pred p JOIN sample s ON s.id = p.id'),
    "flat_labels": m("SELECT idx, CASE WHEN idx % 4 <> 0 THEN idx % 6 ELSE -1 END AS pred FROM pred"),
    "eval_masks": s(f"""SELECT idx, pred, "true", {SUBSET} AND "true" IN ('c1', 'c4') AS novel_discovery, {SUBSET} AND "true" NOT IN ('c1', 'c4') AS robustness_known, {SUBSET} AS overall_pipeline FROM scored"""),
    "contingency": s('SELECT pred, "true", n FROM tab'),
    "bcubed": s("SELECT round(p, 6) AS bcubed_precision, round(r, 6) AS bcubed_recall, round(2 * p * r / (p + r), 6) AS bcubed_f1 FROM (SELECT sum(n * n / a / t) AS p, sum(n * n / b / t) AS r FROM mar)"),
    "vmeasure": s(""", x AS (SELECT sum(n / t * ln(t * n / (a * b))) AS mi FROM mar),
        h AS (SELECT -sum(b / t * ln(b / t)) AS ht FROM (SELECT DISTINCT "true", b, t FROM mar)), q AS (SELECT -sum(a / t * ln(a / t)) AS hp FROM (SELECT DISTINCT pred, a, t FROM mar))
        SELECT round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) AS v_measure, round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness FROM x, h, q"""),
    "ari": s(""", z AS (SELECT (SELECT sum(n * n)::DOUBLE FROM tab) AS s, (SELECT sum(b * b) FROM (SELECT DISTINCT "true", b FROM mar)) AS bb, (SELECT sum(a * a) FROM (SELECT DISTINCT pred, a FROM mar)) AS aa, (SELECT sum(n)::DOUBLE FROM tab) AS t),
        y AS (SELECT s - t AS tp, bb - s AS fp, aa - s AS fn, t * t - (bb - s) - (aa - s) - s AS tn FROM z)
        SELECT round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari FROM y"""),
    "metric_flatten": s("""SELECT unnest(['overall_bcubed_precision', 'overall_bcubed_recall', 'overall_bcubed_f1']) AS name, unnest([round(p, 6), round(r, 6), round(2 * p * r / (p + r), 6)]) AS value
        FROM (SELECT sum(n * n / a / t) AS p, sum(n * n / b / t) AS r FROM mar)"""),
    "silhouette": e(SILHOUETTE + " SELECT silhouette FROM sil"),
    "quality_bundle": e(SILHOUETTE + BUNDLE + " SELECT silhouette, davies_bouldin, calinski_harabasz, density_separation FROM sil, dab, cah, den"),
    "davies_bouldin": e("SELECT round(avg(x), 6) AS davies_bouldin FROM (SELECT label, max((s1 + s2) / d) AS x FROM cp GROUP BY 1)"),
    "calinski_harabasz": e(""", g AS (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) r(i) GROUP BY 1), gm AS (SELECT list(m ORDER BY i) AS c FROM g)
        SELECT round((sum(s.size * list_distance(s.c, gm.c) ** 2) / (count(*) - 1)) / (sum(w) / ((SELECT count(*) FROM v) - count(*))), 6) AS calinski_harabasz FROM sca s, gm"""),
    "density_sep": e("SELECT round((SELECT avg(s) FROM sca) / ((SELECT avg(d) FROM cp) + 1e-8), 6) AS density_separation"),
    "dunn": e("""SELECT round((SELECT min(d) FROM cp) / (SELECT max(1 - list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-8) * (sqrt(list_dot_product(b.e, b.e)) + 1e-8)))
        FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id), 6) AS dunn"""),
    "typepair_quality": e(TYPE_PAIRS + " SELECT * FROM tp"),
    "typepair_summary": e(TYPE_PAIRS + """ SELECT round(avg(silhouette), 6) AS avg_silhouette, round(avg(calinski_harabasz), 6) AS avg_calinski_harabasz,
        round(avg(davies_bouldin), 6) AS avg_davies_bouldin, round(avg(dunn), 6) AS avg_dunn, count(*) AS n_typepairs FROM tp"""),
    "representatives_topk": e(""", d AS (SELECT label AS cluster_id, vec_id AS idx, round(list_distance(e, c), 6) AS distance FROM v JOIN cen USING (label))
        SELECT cluster_id, idx, rank::INT AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, idx) AS rank FROM d) WHERE rank <= 5"""),
    "large_clusters": c("SELECT cluster_id, count(*) AS cluster_size FROM ev GROUP BY 1 HAVING count(*) >= 25"),
    "prompt_validation": c(""", top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) AS rank FROM ev QUALIFY rank <= 5),
        l AS (SELECT cluster_id, string_agg(rank || '. ' || subject || ' | ' || relation || ' | ' || object, chr(10) ORDER BY rank) AS lines FROM top GROUP BY 1),
        r AS (SELECT cluster_id, coalesce((SELECT string_agg(DISTINCT relation, ',' ORDER BY relation) FROM known_onto o WHERE o.domain_type = cands.subj_type AND o.range_type = cands.obj_type), 'None') AS rel FROM cands)
        SELECT cluster_id, md5('Cluster ' || cluster_id || ' of ' || cluster_size || ' triples, ' || upper(subj_type) || ' to ' || upper(obj_type) || ':' || chr(10) || lines || chr(10) || 'Known relations: ' || rel || chr(10)
        || 'Answer with one JSON object: name, description, domain, range, existing_match, existing_relation_name, confidence, reasoning.') AS prompt_md5 FROM cands JOIN l USING (cluster_id) JOIN r USING (cluster_id)"""),
    "accept_candidates": c("SELECT cluster_id, name, reason, reason = 'accepted' AS accepted FROM judged"),
    "rejected_buckets": c("""SELECT CASE WHEN reason = 'existing_match' THEN reason WHEN reason LIKE 'invalid%' THEN 'type_incompatible' ELSE 'low_confidence' END AS bucket, count(*) AS n,
        string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) AS clusters FROM judged WHERE reason <> 'accepted' GROUP BY 1"""),
    "rejected_report": c("""SELECT coalesce(string_agg(name || '|' || lower(name) || '|' || cluster_id, ';' ORDER BY cluster_id) FILTER (reason = 'existing_match'), '') AS existing_match,
        coalesce(string_agg(name || '|' || domain || '|' || range || '|' || cluster_id, ';' ORDER BY cluster_id) FILTER (reason LIKE 'invalid%'), '') AS type_incompatible,
        coalesce(string_agg(CAST(cluster_id AS VARCHAR), ';' ORDER BY cluster_id) FILTER (reason = 'low_confidence'), '') AS low_confidence FROM judged"""),
    "novel_export": c(""", top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) AS rank FROM ev)
        SELECT j.cluster_id, name, domain, range, confidence, (SELECT count(*) FROM ev WHERE ev.cluster_id = j.cluster_id) AS evidence_count,
               (SELECT string_agg(subject || '|' || relation || '|' || object, ';' ORDER BY rank) FROM top WHERE top.cluster_id = j.cluster_id AND rank <= 5) AS sample_triples
        FROM judged j WHERE reason = 'accepted'"""),
}
