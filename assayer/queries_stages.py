"""Driver queries of whole stages, and of the branches that other queries see in part only. Registered by ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import labels as L
from .functions import vocab as V
from .operators import graph, images, reconcile, responses, review, runs
from .plans import inbox, stages
from .queries import ACTIONS, EVIDENCE, FILES, KIND, LIVE, LOG, MAP_REASON, MAPPED, NAMES, NORM, NORM_C, PATHS, REPORT, SESSIONS, UNITS, K, _report, _sides, query, save
from .sources import readers

# --- naming: rows that get a name, keep their key, or clash
CLASHED = f"SELECT id, property_id, floor, raw || tail AS canonical_key, CASE WHEN id % 11 = 0 THEN 'DOAS' ELSE raw END AS equipment_type, CASE WHEN id % 17 = 0 THEN 'floor_ambiguous' WHEN id % 3 = 0 THEN 'matched' ELSE 'topics_only' END AS discrepancy_category, id % 3 <> 0 AS review_required, CASE WHEN id % 3 <> 0 THEN 'absent' ELSE '' END AS review_reason FROM ({UNITS})"


@query(f"""WITH {NAMES}, x AS (SELECT c.*, f.name AS made, f.reason AS why, {MAPPED('equipment_type')} AS mapped, {MAP_REASON('equipment_type')} AS kind_why, split_part(canonical_key, '_', 1) AS prefix FROM ({CLASHED}) c JOIN final f ON f.id = c.id),
y AS (SELECT *, discrepancy_category = 'floor_ambiguous' AS contested, prefix <> equipment_type AS misread FROM x),
z AS (SELECT *, CASE WHEN contested OR misread THEN canonical_key ELSE made END AS name, review_required OR contested OR misread OR kind_why <> '' OR why <> '' AS flag,
  concat_ws('; ', nullif(review_reason, ''), nullif(kind_why, ''), CASE WHEN contested THEN '{reconcile.HELD}' WHEN misread THEN 'label prefix ''' || prefix || ''' does not match inferred type ''' || equipment_type || ''' (possible misread); preserved as key' ELSE nullif(why, '') END) AS reason FROM y),
w AS (SELECT *, count(*) OVER (PARTITION BY property_id, floor, name) > 1 AS twice FROM z)
SELECT id, mapped AS equipment_type, CASE WHEN twice THEN canonical_key ELSE name END AS canonical_name, flag OR twice AS review_required, concat_ws('; ', nullif(reason, ''), CASE WHEN twice THEN '{reconcile.COLLISION}' END) AS review_reason FROM w""")
def canonical_rows(t):
    return reconcile.canonicalize(t(CLASHED)).select("id", "equipment_type", "canonical_name", "review_required", "review_reason")


# --- edges: both ends named, with what is doubtful of either
ENDS = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'OAVAV 02 ' || user_id WHEN 1 THEN 'AHU-2-' || user_id WHEN 2 THEN 'FCU 3 ' || user_id WHEN 3 THEN 'VAVRH_2_' || user_id ELSE 'pump ' || user_id END AS child_raw, CASE event_id % 3 WHEN 0 THEN 'DOAS_22_' || (user_id % 5) WHEN 1 THEN 'CHW-PLANT 1' ELSE 'AHU_' || (user_id % 40) END AS parent_raw, 'airRef' AS ref_type, 'primary_air' AS link_kind, CASE WHEN event_id % 4 = 0 THEN 0.55 ELSE 0.9 END AS confidence, 'd' || event_id AS source_drawing, 'k' AS evidence_kind, event_id % 7 = 0 AS conflict, '' AS conflict_reason, CASE WHEN event_id % 6 = 0 THEN 'seen' ELSE '' END AS notes FROM events"


@query(f"""WITH e AS ({ENDS}), labels AS (SELECT DISTINCT unnest([child_raw, parent_raw]) AS label FROM e), named AS (SELECT label AS id, '' AS property_id, '' AS floor, {K('label')} AS key,
  CASE WHEN starts_with(label, 'OAVAV') THEN 'OAVAV' WHEN starts_with(label, 'AHU') THEN 'AHU' WHEN starts_with(label, 'FCU') THEN 'FCU' WHEN starts_with(label, 'VAVRH') THEN 'VAVRH' ELSE 'UNRESOLVED' END AS raw, '2' AS fd, string_split({K('label')}, '_')[2:] AS us FROM labels),
{NAMES.split(chr(10), 1)[1]},
n AS (SELECT f.id, CASE WHEN kept THEN replace(f.id, ' ', '_') ELSE name END AS name, CASE WHEN kept THEN '' ELSE concat_ws('; ', nullif(reason, ''), nullif({MAP_REASON('raw')}, '')) END AS reason
  FROM (SELECT *, starts_with(id, 'DOAS') OR starts_with(id, 'CHW') AS kept FROM final) f JOIN named USING (id))
SELECT e.source_drawing, c.name AS child, p.name AS parent, confidence < 0.75 OR conflict OR c.reason <> '' OR p.reason <> '' AS review_required, concat_ws('; ', nullif(c.reason, ''), nullif(p.reason, ''), nullif(notes, '')) AS review_reason FROM e JOIN n c ON c.id = child_raw JOIN n p ON p.id = parent_raw""")
def edge_ends(t):
    return graph.edges_from(t(ENDS).drop("id")).select("source_drawing", "child", "parent", "review_required", "review_reason")


@query(f"""WITH e AS (SELECT CASE id % 3 WHEN 0 THEN 'DOAS_22_' || (id % 9) WHEN 1 THEN 'AHU_2-01' ELSE 'HW-PLANT_' || (id % 4) END AS parent, CASE WHEN id % 50 = 0 THEN 'DOAS_22_3' ELSE 'VAV_2-' || id END AS child FROM (SELECT event_id AS id FROM events))
SELECT DISTINCT parent AS name FROM e WHERE (parent LIKE 'DOAS%' OR parent LIKE 'HW-PLANT%') AND parent NOT IN (SELECT child FROM e)""")
def own_parents(t):
    e = t("SELECT CASE event_id % 3 WHEN 0 THEN 'DOAS_22_' || (event_id % 9) WHEN 1 THEN 'AHU_2-01' ELSE 'HW-PLANT_' || (event_id % 4) END AS parent, CASE WHEN event_id % 50 = 0 THEN 'DOAS_22_3' ELSE 'VAV_2-' || event_id END AS child FROM events")
    return graph.candidates(e)


SILENT = f"SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN 'no_oa_link' WHEN seq % 5 = 1 THEN 'no_ahu_link' ELSE evidence_kind END AS evidence_kind, CASE WHEN seq % 2 = 0 THEN 'asked ' || seq ELSE '' END AS detail) FROM ({EVIDENCE})"


@query(f"SELECT page_title AS item, coalesce(nullif(detail, ''), '{graph.NO_LINK_QUESTION}') AS question, source_image AS source, count(*) AS n FROM ({SILENT}) WHERE evidence_kind IN ('no_oa_link', 'no_ahu_link') GROUP BY ALL")
def no_link_notes(t):
    d = t(EVIDENCE).withColumn("evidence_kind", F.when(F.expr("seq % 5 = 0"), "no_oa_link").when(F.expr("seq % 5 = 1"), "no_ahu_link").otherwise(F.col("evidence_kind")))
    d = d.withColumn("detail", F.when(F.expr("seq % 2 = 0"), F.concat(F.lit("asked "), "seq")).otherwise(""))
    return graph.review_notes(d).groupBy("item", "question", "source").agg(F.count(F.lit(1)).alias("n"))


# --- responses to rows
PAGE = "SELECT event_id AS image, CASE WHEN event_id % 9 = 0 THEN 'sorry' ELSE '{\"equipment\": [{\"raw_label\": \"AHU 1\", \"canonical_name\": \"AHU_01\", \"equipment_type\": \"AHU\", \"confidence\": 0.' || (event_id % 10) || '}, {\"raw_label\": \"zone\", \"canonical_name\": \"AHU-1\", \"equipment_type\": \"AHU\", \"confidence\": 0.' || (event_id % 7) || '}, {\"raw_label\": \"FCU ' || (event_id % 3) || '\", \"canonical_name\": \"\", \"equipment_type\": \"FCU\", \"confidence\": 0.' || (event_id % 8) || '}]}' END AS raw_text FROM events"
BESTS = "SELECT event_id AS image, event_id % 10 AS a, event_id % 7 AS b, event_id % 8 AS c, event_id % 3 AS k FROM events WHERE event_id % 9 <> 0"


@query(f"""WITH r AS ({BESTS}), u AS (SELECT image, CASE WHEN a >= b THEN 'AHU 1' ELSE 'zone' END AS raw_label, CASE WHEN a >= b THEN 'AHU_01' ELSE 'AHU-1' END AS proposed, greatest(a, b) / 10.0 AS confidence, 0 AS first_seq FROM r UNION ALL SELECT image, 'FCU ' || k, '', c / 10.0, 2 FROM r)
SELECT image, raw_label, proposed, confidence::DOUBLE AS confidence, first_seq, confidence < 0.75 AS review_required, CASE WHEN confidence < 0.75 THEN '{responses.LOW_REASON}' ELSE '' END AS review_reason FROM u""")
def page_units(t):
    d = stages.runs_to_rows(t(PAGE))["rows"]
    return d.select("image", "raw_label", F.col("llm_proposed_canonical_name").alias("proposed"), "confidence", "first_seq", "review_required", "review_reason")


LINKS = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '[]' ELSE '{\"relationships\": [{\"child\": \"c' || user_id || '\", \"parent\": \"' || event_type || '\", \"ref_type\": \"airRef\", \"confidence\": 0.' || (event_id % 10) || ', \"conflict\": ' || CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END || '}]}' END AS raw_text FROM events"


@query("SELECT 'c' || user_id AS child, event_type AS parent, (event_id % 10 / 10.0)::DOUBLE AS confidence, event_id % 10 < 8 OR event_id % 4 = 0 AS review_required, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY ALL")
def relationship_rows(t):
    d = responses.relationship_document(responses.parsed(t(LINKS), responses.RELATIONSHIPS, "relationships"))
    return d.groupBy("child", "parent", "confidence", "review_required").agg(F.count(F.lit(1)).alias("n"))


SEEN = "SELECT l_suppkey AS image, 'AHU' || CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END || (l_partkey % 9) || CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE '' END AS canonical_name, l_quantity AS confidence, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS seq FROM lineitem"


@query(f"SELECT image, arg_min(canonical_name, struct_pack(a := -confidence, b := seq)) AS canonical_name, max(confidence) AS confidence FROM ({SEEN}) GROUP BY image, replace(canonical_name, ' ', '')")
def label_union(t):
    return responses.tile_union(t(SEEN)).select("image", "canonical_name", "confidence")


# --- bookkeeping of runs
@query("SELECT event_id, concat_ws('|', user_id::VARCHAR, event_type, 'flat') AS key, sha256('type' || chr(0) || strlen(event_type) || chr(0) || event_type || chr(0) || 'body' || chr(0) || strlen(coalesce(props, '')) || chr(0) || coalesce(props, '') || chr(0)) AS digest FROM events")
def run_keys(t):
    d = t("SELECT event_id, user_id, event_type, props FROM events")
    return d.select("event_id", L.checkpoint_key(F.col("user_id"), F.col("event_type"), F.lit("flat")).alias("key"), L.fingerprint(type=F.col("event_type"), body=F.col("props")).alias("digest"))


RECORDS = "SELECT p_partkey AS id, p_size * 100 AS width, p_size * 70 + p_partkey % 700 AS height FROM part"


@query(f"SELECT id, CASE WHEN width * height > 8000000 THEN 'drawing' ELSE 'flat' END AS route, CASE WHEN width * height > 8000000 THEN 'large' ELSE 'small' END AS model, 'flat' AS flat_route FROM ({RECORDS})")
def run_routes(t):
    d = t(RECORDS).withColumn("kind", L.image_class(F.col("width").cast("long") * F.col("height")))
    both = runs.routed(d, F.col("kind")), runs.routed(d, F.col("kind"), flat=True).select("id", F.col("route").alias("flat_route"))
    return both[0].select("id", "route", "model").join(both[1], "id")


@query(f"""WITH r AS (SELECT CASE event_id % 4 WHEN 0 THEN 'parse_failed' ELSE 'succeeded' END AS run_status, value / 100 AS confidence FROM events), s AS (SELECT key, arg_max(status, seq) AS status FROM ({LOG}) GROUP BY key),
o AS (SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 THEN 'drawing' ELSE 'flat' END AS route FROM customer), j AS (SELECT o.*, s.key IS NOT NULL AS done FROM o LEFT JOIN s ON s.key = o.key AND s.status = 'succeeded')
SELECT count(*) AS images_total, count(*) FILTER (run_status = 'succeeded') AS images_succeeded, count(*) FILTER (run_status <> 'succeeded') AS images_incomplete, (SELECT count(*) FROM j WHERE done) AS images_reused_from_checkpoint, (SELECT count(*) FROM j WHERE NOT done) AS images_run,
  (SELECT count(*) FROM j WHERE route = 'drawing') AS images_routed_to_tiling, (SELECT count(*) FROM j WHERE route = 'flat') AS images_routed_flat, count(*) AS equipment_candidates_total, count(*) FILTER (confidence >= 0.75) AS equipment_candidates_confident, count(*) FILTER (NOT coalesce(confidence >= 0.75, false)) AS equipment_candidates_review_required FROM r""")
def run_outcome(t):
    r = t("SELECT CASE event_id % 4 WHEN 0 THEN 'parse_failed' ELSE 'succeeded' END AS run_status, value / 100 AS confidence FROM events")
    routes = t("SELECT cast(c_custkey AS string) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'drawing' ELSE 'flat' END AS route FROM customer")
    return runs.outcome(r, routes, r, t(LOG))


SPENT = "SELECT CASE WHEN l_linenumber = 4 THEN 'errored' ELSE 'succeeded' END AS status, l_partkey AS input_tokens, l_suppkey AS output_tokens, l_linenumber AS cache_read_input_tokens, 0 AS cache_creation_input_tokens FROM lineitem"


@query(f"SELECT count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status <> 'succeeded') AS errored, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_input_tokens)::BIGINT AS cache_read_input_tokens, 0::BIGINT AS cache_creation_input_tokens, round(((sum(input_tokens) + 0.1::DOUBLE * sum(cache_read_input_tokens)) * 3 + sum(output_tokens) * 15) / 1e6 * 0.5::DOUBLE, 6) AS cost FROM ({SPENT})")
def item_costs(t):
    return runs.item_summary(t(SPENT), 3.0, 15.0)


@query("SELECT l_linenumber AS line, sum(CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 ELSE 0 END)::BIGINT AS tokens FROM lineitem GROUP BY 1")
def usage_fields(t):
    d = t("SELECT l_linenumber AS line, l_partkey % 3 AS prompt_tokens, CASE WHEN l_suppkey % 5 = 4 THEN 4 ELSE l_suppkey % 5 END AS input_tokens FROM lineitem")
    return d.groupBy("line").agg(F.sum(runs.first_nonzero(F.col("prompt_tokens"), F.col("input_tokens"))).cast("long").alias("tokens"))


@query(f"WITH {NORM} SELECT count(*) AS units, count(*) FILTER (status = 'settled') AS settled, count(*) FILTER (review_required) AS flagged, 0::BIGINT AS refs_filled FROM normalized")
def stage_counters(t):
    return reconcile.stage_counts(_sides(t))


LIBRARY = "SELECT CASE p_partkey % 5 WHEN 0 THEN 'AHU' WHEN 1 THEN 'ERV' WHEN 2 THEN 'VAV-RH-' || CASE WHEN p_size % 2 = 0 THEN 'HW' ELSE 'ELEC' END WHEN 3 THEN 'HEATER-' || (p_size % 3) ELSE 'chiller' END AS type FROM part"
KNOWN = ", ".join(f"('{x}')" for x in V.LIBRARY_TYPES)


@query(f"WITH l AS ({LIBRARY}), k(type) AS (VALUES {KNOWN}) SELECT type, 'vocabulary' AS missing_from FROM (SELECT type FROM l EXCEPT SELECT type FROM k) UNION ALL SELECT type, 'library' FROM (SELECT type FROM k EXCEPT SELECT type FROM l)")
def library_gaps(t):
    return V.library_gaps(t(LIBRARY))


# --- topics: grouped, covered, checked
@query(f"""WITH n AS ({PATHS}), c AS (SELECT *, split_part(topic_name, '/', 2) AS ctx FROM n WHERE topic_name LIKE 'Floor%'), kept AS (SELECT * FROM c WHERE ctx NOT LIKE 'DEV5%')
SELECT 'unit' AS part, property_id, floor, regexp_replace(ctx, '^DEV[0-9]+_', '') || ' of ' || ctx AS name, count(*) AS n, CASE WHEN NOT contains(regexp_replace(ctx, '^DEV[0-9]+_', ''), 'AHU') THEN 'flagged' ELSE '' END AS told FROM kept GROUP BY property_id, floor, ctx
UNION ALL SELECT 'coverage', property_id, floor, topic_name, count(*), 'missing' FROM n WHERE topic_name = 'lost/path' OR split_part(topic_name, '/', 2) LIKE 'DEV5%' GROUP BY property_id, floor, topic_name""")
def topic_groups(t):
    def parse(names):
        d = names.withColumn("ctx", L.path_context(F.col("topic_name"), F.col("floor"))).where("ctx NOT LIKE 'DEV5%'")
        d = d.groupBy("property_id", "floor", "ctx").agg(F.collect_list("topic_name").alias("source_topics"))
        return d.withColumn("raw_label", F.col("ctx")).withColumns({"equipment_type": F.lit("AHU"), "review_required": F.lit(False), "review_reason": F.lit("")})

    out = stages.topics_to_units(t(PATHS), parse, strict=False, save=save)
    label = F.concat(L.strip_device_prefix(F.col("ctx"), any_case=False), F.lit(" of "), "ctx")
    u = out["units"].select(F.lit("unit").alias("part"), "property_id", "floor", label.alias("name"), F.size("source_topics").cast("long").alias("n"), F.when(F.col("review_required"), "flagged").otherwise("").alias("told"))
    return u.unionByName(out["coverage"].select(F.lit("coverage").alias("part"), "property_id", "floor", F.col("topic_name").alias("name"), "n", F.col("kind").alias("told")))


@query("SELECT 'once' AS list, trim(c_mktsegment) AS name, min(c_custkey) AS n FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 2 UNION ALL SELECT 'each', trim(c_mktsegment), count(*) FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 2")
def listed_names(t):
    d = t("SELECT CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS label, c_custkey AS seq FROM customer UNION ALL SELECT ' ' AS label, o_orderkey AS seq FROM orders")
    once = readers.names(d, "label").select(F.lit("once").alias("list"), "name", F.col("seq").cast("long").alias("n"))
    return once.unionByName(readers.topic_names(d, "label").groupBy(F.col("topic_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("each").alias("list"), "name", "n"))


# --- the review inbox
INBOX = "SELECT 'p' || (s_suppkey % 2) AS property_id, 'Floor_02' AS floor, 'AHU 0' || s_suppkey AS canonical_name, CASE WHEN s_suppkey % 3 = 0 THEN 'OWN_' || s_suppkey ELSE '' END AS canonical_key, CASE s_suppkey % 4 WHEN 0 THEN ' ; ' WHEN 1 THEN 'a.png; b.png ;' ELSE 'c.png' END AS source_files FROM supplier"
SHOWN = "SELECT 'p' || (l_suppkey % 2) AS property_id, 'Floor_02' AS floor, CASE WHEN l_suppkey % 3 = 0 THEN 'OWN_' ELSE 'AHU_' END || l_suppkey AS key, 'f' || (l_partkey % 3) AS source, l_orderkey || '/' || l_linenumber AS detail FROM lineitem"


@query(f"""WITH u AS (SELECT *, coalesce(nullif(canonical_key, ''), {K('canonical_name')}) AS k FROM ({INBOX})), e AS (SELECT property_id, key, count(*) AS n, string_agg(source || ':' || detail, ',' ORDER BY source, detail) AS every FROM ({SHOWN}) GROUP BY ALL)
SELECT u.property_id, canonical_name, array_to_string(list_filter(list_transform(string_split(source_files, ';'), lambda x: trim(x)), lambda x: x <> ''), ',') AS files, coalesce(n, 0) AS n_evidence, coalesce(every, '') AS evidence FROM u LEFT JOIN e ON e.property_id = u.property_id AND e.key = k""")
def inbox_equipment(t):
    d = inbox.equipment(inbox.keyed_units(t(INBOX)), inbox.evidence_by_key(t(SHOWN)))
    shown = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["source"], x["detail"])), ",")
    return d.select("property_id", "canonical_name", F.array_join("files", ",").alias("files"), "n_evidence", shown.alias("evidence"))


@query(f"WITH {NORM_C}, {REPORT}, gp AS (SELECT *, status = '{inbox.CONTESTED}' AS hit FROM report), ru AS (SELECT building, equipment_id, min(length(equipment_id) % 5)::VARCHAR AS f FROM report WHERE equipment_id LIKE '%7%' GROUP BY ALL) SELECT gp.building, gp.floor, gp.equipment_id, CASE WHEN hit THEN '{inbox.RESOLVED}' ELSE status END AS status, CASE WHEN hit THEN coalesce(f, '1') END AS resolved_floor FROM gp LEFT JOIN ru USING (building, equipment_id)")
def inbox_gaps(t):
    report = save(_report(t))
    rulings = report.where("equipment_id LIKE '%7%'").select("building", "equipment_id", (F.length("equipment_id") % 5).cast("string").alias("resolved_floor"))
    return inbox.gaps(report, rulings).select("building", "floor", "equipment_id", "status", "resolved_floor")


LINKED = "SELECT 'p' || (l_suppkey % 7) AS property_id, 'Floor_0' || (l_suppkey % 4) AS floor, 'c' || l_partkey AS child, 'airRef' AS ref_type, 'q' || l_suppkey AS parent FROM lineitem"
TOLD = "SELECT 'p' || (o_custkey % 9) AS property_id, 'Floor_0' || (o_custkey % 4) AS floor, 'x' AS check_id, CASE WHEN o_custkey % 9 < 3 THEN 'review' WHEN o_orderkey % 5 = 0 THEN 'orphan' ELSE 'error' END AS severity, 'm' || o_orderkey AS message FROM orders"
APPLIED = "SELECT 'p' || (l_suppkey % 7) AS property_id, 'Floor_0' || (l_suppkey % 4) AS floor, 'relationship' AS item_type, 'c' || l_partkey || '|airRef|q' || l_suppkey AS item_key FROM lineitem WHERE l_linenumber = 1"


@query(f"""WITH e AS (SELECT property_id, floor, count(*) AS edges FROM ({LINKED}) GROUP BY ALL), f AS (SELECT property_id, floor, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'orphan') AS orphans, count(*) FILTER (severity = 'review') AS review_items FROM ({TOLD}) GROUP BY ALL)
SELECT property_id, floor, coalesce(edges, 0) AS edges, coalesce(errors, 0) AS errors, coalesce(orphans, 0) AS orphans, coalesce(review_items, 0) AS review_items, coalesce(errors, 0) + coalesce(orphans, 0) = 0 AS passed FROM e FULL JOIN f USING (property_id, floor)""")
def inbox_relationships(t):
    return inbox.relationships(t(LINKED), t(TOLD))["summary"]


@query(f"""WITH a AS ({APPLIED}), k AS (SELECT DISTINCT property_id, floor, 'relationship' AS item_type, child || '|' || ref_type || '|' || parent AS item_key FROM ({LINKED}) UNION SELECT property_id, floor, 'equipment', canonical_name FROM ({INBOX}))
SELECT property_id, floor, item_type, count(*) AS n, min(item_key) AS least FROM k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.property_id = k.property_id AND a.floor = k.floor AND a.item_type = k.item_type AND a.item_key = k.item_key) GROUP BY ALL""")
def inbox_pending(t):
    edges = inbox.relationships(t(LINKED), t(TOLD))["edges"]
    return inbox.pending(t(INBOX), edges, t(APPLIED)).groupBy("property_id", "floor", "item_type").agg(F.count(F.lit(1)).alias("n"), F.min("item_key").alias("least"))


REVIEWABLE = "SELECT DISTINCT 's' || (user_id % 20) AS session_id, 'equipment' AS item_type, cast(user_id AS string) AS item_key FROM events WHERE user_id % 3 <> 0"


@query(f"WITH {LIVE} SELECT k.session_id, count(*) AS total, count(*) FILTER (action IN ('approve', 'edit')) AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action IS NULL) AS \"left\" FROM ({REVIEWABLE}) k LEFT JOIN live USING (session_id, item_type, item_key) GROUP BY 1")
def session_progress(t):
    return inbox.progress(review.live_actions(t(ACTIONS)), t(REVIEWABLE))


@query(f"WITH {LIVE}, n AS (SELECT session_id, count(*) FILTER (action IN ('approve', 'edit')) AS a, count(*) FILTER (action = 'reject') AS r FROM live GROUP BY 1) SELECT s.session_id, s.floor, s.property_id, coalesce(a, 0) AS n_approved, coalesce(r, 0) AS n_rejected, greatest(5 - coalesce(a, 0) - coalesce(r, 0), 0) AS n_pending FROM ({SESSIONS}) s LEFT JOIN n USING (session_id)")
def session_list(t):
    s = t(f"SELECT session_id, property_id, floor, 'open' AS status, 'x' AS created_by, -cast(substr(session_id, 2) AS int) AS created_at, 5 AS n_open FROM ({SESSIONS})")
    d = inbox.sessions_list(s, t(ACTIONS).withColumn("source_item", F.lit(None).cast("string")))
    return d.select("session_id", "floor", "property_id", "n_approved", "n_rejected", "n_pending")


STYLED = "SELECT '{s}' AS style, floor, equipment_type, status, count(*) AS n FROM report WHERE {w} GROUP BY ALL"


@query(f"WITH {NORM_C}, {REPORT} {STYLED.format(s='high', w=chr(39).join(['severity_hint = ', 'high', '']))} UNION ALL {STYLED.format(s='all', w=chr(39).join(['status <> ', 'matched', '']))}")
def headlines(t):
    report = save(_report(t))
    both = [review.headlines(report, s).select(F.lit(s).alias("style"), "floor", "equipment_type", "status", "n") for s in ("high", "all")]
    return both[0].unionByName(both[1])


# --- files
@query(f"""WITH f AS (SELECT p.path AS relative_path, {KIND} AS file_type, page_id % 5 * 700 AS width, page_id % 3 * 600 AS height FROM ({FILES}) p), k AS (SELECT *, CASE WHEN relative_path NOT LIKE '../%' THEN 'raw/' || file_type || '/' || relative_path END AS object_key FROM f), n AS (SELECT *, count(object_key) OVER (PARTITION BY object_key) AS n FROM k)
SELECT relative_path, CASE WHEN file_type = 'pdf' THEN 'deferred' WHEN file_type NOT IN ('png', 'jpeg') THEN 'unsupported' WHEN greatest(width, height) >= 1000 AND least(width, height) >= 750 THEN 'prepared' ELSE 'failures' END AS kind,
  CASE WHEN object_key IS NULL THEN 'rejected' WHEN file_type = 'unsupported' THEN 'skipped' WHEN n > 1 THEN 'duplicate' WHEN contains(object_key, '7') THEN 'conflict' ELSE 'planned' END AS plan_status, count(*) AS n FROM n GROUP BY ALL""")
def prepared_files(t):
    """Every page as a file of some size: the quality gate and the plan of its copy."""
    f = t(FILES).select(F.col("path").alias("relative_path"), L.file_type(F.col("path")).alias("file_type"), F.expr("page_id % 5 * 700 AS width"), F.expr("page_id % 3 * 600 AS height"))
    have = f.select(L.object_key("raw", F.col("file_type"), F.col("relative_path")).alias("key")).where("contains(key, '7')")
    plan = images.preservation_plan(f.select("relative_path", "file_type"), have, "raw").dropDuplicates(["relative_path"])
    each = [d.select("relative_path", F.lit(kind).alias("kind"), "plan_status") for kind, d in images.prepared(images.with_plan(f, plan)).items()]
    d = each[0]
    for e in each[1:]:
        d = d.unionByName(e)
    return d.groupBy("relative_path", "kind", "plan_status").agg(F.count(F.lit(1)).alias("n"))


PARTS = "SELECT l_orderkey AS relative_path, l_discount < 0.1 AS quality_flag, l_tax / 10 AS ink_fraction FROM lineitem WHERE l_linenumber > 1"


@query(f"SELECT relative_path, bool_and(quality_flag) AS quality_flag, count(*) FILTER (ink_fraction >= 0.0015) AS inked FROM ({PARTS}) GROUP BY 1 HAVING count(*) FILTER (ink_fraction >= 0.0015) > 0")
def page_quality(t):
    d = t(PARTS)
    return images.file_quality(d).join(images.inked(d).groupBy("relative_path").agg(F.count(F.lit(1)).alias("inked")), "relative_path")


# --- sessions whose decisions clash
CLASH_MASTER = "SELECT s_suppkey AS equipment_id, 'p' AS property_id, 'AHU_2-' || s_suppkey AS name, '2' AS floorRef, cast(NULL AS string) AS zone, cast(NULL AS string) AS spaceRef, cast(NULL AS bigint) AS airRef, cast(NULL AS bigint) AS chilledWaterRef, cast(NULL AS bigint) AS hotWaterRef, cast(NULL AS bigint) AS condenserWaterRef, cast(NULL AS bigint) AS systemRef FROM supplier"
CLASH_MASTER += " UNION ALL SELECT s_suppkey + 1000000, 'p', 'AHU_2-0' || s_suppkey, '2', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 0"
CLASH_ITEMS = "SELECT 'p' AS property_id, 'i' || s_suppkey AS item_key, 'AHU_2-' || s_suppkey AS canonical_name, 'AHU' AS equipment_type, 'Floor_02' AS floor FROM supplier WHERE s_suppkey % 7 <> 5"
CLASH_EVENTS = """SELECT 's' || (s_suppkey % 20) AS session_id, 'equipment' AS item_type, 'i' || s_suppkey AS item_key, CASE WHEN s_suppkey % 7 IN (1, 3, 4, 6) THEN 'edit' ELSE 'approve' END AS action,
  CASE s_suppkey % 7 WHEN 1 THEN '{"canonical_name": "AHU_2-' || (s_suppkey + 1) || '"}' WHEN 3 THEN '{"canonical_name": null}' WHEN 4 THEN '{"colour": "x"}' WHEN 6 THEN '{"floor": "roof"}' END AS payload, 'because' AS reason, cast(NULL AS string) AS reviewer, false AS applied, s_suppkey AS created_at, s_suppkey AS action_id FROM supplier"""
CLASH_SESSIONS = "SELECT DISTINCT 's' || (s_suppkey % 20) AS session_id, 'p' AS property_id, 'Floor_02' AS floor, 'open' AS status, 'boss' AS created_by FROM supplier"


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 AS w, s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS has FROM supplier)
SELECT 'i' || k AS item_key, 'no such item' AS problem FROM s WHERE w = 5 UNION ALL SELECT 'i' || k, 'canonical_name must be a non-empty string' FROM s WHERE w = 3 UNION ALL SELECT 'i' || k, 'unsupported edit field(s): colour' FROM s WHERE w = 4 UNION ALL SELECT 'i' || k, 'floor can''t be mapped' FROM s WHERE w = 6
UNION ALL SELECT 'i' || k, 'identity matches multiple equipment rows' FROM s WHERE w <> 5 AND (k % 10 = 0 OR (w = 1 AND has AND (k + 1) % 10 = 0)) UNION ALL SELECT 'i' || k, 'edited identity already belongs to another equipment row' FROM s WHERE w = 1 AND has
UNION ALL SELECT 'i' || k, 'several items map to one equipment row' FROM s WHERE (w = 1 AND has) OR (w = 2 AND k > 1)""")
def session_clashes(t):
    out = review.commit(t(CLASH_SESSIONS), t(CLASH_EVENTS), t(CLASH_ITEMS), t("SELECT 'p' AS property_id, 'none' AS item_key, 'a' AS child, 'b' AS parent, 'airRef' AS ref_type FROM region"), t(CLASH_MASTER), save=save)
    return out["problems"].select("item_key", "problem")
