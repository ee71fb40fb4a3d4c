"""Review inbox, sessions as an event log, and commits as keyed upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import floor_digits, strip
from ..functions.vocab import REF_TYPES, production_identity
from .picks import first_per_key, last_per_key
from .ranks import placed


def inbox(equipment: DataFrame, relationships: DataFrame, applied: DataFrame) -> DataFrame:
    """(item_type, item_key) still to decide: all of both kinds without those applied in any session of the scope."""
    every = equipment.select(F.lit("equipment").alias("item_type"), "item_key").unionByName(relationships.select(F.lit("relationship").alias("item_type"), "item_key")).distinct()
    return every.join(applied.select("item_type", "item_key").distinct(), ["item_type", "item_key"], "left_anti")


def applied_keys(actions: DataFrame, sessions: DataFrame, property_id: str, floor: str) -> DataFrame:
    scope = sessions.where((F.col("property_id") == property_id) & (F.col("floor") == floor)).select("session_id")
    return actions.where("applied").join(scope, "session_id", "left_semi").select("item_type", "item_key").distinct()


def live_actions(events: DataFrame) -> DataFrame:
    """The latest event for each (session, item); a cleared decision is no decision. Order: created_at, then action_id."""
    d = first_per_key(events, ["session_id", "item_type", "item_key"], F.desc("created_at"), F.desc("action_id"))
    return d.where("action <> 'clear'")


def session_counts(live: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """session_id, n_approved, n_rejected, n_pending (totals(session_id, n_total), never below 0)."""
    d = live.groupBy("session_id").agg(F.count_if(F.col("action").isin("approve", "edit")).alias("n_approved"), F.count_if(F.col("action") == "reject").alias("n_rejected"))
    if totals is None:
        return d
    j = totals.join(d, "session_id", "left").fillna(0, ["n_approved", "n_rejected"])
    return j.withColumn("n_pending", F.greatest(F.col("n_total") - F.col("n_approved") - F.col("n_rejected"), F.lit(0))).drop("n_total")


def committed_counts(actions: DataFrame, corrections: DataFrame) -> DataFrame:
    a = actions.where("applied AND action <> 'reject'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_applied"))
    c = corrections.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_corrections"))
    return a.join(c, "session_id", "full_outer").fillna(0)


def evidence_attached(items: DataFrame, *evidence: DataFrame, key: str = "key") -> DataFrame:
    """items with the evidence rows (key, source, detail) of all sources, in order, and their number."""
    every = evidence[0]
    for e in evidence[1:]:
        every = every.unionByName(e)
    grouped = every.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("source", "detail"))).alias("evidence"))
    return items.join(grouped, key, "left").withColumn("n_evidence", F.coalesce(F.size("evidence"), F.lit(0)))


def upsert(master: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New version of master: given values of edits replace, others stay; keys that master lacks are added."""
    e = edits.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_edit"))
    j = master.withColumn("_old", F.lit(True)).join(e, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_edit"), "update").otherwise("keep")
    return j.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], change.alias("change"))


def identity_conflicts(master: DataFrame, items: DataFrame) -> DataFrame:
    """Items (item_key, name) whose identity meets several master rows, or one row that another item meets too."""
    m = master.select("property_id", F.col("name").alias("_m"), production_identity(F.col("name")).alias("identity"))
    i = items.select("property_id", "item_key", production_identity(F.col("name")).alias("identity"))
    n = i.join(m.groupBy("property_id", "identity").agg(F.count(F.lit(1)).alias("n_rows")), ["property_id", "identity"], "left").fillna(0, ["n_rows"])
    n = n.withColumn("n_items", F.count(F.lit(1)).over(Window.partitionBy("property_id", "identity")))
    return n.withColumn("conflict", F.when(F.col("n_rows") > 1, "several master rows").when((F.col("n_items") > 1), "several items for one unit")).where("conflict IS NOT NULL")


def refs_applied(master: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    """Ref columns of the child rows filled from approved edges (child, ref_type, parent_id, seq), the last one for a ref, by the scope columns
    that both frames have."""
    scope = [c for c in ("property_id", "floor") if c in edges.columns and c in master.columns]
    last = last_per_key(edges, [*scope, "child", "ref_type"])
    wide = last.groupBy(*scope, F.col("child").alias(key)).agg(*[F.max(F.when(F.col("ref_type") == r, F.col("parent_id"))).alias(f"_{r}") for r in REF_TYPES])
    out = master.join(wide, [*scope, key], "left")
    return out.withColumns({r: F.coalesce(f"_{r}", r) for r in REF_TYPES if r in master.columns}).drop(*[f"_{r}" for r in REF_TYPES])


def missing_endpoints(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ends of edges that are no name of their scope: (scope, seq, role, name)."""
    scope = [c for c in ("property_id", "floor") if c in edges.columns]
    met = [c for c in scope if c in names.columns]
    end = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("name"))
    ends = edges.select(*scope, "seq", F.explode(F.array(end("child"), end("parent"))).alias("e")).select(*scope, "seq", "e.*")
    return ends.join(names.select(*met, "name").distinct(), [*met, "name"], "left_anti")


def corrections(actions: DataFrame) -> DataFrame:
    """Rejected and edited decisions as original and corrected JSON, by their item."""
    d = actions.where(F.col("action").isin("reject", "edit"))
    return d.select("session_id", "item_type", "item_key", F.col("source_item").alias("original"), F.when(F.col("action") == "edit", F.col("payload")).alias("corrected"), "reason")


def outbox(corrections: DataFrame, pool: DataFrame, key: str = "correction_id") -> DataFrame:
    return corrections.join(pool.select(key).distinct(), key, "left_anti")


def overlay(items: DataFrame, payload: Column, fields: list[str]) -> DataFrame:
    """Fields of a JSON payload over the item's own; ``unknown`` lists keys that aren't editable, ``blank`` that a value is."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    given = {f: F.get_json_object(payload, f"$.{f}") for f in fields}
    blank = F.lit(False)
    for f in fields:
        blank = blank | (F.array_contains(keys, f) & (F.trim(F.coalesce(given[f], F.lit(""))) == ""))
    return items.withColumns({**{f: F.coalesce(given[f], F.col(f)) for f in fields}, "unknown": F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)))), ","), "blank": blank})


def opened(requests: DataFrame, keys: DataFrame, applied: DataFrame) -> DataFrame:
    """Sessions for requests(session_id, property_id, floor, created_by): open, with the number of items of their scope that are still
    to decide. keys and applied: (property_id, floor, item_type, item_key)."""
    left = keys.distinct().join(applied.distinct(), ["property_id", "floor", "item_type", "item_key"], "left_anti")
    n = left.groupBy("property_id", "floor").agg(F.count(F.lit(1)).alias("n_open"))
    return requests.join(n, ["property_id", "floor"], "left").select(
        "session_id", "property_id", "floor", F.lit("open").alias("status"), "created_by", F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open")
    )


ITEM = ["session_id", "item_type", "item_key"]


def recorded(events: DataFrame, new: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new events to append, those refused with their rule): sessions have to be open, applied decisions are frozen."""
    frozen = live_actions(events).where("applied").select(*ITEM, F.lit(True).alias("_frozen"))
    open_ = sessions.where("status = 'open'").select("session_id", F.lit(True).alias("_open"))
    rule = F.when(F.col("_open").isNull(), "session is not open").when(F.col("_frozen"), "action is already applied and frozen")
    d = new.join(open_, "session_id", "left").join(frozen, ITEM, "left").withColumn("rule", rule).drop("_open", "_frozen")
    return d.where("rule IS NULL").drop("rule").select(new.columns), d.where("rule IS NOT NULL")


def cleared(
    events: DataFrame, session_id: str, at, action_id: str, item_type: str | None = None, item_key: str | None = None, *, sessions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(events that clear one undecided item of a session, or all of them; what is refused with its rule). The session has to be open; one
    item that is applied already is refused, and clearing all leaves applied ones as they are. ``at`` is their created_at."""
    d = live_actions(events).where(F.col("session_id") == session_id)
    if item_key is not None:
        d = d.where((F.col("item_type") == item_type) & (F.col("item_key") == item_key.strip()))
    open_ = sessions.where("status = 'open'").select("session_id", F.lit(True).alias("_open"))
    frozen = F.coalesce("applied", F.lit(False))
    rule = F.when(F.col("_open").isNull(), "session is not open").when(frozen, "action is already applied and frozen")
    d = d.join(open_, "session_id", "left").withColumn("rule", rule).drop("_open")
    kind = events.schema["action_id"].dataType.simpleString()
    named = F.concat(F.lit(action_id), F.lit(":"), F.col("item_type"), F.lit(":"), F.col("item_key")) if kind == "string" else F.lit(action_id).cast(kind)
    clear = d.where("rule IS NULL").withColumns({"action": F.lit("clear"), "created_at": F.lit(at).cast(events.schema["created_at"].dataType), "action_id": named})
    refused = d.where("rule IS NOT NULL")
    if item_key is None:
        refused = refused.where("rule = 'session is not open'")
    return clear.select(events.columns), refused.select(*events.columns, "rule")


def session_state(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """sessions(session_id, n_open) with their counts; an engineer's own proposal (a live action with a source_item) is one item more."""
    live = live_actions(events)
    extra = live.where("source_item IS NOT NULL AND item_type = 'relationship'").groupBy("session_id").agg(F.count(F.lit(1)).alias("_extra"))
    totals = sessions.join(extra, "session_id", "left").select("session_id", (F.col("n_open") + F.coalesce("_extra", F.lit(0))).alias("n_total"))
    return session_counts(live, totals)


CORRECTION_FIELDS = ("raw_label", "canonical_name", "equipment_type", "topics_raw_label", "drawing_raw_label")
EQUIPMENT_FIELDS = ("canonical_name", "equipment_type", "floor", "zone", "space_ref")
EDGE_FIELDS = ("child", "parent", "ref_type")
MASTER_REFS = ("airRef", "chilledWaterRef", "hotWaterRef", "condenserWaterRef", "systemRef")


def safe_fields(document: Column) -> Column:
    """The correction fields of a JSON object that hold a scalar and aren't blank, trimmed, as JSON; nothing else passes."""
    pairs = []
    for f in CORRECTION_FIELDS:
        raw = F.get_json_object(document, f"$.{f}")
        value = F.nullif(strip(raw), F.lit(""))
        pairs.append(F.when(~F.coalesce(value, F.lit("{")).rlike(r"^[\[{]"), value).alias(f))
    return F.to_json(F.struct(*pairs))


def _values(d: DataFrame, fields, required) -> DataFrame:
    """Items with the fields of their payload laid over; ``problem`` names unknown fields, and required ones that the payload gives as
    anything but a text, or that are blank."""
    o = overlay(d, F.col("payload"), list(fields))
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), f"$.{f}", "variant"))
    wrong = lambda f: F.array_contains(keys, f) & (F.coalesce(kind(f), F.lit("VOID")) != "STRING")
    blank = F.concat_ws(", ", *[F.when(wrong(f) | (F.coalesce(strip(F.col(f)), F.lit("")) == ""), F.lit(f)) for f in required])
    problem = F.when(F.col("unknown") != "", F.concat(F.lit("unsupported edit field(s): "), F.col("unknown"))).when(blank != "", F.concat(blank, F.lit(" must be a non-empty string")))
    return o.withColumn("problem", problem).withColumns({f: strip(F.col(f)) for f in required}).drop("unknown", "blank")


def _yes() -> Column:
    return F.col("action").isin("approve", "edit")


def _changed() -> Column:
    return F.col("action").isin("reject", "edit")


def _problem(d: DataFrame, why: str) -> DataFrame:
    return d.select(*ITEM, F.lit(why).alias("problem"))


def _decided(live: DataFrame, events: DataFrame, sessions: DataFrame) -> list[DataFrame]:
    """Problems of decisions as such: made before, without a reason, on an unknown kind of item."""
    done = live_actions(events).where("applied").join(sessions.select("session_id", "property_id", F.col("floor").alias("_floor")), "session_id")
    done = done.select("property_id", "_floor", "item_type", "item_key").distinct()
    return [
        _problem(live.join(done, ["property_id", "_floor", "item_type", "item_key"], "left_semi"), "decided in an earlier commit"),
        _problem(live.where(_changed() & (F.coalesce(strip(F.col("reason")), F.lit("")) == "")), "no reason given"),
        _problem(live.where(~F.col("item_type").isin("equipment", "relationship")), "unsupported item type"),
    ]


def _identities(master: DataFrame) -> DataFrame:
    """(property_id, identity, id, n): the first master row of each production identity, and how many there are."""
    known = master.select("property_id", "equipment_id", production_identity(F.col("name")).alias("identity"))
    return known.groupBy("property_id", "identity").agg(F.min("equipment_id").alias("id"), F.count(F.lit(1)).alias("n"))


def _equipment(live: DataFrame, items: DataFrame, per: DataFrame, save) -> tuple[DataFrame, list[DataFrame]]:
    """Decided equipment with its values and the master row it falls on, by the edited name first, then by the item's own; its problems."""
    extra = {"zone": F.lit(None).cast("string"), "space_ref": F.lit(None).cast("string"), "_item": F.lit(True)}
    e = live.where("item_type = 'equipment'").join(items.withColumns(extra), ["property_id", "item_key"], "left")
    bad = [_problem(e.where("_item IS NULL"), "no such item")]
    e = e.where("_item").withColumn("original", F.to_json(F.struct("canonical_name", "equipment_type", "floor"))).withColumn("_was", F.col("canonical_name"))
    e = _values(e, EQUIPMENT_FIELDS, EQUIPMENT_FIELDS[:3])
    was = F.when(F.col("_was") != F.col("canonical_name"), production_identity(F.col("_was")))
    e = e.withColumn("identity", production_identity(F.col("canonical_name"))).withColumn("was", was)
    e = e.withColumn("floor_ref", F.when(~F.upper("equipment_type").endswith("-PLANT"), floor_digits(F.col("floor"))))
    at = lambda c, tag: per.select("property_id", F.col("identity").alias(c), F.col("id").alias(f"{tag}_id"), F.col("n").alias(f"{tag}_n"))
    e = e.join(at("identity", "now"), ["property_id", "identity"], "left").join(at("was", "old"), ["property_id", "was"], "left")
    made = F.xxhash64("property_id", "identity").bitwiseAND(F.lit(2**63 - 1))
    e = save(e.withColumn("equipment_id", F.coalesce("now_id", "old_id", made)))
    go = e.where(_yes())
    twice = go.groupBy("property_id", "equipment_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return e, bad + [
        go.where("problem IS NOT NULL").select(*ITEM, "problem"),
        _problem(go.where("floor_ref IS NULL AND NOT upper(equipment_type) LIKE '%-PLANT'"), "floor can't be mapped"),
        _problem(go.where("now_n > 1 OR old_n > 1"), "identity matches multiple equipment rows"),
        _problem(go.where("now_id <> old_id"), "edited identity already belongs to another equipment row"),
        _problem(go.join(twice, ["property_id", "equipment_id"], "left_semi"), "several items map to one equipment row"),
    ]


def _references(live: DataFrame, edges: DataFrame, go: DataFrame, per: DataFrame, save) -> tuple[DataFrame, list[DataFrame]]:
    """Decided references with the rows of their ends, and their problems. An end stands in the session's own equipment, else in the
    master under a name that the session didn't change."""
    r = live.where("item_type = 'relationship'").join(edges.withColumn("_item", F.lit(True)), ["property_id", "item_key"], "left")
    bad = [_problem(r.where("_item IS NULL"), "no such item")]
    r = _values(r.where("_item").withColumn("original", F.to_json(F.struct(*EDGE_FIELDS))), EDGE_FIELDS, EDGE_FIELDS)
    landed = go.select("session_id", "identity", F.col("equipment_id").alias("own_id"))
    renamed = go.where("now_id IS NULL AND old_id IS NOT NULL").select(F.col("session_id").alias("gone_session"), F.col("old_id").alias("gone_id"))
    for end in ("child", "parent"):
        r = r.withColumn("identity", production_identity(F.col(end))).join(landed, ["session_id", "identity"], "left")
        r = r.join(per.withColumnRenamed("n", "_n"), ["property_id", "identity"], "left")
        r = r.join(renamed, (F.col("session_id") == F.col("gone_session")) & (F.col("id") == F.col("gone_id")), "left")
        known = F.when(F.col("gone_id").isNull() & (F.col("_n") == 1), F.col("id"))
        r = r.withColumn(f"{end}_id", F.coalesce("own_id", known)).drop("identity", "own_id", "id", "_n", "gone_session", "gone_id")
    r = save(r)
    ref = r.where(_yes())
    return r, bad + [
        ref.where("problem IS NOT NULL").select(*ITEM, "problem"),
        _problem(ref.where(~F.col("ref_type").isin(*MASTER_REFS)), "not an equipment-to-equipment production reference"),
        _problem(ref.where("child_id IS NULL OR parent_id IS NULL"), "relationship endpoint is absent from equipment_details"),
    ]


def _new_master(master: DataFrame, go: DataFrame, ref: DataFrame) -> DataFrame:
    """The master with equipment edited or added, then with references, the last decision on a child's reference first; ``change``."""
    edits = go.select(
        "equipment_id", F.col("property_id").alias("_property"), F.col("canonical_name").alias("_name"), F.col("floor_ref").alias("_floorRef"),
        F.col("zone").alias("_zone"), F.col("space_ref").alias("_space"), F.lit(True).alias("_edit"),
    )
    j = master.withColumn("_old", F.lit(True)).join(edits, "equipment_id", "full_outer")
    pick = lambda new, old: F.when(F.col("_edit"), F.col(new)).otherwise(F.col(old)).alias(old)
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_edit"), "update").otherwise("keep")
    new = j.select(
        "equipment_id", F.coalesce("property_id", "_property").alias("property_id"), pick("_name", "name"), pick("_floorRef", "floorRef"),
        pick("_zone", "zone"), pick("_space", "spaceRef"), *MASTER_REFS, change.alias("change"),
    )
    last = first_per_key(ref, ["child_id", "ref_type"], F.desc("created_at"), F.desc("action_id"))
    wide = last.groupBy(F.col("child_id").alias("equipment_id")).agg(*[F.max(F.when(F.col("ref_type") == c, F.col("parent_id"))).alias(f"_{c}") for c in MASTER_REFS])
    new = new.join(wide, "equipment_id", "left")
    touched = F.coalesce(*[F.col(f"_{c}") for c in MASTER_REFS]).isNotNull()
    new = new.withColumn("change", F.when((F.col("change") == "keep") & touched, "update").otherwise(F.col("change")))
    return new.withColumns({c: F.coalesce(f"_{c}", c) for c in MASTER_REFS}).drop(*[f"_{c}" for c in MASTER_REFS])


def commit(sessions: DataFrame, events: DataFrame, items: DataFrame, edges: DataFrame, master: DataFrame, *, save) -> dict[str, DataFrame]:
    """All outputs of committing the open sessions, as new tables; nothing is changed in place (``plans.ledger`` publishes them together).

    sessions(session_id, property_id, floor, status, created_by); events: the action log (session_id, item_type, item_key, action, payload,
    reason, reviewer, applied, created_at, action_id); items(property_id, item_key, canonical_name, equipment_type, floor); edges(property_id,
    item_key, child, parent, ref_type); master(equipment_id long, property_id, name, floorRef, zone, spaceRef, and the ref columns).

    A session is committed whole or not at all: a payload that isn't allowed, a decision without its reason, an item decided elsewhere already,
    an identity that several master rows share or that belongs to another row, two items for one row, or an end that neither the master nor the
    session's own equipment has, goes to ``problems``, and nothing of that session is applied. Equipment lands before references;
    rows are matched by production identity, by the edited name first, then by the item's own. The last decision on a child's reference
    wins. Decisions applied before have no further effect, so a second run gives the same tables.
    Returns master (with ``change``), corrections, applied, problems, counts (session_id, n_committed, n_corrections).
    """
    own = sessions.where("status = 'open'").select("session_id", "property_id", F.col("floor").alias("_floor"), "created_by")
    live = save(live_actions(events.drop("source_item")).where("NOT coalesce(applied, false)").join(own, "session_id"))
    per = save(_identities(master))
    e, wrong = _equipment(live, items, per, save)
    go = e.where(_yes())
    r, astray = _references(live, edges, go, per, save)
    problems = save(reduce(DataFrame.unionByName, [*_decided(live, events, sessions), *wrong, *astray]).distinct())
    stopped = problems.select("session_id").distinct()
    fine = lambda d: d.join(stopped, "session_id", "left_anti")
    corrected = lambda fields: F.when(F.col("action") == "edit", F.to_json(F.struct(*fields))).alias("corrected")
    told = lambda d, fields: d.where(_changed()).select(*ITEM, "original", corrected(fields), "reason", F.coalesce("reviewer", "created_by").alias("reviewer"))
    n = fine(live).groupBy("session_id").agg(F.count_if(_yes()).alias("n_committed"), F.count_if(_changed()).alias("n_corrections"))
    return {
        "master": _new_master(master, fine(go), fine(r.where(_yes()))),
        "corrections": fine(told(e, EQUIPMENT_FIELDS).unionByName(told(r, EDGE_FIELDS))),
        "applied": fine(live).select(*ITEM, F.lit(True).alias("applied")),
        "problems": problems,
        "counts": fine(own.select("session_id")).join(n, "session_id", "left").fillna(0),
    }


def discrepancy_view(report: DataFrame, by: str | None = None) -> DataFrame:
    """Counts by status, or by one of floor, equipment_type, severity_hint; 'all': the three in one pass."""
    if by == "all":
        d = report.groupingSets([["floor"], ["equipment_type"], ["severity_hint"]], "floor", "equipment_type", "severity_hint")
        return d.agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.concat(F.lit("floor="), "floor"), F.concat(F.lit("type="), "equipment_type"), F.concat(F.lit("severity="), "severity_hint")).alias("dim"), "n")
    return report.groupBy(by or "status").agg(F.count(F.lit(1)).alias("n"))


def headlines(report: DataFrame, style: str = "store") -> DataFrame:
    """floor, equipment_type, status, n, text; store: the two gaps; high: high severity only; all: whatever is not matched."""
    keep = {"store": F.col("status").isin("missing_from_drawings", "missing_from_points"), "high": F.col("severity_hint") == "high", "all": F.col("status") != "matched"}[style]
    d = report.where(keep).groupBy("floor", "equipment_type", "status").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.regexp_replace("floor", r"_0*", " "), F.lit(": "), F.col("n").cast("string"), F.lit(" "), "equipment_type", F.when(F.col("n") != 1, "s").otherwise(""), F.lit(" "), F.replace("status", F.lit("_"), F.lit(" ")))
    return d.withColumn("text", text)


def sorted_for_review(items: DataFrame, name: str, score: str = "confidence", ascending: bool = True, attention: bool = False) -> DataFrame:
    """Unscored items last; with ``attention`` flagged or doubtful ones first."""
    s = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    first = [F.desc(needs_attention(score))] if attention else []
    return items.orderBy(*first, s, name)


def placed_for_review(items: DataFrame, name: str, groups: list[str], score: str = "confidence", ascending: bool = True, attention: bool = False) -> DataFrame:
    """``sorted_for_review`` within each of ``groups``, as a place from 1: an order that outlives the frame."""
    s = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    first = [F.desc(needs_attention(score))] if attention else []
    return placed(items, groups, *first, s, F.asc(name))


def needs_attention(score: str = "confidence") -> Column:
    return F.coalesce(F.col("review_required"), F.lit(False)) | F.coalesce(F.col(score) < 0.75, F.lit(False))


def filtered(items: DataFrame, property_id=None, floor=None, status=None, review_required=None, min_confidence=None) -> DataFrame:
    for c, v in (("property_id", property_id), ("floor", floor), ("status", status), ("review_required", review_required)):
        if v is not None:
            items = items.where(F.col(c) == v)
    return items.where(F.col("confidence") >= min_confidence) if min_confidence is not None else items


def scope_or_empty(view: DataFrame, snapshot: DataFrame) -> DataFrame:
    return view.join(snapshot.select("property_id", "floor").distinct(), ["property_id", "floor"], "left_semi")


def status_override(items: DataFrame, floor: str = "1") -> DataFrame:
    hit = F.col("status") == "floor_ambiguous"
    return items.withColumn("resolved_floor", F.when(hit, floor)).withColumn("status", F.when(hit, "resolved_out_of_scope").otherwise(F.col("status")))


def ranked_groups(report: DataFrame) -> DataFrame:
    """Rows with the rank of their severity inside each type, high first."""
    rank = F.when(F.col("severity_hint") == "high", 0).when(F.col("severity_hint") == "medium", 1).otherwise(2)
    return placed(report.withColumn("severity_rank", rank), ["equipment_type"], F.asc("severity_rank"), F.asc("equipment_id"))


