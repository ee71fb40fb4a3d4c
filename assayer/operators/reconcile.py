"""Full outer reconciliation of two label sources, gap reports and canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab
from ..functions.labels import append_reason, canonical_key, strip, strip_device_prefix
from .picks import last_per_key, ordered_distinct, side_by_side

SCOPE = ["property_id", "floor"]
# Reasons attached to rows.
UNEXPLAINED = {
    "topics": "topics extraction flagged unit for review without a reason",
    "drawing": "drawing extraction flagged unit for review without a reason",
}
CONTESTED = "floor contested between topic path and unit-name token; supervisor clarification pending"
TOPICS_ONLY = "present in BMS topics but absent from drawing evidence"
DRAWING_ONLY = "extracted from drawings but absent from BMS topics"
HELD = "floor contested; canonical name preserved as key pending floor ruling"
COLLISION = "canonical name collision; using canonical key"


def keyed(df: DataFrame, *labels: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``key``, of the first of ``labels`` that isn't empty, quarantined rows whose label has no content)."""
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in labels or ("raw_label",)])
    d = df.withColumn("key", canonical_key(label))
    return d.where("key IS NOT NULL"), d.where("key IS NULL").drop("key").withColumn("rule", F.lit("label without content"))


def reconcile(topics: DataFrame, drawings: DataFrame, contested: DataFrame | None = None) -> DataFrame:
    """One row for each (property_id, floor, key) of either source.

    topics: property_id, floor, seq, raw_label, inferred_raw_type, review_required, review_reason. drawings: property_id, floor, seq,
    raw_label, llm_proposed_canonical_name, equipment_type, source_filename, run_status, review_required, review_reason.
    contested: property_id, floor, seq, raw_label, review_reason; its last row for a key overrides the outcome.
    A drawing is keyed by its proposed name, and by its label only where none is proposed: labels are read as they stand, the
    proposed name is the form in which the two sources agree.
    Each side is reduced to one row a key before the join, so copies of a label don't multiply.
    """
    t = (
        keyed(topics)[0].groupBy(*SCOPE, "key")
        .agg(F.min_by(F.struct("raw_label", "inferred_raw_type", "review_required", "review_reason"), "seq").alias("t"))
    )
    ok = F.coalesce("run_status", F.lit("")).isin("", "succeeded")
    d = (
        keyed(drawings.where(ok), "llm_proposed_canonical_name", "raw_label")[0]
        .withColumn("review_reason", strip(F.col("review_reason"))).withColumn("source_filename", strip(F.col("source_filename")))
        .groupBy(*SCOPE, "key", "review_reason")
        .agg(
            F.min_by(F.struct("raw_label", "llm_proposed_canonical_name", "equipment_type"), "seq").alias("d"),
            F.collect_set(F.nullif("source_filename", F.lit(""))).alias("files"),
            F.bool_or(F.coalesce("review_required", F.lit(False))).alias("d_review"),
            F.min("seq").alias("seq"),
        )
        .groupBy(*SCOPE, "key")
        .agg(
            F.min_by("d", "seq").alias("d"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))), ";").alias("source_files"),
            F.bool_or("d_review").alias("d_review"),
            F.array_join(ordered_distinct(F.col("review_reason"), F.col("seq")), "; ").alias("d_reason"),
        )
    )
    j = t.join(d, [*SCOPE, "key"], "full_outer")
    if contested is None:
        j = j.withColumn("c_reason", F.lit(None).cast("string"))
    else:
        c = last_per_key(keyed(contested)[0], [*SCOPE, "key"]).select(
            *SCOPE, "key", F.coalesce(F.nullif(strip(F.col("review_reason")), F.lit("")), F.lit(CONTESTED)).alias("c_reason")
        )
        j = j.join(c, [*SCOPE, "key"], "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    tt, dt = blank(F.col("t.inferred_raw_type")), blank(F.col("d.equipment_type"))
    in_t, in_d, hit = F.col("t").isNotNull(), F.col("d").isNotNull(), F.col("c_reason").isNotNull()
    mismatch = (tt != "") & (dt != "") & (tt != dt)
    category = (
        F.when(hit, "floor_ambiguous").when(in_t & in_d & mismatch, "type_mismatch").when(in_t & in_d, "matched")
        .when(in_t, "topics_only").otherwise("drawing_only")
    )
    base = (
        F.when(hit, F.col("c_reason"))
        .when(category == "type_mismatch", F.concat(F.lit("type mismatch: topics="), tt, F.lit(" drawings="), dt))
        .when(category == "matched", "").when(category == "topics_only", TOPICS_ONLY)
        .otherwise(DRAWING_ONLY)
    )
    t_flag, t_reason = F.coalesce(F.col("t.review_required"), F.lit(False)), strip(F.col("t.review_reason"))
    d_flag, d_reason = F.coalesce("d_review", F.lit(False)), blank(F.col("d_reason"))
    reason = append_reason(
        base, t_reason, F.when(t_flag & (t_reason == ""), UNEXPLAINED["topics"]),
        d_reason, F.when(d_flag & (d_reason == ""), UNEXPLAINED["drawing"]),
    )
    review = (category != "matched") | t_flag | d_flag
    status = F.when(category == "floor_ambiguous", "floor_ambiguous").when(review, "review_required").otherwise("settled")
    t_label, d_label = blank(F.col("t.raw_label")), blank(F.col("d.raw_label"))
    name = F.coalesce(
        F.nullif(F.col("d.llm_proposed_canonical_name"), F.lit("")),
        F.nullif(strip_device_prefix(t_label), F.lit("")), strip_device_prefix(d_label),
    )
    return j.select(
        *SCOPE, F.col("key").alias("canonical_key"), name.alias("canonical_name"),
        F.coalesce(F.nullif(tt, F.lit("")), F.nullif(dt, F.lit("")), F.lit("unknown")).alias("equipment_type"),
        category.alias("discrepancy_category"), status.alias("status"), in_t.alias("in_topics"), in_d.alias("in_drawings"),
        t_label.alias("topics_raw_label"), tt.alias("topics_inferred_type"), d_label.alias("drawing_raw_label"),
        dt.alias("drawing_equipment_type"), blank(F.col("source_files")).alias("source_files"),
        review.alias("review_required"), reason.alias("review_reason"),
    )


def summary(normalized: DataFrame) -> DataFrame:
    cats = ("matched", "topics_only", "drawing_only", "type_mismatch", "floor_ambiguous")
    return normalized.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("discrepancy_category") == c).alias(c) for c in cats],
        F.count_if("review_required").alias("review_required"),
    )


def canonicalize(normalized: DataFrame) -> DataFrame:
    """Rows with mapped type and canonical name; contested or misread rows, and names that collide, keep their key."""
    key, raw, cat = F.col("canonical_key"), F.col("equipment_type"), F.col("discrepancy_category")
    floor = F.coalesce(F.regexp_replace(F.col("floor"), r"\D", "").try_cast("int").cast("string"), F.lit("2"))
    kind, kind_flag, kind_why = vocab.mapped_type(raw)
    prefix, raw_prefix = F.upper(F.substring_index(key, "_", 1)), F.upper(F.coalesce(raw, F.lit("")))
    misread = F.concat(F.lit("label prefix '"), prefix, F.lit("' does not match inferred type '"), raw_prefix, F.lit("' (possible misread); preserved as key"))
    held = (cat == "floor_ambiguous") | (prefix != raw_prefix)
    d = normalized.select("*", kind.alias("mapped_type"), kind_flag.alias("_kind_flag"), kind_why.alias("_kind_why"), held.alias("_held"), floor.alias("_floor"))
    d = d.withColumn("_n", F.when(~F.col("_held"), vocab.named(key, F.col("mapped_type"), F.col("_floor"))))
    reason = append_reason(
        strip(F.col("review_reason")), F.col("_kind_why"),
        F.when(cat == "floor_ambiguous", HELD).when(F.col("_held"), misread).otherwise(F.col("_n.reason")),
    )
    d = d.select(
        *normalized.columns, "mapped_type", F.when(F.col("_held"), key).otherwise(F.col("_n.name")).alias("_name"), reason.alias("_reason"),
        (F.col("review_required") | F.col("_held") | F.col("_kind_flag") | F.coalesce("_n.flag", F.lit(False))).alias("_review"),
    )
    d = d.withColumn("_twice", F.count(F.lit(1)).over(Window.partitionBy("property_id", "floor", "_name")) > 1)
    return (
        d.withColumn("raw_equipment_type", F.col("equipment_type")).withColumn("equipment_type", F.col("mapped_type"))
        .withColumn("canonical_name", F.when(F.col("_twice"), key).otherwise(F.col("_name")))
        .withColumn("review_reason", F.when(F.col("_twice"), append_reason(F.col("_reason"), F.lit(COLLISION))).otherwise(F.col("_reason")))
        .withColumn("review_required", F.col("_review") | F.col("_twice"))
        .drop("_name", "_reason", "_review", "_twice", "mapped_type")
    )


def gap_report(canonical: DataFrame, building: str = "property_id") -> DataFrame:
    status = vocab.report_status(F.col("discrepancy_category"))
    return canonical.select(
        F.coalesce(F.nullif(building, F.lit("")), F.lit("unknown")).alias("building"), "floor",
        F.coalesce(F.nullif("equipment_type", F.lit("")), F.lit("UNRESOLVED")).alias("equipment_type"),
        F.coalesce(F.nullif("canonical_name", F.lit("")), F.col("canonical_key")).alias("equipment_id"),
        F.col("in_topics").alias("in_points"), "in_drawings", status.alias("status"),
        F.col("topics_raw_label").alias("evidence_point"), F.col("drawing_raw_label").alias("evidence_drawing"),
        vocab.severity(status, F.col("equipment_type")).alias("severity_hint"),
    )


def alias_rows(canonical: DataFrame) -> DataFrame:
    """(property_id, floor, key) -> the first row of the table with that key or name (seq: the table's order)."""
    forms = F.posexplode(F.array("canonical_key", "canonical_name")).alias("form", "label")
    d = canonical.select(*SCOPE, "seq", F.col("canonical_name").alias("target"), forms).withColumn("key", canonical_key(F.col("label")))
    return d.where("key IS NOT NULL").groupBy(*SCOPE, "key").agg(F.min_by("target", F.struct("seq", "form")).alias("target"))


def joined_edges(canonical: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of refs that have a column and of two named ends, with the unit they fall on and the parent's name.

    The unit is that of the child, else of its raw label; the name that of the parent's unit, else of its raw label's, else the
    parent as it stands. Edges of no unit are left out. Labels are resolved once each, not once for each edge.
    """
    e = edges.where(F.col("ref_type").isin(*vocab.REF_TYPES) & (F.coalesce("child", F.lit("")) != "") & (F.coalesce("parent", F.lit("")) != ""))
    forms = ("child", "child_raw", "parent", "parent_raw")
    said = e.select(*SCOPE, F.explode(F.array(*forms)).alias("label")).where("label <> ''").distinct()
    hits = said.withColumn("key", canonical_key(F.col("label"))).join(alias_rows(canonical), [*SCOPE, "key"]).select(*SCOPE, "label", "target")
    for form in forms:
        own = hits.select(*SCOPE, F.col("label").alias(form), F.col("target").alias(f"_{form}"))
        if form.endswith("_raw"):  # most edges have none: these don't meet in one task
            there = F.coalesce(F.col(form), F.lit("")) != ""
            e = e.where(there).join(own, [*SCOPE, form], "left").unionByName(e.where(~there).withColumn(f"_{form}", F.lit(None).cast("string")))
        else:
            e = e.join(own, [*SCOPE, form], "left")
    e = e.withColumn("unit", F.coalesce("_child", "_child_raw")).withColumn("name", F.coalesce("_parent", "_parent_raw", "parent"))
    return e.where("unit IS NOT NULL").drop(*[f"_{f}" for f in forms])


# Notes of a fold.
EVIDENCE_NOTE, UNCONFIRMED_NOTE = "evidence points to ", "flagged by relationship extraction"


def telling_edges(joined: DataFrame) -> DataFrame:
    """Those ``joined_edges`` that a fold can't do without.

    As long as all parents of a unit's reference agree, a further edge that names the same one, unflagged and without conflict, leaves
    cell, flag and notes as they are. Such edges go: those behind the first parent and before the first that differs, both of which are found by
    the smallest seq of each name, before any edges meet. What stays for a unit grows with what is written into its row.
    """
    keys = [*SCOPE, "unit", "ref_type"]
    conflict, review = (F.coalesce(c, F.lit(False)) for c in ("conflict", "review_required"))
    names = joined.where(~conflict).groupBy(*keys, "name").agg(F.min(F.struct("seq")).alias("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "name"))
    two = names.withColumn("_place", place).where("_place <= 2")
    marks = two.groupBy(*keys).agg(
        F.max(F.when(F.col("_place") == 1, F.col("_at.seq"))).alias("_first"), F.max(F.when(F.col("_place") == 2, F.col("_at.seq"))).alias("_differs"),
        F.max("_place").alias("_names"),
    )
    agreed = (F.col("seq") > F.col("_first")) & ((F.col("_names") == 1) | (F.col("seq") < F.col("_differs")))
    d = joined.join(marks, keys, "left")
    return d.where(conflict | review | ~F.coalesce(agreed, F.lit(False))).drop("_first", "_differs", "_names")


def fold_refs(canonical: DataFrame, edges: DataFrame, *, save=None) -> DataFrame:
    """canonical (seq, canonical_key, canonical_name) with a column for each ref type, filled from edges in the order of their seq.

    The first parent fills the cell; one that differs from the cell is appended with ';' and flags the row; conflicts only
    flag it; parents flagged upstream are noted as unconfirmed. Notes stand in the order of the edges. Only ``telling_edges`` meet in a
    unit's row. ``save`` stores the joined edges, which are read twice.
    """
    e = joined_edges(canonical, edges)
    e = telling_edges(save(e) if save else e)
    item = F.struct("seq", "name", F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce("conflict_reason", F.lit("")).alias("why"), F.coalesce("review_required", F.lit(False)).alias("review"), F.coalesce("review_reason", F.lit("")).alias("note"), "parent")
    notes = f"array<struct<seq: {e.schema['seq'].dataType.simpleString()}, note: string>>"
    state = lambda cell, flag, note=None: f"named_struct('cell', {cell}, 'flag', {flag}, 'notes', " + (f"array_append(a.notes, named_struct('seq', x.seq, 'note', {note})))" if note else "a.notes)")
    torn = f"concat(ref_type, ' conflict: ', coalesce(nullif(trim(x.why), ''), concat('{EVIDENCE_NOTE}', x.parent)))"
    several = "concat('multiple ', ref_type, ' parents inferred: ', a.cell, ';', x.name)"
    doubtful = f"concat(ref_type, ' ', x.name, ' inferred but unconfirmed: ', coalesce(nullif(trim(x.note), ''), '{UNCONFIRMED_NOTE}'))"
    folded = F.expr(f"""aggregate(items, named_struct('cell', '', 'flag', false, 'notes', cast(array() as {notes})), (a, x) ->
        CASE WHEN x.conflict THEN {state("a.cell", "true", torn)}
             WHEN a.cell <> '' AND a.cell <> x.name THEN {state("concat(a.cell, ';', x.name)", "true", several)}
             WHEN x.review THEN {state("x.name", "true", doubtful)}
             ELSE {state("x.name", "a.flag")} END)""")
    cells = e.groupBy(*SCOPE, "unit", "ref_type").agg(F.sort_array(F.collect_list(item)).alias("items")).select(*SCOPE, "unit", "ref_type", folded.alias("f"))
    wide = cells.groupBy(*SCOPE, F.col("unit").alias("canonical_name")).agg(
        *[F.max(F.when(F.col("ref_type") == r, F.nullif("f.cell", F.lit("")))).alias(r) for r in vocab.REF_TYPES],
        F.bool_or("f.flag").alias("_flag"),
        F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("f.notes"))), lambda x: x["note"]), "; ").alias("_notes"),
    )
    out = canonical.join(wide, [*SCOPE, "canonical_name"], "left")
    return (
        out.withColumns({r: F.coalesce(r, F.lit("")) for r in vocab.REF_TYPES})
        .withColumn("review_required", F.col("review_required") | F.coalesce("_flag", F.lit(False)))
        .withColumn("review_reason", append_reason(F.col("review_reason"), F.col("_notes"))).drop("_flag", "_notes")
    )


def ref_join_counts(canonical: DataFrame, edges: DataFrame) -> DataFrame:
    """joined_edges: edges that fill or extend a cell; valid_uncolumned_edges: edges of a valid ref type that has no column."""
    joined = joined_edges(canonical, edges).where(~F.coalesce("conflict", F.lit(False))).agg(F.count(F.lit(1)).alias("joined_edges"))
    rest = edges.agg(F.count_if(F.col("ref_type").isin(*vocab.UNCOLUMNED_REFS)).alias("valid_uncolumned_edges"))
    return side_by_side(joined, rest)


def stage_counts(canonical: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """What a run of the stage reports: rows, settled and flagged rows, rows with a ref, and with edges the two counts of the join."""
    filled = F.lit(False)
    for r in vocab.REF_TYPES:
        if r in canonical.columns:
            filled = filled | (F.coalesce(r, F.lit("")) != "")
    d = canonical.agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("status") == "settled").alias("settled"), F.count_if("review_required").alias("flagged"), F.count_if(filled).alias("refs_filled"),
    )
    return d if edges is None else side_by_side(d, ref_join_counts(canonical, edges))
