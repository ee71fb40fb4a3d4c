"""Edges, their fusion from evidence, and validation of the graph they make."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.labels import append_reason, canonical_key, strip, to_bool, type_prefix, widget_kind
from .cycles import cycle_nodes
from .picks import first_by, ordered_distinct

# Review threshold, confidence by link state and kind, and the notes attached to edges.
LOW = 0.75
CONFIDENCE = {"live": 0.95, "live_synced": 0.95, "offline": 0.85}
EXTRAPOLATED, VALVE_AHU, VALVE_OTHER = 0.55, 0.90, 0.85
PLANT_NOTE = "single-plant default (Appendix A): one CHW/HW plant instance per building"
EDGE = ["child", "parent", "ref_type", "confidence", "conflict", "conflict_reason", "review_required", "review_reason", "source_drawing", "child_raw", "parent_raw", "link_kind", "evidence_kind"]


# Notes attached to edges by the evidence they come from.
OAVAV_NOTE = "OA/ventilation link: the OAVAV feeds this unit's mixed-air side"
DOAS_NOTE = "DOAS is outside the scored vocabulary but is the real OA parent"
CHW_NOTE = f"CHW valve points on graphic; {PLANT_NOTE}"
HW_NOTE = f"WW (hot water) valve points on graphic; {PLANT_NOTE}"
EXTRAPOLATED_NOTE = "extrapolated: every observed OAVAV page links to this DOAS; this page has not been captured — confirm before approval"
NO_LINK_QUESTION = "no upstream linked widget on this page"


def scope_of(df: DataFrame) -> list[str]:
    """The scope columns that a frame has: property and floor, one of them, or none where it is of one floor."""
    return [c for c in ("property_id", "floor") if c in df.columns]


def _shared(df: DataFrame, other: DataFrame) -> list[str]:
    """The scope columns by which two frames meet: those that both have."""
    return [c for c in scope_of(df) if c in other.columns]


def _filled(df: DataFrame) -> DataFrame:
    """A null property or floor is the empty one, so that rows without it meet each other."""
    return df.fillna("", scope_of(df)) if scope_of(df) else df


def edges_from(df: DataFrame, floor: str = "2") -> DataFrame:
    """child_raw, parent_raw, ref_type, link_kind, confidence, source_drawing, evidence_kind, conflict, conflict_reason, notes -> edges,
    with the scope columns that df has; the floor in names is that of the row, else ``floor``."""
    f = F.coalesce(F.regexp_replace("floor", r"\D", "").try_cast("int").cast("string"), F.lit(floor)) if "floor" in df.columns else F.lit(floor)
    conf, scope = F.col("confidence").cast("double"), scope_of(df)
    # labels repeat: each is named once, and rows look theirs up
    ends = df.select(*scope, F.explode(F.array("child_raw", "parent_raw")).alias("_label")).distinct().withColumn("_e", vocab.endpoint(F.col("_label"), f))
    d = df
    for end in ("child", "parent"):
        own = ends.select(*[F.col(c).alias(f"_{end}_{c}") for c in scope], F.col("_label").alias(f"_{end}_label"), F.col("_e").alias(f"_{end}"))
        on = [F.col(c).eqNullSafe(F.col(f"_{end}_{c}")) for c in scope] + [F.col(f"{end}_raw").eqNullSafe(F.col(f"_{end}_label"))]
        d = d.join(own, on, "left").drop(f"_{end}_label", *[f"_{end}_{c}" for c in scope])
    return d.select(
        *scope, F.col("_child.name").alias("child"), F.col("_parent.name").alias("parent"), "ref_type", F.round(conf, 2).alias("confidence"), "conflict", "conflict_reason",
        ((conf < LOW) | F.col("conflict") | F.col("_child.flag") | F.col("_parent.flag")).alias("review_required"),
        append_reason(F.col("_child.reason"), F.col("_parent.reason"), F.col("notes")).alias("review_reason"),
        "source_drawing", "child_raw", "parent_raw", "link_kind", "evidence_kind",
    )


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Page payloads to evidence rows: one for each widget, one for valves if any, one where there is no widget."""
    scope = scope_of(pages)
    p = pages.select(*scope, "source_image", F.coalesce("payload.page_title", F.lit("")).alias("page_title"), "payload")
    row = lambda d, kind, obj, state, detail: d.select(
        *scope, "source_image", "page_title", kind.alias("evidence_kind"), F.col("page_title").alias("subject_raw"), obj.alias("object_raw"), state.alias("link_state"), detail.alias("detail"))
    w = p.withColumn("w", F.explode("payload.linked_widgets"))
    label = F.coalesce("w.label", F.lit(""))
    widgets = row(w, widget_kind(label), label, F.when(F.col("w.values_live"), "live_synced").otherwise("offline"), F.coalesce(F.array_join("w.points_shown", "; "), F.lit("")))
    detail = F.coalesce("payload.water_valves.detail", F.lit(""))
    chw = F.coalesce("payload.water_valves.chilled_water", F.lit(False)) | F.upper(detail).contains("CHW")
    hot = F.coalesce("payload.water_valves.hot_water", F.lit(False)) | F.upper(detail).contains("WW")
    valves = row(p.where(chw | hot), F.lit("valve_points"), F.concat_ws("+", F.when(chw, "CHW"), F.when(hot, "WW")), F.lit("n/a"), detail)
    bare = F.coalesce(F.size("payload.linked_widgets"), F.lit(0)) <= 0
    none = row(p.where(bare), F.lit("no_linked_widget"), F.lit(""), F.lit("n/a"), F.lit("no linked equipment widget found on page"))
    return widgets.unionByName(valves).unionByName(none)


def fuse(evidence: DataFrame, floor: str = "2", extrapolate: bool = True) -> DataFrame:
    """Evidence rows (seq, source_image, page_title, evidence_kind, object_raw, link_state, detail, and scope columns) to edges.

    Every row is read once: it makes no edge, one, or for valves one for each kind of water.
    """
    kind, o, scope, conf = F.col("evidence_kind"), F.col("object_raw"), scope_of(evidence), F.lit(CONFIDENCE["offline"])
    for state, c in CONFIDENCE.items():
        conf = F.when(F.col("link_state") == state, c).otherwise(conf)
    valve = F.when(type_prefix(F.col("page_title")) == "AHU", VALVE_AHU).otherwise(VALVE_OTHER)

    def edge(when, parent, ref, link, confidence, notes):
        made = F.struct(parent.alias("parent_raw"), F.lit(ref).alias("ref_type"), F.lit(link).alias("link_kind"), confidence.cast("double").alias("confidence"), notes.alias("notes"))
        return F.when(when, made)

    made = F.array_compact(F.array(
        edge(kind == "linked_widget_ahu", o, "airRef", "primary_air", conf, F.col("detail")),
        edge(kind == "linked_widget_oavav", o, "airRef", "outside_air", conf, F.lit(OAVAV_NOTE)),
        edge(kind == "linked_widget_doas", o, "airRef", "primary_air", conf, F.lit(DOAS_NOTE)),
        edge((kind == "valve_points") & o.contains("CHW"), F.lit("CHW-PLANT_1"), "chilledWaterRef", "plant", valve, F.lit(CHW_NOTE)),
        edge((kind == "valve_points") & o.contains("WW"), F.lit("HW-PLANT_1"), "hotWaterRef", "plant", valve, F.lit(HW_NOTE)),
    ))
    plain = [F.lit(False).alias("conflict"), F.lit("").alias("conflict_reason")]
    d = evidence.select(*scope, F.col("page_title").alias("child_raw"), F.col("source_image").alias("source_drawing"), "evidence_kind", F.explode(made).alias("e"), *plain).select("*", "e.*").drop("e")
    if extrapolate:
        d = d.unionByName(extrapolated(evidence))
    return edges_from(d, floor)


def extrapolated(evidence: DataFrame) -> DataFrame:
    """Labels seen without an observed page get the last seen parent, if at least two pages were observed; floor by floor.

    The images named are those of the floor's observed pages, each as often as it was observed.
    """
    scope = scope_of(evidence)
    e = evidence if scope else evidence.withColumn("_one", F.lit(1))
    keys = scope or ["_one"]
    seen = e.where(F.col("evidence_kind") == "linked_widget_oavav").select(*keys, F.col("object_raw").alias("child_raw")).unionByName(
        e.where(type_prefix(F.col("page_title")) == "OAVAV").select(*keys, F.col("page_title").alias("child_raw"))
    ).distinct()
    doas = e.where(F.col("evidence_kind") == "linked_widget_doas")
    pages = doas.select(*keys, F.col("page_title").alias("child_raw")).distinct()
    # an image is named once for each row, but gathered once, with its count
    images = doas.where("source_image IS NOT NULL").groupBy(*keys, "source_image").agg(F.count(F.lit(1)).cast("int").alias("n"))
    images = images.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_image", "n"))).alias("each"))
    named = F.array_join(F.flatten(F.transform("each", lambda x: F.array_repeat(x["source_image"], x["n"]))), ", ")
    last = doas.groupBy(*keys).agg(F.max_by("object_raw", "seq").alias("parent_raw"), F.count_distinct("page_title").alias("_n")).where("_n >= 2")
    one = last.join(images, keys, "left").select(*keys, "parent_raw", named.alias("source_drawing"))
    left = seen.join(pages, [*keys, "child_raw"], "left_anti")
    return left.join(one, keys).select(
        *scope, "child_raw", "parent_raw", F.lit("airRef").alias("ref_type"), F.lit("primary_air").alias("link_kind"), F.lit(EXTRAPOLATED).alias("confidence"), "source_drawing",
        F.lit("pattern_extrapolation").alias("evidence_kind"), F.lit(False).alias("conflict"), F.lit("").alias("conflict_reason"),
        F.lit(EXTRAPOLATED_NOTE).alias("notes"),
    )


def review_notes(evidence: DataFrame, kinds=("no_oa_link", "no_ahu_link")) -> DataFrame:
    return evidence.where(F.col("evidence_kind").isin(*kinds)).select(
        F.col("page_title").alias("item"), F.coalesce(F.nullif("detail", F.lit("")), F.lit(NO_LINK_QUESTION)).alias("question"), F.col("source_image").alias("source")
    )


def merge_secondary(edges: DataFrame, secondary: DataFrame) -> DataFrame:
    """``edges`` and those of a second source whose (child, ref_type) the first lacks, scope by scope."""
    edges, secondary = _filled(edges), _filled(secondary)
    keys = [*_shared(secondary, edges), "child", "ref_type"]
    return edges.unionByName(secondary.join(edges.select(*keys).distinct(), keys, "left_anti"))


def union_edges(edges: DataFrame) -> DataFrame:
    """One row for each (scope, child, ref_type, parent): best confidence, any conflict and its first reason, drawings in order, hits."""
    flag, keys = F.coalesce("conflict", F.lit(False)), [*scope_of(edges), "child", "ref_type", "parent"]
    each = edges.groupBy(*keys, "source_drawing").agg(
        F.max("confidence").alias("confidence"), F.bool_or(flag).alias("conflict"), F.min("seq").alias("seq"), F.min(F.when(flag, F.col("seq"))).alias("_at"),
        first_by(F.col("conflict_reason"), F.col("seq"), flag).alias("conflict_reason"), F.count(F.lit(1)).alias("tile_hits"),
    )
    return each.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.bool_or("conflict").alias("conflict"),
        first_by(F.col("conflict_reason"), F.col("_at")).alias("conflict_reason"),
        F.array_join(ordered_distinct(F.col("source_drawing"), F.col("seq")), ";").alias("source_drawings"), F.sum("tile_hits").alias("tile_hits"),
    )


def candidates(edges: DataFrame) -> DataFrame:
    """Parents with a name of their own that are nobody's child in their scope."""
    edges = _filled(edges)
    scope, own = scope_of(edges), F.lit(False)
    for p in vocab.PASSTHROUGH:
        own = own | F.col("name").startswith(p)
    parents = edges.select(*scope, F.col("parent").alias("name")).distinct().where(own)
    return parents.join(edges.select(*scope, F.col("child").alias("name")).distinct(), [*scope, "name"], "left_anti")


def alias_names(equipment: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(scope, key, name) of the names that stand under a key; equipment(name, type), aliases(alias, name), both with the scope columns they
    have. A name stands under its own key, and a name without a token under itself; aliases of names that aren't equipment of their scope
    count for nothing; aliases without scope columns hold in every scope that has the name."""
    equipment = _filled(equipment)
    scope = scope_of(equipment)
    own = F.coalesce(canonical_key(F.col("name")), F.concat(F.lit("="), F.col("name")))
    d = equipment.select(*scope, own.alias("key"), "name")
    if aliases is not None:
        aliases = _filled(aliases)
        named = aliases.join(equipment.select(*scope, "name").distinct(), [*_shared(aliases, equipment), "name"])
        d = d.unionByName(named.select(*scope, canonical_key(F.col("alias")).alias("key"), "name"))
    return d.where("key IS NOT NULL")


def _stripped(edges: DataFrame) -> DataFrame:
    """Edges with the text of their ends: _child_label, _child_text (the raw label), and those of the parent."""
    return edges.withColumns({f"_{role}_{c}": strip(F.col(f"{role}{raw}")) for role in ("child", "parent") for c, raw in (("label", ""), ("text", "_raw"))})


def _each_end(scope: list[str], edges: DataFrame, *also: str) -> DataFrame:
    """(scope, also, role, label, raw) of the ends of ``_stripped`` edges."""
    end = lambda role: F.struct(F.lit(role).alias("role"), F.col(f"_{role}_label").alias("label"), F.col(f"_{role}_text").alias("raw"))
    return edges.select(*scope, *also, F.explode(F.array(end("child"), end("parent"))).alias("e")).select(*scope, *also, "e.*")


def _looked_up(pairs: DataFrame, met: list[str], equipment: DataFrame, aliases: DataFrame | None, declared: DataFrame | None) -> DataFrame:
    """Rows with label and raw -> with identity, status, canonical, declared, targets. The status is told by the smallest and the largest
    name alone, so rows only hold lists of names where somebody asks for ``targets``."""
    known = alias_names(equipment.select(*met, "name"), aliases).groupBy(*met, "key").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.array_sort(F.collect_set("name")).alias("targets"))
    d = pairs.withColumns({f"_own_{c}": F.when(F.col(c) != "", canonical_key(F.col(c))) for c in ("label", "raw")})
    # a blank text has a key that nothing stands under, and not all the same one
    d = d.withColumns({f"_key_{c}": F.when(F.col(c) == "", F.concat(F.lit("<"), "label", "raw")).otherwise(F.coalesce(f"_own_{c}", F.concat(F.lit("="), F.col(c)))) for c in ("label", "raw")})
    for c in ("label", "raw"):
        d = d.join(known.select(*met, F.col("key").alias(f"_key_{c}"), *[F.col(x).alias(f"_{x}_{c}") for x in ("low", "high", "targets")]), [*met, f"_key_{c}"], "left")
        if declared is None:
            d = d.withColumn(f"_declared_{c}", F.lit(False))
        else:
            told = _shared(declared, d.select(*met))
            named = _filled(declared).select(*told, canonical_key(F.col("name")).alias(f"_own_{c}")).where(f"_own_{c} IS NOT NULL").distinct()
            d = d.join(named.withColumn(f"_declared_{c}", F.lit(True)), [*told, f"_own_{c}"], "left")
    low, high = F.least("_low_label", "_low_raw"), F.greatest("_high_label", "_high_raw")
    none = F.array().cast("array<string>")
    first = F.coalesce(F.nullif("label", F.lit("")), F.nullif("raw", F.lit("")))
    return d.select(
        *pairs.columns, F.coalesce(F.when(F.col("label") != "", F.col("_own_label")).otherwise(F.col("_own_raw")), F.upper(first)).alias("identity"),
        F.when(low.isNull(), "unresolved").when(low == high, "resolved").otherwise("ambiguous").alias("status"), F.when(low == high, low).alias("canonical"),
        (F.coalesce("_declared_label", F.lit(False)) | F.coalesce("_declared_raw", F.lit(False))).alias("declared"),
        F.array_sort(F.array_union(F.coalesce("_targets_label", none), F.coalesce("_targets_raw", none))).alias("targets"),
    )


# What an edge holds of an end once it is resolved.
TOLD = ["identity", "status", "canonical", "declared"]


def _matched(edges: DataFrame, equipment: DataFrame, aliases=None, declared=None, *, save=None, told=TOLD) -> DataFrame:
    """Edges with what is ``told`` of both ends, as _child_identity and so on. Every distinct pair of label and raw label of a scope is
    resolved once; edges look theirs up."""
    edges = _filled(edges)
    met = _shared(edges, equipment)
    d = _stripped(edges)
    pairs = _looked_up(_each_end(met, d).drop("role").distinct(), met, equipment, aliases, declared).select(*met, "label", "raw", *told)
    pairs = save(pairs) if save else pairs
    for role in ("child", "parent"):
        own = pairs.select(*met, F.col("label").alias(f"_{role}_label"), F.col("raw").alias(f"_{role}_text"), *[F.col(c).alias(f"_{role}_{c}") for c in told])
        d = d.join(own, [*met, f"_{role}_label", f"_{role}_text"], "left")
    return d


def _ends(matched: DataFrame, told=TOLD) -> DataFrame:
    """The two ends of each of the ``matched`` edges, with its seq and what it says."""
    scope = scope_of(matched)
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("<blank>"))
    said = F.concat(shown(F.col("_child_label")), F.lit(" -> "), shown(F.col("_parent_label")), F.lit(" ("), shown(strip(F.col("ref_type"))), F.lit(")"))
    end = lambda role: F.struct(F.lit(role).alias("role"), *[F.col(f"_{role}_{c}").alias(c) for c in ("label", "text", *told)])
    d = matched.select(*scope, "seq", "ref_type", said.alias("said"), F.explode(F.array(end("child"), end("parent"))).alias("e")).select(*scope, "seq", "ref_type", "said", "e.*")
    blank, labels = F.concat(F.lit("<blank "), F.col("role"), F.lit(">")), F.array_distinct(F.filter(F.array("label", "text"), lambda x: x != ""))
    return d.select(
        *scope, "seq", "role", "ref_type", "said", F.coalesce("identity", F.upper(blank)).alias("identity"), F.when(F.size(labels) > 0, labels).otherwise(F.array(blank)).alias("labels"),
        *(["targets"] if "targets" in told else []), "status", "canonical", F.coalesce(F.col("canonical") != F.col("label"), F.lit(False)).alias("used_alias"), "declared",
    )


def resolve(edges: DataFrame, equipment: DataFrame, aliases: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(scope, seq, role) -> identity, labels, targets, status (resolved, unresolved, ambiguous), canonical, used_alias, declared, said (the edge).

    An end is named by its label and its raw label, and resolves among the equipment of its own property and floor, by the scope columns
    that both frames have; ``seq`` numbers the edges of a scope. ``targets`` lists all names in each row: where counts are enough,
    ``end_counts`` and ``accepted_edges`` do without.
    """
    told = [*TOLD, "targets"]
    return _ends(_matched(edges, equipment, aliases, declared, told=told), told)


def end_counts(edges: DataFrame, equipment: DataFrame, aliases: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(scope, role, ref_type, identity, status, canonical) -> n, the number of ends. Equal ends are counted before any is resolved."""
    edges = _filled(edges)
    scope = scope_of(edges)
    each = _each_end(scope, _stripped(edges), "ref_type").groupBy(*scope, "ref_type", "role", "label", "raw").agg(F.count(F.lit(1)).alias("n"))
    d = _looked_up(each, _shared(edges, equipment), equipment, aliases, declared)
    identity = F.coalesce("identity", F.upper(F.concat(F.lit("<blank "), F.col("role"), F.lit(">"))))
    return d.groupBy(*scope, "role", "ref_type", identity.alias("identity"), "status", "canonical").agg(F.sum("n").alias("n"))


def _accepted(matched: DataFrame, *also: str) -> DataFrame:
    """The ``matched`` edges with both ends resolved and no conflict, by canonical names."""
    good = matched.where(~to_bool(F.col("conflict")) & F.col("_child_canonical").isNotNull() & F.col("_parent_canonical").isNotNull())
    return good.select(*scope_of(matched), *also, F.col("_child_canonical").alias("child"), F.col("_parent_canonical").alias("parent"), "ref_type")


def accepted_edges(edges: DataFrame, equipment: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(scope, child, parent, ref_type) of edges with both ends resolved and no conflict, by canonical names, once for each edge."""
    return _accepted(_matched(edges, equipment, aliases))


def accepted(edges: DataFrame, resolution: DataFrame) -> DataFrame:
    """Edges with both ends resolved and no conflict, by canonical names."""
    edges = _filled(edges)
    scope = scope_of(edges)
    ends = resolution.where("status = 'resolved'").groupBy(*scope, "seq").agg(
        F.max(F.when(F.col("role") == "child", F.col("canonical"))).alias("c"), F.max(F.when(F.col("role") == "parent", F.col("canonical"))).alias("p")
    )
    both = ends.where("c IS NOT NULL AND p IS NOT NULL")
    return edges.where(~to_bool(F.col("conflict"))).join(both, [*scope, "seq"]).select(*scope, "seq", F.col("c").alias("child"), F.col("p").alias("parent"), "ref_type")


def orphans(edges: DataFrame, equipment: DataFrame) -> DataFrame:
    """Terminals that no air edge of their scope feeds."""
    edges, equipment = _filled(edges), _filled(equipment)
    met = _shared(equipment, edges)
    fed = edges.where("ref_type = 'airRef'").select(*met, F.col("child").alias("name")).distinct()
    return equipment.where(vocab.is_terminal(F.col("type"))).join(fed, [*met, "name"], "left_anti")


def multiple_parents(edges: DataFrame, ref_type: str = "airRef") -> DataFrame:
    d = edges.where(F.col("ref_type") == ref_type).groupBy(*scope_of(edges), "child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return d.where(F.size("parents") > 1)


def ref_sanity(ends: DataFrame, equipment: DataFrame) -> DataFrame:
    """Resolved ends (role, ref_type, canonical; seq, or n of ``end_counts``) whose type their ref doesn't allow: check, name, type."""
    ends, equipment = _filled(ends), _filled(equipment)
    met = _shared(ends, equipment)
    d = ends.join(equipment.select(*met, F.col("name").alias("canonical"), "type"), [*met, "canonical"])
    child = (F.col("ref_type") == "airRef") & (F.col("role") == "child") & ~vocab.is_terminal(F.col("type"))
    parent = (F.col("ref_type") == "airRef") & (F.col("role") == "parent") & ~vocab.is_air_source(F.col("type"))
    water = F.col("ref_type").isin(*vocab.WATER_REFS) & (F.col("role") == "parent") & ~vocab.is_plant(F.col("type"))
    check = F.when(child, "child is not a terminal").when(parent, "parent is not an air source").when(water, "parent is not a plant")
    also = [c for c in ("seq", "n") if c in ends.columns]
    return d.select(*scope_of(ends), *also, "role", "ref_type", F.col("canonical").alias("name"), "type", check.alias("check")).where("check IS NOT NULL")


def review_items(edges: DataFrame) -> DataFrame:
    """Edges to review with all reasons: low confidence, conflict, a flag that nothing else explains, and what was noted upstream."""
    low, conflict, flagged = F.col("confidence") < LOW, to_bool(F.col("conflict")), to_bool(F.col("review_required"))
    low = F.coalesce(low, F.lit(False))
    why = F.concat_ws(", ", F.when(low, F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit(f" < {LOW}"))), F.when(conflict, "conflict=true"),
                      F.when(flagged & ~low & ~conflict, "review_required=true"), F.nullif(strip(F.col("review_reason")), F.lit("")))
    return edges.where(low | conflict | flagged).select(*scope_of(edges), "seq", "child", "parent", "ref_type", why.alias("reason"))


# Findings and their messages.
CANDIDATE_NOTE = "declared in equipment_candidates but not approved into canonical equipment"
ABSENT_NOTE = "not present in canonical equipment or its source-label aliases"


class Validation(NamedTuple):
    """findings(check_id, severity, message, nodes); the resolved ends, the accepted edges and what was checked."""

    findings: DataFrame
    ends: DataFrame
    good: DataFrame
    edges: DataFrame
    equipment: DataFrame


def _listed(c: Column) -> Column:
    """A list of texts as ['a', 'b']."""
    return F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))


def validate(edges: DataFrame, equipment: DataFrame, aliases=None, declared=None, *, save) -> Validation:
    """All findings of a graph. edges(seq, child, parent, child_raw, parent_raw, ref_type, confidence, conflict, review_required,
    review_reason); equipment(name, type); aliases(alias, name); declared(name), candidates that aren't equipment yet.

    Ends that can't be resolved are told once for each identity, with every label they were given and the number of different edges.
    Where edges and equipment have property_id or floor, each scope is a graph of its own, and findings name theirs.
    """
    edges, equipment = _filled(edges), _filled(equipment)
    scope = scope_of(edges)
    if missing := [c for c in scope if c not in equipment.columns]:
        raise ValueError(f"equipment lacks the edges' scope columns: {missing}")
    # one table of edges that know their ends: ends and accepted edges are read from it
    known = save(_matched(edges, equipment, aliases, declared, save=save))
    edges, ends, good = known.select(*edges.columns), _ends(known), _accepted(known, "seq")

    def row(d, check, sev, message, nodes):
        return d.select(*scope, F.lit(check).alias("check_id"), F.lit(sev).alias("severity"), message.alias("message"), nodes.alias("nodes"))

    bad = ends.where("status <> 'resolved'")
    keys, met = [*scope, "identity", "status"], _shared(edges, equipment)
    # names meet the different labels of an identity, not its edges
    texts = save(bad.select(*keys, F.explode("labels").alias("x")).distinct())
    names = alias_names(equipment.select(*met, "name"), aliases).withColumnRenamed("key", "_key")
    torn = texts.where("status = 'ambiguous'").withColumn("_key", F.coalesce(canonical_key(F.col("x")), F.concat(F.lit("="), F.col("x"))))
    torn = torn.join(names, [*met, "_key"]).select(*keys, "name").distinct()
    sets = lambda d, x, c: d.groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias(c))
    issue = bad.groupBy(*keys).agg(F.count_distinct("said").alias("n"), F.bool_or("declared").alias("declared"))
    issue = save(issue.join(sets(texts, "x", "labels"), keys).join(sets(torn, "name", "targets"), keys, "left"))
    times = F.concat(F.lit("; referenced by "), F.col("n").cast("string"), F.lit(" edge(s)"))
    unknown, unsure = issue.where("status = 'unresolved'"), issue.where("status = 'ambiguous'")
    lost = F.concat(F.lit("unresolved endpoint "), _listed(F.col("labels")), F.lit(": "), F.when(F.col("declared"), CANDIDATE_NOTE).otherwise(ABSENT_NOTE), times)
    torn = F.concat(F.lit("endpoint labels "), _listed(F.col("labels")), F.lit(" resolve to multiple canonical units "), _listed(F.col("targets")), times)
    both = F.concat("labels", "targets")
    one = lambda c: F.array(F.col(c))
    sane = F.concat(F.col("ref_type"), F.lit(" "), F.col("role"), F.lit(" '"), F.col("name"), F.lit("' is not "), F.when(F.col("role") == "child", "a terminal").when(F.col("ref_type") == "airRef", "an air source").otherwise("a plant"), F.lit(" ("), F.col("type"), F.lit(")"))
    item = F.concat(F.lit("edge "), strip(F.col("child")), F.lit(" -> "), strip(F.col("parent")), F.lit(" ("), strip(F.col("ref_type")), F.lit("): "), F.col("reason"))
    several = F.concat(F.lit("terminal '"), F.col("child"), F.lit("' has "), F.size("parents").cast("string"), F.lit(" airRef parents: "), _listed(F.col("parents")))
    findings = reduce(DataFrame.unionByName, [
        row(unknown, "unknown_node", "error", lost, F.col("labels")),
        row(unknown, "unresolved_endpoint", "review", lost, F.col("labels")),
        row(unsure, "ambiguous_node", "error", torn, both),
        row(unsure, "endpoint_resolution_conflict", "review", torn, both),
        row(ref_sanity(ends.where("status = 'resolved'"), equipment), "ref_type_sanity", "error", sane, one("name")),
        row(review_items(edges), "review_item", "review", item, F.array(strip(F.col("child")), strip(F.col("parent")))),
        row(multiple_parents(good), "multiple_air_parents", "error", several, one("child")),
        row(cycle_nodes(good, save), "cycle", "error", F.concat(F.lit("node participates in a parent cycle: "), F.col("node")), one("node")),
        row(orphans(good, equipment), "orphan_terminal", "orphan", F.concat(F.lit("terminal '"), F.col("name"), F.lit("' ("), F.col("type"), F.lit(") has no airRef parent")), one("name")),
    ])
    return Validation(findings, ends, good, edges, equipment)


COUNTS = ["edge_count", "accepted_edge_count", "equipment_count", "alias_resolution_count", "unresolved_endpoint_count", "ambiguous_endpoint_count", "error_count", "orphan_count", "review_item_count"]


def report(v: Validation) -> DataFrame:
    """The ten counts of a report, one row for each scope that has edges or equipment, or one row in all. A scope passes without errors and
    orphans; review items alone don't fail it."""
    scope, sev, one = scope_of(v.edges), F.col("severity"), F.lit(1)
    issues = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("identity")))
    parts = [
        v.edges.groupBy(*scope).agg(F.count(one).alias("edge_count")),
        v.good.groupBy(*scope).agg(F.count(one).alias("accepted_edge_count")),
        v.equipment.groupBy(*scope).agg(F.count_distinct("name").alias("equipment_count")),
        v.ends.groupBy(*scope).agg(
            F.count_if(F.col("used_alias") & (F.col("status") == "resolved")).alias("alias_resolution_count"),
            issues("unresolved").alias("unresolved_endpoint_count"), issues("ambiguous").alias("ambiguous_endpoint_count"),
        ),
        v.findings.groupBy(*scope).agg(*[F.count_if(sev == s).alias(c) for s, c in (("error", "error_count"), ("orphan", "orphan_count"), ("review", "review_item_count"))]),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = every.groupBy(*scope).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    return counts.withColumn("passed", (F.col("error_count") == 0) & (F.col("orphan_count") == 0))


def report_document(v: Validation) -> DataFrame:
    """The report as a JSON document for each scope: its counts, and the findings by severity, in order. For graphs of a floor's size: a
    document is one row; the tables stay the primary form."""
    lists, scope = {"errors": "error", "orphans": "orphan", "review_items": "review"}, scope_of(v.edges)
    body = v.findings.groupBy(*scope).agg(*[F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("check_id", "message", "nodes", "severity")))).alias(k) for k, s in lists.items()])
    d = report(v)
    d = d.join(body, scope, "left") if scope else d.withColumn("_one", F.lit(1)).join(body.withColumn("_one", F.lit(1)), "_one").drop("_one")
    none = F.array().cast(body.schema["errors"].dataType)
    d = d.withColumns({k: F.coalesce(k, none) for k in lists})
    return d.select(*scope, F.to_json(F.struct(*sorted(c for c in d.columns if c not in scope))).alias("document"))


def node_set(edges: DataFrame) -> DataFrame:
    """Every name at an end of an edge, once for each scope."""
    return edges.select(*scope_of(edges), F.explode(F.array("child", "parent")).alias("node")).where("node <> ''").distinct()
