"""Whole stages: tables in, tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, images, points, reconcile, responses
from ..sources import readers


def building(topics: DataFrame, drawings: DataFrame, contested: DataFrame | None = None, edges: DataFrame | None = None, *, seq) -> dict[str, DataFrame]:
    """Reconcile, name, grade; with edges also the refs. ``seq`` gives the named rows their order column."""
    normalized = reconcile.reconcile(topics, drawings, contested)
    named = reconcile.canonicalize(normalized)
    if edges is not None:
        named = reconcile.fold_refs(named.withColumn("seq", seq), edges)
    return {"normalized": normalized, "canonical": named, "report": reconcile.gap_report(named)}


def evidence_to_edges(pages: DataFrame, seq, secondary: DataFrame | None = None, floor: str = "2") -> dict[str, DataFrame]:
    evidence = graph.flatten_pages(pages).withColumn("seq", seq)
    edges = graph.fuse(evidence, floor)
    if secondary is not None:
        edges = graph.merge_secondary(edges, secondary)
    return {"evidence": evidence, "edges": edges, "notes": graph.review_notes(evidence)}


def runs_to_rows(runs: DataFrame) -> dict[str, DataFrame]:
    d = responses.parsed(runs)
    return {"runs": d, "rows": responses.flattened(d)}


def topics_to_units(names: DataFrame, parse: Callable[[DataFrame], DataFrame], *, strict: bool = True, save=None) -> dict[str, DataFrame]:
    """names(property_id, floor, topic_name) grouped by ``parse`` into units (property_id, floor, raw_label, equipment_type, source_topics,
    review_required, review_reason), then checked: ``coverage`` has the names that no unit or several units were given and those that
    don't exist, scope by scope; ``units`` are flagged by the paths of their own names.

    With ``strict``, any row of ``coverage`` is an error. ``save`` stores what ``parse`` gives, which is read twice.
    """
    parsed = save(parse(names)) if save else parse(names)
    told = F.to_json(F.struct("property_id", "floor", "topic_name"))
    given = parsed.select("property_id", "floor", F.explode("source_topics").alias("topic_name"))
    odd = points.coverage(names.select(told.alias("_name")), given.select(told.alias("_name")), "_name")
    back = F.from_json("value", "property_id string, floor string, topic_name string")
    odd = odd.select("kind", "n", back.alias("_v")).select("_v.*", "kind", "n")
    if strict and (bad := odd.limit(5).collect()):
        raise readers.ContractError("; ".join(f"{r['kind']} topic {r['topic_name']!r} of {r['property_id']}/{r['floor']}" for r in bad))
    return {"units": points.path_checked(parsed), "coverage": odd}


def folder_to_records(spark, path: str, prefix: str, listing: DataFrame, glob: str | None = None) -> dict[str, DataFrame]:
    """The files under a folder as an inventory with the plan of their raw copy, and the images among them by the quality gate: frames
    prepared, failures, deferred, unsupported (``images.prepared``), each with relative_path, size, SHA-256, object_key and plan_status.

    Sizes of PNG files are read from their first bytes; others have none, and fail with a reason. Paths are relative to ``path``.
    """
    files = readers.files(spark, path, glob)
    wide, high = images.png_size(F.col("content"))
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = "/" + path.split(":", 1)[-1].strip("/") + "/"
    relative = F.when(at.startswith(root), F.substring(at, F.lit(len(root) + 1), F.length(at))).otherwise(at)
    sized = files.select(F.col("path"), relative.alias("relative_path"), wide.alias("width"), high.alias("height"))
    found = images.manifest(files).join(sized, "path").drop("path")
    plan = images.preservation_plan(found.select("relative_path", "file_type"), listing, prefix)
    return images.prepared(images.with_plan(found, plan))
