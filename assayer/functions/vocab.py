"""Equipment types and canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import append_reason, canonical_key, let, strip, type_prefix

# The official type keys.
LIBRARY_TYPES = (
    "AHU", "DOAS", "MAU", "FCU",
    "VAV", "VAV-RH-HW", "VAV-RH-ELEC", "FPTU-PARALLEL-HW", "FPTU-SERIES-HW", "FPTU-PARALLEL-ELEC", "FPTU-SERIES-ELEC",
    "OAVAV", "OAVAV-RH-HW", "OAVAV-RH-ELEC", "EAVAV",
    "CHILLER", "CHW-PUMP", "COOLING-TOWER", "COND-PUMP", "BOILER", "HW-PUMP", "ERV",
)
PLANT_CONTAINERS = ("CHW-PLANT", "HW-PLANT", "COND-PLANT")
OFFICIAL_TYPES = LIBRARY_TYPES + PLANT_CONTAINERS

# Reasons attached to ambiguous raw types.
VAVRH_REASON = "reheat source assumed hot-water (supervisor: VAVRH most commonly HW); confirm against VAV-RH-ELEC"
FPTU_REASON = (
    "FPTU subtype unresolved: parallel/series and HW/electric require drawing or schedule evidence "
    "(FPTU-PARALLEL-HW / FPTU-SERIES-HW / FPTU-PARALLEL-ELEC / FPTU-SERIES-ELEC)"
)
AMBIGUOUS_TYPES = {"VAVRH": ("VAV-RH-HW", VAVRH_REASON), "FPTU": ("FPTU", FPTU_REASON)}

AIR_SOURCES = ("AHU", "DOAS", "MAU", "OAVAV")
PLANTS = PLANT_CONTAINERS + ("CHILLER", "BOILER", "COOLING-TOWER", "CHW-PUMP", "COND-PUMP", "HW-PUMP")
# Types whose gaps weigh most.
HIGH_SEVERITY = ("AHU", "DOAS", "MAU") + PLANTS
PASSTHROUGH = ("DOAS", "CHW-PLANT", "HW-PLANT", "COND-PLANT")
REF_TYPES = ("airRef", "chilledWaterRef", "hotWaterRef", "condenserWaterRef", "spaceRef")
#: valid refs without a column of their own
UNCOLUMNED_REFS = ("systemRef", "floorRef")
WATER_REFS = ("chilledWaterRef", "hotWaterRef", "condenserWaterRef")


def mapped_type(raw: Column) -> tuple[Column, Column, Column]:
    """(official type, review flag, reason) of a raw type."""
    key = F.upper(strip(raw))
    kind, reason = F.when(key.isin(*OFFICIAL_TYPES), key), F.when(key.isin(*OFFICIAL_TYPES), "")
    for name, (to, why) in AMBIGUOUS_TYPES.items():
        kind, reason = kind.when(key == name, to), reason.when(key == name, why)
    unknown = F.concat(F.lit("unrecognized raw type '"), F.coalesce(raw, F.lit("")), F.lit("'; not in the current vocabulary"))
    reason = reason.otherwise(unknown)
    return kind.when(key == "", "UNRESOLVED").otherwise(key), reason != "", reason


def padded_unit(unit: Column) -> Column:
    """Last token, if it is a number, with two digits at least."""
    last = F.substring_index(unit, "_", -1)
    head = F.substring(unit, F.lit(1), F.length(unit) - F.length(last))
    return F.when(last.rlike(r"^\d$"), F.concat(head, F.lit("0"), last)).otherwise(unit)


# What is said of names that couldn't be derived cleanly.
INLINE_FLOOR = "floor digit inferred from inline token '"
NO_FLOOR = "could not isolate a floor token; floor assumed from snapshot"
NO_UNIT = "could not derive a unit identifier"
EMPTY_KEY = "empty canonical key"


def named(key: Column, kind: Column, floor: Column) -> Column:
    """struct(name, flag, reason): type_floor-unit, the unit being the key without its type and its floor token.

    Every step is bound once, so the expression grows with the steps and not with their product.
    """
    tokens = F.filter(F.split(F.coalesce(key, F.lit("")), "_"), lambda t: t != "")
    start = F.struct(
        F.coalesce(key, F.lit("")).alias("key"), F.size(tokens).alias("n"), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))).alias("units"),
        kind.alias("kind"), floor.alias("floor"), F.concat(F.lit("0"), floor).alias("padded"),
    )

    def first(units, test):
        found = F.filter(F.transform(units, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(found, F.lit(0)), F.lit(-1))

    def places(s):
        exact = first(s["units"], lambda t: (t == s["floor"]) | (t == s["padded"]))
        inline = first(s["units"], lambda t: t.startswith(s["floor"]) | t.startswith(s["padded"]))
        return let(F.struct(s.alias("s"), exact.alias("exact"), inline.alias("inline")), parts)

    def parts(p):
        s = p["s"]
        token = F.get(s["units"], p["inline"])
        cut = F.when(token.startswith(s["padded"]), F.length(s["padded"])).otherwise(F.length(s["floor"]))
        rest = F.substring(token, cut + 1, F.length(token))
        left = (
            F.when(p["exact"] >= 0, F.filter(s["units"], lambda t, i: i != p["exact"]))
            .when(p["inline"] >= 0, F.filter(F.transform(s["units"], lambda t, i: F.when(i == p["inline"], rest).otherwise(t)), lambda t: t != ""))
            .otherwise(s["units"])
        )
        return let(F.struct(p.alias("p"), token.alias("token"), left.alias("left")), joined)

    def joined(q):
        s, none = q["p"]["s"], F.size(q["left"]) == 0
        unit = let(F.array_join(F.when(none, s["units"]).otherwise(q["left"]), "_"), padded_unit)
        where = (
            F.when(q["p"]["exact"] >= 0, "").when(q["p"]["inline"] >= 0, F.concat(F.lit(INLINE_FLOOR), q["token"], F.lit("'")))
            .otherwise(NO_FLOOR)
        )
        why = append_reason(where, F.when(none, NO_UNIT))
        return let(F.struct(s.alias("s"), unit.alias("unit"), why.alias("why")), whole)

    def whole(r):
        s, empty = r["s"], r["s"]["n"] == 0
        base = F.concat(s["kind"], F.lit("_"), s["floor"])
        name = F.when(empty, s["key"]).when(r["unit"] == "", base).otherwise(F.concat(base, F.lit("-"), r["unit"]))
        why = F.when(empty, EMPTY_KEY).otherwise(r["why"])
        return F.struct(name.alias("name"), (why != "").alias("flag"), why.alias("reason"))

    return let(start, places)


def canonical_name(key: Column, kind: Column, floor: Column) -> tuple[Column, Column, Column]:
    """(name, review flag, reason) of ``named``."""
    n = named(key, kind, floor)
    return n["name"], n["flag"], n["reason"]


def classified(key: Column, raw: Column, floor: Column) -> tuple[Column, Column, Column, Column]:
    """(official type, name, review flag, reason) in one call."""
    kind, flag, why = mapped_type(raw)
    name, named_flag, named_why = canonical_name(key, kind, floor)
    return kind, name, flag | named_flag, append_reason(why, named_why)


def endpoint(label: Column, floor: Column) -> Column:
    """struct(name, flag, reason) of an edge's end; plants and outdoor-air systems keep their own name."""
    own = F.replace(F.replace(F.upper(strip(label)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    kept = let(own, lambda o: F.exists(F.array(*[F.lit(p.replace("-", "_")) for p in PASSTHROUGH]), lambda p: F.startswith(o, p)))
    kind, flag, why = mapped_type(type_prefix(label))
    n = let(
        F.struct(named(canonical_key(label), kind, floor).alias("n"), flag.alias("flag"), why.alias("why")),
        lambda x: F.struct(x["n"]["name"].alias("name"), (x["flag"] | x["n"]["flag"]).alias("flag"), append_reason(x["n"]["reason"], x["why"]).alias("reason")),
    )
    own_name = F.struct(F.replace(strip(label), F.lit(" "), F.lit("_")).alias("name"), F.lit(False).alias("flag"), F.lit("").alias("reason"))
    return F.when(kept, own_name).otherwise(n)


def canonical_endpoint(label: Column, floor: Column) -> tuple[Column, Column, Column]:
    """(name, review flag, reason) of ``endpoint``."""
    e = endpoint(label, floor)
    return e["name"], e["flag"], e["reason"]


def production_identity(name: Column) -> Column:
    """type|key of the rest, so spellings of one unit agree; the key alone where a name has no type."""
    kind = F.substring_index(name, "_", 1)
    rest = canonical_key(F.concat(F.lit("EQUIP_"), F.substring(name, F.length(kind) + 2, F.length(name))))
    tail = F.when(rest.contains("_"), F.substring(rest, F.lit(7), F.length(rest))).otherwise("")
    return F.when(name.contains("_"), F.concat_ws("|", mapped_type(kind)[0], tail)).otherwise(canonical_key(name))


def is_terminal(kind: Column) -> Column:
    k = F.upper(F.coalesce(kind, F.lit("")))
    return k.isin("VAV", "FCU", "OAVAV", "EAVAV", "FPTU") | k.startswith("VAV-RH") | k.startswith("FPTU") | k.startswith("OAVAV")


def is_air_source(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit(""))).isin(*AIR_SOURCES)


def is_plant(kind: Column) -> Column:
    return F.upper(F.coalesce(kind, F.lit(""))).isin(*PLANTS)


def severity(status: Column, kind: Column) -> Column:
    return (
        F.when(status.isin("matched", "type_mismatch", "identifier_mismatch"), "low").when(status == "floor_ambiguous", "medium")
        .when(kind.isin(*HIGH_SEVERITY), "high").otherwise("medium")
    )


# Report status of a category.
CATEGORY_STATUS = {
    "matched": "matched", "topics_only": "missing_from_drawings", "drawing_only": "missing_from_points",
    "type_mismatch": "type_mismatch", "floor_ambiguous": "floor_ambiguous",
}


def report_status(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_STATUS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), F.nullif(category, F.lit("")), F.lit("matched"))


def library_gaps(library: DataFrame) -> DataFrame:
    """Types that a library(type, point_types, equip_tags) has and the vocabulary lacks, and the other way round: (type, missing_from)."""
    known = library.sparkSession.createDataFrame([(t,) for t in LIBRARY_TYPES], "type string")
    own = library.select("type").distinct()
    return own.join(known, "type", "left_anti").withColumn("missing_from", F.lit("vocabulary")).unionByName(known.join(own, "type", "left_anti").withColumn("missing_from", F.lit("library")))
