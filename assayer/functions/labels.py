"""Labels and keys as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def strip_device_prefix(label: Column, any_case: bool = True) -> Column:
    return F.regexp_replace(strip(label), r"(?i)^DEV\d+_" if any_case else r"^DEV\d+_", "")


def _unpadded(t: Column) -> Column:
    return F.when(t.rlike(r"^\d+$"), F.regexp_replace(t, r"^0+(?=\d)", "")).otherwise(t)


def canonical_key(label: Column) -> Column:
    """Upper-case tokens joined by _, digits without leading zeros; null where a label has no token."""
    tokens = F.filter(F.split(F.upper(strip_device_prefix(label)), r"[^0-9A-Za-z]+"), lambda t: t != "")
    return F.nullif(F.array_join(F.transform(tokens, _unpadded), "_"), F.lit(""))


def match_key(label: Column) -> Column:
    """Letter runs and digit runs without device prefix, upper case, unpadded, without separators."""
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), r"^DEV\d+_", "")
    runs = F.regexp_extract_all(F.upper(bare), F.lit(r"([A-Z]+|\d+)"), 1)
    return F.array_join(F.transform(runs, _unpadded), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def append_reason(*parts: Column) -> Column:
    return F.concat_ws("; ", *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts])


def split_list(c: Column, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip), lambda x: x != "")


def join_list(c: Column, sep: str = ";") -> Column:
    return F.array_join(c, sep)


def path_context(path: Column, floor: Column) -> Column:
    """Second part of floor/context/point paths of that floor; null for others."""
    parts = F.split(strip(path), "/")
    context = strip(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == floor) & (context != ""), context)


# Types, tried in this order.
TOPIC_TYPES = ("VAVRH", "OAVAV", "EAVAV", "FPTU", "AHU", "FCU", "VAV")
PREFIX_TYPES = ("VAVRH", "EAVAV", "EVAV", "OAVAV", "FPTU", "FCU", "AHU", "VAV", "DOAS", "IDU", "TF")


def type_contained(label: Column, types=TOPIC_TYPES) -> Column:
    out = F.lit("UNRESOLVED")
    for t in reversed(types):
        out = F.when(F.upper(label).contains(t), F.lit(t)).otherwise(out)
    return out


def squeezed(label: Column) -> Column:
    return F.replace(F.replace(F.upper(F.coalesce(label, F.lit(""))), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))


def type_prefix(label: Column, types=PREFIX_TYPES) -> Column:
    out, key = F.lit("UNRESOLVED"), squeezed(label)
    for t in reversed(types):
        out = F.when(key.startswith(t), F.lit("EAVAV" if t == "EVAV" else t)).otherwise(out)
    return out


def type_base(t: Column) -> Column:
    return F.upper(F.get(F.split(strip(t), "[-_]"), F.lit(0)))


def widget_kind(label: Column) -> Column:
    key = squeezed(label)
    return (
        F.when(key.startswith("AHU"), "linked_widget_ahu").when(key.startswith("OAVAV"), "linked_widget_oavav")
        .when(key.startswith("DOAS"), "linked_widget_doas").otherwise("linked_widget_other")
    )


def relationship_key(child: Column, ref: Column, parent: Column) -> Column:
    return F.concat_ws("|", child, ref, parent)


def floor_digits(floor: Column) -> Column:
    """Floor number without padding, or null."""
    return F.regexp_replace(floor, r"\D", "").try_cast("int").cast("string")


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext.isin("png", "pdf", "csv", "json", "parquet"), ext).otherwise("unsupported")


# Sizes an image must have, and what is said of it.
MIN_LONG_SIDE, MIN_SHORT_SIDE, MANY_PIXELS = 1000, 750, 100_000_000
QUALITY_OK = "Image meets minimum resolution threshold"


def image_quality(width: Column, height: Column) -> tuple[Column, Column]:
    """(passes, reason): long side from 1000, short side from 750; over 100 million pixels with a warning."""
    long, short, pixels = F.greatest(width, height), F.least(width, height), width.cast("long") * height
    bad = width.isNull() | height.isNull()
    small = (long < MIN_LONG_SIDE) | (short < MIN_SHORT_SIDE)
    size = F.concat(F.lit("Image resolution "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" is "))
    passes = F.when(bad, False).otherwise(~small)
    reason = (
        F.when(bad, "Unable to read image file")
        .when(small, F.concat(size, F.lit(f"below minimum threshold: long side must be at least {MIN_LONG_SIDE}px and short side must be at least {MIN_SHORT_SIDE}px")))
        .when(pixels > MANY_PIXELS, F.concat(size, F.lit("valid but unusually large ("), pixels.cast("string"), F.lit(" pixels) and may require resizing or tiling before LLM inference")))
        .otherwise(QUALITY_OK)
    )
    return passes, reason


def image_class(pixels: Column) -> Column:
    return F.when(F.coalesce(pixels, F.lit(0)) > 8_000_000, "drawing").otherwise("screenshot")


def object_key(prefix: str, kind: Column, path: Column) -> Column:
    """prefix/kind/path with forward slashes; null for paths that leave the folder or are absolute."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(clean, "/")
    bad = F.exists(parts, lambda p: p == "..") | clean.startswith("/") | (clean == "")
    return F.when(~bad, F.concat_ws("/", F.lit(prefix.strip("/")), kind, clean))


def fingerprint(**parts: Column) -> Column:
    """SHA-256 over named parts, each as label, length in bytes and payload with a zero byte behind each, so that no two lists of
    parts collide by concatenation."""
    zero, framed = F.lit("\0"), []
    for label, c in parts.items():
        text = F.coalesce(c.cast("string"), F.lit(""))
        framed += [F.lit(label), zero, F.octet_length(text).cast("string"), zero, text, zero]
    return F.sha2(F.concat(*framed), 256)


def checkpoint_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def unfenced(text: Column, strict: bool = True) -> Column:
    """Text inside one plain or json code fence, or the text; lenient: fence lines removed wherever they are."""
    t = strip(text)
    if not strict:
        return strip(F.regexp_replace(t, r"(?m)^```\w*[ \t]*$", ""))
    inner = F.regexp_extract(t, r"(?s)^```(?:json|JSON)?[ \t]*\n(.*)\n[ \t]*```$", 1)
    return F.when(t.startswith("```"), F.nullif(strip(inner), F.lit(""))).otherwise(F.nullif(t, F.lit("")))


def single_json_object(text: Column) -> Column:
    """Whether the text is one JSON object and nothing behind it (parsers accept trailing text, two wrappings don't)."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    two = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(one & two & F.json_object_keys(text).isNotNull(), F.lit(False))


def tile_starts(total: Column, tile: int, overlap: int) -> Column:
    """Even starts of overlapping tiles that cover a length, half rounded to even."""
    step, span = tile - overlap, total - tile
    n = F.greatest(F.ceil((total - overlap) / step).cast("int"), F.lit(2))
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * span / (n - 1), 0).cast("int"))
    return F.when(total <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(starts))
