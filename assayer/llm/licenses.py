"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

Native DataFrame operators only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, settled

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label; a phrase counts where its words stand consecutively
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    """A notice. Its words, as a set, are sought in every block. A block gets the label if some run of its words, not much longer
    than the notice, holds enough of them, all of ``must`` in that order, and none of ``barred``: what tells licenses apart whose notices are
    nearly the same set of words counts where it stands among the notice's own words, and nowhere else."""

    label: str
    notice: str
    must: str
    barred: str = ""

    @property
    def words(self) -> list[str]:
        return sorted(set(self.notice.split()))

    @property
    def length(self) -> int:
        return len(self.notice.split())

    @property
    def reach(self) -> int:
        """The longest run that still reads as the notice: a few words may stand between its own."""
        return self.length + max(3, self.length // 4)


_CC = "noncommercial sharealike noderivatives noderivs nc sa nd"
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted software"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    Template("cc-by", "licensed under cc by 4 0", "cc by", _CC),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc nc", "sa nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc sa", "nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc nd", "nc"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc nc sa"),
    Template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc nc nd"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution", _CC),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial", "sharealike noderivatives noderivs"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons sharealike", "noncommercial"),
    Template("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", "creative commons noderivatives", "noncommercial"),
    Template("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international license", "creative commons noncommercial sharealike"),
    Template("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons noncommercial noderivatives"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license", "lesser library affero"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license", "lesser library affero"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license", "lesser library affero"),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser public license"),
    Template("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser public license"),
    Template("gpl", "or the gnu general public license version 3", "gnu general public license", "lesser library affero"),
    Template("lgpl", "or the gnu lesser general public license version 3", "gnu lesser public license"),
    Template("agpl", "licensed under the gnu affero general public license version 3", "gnu affero public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution permitted conditions"),
)
THRESHOLD = 0.9


def _need(t: Template, threshold: float) -> int:
    return math.ceil(threshold * len(t.words) - 1e-9)


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does the same for every text without the two letters whose lower case is, or begins
    with, an ASCII letter; it changes other letters outside ASCII, which no phrase or template holds."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit("\u212a")) | F.contains(t, F.lit("\u0130")), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))


def spaced(low: Column) -> Column:
    """Words joined by one blank."""
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def _blanks(c: Column) -> Column:
    return (F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _phrase_columns(s: Column, n: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word, base_labels of a text ``s`` of ``n`` words."""
    # every word gets blanks of its own, so that neighbouring places of a phrase share none
    t, none = F.concat(F.lit("  "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit("  ")), F.lit(None).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        p, size = f" {phrase.replace(' ', '  ')} ", len(phrase.split())
        has = F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(f" {phrase} "))
        gone = F.char_length(t) - F.char_length(F.replace(t, F.lit(p), F.lit("")))
        counts.append(F.when(has, (gone / len(p)).cast("long")).otherwise(0))
        before = F.substring(t, F.lit(1), F.instr(t, p) - 1)
        firsts.append(F.when(has, ((_blanks(before) - 1) / 2).cast("long")).otherwise(none))
        after = F.substring(F.reverse(t), F.lit(1), F.instr(F.reverse(t), p[::-1]) - 1)
        lasts.append(F.when(has, n - size - ((_blanks(after) - 1) / 2).cast("long")).otherwise(none))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts) if len(firsts) > 1 else firsts[0],
        "last_word": F.greatest(*lasts) if len(lasts) > 1 else lasts[0],
        "base_labels": F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def read_texts(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One pass over the texts, kept: row, doc_id, the phrase columns, ``held`` (the template words of the text), and the
    words joined by blanks where all of them together could satisfy a template, else null."""
    vocabulary = sorted({w for t in templates for w in [*t.words, *t.must.split(), *t.barred.split()]})
    d = docs.select("doc_id", spaced(lowered(F.col("text"))).alias("s"))
    d = d.withColumn("n_words", F.when(F.col("s") == "", 0).otherwise(_blanks(F.col("s")) + 1).cast("long"))
    d = d.withColumn("held", F.array_intersect(F.split("s", " "), F.array(*map(F.lit, vocabulary))))
    could = F.lit(False)
    for t in templates:
        could = could | (F.size(F.array_intersect("held", F.array(*map(F.lit, t.words)))) >= _need(t, threshold))
    columns = _phrase_columns(F.col("s"), F.col("n_words"), phrases)
    d = d.select("doc_id", "n_words", *[c.alias(k) for k, c in columns.items()], "held", F.when(could, F.col("s")).alias("s"))
    return settled(d.withColumn("row", F.monotonically_increasing_id()))


def _runs(words: Column, templates: list[Template], threshold: float) -> Column:
    """(length, block, ws, cut) of the blocks that hold words enough for one of ``templates``, which are of one length: their distinct
    template words, and all their words in order."""
    length, least = templates[0].length, min(_need(t, threshold) for t in templates)
    own = F.array(*map(F.lit, sorted({w for t in templates for w in [*t.words, *t.must.split(), *t.barred.split()]})))
    every = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / length).cast("int"))
    held = lambda c: F.array_intersect(F.slice(words, c * length + 1, 2 * length), own)
    cut = F.transform(every, lambda c: F.struct(F.lit(length).alias("length"), c.alias("block"), held(c).alias("ws")))
    kept = F.filter(cut, lambda b: F.size(b["ws"]) >= least)
    whole = lambda c: F.slice(words, c * length + 1, 2 * length).alias("cut")
    return F.transform(kept, lambda b: F.struct(b["length"].alias("length"), b["block"].alias("block"), b["ws"].alias("ws"), whole(b["block"])))


def template_blocks(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block of a text of ``read_texts`` that holds at least ``threshold`` of the distinct words of a template.

    The blocks of a template of L words are runs of 2 L words that begin at every Lth word, whatever lines they stand in, so L
    words in a row always stand in one of them. Exact: the template's words are ordered by their frequency over all texts,
    rarest first. A block that reaches the overlap ``need = ceil(threshold * size)`` must share one of the
    template's first ``size - need + 1`` words (prefix filter), have ``need`` words at all (length filter), and leave
    enough words after the shared one on both sides (positional filter). What is left is counted.
    The statistics gathered are one count for each distinct template word.
    ``shortest`` is the length of the shortest run in the block that reads as the notice (see ``Template``), null where none does.
    Returns row, block (its number), template, label, containment, length, shortest.
    """
    vocabulary = sorted({w for t in templates for w in [*t.words, *t.must.split(), *t.barred.split()]})
    seen = texts.select(F.explode("held").alias("w")).groupBy("w").count().collect()  # <= size of the templates' vocabulary
    often = {r["w"]: r["count"] for r in seen}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    prefixes = []
    for k, t in enumerate(templates):
        order, need = sorted(rank[w] for w in t.words), _need(t, threshold)
        must, barred = ([rank[w] for w in ws.split()] for ws in (t.must, t.barred))
        prefixes += [(t.length, r, k, t.label, p, len(order), need, t.reach, order, must, barred) for p, r in enumerate(order[: len(order) - need + 1])]
    prefix = texts.sparkSession.createDataFrame(
        prefixes, "length int, r int, template int, label string, p int, size int, need int, reach int, ranks array<int>, must array<int>, barred array<int>"
    )
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    words = F.split("s", " ")
    runs = F.concat(*[_runs(F.col("ws"), [t for t in templates if t.length == n], threshold) for n in sorted({t.length for t in templates})])
    blocks = texts.where("s IS NOT NULL").select("row", words.alias("ws")).select("row", F.explode(runs).alias("b")).select("row", "b.length", "b.block", "b.ws", "b.cut")
    ordered = blocks.select("row", "length", "block", F.array_sort(F.transform("ws", lambda w: ranks[w])).alias("rs"), F.transform("cut", lambda w: F.coalesce(ranks[w], F.lit(-1))).alias("cut"))
    probes = ordered.select("row", "length", "block", "rs", "cut", F.posexplode("rs").alias("q", "r"))
    left = F.least(F.col("size") - F.col("p"), F.size("rs") - F.col("q"))
    # runs begin and end anywhere in the block; those of up to ``reach`` words are tried
    shortest = F.expr("""array_min(flatten(transform(filter(sequence(1, size(cut)), p -> array_contains(ranks, cut[p - 1])), p -> filter(sequence(need, reach), n ->
      p + n - 1 <= size(cut) AND size(array_intersect(slice(cut, p, n), ranks)) >= need AND array_min(transform(must, m -> array_position(slice(cut, p, n), m))) > 0
      AND array_sort(transform(must, m -> array_position(slice(cut, p, n), m))) = transform(must, m -> array_position(slice(cut, p, n), m)) AND NOT arrays_overlap(slice(cut, p, n), barred)))))""")
    return (
        probes.join(F.broadcast(prefix), ["length", "r"])
        .where((F.size("rs") >= F.col("need")) & (left + F.least("p", "q") >= F.col("need")))
        .withColumn("overlap", F.size(F.array_intersect("rs", "ranks")))
        .where("overlap >= need")
        .dropDuplicates(["row", "block", "template"])
        .select("row", "block", "template", "label", (F.col("overlap") / F.col("size")).alias("containment"), "length", shortest.alias("shortest"))
    )


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: phrase places, and the labels of phrases and of template blocks.

    A template's label holds where a run of a block reads as its notice. ``score`` is 1 where a phrase stands, else the best
    containment of such a block, times the notice's length by the run's where that is longer, else 0. Texts are read and
    cut into words once. Null or empty text: no words, no labels, score 0. Repeated rows, and rows that share a ``doc_id``
    or have none, are each judged by their own text. Other columns are ignored. Very long texts are scanned whole.
    """
    texts = read_texts(docs.select("doc_id", "text"), phrases, templates, threshold)
    found = (
        template_blocks(texts, templates, threshold).where("shortest IS NOT NULL")
        .withColumn("containment", F.col("containment") * (F.col("length") / F.greatest("length", "shortest")))
        .groupBy("row").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    )
    every = F.sort_array(F.array_union("base_labels", F.coalesce("_labels", F.array().cast("array<string>"))))
    return (
        texts.drop("s", "held").join(found, "row", "left")
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.array_join("base_labels", ",").alias("base_labels"),
            F.array_join(every, ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        )
    )


def oracle_sql(phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by brute force, for DuckDB: every block against every template of its length."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = lambda ws: "[" + ", ".join(repr(w) for w in ws) + "]::VARCHAR[]"
    rows = ", ".join(f"('{t.label}', {t.length}, {listed(t.words)}, {_need(t, threshold)}, {t.reach}, {listed(t.must.split())}, {listed(t.barred.split())})" for t in templates)
    said = ", ".join(f"('{label}', string_split('{p}', ' '), {len(p.split())})" for p, label in phrases.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT id, doc_id, regexp_extract_all(low, '{word}') AS ws FROM d),
phrases(label, ps, n) AS (VALUES {said}),
places AS (
  SELECT id, label, i - 1 AS pos FROM (
    SELECT w.id, p.label, p.ps, p.n, w.ws, unnest(range(1, len(w.ws) - p.n + 2)) AS i FROM w, phrases p
    WHERE list_has_all(w.ws, p.ps)
  ) WHERE ws[i:i + n - 1] = ps),
base AS (SELECT id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY id),
templates(label, size, ts, need, reach, must, barred) AS (VALUES {rows}),
blocks AS (SELECT id, size, ws[p + 1:p + 2 * size] AS bs FROM (
  SELECT id, ws, size, unnest(range(0, len(ws), size)) AS p FROM w, (SELECT DISTINCT size FROM templates) WHERE list_has_any(ws, (SELECT list(DISTINCT m) FROM (SELECT unnest(must) AS m FROM templates))))),
told AS MATERIALIZED (SELECT b.id, b.bs, t.* FROM blocks b JOIN templates t USING (size) WHERE list_has_all(b.bs, t.must)),
near AS (SELECT * FROM (SELECT *, len(list_intersect(bs, ts)) AS k FROM told) WHERE k >= need),
runs AS (SELECT *, unnest(range(0, len(bs))) AS p FROM near),
cuts AS (SELECT id, label, size, ts, need, must, barred, k, n, bs[p + 1:p + n] AS c FROM (SELECT *, unnest(range(need, reach + 1)) AS n FROM runs WHERE list_contains(ts, bs[p + 1])) WHERE p + n <= len(bs)),
found AS (
  SELECT id, list(DISTINCT label) AS ls, max((k::DOUBLE / len(ts)) * (size::DOUBLE / greatest(size, n))) AS best FROM cuts
  WHERE len(list_intersect(c, ts)) >= need AND list_has_all(c, must) AND NOT list_has_any(c, barred)
    AND list_sort(list_transform(must, lambda m: list_position(c, m))) = list_transform(must, lambda m: list_position(c, m)) GROUP BY id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.ls, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []::VARCHAR[]), coalesce(found.ls, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(found.best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (id) LEFT JOIN found USING (id)"""
