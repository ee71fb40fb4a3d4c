"""Mixing of sources to target weights by temperature, and its realisation as budgeted block permutations.

Native DataFrame operators only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled

#: share of the largest possible entropy, log(number of sources)
TARGET_ENTROPY = 0.97
#: most often that a source's tokens may be repeated; None: no limit
MAX_REPEATS = 4.0
BLOCKS = 64
STEPS = 40
#: a source's documents are dealt to buckets of at most about so many
BUCKET_DOCS = 512
#: a plan of at most so many sources (some 10 MB) is broadcast; a larger one is joined by a shuffle
BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Runs of characters other than blank and the control characters 9 to 13; null has none."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, r"[\x20\x09-\x0D]+")).cast("long")
    ends = F.when(t.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(t == "", 0).otherwise(pieces - ends).cast("long")


def mixing_weights(
    sources: DataFrame,
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    budget_tokens: int | None = None,
) -> DataFrame:
    """``sources(source, n_docs, n_tokens)`` gains exponent, weight (sum 1) and budget (tokens).

    Weights are ``share ** exponent``, normalised. The exponent, between 0 (all alike) and 1 (as they are), is the
    largest whose entropy reaches ``target_entropy * log(sources)``; entropy falls as it grows, so it is
    bisected. Then it is raised, where it must be, to the least exponent at which no source is repeated more than
    ``max_repeats`` times. It is rounded to six places. The table has one row per source.
    The budgets divide ``budget_tokens``; where none is given, the least number of tokens with which no source loses a
    document: the most down-weighted source is then taken once. Sources without tokens get weight 0.
    """
    one = sources.agg(
        F.sort_array(F.collect_list(F.when(F.col("n_tokens") > 0, F.col("n_tokens").cast("double")))).alias("ts"),
        F.sum("n_tokens").cast("double").alias("total"),
    ).withColumn("ps", F.expr("transform(ts, t -> t / total)"))
    bisect = """aggregate(sequence(1, {n}), named_struct('lo', 0D, 'hi', 1D), (s, i) ->
        CASE WHEN {test} THEN named_struct('lo', {yes_lo}, 'hi', {yes_hi}) ELSE named_struct('lo', {no_lo}, 'hi', {no_hi}) END)"""
    mid = "((s.lo + s.hi) / 2)"
    z = f"aggregate(ps, 0D, (a, p) -> a + pow(p, {mid}))"
    entropy = f"(ln({z}) - aggregate(ps, 0D, (a, p) -> a + pow(p, {mid}) * {mid} * ln(p)) / {z})"
    # the smallest source is the one repeated most
    most = f"pow(ps[0] / ps[size(ps) - 1], {mid} - 1)" if budget_tokens is None else f"(pow(ps[0], {mid} - 1) / {z} * {budget_tokens}D / total)"
    up = dict(n=STEPS, yes_lo=mid, yes_hi="s.hi", no_lo="s.lo", no_hi=mid)
    down = dict(n=STEPS, yes_lo="s.lo", yes_hi=mid, no_lo=mid, no_hi="s.hi")
    alpha = F.lit(1.0)
    if target_entropy is not None:
        alpha = F.expr(bisect.format(test=f"{entropy} >= {target_entropy}D * ln(size(ps))", **up) + ".lo")
    if max_repeats is not None:
        least = F.expr(bisect.format(test=f"{most} <= {max_repeats}D", **down) + ".hi")
        alpha = F.greatest(alpha, least) if target_entropy is not None else least
    one = one.select("total", "ps", F.round(F.when(F.size("ps") > 1, alpha).otherwise(1.0), 6).alias("exponent"))
    r = one.select("total", "exponent", F.expr("aggregate(ps, 0D, (a, p) -> a + pow(p, exponent))").alias("z")).first()  # three numbers
    total, exponent, z = (float(r[c] or 0.0) for c in ("total", "exponent", "z"))
    share = F.col("n_tokens") / F.lit(total)
    weight = F.when(F.col("n_tokens") > 0, F.round(F.pow(share, F.lit(exponent)) / F.lit(z), 9)).otherwise(0.0)
    out = sources.select("source", "n_docs", "n_tokens", F.lit(exponent).alias("exponent"), weight.alias("weight"))
    if budget_tokens is None:
        budget_tokens = out.where("weight > 0").agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0.0
    return out.withColumn("budget", F.ceil(F.round(F.col("weight") * F.lit(float(budget_tokens)), 3)).cast("long"))


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    blocks: int = BLOCKS,
    seed: int = 7,
    budget_tokens: int | None = None,
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """The mixed corpus as places: source, doc_id, epoch, n_tokens, start, block, rank_key, and how often the row stands.

    Each source fills its budget from whole permutations of its documents (epochs 0, 1, ...), each ordered by a hash
    of seed, epoch and doc_id; the last one ends with the document that reaches the budget. ``start`` counts
    the source's tokens before the place; ``block`` is ``start`` in ``blocks``ths of the budget, so every block
    holds each source by its weight. Order within a block is that of ``rank_key``.

    Positions are prefix sums in three levels, by the digits of the hash: tokens of a source's heads (the first half of a
    bucket's digits), of buckets of at most about ``bucket_docs`` documents inside a head, and of documents inside a bucket. So a source
    with a third of all rows is dealt over many tasks, and no window holds more than about the root of its buckets.
    A null source counts as the source ''; documents without words stand at no budget and come once in epoch 0;
    rows that share a doc_id are kept apart by their token count and counted as one place each.
    Empty input gives no rows. Other columns are ignored.
    """
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    d = settled(d)  # texts are read once; what follows works on ids and counts
    per = settled(d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    few = per.count() <= BROADCAST_SOURCES
    plan = mixing_weights(per, target_entropy, max_repeats, budget_tokens).select(
        "source", "budget", "weight", "exponent", F.col("n_tokens").alias("have"),
        F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("n_docs") / float(bucket_docs)))).cast("int").alias("digits"),
        F.when(F.col("n_tokens") > 0, F.ceil(F.col("budget") / F.col("n_tokens"))).otherwise(1).cast("long").alias("epochs"),
    )
    laid = (
        d.join(F.broadcast(plan) if few else plan, "source")
        .withColumn("epoch", F.explode(F.expr("sequence(0L, greatest(epochs, 1L) - 1L)")))
        .withColumn("rank_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
        .withColumn("bucket", F.expr("substring(rank_key, 1, digits)"))
        .drop("epochs", "digits")
    )
    before = lambda w: F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = (
        laid.groupBy("source", "epoch", "bucket")
        .agg(F.sum("n_tokens").alias("_in"))
        .withColumn("head", F.expr("substring(bucket, 1, int((length(bucket) + 1) / 2))"))
    )
    heads = buckets.groupBy("source", "epoch", "head").agg(F.sum("_in").alias("_in"))
    heads = heads.select("source", "epoch", "head", before(Window.partitionBy("source", "epoch").orderBy("head")).alias("_ahead"))
    offsets = (
        buckets.withColumn("_near", before(Window.partitionBy("source", "epoch", "head").orderBy("bucket")))
        .join(heads, ["source", "epoch", "head"])
        .select("source", "epoch", "bucket", (F.col("_ahead") + F.col("_near")).alias("_before"))
    )
    inside = (
        Window.partitionBy("source", "epoch", "bucket")
        .orderBy("rank_key", "doc_id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        laid.withColumn("_own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(offsets, ["source", "epoch", "bucket"])
        .withColumn("start", (F.col("epoch") * F.col("have") + F.col("_before") + F.col("_own")).cast("long"))
    )
    kept = placed.where("start < budget OR (epoch = 0 AND n_tokens = 0)")
    block = F.when(F.col("budget") > 0, F.least(F.lit(blocks - 1), F.floor(F.col("start") * blocks / F.col("budget")))).otherwise(0)
    return kept.select(
        "source", "doc_id", F.col("epoch").cast("long"), "n_tokens", "start", block.cast("long").alias("block"), "rank_key", "weight"
    )


def oracle_sql(target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: int = 7) -> str:
    """The same places for DuckDB, with plain windows and a recursive bisection."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
per AS (SELECT source, sum(n_tokens)::BIGINT AS have FROM d GROUP BY source),
ps AS (SELECT source, have, have / (SELECT sum(have) FROM per)::DOUBLE AS p FROM per WHERE have > 0),
up(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) >= {target_entropy} * ln(count(*)) FROM ps) AS ok FROM up WHERE i < {STEPS})),
down(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT i, lo, hi, (SELECT pow(min(p) / max(p), (lo + hi) / 2 - 1) <= {max_repeats} FROM ps) AS ok FROM down WHERE i < {STEPS})),
a AS (SELECT CASE WHEN (SELECT count(*) FROM ps) > 1 THEN round(greatest((SELECT max(lo) FROM up), (SELECT min(hi) FROM down)), 6) ELSE 1.0 END AS e),
ws AS (SELECT source, have, round(pow(p, e) / (SELECT sum(pow(p, e)) FROM ps), 9) AS weight FROM ps, a),
plan AS (SELECT per.source, per.have, coalesce(weight, 0.0) AS weight, coalesce(ceil(round(weight * (SELECT max(have / weight) FROM ws WHERE weight > 0), 3)), 0)::BIGINT AS budget FROM per LEFT JOIN ws USING (source)),
laid AS (SELECT source, doc_id, n_tokens, have, budget, weight, e.epoch, md5(concat_ws(':', '{seed}', e.epoch::VARCHAR, coalesce(doc_id::VARCHAR, '-'))) AS rank_key
  FROM d JOIN plan USING (source) JOIN (SELECT unnest(range(0, 1000)) AS epoch) e ON e.epoch = 0 OR e.epoch * have < budget),
placed AS (SELECT *, (epoch * have + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY rank_key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM laid)
SELECT source, doc_id, epoch::BIGINT AS epoch, n_tokens, start, CASE WHEN budget > 0 THEN least({blocks - 1}, floor(start * {blocks} / budget::DOUBLE))::BIGINT ELSE 0 END AS block, rank_key, weight
FROM placed WHERE start < budget OR (epoch = 0 AND n_tokens = 0)"""
