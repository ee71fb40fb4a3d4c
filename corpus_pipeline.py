"""The corpus pipeline: toxic documents go, one of each group of near copies stays, documents that hold benchmark items
go, and the rest is mixed to target weights.

Each stage takes (spark, docs, sf_dir), works on every row of docs, and returns a DataFrame; all but the last
return the columns of docs. A stage's result is written as Parquet and read again as the next one's docs.
Null, empty and very long texts, repeated rows, empty tables and further columns pass through as the stages' operators
say: null and empty texts are clean and copies of each other, so one of them stays; rows without a doc_id are kept by every stage.
"""

from __future__ import annotations

import os
import uuid

from assayer.llm import common, decontaminate, mixing, neardup, toxicity


def clean(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def dedupe(spark, docs, sf_dir):
    return neardup.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    return mixing.mix_sources(docs)


STAGES = [("toxicity", clean), ("near_dedup", dedupe), ("decontamination", decontaminated), ("mixing", mix)]

#: the first stage is a fitted model, which SQL can't express
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents. Between them, tables stand in a folder of ``spark.checkpoint.dir``; each goes
    when the next one is written, and the last one stays for the result to be read from."""
    base = os.path.join(common.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            if before:
                common.removed(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
