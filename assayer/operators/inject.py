"""Places where users' Python functions run: grouped parsing, extraction of rows, and a ladder of tiers."""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import escalated

#: keys whose merged rows a task holds before it passes them on
HELD = 10_000


def grouped(points: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``fn`` on the points of each key.

    With ``merge``, ``fn`` gets parts of a key's points, a batch at most, and ``merge`` makes one row of a key's rows from ``fn``
    or ``merge``: in each task, then over tasks, so no key has to fit one. Without it a key's points stand in one frame.
    """
    if merge is None:
        return points.groupBy(*keys).applyInPandas(fn, schema)

    def each(d: pd.DataFrame, f) -> pd.DataFrame:
        return pd.concat([f(part) for _, part in d.groupby(keys, dropna=False)], ignore_index=True)

    def run(batches):
        held = None
        for b in batches:
            if len(b):
                own = each(b, fn)
                held = own if held is None else each(pd.concat([held, own], ignore_index=True), merge)
            if held is not None and len(held) > HELD:
                yield held
                held = None
        if held is not None:
            yield held

    return points.mapInPandas(run, schema).groupBy(*keys).applyInPandas(merge, schema)


class FolderLog:
    """Answers by their request key, a small file each, in a folder that all executors share (any file system that pyarrow opens).
    An answer is written before it is passed on, under another name first, so a lost executor leaves whole answers."""

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self, key: str) -> tuple[fs.FileSystem, str]:
        name = hashlib.sha256(key.encode()).hexdigest()
        files, root = fs.FileSystem.from_uri(self.uri)
        return files, f"{root}/{name[:2]}/{name}"

    def get(self, key: str) -> str | None:
        files, path = self._at(key)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, key: str, answer: str) -> None:
        files, path = self._at(key)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        held = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(held) as f:
            f.write(answer.encode())
        files.move(held, path)


def extracted(
    rows: DataFrame, fn: Callable[[dict], str], key: str, *, concurrency: int = 1, tasks: int | None = None, retries: int = 0, pause: float = 0.5,
    log: FolderLog | None = None, request: str | None = None,
) -> DataFrame:
    """``fn`` on each row: key, payload, run_status, error (at most 300 characters); a failure is a row.

    ``fn`` is a function or a coroutine function. A task has ``concurrency`` calls under way at most; with ``tasks``, rows are dealt over
    so many tasks, so ``tasks * concurrency`` bounds all calls together. A call that fails is tried ``retries`` times more, after pauses that
    double. With ``log`` (``get(key)``, ``put(key, answer)``; ``FolderLog`` is one), an answer that stands under the text of the
    column ``request`` (``key`` where it isn't given) isn't asked for again, whether another run left it or a task that was lost;
    failures aren't logged.
    """
    request = request or key

    async def ask(row: dict, gate: asyncio.Semaphore) -> tuple:
        name = str(row[request])
        async with gate:
            if log is not None and (known := await asyncio.to_thread(log.get, name)) is not None:
                return row[key], known, "succeeded", None
            for attempt in range(retries + 1):
                try:
                    answer = await fn(row) if inspect.iscoroutinefunction(fn) else await asyncio.to_thread(fn, row)
                    if log is not None:
                        await asyncio.to_thread(log.put, name, answer)
                    return row[key], answer, "succeeded", None
                except Exception as e:  # noqa: BLE001
                    error = str(e)[:300]
                    if attempt < retries:
                        await asyncio.sleep(pause * 2**attempt)
            return row[key], None, "parse_failure", error

    async def together(part: list[dict]) -> list[tuple]:
        gate = asyncio.Semaphore(concurrency)
        return await asyncio.gather(*[ask(r, gate) for r in part])

    def one(row: dict) -> tuple:
        for attempt in range(retries + 1):
            try:
                return row[key], fn(row), "succeeded", None
            except Exception as e:  # noqa: BLE001
                error = str(e)[:300]
                if attempt < retries:
                    time.sleep(pause * 2**attempt)
        return row[key], None, "parse_failure", error

    def run(batches):
        for b in batches:
            every = b.to_dict("records")
            if plain:
                yield pd.DataFrame([one(row) for row in every], columns=[key, "payload", "run_status", "error"])
                continue
            for at in range(0, len(every), HELD):
                yield pd.DataFrame(asyncio.run(together(every[at : at + HELD])), columns=[key, "payload", "run_status", "error"])

    if concurrency < 1:
        raise ValueError("concurrency must be at least 1")
    # one call at a time of a plain function needs no loop and no threads, which cost more than a small call
    plain = concurrency == 1 and log is None and not inspect.iscoroutinefunction(fn)
    dealt = rows.repartition(tasks) if tasks else rows
    return dealt.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, payload string, run_status string, error string")


def ladder(rows: DataFrame, tiers: list[Callable[[dict], str]], key: str, gate, *, save, **how) -> DataFrame:
    """Tier after tier on what no earlier tier got through the gate; first pass wins, else the last attempt.

    ``save`` computes a frame once (a checkpoint): each tier's answers are kept before they are looked at, so no row is put to
    the same tier twice, and later tiers see the answers that were judged. ``how`` goes to ``extracted``; logged answers are kept apart
    by tier.
    """
    log, request = how.pop("log", None), how.pop("request", None) or key
    left, tries = rows, None
    for k, fn in enumerate(tiers):
        named = left.withColumn("_request", F.concat_ws("|", F.lit(f"tier {k}"), F.col(request).cast("string")))
        got = save(extracted(named if log else left, fn, key, log=log, request="_request" if log else None, **how).select(key, F.lit(k).alias("tier"), F.col("payload").alias("result")))
        tries = got if tries is None else tries.unionByName(got)
        left = left.join(got.where(gate).select(key), key, "left_anti")
    return escalated(tries, key, gate)
