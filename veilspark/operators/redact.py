"""Texts in, findings and masked texts out, over DataFrames.

One Arrow function runs all detectors of a compiled policy: several of them parse
escapes, decode tokens and recurse, which Column expressions can't. The policy is
broadcast (its size is that of its configuration). No shuffle.
Null texts give null outputs and no findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions.formats import detect_format, normalized
from ..policy import Policy
from . import spans
from .detect import Engine

FINDINGS = "array<struct<start:int,end:int,category:string,replacement:string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("replacement", pa.string())]))
#: Rows of a batch that are worked on at once; long texts need few.
SLICE = 256


def redact(df: DataFrame, policy: Policy = Policy(), text: str = "text", output: str = "output") -> DataFrame:
    """``df`` with format, input (readable form of the text), findings (offsets in it) and the masked ``output``.

    Columns of these names are replaced. ``input`` holds what is to be hidden: drop
    it, and the text, before writing (``public``).
    """
    added = ("format", "input", "findings", output)
    base = df.drop(*(c for c in added if c != text)).withColumn("format", detect_format(text))
    handle = df.sparkSession.sparkContext.broadcast(Engine(policy))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "input string", f"findings {FINDINGS}", f"`{output}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = handle.value
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                inputs, found, masked = [], [], []
                for value, kind in zip(batch.column(text).to_pylist(), batch.column("format").to_pylist(), strict=True):
                    if value is None:
                        inputs.append(None), found.append([]), masked.append(None)
                        continue
                    inputs.append(normalized(value, kind))
                    out, own = engine.redact(inputs[-1])
                    found.append([{"start": s.start, "end": s.end, "category": s.category, "replacement": s.replacement} for s in own])
                    masked.append(out)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inputs, pa.string()), pa.array(found, _ARROW), pa.array(masked, pa.string())], names=[*batch.schema.names, "input", "findings", output])

    return base.mapInArrow(run, schema)


def public(redacted: DataFrame, text: str = "text") -> DataFrame:
    """What may be written: without texts and inputs."""
    return redacted.drop("input", text)


def findings(redacted: DataFrame, *keys: str) -> DataFrame:
    """One row a finding, with its original."""
    each = redacted.select(*keys, "input", F.explode("findings").alias("f"))
    return each.select(*keys, "f.*", F.substring("input", F.col("f.start") + 1, F.col("f.end") - F.col("f.start")).alias("original"))


def summary(redacted: DataFrame) -> DataFrame:
    """Findings by category, in the order of categories."""
    each = redacted.select(F.explode("findings.category").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return each.orderBy(spans.priority(F.col("category")))


def most_frequent(redacted: DataFrame) -> DataFrame:
    return redacted.select(F.explode("findings.category").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), spans.priority(F.col("category")))


def summary_line(counts: dict[str, int], profile: str | None = None) -> str:
    """For people: ``3 values masked (2 email, 1 ip)``."""
    total = sum(counts.values())
    listed = ", ".join(f"{counts[c]} {c}" for c in tables.CATEGORIES if counts.get(c))
    return f"{total} value{'s' * (total != 1)} masked" + f" ({listed})" * bool(total) + f" [{profile}]" * (profile is not None)
