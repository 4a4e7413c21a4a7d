"""Whether two titles are of one work: keys, containment, and the ratio of matching blocks, in Arrow batches where bounds leave it open."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least ratio of two titles of one work. Fixed value.
ALIKE = 0.75


def title_key(text: str | None) -> str:
    """NFKC, lower case, words joined by single spaces."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text or "").lower()))


def keyed(rows: DataFrame, title: str, name: str = "title_key") -> DataFrame:
    """`rows` with the title's key, made once for each row in Arrow batches; empty for null titles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(title)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([title_key(x) for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` string")


def matched(pairs: DataFrame, least: float = ALIKE) -> DataFrame:
    """pairs(..., a, b), keys of titles -> the pairs of one work, with `ratio`: one key contains the other (1), or their matching blocks are `least` of both.

    Twice the shorter length over both bounds the ratio: pairs beyond are dropped before any leave the JVM. The others are told by the standard matcher, first by its bound
    from the characters, then by its blocks, a row at a time in Arrow batches. Empty keys match none.
    """
    a, b = F.col("a"), F.col("b")
    open_ = pairs.where((a != "") & (b != "")).withColumn("inside", F.contains(a, b) | F.contains(b, a))
    open_ = open_.where(F.col("inside") | (2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = []
            for x, y, inside in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "inside")), strict=True):
                match = None if inside else SequenceMatcher(None, x, y)
                ratios.append(1.0 if match is None else match.ratio() if match.quick_ratio() >= least else 0.0)
            told = batch.drop_columns(["inside"])
            yield pa.RecordBatch.from_arrays([*told.columns, pa.array(ratios, pa.float64())], [*names, "ratio"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return open_.select(*names, "inside").mapInArrow(run, f"{kinds}, ratio double").where(F.col("ratio") >= least)
