"""Column functions on oriented paths such as >a<b>c, and on composed names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = r"([<>])([^<>]+)"


def parse(path: Column) -> Column:
    """array<struct<orient, contig>>"""
    orient = F.regexp_extract_all(path, F.lit(_STEP), F.lit(1))
    return F.zip_with(orient, F.regexp_extract_all(path, F.lit(_STEP), F.lit(2)), lambda o, c: F.struct(o.alias("orient"), c.alias("contig")))


def render(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["orient"], s["contig"])), "")


def flip(steps: Column) -> Column:
    """The same path from its other end."""
    return F.transform(F.reverse(steps), lambda s: F.struct(F.when(s["orient"] == ">", "<").otherwise(">").alias("orient"), s["contig"].alias("contig")))


def window_name(contig: Column, start: Column, group: Column) -> Column:
    """C18"""
    return F.concat_ws("_", contig.cast("string"), start.cast("string"), group.cast("string"))


def chunk_name(contig: Column, number: Column) -> Column:
    """C18"""
    return F.concat_ws("@", contig.cast("string"), number.cast("string"))


def without_copies(name: Column) -> Column:
    """Names without the suffix of their copy."""
    return F.regexp_replace(name, r"-\d+$", "")
