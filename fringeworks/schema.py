"""Table schemas and the logical checks of the data model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT = (1, 0)
_D = "array<double>"
SAMPLES = f"sample_id bigint, time double, wl double, scale double, d {_D}, v_re {_D}, v_im {_D}, uvw {_D}"
SELECTION = "tag string, sample_id bigint, d array<double>"
PIXELS = "pixel_id bigint, l double, m double, n double"
IMAGES = "tag string, pixel_id bigint, value float"
VISIBILITY = "time_id bigint, channel_id bigint, beam_i bigint, beam_j bigint, re double, im double"
ANTENNAS = "station_id bigint, antenna_id bigint, x double, y double, z double"


class FormatError(ValueError):
    """A stored table's version or shape isn't usable."""


def check_version(major: int, minor: int) -> None:
    if major != FORMAT[0] or minor > FORMAT[1]:
        raise FormatError(f"format {major}.{minor} can't be read; this is {FORMAT[0]}.{FORMAT[1]}")


def check_tag(tag: str) -> str:
    if not tag or re.search(r"[/. ]", tag):
        raise ValueError(f"tag {tag!r} must not be empty or hold '/', '.' or spaces")
    return tag


def check_selection(selection: DataFrame, samples: DataFrame, beams: int) -> tuple[list[str], int]:
    """Unique ids per tag, known ids, the same ids under all tags, vectors of one number per beam; one action.

    Returns the tags, of which there is one per image, and the number of samples selected.
    """
    n = F.coalesce(F.size("d"), F.lit(-1))
    per_id = selection.groupBy("sample_id").agg(F.collect_list("tag").alias("tags"), F.max(n).alias("hi"), F.min(n).alias("lo"))
    s = per_id.join(samples.select("sample_id", F.lit(True).alias("known")), "sample_id", "left")
    each = F.size(F.array_distinct("tags"))
    row = s.agg(
        F.max(F.size("tags") - each).alias("twice"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.min(each).alias("least"), F.count("*").alias("count"),
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("unknown"), F.array_distinct(F.flatten(F.collect_set(F.array_sort("tags")))).alias("tags"),
    ).first()
    if not row["count"]:
        return [], 0
    tags = sorted(row.tags)
    if row.twice:
        raise ValueError("a sample id occurs twice under a tag")
    if row.unknown:
        raise ValueError("a selected sample id isn't in the dataset")
    if row.least != len(tags):
        raise ValueError("all tags must select the same samples")
    if row.hi != beams or row.lo != beams:
        raise ValueError(f"selected vectors must hold {beams} eigenvalues")
    return [check_tag(t) for t in tags], row["count"]
