"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation gets a rendering of it in which it is the assistant, all others are named
users, and its own texts with their end marks are what is trained on. System turns are rendered as such in all
of them and are nobody's perspective.

A rendering is a run of segments, one per turn, in order; put together they are the rendered text, and
``start`` says where each begins. A conversation may hold much of the table, so it is never gathered: offsets
are running sums over stretches of turns, shifted by the sums of the stretches before.

Defined results: a null role is the participant "unknown"; a null text is empty; turns are ordered by
number (null last), then role, then text; turns without a conversation id form one conversation. Repeated turns
are rendered each. A conversation with system turns alone has no rendering. ``<|`` in texts and names becomes
``< |``, so a text cannot forge a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
STRETCH = 64
ENDING = "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(conversations: DataFrame, system: str = SYSTEM, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, perspective, position, turn, role, segment, start, mask_start, mask_end).

    Offsets count characters of the rendering; the mask bounds are null where nothing is trained on."""
    role = F.coalesce("role", F.lit("unknown"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.filter(F.col("role") != system).select("conv_id", "role").distinct()
    speakers = speakers.select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective"))
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == system, F.lit("<|system|>\n"))
    head = head.otherwise(F.concat(F.lit("<|user name="), _safe(F.col("role")), F.lit("|>\n")))
    seen = seen.withColumns({"own": own, "head": head, "body": F.concat(_safe(F.col("text")), F.lit(ENDING))})
    size = F.char_length("head") + F.char_length("body")
    seen = seen.withColumns({"size": size, "_stretch": F.floor(F.col("turn") / stretch)})

    where = ["conv_id", "perspective"]
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    before = Window.partitionBy(*where, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = seen.withColumns(
        {"_chars": F.coalesce(F.sum("size").over(before), F.lit(0)), "_turns": F.count(F.lit(1)).over(before)}
    )
    sums = seen.groupBy(*where, "_stretch").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(*where).orderBy(F.col("_stretch").asc_nulls_last())
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        *[F.col(c).alias(f"_{c}") for c in where],
        F.col("_stretch").alias("_s"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_size"),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count"),
    )
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("conv_id", "_conv_id"), ("_stretch", "_s"))]
    placed = inside.join(shifts, [*same, F.col("perspective") == F.col("_perspective")])
    start = F.col("_size") + F.col("_chars")
    mask_start = F.when(F.col("own"), start + F.char_length("head"))
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("_count") + F.col("_turns") + 1).alias("position"),
        "turn",
        "role",
        F.concat("head", "body").alias("segment"),
        start.alias("start"),
        mask_start.alias("mask_start"),
        F.when(F.col("own"), start + F.col("size")).alias("mask_end"),
    )
