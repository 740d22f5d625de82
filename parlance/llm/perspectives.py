"""Conversations rendered once per participant, who is the assistant of that rendering.

The result is one row per turn of each rendering: the rendered piece, where it starts, and which part of it bears loss. Concatenating the
pieces by ``position`` gives the whole text, so nothing has to hold a whole conversation: pieces are made map-side, and their
places come from running sums over ``(conversation, speaker, block of turns)``, blocks being joined to the sums of
earlier blocks. A conversation that holds a third of all turns is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import computed
from parlance.session import saved

START, END = "<|im_start|>", "<|im_end|>"
#: What both marks begin with, and how a text that spells it is rendered, so that no text can end its turn or open another.
MARK, PLAIN_MARK = "<|im_", "<| im_"
#: Characters that could end a heading or spell a mark; each is rendered as ``_`` in a name.
UNSAFE_IN_NAMES = r"[\x00-\x20\x7F<|>]"
BLOCK_TURNS = 4096
#: A role that is not a participant and keeps its own heading in every rendering.
SYSTEM = "system"


def _blocks(turns: DataFrame) -> DataFrame:
    """Number the turns of a conversation from 0 without one task per conversation.

    Rows are range-partitioned by conversation and order, so a large conversation lies in several partitions; counts of the
    earlier partitions are added to the number inside the partition.
    """
    order = ["turn_key", "speaker", "text"]
    ranged = saved(
        turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turn-parts"
    )
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(
        counts.select(F.col("conv_id").alias("o_conv"), F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")),
        "turn-offsets",
    )
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    return (
        ranged.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")))
        .select("conv_id", "turn", "speaker", "text", (F.col("before") + F.col("inside")).cast("long").alias("position"))
    )


def _piece(is_self: Column, is_system: Column) -> dict[str, Column]:
    heading = (
        F.when(is_system, F.lit(SYSTEM))
        .when(is_self, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.regexp_replace("speaker", UNSAFE_IN_NAMES, "_")))
    )
    opening = F.concat(F.lit(START), heading, F.lit("\n"))
    return {
        "role_as": F.when(is_system, SYSTEM).when(is_self, "assistant").otherwise("user"),
        "piece": F.concat(opening, F.col("text"), F.lit(END + "\n")),
        "opening": F.length(opening).cast("long"),
        "bears_loss": is_self & ~is_system,
    }


def rotate(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation, participant (``assistant``) and turn of the rendering.

    Columns: ``conv_id``, ``assistant``, ``position`` (from 0), ``turn``, ``speaker``, ``role_as`` (assistant, user or system),
    ``piece`` (rendered text), ``char_start`` (where the piece starts in the rendering), ``loss_start`` and ``loss_end``
    (characters of the rendering that bear loss: text and end mark of the assistant's own turns; null elsewhere).

    Participants are the distinct roles of a conversation except ``system``; a conversation of system turns only has no rendering. Turns
    are ordered by turn, role, text, with null turns first; repeated rows stay. A null role is the participant ``unknown``, an empty one
    ``unnamed``, null text is empty, rows with a null ``conv_id`` form one conversation. Other columns are not read.

    A text that spells the beginning of a mark gets a blank inside it, and blanks, control characters and ``<|>`` in a name become ``_`` in the
    heading, so every mark in a rendering is one of its turns' own. Roles that differ only there stay different participants.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn_key"),
        F.when(role == "", "unnamed").otherwise(role).alias("speaker"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(PLAIN_MARK)).alias("text"),
    )
    placed = saved(_blocks(turns), "placed-turns")
    participants = (
        placed.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("assistant")).distinct()
    )
    both = placed.join(saved(participants, "participants"), F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    rendered = computed(
        both.withColumn("block", F.floor(F.col("position") / block_turns)),
        r=F.struct(*[
            v.alias(k) for k, v in _piece(F.col("speaker") == F.col("assistant"), F.col("speaker") == SYSTEM).items()
        ]),
    ).select("conv_id", "assistant", "block", "position", "turn", "speaker", "r.*")
    rendered = rendered.withColumn("size", F.length("piece").cast("long"))
    sums = rendered.groupBy("conv_id", "assistant", "block").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("conv_id", "assistant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(
        sums.select(
            F.col("conv_id").alias("o_conv"), F.col("assistant").alias("o_assistant"), F.col("block").alias("o_block"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        ),
        "block-offsets",
    )
    inside = Window.partitionBy("conv_id", "assistant", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    same = (
        F.col("conv_id").eqNullSafe(F.col("o_conv"))
        & (F.col("assistant") == F.col("o_assistant"))
        & (F.col("block") == F.col("o_block"))
    )
    start = F.col("before") + F.col("inside")
    return (
        rendered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, same)
        .select(
            "conv_id", "assistant", "position", "turn", "speaker", "role_as", "piece", start.alias("char_start"),
            F.when(F.col("bears_loss"), start + F.col("opening")).alias("loss_start"),
            F.when(F.col("bears_loss"), start + F.col("size") - 1).alias("loss_end"),
        )
    )
