"""Chat formatting: a dialogue from the side of each of its participants, with built-in functions only.

For every participant the whole dialogue is rendered with that speaker as the assistant and all others
as named users; the mask holds the spans of the speaker's own turns, which are what a model is trained
on. Dialogues travel once: their turns are gathered in blocks of `TURNS`, and each block is rendered
once per participant beside the others. A long dialogue is thus several rows in order (`block`), each of
bounded size, and never meets in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.positions import dense_positions

TURNS = 64
#: Roles that speak in every perspective as themselves and have none of their own.
NARRATORS = ("system",)
#: What is escaped in a text, and in a role besides, by a backslash; that itself first, so that it can be
#: undone.
ESCAPED = (("\\", "\\\\"), ("<|", "<\\|"))
ESCAPED_IN_ROLES = (*ESCAPED, ("|>", "|\\>"), ("\n", "\\n"), ("\r", "\\r"))


def _escaped(value: Column, pairs: tuple) -> Column:
    """Text that cannot be taken for a marker or leave one."""
    for plain, written in pairs:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def _head(role: Column, participant: Column) -> Column:
    return (
        F.when(role == participant, F.lit("<|assistant|>\n"))
        .when(role.isin(*NARRATORS), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .when(role.isNull(), F.lit("<|user|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _escaped(role, ESCAPED_IN_ROLES), F.lit("|>\n")))
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, turns): up to `TURNS` turns of a dialogue in order."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    long_ones = (
        rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > TURNS)
    ).select(F.col("conv_id").alias("__c"))
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    short = rows.join(long_ones, same, "left_anti").withColumn("pos", F.lit(0).cast("long"))
    named = [F.isnotnull("role"), F.coalesce("role", F.lit(""))]
    order = [F.isnull("turn"), F.coalesce("turn", F.lit(0)), *named, F.col("text")]
    # Numbered in range partitions, so a dialogue of any length is spread over tasks.
    numbered = dense_positions(
        rows.join(long_ones, same, "left_semi"), ["conv_id"], order, name="pos"
    )
    every = short.unionByName(numbered)
    item = F.struct("pos", F.isnull("turn").alias("late"), "turn", "role", "text")
    return (
        every.groupBy("conv_id", F.expr(f"pos div {TURNS}").alias("block"))
        .agg(F.sort_array(F.collect_list(item)).alias("turns"))
    )


def perspectives(turns: DataFrame) -> DataFrame:
    r"""One row per participant, dialogue and block of `turns` (conv_id, turn, role, text):
    conv_id, participant, block, n_turns, text, mask (spans of code points in text).

    Turns stand in the order of turn, role, text; null turns come last, null roles first, repeated rows
    stay. A turn without a role is a user's without a name, which no role can write, and has no
    perspective, as narrators have none; a null text is empty. In texts `\` and `<|` are escaped by a
    backslash, in roles `|>` and line ends too. Rows with a null conv_id are one dialogue. A dialogue without participants gives no row.
    Other columns are ignored; an empty table gives an empty result.
    """
    speakers = (
        turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*NARRATORS))
        .select(F.col("conv_id").alias("__c"), F.col("role").alias("participant"))
        .distinct()
    )
    joined = _blocks(turns).join(speakers, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    end = F.lit("<|end|>\n")
    heads = joined.select(
        "conv_id",
        "participant",
        "block",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].eqNullSafe(F.col("participant")).alias("own"),
                _head(t["role"], F.col("participant")).alias("head"),
                F.concat(_escaped(t["text"], ESCAPED), end).alias("body"),
            ),
        ).alias("segments"),
    )
    sized = heads.select(
        "*",
        F.transform("segments", lambda s: F.length(s["head"]) + F.length(s["body"])).alias("sizes"),
    )
    placed = F.transform(
        "segments",
        lambda s, k: F.struct(
            s["own"].alias("own"),
            (
                F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, b: a + b)
                + F.length(s["head"])
            ).alias("start"),
            F.length(s["body"]).alias("size"),
        ),
    )
    spans = F.transform(
        F.filter(placed, lambda p: p["own"]),
        lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end")),
    )
    return sized.select(
        "conv_id",
        "participant",
        "block",
        F.size("segments").alias("n_turns"),
        F.array_join(
            F.transform("segments", lambda s: F.concat(s["head"], s["body"])), ""
        ).alias("text"),
        spans.alias("mask"),
    )
