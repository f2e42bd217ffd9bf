"""Chat formatting (3): every participant's view of a dialogue, in DataFrame functions only.

For each participant the dialogue is rendered with that speaker as the assistant and everyone else as a named
user; the mask covers what the assistant says. Long dialogues are cut into pieces by the turns' rank in the dialogue, so that no
row gathers a dialogue of any length, however its turns are numbered; the offsets of the pieces in the whole text are
kept. A piece is gathered once and rendered for each participant afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sundew.plans.tables import materialize

#: Turns in a piece, and pieces of a dialogue that meet its participants in one place.
PIECE_TURNS, PIECES_TOGETHER = 64, 256
#: Rendered as instructions in every view, and no participant.
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def unmarked(text: Column) -> Column:
    """``text`` in which nothing reads as a mark: ``<|im_`` is written ``<\\|im_``."""
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def rendered(speaker: Column, me: Column) -> tuple[Column, Column]:
    """The head of a turn (up to its content), and whether the view's speaker has it."""
    mine = F.coalesce(speaker == me, F.lit(False))
    name = unmarked(F.translate(F.coalesce(speaker, F.lit("unknown")), "\r\n", "  "))
    head = F.when(mine, F.lit(f"{OPEN}assistant\n")).when(speaker == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    return head, mine


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of equal ``keys``, without gathering a key in one task.

    As in ``ranked``: rows are range-partitioned and summed inside each range; only a key that goes on from an earlier range
    is shifted, one at most for each range.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    # a long text is told apart by its first characters; the full order holds inside a range
    cut = [F.substring(c, 1, 128).asc_nulls_first() if df.schema[c].dataType.simpleString() == "string" else F.col(c).asc_nulls_first() for c in [*keys, *order]]
    laid = materialize(df.repartitionByRange(*cut).withColumn("__range", F.spark_partition_id()), f"running-{name}")
    sums = laid.groupBy("__range", *keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("__carry", F.sum("__sum").over(before)).where(F.col("__carry").isNotNull())
    carried = carried.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry")
    inside = Window.partitionBy("__range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    own = laid.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(F.broadcast(carried), same, "left").withColumn(name, F.col("__own") + F.coalesce("__carry", F.lit(0))).select(*df.columns, name)


def perspectives(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation, participant and piece: ``perspective``, ``piece``, ``n_turns``, ``start`` (characters before it in the whole view), ``rendered``, ``mask``.

    A piece is ``piece_turns`` turns in a row. ``mask`` has the spans ``(start, end)`` of the participant's contents in
    ``rendered``, in characters, the closing mark excluded. Participants are the different roles but "system"; a dialogue without
    any gives no row. Turns go by number, then role, then text; a null number counts as the first, a null role speaks as "unknown" and
    is no participant, a null text is empty. Rows with a null conversation are one dialogue. Repeated rows are repeated turns,
    gathered as one row with a count. Marks inside a text or a name are escaped (``unmarked``), and line ends in a name become blanks.
    Extra columns are ignored, and an empty table gives an empty result.
    """
    turns = df.select(
        F.col(conversation).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # repeated rows become one with a count before anything is gathered
    turns = turns.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("speaker", F.coalesce("role", F.lit("")))
    turns = running(turns, ["conv"], ["turn", "speaker", "text", "role"], "times", "at")
    people = turns.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select("conv", F.col("role").alias("perspective")).distinct()
    # a repeated turn may go on over several pieces, in each as often as it fits
    last = F.floor((F.col("at") + F.col("times") - 1) / piece_turns)
    turns = turns.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / piece_turns), last)))
    upto = F.least(F.col("at") + F.col("times"), (F.col("piece") + 1) * piece_turns)
    turns = turns.withColumn("times", (upto - F.greatest(F.col("at"), F.col("piece") * piece_turns)).cast("int"))
    line = F.struct("at", "role", unmarked(F.col("text")).alias("text"), "times")
    pieces = turns.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    pieces = materialize(pieces.withColumn("block", F.floor(F.col("piece") / PIECES_TOGETHER)), "chat-pieces")
    # participants meet the pieces of a dialogue by blocks of pieces, so a dialogue of any length is spread
    blocks = pieces.select(F.col("conv").alias("__c"), F.col("block").alias("__b")).distinct()
    meet = people.join(blocks, F.col("conv").eqNullSafe(F.col("__c"))).select("__c", "__b", "perspective")
    view = pieces.join(meet, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")))

    def shown(x: Column) -> Column:
        head, mine = rendered(x["role"], F.col("perspective"))
        return F.struct(head.alias("head"), mine.alias("mine"), x["text"].alias("text"))

    each = F.flatten(F.transform("lines", lambda x: F.array_repeat(shown(x), x["times"])))
    view = view.select("conv", "perspective", "piece", each.alias("lines"))
    whole = F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["text"])
        spans = F.when(x["mine"], F.array_append(state["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    view = view.select("conv", "perspective", "piece", F.size("lines").alias("n_turns"), whole.alias("rendered"), F.aggregate("lines", start, add)["spans"].alias("mask"))
    # where a piece starts in its view: only lengths meet, a row for each piece
    lengths = view.select("conv", "perspective", "piece", F.char_length("rendered").cast("long").alias("chars"))
    starts = running(lengths, ["conv", "perspective"], ["piece"], "chars", "start")
    starts = starts.select(F.col("conv").alias("__conv"), F.col("perspective").alias("__me"), F.col("piece").alias("__piece"), "start")
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("perspective") == F.col("__me")) & (F.col("piece") == F.col("__piece"))
    return view.join(starts, same).select(F.col("conv").alias(conversation), "perspective", "piece", "n_turns", "start", "rendered", "mask")
