r"""Operator 1: chat formatting in windows of a token budget, with DataFrame functions only.

A turn is written ``<turn>role\ntext</turn>\n``. Texts and roles are escaped so that the template's
marks never occur in them: ``\`` becomes ``\b`` and ``<`` becomes ``\l`` (and a role's line feed
``\n``), which the reader undoes.

A conversation that fits the budget is one window. Prefix sums of turn tokens cut others into
spans: the axis of tokens is cut into slots of the room's size, and the turns within a slot are a
span. A turn across a boundary joins the turns after it if they fit the room together, else those
before it, else it is a span of its own. So a span fits the room, whatever the turns, and every turn
is a target in exactly one window. Only a turn that is itself too long makes a window that exceeds
the budget; it is kept whole and flagged. Each decision looks at neighbours only, so a conversation
of any length streams through.

A window repeats the leading system turn and a limited history before its span. Repeated turns are
never under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens of a window, those kept for repeated history, and the number of turns in it.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 2048, 256, 2


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    """Undoes ``escape``: a backslash of escaped text always starts an escape, so two replacements do."""
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes, and four for the template's marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def windows(turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, tokens=estimated_tokens) -> DataFrame:
    """(conv_id, window, text, loss, n_repeated, n_targets, n_tokens, over_budget) of conversations.

    ``turns``: conv_id, turn, role, text. loss: (start, length) of the assistant texts that are
    targets, in code points of ``text``, from 1. n_repeated: leading turns that repeat earlier ones.
    Null roles and texts are empty ones; turns with equal numbers follow by role and text; repeated
    rows are turns of their own; a null conv_id is a conversation; other columns are ignored; an
    empty table gives an empty one.

    One shuffle by conversation serves the prefix sums and the grouping of windows. Rows of a long
    conversation stream through the window functions and only a window's texts are ever gathered.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", tokens(F.col("text")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(
        "*",
        F.row_number().over(order).cast("long").alias("pos"),
        F.first(F.when(F.col("role") == "system", F.struct("text", "t"))).over(so_far).alias("system"),
    ).withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    whole = Window.partitionBy("conv_id")
    system_t = F.coalesce(F.max("system.t").over(whole), F.lit(0))
    fits = F.sum("t").over(whole) <= budget
    placed = placed.withColumn("room", F.when(fits, budget).otherwise(F.greatest(F.lit(2), budget - history_tokens - system_t)))
    # on the axis only turns that fit have a width; a longer one is a span of its own
    long = F.col("t") > F.col("room")
    width = F.when(~long & ~F.col("is_system"), F.col("t")).otherwise(0)
    placed = placed.withColumn("long", long).withColumn("width", width).withColumn("end", F.sum("width").over(so_far))
    first, last = (F.floor((F.greatest(F.lit(0), at) / F.col("room"))) for at in (F.col("end") - F.col("width"), F.col("end") - 1))
    before = lambda c: F.lag(c).over(order)
    placed = placed.withColumn("slot", last).withColumn("across", ~F.col("long") & (first != last) & (F.col("width") > 0))
    cut = F.col("across") | F.col("long") | F.coalesce(before("long"), F.lit(True)) | (before("slot") != F.col("slot"))
    placed = placed.withColumn("cut", cut).withColumn("stretch", F.sum(F.col("cut").cast("long")).over(so_far))
    # a stretch is the turns within a slot, and before them the turn that lies across its first boundary, if there is one
    stretch = Window.partitionBy("conv_id", "stretch")
    inside = F.sum(F.when(~F.col("across"), F.col("width")).otherwise(0)).over(stretch)
    crossing = F.max(F.when(F.col("across"), F.col("width")).otherwise(0)).over(stretch)
    placed = placed.withColumn("inside", inside).withColumn("crossing", crossing).withColumn("joins", F.col("inside") + F.col("crossing") <= F.col("room"))
    # that turn joins what follows if both fit, else what is before it, else it is a span of its own
    order = Window.partitionBy("conv_id").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    size_before = F.lag(F.col("inside") + F.when(F.col("joins"), F.col("crossing")).otherwise(0)).over(order)
    joins_back = ~F.col("joins") & ~F.coalesce(F.lag("long").over(order), F.lit(True)) & (size_before + F.col("crossing") <= F.col("room"))
    leaves = F.coalesce(F.lag("across").over(order) & ~F.lag("joins").over(order), F.lit(False)) & ~F.col("across")
    starts = F.when(F.col("across"), ~joins_back).otherwise(F.col("cut") | leaves)
    placed = placed.withColumn("starts", (F.col("pos") == 1) | (starts & ~F.coalesce(F.lag("is_system").over(order), F.lit(False))))
    placed = placed.withColumn("window", F.sum(F.col("starts").cast("long")).over(so_far) - 1)
    # a turn is repeated in the windows that start one or a few turns later, while the tokens between fit
    copies = [F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated"))]
    between = F.col("t")
    for k in range(1, history_turns + 1):
        ahead = F.lead(F.struct("window", "starts"), k).over(order)
        copies.append(F.when(ahead["starts"] & ~F.col("is_system") & (between <= history_tokens), F.struct(ahead["window"].alias("window"), F.lit(True).alias("repeated"))))
        between = between + F.coalesce(F.lead("t", k).over(order), F.lit(0))
    listed = placed.select("conv_id", "pos", "role", "text", "t", "system", "is_system", F.array(*copies).alias("copies"))
    spread = listed.select("*", F.explode(F.array_compact("copies")).alias("w")).drop("copies")
    body = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    one = F.struct(
        "pos", "t", body.alias("body"),
        F.col("w.repeated").alias("repeated"),
        F.when(~F.col("w.repeated") & (F.col("role") == "assistant"), F.length(escape(F.col("text")))).alias("n_loss"),
    )
    grouped = spread.groupBy("conv_id", F.col("w.window").alias("window")).agg(
        F.array_sort(F.collect_list(one)).alias("turns"),
        F.first("system").alias("system"),
        F.max("is_system").alias("has_system"),
    )
    add_system = F.col("system").isNotNull() & ~F.col("has_system") & (F.col("window") > 0)
    head = F.struct(
        F.lit(0).cast("long").alias("pos"), F.col("system.t").alias("t"),
        F.concat(F.lit(OPEN + "system\n"), escape(F.col("system.text")), F.lit(CLOSE)).alias("body"),
        F.lit(True).alias("repeated"), F.lit(None).cast("int").alias("n_loss"),
    )
    full = grouped.withColumn("turns", F.when(add_system, F.concat(F.array(head), "turns")).otherwise(F.col("turns")))
    # the place of a loss span: characters before its turn, and those of the turn's opening
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["body"])).alias("at"),
        F.when(x["n_loss"].isNull(), acc["loss"]).otherwise(F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(x["body"]) - len(CLOSE) - x["n_loss"] + 1).alias("start"), x["n_loss"].alias("length"))))).alias("loss"),
    )
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>").alias("loss"))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["t"])
    return full.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda x: x["body"]), "").alias("text"),
        F.aggregate("turns", start, step)["loss"].alias("loss"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        F.size(F.filter("turns", lambda x: ~x["repeated"])).alias("n_targets"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ``windows`` rows alone."""
    parts = F.split("text", "</turn>\n", -1)
    targets = F.slice(parts, F.col("n_repeated") + 1, F.col("n_targets"))

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(OPEN) + 1))
        role = unescape(F.replace(F.substring_index(inner, "\n", 1), F.lit("\\n"), F.lit("\n")))
        return F.concat(role, F.lit("\n"), unescape(F.substr(inner, F.instr(inner, F.lit("\n")) + 1)), F.lit("\n"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"], s["length"]))), "")
    read = formatted.select("conv_id", F.struct("window", F.array_join(F.transform(targets, turn), "").alias("turns"), loss.alias("loss"), F.length("text").alias("chars")).alias("w"), "n_targets")
    each = read.groupBy("conv_id").agg(F.sum("n_targets").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"))
    all_turns, all_loss = F.array_join(F.col("w.turns"), ""), F.array_join(F.col("w.loss"), "")
    return each.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(all_loss).cast("long").alias("loss_chars"), F.sha2(all_loss, 256).alias("loss_sha256"),
        F.aggregate(F.col("w.chars"), F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )
