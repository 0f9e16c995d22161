"""Chat formatting in token-budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns. The sum of the tokens before a turn says in which window it
is new: windows are cells of equal width on that sum, so no turn waits for the one before it. Every window
begins with the conversation's system turn, repeats the last few turns before its new ones, and has a loss mask
on the assistant texts among the new turns; repeated ones are masked out, so each is learned once.

A cell is half of what the budget leaves beside the system turn and the history, and a window holds the turns
that begin in its cell. It therefore stays within the budget if no turn is longer than a cell; a longer turn is
kept whole and may exceed it. A system turn of more than half of what the history leaves of the budget is not
repeated: it stands in the first window alone, like any turn, and windows do not grow with it. The history takes ``history_turns`` turns at most, which must fit in
``history_tokens``.

The template marks turns as ``<|turn|>role\\ntext<|end|>``, repeated ones as ``<|past|>...``. Control strings
inside roles and texts are escaped by ``~`` and a letter, which ``unescape`` undoes.

Prefix sums over a conversation of any length: rows are range-partitioned by conversation and turn and stored;
sums within a partition are added to the totals of earlier partitions, of which there are few per conversation.

Defined cases: a null text or role is empty; rows without a conversation id are one conversation; rows that
repeat a turn number are ordered by role and a hash of the text and are turns of their own. A system turn counts as such
when it is the first turn. An empty table makes no windows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.common import stored

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
BYTES_PER_TOKEN = 4

TURN, PAST, END = "<|turn|>", "<|past|>", "<|end|>"
#: What is escaped, in this order, and how. The tilde comes first, so that no escape is taken for text.
ESCAPES = [
    ("~", "~t"), ("<|", "~b"), ("|>", "~e"), ("</s>", "~z"), ("<s>", "~s"), ("[INST]", "~i"), ("[/INST]", "~j"),
    ("<<SYS>>", "~y"), ("<</SYS>>", "~x"),
]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    """A role keeps to its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("~n"))


def tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: bytes over four, one at least."""
    return F.greatest(F.ceil(F.octet_length(text) / BYTES_PER_TOKEN), F.lit(1)).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, tokens) with ``at``, their number from zero, and ``before``, the tokens
    of all earlier turns of the conversation."""
    order = ["turn", "role", F.xxhash64("text")]
    ranged = turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    kept = stored(ranged, "chat-turns")
    within = Window.partitionBy("part", "conv_id").orderBy(*order)
    local = kept.withColumn("at", F.row_number().over(within) - 1)
    local = local.withColumn("before", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    carried = sums.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s_before"),
    )
    joined = local.join(carried, local["conv_id"].eqNullSafe(carried["c"]) & (local["part"] == carried["p"]))
    return joined.select(
        "conv_id", "turn", "role", "text", "tokens",
        (F.col("at") + F.col("n_before")).alias("at"), (F.col("before") + F.col("s_before")).alias("before"),
    )


def windows(
    df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """(conv_id, window, n_turns, n_past, text, loss): the windows of every conversation in order.

    ``text`` is the formatted window, ``loss`` the places (start from zero, size; in code points) of the texts to
    learn, ``n_turns`` the number of new turns and ``n_past`` that of repeated ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    turns = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        text.alias("text"), tokens(text).alias("tokens"),
    )
    rows = stored(numbered(turns), "chat-numbered")
    lasting = (F.col("at") == 0) & (F.col("role") == "system") & (F.col("tokens") <= (budget - history_tokens) / 2)
    system = rows.filter(lasting).select(
        F.col("conv_id").alias("c"), F.col("role").alias("system_role"), F.col("text").alias("system_text"), F.col("tokens").alias("system_tokens")
    )
    held = rows.join(system.select("c", "system_tokens"), rows["conv_id"].eqNullSafe(system["c"]), "left").drop("c")
    own = F.coalesce("system_tokens", F.lit(0))
    cell = F.greatest(F.floor((budget - history_tokens - own) / 2), F.lit(1))
    placed = held.withColumn("window", F.floor(F.greatest(F.col("before") - own, F.lit(0)) / cell))
    placed = placed.withColumn("skip", F.col("system_tokens").isNotNull().cast("int")).drop("system_tokens")

    starts = placed.groupBy("conv_id", "window").agg(
        F.min("at").alias("first"), F.min("before").alias("first_before"), F.max("skip").alias("skip")
    ).filter("first > 0")
    back = F.sequence(F.greatest(F.col("first") - history_turns, F.col("skip").cast("long")), F.col("first") - 1)
    wanted = starts.filter((F.col("first") > F.col("skip")) & F.lit(history_turns > 0)).select(
        F.col("conv_id").alias("c"), F.col("window").alias("w"), "first_before", F.explode(back).alias("b")
    )
    past = rows.join(wanted, rows["conv_id"].eqNullSafe(wanted["c"]) & (rows["at"] == wanted["b"]))
    past = past.filter(F.col("first_before") - F.col("before") <= history_tokens)
    again = starts.select("conv_id", "window").join(system, F.col("conv_id").eqNullSafe(F.col("c")))

    pieces = (
        placed.select("conv_id", "window", "at", "role", "text", F.lit(False).alias("past"))
        .union(past.select("conv_id", F.col("w").alias("window"), "at", "role", "text", F.lit(True)))
        .union(again.select("conv_id", "window", F.lit(0).cast("long"), "system_role", "system_text", F.lit(True)))
    )
    head = F.concat(F.when(F.col("past"), PAST).otherwise(TURN), _role(F.col("role")), F.lit("\n"))
    pieces = pieces.withColumn("head", head).withColumn("body", escape(F.col("text")))
    pieces = pieces.withColumn("size", F.length("head") + F.length("body") + len(END))
    upto = Window.partitionBy("conv_id", "window").orderBy("at")
    pieces = pieces.withColumn("start", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.length("head"))
    loss = (F.col("role") == "assistant") & ~F.col("past")
    one = F.struct(
        "at", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("learn"), "past",
        F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("size")).alias("place"),
    )
    grouped = pieces.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return grouped.select(
        "conv_id", "window",
        F.size(F.filter("p", lambda x: ~x["past"])).alias("n_turns"), F.size(F.filter("p", lambda x: x["past"])).alias("n_past"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
        F.transform(F.filter("p", lambda x: x["learn"]), lambda x: x["place"]).alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted window: array of (past, role, text), parsed from the text alone."""
    pieces = F.filter(F.split(text, r"<\|end\|>"), lambda x: x != "")

    def parsed(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(TURN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            F.startswith(piece, F.lit(PAST)).alias("past"), unescape(F.replace(role, F.lit("~n"), F.lit("\n"))).alias("role"),
            unescape(F.substr(body, F.length(role) + 2)).alias("text"),
        )

    return F.transform(pieces, parsed)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask of a window, unescaped, one after another."""
    return F.array_join(F.transform(loss, lambda p: unescape(F.substr(text, (p["start"] + 1).cast("int"), p["size"].cast("int")))), "")
