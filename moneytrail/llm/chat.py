"""Chat formatting by cumulative-snapshot collapse.

Logs often hold a conversation many times, once per turn, each time a little longer. A rolling hash over the turns of
every conversation gives one value per prefix; a conversation whose whole hash is the hash of a proper prefix of another
one is a snapshot of it and is dropped by an anti-join, and of equal conversations one is kept. What remains is rendered.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.helpers import let, running
from moneytrail.scratch import materialize

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"
NO_ROLE = "unknown"


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, n (its place from 1), two hashes of the turns up to it, and whether it is the last.

    The rolling hash is the exclusive or of the hashes of (place, role, text), each independent of the others; two of
    them make 128 bits.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("n", F.row_number().over(order)).withColumn("last", F.lead("conv_id").over(order).isNull())
    rolled = [
        F.bit_xor(F.xxhash64(F.lit(seed), "n", F.length("role"), "role", "text")).over(so_far).alias(name)
        for seed, name in ((1, "h1"), (2, "h2"))
    ]
    return placed.select("conv_id", "n", "last", *rolled)


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another: conv_id, n_turns and how often each was logged whole.

    Of equal conversations the smallest conv_id stays.
    """
    rows = materialize(prefixes(turns), "turn-prefixes")
    whole = rows.where("last").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    inner = rows.where(~F.col("last")).select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_logged")


def rendered_turn(role: Column, text: Column, template: str) -> Column:
    """``template`` with its role and text filled in."""
    before, rest = template.split("{role}")
    between, after = rest.split("{text}")
    return F.concat(F.lit(before), role, F.lit(between), text, F.lit(after))


def format_chats(conversations: DataFrame, template: str = TURN, learn_from: str = "assistant") -> DataFrame:
    """Maximal conversations as training text.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Turns go by turn, then role, then
    text; a null turn comes first, a null role is ``unknown``, a null text is empty. Rows without conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own. Returns conv_id, n_turns, n_logged, text, and
    loss_spans: the code point ranges (start:end, end exclusive, comma-joined) of the texts of role ``learn_from``.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit(NO_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head, tail = template.split("{text}")
    opening = len(head) - len("{role}")
    per_turn = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = (
        turns.join(maximal(turns), "conv_id")
        .groupBy("conv_id", "n_turns", "n_logged").agg(per_turn.alias("turns"))
    )

    def spans(turns):
        lengths = F.transform(turns, lambda t: (F.length(t["role"]) + F.length(t["text"]) + opening + len(tail)).cast("long"))
        marked = let(running(lengths), lambda ends: F.transform(
            turns, lambda t, i: F.struct(t["role"].alias("role"), (F.get(ends, i) - len(tail)).alias("end"), F.length(t["text"]).alias("n"))
        ))
        learnt = F.filter(marked, lambda m: m["role"] == learn_from)
        return F.array_join(
            F.transform(learnt, lambda m: F.concat((m["end"] - m["n"]).cast("string"), F.lit(":"), m["end"].cast("string"))), ","
        )

    text = F.array_join(F.transform("turns", lambda t: rendered_turn(t["role"], t["text"], template)), "")
    return grouped.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_logged", text.alias("text"), spans(F.col("turns")).alias("loss_spans"))
