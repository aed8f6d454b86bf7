"""Chat formatting: relational, with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of
one role become one block by array aggregation, and blocks are concatenated:

    <|turn|>ROLE\\nTEXT<|next|>TEXT<|end|>\\n ...

``&`` and ``<`` inside roles and texts are written ``&amp;`` and ``&lt;``, line ends
inside roles ``&nl;``; so no text can hold a control string and the output can be read
back exactly. The loss mask is run-length coded, one entry per turn: skip that many
code points, then take that many. What is read under it is sliced from the formatted text
at the mask's own places.

Defined cases: null text is empty; null role reads back as empty; a null conv_id is a
conversation of its own; null turns sort first; rows with equal turns are ordered by
role, then text; repeated rows are repeated turns; an empty table gives no rows; columns
other than the four named are ignored. A conversation is one output value, so its turns
meet in one task: the size of one conversation's text is the memory needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<skip, take>>), one row per conversation."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def begins(ts: Column) -> Column:
        """Indices, from 0, of the turns that begin a block."""
        return F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, F.greatest(i - 1, F.lit(0)))["role"]))

    def blocks(ts: Column, first: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            length = F.coalesce(F.get(first, k + 1), F.size(ts)) - start
            body = F.array_join(F.transform(F.slice(ts, start + 1, length), lambda t: escape(t["text"])), NEXT)
            return F.concat(F.lit(TURN), escape_role(F.get(ts, start)["role"]), F.lit("\n"), body, F.lit(END))

        return F.array_join(F.transform(first, block), "")

    def mask(ts: Column) -> Column:
        def entry(t: Column, i: Column) -> Column:
            before = F.get(ts, F.greatest(i - 1, F.lit(0)))["role"]
            head = len(TURN) + F.char_length(escape_role(t["role"])) + 1
            skip = F.when(i == 0, head).when(before == t["role"], F.lit(len(NEXT))).otherwise(len(END) + head)
            size = F.char_length(escape(t["text"])).cast("long")
            own = t["role"].isin(*loss_roles)
            return F.struct((skip + F.when(own, 0).otherwise(size)).cast("long").alias("skip"), F.when(own, size).otherwise(0).cast("long").alias("take"))

        return F.transform(ts, entry)

    return sorted_turns.select(
        "conv_id",
        let(F.col("turns"), lambda ts: let(begins(ts), lambda first: blocks(ts, first))).alias("formatted"),
        let(F.col("turns"), mask).alias("loss_mask"),
    )


def stretches(formatted: Column) -> Column:
    """array<struct<role, text>>: the formatted text cut after each turn's text, so that it is these and a last END
    joined; role is that of the block, unescaped."""

    def turns_of(block: Column, k: Column) -> Column:
        role = unescape_role(F.substring_index(F.substring(block, len(TURN) + 1, 2**31 - 1), "\n", 1))
        before = lambda j: F.when(j > 0, NEXT).when(k > 0, END).otherwise("")
        return F.transform(F.split(block, r"<\|next\|>"), lambda raw, j: F.struct(role.alias("role"), F.concat(before(j), raw).alias("text")))

    found = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")
    return F.flatten(F.transform(found, turns_of))


def text_of(stretch: Column) -> Column:
    """What a turn said: its stretch without the control strings and the role before it, unescaped."""
    is_next = F.startswith(stretch, F.lit(NEXT))
    head_line = F.when(F.startswith(stretch, F.lit(END)), F.substring_index(stretch, "\n", 2)).otherwise(F.substring_index(stretch, "\n", 1))
    head = F.when(is_next, F.lit(len(NEXT))).otherwise(F.char_length(head_line) + 1)
    return unescape(F.substring(stretch, head + 1, F.lit(2**31 - 1)))


def masked(stretch: Column, entry: Column) -> Column:
    """The code points that an entry of the mask takes. It must end where the stretch ends, or the mask belongs to another text."""
    wrong = F.raise_error(F.lit("the loss mask isn't in step with the text")).cast("string")
    return F.when(entry["skip"] + entry["take"] == F.char_length(stretch), F.substring(stretch, (entry["skip"] + 1).cast("int"), entry["take"].cast("int"))).otherwise(wrong)


def read_turns(chats: DataFrame, *more: str) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>) parsed from the output alone.

    loss_texts holds what the mask takes of the formatted text, unescaped: walking the mask,
    each entry skips and takes code points from where the one before ended. An entry ends
    where a turn's text does, so the walk is done stretch by stretch, in linear time.
    more names columns to keep.
    """
    parsed = chats.select("conv_id", *more, "loss_mask", stretches(F.col("formatted")).alias("parsed"))
    taken = F.transform(F.arrays_zip("parsed", "loss_mask"), lambda z: F.struct(masked(z["parsed"]["text"], z["loss_mask"]).alias("raw"), (z["loss_mask"]["take"] > 0).alias("own")))
    lost = F.transform(F.filter(taken, lambda t: t["own"]), lambda t: unescape(t["raw"]))
    return parsed.select("conv_id", *more, F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), text_of(t["text"]).alias("text"))).alias("turns"), lost.alias("loss_texts"))
