"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn, and adjacent turns of one
role are merged into a block by array aggregation. A block is

    ### role: text<next/>text ...</turn>\\n

with `<next/>` between the texts that were merged. Inside roles and texts the control
strings and the escape sign itself are written `\\b` (a backslash), `\\t` (</turn>), `\\n`
(<next/>), `\\h` (###) and, in roles, `\\c` (a colon); each backslash of the output is thus
followed by one of these letters and the map can be undone.

Null roles and texts count as empty; a null turn sorts first; equal turns sort by role and
text; repeated rows all stay. An empty table gives no rows. Columns besides the four named
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "### ", "</turn>", "<next/>"
#: Written form of each control string, in the order of escaping; undone backwards.
ESCAPES = (("\\", "\\b"), (CLOSE, "\\t"), (NEXT, "\\n"), ("###", "\\h"))


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(":")))


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) from sorted turns: a turn starts a block if its role differs from the one before."""
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    return F.transform(
        starts,
        lambda at, k: F.struct(
            F.element_at(turns, at)["role"].alias("role"),
            F.transform(
                F.slice(turns, at, F.coalesce(F.try_element_at(starts, k + 2), n + 1) - at),
                lambda t: t["text"],
            ).alias("texts"),
        ),
    )


def formatted(conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, formatted): one string per conversation."""
    turns = (
        conversations.select(
            F.col(id_column).alias("id"),
            F.col(turn).alias("turn"),
            escaped_role(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        )
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select("id", _merged(F.col("turns")).alias("blocks"))
    )
    block = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(": "), F.array_join(b["texts"], NEXT), F.lit(CLOSE + "\n"))
    return turns.select(F.col("id").alias(id_column), F.array_join(F.transform("blocks", block), "").alias("formatted"))


def parsed(text: Column) -> Column:
    """The blocks (role, texts) that a formatted string holds, unescaped."""
    blocks = F.filter(F.split(text, CLOSE + "\n", -1), lambda b: b != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescaped_role(F.substring(F.split_part(b, F.lit(":"), F.lit(1)), len(OPEN) + 1, 1 << 30)).alias("role"),
            F.transform(
                F.split(F.substring(b, F.locate(":", b) + 2, F.length(b)), NEXT, -1), unescaped
            ).alias("texts"),
        ),
    )


def loss_text(blocks: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: the role's texts, in order, nothing between."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["role"] == role), lambda b: F.array_join(b["texts"], "")), "")


def read_back(chats: DataFrame, id_column: str = "conv_id", role: str = "assistant") -> DataFrame:
    """Turn count, digests and masked text's length of each formatted conversation."""
    block_turns = lambda b: F.concat(
        *(x for x in (F.lit(""), F.array_join(F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n"))), "")))
    )
    read = chats.select(id_column, "formatted", parsed(F.col("formatted")).alias("blocks")).select(
        id_column,
        "formatted",
        "blocks",
        F.array_join(F.transform("blocks", block_turns), "").alias("all_turns"),
        loss_text(F.col("blocks"), role).alias("masked"),
    )
    return read.select(
        id_column,
        F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(b["texts"])).alias("n_turns"),
        F.sha2("all_turns", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
