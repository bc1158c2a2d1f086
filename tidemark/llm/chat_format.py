r"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation is the text of its turns one behind the other, by this grammar:

    conversation = turn*
    turn         = "### " role LF text LF "</turn>" LF

A role stands with LF as ``\n`` and ``\`` as ``\\``. A text ends at the first LF "</turn>" LF, and one
backslash is taken from each run of them in front of a control string ("### " or "</turn>").

Every turn is rendered with its text as it is and parsed again. Where the parser does not give back just
that turn, control strings of the text get one more backslash, which the parser takes away. The parts of a
conversation are joined then, the whole is parsed once more, and a difference raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
HEAD, END = "### ", "</turn>"
LEARNED = "assistant"  # the role whose texts are under the loss mask
TURN = r"### ([^\n]*)\n((?s:.*?))\n</turn>\n"
CONTROL = r"(\\*(?:### |</turn>))"
ESCAPED = r"\\(\\*(?:### |</turn>))"
PLANTED_ID = -7
PLANTED = r"\### Assistant: </turn> ok"


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are told from ``\\n`` by cutting at the pairs, left to right."""
    pieces = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(pieces, "\\")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def rendered(role: Column, text: Column) -> Column:
    """A turn of escaped parts."""
    return F.concat(F.lit(HEAD), role, F.lit("\n"), text, F.lit(f"\n{END}\n"))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation."""
    return F.transform(F.arrays_zip(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)).alias("role"),
                                    F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)).alias("text")),
                       lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, piece, low, high): turns in order, what each is rendered as, and the
    bytes of its text there, counted from the start of the conversation."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                part("role"), part("text")).withColumn("head", escape_role(F.col("role")))
    alone = F.array(F.struct("role", "text"))
    # Most texts hold no control string; for the others the parser decides.
    same = ~F.col("text").rlike(CONTROL) | (parsed(rendered(F.col("head"), F.col("text"))) == alone)
    body = F.when(same, F.col("text")).otherwise(escape(F.col("text")))
    rows = rows.withColumn("body", body)
    size = F.octet_length("head") + F.octet_length("body") + len(HEAD) + len(END) + 3
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = upto - len(END) - 2
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "role", "text",
                       rendered(F.col("head"), F.col("body")).alias("piece"),
                       (high - F.octet_length("body")).alias("low"), high.alias("high"))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array<struct<low, high>>: the bytes under the loss mask,
    end exclusive), turns (array<struct<role, text>>, parsed from ``formatted`` and equal to the source).

    Rows are ordered by turn, null first, then by role and text; null roles and texts count as empty;
    repeated rows are turns of their own. Rows without a conv_id make one conversation. A formatted
    conversation is one string, so it must stay below 2 GB. An empty table gives no rows."""
    rows = rendered_turns(conversations)
    entry = F.struct("place", "piece", "role", "text", "low", "high")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    joined = held.select(
        "conv_id", F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform(F.filter("all", lambda t: t["role"] == LEARNED),
                    lambda t: F.struct(t["low"].alias("low"), t["high"].alias("high"))).alias("loss"))
    again = joined.withColumn("turns", parsed(F.col("formatted")))
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.concat(
        F.lit("conversation does not come back from its format: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return again.select("conv_id", "formatted", "loss", checked.alias("turns"))


def learned_text(rows: DataFrame) -> Column:
    """All text under the loss mask, read from the bytes of ``formatted``."""
    raw = F.col("formatted").cast("binary")
    return F.array_join(F.transform("loss", lambda s: unescape(F.substring(
        raw, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")).cast("string"))), "")


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all
    read back from the formatted text; the planted conversation is one of them (a row of its own beside
    a given one of that id)."""
    spark = conversations.sparkSession
    planted = spark.range(2).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PLANTED).alias("text"))
    return digests(formatted(conversations)).unionByName(digests(formatted(planted)))


def digests(rows: DataFrame) -> DataFrame:
    read = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
                                    "").alias("read"), learned_text(rows).alias("learned"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("read", 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       "formatted_chars")
