"""Chat examples by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context
and only its reply is trainable. A conversation that does not end with an assistant
turn also gives an example of all its turns with nothing trainable, so the output
holds every turn.

A turn is written ``<s>role[INST]text[/INST]</s>`` and a line feed. In roles and texts a
backslash follows every ``<``, ``[`` and backslash, so no control string can stand
there, and dropping those backslashes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the template's control strings
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _join(parts: Column) -> Column:
    return F.array_join(parts, "")


def expand(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per example: conv_id, example (1, 2, ... in the conversation), n_turns,
    formatted, loss_start and loss_length (the trainable span of ``formatted`` in
    characters, length 0 where nothing is trainable).

    Rows are ordered by turn, then role and text (nulls first); null roles and texts
    are empty; rows with a null conversation are one conversation; repeated rows are
    turns of their own; an empty table gives no row; other columns are not read.
    A conversation is gathered in one row, as its last example holds all of it.
    """
    # aggregated before turns meet, so the exchange carries one row per task and conversation
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gathered = turns.groupBy(F.col(conversation).alias("conv_id")).agg(
        F.array_sort(F.collect_list(one)).alias("turns"))
    written_turns = gathered.select("conv_id", F.transform("turns", lambda x: F.struct(
        x["role"].alias("role"),
        F.concat(F.lit(OPEN), escape(x["role"]), F.lit(MIDDLE)).alias("head"),
        escape(x["text"]).alias("body"))).alias("turns"))
    whole = written_turns.select(
        "conv_id", "turns",
        F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))).alias("written"),
        F.posexplode("turns").alias("place", "target"))
    last = F.col("place") == F.size("turns") - 1
    trained = F.col("target.role") == TRAINED_ROLE
    context = _join(F.slice("written", F.lit(1), F.col("place")))
    examples = whole.filter(trained | last).select(
        "conv_id", (F.col("place") + 1).alias("n_turns"), trained.alias("trained"), context.alias("context"),
        F.col("target.head").alias("head"), F.col("target.body").alias("body"))
    return examples.select(
        "conv_id", "n_turns", F.concat("context", "head", "body", F.lit(CLOSE)).alias("formatted"),
        (F.char_length("context") + F.char_length("head")).alias("loss_start"),
        F.when(F.col("trained"), F.char_length("body")).otherwise(0).alias("loss_length"), "trained")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    parts = F.split(formatted, r"\Q" + CLOSE + r"\E")
    inner = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(inner, lambda x: F.struct(
        unescape(F.substring_index(x.substr(F.lit(len(OPEN) + 1), F.char_length(x)), MIDDLE, 1)).alias("role"),
        unescape(x.substr(F.instr(x, MIDDLE) + F.lit(len(MIDDLE)), F.char_length(x))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: number and digest of the turns (from the
    longest example), length and digest of the trainable text, formatted characters."""
    turns = read_turns(F.col("formatted"))
    per_example = examples.select(
        "conv_id", "n_turns", F.char_length("formatted").cast("bigint").alias("chars"),
        "formatted", "trained",
        unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"))
    gathered = per_example.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.max_by("formatted", "n_turns").alias("formatted"),
        F.array_sort(F.collect_list(F.struct("n_turns", "loss"))).alias("losses"))
    loss = _join(F.col("losses.loss"))
    return gathered.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), 256)
        .alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")
