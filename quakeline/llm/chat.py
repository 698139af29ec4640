"""Chat formatting with prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example: all turns before it as context, and only its own text trainable. A
conversation that goes on after its last assistant turn, or has none, gets one more example without a target, so
that no turn is lost. Turns are marked as `<|start|>role\\n` ... `<|end|>\\n`. Inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so no text can forge a mark, and both are undone when reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(text: Column) -> Column:
    """Roles stand on a line of their own, so their line ends are escaped too."""
    return F.replace(escaped(text), F.lit("\n"), F.lit("\\n"))


def _plain_role(text: Column) -> Column:
    return unescaped(F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, target (its place from 0), last, formatted, loss_start, loss_length (code points, 0: no target).

    turns: conv_id, turn, role, text, in order of turn; equal turns in order of role and text. Null texts and roles
    are empty; null turns come first; rows without conv_id form one conversation. Repeated rows are turns of their own,
    long texts are kept whole, other columns don't matter, and an empty table gives an empty result. A conversation is
    one value of the output and is gathered as one; no other group is. Its examples hold all turns before their target,
    so n assistant turns make text that grows with n * n.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    marked = lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    each = each.select("conv_id", F.transform("t", marked).alias("m"), F.transform("t", lambda t: (t["role"] == "assistant")).alias("is"), F.size("t").alias("n"))
    picked = each.select("conv_id", "m", "n", F.posexplode("is").alias("target", "trainable")).filter("trainable or target = n - 1")
    whole = F.array_join(F.slice("m", F.lit(1), F.col("target") + 1), "")
    head = F.array_join(F.slice("m", F.lit(1), F.col("target")), "")
    own = F.element_at("m", F.col("target") + 1)
    before = F.length(head) + F.length(F.lit(START + "assistant\n"))
    span = F.length(own) - len(START + "assistant\n") - len(END)
    return picked.select(
        "conv_id", "target", (F.col("target") == F.col("n") - 1).alias("last"), whole.alias("formatted"),
        F.when(F.col("trainable"), before).otherwise(0).alias("loss_start"), F.when(F.col("trainable"), span).otherwise(0).alias("loss_length"),
    )


def trained_text(example: DataFrame) -> Column:
    """The text under the loss mask of an example, read back."""
    return unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))


def turns_in(formatted: Column) -> Column:
    """Turns (role, text) of a formatted example, read back."""
    pieces = F.slice(F.split(formatted, r"<\|start\|>", -1), 2, 1 << 30)
    role = lambda p: _plain_role(F.substring_index(p, "\n", 1))
    text = lambda p: unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def digests(example: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back: turns, text under the loss mask, size."""
    turns = F.when(F.col("last"), turns_in(F.col("formatted")))
    # an example's own parts are read before anything is grouped; the groups are already together
    parts = example.select("conv_id", "target", F.length("formatted").cast("long").alias("size"), F.when(F.col("loss_length") > 0, trained_text(example)).otherwise("").alias("lost"), turns.alias("turns"))
    each = parts.groupBy("conv_id").agg(
        F.sum("size").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "lost"))), lambda x: x["lost"]), "").alias("lost"), F.first("turns", ignorenulls=True).alias("turns"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return each.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def with_control_strings(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) plus conversation -7, whose texts hold the control strings of a common template.

    Turns that have this id already become one conversation with it, in order of turn, so that none is lost.
    """
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
