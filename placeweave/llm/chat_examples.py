"""Chat formatting by prefix-target expansion: one training example per assistant turn.

An example is the formatted text of all turns before the reply (``context``), the opening of the reply's turn, the reply
(``target``, the only part under the loss mask) and its closing. Turns after the last reply make one more example without a
target, so that nothing of a conversation is lost.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<`` backslash ``|``, so no text can open or close a turn; reading back turns every backslash pair into its second
character. A newline in a role is written as backslash ``n`` ``|``.

An example's context grows with the turns before it, so a conversation's output grows with the square of its turns; that is
what the method asks for, and nothing is cut off.

Defined results: null text or role is empty; equal turn numbers are ordered by role and text; repeated rows are turns of
their own; a null conv_id is a conversation; an empty table gives only what is added to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(n\||.)", re.S)


def _escape(column: F.Column) -> F.Column:
    doubled = F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n|" else m[1], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn_no, context, target, closing``: the examples. ``turn_no`` counts a conversation's turns from 1."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opening = F.concat(F.lit(OPEN), F.replace(_escape(F.col("role")), F.lit("\n"), F.lit("\\n|")), F.lit("\n"))
    turns = conversations.select(
        "conv_id", "turn", "role", "text", opening.alias("opening"), _escape(F.col("text")).alias("said"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("reply"))
    turns = turns.withColumns({
        "turn_no": F.row_number().over(order),
        "turns": F.count(F.lit(1)).over(Window.partitionBy("conv_id")),
        "before": F.concat_ws("", F.collect_list(F.concat("opening", "said", F.lit(CLOSE))).over(
            order.rowsBetween(Window.unboundedPreceding, -1)))})
    return turns.filter("reply OR turn_no = turns").select(
        "conv_id", "turn_no",
        F.when(F.col("reply"), F.concat("before", "opening")).otherwise(F.concat("before", "opening", "said", F.lit(CLOSE))).alias("context"),
        F.when(F.col("reply"), F.col("said")).alias("target"),
        F.when(F.col("reply"), F.lit(CLOSE)).otherwise(F.lit("")).alias("closing"))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples say, read back from their text: turns, loss and lengths of each conversation."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for conv, turn, context, target, closing in frame.itertuples(index=False):
                whole = context + (target or "") + closing
                turns = parse(whole)
                rows.append((conv, turn, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             None if target is None else unescape(target), len(whole)))
            yield pd.DataFrame(rows, columns=["conv_id", "turn_no", "n_turns", "turns_sha256", "loss", "chars"])

    conv = examples.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {conv}, turn_no int, n_turns long, turns_sha256 string, loss string, chars long"
    parts = examples.select("conv_id", "turn_no", "context", "target", "closing").mapInPandas(read, shape)
    losses = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "loss"))), lambda s: s["loss"]))
    return parts.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max_by("turns_sha256", "n_turns").alias("turns_sha256"), losses.alias("loss"),
        F.sum("chars").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
