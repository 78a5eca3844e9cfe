"""Chat formatting by event-sourced reconstruction (operator 9).

A conversation is a log of events on its messages, in sequence: ``open`` starts a
message with its role, ``delta`` appends text, ``edit`` replaces the text so far,
``regenerate`` discards it, ``delete`` withdraws the message until a later event
other than ``delta``. A message is named by conversation, turn and copy; folding a
message needs its last resetting event (a map-side-combined maximum) and the deltas
after it in sequence, so a conversation with a third of all events is folded by
message in many tasks.

Final messages are rendered in order by ranges of (conversation, turn, copy): a
conversation that spans ranges, or is long, becomes several chunks of whole turns.

The template is ``[TURN]role[SAYS]text[/TURN]``. In texts and roles each control
string gets a backslash after its bracket, and one that already has backslashes there
gets one more, so taking one away gives back the text exactly. The loss mask covers
the (escaped) texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored

#: Control strings of the template and of common chat formats.
TURN, SPLIT, END = "[TURN]", "[SAYS]", "[/TURN]"
CONTROL = [TURN, SPLIT, END, "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([\[<])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([\[<])\\(\\*)(?={_REST})")
LOSS_ROLE = "assistant"
DELTA_CHARS = 512
CHUNK_CHARS = 1 << 20
MESSAGE = ["conv_id", "turn", "copy"]
#: Events by the order in which equal sequence numbers take effect.
KINDS = ["open", "regenerate", "edit", "delete", "delta"]


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{SPLIT}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, first, last)`` per turn, with the place of its escaped text."""
    turns, at = [], 0
    while at < len(formatted):
        split = formatted.index(SPLIT, at)
        end = formatted.index(END, split)
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        first = split + len(SPLIT)
        turns.append((unescape(formatted[at + len(TURN):split]), unescape(formatted[first:end]),
                      first, end))
        at = end + len(END)
    return turns


def events_of_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The log ``(conv_id, turn, copy, seq, kind, role, text)`` of finished turns: each
    row opens a message and streams its text in deltas. Rows of one turn are told
    apart by ``copy``, in the order of role and text; repeated rows are messages of
    their own. Null roles and texts are empty."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"),
                        F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    placed = rows.withColumn("copy", F.row_number().over(same).cast("long"))
    opens = placed.select(*MESSAGE, F.lit(0).cast("long").alias("seq"), F.lit("open").alias("kind"),
                          "role", F.lit("").alias("text"))
    cuts = F.sequence(F.lit(0), F.ceil(F.length("text") / DELTA_CHARS).cast("int") - 1)
    deltas = placed.where("text <> ''").withColumn("k", F.explode(cuts)).select(
        *MESSAGE, (F.col("k") + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"),
        F.lit(None).cast("string").alias("role"),
        F.substring(F.col("text"), F.col("k") * DELTA_CHARS + 1, F.lit(DELTA_CHARS)).alias("text"))
    return opens.unionByName(deltas)


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, copy, role, text)`` of a log of events.

    Equal ``seq`` take effect in the order of ``KINDS``, then of the text; of equal
    resetting events one counts, equal deltas all count. A null text adds nothing, a
    null role changes nothing, a message without any role has the empty role, and a
    null or unknown kind is no event. Deleted messages are left out."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    events = log.select(
        *[F.coalesce(F.col(c), F.lit(-1 << 62)).alias(c) for c in MESSAGE],
        F.struct(F.col("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("e"),
        "role").where("e.rank >= 0")
    resets = stored(events.groupBy(*MESSAGE).agg(
        F.max(F.when(F.col("e.rank") < 4, F.col("e"))).alias("reset"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("e.seq", "e.rank", "role"))
                 ).alias("role")), "chat-resets")
    later = events.where("e.rank = 4").drop("role").join(
        resets.select(*MESSAGE, "reset"), MESSAGE).where("reset is null or e > reset")
    # A group is one message: its text has to be one string anyway.
    texts = later.groupBy(*MESSAGE).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("e")), lambda e: e["text"]), "").alias("after"))
    folded = resets.where("reset is null or reset.rank <> 3").join(texts, MESSAGE, "left")
    return folded.select(
        *[F.nullif(F.col(c), F.lit(-1 << 62)).alias(c) for c in MESSAGE],
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.coalesce("reset.text", F.lit("")), F.coalesce("after", F.lit(""))).alias("text"))


def formatted(messages: DataFrame) -> DataFrame:
    """Chunks ``(conv_id, turn, copy, formatted, loss)`` of rendered conversations.

    A chunk holds whole turns from (turn, copy) on; the chunks of a conversation in
    that order are its text. ``loss`` lists the spans (code points of the chunk, end
    exclusive) under the loss mask."""
    def render(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("copy", pa.int64()),
                          ("formatted", pa.string()),
                          ("loss", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
        start, parts, loss, size = None, [], [], 0

        def flush() -> dict:
            return {"conv_id": start[0], "turn": start[1], "copy": start[2],
                    "formatted": "".join(parts), "loss": loss}

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if start is not None and (start[0] != row["conv_id"] or size > CHUNK_CHARS):
                    done.append(flush())
                    start, parts, loss, size = None, [], [], 0
                if start is None:
                    start = (row["conv_id"], row["turn"], row["copy"])
                turn = render_turn(row["role"], row["text"])
                if row["role"] == LOSS_ROLE:
                    loss.append({"first": size + turn.index(SPLIT) + len(SPLIT),
                                 "last": size + len(turn) - len(END)})
                parts.append(turn)
                size += len(turn)
            yield pa.RecordBatch.from_pylist(done, kind)
        if start is not None:
            yield pa.RecordBatch.from_pylist([flush()], kind)

    return messages.repartitionByRange(*MESSAGE).sortWithinPartitions(*MESSAGE).mapInArrow(
        render, "conv_id long, turn long, copy long, formatted string, "
                "loss array<struct<first:long,last:long>>")


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, read back from its chunks in order: number and digest of the
    turns, length and digest of the text under the loss mask, length of the format."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])
        at = None

        def row() -> dict:
            return dict(zip(names, (at[0], at[1], at[2].hexdigest(), at[3], at[4].hexdigest(), at[5])))

        for batch in batches:
            done = []
            for chunk in batch.to_pylist():
                if at is not None and at[0] != chunk["conv_id"]:
                    done.append(row())
                    at = None
                if at is None:
                    at = [chunk["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = chunk["formatted"]
                for role, said, _, _ in parse(text):
                    at[1] += 1
                    at[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in chunk["loss"]:
                    said = unescape(text[span["first"]:span["last"]])
                    at[3] += len(said)
                    at[4].update(said.encode("utf-8", "surrogatepass"))
                at[5] += len(text)
            yield pa.RecordBatch.from_pylist(done, kind)
        if at is not None:
            yield pa.RecordBatch.from_pylist([row()], kind)

    # Rows here are chunks, one for most conversations; long ones stream chunk by chunk.
    return chunks.repartition("conv_id").sortWithinPartitions(*MESSAGE).mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                "loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame, **columns) -> DataFrame:
    """Finished turns through the event log to stored chunks (see :func:`formatted`).
    Conversations with a null id are one conversation; null turns come first."""
    return stored(formatted(reconstruct(events_of_turns(turns, **columns))), "chat-formatted")
