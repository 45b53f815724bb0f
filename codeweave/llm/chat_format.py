"""Chat formatting by token-level assembly.

A turn is formatted as ``### role: text </turn>`` and a line end. The markers are reserved ids above the vocabulary,
spliced between the role's and the text's own ids, which are encoded separately: no merge crosses a marker and no text
can make one. In the written form, the marker strings inside a role or text are broken up by a backslash, reversibly.
The loss mask is a prefix sum: 1 is added at the marker that opens an assistant's text and taken away at its end.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import automaton, shared_vocabulary
from .scratch import small_batches

OPEN, ROLE_END, TURN_END = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    """``text`` without any marker string: a backslash before each backslash and inside what could be a marker."""
    text = text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(conversations: DataFrame, path: str) -> DataFrame:
    """``(conv_id, turn, formatted, ids array<int>, loss array<tinyint>)`` for every row of
    ``conversations(conv_id, turn, role, text)``; a conversation is its rows by turn, joined without a gap.

    Null role or text counts as empty. Each row is formatted on its own, without a shuffle. The markers' ids follow
    the vocabulary's greatest id.
    """
    spark = conversations.sparkSession
    small_batches(spark, 256)
    key, vocabulary = shared_vocabulary(spark, path)

    def run(batches):
        a = automaton(key, vocabulary.value)
        opened, role_end, turn_end = markers(a)
        for batch in batches:
            roles, texts = (["" if x is None else x for x in batch.column(i).to_pylist()] for i in (1, 2))
            segments = [escape(r, role=True) for r in roles], [escape(t) for t in texts]
            a.learn([*segments[0], *segments[1]])
            ids, loss, formatted = [], [], []
            for role, raw_role, text in zip(segments[0], roles, segments[1], strict=True):
                head, body = a.encode(role, special=False), a.encode(text, special=False)
                turn = [opened, *head, role_end, *body, turn_end]
                step = np.zeros(len(turn) + 1, dtype=np.int8)
                if raw_role == LOSS_ROLE:
                    step[len(head) + 2] += 1
                    step[len(turn) - 1] -= 1
                ids.append(turn)
                loss.append(np.cumsum(step, dtype=np.int8)[:-1])
                formatted.append(OPEN + role + ROLE_END + text + TURN_END)
            yield pa.RecordBatch.from_arrays([batch.column(0).field(0), batch.column(0).field(1), pa.array(formatted, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8()))], names=["conv_id", "turn", "formatted", "ids", "loss"])

    rows = conversations.select(F.struct("conv_id", "turn").alias("k"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, ids array<int>, loss array<tinyint>")


def markers(a) -> tuple[int, int, int]:
    top = max(a.label)
    return top + 1, top + 2, top + 3


class _Conversation:
    """Running digests of one conversation, so that one of any length takes constant memory."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.of_turns, self.of_loss = hashlib.sha256(), hashlib.sha256()

    def add(self, a, marks, formatted: str, ids: np.ndarray, loss: np.ndarray) -> None:
        cut = np.flatnonzero(ids == marks[1])[0]
        role = unescape(a.decode(ids[1:cut].tolist()))
        text = unescape(a.decode(ids[cut + 1 : -1].tolist()))
        self.of_turns.update(f"{role}\n{text}\n".encode())
        trained = unescape(a.decode(ids[loss.astype(bool)].tolist()))
        self.of_loss.update(trained.encode())
        self.turns, self.loss_chars, self.chars = self.turns + 1, self.loss_chars + len(trained), self.chars + len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.of_turns.hexdigest(), self.loss_chars, self.of_loss.hexdigest(), self.chars


def read_back(assembled: DataFrame, path: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the rows of ``assemble``.

    Turns are decoded from ids and masks. Rows of equal turn come in the order of their formatted text; repeated rows
    all count; a null conv_id is a conversation of its own. Rows are sorted (on disk where needed) and read as a
    stream, so a conversation is never held whole.
    """
    spark = assembled.sparkSession
    key, vocabulary = shared_vocabulary(spark, path)
    kind = assembled.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        a = automaton(key, vocabulary.value)
        marks = markers(a)
        now, done, arrow_kind = None, [], None

        def flush():
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            kinds = [arrow_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            arrow_kind = batch.column(0).type
            for conv, formatted, ids, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                now.add(a, marks, formatted, ids.values.to_numpy(), loss.values.to_numpy())
            if len(done) >= 1000:
                yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()

    ordered = assembled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "ids", "loss").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
