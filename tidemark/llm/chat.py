r"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered once, as a whole:

    <|turn|>role<|text|>text<|end|>  for each turn, in ascending order of the turn number

Texts cannot forge a mark: inside roles and texts a backslash is doubled and every control string of this or another
chat template gets a backslash after its first character.  A single backslash never stands before another one
otherwise, so dropping it restores the text.

The rendered text is encoded once, with offsets.  Token spans and turn spans are both sorted, so each turn finds its
tokens by two binary searches; the parts of tokens inside an assistant's text, merged, are the loss mask in characters.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import new_folder, ship

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, by how they begin.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(\\?)")
_PARSE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the span of each text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        at += len(head)
        spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARSE.finditer(formatted)]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens carry loss, and the merged parts of tokens inside the spans."""
    loss, merged = np.zeros(len(offsets), np.int8), []
    begins, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        if first >= last or a == b:
            continue
        loss[first:last] = 1
        low, high = np.maximum(begins[first:last], a), np.minimum(ends[first:last], b)
        reach = np.maximum.accumulate(high)
        cuts = np.flatnonzero(low[1:] > reach[:-1]) + 1
        merged += zip(low[np.r_[0, cuts]].tolist(), reach[np.r_[cuts - 1, len(reach) - 1]].tolist(), strict=True)
    return loss, merged


FORMATTED = "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_mask array<tinyint>, loss_spans array<struct<begin:long,end:long>>"


def format_conversations(rows: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, input_ids, loss_mask, loss_spans``.

    Turns are ordered by number, then role, then text; repeated turns stay repeated.  Null texts and roles are empty.
    Rows without a conversation identifier form one conversation.  One conversation is held in memory at a time, since
    it is one output row.  Identifiers are whole numbers, or what a cast to long accepts.  An empty table gives an empty
    result.
    """
    ship(rows.sparkSession)

    def work(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path).tokenizer
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
        names = [x.split()[0] for x in FORMATTED.split(", ")]

        def row(conv, turns):
            text, spans = render(turns)
            coded = enc.encode(text, add_special_tokens=False)
            loss, merged = mask(np.array(coded.offsets, np.int64).reshape(-1, 2), [s for s, (role, _) in zip(spans, turns, strict=True) if role in loss_roles])
            return conv, len(turns), text, coded.ids, loss, [{"begin": a, "end": b} for a, b in merged]

        def table(done):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        now, turns, done, size = None, [], [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and conv != now:
                    done.append(row(now, turns))
                    size += len(done[-1][2])
                    turns = []
                    if size > 1 << 22:
                        yield table(done)
                        done, size = [], 0
                now = conv
                turns.append((role, text))
        if turns:
            done.append(row(now, turns))
        if done:
            yield table(done)

    clean = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return clean.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text").mapInArrow(work, FORMATTED)


def write_conversations(rows: DataFrame, tokenizer_path: str, out_uri: str | None = None, **columns) -> DataFrame:
    """Write the formatted conversations as Parquet below ``out_uri`` and return the table read back."""
    spark = rows.sparkSession
    path = out_uri or new_folder(spark, "chat")
    formatted = format_conversations(rows, tokenizer_path, **columns)
    formatted.write.parquet(path)
    return spark.read.schema(formatted.schema).parquet(path)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_tokens long, n_tokens long"


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted table holds, from its rendered text and masks alone."""
    ship(formatted.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for conv, text, ids, loss, spans in zip(*(batch.column(k) for k in range(5)), strict=True):
                text = text.as_py()
                turns = parse(text)
                said = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans.as_py())
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv.as_py(), len(turns), _sha(whole), len(said), _sha(said), len(text), sum(loss.as_py()), len(ids)))
            if out:
                kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.select("conv_id", "formatted", "input_ids", "loss_mask", "loss_spans").mapInArrow(work, DIGESTS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
