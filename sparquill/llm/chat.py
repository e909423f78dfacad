"""Conversations as text, by templates compiled to Python closures (templates.py), and read back from it.

A conversation of any length is rendered as its turns arrive.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .templates import FILTERS, TemplateError, compile_template, fold_body, parse  # noqa: F401 (for users of this module)

TURNS = """{% for turn in turns %}### {{ turn.role | escape_name }}: {% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %} </turn>
{% endfor %}"""

#: A turn as TURNS writes it; the text group ends with the space before its end marker.
_TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_conversations(turns: DataFrame, template: str = TURNS, segment: int = 1_000_000, variables: dict[str, object] | None = None, trim_blocks: bool = False) -> DataFrame:
    """conv_id, seq, formatted, spans: the text of each conversation, its turns ordered by turn, then role and text.

    spans are the (start, end) code points of the segment that are to be learned. A conversation longer than
    segment goes on in further rows, numbered by seq, in the same partition and in order: no task holds a
    whole conversation. Null roles and texts count as empty, repeated rows as turns of their own, turns with a null number
    come first, and a null conv_id is a conversation like any other. An empty table has no rows; further columns are not read.

    A turn has role, text and, the same, content. variables and trim_blocks as in compile_template. A template that can't be
    compiled is refused at once; one that raises (raise_exception, a turn out of reach) ends the job.
    """
    compile_template(template, variables, trim_blocks)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in C.batches(it):
            for row in batch.to_pylist():
                row["content"] = row["text"]
                yield row

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, variables, trim_blocks)
        out: list[tuple] = []
        held = 0
        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema)

        for conv, own in itertools.groupby(stream(it), lambda r: r["conv_id"]):
            seq, size, texts, spans = 0, 0, [], []
            for text, learn in render(own):
                if size and size + len(text) > segment:
                    out.append((conv, seq, "".join(texts), spans))
                    held, seq, size, texts, spans = held + size, seq + 1, 0, [], []
                    if held > segment:
                        yield batch()
                        out, held = [], 0
                if learn:
                    spans.append({"start": size, "end": size + len(text)})
                texts.append(text)
                size += len(text)
            out.append((conv, seq, "".join(texts), spans))
            held += size
            if held > segment:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(run, "conv_id long, seq int, formatted string, spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of format_conversations with TURNS says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows = (r for batch in it for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist())
        done: list[tuple] = []
        for conv, own in itertools.groupby(rows, lambda r: r["conv_id"]):
            turns, loss, n, chars, total, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for r in own:
                total += len(r["formatted"])
                for s in r["spans"]:
                    text = unescape(r["formatted"][s["start"] : s["end"]])
                    chars += len(text)
                    loss.update(text.encode())
                rest, at = rest + r["formatted"], 0
                while m := _TURN.match(rest, at):
                    n, at = n + 1, m.end()
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2][:-1])}\n".encode())
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {conv} cannot be read back")
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
