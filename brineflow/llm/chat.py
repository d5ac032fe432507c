r"""Chat formatting with a loss mask that is aligned to token offsets.

A conversation is rendered whole as ``<|start|>role<|text|>text<|end|>`` per
turn and encoded once, with offsets. The three control strings are tokens of
their own, so no token crosses the bounds of a text, and equal texts between them,
which have equal tokens, are encoded once in a batch. A token's offset is the sum of
the bytes of those before it; the spans of the assistant's texts are intersected with
the tokens by binary search. Inside
roles and texts ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so that texts
that look like the template stay text; :func:`unescape` is the exact inverse.

Turns are sorted by (conversation, turn, role, text) over all tasks. A
conversation of more than ``PIECE_TURNS`` turns, or one that lies on the bound
of two tasks, is kept in several consecutive pieces; a piece starts and ends at
turns, where the control tokens end any match, so the pieces' ids in a row are
those of the whole. Only such conversations are brought together to be read back.

Defined results: a null text or role is empty; an empty text has no tokens
under the mask; turns that share a number are ordered by role, then text;
repeated turns are all kept; a null conversation id is a conversation of its
own; an empty table gives no pieces. Other columns are not kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineflow import runtime
from brineflow.llm.idstore import LibraryEncoder

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
PIECE_TURNS = 256
PIECE = "conv_id bigint, part int, piece bigint, whole boolean, formatted string, token_ids array<int>, mask_spans array<int>"
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """The formatted text, and what stands between its control strings: role and text of each turn in turn, escaped."""
    between = [escape(x) for turn in turns for x in turn]
    return "".join(f"{START}{r}{TEXT}{t}{END}" for r, t in zip(between[::2], between[1::2], strict=True)), between


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class ChatEncoder:
    """The tokenizer with the three control strings as ids of their own, and the bytes of each id."""

    def __init__(self, blob: str):
        self.encoder = LibraryEncoder(blob)
        own = len(self.encoder.n_bytes)
        controls = [c.encode() for c in (START, TEXT, END)]
        self.control = [np.asarray([own + k], "<u4").tobytes() for k in range(3)]
        self.bytes_of = [*self.encoder.bytes_of(), *controls]
        self.n_bytes = np.asarray([len(b) for b in self.bytes_of], np.int64)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without control strings, as 32-bit integers."""
        column = pa.array(texts, pa.string()).dictionary_encode()
        made = [np.frombuffer(b, self.encoder.width).astype("<u4").tobytes() for b in self.encoder.encode(column.dictionary)]
        return list(map(made.__getitem__, column.indices.to_pylist()))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")

    def tokens(self, turns: list[tuple[str, str]], between: list[str], known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a rendered conversation, and the token spans (start and end in turn) of the assistant's texts."""
        start, text, end = self.control
        ids = np.frombuffer(b"".join(start + r + text + t + end for r, t in zip(known[::2], known[1::2], strict=True)), "<u4")
        width = self.n_bytes[ids]
        offsets = np.cumsum(width) - width
        sizes = np.asarray([len(x.encode("utf-8", "surrogatepass")) for x in between], np.int64)
        fixed = np.tile(np.asarray([len(START), len(TEXT) + len(END)], np.int64), len(turns))
        # A text starts after its turn's two first control strings and all that is before them.
        before = np.cumsum(sizes) - sizes + np.cumsum(fixed) - np.tile([0, len(END)], len(turns))
        mine = 2 * np.flatnonzero([role == "assistant" for role, _ in turns]) + 1
        return ids, mask_spans(offsets, np.column_stack([before[mine], before[mine] + sizes[mine]]))


def mask_spans(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Token spans (start and end in turn) of sorted spans of the text, by binary search over the tokens' starts."""
    return np.searchsorted(offsets, spans.reshape(-1), "left").astype(np.int32)


_ENCODERS: dict[int, ChatEncoder] = {}


def encoder_of(blob: str) -> ChatEncoder:
    """One for each worker process, so that what it remembers outlives a task."""
    key = zlib.crc32(blob.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChatEncoder(blob)
    return _ENCODERS[key]


def format_chats(turns: DataFrame, tokenizer_path: str, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """The pieces of all conversations, written to the shared folder."""
    spark = turns.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())  # the vocabulary: a file of a few MB
    clean = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = clean.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of(blob.value), TaskContext.get().partitionId()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        schema = pa.schema(list(zip([c.split()[0] for c in PIECE.split(", ")], types, strict=True)))
        number = 0

        def made(groups: list[tuple[int | None, list, bool]]) -> pa.RecordBatch:
            nonlocal number
            drawn = [render(g) for _, g, _ in groups]
            known, rows = encoder.ids_of([x for _, between in drawn for x in between]), []
            for (conv_id, g, whole), (text, between) in zip(groups, drawn, strict=True):
                ids, spans = encoder.tokens(g, between, known[: len(between)])
                known = known[len(between) :]
                rows.append((conv_id, part, number, whole, text, ids.astype(np.int32), spans))
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

        open_: list[tuple[str, str]] = []
        conv, first, alone, done = None, True, True, []
        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if open_ and (c != conv or len(open_) >= piece_turns):
                    # The first and the last conversation of a task may go on in another.
                    done.append((conv, open_, c != conv and alone and not first))
                    first, alone = first and c == conv, c != conv
                    open_ = []
                    if len(done) >= 128:
                        yield made(done)
                        done = []
                conv = c
                open_.append((role, text))
        if open_:
            done.append((conv, open_, False))
        if done:
            yield made(done)

    return runtime.save(ranged.mapInArrow(run, PIECE), "chats")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest(pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """Read the pieces back, in order: turns from the formatted text, the loss from ids and mask.

    The pieces of a conversation are streamed through running digests, so its length does not matter; conversations
    of one piece are read where they lie.
    """
    spark = pieces.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = spark.sparkContext.broadcast(f.read())
    columns = ["conv_id", "formatted", "token_ids", "mask_spans"]
    split = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(blob.value)
        state, conv, rows = None, None, []

        def fields() -> dict:
            return {"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            ids_at, span_at = batch.column(2).offsets.to_pylist(), batch.column(3).offsets.to_pylist()
            all_ids, all_spans = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for i, (conv_id, formatted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if state is None or conv_id != conv:
                    if state is not None:
                        rows.append(fields())
                    state, conv = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv_id
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                ids, spans = all_ids[ids_at[i] : ids_at[i + 1]], all_spans[span_at[i] : span_at[i + 1]].tolist()
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    text = unescape(encoder.decode(ids[a:b]))
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if len(rows) >= 512:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if state is not None:
            rows.append(fields())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pieces.where("whole").select(*columns).mapInArrow(run, DIGEST).unionByName(split.mapInArrow(run, DIGEST))


#: The conversation that the contract adds: both turns look like a template of their own (fixed value).
EXTRA = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = runtime.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string")
    return digest(format_chats(turns.unionByName(extra), path), path)
