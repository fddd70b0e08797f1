"""Packing token ids into sequences: bounded-space best fit, online within each partition.

A partition streams its documents and keeps a fixed number of open windows. Whole windows of a long document are sequences
of their own; the rest goes to the open window that it fills best, and when none has room the fullest one is
emitted. What is still open at the end of the partitions is merged in rounds, so many partitions at a time.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import checkpointed, small_batches
from seriesloom.llm.tokens import Encoder

WINDOW, OPEN_WINDOWS, MERGED_AT_ONCE = 1024, 64, 32
END = (0).to_bytes(4, "little")
FIELDS = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("part", "int"), ("open", "boolean")]


class OpenWindows:
    """At most ``most`` windows, found by free space."""

    def __init__(self, window: int, most: int, first_id: int):
        self.window, self.most, self.next_id = window, most, first_id
        self.free: list[tuple[int, int]] = []  # (free, sequence), in order
        self.held: dict[int, list] = {}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int, piece: list) -> tuple[int, list] | None:
        """Put a piece shorter than a window where it leaves least room; returns the window that closes, if any."""
        at = bisect.bisect_left(self.free, (length, -1))
        gone = None
        if at < len(self.free):
            free, sequence = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                gone = self.pop_fullest()
            free, sequence = self.window, self.new_id()
            self.held[sequence] = []
        self.held[sequence].append((piece, self.window - free))
        if free == length:  # shorter than a window, so the window is not new and none had to go
            return sequence, self.held.pop(sequence)
        bisect.insort(self.free, (free - length, sequence))
        return gone

    def pop_fullest(self) -> tuple[int, list]:
        _, sequence = self.free.pop(0)
        return sequence, self.held.pop(sequence)

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.free:
            yield self.pop_fullest()


def packer(path: str | None, window: int, open_windows: int, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(path), TaskContext.get().partitionId()
        windows = OpenWindows(window, open_windows, part << 32)
        out: list[tuple] = []

        def emit(closed: tuple[int, list] | None, still_open: bool = False) -> None:
            if closed:
                out.extend((*piece[:5], closed[0], offset, part, still_open, *piece[5:]) for piece, offset in closed[1])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * (len(FIELDS) + with_ids)
            types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t] for _, t in FIELDS] + [pa.binary()] * with_ids
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[n for n, _ in FIELDS] + ["ids"] * with_ids)

        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encoder.ids(text or "").astype("<u4").tobytes() + END)
                total = len(ids) // 4
                for start in range(0, total, window):
                    part_ids = ids[4 * start : 4 * (start + window)]
                    length = len(part_ids) // 4
                    piece = [doc_id, start, length, zlib.crc32(part_ids), total, *([bytes(part_ids)] if with_ids else [])]
                    if length == window:
                        emit((windows.new_id(), [(piece, 0)]))
                    else:
                        emit(windows.place(length, piece))
            yield flush()
        for closed in windows.rest():
            emit(closed, True)
        yield flush()

    return pack


def merger(window: int, open_windows: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Best fit over the pieces of a group's open windows, largest first; all but the emptiest windows close."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        windows = OpenWindows(window, len(pdf) + 1, (level << 56) | (int(pdf["part"].iloc[0]) << 24))
        done = []
        for row, length in enumerate(pdf["length"].tolist()):
            closed = windows.place(length, row)
            if closed:
                done.append((*closed, False))
        rest = list(windows.rest())
        keep_open = 0 if last else open_windows
        done += [(*x, i >= len(rest) - keep_open) for i, x in enumerate(rest)]
        rows, sequences, offsets, still = [], [], [], []
        for sequence, held, is_open in done:
            for row, offset in held:
                rows.append(row)
                sequences.append(sequence)
                offsets.append(offset)
                still.append(is_open)
        return pdf.iloc[rows].assign(sequence_id=sequences, offset=offsets, open=still)

    return merge


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids are its text's and a final 0; null and empty texts are the 0 alone. Each id lies in one piece;
    a document longer than the window gives whole windows and a rest. Sequence ids are unique but not consecutive; the
    pieces of a sequence follow each other from offset 0. Repeated rows are packed each; an empty table gives no rows.
    """
    schema = ", ".join(f"{n} {t}" for n, t in FIELDS) + ", ids binary" * with_ids
    made = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(packer(vocabulary, window, open_windows, with_ids), schema)
    pieces = checkpointed(made)
    done, left, level = [pieces.where("not open")], pieces.where("open"), 0
    most = left.agg(F.max("part")).first()[0]
    while most is not None:
        level, most = level + 1, most // MERGED_AT_ONCE
        grouped = left.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE).cast("int")).groupBy("part")
        merged = checkpointed(grouped.applyInPandas(merger(window, open_windows, level, most == 0), schema))
        done.append(merged.where("not open"))
        left = merged.where("open")
        if most == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open")
