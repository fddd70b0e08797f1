"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree of token counts, kept as a row: the text, the leaves' lengths, and the
sums of every level. An update reads the stored trees and the edits alone. An edit touches some leaves; they and the
pre-tokens around them whose borders may move are cut and encoded again, up to the first old border from which on nothing
has changed. Only sums above these leaves are added up anew. An updated tree is stored and updated again as any other.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import shared_dir, small_batches
from seriesloom.llm.tokens import Encoder

Edit = tuple[int, int, str]
#: Children of a node, pre-tokens around an edit whose borders may move, and characters of a leaf that has become too coarse.
ARITY, CONTEXT, COARSE = 8, 3, 4096
#: Cleaning edits of the registered query: runs of three or more signs that carry no text, then hex secrets.
NOISE = re.compile(r"[#$%&*]{3,}")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])")
TREES = "doc_id long, text string, lengths binary, levels array<binary>, first_tokens long, edits long, encoded long"


def noise_edits(text: str) -> list[Edit]:
    """Runs of signs go. In order, without overlaps."""
    return [(m.start(), m.end(), "") for m in NOISE.finditer(text)]


def secret_edits(text: str) -> list[Edit]:
    """40-digit hex strings become <SECRET>. In order, without overlaps."""
    return [(m.start(), m.end(), "<SECRET>") for m in SECRET.finditer(text)]


def packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after one that says how many."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


class TokenTree:
    """levels[0] has the leaves' counts, levels[k] the sums of ARITY nodes each of the level before; the last is the total."""

    def __init__(self, encoder: Encoder, text: str, lengths: np.ndarray | None = None, levels: list[np.ndarray] | None = None):
        self.encoder, self.text, self.encoded = encoder, text, 0
        if lengths is None or levels is None:
            self.build()
        else:
            self.lengths, self.levels = lengths, levels

    def build(self) -> None:
        parts = self.encoder.pre_tokens(self.text)
        self.lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.levels = [self.encoder.counts(parts)]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.add.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), ARITY)))
        self.encoded += len(parts)

    @property
    def total(self) -> int:
        return int(self.levels[-1][0]) if len(self.levels[0]) else 0

    @property
    def leaves(self) -> int:
        return len(self.lengths)

    def put(self, first: int, lengths: list[int], counts: list[int]) -> None:
        """New leaves from ``first`` on, and the sums above them."""
        self.lengths[first : first + len(lengths)] = lengths
        self.levels[0][first : first + len(counts)] = counts
        a, b = first, first + len(counts)
        for below, above in zip(self.levels[:-1], self.levels[1:], strict=True):
            a, b = a // ARITY, -(-b // ARITY)
            above[a:b] = np.add.reduceat(below[a * ARITY : b * ARITY], np.arange(0, len(below[a * ARITY : b * ARITY]), ARITY))

    def apply(self, edits: list[Edit]) -> None:
        """Replace each text[start:end], given in order and without overlaps, by its new text."""
        if not edits:
            return
        old, reach = self.text, self.encoder.reach
        made, at = [], 0
        for start, end, new in edits:
            made += [old[at:start], new]
            at = end
        self.text = "".join([*made, old[at:]])
        full = np.flatnonzero(self.lengths)
        if not len(full):
            self.build()
            return
        starts = np.append(np.cumsum(self.lengths)[full] - self.lengths[full], len(old))  # of leaves that have text
        i = 0
        while i < len(edits):
            first = int(np.searchsorted(starts, max(0, edits[i][0] - reach), side="right")) - 1
            first = max(0, min(first, int(np.searchsorted(starts, edits[i][0], side="left")) - 1) - CONTEXT)
            j, room = i, 4
            while True:
                # up to here borders may differ; the leaves after it show where the old borders hold again
                last = int(np.searchsorted(starts, edits[j][1] + reach, side="left"))
                stop = min(last + CONTEXT + room, len(full))
                if j + 1 < len(edits) and edits[j + 1][0] - reach <= starts[min(stop + CONTEXT + 1, len(full))]:
                    j += 1
                    continue
                parts = self.encoder.pre_tokens(self._region(old, edits[i : j + 1], int(starts[first]), int(starts[stop])))
                if stop == len(full):
                    break
                ends = int(starts[stop]) - sum(map(len, parts)) + np.cumsum([len(p) for p in parts])  # in the old text's places, after the edits
                trusted = ends[: max(0, len(ends) - CONTEXT)]
                held = np.flatnonzero(np.isin(starts[last:stop], trusted[trusted >= edits[j][1] + reach]))
                if len(held):
                    stop = last + int(held[0])
                    parts = parts[: int(np.searchsorted(ends, starts[stop])) + 1]
                    break
                room *= 2
            self._replace(full, first, stop, parts)
            i = j + 1
        if self.lengths.max() > COARSE and len(self.encoder.pre_tokens(self.text)) > 2 * len(self.lengths):
            self.build()

    @staticmethod
    def _region(old: str, edits: list[Edit], start: int, stop: int) -> str:
        made, at = [], start
        for a, b, new in edits:
            made += [old[at:a], new]
            at = b
        return "".join([*made, old[at:stop]])

    def _replace(self, full: np.ndarray, first: int, stop: int, parts: list[str]) -> None:
        """Pre-tokens in place of the leaves from ``first`` to before ``stop``; what is too much goes to the last, what is too few leaves empty ones."""
        a, b = int(full[first]), int(full[stop]) if stop < len(full) else self.leaves
        lengths, counts = [len(p) for p in parts], self.encoder.counts(parts).tolist()
        n = b - a
        if len(parts) > n:
            lengths, counts = [*lengths[: n - 1], sum(lengths[n - 1 :])], [*counts[: n - 1], sum(counts[n - 1 :])]
        self.put(a, lengths + [0] * (n - len(lengths)), counts + [0] * (n - len(counts)))
        self.encoded += len(parts)


def tree_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (doc_id, tree, tokens at first, edits)."""
    types = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64()]
    made = [(doc_id, t.text, packed(t.lengths), [packed(x) for x in t.levels], first, edits, t.encoded) for doc_id, t, first, edits in rows]
    columns = list(zip(*made, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in TREES.split(", ")])


def build_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A stored tree for every row of docs; null texts count as empty. Rows that repeat get a tree each.

    Whole texts are cut, whatever their length; an empty table gives no rows, and other columns are ignored.
    """
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in small_batches(batches):
            trees = [TokenTree(encoder, t or "") for t in batch.column(1).to_pylist()]
            yield tree_rows([(i, t, t.total, 0) for i, t in zip(batch.column(0).to_pylist(), trees, strict=True)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(build, TREES)


def update_trees(trees: DataFrame, edits_of: Callable[[str], list[Edit]] | None = None, *, vocabulary: str | None = None) -> DataFrame:
    """Trees after a batch of edits; reads no more than the trees and the edits.

    Edits come from ``edits_of(text)``, or from a column ``edits`` (array of struct<start, end, text>, code points, in order,
    without overlaps; null for none) as with_edits adds it. ``edits`` and ``encoded`` of the result are this batch's number of
    edits and of pre-tokens encoded. Trees without edits stay as they are.
    """
    def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in small_batches(batches):
            rows = []
            given = batch.column(5).to_pylist() if edits_of is None else [None] * batch.num_rows
            for doc_id, text, lengths, levels, first, edits in zip(*(batch.column(k).to_pylist() for k in range(5)), given, strict=True):
                own = [(e["start"], e["end"], e["text"]) for e in edits or ()] if edits_of is None else edits_of(text)
                tree = TokenTree(encoder, text, unpacked(lengths), [unpacked(x) for x in levels])
                tree.apply(own)
                rows.append((doc_id, tree, first, len(own)))
            yield tree_rows(rows)

    columns = ["doc_id", "text", "lengths", "levels", "first_tokens"] + ["edits"] * (edits_of is None)
    return trees.select(*columns).mapInArrow(update, TREES)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with each document's edits, of a table (doc_id, start, end, text), as update_trees takes them.

    Rows that share a doc_id get the same edits; a null doc_id gets none.
    """
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text"))).alias("edits"))
    return trees.drop("edits").join(each, "doc_id", "left")


def store_trees(trees: DataFrame, path: str) -> DataFrame:
    """trees written as a table and read again, for later batches."""
    trees.write.option("compression", "zstd").parquet(path)
    return trees.sparkSession.read.parquet(path)


def token_total(levels: str = "levels") -> Column:
    """The count of a stored tree, from the one number of its last level; it is little-endian after a byte for the width."""
    last = F.substring(F.hex(F.element_at(levels, -1)), 3, 16)
    flipped = F.concat(*(F.substring(F.rpad(last, 16, "0"), 15 - 2 * i, 2) for i in range(8)))
    return F.coalesce(F.when(F.length(last) > 0, F.conv(flipped, 16, 10).cast("long")), F.lit(0).cast("long"))


def token_counts(docs: DataFrame, batches: list[Callable[[str], list[Edit]]], *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and per batch k from 1 edits_k, tokens_k and encoded_k, for every row of docs.

    The trees are stored under path (a folder of their own in the shared one if None) and every batch updates the trees that the
    one before has left. Null and empty texts have no tokens, texts without edits keep their count, repeated rows are counted each;
    very long texts are one tree each, an empty table gives no rows, and other columns of docs are ignored.
    """
    spark = docs.sparkSession
    trees = store_trees(build_trees(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary), path or f"{shared_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}")

    def follow(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        names = ["doc_id", "n_tokens"] + [f"{x}_{k}" for k in range(1, len(batches) + 1) for x in ("edits", "tokens", "encoded")]
        for batch in small_batches(parts):
            rows = []
            for doc_id, text, lengths, levels in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tree = None
                row = [doc_id, int(unpacked(levels[-1])[0]) if len(levels[-1]) > 1 else 0]
                total = row[1]
                for edits_of in batches:
                    edits, before = edits_of(tree.text if tree else text), tree.encoded if tree else 0
                    if edits:
                        tree = tree or TokenTree(encoder, text, unpacked(lengths), [unpacked(x) for x in levels])
                        tree.apply(edits)
                        total = tree.total
                    row += [len(edits), total, (tree.encoded if tree else 0) - before]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    schema = "doc_id long, n_tokens long" + "".join(f", edits_{k} long, tokens_{k} long, encoded_{k} long" for k in range(1, len(batches) + 1))
    return trees.select("doc_id", "text", "lengths", "levels").mapInArrow(follow, schema)
