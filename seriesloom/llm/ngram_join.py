"""Jaccard join on word n-grams with signature trees.

Blocking. Two sets of sizes a <= b that link differ in at most 15 (a + b) / 185 elements (for 85 %). Sizes fall into
classes such that linked sets lie in one class or two that follow each other. For the class of the smaller set, hash ranges cut every
set into m segments, more than that number d of differences, so that at least m - d are the same in both. With m - d = spare
+ 1, every set may leave out its ``spare`` least telling segments under an order that depends on a segment's content alone:
of those that two linked sets share, the most telling one has at least ``spare`` others after it in both, so neither
leaves it out. Telling are segments with a rare shingle; how common shingles are comes from counts over all
documents, hashed into a fixed number of counters. The d + 1 segments that stay, hashed with class and position, are a set's
signatures; sets that share one are candidates.

Trees. Candidates form groups (connected components of shared signatures, a star per signature, never all pairs). A group is cut
into blocks by a budget of shingles; each block is a signature tree whose dual traversal with itself finds its links, and a few
sets of the group, the hubs, join in every block. Between blocks the traversal starts at their roots: pairs of blocks whose
root signatures leave no possible overlap, or whose members are all joined already, go before any set is shipped, and what
is joined already is left out below. Equal sets count once throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.components import components
from seriesloom.llm.shared import checkpointed, groups_in_order, joined_anew, runs_of, small_batches
from seriesloom.llm.shingles import EMPTY, Hasher, digest, mixed
from seriesloom.llm.signature_tree import block_signature, linked, may_link

WORDS, PERCENT = 4, 85
#: Shingles of a block, and the sets that it has at least where that makes more blocks than tasks can use.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 19, 64
#: Counters of how common shingles are, in chunks, and the groups of tasks in which they are first added up.
COUNTERS, CHUNK, ADDED_AT_ONCE = 1 << 20, 1 << 14, 64
#: Signatures that a task holds before it passes them on.
HELD = 1 << 20
_U = np.uint64
MAPPED = "bin int, sigs binary, owners binary, uid long, v long, doc_id long, mark long, n long, d1 long, d2 long"
FOUND = "u long, v long, doc_id long, mark long, n long, d1 long, d2 long"
COUNTED = "chunk int, part int, places binary, counts binary"


# --- how common shingles are ------------------------------------------------------------------------------------------


def packed_counts(part: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per chunk of counters, with those that are not 0."""
    for start in range(0, len(counts), CHUNK):
        own = counts[start : start + CHUNK]
        at = np.flatnonzero(own)
        if len(at):
            yield counted_row(start // CHUNK, part, at, own[at])


def counted_row(chunk: int, part: int, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([counts.astype("<u8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in COUNTED.split(", ")])


def counter(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of shingles by the low bits of their hashes, over a task's texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, held, seen = Hasher(width), np.zeros(COUNTERS, dtype=np.int64), [EMPTY[0]], 0
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                held.append(hasher.shingles(text, halves=1)[0])
                seen += len(held[-1])
            if seen >= COUNTERS:
                counts += np.bincount((np.concatenate(held) & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                held, seen = [EMPTY[0]], 0
        counts += np.bincount((np.concatenate(held) & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield from packed_counts(TaskContext.get().partitionId(), counts)

    return count


def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and part, of rows in that order."""
    counts, now = np.zeros(CHUNK, dtype=np.int64), None

    def row() -> Iterator[pa.RecordBatch]:
        if now is not None:
            at = np.flatnonzero(counts)
            yield counted_row(*now, at, counts[at])
            counts[:] = 0

    for batch in batches:
        for key, rows in runs_of(batch, 2):
            if key != now:
                yield from row()
                now = key
            for at, own in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                counts[np.frombuffer(at, dtype="<u2")] += np.frombuffer(own, dtype="<u8").astype(np.int64)
    yield from row()


def commonness(source: DataFrame, width: int) -> np.ndarray:
    """A level for each counter, twice the binary logarithm of its count, over all documents.

    Tasks' counts are added up in two rounds; the driver gets a table of COUNTERS entries whatever the input is.
    """
    made = source.select("text").mapInArrow(counter(width), COUNTED)
    for part in (F.col("part") % ADDED_AT_ONCE, F.lit(0)):
        dealt = made.withColumn("part", part).repartition("chunk", "part").sortWithinPartitions("chunk", "part")
        made = dealt.mapInArrow(added, COUNTED)
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for row in made.collect():
        at, counts = np.frombuffer(row["places"], dtype="<u2"), np.frombuffer(row["counts"], dtype="<u8")
        out[row["chunk"] * CHUNK + at.astype(np.int64)] = np.floor(2 * np.log2(counts))
    return out


# --- signatures -------------------------------------------------------------------------------------------------------


def classes(percent: int) -> tuple[list[int], list[int]]:
    """First size of each class, and the most differences of linked sets whose smaller one is in the class."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    most = []
    for following in starts[1:]:
        a = following - 1
        most.append((100 - percent) * (a + a * 100 // percent) // (100 + percent))
    return starts, most


class Signer:
    """Signatures of sets for one threshold."""

    def __init__(self, percent: int, levels: np.ndarray):
        self.percent, self.levels = percent, levels
        self.starts, self.most = classes(percent)

    def signatures(self, own: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set that is not empty, from the first halves of its hashes."""
        own, n = own[0], own.shape[1]
        c = int(np.searchsorted(self.starts, n, side="right")) - 1
        common = self.levels[(own & _U(len(self.levels) - 1)).astype(np.int64)]
        content, out = mixed(own), []
        for scheme in (c, c - 1):
            if scheme < 0 or n > (self.starts[scheme + 1] - 1) * 100 // self.percent:
                continue
            spare = self.most[scheme]
            m = 2 * spare + 1
            place = ((own >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            count = np.bincount(place, minlength=m)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            sums, rarest = np.zeros(m, dtype=np.uint64), np.full(m, 255, dtype=np.uint8)
            sums[place[first]] = np.add.reduceat(content, first)
            rarest[place[first]] = np.minimum.reduceat(common, first)
            names = mixed(mixed(sums + count.astype(np.uint64)) + np.arange(m, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(scheme << 40))
            out.append(names[np.lexsort((names, -count, rarest))[: m - spare]])
        return np.concatenate(out)


def mapper(width: int, percent: int, levels: np.ndarray, bins: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document, and for each bin the signatures that fall into it with the positions of their owners.

    Owners are numbered within the task; the first document with a set stands for all in the task that have it. Of a
    signature's owners in the task the first one goes on, and the others are tied to it at once, so that a bin gets a very
    common signature no more often than there are tasks.
    """

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        types = {"bin": pa.int32(), "sigs": pa.binary(), "owners": pa.binary()}
        names = [x.split()[0] for x in MAPPED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns.get(x, [None] * n), types.get(x, pa.int64())) for x in names], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer, base, known = Hasher(width), Signer(percent, levels), TaskContext.get().partitionId() << 32, {}
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sigs, own = np.concatenate(held), np.concatenate(owners)
            held.clear()
            owners.clear()
            order = np.lexsort((own, sigs))
            sigs, own = sigs[order], own[order]
            fresh, centre = starred(sigs, own)
            ties = np.unique(np.stack([own[~fresh], centre[~fresh]], axis=1), axis=0).astype(np.int64) + base
            sigs, own = sigs[fresh], own[fresh]
            at = ((sigs >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(cuts[1:], len(at))
            yield rows(bin=at[cuts].tolist(), sigs=[sigs[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], owners=[own[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], uid=[base] * len(cuts))
            if len(ties):
                yield rows(bin=(bins + ties[:, 0] % bins).tolist(), uid=ties[:, 0].tolist(), v=ties[:, 1].tolist())

        seen = 0
        for batch in small_batches(batches):
            uids, digests, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                own = hasher.set_of(text)
                key = digest(own)
                if key not in known:
                    known[key] = len(known)
                    if own.shape[1]:
                        new = signer.signatures(own)
                        held.append(new)
                        owners.append(np.full(len(new), known[key], dtype=np.uint32))
                        seen += len(new)
                uids.append(base + known[key])
                digests.append(key)
                sizes.append(own.shape[1])
            spread = [bins + u % bins for u in uids]
            yield rows(bin=spread, uid=uids, doc_id=batch.column(0).to_pylist(), mark=batch.column(2).to_pylist(), n=sizes, d1=[d[0] for d in digests], d2=[d[1] for d in digests])
            if seen >= HELD:
                yield from flush()
                seen = 0
        if held:
            yield from flush()

    return run


def starred(sigs: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs in order: whether the signature is new, and the first owner of each one's signature."""
    fresh = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    return fresh, owners[np.maximum.accumulate(np.where(fresh, np.arange(len(sigs)), 0))]


def binned(table: pa.Table) -> pa.Table:
    """Rows of documents and ties as they are; of a bin's signatures a star for each that several owners have."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    if table.column("sigs").null_count:
        return pa.table([table.column("uid"), *(table.column(x) for x in names[1:])], names=names)
    sigs = np.frombuffer(b"".join(table.column("sigs").to_pylist()), dtype=np.uint64)
    parts = [np.frombuffer(o, dtype=np.uint32).astype(np.int64) + base for o, base in zip(table.column("owners").to_pylist(), table.column("uid").to_pylist(), strict=True)]
    owners = np.concatenate(parts)
    order = np.lexsort((owners, sigs))
    sigs, owners = sigs[order], owners[order]
    fresh, centre = starred(sigs, owners)
    edges = np.unique(np.stack([owners[~fresh], centre[~fresh]], axis=1), axis=0)
    n = len(edges)
    return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1]), *(pa.nulls(n, pa.int64()) for _ in names[2:])], names=names)


# --- trees ------------------------------------------------------------------------------------------------------------

#: What the tree of a block gives: links (u, v); of a group of several blocks also the sets, and for each block its root's signature.
TREES = "u long, v long, root long, block int, uid long, own binary, low long, high long, hidden long, bits binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def tree_rows(n: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in TREES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(x, [None] * n), t) for x, t in zip(names, _TYPES, strict=True)], names=names)


def edge_rows(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return tree_rows(len(edges), u=[a for a, _ in edges], v=[b for _, b in edges])


def within_blocks(width: int, percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows are (root, block, uid, blocks, home, d1, d2, text) in order of root and block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        for (root, block), rows in groups_in_order(batches, 2):
            found: dict[int, tuple[np.ndarray, bool]] = {}
            for row in (r for part in rows.to_batches(max_chunksize=64) for r in part.to_pylist()):
                if row["uid"] not in found:
                    own = hasher.set_of(row["text"])
                    if digest(own) == (row["d1"], row["d2"]):  # another text may have the same identifier and mark
                        found[row["uid"]] = own, row["home"] == block
            uids = sorted(found)
            sets = [found[u][0] for u in uids]
            yield edge_rows([(uids[a], uids[b]) for a, b in linked(sets, None, percent)])
            if rows.column("blocks")[0].as_py() > 1:
                at_home = [u for u in uids if found[u][1]]
                for u in at_home:
                    yield tree_rows(1, root=[root], block=[block], uid=[u], own=[found[u][0].tobytes()])
                if at_home:
                    low, high, hidden, bits = block_signature([found[u][0] for u in at_home])
                    yield tree_rows(1, root=[root], block=[block], low=[low], high=[high], hidden=[hidden], bits=[bits])

    return run


def overlapping(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs of blocks whose root signatures leave a possible overlap; rows are (root, i, j, and both signatures)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                both = int(np.bitwise_count(np.frombuffer(r["bits"], np.uint8) & np.frombuffer(r["other_bits"], np.uint8)).sum())
                keep.append(may_link((r["low"], r["high"]), (r["other_low"], r["other_high"]), both + min(r["hidden"], r["other_hidden"]), percent))
            yield batch.select(["root", "i", "j"]).filter(pa.array(keep, pa.bool_()))

    return run


def between_blocks(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows are (root, i, j, block, uid, label, own) in order of root, i and j."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groups_in_order(batches, 3):
            sides = {i: [], j: []}
            for uid, label, block, own in zip(*(rows.column(x).to_pylist() for x in ("uid", "label", "block", "own")), strict=True):
                sides[block].append((uid, label, np.frombuffer(own, dtype=np.uint64).reshape(2, -1)))
            first, second = sorted(sides[i], key=lambda x: x[0]), sorted(sides[j], key=lambda x: x[0])
            uids, labels = [x[0] for x in first + second], [x[1] for x in first + second]
            made = linked([x[2] for x in first], [x[2] for x in second], percent, labels)
            yield pa.RecordBatch.from_arrays([pa.array([uids[a] for a, _ in made], pa.int64()), pa.array([uids[b] for _, b in made], pa.int64())], names=["u", "v"])

    return run


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (with uid) and label, the smallest uid that edges tie theirs to."""
    return nodes.join(components(edges).select(F.col("node").alias("uid"), F.col("root").alias("label")), "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def tree_links(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) that tie all linked sets together; texts has root, block, uid, blocks, home, d1, d2, text."""
    dealt = texts.repartition("root", "block").sortWithinPartitions("root", "block")
    made = checkpointed(dealt.mapInArrow(within_blocks(width, percent), TREES))
    edges = made.where("u is not null").select("u", "v")
    sets = made.where("own is not null").select("root", "block", "uid", "own")
    signed = made.where("bits is not null").select("root", "block", "low", "high", "hidden", "bits")
    if signed.isEmpty():
        return edges
    members = labelled(sets.select("root", "block", "uid"), edges)
    ranges = members.groupBy("root", "block").agg(F.min("label").alias("first"), F.max("label").alias("last"))
    roots = signed.join(ranges, ["root", "block"])
    others = roots.select("root", F.col("block").alias("j"), *(F.col(c).alias(f"other_{c}") for c in ("low", "high", "hidden", "bits", "first", "last")))
    apart = (F.col("first") != F.col("last")) | (F.col("other_first") != F.col("other_last")) | (F.col("first") != F.col("other_first"))
    pairs = roots.withColumnRenamed("block", "i").join(others, "root").where((F.col("i") < F.col("j")) & apart)
    names = ["root", "i", "j", "low", "high", "hidden", "bits", "other_low", "other_high", "other_hidden", "other_bits"]
    pairs = pairs.select(*names).mapInArrow(overlapping(percent), "root long, i int, j int")
    sides = pairs.select("*", F.explode(F.array("i", "j")).alias("block"))
    whole = sets.join(members.select("uid", "label"), "uid")
    spread = sides.join(whole, ["root", "block"]).select("root", "i", "j", "block", "uid", "label", "own")
    spread = spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return edges.unionByName(spread.mapInArrow(between_blocks(percent), "u long, v long"))


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block_sets: int) -> DataFrame:
    """doc_id, mark, n, component_id, and whether the row's identifier and mark are those of the row that its component keeps."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = 4 * tasks
    # a row is found again by identifier and a hash of its text, so that rows without an identifier don't all meet
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    levels = commonness(source, width)
    found = checkpointed(source.mapInArrow(mapper(width, percent, levels, bins), MAPPED).groupBy("bin").applyInArrow(binned, FOUND))
    members = found.where("v is null").select("doc_id", "mark", F.col("u").alias("uid"), "n", "d1", "d2")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    sets = members.where("n > 0").groupBy("d1", "d2").agg(F.min(row).alias("row"), F.min("uid").alias("uid"), F.min("n").alias("n"))
    sets = sets.select("d1", "d2", "uid", "n", "row")
    equal = members.where("n > 0").select("uid", "d1", "d2").distinct().join(sets.select("d1", "d2", F.col("uid").alias("v")), ["d1", "d2"]).select(F.col("uid").alias("u"), "v")
    candidates = components(found.where("v is not null").select("u", "v").unionByName(equal))

    roots = candidates.select(F.col("root").alias("uid"), "root").distinct()
    grouped = sets.join(candidates.select(F.col("node").alias("uid"), "root").unionByName(roots), "uid")
    order = F.xxhash64("uid")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), *(f("uid", order).alias(a) for f, a in ((F.min_by, "hub"), (F.max_by, "hub_2")))).where("size > 1")
    # by shingles; groups of many sets in so many blocks that their pairs keep all tasks busy
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.least(F.ceil(F.col("size") / block_sets), F.lit(int(np.ceil((2 * tasks) ** 0.5)))))
    grouped = joined_anew(grouped, sizes, "root").withColumn("blocks", blocks.cast("int"))
    grouped = grouped.withColumn("home", F.pmod(F.xxhash64("uid", F.lit("block")), F.col("blocks")).cast("int"))
    everywhere = F.col("uid").isin(F.col("hub"), F.col("hub_2"))
    grouped = grouped.select("root", "uid", "blocks", "home", "d1", "d2", F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark"), everywhere.alias("hub"))
    texts = grouped.join(source, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))).drop("_id", "_mark", "doc_id", "mark")
    texts = texts.withColumn("block", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))))
    links = tree_links(texts.select("root", "block", "uid", "blocks", "home", "d1", "d2", "text"), width, percent)

    whole = labelled(sets, links)
    kept = whole.groupBy("label").agg(F.min("row").alias("kept"))
    named = joined_anew(whole, kept, "label").select("d1", "d2", "kept")
    some = members.where("n > 0").join(named, ["d1", "d2"])
    some = some.select("doc_id", "mark", "n", F.col("kept.doc_id").alias("component_id"), (row == F.col("kept")).alias("stays"))
    return some.unionByName(members.where("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A-Z are lower-cased, words are runs of other than ASCII white space. component_id is the smallest doc_id reachable
    by links, the row's own included; a row without words or text has 0 shingles and links with nothing, so its
    component is its own doc_id. Null ids are never a component's id unless it has no other. Repeated rows are equal
    sets and share a component, as all texts with the same set do (ties). Very long texts are read whole, cut into words a
    megabyte at a time. An empty table gives no rows; other columns are ignored, whatever they are called.
    """
    return _joined(docs, id_col, text_col, width, percent, block_sets).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS) -> DataFrame:
    """docs with one row of each component, in its own columns: the one with the smallest doc_id, null ids last.

    Rows without words all stay. Rows that repeat both identifier and text stay or go together, as exact deduplication is there for
    them; what ngram_components says of other cases holds here too.
    """
    kept = _joined(docs, id_col, text_col, width, percent, block_sets).where("stays").select("doc_id", F.col("mark").alias("kept_mark")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"))
    return whole.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi").select("whole.*")
