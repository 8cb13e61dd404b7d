"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Documents with equal sets form a class, of which one document goes
on. Each class has a minwise sketch. The join walks trees: a root branch is one sketch position, its
children are the values found there. A node with few members is compared exhaustively; a node with many
members branches again at positions of its own choice, unless its members resemble each other (then
branching cannot part them, and the node is compared in pairs of blocks). The trees repeat independently.
Pairs whose sketches agree often enough join a candidate cluster; inside a cluster, full sets decide.

The number of trees and of positions that must agree follow from the threshold: with positions taken as
independent, a pair at the threshold is lost in all trees, to their last level, with probability of at most
TREE_LOSS, and refused by its sketches with at most GATE_LOSS. At 75 percent these are 16 trees and 70 of 128
positions (96 are expected). A threshold that would need more than MOST_ROOTS trees (below 48 percent) is refused.

Nulls, empty texts and texts without words have an empty set and link with nothing. Rows without doc_id
link with nothing, have a null component and are kept. Repeated rows get the same component. Unlike texts of one
doc_id are classes of their own: each has its own links and component. Other columns, whatever their names,
are ignored by ``near_duplicates`` and returned by ``keep_one``.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from costlens.llm.common import byte_values, components, linked, mixed, released, small_batches, whole_groups, window_hashes, word_hashes
from costlens.session import materialise

POSITIONS = 128
MOST_ROOTS = 80
TREE_LOSS = 5e-8
GATE_LOSS = 2e-7
CHILDREN = 2
LEAF = 4096  # rows compared exhaustively in one task: 1 MB of sketches
LEVELS = 5
DENSE = 0.3
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 1000
_PERMUTE = np.random.default_rng(7).integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def agreeing(percent: int) -> int:
    """How many positions must agree, so that a pair at the threshold is refused with at most GATE_LOSS."""
    p, below = percent / 100, 0.0
    for least in range(POSITIONS + 1):
        below += math.comb(POSITIONS, least) * p**least * (1 - p)**(POSITIONS - least)
        if below > GATE_LOSS:
            return least
    return POSITIONS


def tree_count(percent: int) -> int:
    """How many trees lose a pair at the threshold in all of them with at most TREE_LOSS."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    p, found = percent / 100, 1.0
    for _ in range(LEVELS - 1):
        found = 1 - (1 - p * found) ** CHILDREN
    trees = 1
    while (1 - p * found) ** trees > TREE_LOSS:
        trees += 1
        if trees > MOST_ROOTS:
            raise ValueError(f"{percent} percent is too low: pairs at the threshold would be lost")
    return trees + trees % 2  # even, as the positions left for children must be


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z are lower-cased, words end at ASCII white space."""
    hashes = word_hashes((text or b"").lower().split())
    if len(hashes) and len(hashes) < width:
        return window_hashes(hashes, len(hashes))
    return np.unique(window_hashes(hashes, width))


def minwise(shingles: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start:start + 1024]
        np.minimum(least, (part[None, :] * _PERMUTE[:, None]).min(axis=1), out=least)
    return mixed(least)


def _sketches(width: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, one, two, sketches, roots = [], [], [], [], []
            for text in byte_values(batch["text"]):
                found = shingle_set(text, width)
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                one.append((digest >> 64) - 2**63)
                two.append((digest & (2**64 - 1)) - 2**63)
                values = minwise(found)
                sketches.append((values & np.uint64(0xFFFF)).astype("<u2").tobytes())
                roots.append(mixed(values[:trees] + np.arange(trees, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], batch["text1"], batch["text2"], pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, trees * len(sizes) + 1, trees), pa.int32()), pa.array(np.concatenate(roots) if roots else [], pa.int64())),
            ], ["doc_id", "text1", "text2", "size", "key1", "key2", "sketch", "roots"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingle_set(text, width).tobytes() for text in byte_values(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["cluster"], batch["blocks"], batch["doc"], pa.array(sets, pa.binary())], ["cluster", "blocks", "doc", "shingles"])

    return run


def _edges(docs: np.ndarray, labels: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
    """(a, b): each linked row with the smallest document of its part."""
    out_a, out_b = [], []
    for label, start in zip(labels, starts):
        own = docs[start:start + len(label)]
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, label, own)
        hub = least[label]
        out_a.append(own[own != hub])
        out_b.append(hub[own != hub])
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([join(out_a), join(out_b)], ["a", "b"])


def _similar_sketches(percent: int):
    needed = agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "node"):
            docs, sizes = table["doc"].to_numpy(), table["size"].to_numpy()
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u2").reshape(-1, POSITIONS)
            labels = []
            for start, end in zip(starts[:-1], starts[1:]):
                order = np.argsort(sizes[start:end], kind="stable")
                own, size = sketches[start:end][order], sizes[start:end][order]
                first = np.searchsorted(100 * size, percent * size)  # sizes too far apart for a link are not compared
                after = np.searchsorted(percent * size, 100 * size, side="right")

                def near(row, own=own, first=first, after=after):
                    mark, fits = np.zeros(len(own), bool), slice(first[row], after[row])
                    mark[fits] = np.count_nonzero(own[fits] == own[row], axis=1) >= needed
                    return mark

                label = np.empty(end - start, np.int64)
                label[order] = linked(end - start, near)
                labels.append(label)
            yield _edges(docs, labels, starts)

    return run


def _similar_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "node"):
            docs, blobs = table["doc"].to_numpy(), table["shingles"].to_pylist()
            labels = []
            for start, end in zip(starts[:-1], starts[1:]):
                sets = [np.frombuffer(blob, np.uint64) for blob in blobs[start:end]]
                size = np.array([len(one) for one in sets])
                values, place = np.unique(np.concatenate(sets), return_inverse=True)
                owner, ends = np.repeat(np.arange(len(sets)), size), np.cumsum(size)

                def near(row, sets=sets, size=size, values=values, place=place, owner=owner, ends=ends):
                    mark = np.zeros(len(values), bool)
                    mark[place[ends[row] - size[row]:ends[row]]] = True
                    shared = np.bincount(owner[mark[place]], minlength=len(sets))
                    return 100 * shared >= percent * (size + size[row] - shared)

                labels.append(linked(end - start, near))
            yield _edges(docs, labels, starts)

    return run


def _in_groups(frame: DataFrame, run) -> DataFrame:
    """Edges found by ``run`` in each group ``node``; many groups share a task."""
    return frame.repartition("node").sortWithinPartitions("node").mapInArrow(released(run), "a long, b long")


def _block_pairs(frame: DataFrame, blocks: str) -> DataFrame:
    """Every row once for each block it must meet, under the node of that pair of blocks."""
    own = F.pmod(F.xxhash64("doc", F.lit("block")), F.col(blocks))
    return (
        frame.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
        .withColumn("node", F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")
    )


def candidate_nodes(classes: DataFrame, trees: int) -> DataFrame:
    """(node, doc) of the nodes to be compared exhaustively."""
    level, found = classes.select("doc", F.explode("roots").alias("node")), []
    for depth in range(LEVELS):
        member = F.xxhash64("doc")
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).where("n > 1")
        sizes = materialise(sizes.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", "n"))  # equal nodes once
        level = materialise(level.join(sizes, "node"))
        found.append(level.where(F.col("n") <= LEAF).select("node", "doc"))
        large = level.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        step = 2 * F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1000)) + 1  # odd: the children of a node have different positions
        position = (trees + F.pmod(F.pmod(F.xxhash64("node"), F.lit(POSITIONS - trees)) + step * F.col("_child"), F.lit(POSITIONS - trees))).cast("int")
        value = F.expr("substring(sketch, _position * 2 + 1, 2)")
        children = materialise(
            large.join(classes.select("doc", "sketch"), "doc").withColumn("_child", F.explode(F.sequence(F.lit(1), F.lit(CHILDREN))))
            .withColumn("_position", position).select("doc", "node", "n", F.xxhash64("node", "_position", value).alias("child"))
        )
        density = children.groupBy("node", "n", "child").agg(F.count("*").alias("m")).groupBy("node").agg(
            (F.sum(F.col("m").cast("double") * F.col("m")) / (CHILDREN * F.first("n").cast("double") ** 2)).alias("density"))
        last = F.lit(depth == LEVELS - 1)
        dense = materialise(density.select("node", ((F.col("density") >= DENSE) | last).alias("dense")))
        blocks = F.ceil(F.col("n") / (LEAF // 2))
        found.append(_block_pairs(large.join(dense.where("dense"), "node").withColumn("blocks", blocks), "blocks").select("node", "doc"))
        level = materialise(children.join(dense.where("NOT dense"), "node").select("doc", F.col("child").alias("node")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _text_key(*others) -> list:
    """doc_id and a 128-bit hash of the text: what tells rows apart that are not repeated."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text1"), F.xxhash64(F.lit("text"), "text").alias("text2"), *others]


def labelled(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, text1, text2, size, part (the number of its component, null without a set or any doc_id), component_id of every row."""
    trees = tree_count(percent)
    texts = docs.select(*_text_key(F.col("text")))
    sketched = materialise(texts.mapInArrow(
        released(_sketches(width, trees)), "doc_id long, text1 long, text2 long, size long, key1 long, key2 long, sketch binary, roots array<long>"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text1", "text2"))).alias("first")
    keys = sketched.where("size > 0").groupBy("key1", "key2").agg(first).where("first IS NOT NULL").select("key1", "key2", "first.*")
    keys = materialise(keys.withColumn("doc", F.monotonically_increasing_id()))
    classes = sketched.select("key1", "key2", "doc_id", "text1", "text2", "size", "sketch", "roots").join(
        keys, ["key1", "key2", "doc_id", "text1", "text2"]).dropDuplicates(["doc"])
    classes = materialise(classes.select("doc", "doc_id", "text1", "text2", "size", "sketch", "roots"))

    nodes = candidate_nodes(classes, trees).join(classes.select("doc", "size", "sketch"), "doc")
    clusters = materialise(components(_in_groups(nodes, _similar_sketches(percent))).select(F.col("node").alias("doc"), F.col("component").alias("cluster")))
    members = clusters.join(classes.select("doc", "doc_id", "text1", "text2", "size"), "doc")
    sizes = members.groupBy("cluster").agg(F.sum("size").alias("shingles"), F.count("*").alias("members"))
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("members") / BLOCK_SETS))
    placed = materialise(members.join(sizes.select("cluster", blocks.alias("blocks")), "cluster"))
    sets = texts.join(placed, ["doc_id", "text1", "text2"]).select("cluster", "blocks", "doc", "text").dropDuplicates(["doc"])
    sets = sets.mapInArrow(released(_sets(width)), "cluster long, blocks long, doc long, shingles binary").withColumnRenamed("cluster", "node")
    links = components(_in_groups(_block_pairs(sets, "blocks"), _similar_sets(percent)))

    parts = materialise(keys.join(links.withColumnRenamed("node", "doc"), "doc", "left").select("key1", "key2", "doc_id", F.coalesce("component", "doc").alias("part")))
    least = parts.groupBy("part").agg(F.min("doc_id").alias("least"))
    named = parts.select("key1", "key2", "part").join(least, "part")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return sketched.drop("sketch", "roots").join(named, ["key1", "key2"], "left").select(
        "doc_id", "text1", "text2", "size", F.when(F.col("doc_id").isNotNull(), F.col("part")).alias("part"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; see the module's text."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return labelled(docs, width, percent).select("doc_id", F.col("size").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each group, of those with the smallest doc_id, and one of repeated rows; rows without doc_id stay."""
    rows = labelled(docs, width, percent).where("doc_id IS NOT NULL")
    key = ["doc_id", "text1", "text2"]
    first = rows.where("part IS NOT NULL").groupBy("part").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    kept = first.unionByName(rows.where("part IS NULL").select(*key)).distinct()
    carried = docs.select(*_text_key(F.struct("*").alias("row")))
    named = carried.where("doc_id IS NOT NULL").join(kept, key, "left_semi").dropDuplicates(key)
    return named.unionByName(carried.where("doc_id IS NULL")).select("row.*")
