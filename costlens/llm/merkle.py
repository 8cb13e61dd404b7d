"""A Merkle manifest of documents: a leaf for each row, a subroot for each source, one root, a proof for each leaf.

Leaves of a source stand in the order of doc_id (null first, then by leaf). Every sixteen consecutive nodes
become one, until one is left; the subroots, in the order of source (null first), give the root in the same way.

A rank is written in digits of base sixteen. Blocks of three digits (4,096 consecutive nodes) are rolled up by
grouping the lowest digit away, then the next: each step hashes the children of a node and nests them in it as an
array of structs, so a block ends as one row that holds its whole tree. All three groupings use the one partitioning
by block, and no block grows with its source. The tops of the blocks are the nodes of the next tier. Proofs are
then emitted from the top tier down: a row's nested arrays are exploded, the concatenated digests of a run give the
siblings at each place, and what a block inherits from above reaches it by one more grouping of a row for
each block; nothing is joined to leaves.

Null columns are hashed as ``-``; null and empty texts differ. Repeated rows are leaves of their own. A table
without rows has no manifest rows. Columns that are not hashed are ignored, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from costlens.session import materialise

FAN_BITS = 4
DIGITS = 3
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its value, or ``-`` if null."""
    texts = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``count`` of their ``group``, without a task for a whole group."""
    keys = [F.col("group").asc_nulls_first(), *order]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("id", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("id", 33))
    along = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("group", "part").agg(F.count("*").alias("own"), F.min("id").alias("first"))  # a row for each task and group
    parts = parts.select(
        F.col("group").alias("of"), F.col("part").alias("in"), (F.col("first") - F.coalesce(F.sum("own").over(along), F.lit(0))).alias("base"),
        F.sum("own").over(Window.partitionBy("group")).alias("count"))
    joined = placed.join(parts, (F.col("part") == F.col("in")) & F.col("group").eqNullSafe(F.col("of")))
    return joined.withColumn("rank", F.col("id") - F.col("base")).drop("id", "part", "of", "in", "base")


def _nodes_at(level: int) -> Column:
    """How many nodes a group of ``count`` has after ``level`` roll-ups."""
    return F.shiftright(F.col("count") + ((1 << FAN_BITS * level) - 1), FAN_BITS * level)


def _run(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda kid: kid["digest"]), "")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """group, count, block, tree: one row for each block of consecutive nodes (group, count, rank, digest, payload)."""
    digits = {k: F.shiftright("rank", FAN_BITS * (k - 1)).bitwiseAND(F.lit((1 << FAN_BITS) - 1)).cast("int") for k in range(1, DIGITS + 1)}
    rows = nodes.select(
        "group", "count", F.shiftright("rank", FAN_BITS * DIGITS).alias("block"), *[digits[k].alias(f"digit{k}") for k in range(2, DIGITS + 1)],
        F.struct(digits[1].alias("place"), "digest", "payload").alias("node")).repartition("group", "block")
    for level in range(1, DIGITS + 1):
        keys = ["group", "count", "block", *[f"digit{k}" for k in range(level + 1, DIGITS + 1)]]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("node")).alias("kids"))
        digest = F.when(_nodes_at(level - 1) > 1, F.sha2(_run(F.col("kids")), 256)).otherwise(F.col("kids")[0]["digest"])
        place = F.col(f"digit{level + 1}") if level < DIGITS else F.lit(0)
        rows = rows.select(*keys, F.struct(place.alias("place"), digest.alias("digest"), "kids").alias("node"))
    return rows.withColumnRenamed("node", "tree")


def unrolled(blocks: DataFrame) -> DataFrame:
    """group, payload, above: each node of the blocks, ``above`` with the path from the node on, nearest siblings first."""
    rows = blocks.select("group", "count", "above", F.col("tree.kids").alias("kids"))
    sides = []
    for level in range(DIGITS, 0, -1):
        rows = rows.withColumn("run", _run(F.col("kids")))
        rows = rows.select("group", "count", "above", *sides, "run", F.posexplode("kids").alias("place", "node"))
        run, place = F.col("run"), F.col("place")
        side = F.struct(run.substr(F.lit(1), place * HEX).alias("left"), run.substr((place + 1) * HEX + 1, F.length(run)).alias("right"))
        below = F.col("node.kids").alias("kids") if level > 1 else F.col("node.payload").alias("payload")
        rows = rows.select("group", "count", "above", *sides, F.when(_nodes_at(level - 1) > 1, side).alias(f"side{level}"), below)
        sides.append(f"side{level}")
    own = F.filter(F.array(*reversed(sides)), lambda side: side.isNotNull())
    return rows.select("group", "payload", F.col("above").withField("path", F.concat(own, F.col("above.path"))).alias("above"))


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every tier, written; in the last one each group has one block."""
    found = []
    while True:
        found.append(materialise(rolled_up(nodes)))
        if found[-1].where(_nodes_at(DIGITS) > 1).isEmpty():
            return found
        nodes = found[-1].select(
            "group", _nodes_at(DIGITS).alias("count"), F.col("block").alias("rank"), F.col("tree.digest").alias("digest"), F.struct("block").alias("payload"))


def _inherited(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``blocks`` with the ``above`` of (group, block, above): a grouping of two rows for each block."""
    both = blocks.unionByName(above, allowMissingColumns=True)
    return both.groupBy("group", "block").agg(*[F.first(name, True).alias(name) for name in ("count", "tree", "above")])


def paths(trees: list[DataFrame], above: DataFrame) -> DataFrame:
    """group, payload, above of every leaf of ``trees``, given (group, above) of every group."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(trees[1:]):
        above = unrolled(_inherited(blocks, above)).select("group", F.col("payload.block").alias("block"), "above")
    return unrolled(_inherited(trees[0], above))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (array of left, right: digests of the siblings on both sides), and the ``carried``."""
    carried = carried or {}
    leaves = materialise(docs.select(
        F.col("source").alias("group"), leaf_digest([F.col(name) for name in FIELDS]).alias("digest"),
        F.struct(F.col("doc_id").alias("doc_id"), *[column.alias(name) for name, column in carried.items()]).alias("payload")))  # the cut points of the ranges are sampled from the digests, not from the texts
    trees = tiers(ranked(leaves, [F.col("payload.doc_id").asc_nulls_first(), F.col("digest")]).withColumn(
        "payload", F.col("payload").withField("digest", F.col("digest"))))
    subroots = trees[-1].select(
        F.lit(0).alias("group"), F.col("group").alias("source"), F.col("tree.digest").alias("digest"))
    sources = tiers(ranked(subroots, [F.col("source").asc_nulls_first()]).select(
        "group", "count", "rank", "digest", F.struct("source", F.col("digest").alias("subroot")).alias("payload")))
    none = F.expr("CAST(array() AS array<struct<left:string,right:string>>)")
    top = sources[-1].select("group", F.struct(F.col("tree.digest").alias("root"), none.alias("path")).alias("above"))
    of_sources = paths(sources, top).select(
        F.col("payload.source").alias("group"),
        F.struct(F.col("above.root").alias("root"), F.col("payload.subroot").alias("subroot"), F.col("above.path").alias("path")).alias("above"))
    found = paths(trees, of_sources)
    return found.select(
        "payload.doc_id", F.col("payload.digest").alias("leaf"), "above.subroot", "above.root", "above.path", *[F.col(f"payload.{name}") for name in carried])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, side: F.sha2(F.concat(side["left"], digest, side["right"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""), 256)
