"""Mixing sources to target weights by entropy balancing, in DataFrame operations.

Every source has a target of words. Among all ways to repeat or thin its documents so that the words meet
the target, entropy balancing takes the one closest to taking each document once: document d of n words
has rate min(most, exp(lambda * n / mean)). Lambda solves the convex dual of the source's word constraint: two
passes evaluate the dual's slope at GRID values of lambda each, which bracket the root whatever its size, and
Newton steps inside the bracket end it. Each pass is one aggregation over counts of (source, size), for all sources together.

Rates become whole copies by a hash of the document: the whole part, and one more for the first documents in a
pseudo-random order that favours large remainders. Documents are taken in classes of size (by powers of two), large
ones first; a class is cut where its extra copies pass the words it should add, on the side that smaller documents can
mend, and what is missing or too much goes on to the next smaller class. Cuts are found on sums over BINS bins of the order in each class, at most 64 times
BINS numbers for each source.

Sources are in code point order, null last. Null texts have size 0 and are taken with no words. Without
any words all targets are 0. The order of a document follows from doc_id, source and text: equal rows, and rows without
doc_id that are otherwise equal, get the same number of copies. Other columns are returned by ``copies``, whatever their names, and
ignored by ``mix``.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from costlens.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BINS = 4096
GRID = 48
FAR = 2.0**30  # no lambda lies beyond
NEWTON = 4
FEW_SOURCES = 10_000  # rows of at most 64 cuts each that may be broadcast; more are joined by shuffle
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(frame: DataFrame, order: Column) -> DataFrame:
    """``frame`` with ``number``, from 0 in the given order, without one task for all rows."""
    placed = materialise(frame.repartitionByRange(order).sortWithinPartitions(order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = placed.groupBy(part.alias("_part")).count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return placed.withColumn("_part", part).join(bases, "_part").withColumn(
        "number", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_base")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, docs, target: shares by weight, at most ``most`` times a source, the excess shared anew.

    With sources in the order of cap / weight, the first ones are capped: the level of the others, words left over
    weight left, must reach the ratio of the last capped one. Sources are few beside documents, one row each.
    """
    sums = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = numbered(sums, F.col("source").asc_nulls_last()).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("number")
    by_ratio = sources.groupBy((F.col("cap") / F.col("weight")).alias("ratio")).agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    whole = by_ratio.agg(F.sum("caps") / most * share, F.sum("weights")).first()
    so_far = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct ratio of the sources
    capped = by_ratio.select("ratio", F.sum("caps").over(so_far).alias("caps"), F.sum("weights").over(so_far).alias("weights"))
    # capped up to a ratio: the level of the rest is at least that ratio
    rest = F.lit(whole[1] or 0.0) - F.col("weights")
    valid = capped.where(F.lit(whole[0] or 0.0) - F.col("caps") >= F.col("ratio") * rest)
    last = valid.orderBy(F.desc("ratio")).first()
    words, left, below = (whole[0] or 0.0, whole[1] or 0.0, -1.0) if last is None else (whole[0] - last.caps, whole[1] - last.weights, last.ratio)
    level = words / left if left > 1e-9 else 0.0
    is_capped = F.col("cap") / F.col("weight") <= F.lit(below)
    return sources.select("source", "source_size", "docs", F.when(is_capped, F.col("cap")).otherwise(F.least("cap", F.lit(level) * F.col("weight"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tilts(rows: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` with mean and lambda, and ``full`` or ``none`` where all documents or none have their fill."""
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    counts = materialise(rows.where("size > 0").groupBy("source", "size").count())
    few = sources.count() <= FEW_SOURCES
    kept = ["mean", "target", "low", "high"]

    def sums(state: DataFrame, points: Column) -> DataFrame:
        """state's rows with ``at``: lambda, what the words miss there, and the slope, for every point."""
        asked = state.select(F.col("source").alias("_source"), *kept, points.alias("points"))
        joined = counts.join(F.broadcast(asked) if few else asked, _same("source", "_source")).drop("_source")
        joined = joined.withColumn("lambda", F.explode("points")).drop("points")
        z, words = F.col("size") / F.col("mean"), F.col("count") * F.col("size")
        rate = F.exp(F.least(F.col("lambda") * z, F.lit(50.0)))
        found = joined.groupBy("source", "lambda").agg(
            *[F.first(name).alias(name) for name in kept], (F.sum(words * F.least(F.lit(most), rate)) - F.first("target")).alias("miss"),
            F.sum(F.when(rate < most, words * z * rate).otherwise(0.0)).alias("slope"))
        return found.groupBy("source").agg(
            *[F.first(name).alias(name) for name in kept], F.array_sort(F.collect_list(F.struct("lambda", "miss", "slope"))).alias("at"))  # at most GRID

    def bracketed(state: DataFrame) -> DataFrame:
        below, above = F.filter("at", lambda p: p["miss"] <= 0), F.filter("at", lambda p: p["miss"] > 0)
        inside = state.withColumn("low", F.coalesce(F.get(below, F.size(below) - 1)["lambda"], F.col("low")))
        inside = inside.withColumn("high", F.coalesce(F.get(above, F.lit(0))["lambda"], F.col("high")))
        nearest = F.transform("at", lambda p: F.struct(F.abs(p["miss"]).alias("by"), p["lambda"].alias("lambda"), p["miss"].alias("miss"), p["slope"].alias("slope")))
        nearest = F.get(F.array_sort(nearest), F.lit(0))
        newton = nearest["lambda"] - nearest["miss"] / F.when(nearest["slope"] > 0, nearest["slope"])
        middle = F.when(nearest["miss"] == 0, nearest["lambda"]).otherwise((F.col("low") + F.col("high")) / 2)
        return inside.withColumn("lambda", F.when(newton.between(F.col("low"), F.col("high")), newton).otherwise(middle)).drop("at")

    more = F.col("target") >= F.col("source_size")
    state = sources.where(~full & (F.col("source_size") > 0) & (F.col("target") > 0)).select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.when(more, 0.0).otherwise(-FAR).alias("low"), F.when(more, FAR).otherwise(0.0).alias("high"))
    powers = F.array(F.lit(0.0), *[F.lit(FAR * 2.0**-i) for i in range(GRID - 1)])
    state = bracketed(sums(state, F.transform(powers, lambda p: F.when(F.col("high") > 0, p).otherwise(-p))))
    even = F.array(*[F.lit(i / (GRID - 1)) for i in range(GRID)])
    state = bracketed(sums(state, F.transform(even, lambda p: F.col("low") + p * (F.col("high") - F.col("low")))))
    for _ in range(NEWTON):
        state = bracketed(sums(state, F.array("lambda")))
    tilt = state.select(F.col("source").alias("_source"), "mean", "lambda")
    return sources.join(tilt, _same("source", "_source"), "left").drop("_source").withColumn("full", full).withColumn("none", F.col("target") <= 0)


def sized(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, source, size, chance: what the mix needs of a document; chance is a hash in (0, 1)."""
    key = F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), "source", "text")
    chance = (F.shiftrightunsigned(key, 11) + 0.5) / 2.0**53
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), chance.alias("chance"), *others)


def _rates(rows: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``rows`` with the columns of their source, rate, whole copies, the class of size and the bin of the order."""
    tilt = F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), most).when(F.col("none"), 0.0).otherwise(F.least(F.lit(most), tilt))
    own = sources.withColumnRenamed("source", "_source")
    own = F.broadcast(own) if sources.count() <= FEW_SOURCES else own
    joined = rows.join(own, _same("source", "_source")).drop("_source").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    part = F.col("rate") - F.col("whole")
    order = F.col("chance") / part
    can = (part > 0) & (F.col("size") > 0) & (F.col("whole") + 1 <= most)
    return joined.withColumn("class", F.when(can, F.floor(F.log2("size")).cast("int"))).withColumn("bin", F.when(can, F.floor(order / (1 + order) * BINS).cast("int")))


def _cuts(rows: DataFrame) -> DataFrame:
    """source, cuts: for every class of size the bins below which documents get one more copy."""
    bins = rows.groupBy("source", "class", "bin").agg(
        F.first("target").alias("target"), F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("base"),
        F.sum(F.when(F.col("bin").isNotNull(), (F.col("rate") - F.col("whole")) * F.col("size")).otherwise(0.0)).alias("wanted"))
    classes = bins.groupBy("source", "class").agg(
        F.first("target").alias("target"), F.sum("base").alias("base"), F.sum("wanted").alias("wanted"), F.sum("words").alias("words"),
        F.array_sort(F.collect_list(F.struct("bin", F.col("words")))).alias("bins"))  # at most BINS
    by_class = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "wanted", "words", "bins")))  # at most 64
    ordered = classes.groupBy("source").agg(
        F.reverse(F.array_sort(by_class)).alias("classes"), (F.first("target") - F.sum("base") - F.sum("wanted")).alias("over"))

    def cut_class(state, c):
        wanted = c["wanted"] + state["carried"]
        smaller = F.filter("classes", lambda k: k["class"] < c["class"])
        less = F.aggregate(smaller, F.lit(0.0), lambda total, k: total + k["wanted"])  # words that smaller classes can leave out
        more = F.aggregate(smaller, F.lit(0.0), lambda total, k: total + k["words"]) - less

        def take(s, b):
            short, over = wanted - s["words"], s["words"] + b["words"] - wanted
            left, right = F.greatest(short - more, F.lit(0.0)), F.greatest(over - less, F.lit(0.0))  # what smaller classes can't mend
            fits = s["open"] & ((over <= 0) | (right < left) | ((right == left) & (over <= short)))
            return F.struct(
                F.when(fits, s["words"] + b["words"]).otherwise(s["words"]).alias("words"), F.when(fits, b["bin"] + 1).otherwise(s["cut"]).alias("cut"),
                (fits & (over < 0)).alias("open"))

        start = F.struct(F.lit(0.0).alias("words"), F.lit(0).alias("cut"), F.lit(True).alias("open"))
        found = F.aggregate(c["bins"], start, take)
        return F.struct((wanted - found["words"]).alias("carried"), F.concat(state["cuts"], F.array(F.struct(c["class"].alias("class"), found["cut"].alias("cut")))).alias("cuts"))

    start = F.struct(F.col("over").alias("carried"), F.expr("CAST(array() AS array<struct<class:int,cut:int>>)").alias("cuts"))
    return ordered.select("source", F.map_from_entries(F.aggregate("classes", start, cut_class, lambda s: s["cuts"])).alias("cuts"))


def decided(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """What every source needs to turn its documents into copies, a row for each: target, tilt, cuts."""
    sources = materialise(tilts(rows, targets(rows, weights, share, most), most))
    cuts = _cuts(_rates(rows, sources, most)).withColumnRenamed("source", "_source")
    return materialise(sources.join(cuts, _same("source", "_source"), "left").drop("_source"))


def _copied(rows: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    more = F.coalesce(F.col("bin") < F.element_at("cuts", F.col("class")), F.lit(False)).cast("long")
    return _rates(rows, sources, most).withColumn("copies", F.col("whole") + more)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every document."""
    rows = materialise(sized(docs))
    found = _copied(rows, decided(rows, weights, share, most), most)
    return found.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each document as often as the mix takes it. Texts stay where they are; only sizes are aggregated."""
    sources = decided(materialise(sized(docs)), weights, share, most)
    rows = _copied(sized(docs, F.struct("*").alias("row")), sources, most)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
