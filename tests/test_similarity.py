"""Vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.operators import cache, grading, similarity

WIDTH = 12


def vectors(seed, n, copies=True):
    """Clusters of near vectors, a third of all rows one and the same vector, odd widths, zeros."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, WIDTH))
    out = []
    for i in range(n):
        if copies and i % 3 == 0:
            out.append(centres[0].tolist())
        elif i % 40 == 7:
            out.append([0.0] * WIDTH)
        elif i % 40 == 11:
            out.append(rng.normal(size=5).tolist())
        else:
            out.append((centres[rng.integers(12)] + rng.normal(size=WIDTH) * 0.15).tolist())
    return out


def cos(a, b):
    a, b = np.array(a), np.array(b)
    if len(a) != len(b) or not a.any() or not b.any():
        return 0.0
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def brute(queries, entries, threshold, alive=lambda q, e: True):
    found = {}
    for i, q in enumerate(queries):
        best = min(((-round(cos(q, e), 12), j) for j, e in enumerate(entries) if cos(q, e) >= threshold and alive(i, j)), default=None)
        if best:
            found[i] = best[1]
    return found


def frames(spark, queries, entries):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, embedding array<double>").repartition(3)
    e = spark.createDataFrame(list(enumerate(entries)), "cache_id long, embedding array<double>").repartition(3)
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    q = q.withColumn("asked_at", F.timestamp_micros(F.unix_micros(start) + F.col("query_id") * 97_000_000))
    e = e.withColumn("stored_at", F.timestamp_micros(F.unix_micros(start) + F.col("cache_id") * 61_000_000))
    return q, e


@pytest.mark.parametrize("limit,block", [(20_000, 2048), (0, 2048), (0, 25)])
@pytest.mark.parametrize("threshold", [0.92, 0.6])
def test_best_entry(spark, limit, block, threshold):
    queries, entries = vectors(1, 180), vectors(1, 240)
    q, e = frames(spark, queries, entries)
    found = similarity.similar_entries(q, e, threshold, block_rows=block, max_broadcast_rows=limit)
    assert {r["query_id"]: r["cache_id"] for r in found.collect()} == brute(queries, entries, threshold)


@pytest.mark.parametrize("limit,block", [(20_000, 2048), (0, 20)])
def test_best_living_entry(spark, limit, block):
    queries, entries = vectors(2, 150), vectors(2, 200)
    q, e = frames(spark, queries, entries)
    found = similarity.similar_entries(q, e, 0.9, 600, block_rows=block, max_broadcast_rows=limit)
    expected = brute(queries, entries, 0.9, lambda i, j: j * 61 <= i * 97 < j * 61 + 600)
    assert {r["query_id"]: r["cache_id"] for r in found.collect()} == expected


def test_cells_prune_but_lose_nothing(spark):
    queries, entries = vectors(3, 100, copies=False), vectors(3, 400, copies=False)
    q, e = frames(spark, queries, entries)
    units = similarity._vectors(e)
    pivots = similarity._pivots(units, 20)
    visits = similarity._with_cells(similarity._vectors(q), pivots, float(np.sqrt(2 - 2 * 0.97))).count()
    assert len(pivots) > 10
    assert visits < 0.7 * 100 * len(pivots)
    found = similarity.similar_entries(q, e, 0.97, block_rows=20, max_broadcast_rows=0)
    assert {r["query_id"]: r["cache_id"] for r in found.collect()} == brute(queries, entries, 0.97)


@pytest.mark.parametrize("limit,block", [(20_000, 2048), (0, 30)])
def test_nearest(spark, limit, block):
    queries, entries = vectors(4, 90), [v for v in vectors(5, 140) if len(v) == WIDTH]
    q, _ = frames(spark, queries, entries)
    examples = spark.createDataFrame(
        [(i, ["simple", "medium", "complex"][i % 3], v) for i, v in enumerate(entries)], "exemplar_id long, tier string, embedding array<double>")
    found = similarity.nearest(q, examples, 7, max_broadcast_rows=limit, block_rows=block)
    got = {r["query_id"]: [n["exemplar_id"] for n in r["neighbours"]] for r in found.collect()}
    for i, v in enumerate(queries):
        assert got[i] == [j for _, j in sorted((-round(cos(v, e), 12), j) for j, e in enumerate(entries))[:7]]


@pytest.mark.parametrize("limit", [20_000, 0])
@pytest.mark.parametrize("ttl", [None, 600])
def test_repeated_ids_keep_their_own_matches(spark, limit, ttl):
    queries, entries = vectors(8, 90), vectors(8, 120)
    q, e = frames(spark, queries, entries)
    alive = (lambda i, j: j * 61 <= i * 97 < j * 61 + ttl) if ttl else (lambda i, j: True)
    expected = brute(queries, entries, 0.9, alive)
    q = q.withColumn("n", F.col("query_id")).withColumn("query_id", F.when(F.col("n") % 4 > 0, F.col("n") % 4))
    e = e.withColumn("response", F.col("cache_id").cast("string"))
    rows = cache.lookup(q, e, 0.9, ttl, 25, limit).collect()
    assert len(rows) == len(queries)
    assert {r["n"]: r["cache_id"] for r in rows if r["hit"]} == expected
    assert all(r["response"] == str(r["cache_id"]) for r in rows if r["hit"])
    found = similarity.similar_entries(q, e, 0.9, ttl, 25, limit).collect()
    ids = {i: i % 4 or None for i in expected}
    assert sorted(map(str, ((r["query_id"], r["cache_id"]) for r in found))) == sorted(str((ids[i], j)) for i, j in expected.items())


@pytest.mark.parametrize("limit", [20_000, 0])
def test_entries_of_one_id_serve_their_own_answer(spark, limit):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    entries = spark.createDataFrame([(7, [1.0, 0.0], "a"), (7, [0.0, 1.0], "b")], "cache_id long, embedding array<double>, response string")
    rows = cache.lookup(queries, entries, max_broadcast_rows=limit).collect()
    assert sorted((r["query_id"], r["response"]) for r in rows) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_nearest_with_repeated_ids(spark, limit):
    queries, entries = vectors(4, 60), [v for v in vectors(5, 80) if len(v) == WIDTH]
    q, _ = frames(spark, queries, entries)
    q = q.withColumn("n", F.col("query_id")).withColumn("query_id", F.col("n") % 3)
    examples = spark.createDataFrame([(i, "simple", v) for i, v in enumerate(entries)], "exemplar_id long, tier string, embedding array<double>")
    rows = similarity.nearest(q, examples, 5, max_broadcast_rows=limit, block_rows=30).collect()
    assert len(rows) == len(queries)
    for row in rows:
        expected = sorted((-round(cos(queries[row["n"]], e), 12), j) for j, e in enumerate(entries))[:5]
        assert [n["exemplar_id"] for n in row["neighbours"]] == [j for _, j in expected]


@pytest.mark.parametrize("limit,block", [(20_000, 2048), (0, 2048), (0, 20)])
def test_nearest_with_two_widths(spark, limit, block):
    rng = np.random.default_rng(9)
    entries = [rng.normal(size=8 if i % 3 else 16).tolist() for i in range(60)]  # flattened, a multiple of both widths
    queries = [rng.normal(size=(8, 16, 5)[i % 3]).tolist() for i in range(30)]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, embedding array<double>")
    examples = spark.createDataFrame([(i, "simple", v) for i, v in enumerate(entries)], "exemplar_id long, tier string, embedding array<double>")
    for row in similarity.nearest(q, examples, 5, max_broadcast_rows=limit, block_rows=block).collect():
        expected = sorted((-round(cos(queries[row["query_id"]], e), 12), j) for j, e in enumerate(entries))[:5]
        assert [n["exemplar_id"] for n in row["neighbours"]] == [j for _, j in expected]


def test_long_answers_are_measured_before_they_are_fetched(spark):
    entries = spark.range(100).select(F.col("id").alias("cache_id"), F.array(F.lit(1.0)).alias("embedding"), F.repeat(F.lit("x"), 2_000_000).alias("response"))
    assert similarity._small(entries, 20_000) is None
    assert similarity._small(entries.drop("response"), 99) is None
    assert similarity._small(entries.drop("response"), 100).num_rows == 100
    assert similarity._small(entries.limit(0), 100).num_rows == 0


def test_answerless_entries_hide_nothing(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0], ""), (2, [1.0, 0.1], "yes"), (3, [1.0, 0.0], None)], "cache_id long, embedding array<double>, response string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    got = {r["query_id"]: (r["hit"], r["response"]) for r in cache.lookup(queries, entries).collect()}
    assert got == {1: (True, "yes"), 2: (False, None), 3: (False, None)}


def test_no_vector_is_graded_by_default(spark):
    queries = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "query_id long, embedding array<double>")
    examples = spark.createDataFrame([(1, "complex", [1.0, 0.0])], "exemplar_id long, tier string, embedding array<double>")
    got = {r["query_id"]: (r["predicted"], r["confidence"]) for r in grading.grade(queries, examples).collect()}
    assert got == {1: ("medium", 0.85), 2: ("medium", 0.85), 3: ("complex", 0.2)}


# ---- replay ------------------------------------------------------------------------------

def sequential(rows, ttl):
    stored, out = [], {}
    for rid, t, v, answered in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = any(cos(v, w) >= 0.92 for s, w in stored if s <= t < s + ttl)
        out[rid] = (hit, answered and not hit)
        if answered and not hit:
            stored.append((t, v))
    return out


def traffic(seed, n, span):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(span)), v, bool(rng.random() > 0.1)) for i, v in enumerate(vectors(seed, n))]


def as_requests(spark, rows):
    frame = spark.createDataFrame(rows, "request_id long, s long, embedding array<double>, answered boolean").repartition(3)
    start = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return frame.withColumn("asked_at", F.timestamp_micros(start + F.col("s") * 1_000_000)).drop("s")


@pytest.mark.parametrize("limit,block,slab", [(20_000, 2048, 86_400), (0, 40, 86_400), (20_000, 2048, 1500)])
def test_replay(spark, limit, block, slab):
    rows = traffic(6, 150, 4000)
    got = cache.replay(as_requests(spark, rows), 900, slab_seconds=slab, block_rows=block, max_broadcast_rows=limit)
    assert {r["request_id"]: (r["hit"], r["stored"]) for r in got.collect()} == sequential(rows, 900)


def test_replay_ties_and_nothing(spark):
    rows = [(i, 5, [1.0, 0.0], i > 1) for i in range(6)]
    got = cache.replay(as_requests(spark, rows), 900)
    assert {r["request_id"]: (r["hit"], r["stored"]) for r in got.collect()} == sequential(rows, 900)
    assert cache.replay(as_requests(spark, rows).limit(0), 900).count() == 0


def jobs_of(spark, name, make):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = make()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_replay_jobs_do_not_grow_with_days(spark):
    """The same morning on three and on thirty days: spans are worked on together, and nothing written stays but the result."""
    import os

    from costlens.session import shared_dir

    day = [(t, v, a) for _, t, v, a in traffic(9, 12, 2000)]
    counts = []
    for days in (3, 30):
        rows = [(d * 1000 + i, d * 86_400 + t, v, a) for d in range(days) for i, (t, v, a) in enumerate(day)]
        got, jobs = jobs_of(spark, f"replay-{days}", lambda rows=rows: cache.replay(as_requests(spark, rows), 900).collect())
        assert {r["request_id"]: (r["hit"], r["stored"]) for r in got} == sequential(rows, 900)
        counts.append(jobs)
    assert counts[1] <= counts[0] + 2
    left = os.path.join(shared_dir(spark), "costlens")
    assert not [name for name in os.listdir(left) if name.startswith("replay-")]


def test_replay_chain_over_spans(spark):
    """One question asked all the time, two alike ones in turns, zero vectors, no vectors, no times."""
    rows = [(i, 100 * i, [1.0, 0.0], True) for i in range(60)]
    rows += [(100 + i, 130 * i, [0.0, 1.0] if i % 2 else [0.1, 1.0], i % 5 > 0) for i in range(40)]
    rows += [(200 + i, 10 * i, [0.0, 0.0], True) for i in range(3)]
    got = cache.replay(as_requests(spark, rows), 900)
    assert {r["request_id"]: (r["hit"], r["stored"]) for r in got.collect()} == sequential(rows, 900)
    plain = spark.createDataFrame([(1, None, True), (2, [], True), (3, [1.0], None)], "request_id long, embedding array<double>, answered boolean")
    untimed = plain.withColumn("asked_at", F.when(F.col("request_id") < 3, F.to_timestamp(F.lit("2024-01-01"))))
    assert {r["request_id"]: (r["hit"], r["stored"]) for r in cache.replay(untimed).collect()} == {1: (False, True), 2: (False, True), 3: (False, False)}


def test_running_bound_skips_far_chunks():
    """Examples in tight clusters: chunks that can't reach a query's kth example are not scored, and the result is that of scoring all."""
    import pyarrow as pa

    from costlens.operators import similarity as S

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16))
    vectors = np.repeat(middle, 1024, axis=0) + 0.05 * rng.normal(size=(20 * 1024, 16))
    asked = np.repeat(middle, 10, axis=0) + 0.05 * rng.normal(size=(200, 16))
    lists = lambda rows: pa.array(rows.tolist(), pa.list_(pa.float64()))
    running = S._Running(np.arange(200), lists(asked), 5)
    table = pa.table({"_number": np.arange(len(vectors)), "embedding": lists(vectors), "exemplar_id": np.arange(len(vectors)) + 7, "tier": ["x"] * len(vectors)})
    for start in range(0, len(vectors), 1024):
        running.add(table.slice(start, 1024))
    unit = lambda rows: rows / np.linalg.norm(rows, axis=1, keepdims=True)
    score = np.round(unit(asked) @ unit(vectors).T, 12)
    assert (running.number == np.argsort(-score, axis=1, kind="stable")[:, :5]).all()
    assert running.scored < 0.5 * score.size
    out = running.result(pa.int64()).to_pydict()
    assert out["exemplar_id"][3] == [n + 7 for n in out["number"][3]]


def test_nearest_beyond_the_limit_has_no_window(spark):
    """No window over candidates and no single key: each query brings home k rows a lane."""
    queries = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)], "query_id long, embedding array<double>")
    examples = spark.createDataFrame([(i, "medium", [float(i % 11), 1.0, float(i % 5)]) for i in range(600)], "exemplar_id long, tier string, embedding array<double>")
    from costlens.operators.similarity import LANE_BLOCKS, nearest

    wide = nearest(queries, examples, 3, max_broadcast_rows=0, block_rows=4)  # several parts and lanes
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_all" not in plan and 600 > 4 * LANE_BLOCKS
    same = nearest(queries, examples, 3)
    rows = lambda frame: sorted((r["query_id"], [(n["exemplar_id"], round(n["similarity"], 9)) for n in r["neighbours"]]) for r in frame.collect())
    assert rows(wide) == rows(same)


def test_quiet_spans_are_not_copied_to_cells(spark):
    """Only a span with more entries than a block is cut into cells; questions of other spans visit one, however many entries there are."""
    centres = np.random.default_rng(5).normal(size=(300, WIDTH))
    rows = [(i, i // 10 if i < 200 else 99, WIDTH, v.tolist()) for i, v in enumerate(centres)]
    known = spark.createDataFrame(rows, "query_id long, _bucket long, _dim int, embedding array<double>")
    asked, homes = similarity._in_spans(known.toDF(*known.columns), known, 0.5, 25)
    visits = {r["_bucket"]: r["n"] for r in asked.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    assert all(visits[bucket] == 10 for bucket in range(20)) and visits[99] > 100
    assert homes.count() == 300 and homes.where("_bucket = 99").select("_cell").distinct().count() > 1
    quiet = similarity._in_spans(known.toDF(*known.columns), known, 0.5, 100)
    assert [side.where("_cell = 0").count() for side in quiet] == [300, 300]


def test_many_examples_are_cut_both_ways(spark):
    """What is copied grows with the root of the pairs of blocks while parts are within their bound, and one part never takes a machine's cores alone."""
    for rows in (100_000, 600_000):
        parts, lanes = similarity._parts_and_lanes(rows, rows, similarity.BLOCK_ROWS)
        assert parts * lanes >= 64 and parts + lanes <= 26
        assert rows / parts <= similarity.BLOCK_ROWS * similarity.PART_BLOCKS and rows / lanes <= similarity.BLOCK_ROWS * similarity.LANE_BLOCKS
    assert similarity._parts_and_lanes(0, 0, 25) == (1, 1)


@pytest.mark.parametrize("k", [1, 6, 400])
def test_single_precision_only_chooses_pairs(spark, k):
    """Scores closer together than single precision tells apart are ranked as in double precision."""
    import pyarrow as pa
    rng = np.random.default_rng(9)
    middle = rng.normal(size=WIDTH)
    known = middle + rng.normal(size=(300, WIDTH)) * 1e-5
    known[::50] = known[3]
    known[17] = 0
    asked = np.vstack([middle + rng.normal(size=(40, WIDTH)) * 1e-5, np.zeros((1, WIDTH))])
    lists = lambda rows: pa.array(rows.tolist(), pa.list_(pa.float64()))
    running = similarity._Running(np.arange(len(asked)), lists(asked), k)
    order = rng.permutation(len(known))
    for first in range(0, len(known), 70):
        some = order[first:first + 70]
        running.add(pa.table({"_number": some, "embedding": lists(known[some]), "exemplar_id": some * 2, "tier": [str(i) for i in some]}))
    result = running.result(pa.int64())
    for i, (numbers, ids, tiers) in enumerate(zip(*(result.column(name).to_pylist() for name in ("number", "exemplar_id", "tier")))):
        best = sorted(range(len(known)), key=lambda j: (-round(cos(asked[i], known[j]), 12), j))[:k]
        assert [round(cos(asked[i], known[j]), 11) for j in numbers] == [round(cos(asked[i], known[j]), 11) for j in best]
        assert len(set(numbers)) == len(best) and ids == [2 * j for j in numbers] and tiers == [str(j) for j in numbers]


def test_untimed_questions_are_not_copied_to_cells(spark, monkeypatch):
    """Where vectors have no clusters a question would visit nearly all cells, whose number grows with the entries."""
    reaches, with_cells = [], similarity._with_cells
    monkeypatch.setattr(similarity, "_with_cells", lambda df, pivots, reach, *more: reaches.append(reach) or with_cells(df, pivots, reach, *more))
    queries, entries = vectors(6, 120), vectors(6, 200)
    q, e = frames(spark, queries, entries)
    found = similarity.similar_entries(q, e, 0.85, block_rows=25, max_broadcast_rows=0)
    assert {r["query_id"]: r["cache_id"] for r in found.collect()} == brute(queries, entries, 0.85)
    assert reaches and all(reach is None for reach in reaches)
