"""The manifest against a brute-force tree, with blocks of one, two and three digits."""

import hashlib
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from costlens.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """The top and, for every place, the (left, right) siblings upwards."""
    level, at, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for k, place in enumerate(at):
            run, inside = runs[place // 16], place % 16
            paths[k].append(("".join(run[:inside]), "".join(run[inside + 1:])))
            at[k] = place // 16
        level = [h(*run) for run in runs]
    return level[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of every row of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_of(*row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda leaf: (leaf[0] is not None, leaf[0] or 0, leaf[1]))
    trees = {name: tree([leaf for _, leaf in groups[name]]) for name in names}
    root, above = tree([trees[name][0] for name in names])
    return root, sorted(
        (str(doc), leaf, trees[name][0], root, tuple(trees[name][1][i] + above[k]))
        for k, name in enumerate(names) for i, (doc, leaf) in enumerate(groups[name]))


def rows():
    out = [(None, None, None, None, None), (1, None, "en", 3, "abc"), (1, None, "en", 3, "abc"), (2, "", "de", 0, ""), (3, "lone", None, 2, "ünï \n")]
    out += [(i, "hot", "en", i, f"Text {i} Ü") for i in range(700, 0, -1)]
    out += [(10_000 + i, f"s{i}", "fr", None, "x" * (i * 1000)) for i in range(20)]
    out += [(5, "Zed", "en", 1, "a"), (6, "zed", "en", 1, "a"), (7, "éa", "en", 1, "a")]
    return out


DDL = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_manifest(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    docs = spark.createDataFrame(rows(), DDL).repartition(5)
    for name in ("group", "digest", "rank", "count", "block", "payload", "node", "above", "path", "run", "root", "leaf"):
        docs = docs.withColumn(name, F.lit("x"))
    found = merkle.manifest(docs).collect()
    root, expected = brute(rows())
    plain = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in found)
    assert plain == expected and {r.root for r in found} == {root}


def test_folding(spark):
    docs = spark.createDataFrame(rows(), DDL)
    found = merkle.manifest(docs, {"other": merkle.leaf_digest([F.col(name) for name in merkle.FIELDS[:4]] + [F.lower("text")])})
    found = found.select("doc_id", "root", "leaf", "other", merkle.folded(F.col("leaf"), F.col("path")).alias("own"), merkle.folded(F.col("other"), F.col("path")).alias("changed"))
    for row in found.collect():
        assert row.own == row.root
        assert (row.changed == row.root) == (row.leaf == row.other)


def test_without_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DDL)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", 1, "t")], DDL)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.path == []


def test_query(spark):
    rows = queries.QUERIES["op11_merkle_manifest"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        chosen = zlib.crc32(str(row.doc_id).encode()) % 5 == 0
        upper = any("A" <= c <= "Z" for c in texts[row.doc_id] or "")
        assert row.verified == (row.folded_root == row.root) == (not (chosen and upper))
