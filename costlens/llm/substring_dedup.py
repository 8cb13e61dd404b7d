"""Removal of repeated word windows, prefiltered by a count-min sketch.

Documents lie in ranges of doc_id ("chunks"), so an earlier chunk holds earlier documents. Each chunk sends
its part of a count-min sketch (two rows; only the cells it fills, sorted and differenced) to the shards of
the sketch. A shard merges the parts of all chunks and answers each with one bit for each of its cells:
counted twice or more. A chunk then sends only windows that both rows say are repeated, as 128-bit hashes,
once each, to exact shards, which answer with one bit for each window: an earlier chunk has it. The sketch
can only overestimate, so no repeated window is lost. Shards, not documents, grow in number with the input;
nothing is broadcast, and a window found in every document costs one entry for each chunk.

Null texts have no words. Rows are ordered by doc_id (null first), then by text; a repeated row is a later
document. Other columns are ignored.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costlens.llm.common import byte_values, in_ranges, mixed, window_hashes, word_hashes

CHUNK_BYTES = 8_000_000
SHARD_WINDOWS = 4_000_000
ROWS = 2
_REPLY = "chunk long, kind int, shard long, answer binary"
_ROW_SALT = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


class _Plan:
    """The sizes of the sketch and its shards; the same for all tasks of a run."""

    def __init__(self, total_bytes: int, width: int):
        self.width = width
        windows = max(1, total_bytes // 6)
        self.bits = max(16, int(np.ceil(np.log2(6 * windows))))
        self.shard_bits = max(0, int(np.ceil(np.log2(windows / SHARD_WINDOWS))))

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return mixed(hashes ^ _ROW_SALT[row]) >> np.uint64(64 - self.bits)

    def shards(self, cells: np.ndarray) -> np.ndarray:
        """Where each shard begins among sorted cells."""
        edges = np.arange((1 << self.shard_bits) + 1, dtype=np.uint64) << np.uint64(self.bits - self.shard_bits)
        return np.searchsorted(cells, edges)

    def key_shards(self, keys: np.ndarray) -> np.ndarray:
        if not self.shard_bits:
            return np.array([0, len(keys)])
        edges = np.arange(1, 1 << self.shard_bits, dtype=np.uint64) << np.uint64(64 - self.shard_bits)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _packed(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers as differences of two, three or four bytes each."""
    steps = np.diff(cells, prepend=np.uint64(0)).astype("<u4")
    size = 2 if steps.max() < 1 << 16 else 3 if steps.max() < 1 << 24 else 4
    return bytes([size]) + steps.view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    size = blob[0]
    out = np.zeros(((len(blob) - 1) // size, 4), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, size)
    return np.cumsum(out.view("<u4").ravel(), dtype=np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


class _Chunk:
    """The words and windows of one chunk in document order."""

    def __init__(self, table: pa.Table, width: int):
        ids, texts = table["doc_id"].to_pylist(), byte_values(table["text"])
        rows = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
        self.ids = [ids[i] for i in rows]
        self.texts = [texts[i] or b"" for i in rows]
        one, two, self.counts = [], [], []
        for text in self.texts:
            hashes = word_hashes(text.split())
            one.append(window_hashes(hashes, width))
            two.append(window_hashes(hashes, width, 1))
            self.counts.append(len(one[-1]))
        self.one = np.concatenate(one) if one else np.empty(0, np.uint64)
        self.two = np.concatenate(two) if two else np.empty(0, np.uint64)

    def keys(self, plan: _Plan, replies: pa.Table):
        """Sorted distinct keys of the windows that the sketch says are repeated, the windows, and each window's key."""
        repeated = np.ones(len(self.one), bool)
        kinds, shards, answers = replies["kind"].to_pylist(), replies["shard"].to_pylist(), replies["answer"].to_pylist()
        by = {(kind, shard): answer for kind, shard, answer in zip(kinds, shards, answers)}
        for row in range(ROWS):
            cells, place = np.unique(plan.cells(self.one, row), return_inverse=True)
            bounds, flags = plan.shards(cells), np.zeros(len(cells), bool)
            for shard, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])):
                if end > start:
                    flags[start:end] = np.unpackbits(np.frombuffer(by[row, shard], np.uint8), count=end - start).astype(bool)
            repeated &= flags[place]
        windows = np.flatnonzero(repeated)
        pairs = np.empty(len(windows), [("one", np.uint64), ("two", np.uint64)])
        pairs["one"], pairs["two"] = self.one[windows], self.two[windows]
        order = np.lexsort((windows, pairs["two"], pairs["one"]))
        ordered = pairs[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return ordered[new], windows, place, first, by


def _table(names: list[str], kinds: list, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names)


_REPLY_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def _sketch_parts(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        chunk, own, rows = table["chunk"][0].as_py(), _Chunk(table, plan.width), []
        for row in range(ROWS):
            cells, counts = np.unique(plan.cells(own.one, row), return_counts=True)
            bounds = plan.shards(cells)
            base = np.uint64(plan.bits - plan.shard_bits)
            for shard, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])):
                if end > start:
                    rows.append((chunk, row, shard, _packed(cells[start:end] - (np.uint64(shard) << base)), _bits(counts[start:end] > 1)))
        return _table(["chunk", "kind", "shard", "cells", "twice"], [*_REPLY_KINDS, pa.binary()], rows)

    return run


def _merged(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << (plan.bits - plan.shard_bits), np.uint8)
        chunks, kinds, shards, parts, twice = (table[c].to_pylist() for c in ("chunk", "kind", "shard", "cells", "twice"))
        for part, more in zip(parts, twice):
            cells = _unpacked(part)
            flags = np.unpackbits(np.frombuffer(more, np.uint8), count=len(cells))
            counts[cells] = np.minimum(counts[cells] + 1 + flags, 2)
        rows = [(chunk, kind, shard, _bits(counts[_unpacked(part)] > 1)) for chunk, kind, shard, part in zip(chunks, kinds, shards, parts)]
        return _table(["chunk", "kind", "shard", "answer"], _REPLY_KINDS, rows)

    return run


def _windows_to_group(plan: _Plan):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(["chunk", "shard", "keys"], [pa.int64(), pa.int64(), pa.binary()], [])
        keys = _Chunk(docs, plan.width).keys(plan, replies)[0]
        bounds = plan.key_shards(keys["one"])
        rows = [(docs["chunk"][0].as_py(), shard, keys[start:end].tobytes()) for shard, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])) if end > start]
        return _table(["chunk", "shard", "keys"], [pa.int64(), pa.int64(), pa.binary()], rows)

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """For each key of each chunk: does an earlier chunk have it?"""
    chunks, blobs = table["chunk"].to_numpy(), table["keys"].to_pylist()
    parts = [np.frombuffer(blob, [("one", np.uint64), ("two", np.uint64)]) for blob in blobs]
    keys, sizes = np.concatenate(parts), [len(part) for part in parts]
    order = np.lexsort((np.repeat(chunks, sizes), keys["two"], keys["one"]))
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    ends = np.cumsum(sizes)
    shard = table["shard"][0].as_py()
    rows = [(int(chunk), ROWS, shard, _bits(later[end - size:end])) for chunk, size, end in zip(chunks, sizes, ends)]
    return _table(["chunk", "kind", "shard", "answer"], _REPLY_KINDS, rows)


def _cut(plan: _Plan):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "n_words", "n_removed", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        if not docs.num_rows:
            return _table(names, kinds[:3] + [pa.string()], [])
        own = _Chunk(docs, plan.width)
        keys, windows, place, first, by = own.keys(plan, replies)
        bounds, later = plan.key_shards(keys["one"]), np.zeros(len(keys), bool)
        for shard, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            if end > start:
                later[start:end] = np.unpackbits(np.frombuffer(by[ROWS, shard], np.uint8), count=end - start).astype(bool)
        repeated = np.zeros(len(own.one), bool)
        repeated[windows] = later[place] | ~first
        rows, at = [], 0
        for doc, text, count in zip(own.ids, own.texts, own.counts):
            words = text.split()
            flags, removed = np.flatnonzero(repeated[at:at + count]), 0
            at += count
            if len(flags):
                step = np.zeros(len(words) + 1, np.int32)
                step[flags] += 1
                np.subtract.at(step, flags + plan.width, 1)
                covered = np.cumsum(step[:-1]) > 0
                removed = int(covered.sum())
                total = len(words)
                words = [words[i] for i in np.flatnonzero(~covered)]
            else:
                total = len(words)
            rows.append((doc, total, removed, b" ".join(words)))
        out = _table(names, kinds, rows)
        return out.set_column(3, "kept_text", out["kept_text"].cast(pa.string()))

    return run


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each word covered by a window that starts earlier elsewhere is removed."""
    placed, _, total = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), CHUNK_BYTES)
    plan, chunks = _Plan(total, width), placed.groupBy("chunk")
    parts = chunks.applyInArrow(_sketch_parts(plan), "chunk long, kind int, shard long, cells binary, twice binary")
    sketch = parts.groupBy("kind", "shard").applyInArrow(_merged(plan), _REPLY)
    keys = chunks.cogroup(sketch.groupBy("chunk")).applyInArrow(_windows_to_group(plan), "chunk long, shard long, keys binary")
    exact = keys.groupBy("shard").applyInArrow(_grouped, _REPLY)
    return chunks.cogroup(sketch.unionByName(exact).groupBy("chunk")).applyInArrow(_cut(plan), "doc_id long, n_words long, n_removed long, kept_text string")
