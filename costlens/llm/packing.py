"""Packing of token sequences by patterns of lengths, fitted to the histogram of lengths by non-negative least squares.

Documents are tokenized, closed with an end id, and cut into pieces only where longer than a sequence.
The histogram of piece lengths has at most ``limit`` bins, whatever the input; everything decided on the
driver depends on it alone. Patterns are the ways to fill a sequence with up to three lengths on a grid.
Their repeat counts are fitted to the histogram, rounded down, and filled with pieces of exact lengths;
what is left, and the space left, is packed by best fit in descending length. The result is a table of
runs: so many pieces of one length, by rank, go to as many consecutive sequences at one offset. Ranks are
counted in hashed groups of each length, so that no length, however frequent, meets in one task.

Null and empty texts have the end id alone. Repeated rows are packed each. Other columns are ignored.
"""

import itertools
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from costlens.llm.common import byte_values, released
from costlens.session import materialise

LIMIT = 2048
END_ID = 0
GRID = 8
RANK_ROWS = 10_000
CACHE_BYTES = 48_000_000
CACHED_WORD = 64  # longer words, in bytes, are not cached
CHUNK_BYTES = 2_000_000
AT_ONCE = 16
_tokenizers: dict[str, tuple] = {}


class WordTokenizer:
    """A tokenizer that drops white space; ids of whole texts are joined from those of words cut at ASCII white space.

    Words are independent: no pre-token holds white space. The distinct words of a chunk of texts are looked up together, by
    128-bit hashes in sorted arrays; new ones are encoded many at a time, parted by a special token. The cache is a
    few flat arrays of CACHE_BYTES at most. When it is full it keeps the words that came again since it was
    last full, unless they take more than half of it; most words of a corpus are seen once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parting, self.parting_id = min((token.content, number) for number, token in self.tokenizer.get_added_tokens_decoder().items())
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 2**16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint64)  # hashes of cached words, ascending by high
        self.start, self.count = np.empty(0, np.uint32), np.empty(0, np.uint16)  # where their ids are in the pool
        self.again = np.empty(0, bool)
        self.pool = np.empty(0, self.kind)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """A few texts at a time: the tokenizer's own results take many times the room of their ids."""
        return [
            np.array(found.ids, self.kind) for first in range(0, len(texts), AT_ONCE)
            for found in self.tokenizer.encode_batch_fast(texts[first:first + AT_ONCE], add_special_tokens=False)]

    def _learned(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)"""
        mark = self.parting.encode()
        alone = np.array([len(word) > CACHED_WORD or b"<|" in word or mark in word for word in words], bool)
        plain, mark = np.flatnonzero(~alone), self.parting
        groups = [mark.join([words[i].decode() for i in plain[first:first + 256]]) for first in range(0, len(plain), 256)]
        parted = np.array([self.parting_id], self.kind)
        flat = np.concatenate([parted[:0], *itertools.chain.from_iterable((row, parted) for row in self._encoded(groups))])  # ids of a word, parting, ...
        cuts = np.flatnonzero(flat == self.parting_id)
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.diff(cuts, prepend=-1) - 1
        flat, others = flat[flat != self.parting_id], np.flatnonzero(alone)
        if len(others):
            found = self._encoded([words[i].decode() for i in others])
            at = np.cumsum(counts)[others]
            counts[others] = [len(row) for row in found]
            flat = np.insert(flat, np.repeat(at, counts[others]), np.concatenate(found))
        return flat, counts

    def _kept(self, keep: np.ndarray) -> None:
        start, count = self.start[keep].astype(np.int64), self.count[keep]
        self.pool = self.pool[spread(start, count)]
        self.high, self.low, self.count, self.again = self.high[keep], self.low[keep], count, np.zeros(len(keep), bool)
        self.start = (np.cumsum(count, dtype=np.int64) - count).astype(np.uint32)

    def _remember(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        start = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, ids])
        joined = [np.concatenate(pair) for pair in (
            (self.high, high), (self.low, low), (self.start, start.astype(np.uint32)), (self.count, count.astype(np.uint16)), (self.again, np.zeros(len(high), bool)))]
        order = np.argsort(joined[0], kind="stable")
        self.high, self.low, self.start, self.count, self.again = (column[order] for column in joined)
        if 23 * len(self.high) + self.pool.nbytes > CACHE_BYTES:
            keep = np.flatnonzero(self.again)
            if 23 * len(keep) + self.pool.itemsize * int(self.count[keep].sum()) <= CACHE_BYTES // 2:
                self._kept(keep)
            else:
                self._clear()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and where the last end)"""
        lists = pc.ascii_split_whitespace(texts)
        encoded = lists.flatten().dictionary_encode()
        words = byte_values(encoded.dictionary)
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.high, hashes[:, 0]), max(len(self.high) - 1, 0))
        known = (self.high[at] == hashes[:, 0]) & (self.low[at] == hashes[:, 1]) if len(self.high) else np.zeros(len(words), bool)
        new = np.flatnonzero(~known)
        self.again[at[known]] = True
        ids, counts = self._learned([words[i] for i in new])
        pool = np.concatenate([self.pool, ids])
        start, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[known], count[known] = self.start[at[known]], self.count[at[known]]
        start[new], count[new] = len(self.pool) + np.cumsum(counts) - counts, counts
        short = np.array([len(words[i]) <= CACHED_WORD for i in new], bool)
        self._remember(hashes[new[short], 0], hashes[new[short], 1], ids[np.repeat(short, counts)], counts[short])
        indices = encoded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(count[indices])])
        return pool[spread(start[indices], count[indices])], ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, ``count`` numbers each, one run after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _word_tokenizer(path: str | None) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _pieces(path: str | None, limit: int, end_id: int, with_ids: bool):
    def run(batches):
        encode = _word_tokenizer(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            texts, docs = pc.fill_null(batch["text"], ""), batch["doc_id"].to_pylist()
            before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
            first = 0
            while first < len(docs):
                last = max(first + 1, int(np.searchsorted(before, before[first] + CHUNK_BYTES, side="right")) - 1)
                ids, ends = encode(texts.slice(first, last - first))
                data = memoryview(np.insert(ids.astype("<u4"), ends[1:], end_id).tobytes())
                rows = []
                for place, (doc, begin, end) in enumerate(zip(docs[first:last], ends[:-1].tolist(), ends[1:].tolist())):
                    begin, end = begin + place, end + place + 1
                    for piece, start in enumerate(range(begin, end, limit)):
                        part = data[4 * start:4 * min(start + limit, end)]
                        rows.append((doc, piece, start - begin, len(part) // 4, zlib.crc32(part), bytes(part) if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(list(zip(*rows))[:len(names)], kinds)], names)
                first = last

    return run


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian 32-bit numbers) of every piece."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(released(_pieces(path, limit, end_id, with_ids)), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def grid_patterns(cells: int) -> np.ndarray:
    """All ways to fill ``cells`` with one, two or three grid lengths, a column of counts each."""
    rows = [(cells,)] + [(a, cells - a) for a in range((cells + 1) // 2, cells)]
    rows += [(a, b, cells - a - b) for a in range(1, cells - 1) for b in range(1, min(a, cells - a - 1) + 1) if cells - a - b <= b]
    out = np.zeros((cells + 1, len(rows)))
    for column, row in enumerate(rows):
        for part in row:
            out[part, column] += 1
    return out[1:]


def non_negative_fit(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 with the least squared difference of matrix @ x and target, by active sets."""
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * matrix.shape[0]):
        slope = matrix.T @ (target - matrix @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            solved = np.linalg.lstsq(matrix[:, chosen], target, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[chosen] = solved
                break
            below = solved <= 0
            step = np.min(x[chosen][below] / np.maximum(x[chosen][below] - solved[below], 1e-300))
            x[chosen] += step * (solved - x[chosen])
            active[chosen[below & (x[chosen] <= tolerance)]] = False
            x[~active] = 0
            if not active.any():
                return x
    return x


def packing_runs(histogram: dict[int, int], limit: int = LIMIT, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): where the pieces of each length go."""
    cells = limit // grid
    left: dict[int, dict[int, int]] = defaultdict(dict)  # by grid cell, longest first: length -> count
    for length in sorted(histogram, reverse=True):
        left[-(-length // grid)][length] = histogram[length]
    patterns = grid_patterns(cells)
    target = np.array([sum(left[cell].values()) for cell in range(1, cells + 1)], float)
    repeats = np.floor(non_negative_fit(patterns, target) + 1e-6).astype(np.int64)
    runs, ranks, space, sequences = [], defaultdict(int), defaultdict(list), 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, ranks[length], count, sequence, offset))
        ranks[length] += count

    for column in np.argsort(-repeats, kind="stable"):
        parts = [cell + 1 for cell in np.flatnonzero(patterns[:, column]) for _ in range(int(patterns[cell, column]))]
        wanted = int(repeats[column])
        while wanted:
            chosen, taken = [], defaultdict(int)
            for cell in parts:
                length = next((one for one, n in left[cell].items() if n > taken.get(one, 0)), None)
                if length is None:
                    break
                taken[length] += 1
                chosen.append(length)
            if len(chosen) < len(parts):
                break
            count = min(wanted, *(left[-(-one // grid)][one] // n for one, n in taken.items()))
            offset = 0
            for length in sorted(chosen, reverse=True):
                place(length, count, sequences, offset)
                offset += length
            for length, n in taken.items():
                left[-(-length // grid)][length] -= n * count
            space[limit - offset].append((sequences, count))
            sequences += count
            wanted -= count
    for length, count in sorted(((one, n) for row in left.values() for one, n in row.items() if n), reverse=True):
        while count:
            fits = min((free for free, rows in space.items() if free >= length and rows), default=None)
            if fits is None:
                each = min(limit // length, count)
                fresh = count // each
                for i in range(each):
                    place(length, fresh, sequences, i * length)
                count -= fresh * each
                space[limit - each * length].append((sequences, fresh))
                sequences += fresh
                continue
            first, n = space[fits].pop()
            used = min(n, count)
            place(length, used, first, limit - fits)
            space[fits - length].append((first, used))
            if n > used:
                space[fits].append((first + used, n - used))
            count -= used
    return runs


def _placed(runs: list[tuple[int, int, int, int, int]], names: list[str]):
    by_length = defaultdict(list)
    for length, *run in runs:
        by_length[length].append(run)
    tables = {length: np.array(rows, np.int64) for length, rows in by_length.items()}  # ranks ascend

    def run(batches):
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows, table = np.flatnonzero(lengths == length), tables[int(length)]
                at = np.searchsorted(table[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = table[at, 2] + ranks[rows] - table[at, 0]
                offset[rows] = table[at, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as ``pieces`` gives them), sequence_id, offset of every piece."""
    cut = materialise(pieces(docs, path, limit, end_id, with_ids))
    histogram = dict(map(tuple, cut.groupBy("length").count().collect()))  # at most ``limit`` rows
    groups = max(1, sum(histogram.values()) // RANK_ROWS)
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "_group").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", *cut.columns[4:])
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(base, ["length", "_group"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_own") - 1).alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ranked.mapInArrow(_placed(packing_runs(histogram, limit), cut.columns), f"{kinds}, sequence_id long, offset long")


def sequences(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids: the packed sequences, ids as little-endian 32-bit numbers.

    Every row is packed with its own ids, so repeated rows, as a mix makes them, rows without doc_id and unlike texts of one
    doc_id may stand in ``docs``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pack(docs, path, limit, end_id, True).groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"])).alias("ids"))
