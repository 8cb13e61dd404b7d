"""Similarity digests of whole texts from improbable byte windows.

Every 64-byte window of a text has an entropy, in thousandths of the largest. A first pass counts how often
each value occurs in all documents; rare values rank first, values of nearly uniform windows last. Among
any 64 consecutive windows the best-ranked one (leftmost at ties) gets a point; windows with 16 points are
the features. Each feature sets five bits of a 2,048-bit Bloom filter; a filter takes 160 features, then
the chain goes on with a new filter. Two digests are compared by the overlap of set bits beyond chance,
divided by the largest overlap possible: for each filter of the shorter chain, the best of the other chain.

Texts under 64 bytes are one feature (the whole text); the empty text, and a null text, have none. The
digest of no features is alike (1.0) to itself only. Rows are ordered by doc_id (null first), then by text.
Other columns are ignored.
"""

import base64

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from costlens.llm.common import byte_values, in_ranges, mixed

WINDOW = 64
NEIGHBOURS = 64
POINTS = 16
LEVELS = 1000
WEAK = 100
FILTER_BITS = 2048
FILTER_FEATURES = 160
CHUNK_BYTES = 4_000_000
SLICE_BYTES = 1_000_000
_COUNT = np.arange(WINDOW + 2)
_TERM = np.round(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * 2**20).astype(np.int64)
_ADDED = np.concatenate([[0], np.cumsum(np.diff(np.diff(np.concatenate([[0], _TERM])))[1:WINDOW])])  # by a byte with n copies
_PIECE = 1 << 16
_FEATURE = np.random.default_rng(11).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level (0 to 1000) of every 64-byte window of ``data``.

    The sum of c log c over the byte counts of a window is built from its equal bytes: a byte with n earlier copies less than
    a window before it adds the first n second differences to every window that holds it, and one with n later copies takes
    as many off again behind it. Copies are counted by comparing the bytes with themselves, 1 to 63 places on, in pieces.
    """
    size = len(data) - WINDOW + 1
    if size <= 0:
        return np.empty(0, np.int16)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for first in range(0, len(data), _PIECE):
        last = min(first + _PIECE, len(data))
        for back in range(1, min(WINDOW, last)):
            start = max(first, back)
            if start >= last:
                continue
            same = (data[start:last] == data[start - back:last - back]).view(np.uint8)
            before[start:last] += same
            after[start - back:last - back] += same
    steps = np.zeros(size, np.int64)  # from one window to the next
    added = _ADDED[before]
    steps[0] = added[:WINDOW].sum()
    steps[1:] = added[WINDOW:]
    steps[1:] -= _ADDED[after[:size - 1]]
    entropy = np.log2(WINDOW) - np.cumsum(steps) / 2**20 / WINDOW
    return np.clip(np.round(entropy / np.log2(WINDOW) * LEVELS), 0, LEVELS).astype(np.int16)


def _counts(batches):
    counts = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        for texts in _slices(byte_values(batch["text"])):
            data = np.frombuffer(b"".join(texts), np.uint8)
            levels = entropy_levels(data)
            inside = np.ones(len(levels), bool)
            for end in np.cumsum([len(text) for text in texts])[:-1]:
                inside[max(0, end - WINDOW + 1):end] = False
            counts += np.bincount(levels[inside], minlength=LEVELS + 1)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["level", "n"])


def _slices(texts: list[bytes | None]) -> list[list[bytes]]:
    """Runs of whole texts of about SLICE_BYTES each."""
    out, size = [[]], 0
    for text in texts:
        out[-1].append(text or b"")
        size += len(text or b"")
        if size >= SLICE_BYTES:
            out.append([])
            size = 0
    return out


def level_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level, rarest in all documents first, weak ones last."""
    counts = np.zeros(LEVELS + 1, np.int64)
    for level, n in docs.select("text").mapInArrow(_counts, "level int, n long").groupBy("level").agg(F.sum("n")).collect():  # at most 1,001 rows
        counts[level] = n
    order = sorted(range(LEVELS + 1), key=lambda level: (level < WEAK, counts[level], level))
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    return ranks


def _features(ranks: list[np.ndarray]) -> list[np.ndarray]:
    """The selected window positions of each text, from the ranks of its windows."""
    padded = []
    for rank in ranks:  # short texts are filled up with windows that are never best
        fill = max(0, NEIGHBOURS - len(rank)) if len(rank) else 0
        padded.append(np.concatenate([rank, np.full(fill, LEVELS + 1)]) if fill else rank)
    sizes = np.array([len(rank) for rank in padded])
    ends = np.cumsum(sizes)
    flat = np.concatenate(padded) if padded else np.empty(0, np.int64)
    count = len(flat) - NEIGHBOURS + 1
    chosen = [np.empty(0, np.int64)] * len(ranks)
    if count <= 0:
        return chosen
    bits = 21 if len(flat) < 1 << 21 else 40  # a rank takes 10 bits beside its place
    best = flat.astype(np.int32 if bits == 21 else np.int64) << bits
    best |= np.arange(len(flat), dtype=best.dtype)
    reach = 1
    while reach < NEIGHBOURS:  # NEIGHBOURS is a power of two
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    inside = np.ones(count, bool)
    for end in ends[:-1]:
        inside[max(0, end - NEIGHBOURS + 1):end] = False
    winners = (best & ((1 << bits) - 1))[inside]  # the places of the best never go back
    runs = np.flatnonzero(np.diff(winners, prepend=-1))
    place, points = winners[runs].astype(np.int64), np.diff(runs, append=len(winners))
    owner = np.searchsorted(ends, place, side="right")
    cut = np.searchsorted(owner, np.arange(len(ranks) + 1))
    for i, (start, end) in enumerate(zip(cut[:-1], cut[1:])):
        if end > start:
            own, score = place[start:end] - (ends[i] - sizes[i]), points[start:end]
            keep = score >= POINTS
            chosen[i] = own[keep] if keep.any() else own[[int(score.argmax())]]
    return chosen


def _filters(data: bytes, places: np.ndarray) -> np.ndarray:
    """The chained filters, a row of bits each."""
    if not data:
        return np.zeros((0, FILTER_BITS), bool)
    if len(data) < WINDOW:
        hashes = np.array([xxhash.xxh3_64_intdigest(data)], np.uint64)
    else:
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WINDOW)[places]
        hashes = mixed((np.ascontiguousarray(windows).view("<u8") * _FEATURE).sum(axis=1, dtype=np.uint64))
        first = np.sort(np.unique(hashes, return_index=True)[1])
        hashes = hashes[first]
    bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), bool)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for part in range(5):
        bits[row, ((hashes >> np.uint64(11 * part)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return bits


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Overlap of set bits beyond chance, between 0 and 1."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    if one.shape == two.shape and (one == two).all():
        return 1.0
    one, two = (one, two) if len(one) <= len(two) else (two, one)
    ones, twos = one.sum(axis=1)[:, None], two.sum(axis=1)[None, :]
    shared, chance, most = one.astype(np.float32) @ two.T.astype(np.float32), ones * twos / FILTER_BITS, np.minimum(ones, twos)
    score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(score.max(axis=1).mean())


def text_of(bits: np.ndarray) -> str:
    return ".".join(base64.b64encode(row.tobytes()).decode() for row in np.packbits(bits, axis=1)) if len(bits) else ""


def _char_bytes(text: str, count: int) -> bytes:
    return text[:count].encode()


def _digests(ranks_of_levels: np.ndarray):
    def one_slice(texts: list[bytes], parts: list[tuple[int, int]]) -> list:
        """For texts and the edits of all but the last: (filters, filters of the edit, the edit)."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        levels, at = entropy_levels(data), np.concatenate([[0], np.cumsum([len(text) for text in texts])])
        windows = [ranks_of_levels[levels[start:max(start, end - WINDOW + 1)]] for start, end in zip(at[:-1], at[1:])]
        edits, seams = [], []
        for (kept, taken), text, after in zip(parts, texts, texts[1:]):
            edits.append(text[:kept] + after[:taken])
            seams.append(edits[-1][max(0, kept - WINDOW + 1):kept + WINDOW - 1])
        seam_at = np.concatenate([[0], np.cumsum([len(seam) for seam in seams])])
        seam_levels = entropy_levels(np.frombuffer(b"".join(seams), np.uint8))
        edited = []
        for i, (kept, taken) in enumerate(parts):
            start, end = seam_at[i], max(seam_at[i], seam_at[i + 1] - WINDOW + 1)
            edited.append(np.concatenate([windows[i][:max(0, kept - WINDOW + 1)], ranks_of_levels[seam_levels[start:end]], windows[i + 1][:max(0, taken - WINDOW + 1)]]))
        own = [_filters(text, places) for text, places in zip(texts, _features(windows))]
        changed = [_filters(text, places) for text, places in zip(edits, _features(edited))]
        return [(own[i], changed[i], own[i + 1], edits[i]) for i in range(len(parts))]

    def run(table: pa.Table) -> pa.Table:
        ids, after, texts = table["doc_id"].to_pylist(), table["after"].to_pylist(), byte_values(table["text"])
        order = sorted(range(len(ids)), key=lambda i: (after[i], ids[i] is not None, ids[i] or 0, texts[i] or b""))
        count = sum(not flag for flag in after)
        order = order[:count + 1] if len(order) > count else [*order, order[0]]  # the first document follows the last
        out = {name: [] for name in ("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        start = 0
        while start < count:
            end, size = start, 0
            while end < count and (end == start or size < SLICE_BYTES):
                size += len(texts[order[end]] or b"")
                end += 1
            rows = [texts[i] or b"" for i in order[start:end + 1]]
            decoded, parts = [row.decode() for row in rows], []
            for text, following in zip(decoded, decoded[1:]):
                half = len(text) // 2
                parts.append((len(_char_bytes(text, len(text) - half)), len(_char_bytes(following, half))))
            for i, (own, changed, following, edit) in enumerate(one_slice(rows, parts)):
                values = (ids[order[start + i]], len(decoded[i]), edit, text_of(own), text_of(changed), likeness(own, changed), likeness(own, following))
                for column, value in zip(out.values(), values):
                    column.append(value)
            start = end
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        arrays = [pa.array(column, kind) for column, kind in zip(out.values(), kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.Table.from_arrays(arrays, list(out))

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text's last half is replaced by the beginning of the next document by doc_id; a copy of the
    first document of each range is added to the range before, and of the first of all to the last range.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = level_ranks(texts)
    placed, cuts, _ = in_ranges(texts, CHUNK_BYTES)
    heads = sorted({float(cut) for cut in cuts})
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("double")
    before = F.when(F.col("chunk") > 0, F.col("chunk") - 1).otherwise(F.lit(max(0, len(heads) - 1)))
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("after"))
    copies = F.when(order.isin(heads), F.array(own, F.struct(before.alias("chunk"), F.lit(True).alias("after")))).otherwise(F.array(own))
    rows = placed.select("doc_id", "text", F.explode(copies).alias("place")).select("doc_id", "text", "place.chunk", "place.after")
    return rows.groupBy("chunk").applyInArrow(
        _digests(ranks), "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
