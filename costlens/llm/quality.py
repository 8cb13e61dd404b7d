"""Quality of documents by weak supervision: rules vote good, bad or abstain, and none decides alone.

The votes of a document are one pattern. Patterns are counted over all documents (at most 3 ** rules rows,
whatever the input), expectation-maximisation on the counts estimates how often each rule votes what about
good and about bad documents, and the posterior probability of good is the verdict. Rules start from the
belief that a good document breaks one rule in fifty, a bad one about a third of them; that belief weighs
as much as a twentieth of the data.

Null texts have no words. Repeated rows get one row each. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costlens.llm.common import byte_values
from costlens.session import materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent
KEEP = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def counts_of(text: bytes) -> tuple[int, ...]:
    """COUNTS, then capital ASCII letters, letters' bytes, distinct words, words that end a sentence, lines with a word, words with a symbol."""
    data, words = np.frombuffer(text, np.uint8), text.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))
    repeated = 0
    if len(ids) > 2:
        pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        windows, place, found = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        step = np.zeros(len(ids) + 1, np.int64)
        twice = np.flatnonzero(found[place] > 1)
        step[twice] += 1
        step[twice + 3] -= 1
        repeated = int((np.cumsum(step[:-1]) > 0).sum())
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    space, symbol = _SPACE[data], _SYMBOL[data]
    number = np.cumsum(~space & np.concatenate([[True], space[:-1]]))
    marked = len(np.unique(number[symbol]))
    ends = sum(word.endswith((b".", b"!", b"?")) for word in words)
    return (len(words), int(((data & 0xC0) != 0x80).sum() - space.sum()), int(symbol.sum()), len(lines) - len(set(lines)), repeated,
            int(_UPPER[data].sum()), int(_LETTER[data].sum()), len(numbers), ends, len(lines), marked)


def votes_of(counts: tuple[int, ...]) -> list[int]:
    """The rules: 1 good, -1 bad, 0 abstain."""
    n, chars, symbols, dup_lines, repeated, upper, letters, distinct, ends, lines, marked = counts
    if not n:
        return [-1] + [0] * 9

    def rule(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    return [
        rule(n < LEAST_WORDS, n >= 80),
        rule(not 2.5 <= chars / n <= 12, 3.5 <= chars / n <= 9),
        rule(symbols > 0.2 * n, symbols <= 0.02 * n),
        rule(dup_lines > 0.3 * lines, dup_lines <= 0.1 * lines) if lines >= 8 else 0,
        rule(repeated > 0.3 * n, repeated <= 0.1 * n),
        rule(upper > 0.5 * letters, upper <= 0.2 * letters),
        rule(distinct < 0.1 * n, distinct >= 0.3 * n) if n >= 20 else 0,
        rule(ends > 0.6 * n, 0 < ends <= 0.3 * n),
        rule(marked > 0.15 * n, marked <= 0.02 * n),
        rule(symbols > 0.05 * chars, symbols <= 0.01 * chars),
    ]


RULES = len(votes_of((0,) * 11))


def _rows(batches):
    for batch in batches:
        found = [counts_of(text or b"") for text in byte_values(batch["text"])]
        patterns = [int(sum((vote + 1) * 3**i for i, vote in enumerate(votes_of(counts)))) for counts in found]
        columns = [pa.array([counts[i] for counts in found], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(patterns, pa.int32())], ["doc_id", *COUNTS, "pattern"])


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The probability of good for each pattern, and P(vote | good or bad) of each rule (bad, abstain, good)."""
    votes = (patterns[:, None] // 3 ** np.arange(RULES)) % 3
    total = counts.sum()
    belief = np.array([[0.3, 0.15, 0.55], [0.02, 0.23, 0.75]])  # bad documents, good documents
    good = 1 / (1 + np.exp(-np.log(belief[1] / belief[0])[votes].sum(axis=1)))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.stack([[np.bincount(votes[:, rule], weight[side], minlength=3) + 0.05 * total * belief[side] for rule in range(RULES)] for side in (0, 1)])
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 0.01 * total) / (1.02 * total)
        log = np.log(prior)[:, None] + sum(np.log(table[:, rule, votes[:, rule]]) for rule in range(RULES))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        moved = float(np.abs(new - good).max())
        good = new
        if moved < 1e-10:
            break
    return good, table


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, quality (the posterior probability of good), base_failed, kept."""
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "pattern int"))
    found = rows.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** RULES rows
    patterns, counts = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], float)
    good = posteriors(patterns, counts)[0] if len(found) else np.empty(0)
    table = docs.sparkSession.createDataFrame(pa.table({"pattern": pa.array(patterns, pa.int32()), "quality": pa.array(good, pa.float64())}))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.join(F.broadcast(table), "pattern").select("doc_id", *COUNTS, "quality", failed.alias("base_failed"), (~failed & (F.col("quality") >= KEEP)).alias("kept"))
