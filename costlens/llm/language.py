"""Language identification in two steps: the language family, then one-versus-one within the family.

A text is its letter n-grams (one to three code points, lower case, every run of other characters a single
space), counted over the whole text in hashed bins; square roots of the counts, length one. One linear
support vector machine for each family (against all others) chooses the family, one for each pair of the
family's languages votes within it. They are fitted on up to ``SAMPLE`` labelled documents of each language,
chosen by a hash of doc_id: a bounded sample whose classifiers are fitted each in a task of its own.

Families follow a fixed table; a language that is not in it is a family by itself. Null texts and texts
without a letter get ``und`` and score 0. Empty training data gives ``und`` for all. Labels that are null are
not learned. Repeated rows are predicted each. Other columns are returned as they are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from costlens.llm.common import released

BINS = 2048
SAMPLE = 400
UNKNOWN = "und"
# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "da de en is nl no sv".split(),
    "romance": "ca es fr gl it pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "semitic": "ar he mt".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_letters: list[np.ndarray] = []


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def features(text: str | None) -> np.ndarray | None:
    """The vector of a text, or None if it has no letter."""
    if not _letters:
        _letters.append(np.array([chr(code).isalpha() for code in range(0x110000)]))
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    points = points[letter | np.concatenate([[True], letter[:-1]])]
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    counts = np.zeros(BINS, np.int64)
    gram = np.zeros(len(points), np.uint32)
    for length in range(1, 4):
        gram = (gram[:len(points) - length + 1] * np.uint32(0x01000193)) ^ (points[length - 1:] * np.uint32(0x9E3779B1))
        counts += np.bincount(((gram * np.uint32(0x85EBCA6B)) >> np.uint32(21)).astype(np.int64), minlength=BINS)
    vector = np.sqrt(counts)
    return vector / np.sqrt((vector**2).sum())


def _vectors(batches):
    for batch in batches:
        rows = [features(text) for text in batch["text"].to_pylist()]
        keep = [i for i, row in enumerate(rows) if row is not None]
        yield pa.RecordBatch.from_arrays(
            [batch["lang"].take(pa.array(keep, pa.int64())), pa.array([rows[i].astype("<f4").tobytes() for i in keep], pa.binary())], ["lang", "vector"])


def fit(vectors: np.ndarray, signs: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the constant) of a linear support vector machine, by dual coordinate descent."""
    rows = np.concatenate([vectors, np.ones((len(vectors), 1))], axis=1)
    size, alpha, weights = (rows**2).sum(axis=1), np.zeros(len(rows)), np.zeros(rows.shape[1])
    order = np.random.default_rng(3)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slope = signs[i] * (rows[i] @ weights) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), cost)
            if new != alpha[i]:
                weights += (new - alpha[i]) * signs[i] * rows[i]
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3 * cost:
            break
    return weights


def _fitted(table: pa.Table) -> pa.Table:
    blobs, signs = table["vector"].to_pylist(), table["sign"].to_numpy().astype(float)
    order = sorted(range(len(blobs)), key=lambda i: (signs[i], blobs[i]))  # the same order in every run
    vectors = np.stack([np.frombuffer(blobs[i], "<f4") for i in order]).astype(float)
    weights = fit(vectors, signs[order])
    return pa.table({"task": [table["task"][0].as_py()], "weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


def learn(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights by task: ``family/F`` for a family against the others, ``A/B`` for two languages of a family (A positive)."""
    known = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("doc_id").distinct()
    languages = sorted(row[0] for row in known.select("lang").distinct().collect())  # one row for each language
    if not languages:
        return {}
    families = sorted({family_of(one) for one in languages})
    rows = []
    for one in languages:
        rows += [(one, f"family/{family}", 1 if family == family_of(one) else -1) for family in families]
        rows += [(one, f"{min(one, two)}/{max(one, two)}", 1 if one < two else -1) for two in languages if two != one and family_of(two) == family_of(one)]
    tasks = labelled.sparkSession.createDataFrame(pa.table({"lang": [r[0] for r in rows], "task": [r[1] for r in rows], "sign": [r[2] for r in rows]}))
    vectors = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").where("lang IS NOT NULL").select("text", "lang")  # at most sample rows a language
    fitted = vectors.mapInArrow(_vectors, "lang string, vector binary").join(F.broadcast(tasks), "lang").groupBy("task").applyInArrow(_fitted, "task string, weights array<double>")
    model = {row["task"]: np.array(row["weights"]) for row in fitted.collect()}  # one row for each classifier
    return {"languages": languages, **model}


def decide(vector: np.ndarray, model: dict) -> tuple[str, float]:
    """The language and a score between 0 and 1."""
    row = np.append(vector, 1.0)
    margin = {task.partition("/")[2]: float(row @ weights) for task, weights in model.items() if task.startswith("family/")}
    family = max(margin, key=lambda name: (margin[name], name))
    languages = [one for one in model["languages"] if family_of(one) == family]
    sure, votes = 1 / (1 + np.exp(-3 * (margin[family] + 0.5))), dict.fromkeys(languages, 0.0)
    for i, one in enumerate(languages):
        for two in languages[i + 1:]:
            value = 1 / (1 + np.exp(-3 * float(row @ model[f"{one}/{two}"])))
            votes[one] += value
            votes[two] += 1 - value
    best = max(languages, key=lambda one: (votes[one], one))
    return best, float(sure * (votes[best] / (len(languages) - 1) if len(languages) > 1 else 1.0))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def predict(docs: DataFrame, model: dict, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, under names that replace columns of the table; only the text is looked at."""
    def run(batches):
        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                vector = features(text) if model else None
                found.append((UNKNOWN, 0.0) if vector is None else decide(vector, model))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*batch.schema.names, lang, score])

    rest = docs.drop(lang, score)
    return rest.mapInArrow(released(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields) + f", `{lang}` string, `{score}` double")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, held: str = "held_out", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with held_out, lang_pred, score; learned from the labelled documents that are not held out.

    Columns of these names are replaced; give other names (``free_name``) to keep a table's own.
    """
    model = learn(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs.withColumn(held, held_out()), model, lang, score)
