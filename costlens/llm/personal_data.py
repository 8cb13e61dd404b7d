"""Personal data by weak supervision, in DataFrame operations.

Four base kinds are found by pattern and check (email, ip, card, phone); these spans always stay. Looser
patterns propose more spans: phone numbers without a plus sign, e-mail addresses spelled
with "at" and "dot", grouped card numbers that fail the check, and secrets, a fifth kind: values assigned to a
name such as password or token, and long runs that mix letters and digits or are all capitals. Labelers vote private, not private,
or abstain on every candidate: the pattern itself (for secrets, known openings of keys), a gazetteer or shape (name endings,
issuer digits, address ranges, how often letters and digits change places), words before it, and what it touches. Base spans need no decision. The votes on all proposals
of all documents are counted (a bounded number of patterns), expectation-maximisation estimates each labeler's reliability, and its posteriors train
the final span classifier, a logistic regression over kind, votes and length, which decides on the proposals.

Base patterns are anchored at the start of a run of their characters (or the end of the last match) and
are possessive, so long runs take linear time and no stack; matches are the leftmost non-overlapping ones of
the plain patterns. Null and empty texts have no spans. Repeated rows get one row each. Positions count code
points from 0. ``redact`` returns the columns of its input; ``spans`` ignores all but doc_id and text. The work
within one text grows with the square of the number of its matches.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from costlens.session import materialise, new_dir

KINDS = ["email", "ip", "card", "phone", "secret"]
MASKS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]"]
_RUN = "A-Za-z0-9._%+-"
BASE = [
    rf"(?:(?<![{_RUN}])|\G)[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
# Names that secrets are assigned to, openings of well-known keys, and values that stand for a secret.
ASSIGNED = "password|passwd|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
OPENINGS = "AKIA|ASIA|AIza|ghp_|gho_|glpat-|xox[abp]-|sk[-_]|pk_live|eyJ"
PLACEHOLDER = "example|changeme|placeholder|xxxx|your|none|null|true|false"
_KEY = r"A-Za-z0-9_+/\-"
SECRET = (  # cheap conditions first: few places follow a sign, few words are long
    rf"(?<=[:=\"'] {{0,1}})(?<=(?i:{ASSIGNED})[\"']{{0,1}} {{0,2}}[:=] {{0,1}}[\"']{{0,1}})[{_KEY}.!$%&*#]{{6,256}}+"
    rf"|(?<![{_KEY}.@=])(?=[{_KEY}]{{16}})(?:(?=[{_KEY}]{{0,60}}[0-9])(?=[{_KEY}]{{0,60}}[A-Za-z])[{_KEY}]{{16,256}}+|[A-Z0-9]{{16,128}}+)(?![{_KEY}.@=][A-Za-z0-9])")
PROPOSED = [
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,64}+ ?(?:\[dot\]|\(dot\)) ?[A-Za-z]{2,12}", r"[\[(]at[\])]"),
    (2, r"(?<![0-9-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9-])", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"),
    (3, r"(?<![0-9+().-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-.][0-9]{4}(?![0-9-])", r"[0-9]{3}[-.][0-9]{4}"),
    (4, SECRET, rf"[:=\"'] ?[{_KEY}.!$%&*#]{{6}}|[{_KEY}]{{16}}"),
]
# Common endings of domain names; words that announce personal data, and words that announce other numbers.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|co"
ANNOUNCING = "e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|ip|address|adresse|telefon|correo|llame"
OTHER = "version|build|release|section|chapter|page|isbn|issn|order|invoice|no|figure|commit|revision|checksum|sha1|sha256|md5|digest|uuid"
CONTEXT = 24
ROUNDS = 100
WEIGHTS = 1 + len(KINDS) + 2 * 4 + 1


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when((F.length(digits) - i) % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: int, found: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        def small(part):
            plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
            return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(F.lit(False))

        return F.forall(F.split(found, r"\."), small)
    digits = _digits(found)
    if kind == 2:
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def _found(text: Column, matches: Column, pattern: str) -> Column:
    """(begin, end, match) of the matches of a pattern, from the lengths of what lies between them."""
    between = F.split(text, pattern, -1)

    def add(state, i):
        begin = state["at"] + F.length(F.element_at(between, i))
        match = F.element_at(matches, i)
        end = begin + F.length(match)
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("begin"), end.alias("end"), match.alias("match")))).alias("out"))

    empty = F.expr("CAST(array() AS array<struct<begin:int,end:int,match:string>>)")
    zipped = F.aggregate(F.sequence(F.lit(1), F.size(matches)), F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda state: state["out"])
    return F.when(F.size(matches) > 0, zipped).otherwise(empty)


def with_candidates(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of docs) and ``_spans``: begin, end, kind, base, votes (four numbers), long."""
    docs = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    asked = [("@", None), (".", None), (None, "[0-9][0-9 -]{12}"), ("+", None)]
    rows = docs
    for kind, (letter, needed) in enumerate(asked):
        may = text.contains(letter) if letter else text.rlike(needed)
        none = F.expr("CAST(array() AS array<string>)")
        rows = rows.withColumn(f"_match{kind}", F.when(may, F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))).otherwise(none))
    for number, (_, pattern, needed) in enumerate(PROPOSED):
        none = F.expr("CAST(array() AS array<string>)")
        rows = rows.withColumn(f"_more{number}", F.when(text.rlike(needed), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    def of_kind(kind: int, is_base: bool):
        return lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["match"].alias("match"), F.lit(kind).alias("kind"), F.lit(is_base).alias("base"))

    def passing(kind: int):
        return lambda s: _passes(kind, s["match"])

    base = [F.transform(F.filter(_found(text, F.col(f"_match{kind}"), BASE[kind]), passing(kind)), of_kind(kind, True)) for kind in range(4)]
    rows = rows.withColumn("_base", F.concat(*base))
    more = F.concat(*[F.transform(_found(text, F.col(f"_more{number}"), pattern), of_kind(kind, False)) for number, (kind, pattern, _) in enumerate(PROPOSED)])
    apart = F.filter(more, lambda m: ~F.exists("_base", lambda b: (b["begin"] < m["end"]) & (m["begin"] < b["end"])))
    rows = rows.withColumn("_all", F.concat("_base", apart))

    def voted(s):
        before = F.lower(F.substring(text, F.greatest(s["begin"] - CONTEXT, F.lit(0)) + 1, F.least(s["begin"], F.lit(CONTEXT))))
        digits, near = _digits(s["match"]), F.concat(F.substring(text, s["begin"], F.when(s["begin"] > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(1)))
        turns = F.regexp_count(s["match"], F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
        opening = s["match"].rlike(rf"^(?:{OPENINGS})")
        assigned = before.rlike(rf"(?:{ASSIGNED})[\"']?\s*[:=]\s*[\"']?$")
        listed = (
            F.when(s["kind"] == 0, F.when(s["match"].rlike(rf"(?i)(?:\.|dot[\])] ?)(?:{ENDINGS})$"), 1).otherwise(0))
            .when(s["kind"] == 1, F.when(s["match"].rlike(r"^(?:0|127|255)\."), -1).otherwise(1))
            .when(s["kind"] == 2, F.when(digits.rlike("^(?:4|5[1-5]|3[47]|6)"), 1).otherwise(-1))
            .when(s["kind"] == 4, F.when(s["match"].rlike(rf"(?i)^(?:{PLACEHOLDER})|/.*/|^([a-z]+[-_/])+[a-z]+$"), -1).when(turns >= 3, 1).when((turns <= 1) & ~opening, -1).otherwise(0))
            .otherwise(F.when(digits.rlike("^(?:1?[2-9]|[2-9])"), 1).otherwise(-1)))
        context = F.when(s["kind"] == 4, F.when(assigned, 1).when(before.rlike(rf"\b(?:{OTHER})\b"), -1).otherwise(0)).when(before.rlike(rf"\b(?:{ANNOUNCING})\b"), 1).when(before.rlike(rf"\b(?:{OTHER})\b[ .:#]*$"), -1).otherwise(0)
        touch = F.when(assigned, 0).when(near.rlike(r"^[A-Za-z0-9_=/#]| [A-Za-z0-9_=/]$"), -1).otherwise(0)
        return F.struct(
            s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"),
            F.when(s["base"] | ((s["kind"] == 4) & opening), 1).otherwise(0).alias("v0"), listed.alias("v1"), context.alias("v2"), touch.alias("v3"),
            F.least(F.length(s["match"]) / 8, F.lit(4)).cast("int").alias("long"))

    return rows.select("row", F.transform("_all", voted).alias("_spans"))


def _design(kind, votes, long) -> list:
    """The features of a span: constant, kinds, two for each labeler, length."""
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(vote == sign) for vote in votes for sign in (1, -1)], long / 4.0]


def learn(candidates: DataFrame) -> list[float]:
    """The classifier's weights, from the votes on all candidates."""
    counted = candidates.select(F.explode("_spans").alias("s")).select("s.*").where("NOT base").groupBy("kind", "v0", "v1", "v2", "v3", "long").count()
    rows = sorted(tuple(row) for row in counted.collect())  # at most 5 * 81 * 5 rows
    votes = np.array([row[1:5] for row in rows], int).reshape(-1, 4) + 1
    counts = np.array([row[6] for row in rows], float)
    total = counts.sum()
    belief = np.array([[0.3, 0.55, 0.15], [0.05, 0.45, 0.5]])  # not private, private: votes against, abstaining, for
    good = 1 / (1 + np.exp(-np.log(belief[1] / belief[0])[votes].sum(axis=1)))
    for _ in range(ROUNDS):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.stack([[np.bincount(votes[:, j], weight[side], minlength=3) + (1 + 0.1 * total) * belief[side] for j in range(4)] for side in (0, 1)])
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (total + 2)
        log = np.log(prior)[:, None] + sum(np.log(table[:, j, votes[:, j]]) for j in range(4))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    design = np.array([_design(row[0], row[1:5], row[5]) for row in rows]).reshape(-1, WEIGHTS)
    weights = np.zeros(WEIGHTS)
    scale = max(total, 1.0)
    for _ in range(50):  # Newton steps of ridge logistic regression on the posteriors
        guess = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (counts / scale * (good - guess)) - 1e-3 * weights
        curve = (design * (counts / scale * guess * (1 - guess))[:, None]).T @ design + 1e-3 * np.eye(WEIGHTS)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(w) for w in weights]


def _accepted(weights: list[float]) -> Column:
    """Base spans and the proposals that the classifier takes, by begin and kind."""
    def probable(s):
        score = F.lit(weights[0])
        for k in range(len(KINDS)):
            score = score + F.when(s["kind"] == k, weights[1 + k]).otherwise(0.0)
        votes = 1 + len(KINDS)
        for j in range(4):
            score = score + F.when(s[f"v{j}"] == 1, weights[votes + 2 * j]).when(s[f"v{j}"] == -1, weights[votes + 1 + 2 * j]).otherwise(0.0)
        return score + s["long"] * (weights[-1] / 4)

    kept = F.filter("_spans", lambda s: s["base"] | (probable(s) >= 0))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of begin, kind (its number), end, base."""
    found = materialise(with_candidates(docs.select("doc_id", "text")).select("row.doc_id", "_spans"))
    return found.select("doc_id", _accepted(learn(found)).alias("spans"))


def as_text(found: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every accepted span replaced by the mask of its kind; overlapping spans become one. n_chars follows."""
    path = new_dir(docs.sparkSession, "candidates")  # found once: the classifier needs all of them before it decides on any
    with_candidates(docs).write.parquet(path)
    candidates = docs.sparkSession.read.parquet(path)
    found = candidates.select("row", F.col("row.text").alias("old"), _accepted(learn(candidates)).alias("spans"))
    masks = F.array(*[F.lit(mask) for mask in MASKS])

    def add(state, s):
        free = s["begin"] >= state["at"]
        gap = F.substring(F.col("old"), state["at"] + 1, F.greatest(s["begin"] - state["at"], F.lit(0)))
        parts = F.when(free, F.concat(state["out"], F.array(gap, F.element_at(masks, s["kind"] + 1)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
    text = F.aggregate("spans", start, add, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(F.col("old"), state["at"] + 1, F.length("old"))))
    changed = found.withColumn("new", F.when(F.size("spans") > 0, text).otherwise(F.col("old")))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length("new").cast("long"), F.col("row.n_chars")))
    return changed.select(row.alias("row")).select("row.*")
