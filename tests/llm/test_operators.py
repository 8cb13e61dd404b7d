"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from costlens.llm import chat, common, fingerprint, language, mixing, near_dedup, packing, personal_data, quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(30_000))
TEXTS = [None, "", "  \n\t ", "one", "one", "!!! 123", "a b c d e f g h", "A B c d e f g h", LONG, LONG + " more",
         "same words here again " * 20, "same words here again " * 20, "ünï cödé   x", "'s <|endoftext|> it's"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i if i != 5 else None, text, None if i % 3 else "en", None if i == 4 else f"s{i % 2}", 1, i, "x") for i, text in enumerate(TEXTS)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, node string").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def by_id(frame):
    return {row["doc_id"]: row for row in frame.collect()}


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(texts):
    sets = {i: shingles(text) for i, text in texts.items()}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_on_awkward_rows(awkward, empty):
    found = near_dedup.near_duplicates(awkward)
    assert found.count() == len(TEXTS) + 1
    rows = by_id(found.where("doc_id IS NOT NULL"))
    expected = brute_components({i: text for i, text in enumerate(TEXTS) if i != 5})
    assert {i: (row["n_shingles"], row["component_id"]) for i, row in rows.items()} == expected
    assert all(row["kept"] == (row["component_id"] == i) for i, row in rows.items())
    null = found.where("doc_id IS NULL").first()
    assert null["component_id"] is None and null["kept"]
    kept = near_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(i == c for i, (_, c) in expected.items()) + 1
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_large_nodes_branch_and_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 8)
    rng, rows = np.random.default_rng(5), {}
    base = [f"b{i}" for i in range(60)]
    for i in range(90):
        words = [f"v{i}_{k}" if rng.random() < 0.02 * (i % 4) else word for k, word in enumerate(base)] if i < 60 else base[:8] + [f"u{i}_{k}" for k in range(40)]
        rows[i] = " ".join(words)
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")))
    assert {i: (row["n_shingles"], row["component_id"]) for i, row in found.items()} == brute_components(rows)


def test_pairs_at_other_thresholds(spark):
    assert (near_dedup.tree_count(75), near_dedup.agreeing(75)) == (16, 70)
    rows = {}
    for i in range(30):  # 8 of 16 shingles in common
        common_words = [f"c{i}_{k}" for k in range(12)]
        rows[2 * i], rows[2 * i + 1] = (" ".join(common_words + [f"{side}{i}_{k}" for k in range(4)]) for side in "ab")
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), percent=50))
    assert {i: row["component_id"] for i, row in found.items()} == {i: i - i % 2 for i in rows}
    for percent in (0, 40, 101):
        with pytest.raises(ValueError):
            near_dedup.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=percent)


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 40):
        near = rng.random((size, size)) < 1.2 / size
        near = near | near.T | np.eye(size, dtype=bool)
        label, expected = common.linked(size, lambda i, near=near: near[i]), np.linalg.matrix_power(near.astype(float), max(size, 1)) > 0
        assert ((label[:, None] == label[None, :]) == expected).all()


def brute_repeats(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        words = WORD.findall(texts[i] or "")
        covered = set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k:k + width])
            if window in seen:
                covered.update(range(k, k + width))
            seen.add(window)
        out[i] = (len(words), len(covered), " ".join(w for k, w in enumerate(words) if k not in covered))
    return out


@pytest.mark.parametrize("chunk", [300, 8_000_000])
def test_substring_dedup(spark, awkward, empty, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk * 100 if chunk == 300 else chunk)
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", 5_000)
    unique = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = {i: tuple(row)[1:] for i, row in by_id(substring_dedup.without_repeats(unique)).items()}
    assert found == brute_repeats({i: text for i, text in enumerate(TEXTS) if i != 5}, 20)
    assert substring_dedup.without_repeats(awkward).count() == len(TEXTS) + 1
    assert substring_dedup.without_repeats(empty).count() == 0


def test_fingerprints(awkward, empty):
    found = fingerprint.fingerprints(awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    rows, ids = by_id(found), [i for i in range(len(TEXTS)) if i != 5]
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        text, following = TEXTS[i] or "", TEXTS[after] or ""
        half = len(text) // 2
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_text"] == text[:len(text) - half] + following[:half]
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[3]["fingerprint"] == rows[4]["fingerprint"] and rows[3]["near_next"] == 1.0
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] == "" and rows[8]["near_next"] > 0.9
    assert fingerprint.fingerprints(awkward).count() == len(TEXTS) + 1 and fingerprint.fingerprints(empty).count() == 0


def test_entropy_levels():
    data = np.random.default_rng(0).choice(np.frombuffer(b"the quick  e", np.uint8), 1500)
    data[300:500] = 65
    levels = fingerprint.entropy_levels(data)
    for s in range(0, len(levels), 7):
        share = np.unique(data[s:s + 64], return_counts=True)[1] / 64
        assert abs(round(-(share * np.log2(share)).sum() / 6 * 1000) - levels[s]) <= 1


def test_language_held_out(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).where("held_out").collect()
    assert rows and sum(row["lang"] == row["lang_pred"] for row in rows) >= 0.95 * len(rows)
    assert all(0 <= row["score"] <= 1 for row in rows)
    assert all((zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2) for row in rows)
    found = language.predict(awkward, language.learn(docs.select("doc_id", "text", "lang"))).collect()
    assert len(found) == len(TEXTS) + 1 and {row["text"]: row["lang_pred"] for row in found}[None] == "und"
    assert all(row["lang_pred"] == "und" for row in found if not any(c.isalpha() for c in row["text"] or ""))
    assert language.identify(empty).count() == 0
    assert {row["lang_pred"] for row in language.predict(awkward, {}).collect()} == {"und"}


def test_quality(spark, awkward, empty):
    rows = by_id(quality.judged(awkward))
    for i, text in enumerate(TEXTS):
        if i == 5:
            continue
        words, seen, dup = WORD.findall(text or ""), set(), 0
        found = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if found[tuple(words[k:k + 3])] > 1 for j in range(3)}
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
        assert tuple(rows[i][c] for c in quality.COUNTS) == expected
        assert rows[i]["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (rows[i]["base_failed"] and rows[i]["kept"])
    assert quality.judged(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = quality.judged(docs).drop("quality").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [row["kept"] for row in labels if row["quality"] == 1 and not row["base_failed"]]
    assert good and sum(good) >= 0.98 * len(good)


def test_chat_round_trip(spark):
    marks = "</s>[INST] &lt; ok [/INST] <s> & &#91;"
    turns = [(1, t, r, x) for t, (r, x) in enumerate([("system", "rules " + marks), *[("user" if k % 2 else "assistant", f"{k} " + marks * (k % 5)) for k in range(40)], ("assistant", "long " * 3000)])]
    turns += [(2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "system", "alone"), (None, None, "assistant", "x"), (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.windows(frame)
    assert windows.where("conv_id = 1").count() > 3
    rows = {row["conv_id"]: row for row in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, 4, None):
        own = [(r or "", x or "") for c, _, r, x in turns if c == conv]
        assert [tuple(t) for t in rows[conv]["turns"]] == own
        assert rows[conv]["loss_text"] == "".join(x for r, x in own if r == "assistant")
    assert all(row["formatted"].startswith("<s>[INST]system") for row in windows.where("conv_id = 1").collect())
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = [True, kind == 1 and max(map(int, match.group().split("."))) <= 255 if kind == 1 else False,
                    14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, 10 <= len(digits) <= 15][kind]
            if fine:
                out.append((match.start(), kind, match.end()))
    return sorted(out)


def test_personal_data(spark, awkward, empty):
    hard = ["a@b.c_d@e.f @x.y a@b a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-11115 é 4111111111111111",
            "+1 (988) 555-2485+44 20 7946 0958 +1 2", "9" * 3000, "a" * 9000 + "@b.c", "1 2-3 " * 900, None, "", "phone (212) 555-1234"]
    docs = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_chars", F.length("text").cast("long"))
    rows = by_id(personal_data.spans(docs))
    for i, text in enumerate(hard):
        assert [(s["begin"], s["kind"], s["end"]) for s in rows[i]["spans"] if s["base"]] == brute_spans(text or "")
    masked = by_id(personal_data.redact(docs))
    assert masked[3]["text"] == "[PHONE][PHONE] +1 2" and masked[7]["text"] is None and masked[0]["spans"] == "clash"
    assert all(row["n_chars"] == len(row["text"]) for row in masked.values() if row["text"] is not None)
    assert personal_data.redact(awkward).columns == awkward.columns and personal_data.redact(awkward).count() == len(TEXTS) + 1
    assert personal_data.spans(empty).count() == 0 and personal_data.redact(empty).count() == 0


def test_packing(awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for row in awkward.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            expected[row["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack(awkward).collect()
    assert Counter(tuple(row)[:5] for row in rows) == expected
    used = defaultdict(list)
    for row in rows:
        used[row["sequence_id"]].append((row["offset"], row["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0
    # repeated rows and rows without doc_id are among them
    whole = {row["sequence_id"]: row["ids"] for row in packing.sequences(awkward).collect()}
    assert {number: len(ids) // 4 for number, ids in whole.items()} == {number: sum(n for _, n in parts) for number, parts in used.items()}
    for row in rows:
        part = whole[row["sequence_id"]][4 * row["offset"]:4 * (row["offset"] + row["length"])]
        assert zlib.crc32(part) == row["ids_crc32"]


def test_packing_is_near_the_bound():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(6.5, 1, 20_000).astype(int) + 1)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    runs = packing.packing_runs(histogram)
    places = {length: sum(run[2] for run in runs if run[0] == length) for length in histogram}
    assert places == histogram
    assert max(run[3] + run[2] for run in runs) <= 1.02 * -(-int(lengths.sum()) // 2048)


def test_mixing(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, again = mixing.mix(docs).collect(), mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sources = defaultdict(list)
    for row in rows:
        sources[row["source"]].append(row)
    names = sorted(sources)
    size = {s: sum(row["size"] for row in sources[s]) for s in names}
    left, capped, weights = 1.5 * sum(size.values()), set(), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while True:
        free = left - sum(2 * size[s] for s in capped)
        target = {s: 2 * size[s] if s in capped else free * weights[s] / sum(weights[t] for t in names if t not in capped) for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        assert sources[s][0]["target"] == pytest.approx(target[s])
        assert sum(row["rate"] * row["size"] for row in sources[s]) == pytest.approx(target[s], rel=1e-6)
        assert abs(sum(row["taken"] for row in sources[s]) - target[s]) <= 0.06 * target[s]
        assert all(row["taken"] <= 2 * row["size"] for row in sources[s])
    assert mixing.mix(awkward).count() == len(TEXTS) + 1 and mixing.mix(empty).count() == 0
    assert mixing.copies(awkward).columns == awkward.columns and mixing.copies(empty).count() == 0


def test_pipeline_stages(spark, awkward, empty):
    import corpus_pipeline

    for rows in (awkward, empty):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert json.dumps([name for name, _ in corpus_pipeline.STAGES]) and hashlib  # five named stages
    packed = corpus_pipeline.run(spark, SF).collect()
    assert packed and all(row["length"] <= 2048 for row in packed)
