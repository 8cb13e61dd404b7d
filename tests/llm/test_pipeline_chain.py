"""The pipeline's stages, each on what its predecessor kept: near duplicates and pieces against brute force, the others against their operators."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import SF
from test_operators import WORD, brute_components

import corpus_pipeline
from costlens.llm import language, mixing, personal_data

BARE_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_chain(spark, tmp_path):
    docs, after = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after.append(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    given, known, single, masked, mixed = ({row["doc_id"]: row for row in frame.collect()} for frame in after)
    assert all(frame.columns == columns for frame in after)

    found = {row["doc_id"]: row for row in language.identify(after[0]).collect()}
    wanted = {i: row["lang_pred"] for i, row in found.items() if row["lang_pred"] != "und" and row["score"] >= corpus_pipeline.LEAST_SCORE}
    assert {i: row["lang"] for i, row in known.items()} == wanted
    assert all(row["text"] == given[i]["text"] and row["source"] == given[i]["source"] for i, row in known.items())

    parts = brute_components({i: row["text"] for i, row in known.items()})
    assert single == {i: known[i] for i, (_, part) in parts.items() if part == i}

    assert set(masked) == set(single)
    touched = {row["doc_id"] for row in personal_data.spans(after[2]).where("size(spans) > 0").collect()}
    assert {i for i in masked if masked[i]["text"] != single[i]["text"]} == touched
    assert after[3].where(after[3]["text"].rlike(BARE_EMAIL)).count() == 0

    taken = {row["doc_id"]: (row["taken"], row["size"]) for row in mixing.mix(after[3]).collect()}
    copies = Counter(row["doc_id"] for row in after[4].collect())
    assert all(size == len(WORD.findall(masked[i]["text"] or "")) for i, (_, size) in taken.items())
    assert {i: n * taken[i][1] for i, n in copies.items() if taken[i][1]} == {i: n for i, (n, size) in taken.items() if n}
    assert all(row == masked[i] for i, row in mixed.items())

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, pieces, used = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for i, n in copies.items():
        ids = tokenizer.encode(masked[i]["text"] or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            pieces[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += n
    rows = docs.collect()
    assert Counter(tuple(row)[:5] for row in rows) == pieces
    for row in rows:
        used[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in used.values():
        places.sort()
        ends = [offset + length for offset, length in places]
        assert [offset for offset, _ in places] == [0, *ends[:-1]] and ends[-1] <= 2048
