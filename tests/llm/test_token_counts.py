"""Longest-match counts against cutting every word piece by piece."""

import numpy as np
from conftest import SF

from costlens.llm import token_counts


def greedy(word, vocabulary, longest):
    at = count = 0
    while at < len(word):
        size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at:at + n] in vocabulary), 0)
        if not size:
            return 0
        at, count = at + size, count + 1
    return count


def test_automaton_on_random_words():
    rng = np.random.default_rng(4)
    for _ in range(60):
        vocabulary = {bytes(rng.choice([97, 98, 99], rng.integers(1, 6)).tolist()) for _ in range(rng.integers(1, 12))}
        automaton = token_counts.Automaton(sorted(vocabulary))
        for _ in range(60):
            word = bytes(rng.choice([97, 98, 99], rng.integers(1, 14)).tolist())
            assert automaton.pieces(word) == greedy(word, vocabulary, 6)


def test_documents_and_awkward_rows(spark):
    import public_tokenizers

    vocabulary = set(token_counts.vocabulary_of(public_tokenizers.path("word_bpe_49k.json")))
    longest = max(map(len, vocabulary))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "x" * 20_000), (-5, "Ünï ÑÑ 你好"), (-5, "Ünï ÑÑ 你好"), (None, "a b")], "doc_id long, text string")
    docs = docs.unionByName(more)
    texts = sorted((str(row["doc_id"]), (row["text"] or "").encode().lower().split()) for row in docs.collect())
    found = sorted((str(row["doc_id"]), row["n_words"], row["n_tokens"], row["n_unknown"]) for row in token_counts.token_counts(docs).collect())
    expected = sorted((i, len(words), sum(greedy(w, vocabulary, longest) or 1 for w in words), sum(not greedy(w, vocabulary, longest) for w in words)) for i, words in texts)
    assert found == expected
    assert token_counts.token_counts(docs.limit(0)).count() == 0
