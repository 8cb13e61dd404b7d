"""Greedy word-piece lengths of whole texts in one pass over each word, without building pieces.

The pieces of a word are its longest prefix in the vocabulary, then the longest prefix of the rest, and so
on. A trie of the vocabulary gets failure links: where a node has no child for the next byte, the pieces
that are settled by then are popped and matching goes on at the node of what is left. Only the number of
popped pieces is kept with a node. Each byte is read once and each link shortens what is left, so the time
is linear in the word. Counts of frequent words are remembered for a while.

Words are lower-cased (A-Z) and end at ASCII white space. A word that cannot be cut into vocabulary entries
counts as one unknown piece. Null and empty texts have no words. Repeated rows get one row each. Other
columns are ignored.
"""

import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costlens.llm.common import byte_values

END_MARK = "</w>"
CACHED_WORDS = 1_000_000
CACHED_BYTES = 64
_automata: dict[str | None, "Automaton"] = {}


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        parents, letters, entry = [0], [0], [False]
        for piece in filter(None, vocabulary):
            node = 0
            for byte in piece:
                key = node * 256 + byte
                if key not in self.child:
                    self.child[key] = len(parents)
                    parents.append(node)
                    letters.append(byte)
                    entry.append(False)
                node = self.child[key]
            entry[node] = True
        self.link, self.popped = [-1] * len(parents), [0] * len(parents)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node]] + 1  # parents come first
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            if entry[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            at, popped = self.link[parents[node]], self.popped[parents[node]]
            while at >= 0 and at * 256 + letters[node] not in self.child:
                popped += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.child[at * 256 + letters[node]], popped
        self.cache: dict[bytes, int] = {}

    def pieces(self, word: bytes) -> int:
        """The number of pieces, or 0 for an unknown word."""
        child, link, popped, node, count = self.child, self.link, self.popped, 0, 0
        for byte in word:
            while (after := child.get(node * 256 + byte)) is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = after
        while node:
            count += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return count

    def count(self, text: bytes) -> tuple[int, int, int]:
        """Words, pieces, unknown words."""
        words, total, unknown, cache = text.lower().split(), 0, 0, self.cache
        for word in words:
            found = cache.get(word)
            if found is None:
                found = self.pieces(word)
                if len(word) <= CACHED_BYTES:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = found
            total += found or 1
            unknown += not found
        return len(words), total, unknown


def vocabulary_of(path: str) -> list[bytes]:
    """The entries of a byte-level vocabulary file, as bytes, without marks of word ends."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(byte): byte for byte in plain}
    letters |= {chr(256 + place): byte for place, byte in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    bare = (token.removesuffix(END_MARK) for token in tokens)
    return sorted({bytes(letters[c] for c in token) for token in bare if all(c in letters for c in token)})


def _automaton(path: str | None) -> Automaton:
    if path not in _automata:
        import public_tokenizers

        _automata[path] = Automaton(vocabulary_of(path or public_tokenizers.path("word_bpe_49k.json")))
    return _automata[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every document."""
    def run(batches):
        automaton = _automaton(path)
        for batch in batches:
            found = [automaton.count(text or b"") for text in byte_values(batch["text"])]
            columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
