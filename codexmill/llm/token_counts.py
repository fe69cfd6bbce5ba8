"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie over bytes. Each node that a longest match cannot leave
by the next byte has a failure link to the node of what remains after its longest
pieces are taken off, and the number of pieces so taken. A word's count is then the sum
of these numbers along one pass over its bytes; no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of_letter, spec_of
from .common import text_of

#: Distinct words whose counts a task remembers before it begins anew.
MEMO_WORDS = 300_000
#: The byte that a word begins with in the vocabulary; a space in byte-level vocabularies.
START = b" "


class Automaton:
    """Greedy longest-match piece counts over a set of byte strings."""

    def __init__(self, pieces: Iterable[bytes]):
        self.go: list[dict[int, int]] = [{}]
        ends = {0: False}
        for piece in pieces:
            node = 0
            for byte in piece:
                step = self.go[node].get(byte)
                if step is None:
                    step = self.go[node][byte] = len(self.go)
                    self.go.append({})
                node = step
            ends[node] = True
        n = len(self.go)
        #: Where to go on after the longest pieces are taken off; -1 if that can't be done.
        self.fail = [-1] * n
        #: How many pieces are taken off then.
        self.pops = [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.go[parent].items():
                queue.append(node)
                if ends.get(node):
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, taken = self.fail[parent], self.pops[parent]
                while at >= 0 and byte not in self.go[at]:
                    taken += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.go[at][byte], taken

    def count(self, word: bytes) -> int:
        """The pieces of the word; 1 (one unknown token) if its bytes can't all be matched."""
        go, fail, pops = self.go, self.fail, self.pops
        node = total = 0
        for byte in word:
            step = go[node].get(byte)
            while step is None:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
                step = go[node].get(byte)
            node = step
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as bytes, without its special tokens."""
    letters = byte_of_letter()
    spec = json.loads(spec_of(path))
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(letters[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special]


def counted(batches: Iterator[pa.RecordBatch], pieces: list[bytes], start: bytes) -> Iterator[pa.RecordBatch]:
    automaton, memo = Automaton(pieces), {}
    for batch in batches:
        tokens, words = [], []
        for text in batch["text"].to_pylist():
            split = text.split()
            for word in set(split).difference(memo):
                memo[word] = automaton.count(start + word.encode())
            tokens.append(sum(map(memo.__getitem__, split)))
            words.append(len(split))
            if len(memo) > MEMO_WORDS:
                memo.clear()
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})


def token_counts(docs: DataFrame, pieces: list[bytes], start: bytes = START) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens.

    Words are split at white space and begin with ``start``; each is cut into the longest
    pieces from its left. A word that the vocabulary can't spell is one unknown token.
    Null and empty texts have no words. The vocabulary travels to each task once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lambda b: counted(b, sent.value, start), "doc_id long, n_words long, n_tokens long")
