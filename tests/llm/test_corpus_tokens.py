"""BPE and token counts against the tokenizers library and a plain restatement."""

import hashlib
import tracemalloc

import numpy as np
import pytest
from tokenizers import Tokenizer

from codexmill.llm import bpe, queries, token_counts

TEXTS = ["", None, "Hello  world's 12 cats\n\n", "naïve  Überfall 日本語 😀\x1c\xa0x", "a" * 3000, "same text", "same text", "<|endoftext|> 'll \t end "]
DDL = "doc_id long, text string, n_tokens string, ids string, words int, _tag int"


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if i == 3 else i, t, "x", "y", 1, 2) for i, t in enumerate(TEXTS)], DDL)


def wanted(path):
    tokenizer = Tokenizer.from_file(path)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_encode_and_decode_as_the_library(spark, docs, path):
    ids, texts = wanted(path)
    tokens = bpe.encode(docs, path)
    got = sorted(tokens.collect(), key=lambda r: key(r["doc_id"]))
    assert [(r["n_tokens"], r["ids"]) for r in got] == [(len(ids[i]), ids[i]) for i in [3, 0, 1, 2, 4, 5, 6, 7]]
    assert sorted((key(r["doc_id"]), r["text"]) for r in bpe.decode(tokens, path).collect()) == sorted((-1 if i == 3 else i, t) for i, t in enumerate(texts))


def test_digests(spark, docs, path):
    ids, texts = wanted(path)
    got = {key(r["doc_id"]): r for r in bpe.digests(docs, path).collect()}
    for i in (0, 1, 2, 4, 7):
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


@pytest.mark.parametrize("chunk_words", [1, 40, 10**6])
def test_the_word_table_gives_the_plain_ids(spark, docs, path, chunk_words):
    ids, texts = wanted(path)
    table = bpe.by_word_table(docs, path, with_ids=True, chunk_words=chunk_words)
    got = sorted(table.collect(), key=lambda r: key(r["doc_id"]))
    assert [(r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in got] == [(len(ids[i]), ids[i], hashlib.sha256(texts[i].encode()).hexdigest()) for i in [3, 0, 1, 2, 4, 5, 6, 7]]


def test_packing_holds_little_more_than_the_numbers():
    numbers = (np.random.default_rng(5).integers(0, 150_000, 4_000_000) ** 2 // 150_000).astype(np.uint32)
    held, given = [], numbers
    for step in (bpe.packed, bpe.unpacked):
        tracemalloc.start()
        given = step(given)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (given == numbers).all() and max(held) < 12 * len(numbers), held


def test_only_empty_texts(spark, path):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, bpe.digests(rows, path).collect())) == [(1, 0, nothing, nothing), (2, 0, nothing, nothing)]


def test_no_rows(docs, path):
    assert bpe.digests(docs.limit(0), path).count() == 0 and token_counts.token_counts(docs.limit(0), [b"a"]).count() == 0


def greedy(word, pieces):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = np.random.default_rng(3)
    for _ in range(40):
        pieces = {bytes(rng.choice(list(b"abc"), rng.integers(1, 5))) for _ in range(8)}
        automaton = token_counts.Automaton(pieces)
        for _ in range(60):
            word = bytes(rng.choice(list(b"abc"), rng.integers(1, 14)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(docs, path):
    pieces = token_counts.vocabulary(path)
    known = set(pieces)
    for r in token_counts.token_counts(docs.filter("doc_id is not null"), pieces).collect():
        words = (TEXTS[r["doc_id"]] or "").split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(greedy(b" " + w.encode(), known) for w in words))
