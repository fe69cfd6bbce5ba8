"""BPE encoding and decoding over tables of distinct words.

Texts are split into words (the pieces that merges never cross) inside Spark's tasks.
The distinct words of the corpus meet in one table, where each is encoded once; ids are
joined back by position. Decoding joins ids with their pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, shuffle_width, text_of

#: The published word pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Word places of a chunk, of which a text is never parted.
CHUNK_WORDS = 4_000_000
#: Compression of what is shuffled.
LEVEL = 9
#: Word places that are turned into ids and bytes at a time.
STRIDE = 250_000
#: Words given to the tokenizer at a time, and rows of an output batch.
ENCODED_WORDS, OUT_ROWS = 2_000, 500


class Splitter:
    """Texts to words, the pieces that merges never cross."""

    def __init__(self, added: Iterable[str]):
        self.split, self.added = regex.compile(PATTERN).findall, list(added)
        self.fence = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def words(self, text: str) -> list[str]:
        """The text's words in order; an added token is a word of its own."""
        if self.fence is None or not any(a in text for a in self.added):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.fence.split(text)):
            out += [part] if k % 2 else self.split(part)
        return out


class Codec:
    """Words to ids and ids to text for one tokenizer file's content."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens", [])}
        self.words = Splitter(self.added).words
        self.table: dict[str, bytes] = {}
        self.pieces = id_pieces(self.tokenizer, self.added)

    def learn(self, words: set[str]) -> None:
        """Encodes the words that the table lacks, each once."""
        new = [w for w in words if w not in self.table]
        for a in range(0, len(new), ENCODED_WORDS):
            part = new[a : a + ENCODED_WORDS]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.table[word] = np.array(found.ids, dtype="<u4").tobytes()


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level pieces: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def id_pieces(tokenizer: Tokenizer, added: dict[str, int]) -> list[bytes]:
    letters = byte_of_letter()
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = piece.encode() if added.get(piece) == i else bytes(letters[c] for c in piece)
    return out


def spec_of(path: str) -> str:
    """The tokenizer file, read on the driver; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def thin_rows(doc_ids: list, ids: list[bytes]) -> dict[str, pa.Array]:
    return {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}


def lists(ids: list[bytes]) -> pa.Array:
    return pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))


def thin(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def strides(n: int) -> list[slice]:
    return [slice(a, a + STRIDE) for a in range(0, n, STRIDE)]


def grouped(numbers: np.ndarray, shift: int = 0) -> Iterator[tuple[slice, np.ndarray]]:
    """Each stride of the numbers, and where its members stand when all are grouped by value without ``shift`` bits, equal ones in order.

    What an argsort of the whole would give, but no temporary array is longer than a stride.
    """
    sizes = np.zeros(max((int(numbers[at].max()) >> shift for at in strides(len(numbers))), default=-1) + 1, dtype=np.int64)
    for at in strides(len(numbers)):
        found = np.bincount(numbers[at] >> shift)
        sizes[: len(found)] += found
    start = np.cumsum(sizes) - sizes
    for at in strides(len(numbers)):
        values = numbers[at] >> shift
        order = np.argsort(values, kind="stable")
        held, counts = np.unique(values, return_counts=True)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.repeat(start[held] - np.cumsum(counts) + counts, counts) + np.arange(len(order))
        start[held] += counts
        yield at, place


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed: the upper bytes, then the low bytes grouped by what stands above them."""
    planes = np.empty((4, len(numbers)), dtype=np.uint8)
    for at, place in grouped(numbers, 8):
        planes[:3, at] = (numbers[at] >> 8).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
        planes[3, place] = numbers[at] & 255
    return zstandard.compress(planes.data, LEVEL)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    out = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    out[:, :3] = planes[:3].T
    out = out.view("<u4").reshape(-1)
    for at, place in grouped(out):
        out[at] = out[at] << 8 | planes[3, place]
    return out


CHUNK = "chunk long, doc_ids array<long>, lengths array<int>, places binary, buckets binary, words array<binary>"


def numbered(batches: Iterator[pa.RecordBatch], added: list[str], chunk_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks of rows: places as numbers of the chunk's distinct words, and these words, frequent ones first, by bucket."""
    splitter, chunk = Splitter(added), TaskContext.get().partitionId() << 32
    numbers: dict[str, int] = {}
    doc_ids, texts, total = [], [], 0
    pa.default_memory_pool().release_unused()  # what the worker's earlier tasks have left

    def closed() -> pa.RecordBatch:
        lengths, flat = [len(t) for t in texts], np.concatenate(texts)
        texts.clear()  # a chunk's places are held once
        counts = np.zeros(len(numbers), dtype=np.int64)
        for at in strides(len(flat)):
            counts += np.bincount(flat[at], minlength=len(numbers))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        for at in strides(len(flat)):
            flat[at] = rank[flat[at]]
        words = np.array(list(numbers), dtype=object)[order]
        of = (pd.util.hash_array(words, categorize=False) % np.uint64(buckets)).astype(np.int64) if len(words) else order
        by = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=buckets))[:-1])
        lists_ = [zstandard.compress(json.dumps(words[at].tolist(), ensure_ascii=False).encode(), LEVEL) if len(at) else None for at in by]
        row = {"chunk": [chunk], "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int32()))}
        return pa.RecordBatch.from_pydict(row | {"places": [packed(flat)], "buckets": [packed(of)], "words": pa.array([lists_], pa.list_(pa.binary()))})

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            words = splitter.words(text.as_py())
            for word in set(words).difference(numbers):
                numbers[word] = len(numbers)
            doc_ids.append(doc_id)
            texts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            total += len(words) + 1
            if total >= chunk_words:
                yield closed()
                numbers, doc_ids, texts, total, chunk = {}, [], [], 0, chunk + 1
    if doc_ids:
        yield closed()


def coded(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    """The ids of each list of words; the task holds all lists of its buckets, and encodes a word once."""
    codec = Codec(spec)
    for batch in batches:
        counts, ids = [], []
        for data in batch["words"].to_pylist():
            words = json.loads(zstandard.decompress(data))
            codec.learn(set(words))
            each = [codec.table[w] for w in words]
            counts.append(packed(np.array([len(x) // 4 for x in each])))
            ids.append(packed(np.frombuffer(b"".join(each), dtype="<u4")))
        yield pa.RecordBatch.from_pydict({"chunk": batch["chunk"], "bucket": batch["bucket"], "counts": pa.array(counts, pa.binary()), "ids": pa.array(ids, pa.binary())})


def met(keys: np.ndarray, size: np.ndarray, start: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that belong to the keys, in order, and where each key's begin and end."""
    each = size[keys]
    ends = np.r_[0, np.cumsum(each)]
    return values[np.repeat(start[keys] - ends[:-1], each) + np.arange(ends[-1])], ends


def assembled(chunk: pa.Table, found: pa.Table, pieces: list[bytes], with_ids: bool) -> Iterator[pa.Table]:
    """The rows of one chunk: its places joined with the ids of its words, and these with their pieces."""
    doc_ids, lengths = chunk["doc_ids"][0].as_py(), np.array(chunk["lengths"][0].as_py(), dtype=np.int64)
    places, of = unpacked(chunk["places"][0].as_py()), unpacked(chunk["buckets"][0].as_py())
    order = np.argsort(of, kind="stable")
    found = found.sort_by("bucket")
    counts = np.concatenate([np.zeros(0, np.int64), *map(unpacked, found["counts"].to_pylist())])
    ids = np.concatenate([np.zeros(0, np.int64), *map(unpacked, found["ids"].to_pylist())])
    size, start = np.zeros((2, len(order)), dtype=np.int64)
    size[order], start[order] = counts, np.cumsum(counts) - counts
    piece_size = np.array([len(x) for x in pieces], dtype=np.int64)
    piece_start, letters = np.cumsum(piece_size) - piece_size, np.frombuffer(b"".join(pieces), dtype=np.uint8)
    bounds = np.r_[0, np.cumsum(lengths)]
    first = 0
    while first < len(doc_ids):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STRIDE, side="right")) - 1)
        at = bounds[first : last + 1] - bounds[first]
        tokens, cuts = met(places[bounds[first] : bounds[last]], size, start, ids)
        raw, ends = met(tokens, piece_size, piece_start, letters)
        cuts = cuts[at]
        ends, tokens, raw = ends[cuts], tokens.astype("<u4").tobytes(), raw.tobytes()
        own = [tokens[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        back = [sha(raw[a:b].decode("utf-8", errors="replace").encode()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        shown = {"ids": lists(own)} if with_ids else {"ids_sha256": pa.array([sha(x) for x in own], pa.string())}
        yield pa.table(thin_rows(doc_ids[first:last], own) | shown | {"decoded_sha256": pa.array(back, pa.string())})
        first = last


def by_word_table(docs: DataFrame, path: str, with_ids: bool, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Every text encoded and decoded through one table of the corpus's distinct words.

    Tasks split texts into words and keep them as chunks: places, and the distinct words
    that these number. A bucket of the table, by hash of the word, gets each chunk's words
    of that bucket as one packed list; there each distinct word is encoded once. The ids go back to the chunks,
    are joined with the places by number and with the pieces by id. So what is shuffled is
    the packed places once and each chunk's packed distinct words, not a row for each word.
    """
    spec = spec_of(path)
    codec = Codec(spec)
    added, buckets = list(codec.added), 2 * shuffle_width(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(codec.pieces)  # as large as the vocabulary
    chunks = cut(thin(docs).mapInArrow(lambda b: numbered(b, added, chunk_words, buckets), CHUNK))
    words = chunks.select("chunk", F.posexplode("words").alias("bucket", "words")).filter(F.col("words").isNotNull()).repartition("bucket")
    found = words.mapInArrow(lambda b: coded(b, spec), "chunk long, bucket int, counts binary, ids binary")
    shown = "ids array<int>" if with_ids else "ids_sha256 string"
    return (
        chunks.drop("words").groupBy("chunk").cogroup(found.groupBy("chunk"))
        .applyInArrow(lambda c, f: pa.concat_tables(assembled(c, f, sent.value, with_ids)), f"doc_id long, n_tokens long, {shown}, decoded_sha256 string")
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a whole round trip of every text.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table
    gives no rows; other columns play no part.
    """
    return by_word_table(docs, path, with_ids=False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded_sha256: ids and the digest of what they decode to."""
    return by_word_table(docs, path, with_ids=True)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), one row per input row.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table
    gives no rows; other columns play no part.
    """
    return round_trip(docs, path).drop("decoded_sha256")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids of whole texts, by a join of every id with its piece.

    Null and empty ids give an empty text; ids that spell no whole character give the
    replacement sign; ids outside the vocabulary give nothing.
    """
    codec = Codec(spec_of(path))
    pieces = tokens.sparkSession.createDataFrame([(i, bytearray(piece)) for i, piece in enumerate(codec.pieces)], "id int, piece binary")  # as large as the vocabulary
    rows = cut(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").withColumn("_tag", F.monotonically_increasing_id()))
    at = rows.select("_tag", F.posexplode("ids").alias("pos", "id"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece"))))
    met = at.join(F.broadcast(pieces), "id").groupBy("_tag").agg(F.array_join(F.transform(in_order, lambda x: x["piece"]), "").alias("hex"))
    told = rows.drop("ids").join(met, "_tag", "left").select("doc_id", F.unhex("hex").alias("raw"))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "text": pa.array([(x or b"").decode("utf-8", errors="replace") for x in b["raw"].to_pylist()], pa.string())})

    return told.mapInArrow(spelled, "doc_id long, text string")
