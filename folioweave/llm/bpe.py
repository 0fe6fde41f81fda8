"""Byte-level BPE over a table of distinct words.

Spark tasks split the texts into words and number the distinct words of each block of texts. The distinct words of
all blocks are encoded once each and decoded through a join of ids with their pieces; both results go back to the
blocks by word and to the texts by position. Words recur, so what is shuffled grows with the blocks' distinct
words; the positions stay in files of the shared folder, at about a byte and a half a word.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens in a text become
their ids; repeated rows are encoded one by one; a null key stays null; an empty table gives an empty result; only
key and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.warc import file_system
from folioweave.session import materialize, scratch_path

#: The pattern of the byte-level pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the two libraries' character classes agree; texts with others are split by the tokenizer.
AGREED = "՗"
BLOCK_CHARS = 24_000_000
#: Words are dealt to parts, whose distinct words a task holds: one for so many bytes of text, but some for each shuffle
#: partition, and so many at most (at 100 TB a part has the distinct words of 6 GB of text that fall to it).
PART_BYTES, PARTS_A_PARTITION, MOST_PARTS = 32 << 20, 4, 16_384
#: Words of the texts that a task returns at a time.
RUN_WORDS = 500_000


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: printable Latin-1 stands for itself, the rest is moved up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


class Splitter:
    """Splits a text into the words that the tokenizer encodes one by one; their concatenation is the text."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.specials = special
        self.words = regex.compile(PATTERN).findall
        self.beyond = regex.compile(f"[^\\x00-{AGREED}]").search

    def plain(self, text: str) -> list[str]:
        if not self.beyond(text):
            return self.words(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not any(s in text for s in self.specials):
            return self.plain(text)
        parts = self.special.split(text)
        return [w for k, part in enumerate(parts) if part for w in ([part] if k % 2 else self.plain(part))]


def planes(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes, which compress better than whole numbers."""
    n = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(6).compress(n.T.tobytes())


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def strings(words: list[str]) -> tuple[bytes, bytes]:
    """Strings as packed lengths and packed bytes."""
    raw = [w.encode() for w in words]
    return planes(np.fromiter(map(len, raw), "<u4", len(raw))), zstandard.ZstdCompressor(3).compress(b"".join(raw))


def unstrings(lengths: bytes, data: bytes) -> list[str]:
    raw, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(unplanes(lengths).astype(np.int64)).tolist()
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def blocks(docs: DataFrame, folder: str, vocabulary: str, parts: int, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The distinct words of each block of texts, dealt to ``parts`` parts by a hash of the word: a row for each
    block and part that has words, with packed words and their slots.

    The positions of a block go to a file in the shared ``folder``, under a name of its own attempt that the block's
    rows carry. The rows are written, so that all of a block come from one attempt, whatever order a task that is run
    again sees its texts in. Each block holds the empty word too, so that blocks without words are not lost.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        index: dict[str, int] = {"": 0}
        keys, counts, slots, chars = [], [], [np.zeros(1, "<u4")], 0

        def close() -> pa.RecordBatch:
            old = np.concatenate(slots)
            by_use = np.argsort(-np.bincount(old, minlength=len(index)), kind="stable")
            rank = np.empty(len(index), "<u4")
            rank[by_use] = np.arange(len(index))
            row = {"keys": [keys], "counts": [planes(np.array(counts))], "slots": [planes(rank[old[1:]])]}
            pq.write_table(pa.table(row), f"{root}/{(block := uuid.uuid4().hex)}", filesystem=fs)
            words = list(index)
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), "<u4", len(words))
            order = np.lexsort((rank, part))
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                some = order[a:b]
                out.append((int(part[some[0]]), block, planes(np.diff(rank[some].astype(np.int64), prepend=0)), *strings([words[i] for i in some.tolist()])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "slots", "lengths", "words"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = splitter.split(t)
                for w in words:
                    if w not in index:
                        index[w] = len(index)
                slots.append(np.fromiter(map(index.__getitem__, words), "<u4", len(words)))
                keys.append(k)
                counts.append(len(words))
                chars += len(t or "")
                if chars >= block_chars:
                    yield close()
                    index, keys, counts, slots, chars = {"": 0}, [], [], [np.zeros(1, "<u4")], 0
        if keys:
            yield close()

    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialize(texts.mapInArrow(split, "part int, block string, slots binary, lengths binary, words binary"), "bpe-words")


def encoded_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (block, slots, counts, ids): all rows of a part meet in one task, which encodes each distinct word once.

    A task holds the distinct words of its parts, and one row at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        part, table = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, table = row["part"], {}
                known = unstrings(row["lengths"], row["words"])
                new = [w for w in known if w not in table]
                table.update(zip(new, (np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                ids = [table[w] for w in known]
                out.append((row["block"], row["slots"], planes(np.array([len(x) // 4 for x in ids])), planes(np.frombuffer(b"".join(ids), "<u4"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "slots", "counts", "ids"])

    return words.repartition("part").sortWithinPartitions("part").mapInArrow(encode, "block string, slots binary, counts binary, ids binary")


def piece_table(vocabulary: str) -> list[bytes]:
    """The bytes of each id; its size is the vocabulary's."""
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_file(vocabulary), byte_alphabet()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = piece.encode() if piece in special else bytes(map(alphabet.__getitem__, piece))
    return table


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (key, ids, decoded) of all texts. ``vocabulary`` is a tokenizer file that all executors can read.

    The words cross the network, packed, once by word, where each distinct one is encoded, and once by block. The ids of a block's distinct words are joined with the pieces of the vocabulary, a table of bounded
    size that each task holds.
    """
    folder = scratch_path(docs.sparkSession, "bpe-positions")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    parts = min(MOST_PARTS, max(-(-size // PART_BYTES), PARTS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    back = encoded_words(blocks(docs, folder, vocabulary, parts, text, key, block_chars), vocabulary)

    def assemble(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of: dict[int, bytes] = {}
        for batch in group:
            for block, slots, counts, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "slots", "counts", "ids")), strict=True):
                raw, ends = unplanes(ids).tobytes(), (4 * np.cumsum(unplanes(counts).astype(np.int64))).tolist()
                where = np.cumsum(unplanes(slots).astype(np.int64)).tolist()
                ids_of.update((s, raw[a:b]) for s, a, b in zip(where, [0, *ends], ends, strict=False))
        fs, root = file_system(folder)
        row = pq.read_table(f"{root}/{block}", filesystem=fs).to_pylist()[0]
        pieces = piece_table(vocabulary)
        length = np.array([len(ids_of[i]) // 4 for i in range(len(ids_of))], np.int64)
        flat, ends = np.frombuffer(b"".join(ids_of[i] for i in range(len(ids_of))), "<u4").astype(np.int32), np.cumsum(length)
        del ids_of
        each = flat.tolist()
        decoded_words = [b"".join([pieces[i] for i in each[e - n : e]]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
        del each
        slots, counts = unplanes(row["slots"]), unplanes(row["counts"]).astype(np.int64)
        bounds, keys = np.concatenate([[0], np.cumsum(counts)]), row["keys"]
        a = 0
        while a < len(keys):
            # Texts leave in runs of bounded size, each of one text at least.
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + RUN_WORDS, side="right")) - 1)
            which = slots[bounds[a] : bounds[b]]
            size = length[which]
            stops = np.cumsum(size)
            ids = flat[np.repeat(ends[which] - stops, size) + np.arange(size.sum())]
            at = bounds[a : b + 1] - bounds[a]
            offsets = np.concatenate([[0], stops])[at].astype(np.int32)
            words = [decoded_words[i] for i in which.tolist()]
            decoded = [b"".join(words[i:j]).decode("utf-8", "replace") for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], names=["key", "ids", "decoded"])
            a = b

    return back.groupBy("block").applyInArrow(assemble, "key long, ids array<int>, decoded string")
