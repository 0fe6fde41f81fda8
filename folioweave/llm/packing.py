"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each text is tokenized and gets an end id. Its full stretches of ``capacity`` ids are sequences of their own; the
rest of each text, under ``capacity`` ids, is one piece that is packed. Pieces are dealt to groups by a seeded hash
of their place in the input, so that no key, source or repeated text makes a group large, and each group packs its
pieces alone. Only pieces' lengths meet in a group; ids stay with their rows.

Defined cases: a null or empty text is its end id alone; repeated rows are packed one by one; a null key stays
null; an empty table gives an empty result; only key and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import materialize

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 20_000
#: Texts that are encoded together, in bytes, beside one Arrow batch.
RUN_BYTES = 4 << 20
#: The pattern of the word tokenizer's splitter, for texts without ``UNSURE`` characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: Texts with these go to the tokenizer whole; below U+0300, composition changes nothing and Arrow's lower case,
#: classes and white space agree with the tokenizer's.
UNSURE = r"[\x{1c}-\x{1f}\x{85}\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}\x{130}\x{300}-\x{10ffff}]"
PIECE_DDL = "key long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


class WordEncoder:
    """Encodes texts as the tokenizer does, remembering the ids of short stretches between white space; by the bounds on
    their number and length the memory stays under about 250 MB.

    The splitter drops white space and no word holds any, so a stretch's ids do not depend on its neighbours.
    Words that are new go to the tokenizer in one call, parted by a special token.
    """

    CACHE, CACHED_CHARS = 800_000, 48

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsure = "|".join([UNSURE, *special])
        self.words = re.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of stretches that are not remembered yet; short ones and their short words are remembered."""
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        parts = [self.words(s) for s in stretches]
        cache = self.cache
        new = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in cache]
        # The last id of a word is one that ends words, so the ids of the words can be told apart.
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts, raw, at, found = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes(), 0, {}
        for w, cut in zip(new, cuts, strict=True):
            found[w] = raw[at:cut]
            at = cut
        for s, p in zip(stretches, parts, strict=True):
            found[s] = b"".join(found[w] if w in found else cache[w] for w in p)
        cache.update((w, x) for w, x in found.items() if len(w) <= self.CACHED_CHARS)
        return found

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (strings, no nulls) as little-endian 32-bit numbers."""
        unsure = pc.match_substring_regex(texts, self.unsure).to_numpy(zero_copy_only=False)
        sure = texts.filter(pa.array(~unsure))
        split = pc.utf8_split_whitespace(pc.utf8_lower(sure))
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        ids_of = list(map(self.cache.get, known))
        if new := [w for w, x in zip(known, ids_of, strict=True) if x is None]:
            found = self.learn(new)
            ids_of = [found[w] if x is None else x for w, x in zip(known, ids_of, strict=True)]
        size = np.array([len(x) for x in ids_of], np.int64) // 4
        flat, start = np.frombuffer(b"".join(ids_of), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(start[which] - (ends - n), n) + np.arange(n.sum())].tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])].tolist()
        known_texts = iter([ids[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)])
        others = iter(texts.filter(pa.array(unsure)).to_pylist())
        return [np.array(self.tokenizer.encode(next(others), add_special_tokens=False).ids, "<u4").tobytes() if x else next(known_texts) for x in unsure]


#: By vocabulary, kept while a Python worker lives, as each task would else learn the frequent words anew.
ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(vocabulary: str) -> WordEncoder:
    if vocabulary not in ENCODERS:
        ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return ENCODERS[vocabulary]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches taken together until they have RUN_BYTES, as a word that recurs in a batch is looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= RUN_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The pieces of all texts: full stretches of ``capacity`` ids, then the rest. ``ids`` is null if not asked for."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(vocabulary), np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in runs(batches):
            rows, flat = [], []
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(pc.fill_null(batch.column(1), "")), strict=True):
                ids += end
                flat.append(ids)
                for a in range(0, len(ids), step):
                    part = ids[a : a + step]
                    rows.append((k, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 5]
            if with_ids:
                # Pieces follow each other as their ids do.
                values = pa.Array.from_buffers(pa.int32(), sum(map(len, flat)) // 4, [None, pa.py_buffer(b"".join(flat))])
                pieces_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2].to_numpy())]).astype(np.int32)), values)
            else:
                pieces_of = pa.nulls(len(rows), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, pieces_of], names=[x.split()[0] for x in PIECE_DDL.split(", ")])

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(pieces, PIECE_DDL)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. The tournament tree holds at each node the largest room of the bins below it,
    so the first bin with enough room is found by one walk from the root."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 11, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset), one per piece.

    ``group_pieces`` is the mean size of a group; the number of groups follows the number of pieces.
    """
    pieces = cut(docs, vocabulary, capacity, text, key, with_ids).withColumn("row", F.monotonically_increasing_id())
    return place(materialize(pieces, "pieces"), capacity, group_pieces, seed)


def place(pieces: DataFrame, capacity: int, group_pieces: int, seed: int) -> DataFrame:
    """``pieces`` (written, with ``row``) with their sequences and offsets. Ids, if there are any, meet their places by row."""
    full = F.col("length") == capacity
    groups = max(1, -(-pieces.where(~full).count() // group_pieces))
    rest = pieces.where(~full).withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups))).select("group", "row", "length")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        # Bins of group g get the ids below those of whole pieces, interleaved by group.
        return pd.DataFrame({"row": group["row"], "sequence_id": -1 - (bins * groups + group["group"].to_numpy()), "offset": offsets})

    columns = [c for c in pieces.columns if c != "row"]
    placed = rest.groupBy("group").applyInPandas(fill, "row long, sequence_id long, offset long").withColumnRenamed("row", "of")
    packed = pieces.where(~full).join(placed, F.col("row") == F.col("of"))
    alone = pieces.where(full).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    both = [x.select(*columns, "sequence_id", "offset") for x in (packed, alone)]
    return both[0].unionByName(both[1])
