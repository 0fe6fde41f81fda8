"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distances, components.

A 64-bit fingerprint is split into six blocks. Two fingerprints that differ in three bits at most agree in three
blocks at least, so they meet under one of the twenty choices of three blocks. Distinct fingerprints are dealt and
sorted by (choice, blocks); a task walks each run of equal keys and links its members by a search that compares a
member only with those not yet reached, which yields the links of a spanning forest and never all pairs of a run.
Long runs are split by the same argument: of the six halves of the blocks outside the choice, a pair within three bits
agrees in three, so it meets under one of twenty choices of halves, and such a part has 65,536 members at most.
Links become components by rounds of large-star and small-star; copies share one fingerprint and meet no join.

Defined cases: a null or empty text, or one of separators only, has fingerprint zero; repeated rows and ids are
kept; a component's id is its smallest non-null id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import fresh, materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHOICES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
#: Runs of more fingerprints are split.
LONG_RUN = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, unsigned."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([signed(fingerprint(t)) for t in batch], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long."""
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.col(f"`{text}`")))


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``distance`` connect among distinct fingerprints."""
    left, links = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= distance
            if near.any():
                for y in left[near].tolist():
                    links.append((x, y))
                    queue.append(y)
                left = left[~near]
    return links


def block_keys(fps: DataFrame) -> DataFrame:
    """Rows (choice, key, fp): each distinct fingerprint under each choice of blocks, all by built-in functions."""
    block = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = []
    for k, choice in enumerate(CHOICES):
        key = F.lit(k).cast("long")
        for b in choice:
            key = F.shiftleft(key, BLOCKS[b][1]).bitwiseOR(block[b])
        keys.append(key)
    return fps.select("fp", F.posexplode(F.array(*keys)).alias("choice", "key"))


def half_masks(choice: tuple[int, ...]) -> list[int]:
    """The bits of each choice of three halves of the blocks outside ``choice``, signed."""
    halves = [h for b, (at, width) in enumerate(BLOCKS) if b not in choice for h in ((at, width // 2), (at + width // 2, width - width // 2))]
    return [signed(sum(((1 << width) - 1) << at for at, width in some)) for some in combinations(halves, len(halves) - DISTANCE)]


def split_runs(keys: DataFrame, long_run: int) -> DataFrame:
    """``keys`` with new keys for the members of runs longer than ``long_run``: one by each choice of halves."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_run)
    long = materialize(sizes.select(F.col("key").alias("of")), "long-runs")
    if long.isEmpty():
        return keys
    masks = F.array(*(F.array(*(F.lit(m) for m in half_masks(c))) for c in CHOICES))
    members = keys.join(long, F.col("key") == F.col("of"), "left_semi").select("fp", "key", F.explode(masks[F.col("choice")]).alias("mask"))
    # Where two hashes are equal, parts are walked together; links are verified all the same.
    parts = members.select("fp", F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    return keys.join(long, F.col("key") == F.col("of"), "left_anti").select("fp", "key").unionByName(parts)


def links(fps: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Rows (a, b) of distinct fingerprints that connect all pairs within the distance. ``fps`` has distinct ``fp``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            found = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                run = np.unique(fp[a:b])
                found += [(run[x], run[y]) for x, y in forest(run.view(np.uint64))]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            first, last = held[0][0][0], held[-1][0][-1]
            # Batches are held until a run ends, and the last, open run is carried on.
            if first == last or sum(len(k) for k, _ in held) < 50_000:
                continue
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, last))
            yield close(key[:cut], fp[:cut])
            held = [(key[cut:], fp[cut:])]
        if held:
            yield close(*(np.concatenate(x) for x in zip(*held, strict=True)))

    keys = split_runs(block_keys(fps), long_run).select("key", "fp").repartition("key").sortWithinPartitions("key")
    return keys.mapInArrow(walk, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for all nodes of ``edges`` (a, b), root being the smallest node reachable.

    Large-star and small-star in turn until nothing changes; each round is written, so no lineage grows. Minima
    combine before the shuffle, and the joins are equi-joins that Spark can split at a hub.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def group(marked: DataFrame, key: str, fp: str = "fp", name: str = "component_id") -> DataFrame:
    """``marked`` (written rows with fingerprints) with the smallest ``key`` of each row's component."""
    firsts = materialize(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(f"`{key}`")).alias("first")), "fingerprints")
    roots = materialize(components(links(firsts.select("fp"))), "roots")
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), "first")
    # Only fingerprints with links need the smallest key of their component; others have their own.
    linked = rooted.join(roots.select(F.col("root").alias("has_links")).distinct(), F.col("root") == F.col("has_links"), "left_semi")
    least = linked.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("least"))
    ids = rooted.join(least, F.col("root") == F.col("of"), "left").select("_fp", F.when(F.col("of").isNull(), F.col("first")).otherwise(F.col("least")).alias("_component"))
    return marked.join(ids, F.col(fp) == F.col("_fp")).select(*(F.col(f"`{c}`") for c in marked.columns), F.col("_component").alias(name))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, fingerprint, component_id), one per row of ``docs``; the key keeps its name and type."""
    marked = materialize(with_fingerprint(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")), "_text").drop("_text"), "marked")
    found = group(marked, key)
    return found.select(F.col(f"`{key}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component: that with the smallest key, of repeated rows or rows without a key the first by place in the input."""
    place, fp, comp = fresh(docs, "place"), fresh(docs, "fp"), fresh(docs, "component")
    marked = materialize(with_fingerprint(docs.withColumn(place, F.monotonically_increasing_id()), text, fp), "marked")
    slim = marked.select(F.col(place), F.col(f"`{key}`").alias("_key"), F.col(fp))
    # Places are never null, so components of rows without a key stay apart.
    rows = group(slim, place, fp, comp)
    chosen = rows.groupBy(comp).agg(F.min(F.struct(F.col("_key").isNull(), "_key", F.col(place).alias("place")))["place"].alias("_kept"))
    return marked.join(chosen.select("_kept"), F.col(place) == F.col("_kept"), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
