"""Exact top-k by inner product over quantised vectors, with norm buckets.

All vectors are sorted by length and cut into global buckets, longest first, which are written. Each query meets the
longest bucket first; its k-th score there is its floor. A bucket whose longest vector times the query's length stays
under the floor holds nothing for the query, and as lengths only fall, a query needs a first stretch of the buckets, its
reach: (query, bucket) pairs beyond it are left out before anything is shuffled. Queries are cut into blocks by reach, so
a bucket travels only to blocks that reach it. Where a block meets a bucket, the bucket's candidates are taken in
smaller steps by length, and for each step and query the local cosine threshold theta = floor / (|q| longest) decides:
above 1 nothing is left; high thresholds use coordinate pruning (the best that the leading coordinates and the lengths
of the rests allow), low ones length pruning (|q| |c| >= floor); what is left is multiplied out exactly.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
vectors of another dimension than the query's are no candidates (empty vectors meet empty ones and score 0); a query's
own row is not its candidate, but other rows with its id are; repeated rows are candidates, and queries, one by one; ties go to the smaller id; an empty table gives an empty
result; other columns are not read. Every finite vector takes part: where a squared length is beyond 2**53, so that doubles may round,
scores are counted in whole numbers of any size. Ranks are exact then too; a score beyond 64 bits is given as null.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.session import materialize

SCALE = 64
#: Queries in a block and candidates in a bucket, on average. Blocks grow with the number of queries, up to MOST_BLOCK,
#: so that a bucket has COPIES copies at most until then; buckets grow so that there are MOST_BUCKETS at most.
QUERY_BLOCK, MOST_BLOCK, COPIES = 4096, 65_536, 512
CANDIDATE_BLOCK, MOST_BUCKETS = 16_384, 100_000
#: Candidates in a step and queries in a tile: the products that are held at once.
STEP, TILE = 512, 2048
#: Above this local cosine threshold, coordinate pruning is tried; at most this many leading coordinates are used.
COORDINATE_FROM, LEADING = 0.5, 16
#: Below this share of allowed pairs, they are multiplied one by one, else as a block.
SPARSE = 0.1
#: Products of vectors up to this squared length are exact in doubles, as are the sums on the way; up to the other in singles.
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, v, wide, row): whole numbers as doubles; or, beyond EXACT, the vector as it is. All by built-in functions."""
    raw = F.col(f"`{vector}`")
    plain = F.transform(raw, lambda x: x.cast("double"))
    # A bigint holds floors below 2**53 only as doubles do; larger doubles are whole.
    v = F.transform("plain", lambda x: F.when(F.abs(x * float(scale)) < EXACT, F.floor(x * float(scale)).cast("double")).otherwise(x * float(scale)))
    sound = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = vectors.where(sound & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), plain.alias("plain")).withColumn("v", v)
    fits = squares("v") <= EXACT
    return out.select("id", F.when(fits, F.col("v")).alias("v"), F.when(~fits, F.col("plain")).alias("wide"), F.monotonically_increasing_id().alias("row"))


def squares(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


class Best:
    """The best ``k`` of each of ``n`` queries so far, as flat arrays (query, score, id); ``floor`` is their k-th score."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.astype(float)
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[order][keep], ids[order][keep]
        last = place == self.k - 1
        np.maximum.at(self.floor, query[last], score[order][last])


def search_cell(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray) -> tuple[Best, int]:
    """The best ``k`` of the candidates by query, and the number of products that were computed.

    ``floor`` holds a score per query; candidates below it may be left out.
    """
    exact = c.astype(float), q.astype(float)
    norms, lengths = (np.sqrt((x * x).sum(axis=1)) for x in exact)
    single = max(norms.max(initial=0), lengths.max(initial=0)) ** 2 <= EXACT_SINGLE
    order = np.argsort(-norms, kind="stable")
    c, q = (x.astype(np.float32) if single else x for x in exact)
    c, crow, cid, norms = c[order], crow[order], cid[order], norms[order]
    # Coordinates by weight over all candidates, so that the leading ones hold most of the lengths.
    leading = np.argsort(-(exact[0] ** 2).sum(axis=0), kind="stable")[: min(LEADING, c.shape[1] // 2)]
    rest = lambda x, n: np.sqrt(np.maximum(0, n**2 - (x[:, leading].astype(float) ** 2).sum(axis=1)))
    rest_q, rest_c = rest(q, lengths), rest(c, norms)
    best, products = Best(floor, k), 0
    for first in range(0, len(q), TILE):
        tile = np.arange(first, min(first + TILE, len(q)))
        for at in range(0, len(c), STEP):
            step = slice(at, min(at + STEP, len(c)))
            longest = norms[at]
            live = tile[lengths[tile] * longest * (1 + 1e-9) >= best.floor[tile]]
            if not len(live):
                continue
            reach = lengths[live] * longest
            theta = np.divide(best.floor[live], reach, out=np.full(len(live), -np.inf), where=reach > 0)
            by_coordinate = (theta >= COORDINATE_FROM) & bool(len(leading))
            for rows, coordinate in ((live[by_coordinate], True), (live[~by_coordinate], False)):
                if not len(rows):
                    continue
                if coordinate:
                    upper = q[np.ix_(rows, leading)].astype(float) @ c[step][:, leading].astype(float).T + np.outer(rest_q[rows], rest_c[step])
                    allowed = upper + 1e-9 * np.outer(lengths[rows], norms[step]) >= best.floor[rows, None]
                else:
                    allowed = np.outer(lengths[rows], norms[step]) * (1 + 1e-9) >= best.floor[rows, None]
                if allowed.mean() < SPARSE:
                    i, j = np.nonzero(allowed)
                    products += len(i)
                    scores = np.einsum("ij,ij->i", q[rows[i]], c[at + j]).astype(float)
                    hit = (scores >= best.floor[rows[i]]) & (qrow[rows[i]] != crow[at + j])
                    i, j, scores = i[hit], j[hit], scores[hit]
                else:
                    some = np.flatnonzero(allowed.any(axis=0))
                    products += len(rows) * len(some)
                    block = (q[rows] @ c[at + some].T).astype(float)
                    block[~allowed[:, some] | (qrow[rows, None] == crow[at + some][None, :])] = -np.inf
                    enough = best.floor[rows]
                    if block.shape[1] > k:
                        # Scores under the k-th of the block cannot be among the best; equal ones stay for the ids to decide.
                        enough = np.maximum(enough, np.partition(block, block.shape[1] - k, axis=1)[:, block.shape[1] - k])
                    i, j = np.nonzero((block >= enough[:, None]) & np.isfinite(block))
                    scores, j = block[i, j], some[j]
                best.add(rows[i], scores, cid[at + j])
    return best, products


def whole(x: float, scale: int) -> int:
    """The floor of ``scale * x``, also where the product is no double."""
    y = float(scale) * x
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def estimates(vectors: np.ndarray, scale: int) -> np.ndarray:
    """The quantised vectors as doubles, all divided by one power of two that takes them to about 1 at most."""
    with np.errstate(over="ignore"):
        y = vectors * float(scale)
    top = int(np.frexp(max(1.0, np.abs(vectors).max()))[1]) + scale.bit_length()
    return np.where(np.isfinite(y), np.ldexp(np.floor(y), -top), np.ldexp(vectors, -top) * float(scale))


def search_wide(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, scale: int) -> list[tuple[int, int, int]]:
    """As ``search_cell``, for plain vectors of any finite size, with scores in whole numbers.

    Scores in doubles with a bound of their error leave out what cannot be among the best ``k``; the rest is counted.
    """
    out, ints, width = [], {}, c.shape[1]
    near_c, counted = estimates(c, scale), lambda v: [whole(x, scale) for x in v.tolist()]
    largest = np.abs(near_c).max(axis=1)
    for i, v in enumerate(q):
        near = estimates(v[None, :], scale)[0]
        score = near_c @ near
        slack = (width + 8) * 2.0**-51 * width * largest * np.abs(near).max() + width * 2.0**-1000
        other = np.flatnonzero(crow != qrow[i])
        low = score[other] - slack[other]
        floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -math.inf
        own, seen, best = counted(v), {}, []
        for j in other[score[other] + slack[other] >= floor].tolist():
            copy = c[j].tobytes()
            if copy not in seen:
                if copy not in ints:
                    ints[copy] = counted(c[j])
                seen[copy] = sum(a * b for a, b in zip(own, ints[copy], strict=True))
            best.append((-seen[copy], int(cid[j])))
        out += [(i, j, -s) for s, j in heapq.nsmallest(k, best)]
    return out


def beyond(score: int) -> str | None:
    """A text for a score beyond 64 bits whose order is that of the numbers of the same sign; null for others."""
    if -(2**63) <= score < 2**63:
        return None
    digits = f"{abs(score):x}"
    text = f"{len(digits):08x}{digits}"
    return text if score > 0 else text.translate(str.maketrans("0123456789abcdef", "fedcba9876543210"))


def plain(v: pd.Series, wide: pd.Series, scale: int) -> np.ndarray:
    """Vectors as they were; half a step is added to quantised ones, so that the floor gives the same whole number again."""
    return np.stack([np.asarray(w) if w is not None else (np.asarray(x) + 0.5) / scale for x, w in zip(v, wide, strict=True)])


def anew(df: DataFrame, *columns: str) -> DataFrame:
    """Columns under new attributes: both sides of a cogroup come from one table, and unions of such lose columns otherwise."""
    return df.select(*(F.col(c).alias(c) for c in columns))


def stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list())


FOUND = "row long, query_id long, vec_id long, score long, sign int, beyond string, products long"


def frame(row: np.ndarray, query_id: np.ndarray, vec_id: np.ndarray, scores: list | np.ndarray, products: int) -> pd.DataFrame:
    """Found rows, and one row without a query that holds the number of products."""
    n = len(row)
    if isinstance(scores, np.ndarray):
        score, sign, far = pd.array(scores.astype(np.int64), "Int64"), np.zeros(n, np.int32), [None] * n
    else:
        far = list(map(beyond, scores))
        score = pd.array([s if f is None else None for s, f in zip(scores, far, strict=True)], "Int64")
        sign = np.array([0 if f is None else 1 if s > 0 else -1 for s, f in zip(scores, far, strict=True)], np.int32)
    out = pd.DataFrame({"row": pd.array(row, "Int64"), "query_id": pd.array(query_id, "Int64"), "vec_id": pd.array(vec_id, "Int64"), "score": score, "sign": sign, "beyond": pd.Series(far, dtype=object), "products": pd.array([None] * n, "Int64")})
    count = pd.DataFrame({"row": pd.array([None], "Int64"), "query_id": pd.array([None], "Int64"), "vec_id": pd.array([None], "Int64"), "score": pd.array([None], "Int64"), "sign": np.zeros(1, np.int32), "beyond": pd.Series([None], dtype=object), "products": pd.array([products], "Int64")})
    return pd.concat([out, count])


def cells(left: pd.DataFrame, right: pd.DataFrame, k: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Found rows of queries (id, row, v, floor) among candidates (id, row, v) of their own dimension, and the new floors."""
    floor = left["floor"].to_numpy().copy()
    parts, products = [], 0
    right_size = right["v"].map(len)
    for size, some in left.reset_index(drop=True).groupby(left["v"].map(len).to_numpy()):
        fit, at = right[right_size == size], some.index.to_numpy()
        if len(fit):
            best, n = search_cell(some["row"].to_numpy(), stack(some["v"]), fit["row"].to_numpy(), fit["id"].to_numpy(), stack(fit["v"]), k, floor[at])
            floor[at] = best.floor
            products += n
            parts.append((some["row"].to_numpy()[best.query], some["id"].to_numpy()[best.query], best.id, best.score))
    found = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
    return frame(*found, products), floor


def wide_cells(queries: DataFrame, candidates: DataFrame, k: int, scale: int, blocks: tuple[int, int]) -> DataFrame:
    """All queries against all candidates in whole numbers, in the cells of a grid; for the vectors beyond EXACT alone."""
    across, down = blocks
    deal = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(left) or not len(right):
            return frame(*[np.empty(0, np.int64)] * 3, [], 0)
        for t in (left, right):
            t["size"] = t["v"].where(t["wide"].isna(), t["wide"]).map(len)
        for size, some in left.groupby("size"):
            fit = right[right["size"] == size]
            if len(fit):
                found = search_wide(some["row"].to_numpy(), plain(some["v"], some["wide"], scale), fit["row"].to_numpy(), fit["id"].to_numpy(), plain(fit["v"], fit["wide"], scale), k, scale)
                i, ids, scores = map(list, zip(*found, strict=True)) if found else ([], [], [])
                out.append(frame(some["row"].to_numpy()[i], some["id"].to_numpy()[i], np.array(ids, np.int64), scores, len(some) * len(fit)))
        return pd.concat(out) if out else frame(*[np.empty(0, np.int64)] * 3, [], 0)

    left = anew(queries, "id", "row", "v", "wide").select(deal(across, 1).alias("qb"), every(down).alias("cb"), "*")
    right = anew(candidates, "id", "row", "v", "wide").select(every(across).alias("qb"), deal(down, 2).alias("cb"), "*")
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, FOUND)


def found_rows(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """All rows that the searches of the cells found, by FOUND; those without ``row`` hold numbers of products."""
    rows = materialize(quantised(vectors, key, vector, scale).withColumn("length", F.sqrt(squares("v"))), "quantised")
    asks, near, wide = F.coalesce(is_query, F.lit(False)), F.col("v").isNotNull(), F.col("wide").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    n, m, n_wide, m_wide, most = rows.agg(count(near), count(near & asks), count(wide), count(wide & asks), F.max(largest)).first()
    out = []
    if n and m:
        # The smallest type that holds all components travels.
        kind = next((t for t, top in (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)) if (most or 0) < top), "double")
        out.append(search(rows.where(near).select("id", "row", F.col("v").cast(f"array<{kind}>").alias("v"), "length"), asks, m, k, query_block, candidate_block))
    if n_wide:
        grid = lambda asked, met: (max(1, -(-asked // query_block)), max(1, -(-met // candidate_block)))
        out.append(wide_cells(rows.where(near & asks), rows.where(wide), k, scale, grid(m, n_wide)))
        out.append(wide_cells(rows.where(wide & asks), rows, k, scale, grid(m_wide, n + n_wide)))
    if not out:
        return rows.sparkSession.createDataFrame([], FOUND)
    all_found = out[0]
    for more in out[1:]:
        all_found = all_found.unionByName(more)
    return all_found


def ranges(rows: DataFrame, order: list[Column], size: int, most: int, value: str, name: str) -> tuple[DataFrame, list[float]]:
    """``rows``, written, with the ``place`` of each in a row of ranges of about ``size`` rows by ``order``, ``most`` at most,
    and the largest ``value`` of each range. Spark's partitions are the ranges, small neighbours taken together."""
    total = rows.count()
    parted = materialize(rows.repartitionByRange(max(1, min(most, -(-total // size))), *order).withColumn("part", F.spark_partition_id()), name)
    places, tops, held, size = [], [], size, max(size, -(-total // most))
    # Three numbers by partition.
    for part, n, top in sorted(map(tuple, parted.groupBy("part").agg(F.count(F.lit(1)), F.max(value)).collect())):
        if 2 * held >= size:
            held = 0
            tops.append(top)
        held += n
        tops[-1] = max(tops[-1], top)
        places.append((part, len(tops) - 1))
    numbers = rows.sparkSession.createDataFrame(places, "of int, place int")
    return parted.join(F.broadcast(numbers), F.col("part") == F.col("of")).drop("part", "of"), tops


def search(rows: DataFrame, asks: Column, m: int, k: int, query_block: int, candidate_block: int) -> DataFrame:
    """The found rows of ``m`` queries among vectors (id, row, v, length); ``rows`` is written."""
    buckets, tops = ranges(rows, [F.desc("length"), F.xxhash64("row")], candidate_block, MOST_BUCKETS, "length", "buckets")
    later = np.array(tops[1:])
    block = min(MOST_BLOCK, max(query_block, -(-m // COPIES)))
    seeds = -(-m // block)

    def first_meeting(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({x: pd.Series(dtype=object) for x in ("id", "row", "v", "length", "floor", "reach", "hits", "products")})
        left = left.assign(floor=-np.inf)
        found, floor = cells(left, right, k)
        hits = found.dropna(subset="row")
        by_row = {r: list(zip(h["vec_id"].tolist(), h["score"].tolist(), strict=True)) for r, h in hits.groupby("row")}
        # Lengths fall from bucket to bucket, so those that may hold more are a first stretch.
        reach = np.searchsorted(-later, -np.divide(floor / (1 + 1e-9), left["length"], out=np.where(floor > 0, np.inf, -np.inf), where=left["length"].to_numpy() > 0), side="right")
        products = [int(found["products"].dropna().sum())] + [0] * (len(left) - 1)
        return left.assign(floor=floor, reach=reach, hits=[[{"vec_id": a, "score": b} for a, b in by_row.get(r, [])] for r in left["row"]], products=products)[["id", "row", "v", "length", "floor", "reach", "hits", "products"]]

    v = dict(rows.dtypes)["v"]
    queries = buckets.where(asks).withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(seeds)).cast("int")).select("qb", "id", "row", "v", "length")
    longest = anew(buckets.where("place = 0"), "id", "row", "v").select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("qb"), "*")
    met = materialize(queries.groupBy("qb").cogroup(longest.groupBy("qb")).applyInPandas(first_meeting, f"id long, row long, v {v}, length double, floor double, reach int, hits array<struct<vec_id:long,score:long>>, products long"), "first-meetings")
    hit = met.select("row", F.col("id").alias("query_id"), F.explode("hits").alias("hit")).select("row", "query_id", "hit.vec_id", "hit.score")
    nothing = lambda t: F.lit(None).cast(t)
    found = hit.select("row", "query_id", "vec_id", "score", F.lit(0).alias("sign"), nothing("string").alias("beyond"), nothing("long").alias("products"))
    found = found.unionByName(met.where("products > 0").select(*(nothing("long").alias(c) for c in ("row", "query_id", "vec_id", "score")), F.lit(0).alias("sign"), nothing("string").alias("beyond"), "products"))
    asked, reaches = ranges(met.where("reach > 0").select("id", "row", "v", "floor", "reach"), [F.desc("reach"), F.xxhash64("row")], block, MOST_BUCKETS, "reach", "asked")
    if not reaches:
        return found
    # Blocks are in order of falling reach, so a bucket is met by a first stretch of them.
    meets = [(i, int(np.searchsorted(-np.array(reaches), -i, side="right")) - 1) for i in range(1, len(tops))]
    meets = rows.sparkSession.createDataFrame([x for x in meets if x[1] >= 0], "of int, last int")
    left = asked.select(F.col("place").alias("qb"), F.explode(F.sequence(F.lit(1), "reach")).alias("cb"), "id", "row", "v", "floor")
    right = buckets.join(F.broadcast(meets), F.col("place") == F.col("of")).select(F.explode(F.sequence(F.lit(0), "last")).alias("qb"), F.col("place").alias("cb"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("v").alias("v"))

    def meeting(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return cells(left, right, k)[0] if len(left) and len(right) else frame(*[np.empty(0, np.int64)] * 3, [], 0)

    return found.unionByName(left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meeting, FOUND))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score). ``is_query`` is a condition on the column ``id``.

    Where lengths differ little and nothing can be pruned, this is the work of an exact search without an index: each
    bucket travels to all blocks of queries, at most COPIES of them up to COPIES * MOST_BLOCK queries.
    """
    found = found_rows(vectors, is_query, k, key, vector, scale, query_block, candidate_block).where(F.col("row").isNotNull())
    order = Window.partitionBy("row").orderBy(F.desc("sign"), F.desc("beyond"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
