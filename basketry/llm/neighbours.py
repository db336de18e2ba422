"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each vector is stored once, with its nearest axis in every table. A task holds a block of rows and a block of queries,
marks for each query the rows that share one of its probed axes in any table, each once, and scores what is marked. How many
axes a query probes is worked out beforehand: the fewest that find the wanted share of the true neighbours of a sample of
queries, which are compared with all rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import column, in_blocks
from basketry.session import durable

K = 20
TABLES = 16
ROTATIONS = 3
SEED = 7
# The share of true neighbours that the probes find for the sample, and the queries in the sample for each length of vector.
RECALL = 0.95
SAMPLE = 100
# Rows that a task holds, and queries that it looks up, about.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
# Rows whose lengths differ by less than this factor are scaled by one length.
BAND = 1.25
_STEP = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        out = np.empty_like(pairs)
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 0])
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 1])
        x = out.reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n).astype(x.dtype)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """A pseudo-rotation of each row: random signs, then a Hadamard transform, three times over."""
    signs = np.random.RandomState(seed * 1000 + table).choice([-1.0, 1.0], (ROTATIONS, x.shape[1])).astype(x.dtype)
    for s in signs:
        x = hadamard(x * s)
    return x


def signed(turned: np.ndarray) -> np.ndarray:
    """How near each row is to each signed axis: 2 * axis + (1 if negative)."""
    return np.stack([turned, -turned], axis=2).reshape(len(turned), -1)


def axes(x: np.ndarray, table: int, probes: int, seed: int = SEED) -> np.ndarray:
    """The `probes` nearest signed axes of each row after the table's rotation, nearest first."""
    near = signed(rotated(x, table, seed))
    if probes == 1:
        return near.argmax(axis=1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :probes]


def lifted(vectors: np.ndarray, largest: np.ndarray, as_query: bool) -> np.ndarray:
    """Unit vectors whose angles order rows as their inner products with the query do, padded to a power of two.

    A row is scaled by the largest length of its band and gets one more component that makes its length 1; a query gets 0 there.
    """
    n, dim = vectors.shape
    out = np.zeros((n, 1 << dim.bit_length()))
    if as_query:
        # By the largest component first, so that no square overflows.
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        out[:, :dim] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    else:
        out[:, :dim] = vectors / largest[:, None]
        out[:, dim] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, :dim] ** 2).sum(axis=1)))
    return out


def _coded(tables: int, seed: int):
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The nearest axis of each row in each table."""
        for vectors, largest in batches:
            out: list = [None] * len(vectors)
            sizes = vectors.str.len().to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for start in range(0, len(at), 1024):
                    some = at[start : start + 1024]
                    unit = lifted(np.stack(vectors.iloc[some].to_list()), largest.iloc[some].to_numpy(), False).astype(np.float32)
                    found = np.stack([axes(unit, t, 1, seed)[:, 0] for t in range(tables)], axis=1)
                    for i, row in zip(some, found.astype(np.int32)):
                        out[i] = row
            yield pd.Series(out)

    return F.pandas_udf(of, "array<int>")


def _ranks(wanted: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """query x table x signed axis: which probe it is, from 0."""
    unit = lifted(wanted, np.ones(len(wanted)), True).astype(np.float32)
    out = np.empty((len(unit), tables, 2 * unit.shape[1]), np.int32)
    for t in range(tables):
        order = np.argsort(-signed(rotated(unit, t, seed)), axis=1, kind="stable")
        np.put_along_axis(out[:, t], order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int32), order.shape), axis=1)
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _true(k: int, tables: int, seed: int):
    def true(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Each query's first k rows of the block, all compared, and at which probe each is met."""
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "rep": [], "score": [], "probe": []})
        rows = rows.sort_values("rep")
        held, codes, wanted = _matrix(rows["vector"]), _matrix(rows["codes"]), _matrix(queries["vector"])
        query, row = _top(wanted @ held.T, k)
        ranks = _ranks(wanted, tables, seed)
        probe = ranks[query[:, None], np.arange(tables)[None, :], codes[row]].min(axis=1)
        score = (held[row] * wanted[query]).sum(axis=1)
        return pd.DataFrame({"query": queries["query"].to_numpy()[query], "rep": rows["rep"].to_numpy()[row], "score": score, "probe": probe})

    return true


def _top(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, and of all that equal the last of them but for rounding."""
    n = near.shape[1]
    if n <= k:
        return np.nonzero(np.ones_like(near, bool))
    least = np.partition(near, n - k, axis=1)[:, n - k]
    return np.nonzero(near >= (least - 1e-9 * (1 + np.abs(least)))[:, None])


def _best(k: int, tables: int, seed: int):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Each query's best k of the rows that share a probed axis with it."""
        names = ["query", "rep", "score"]
        if not len(queries) or not len(rows):
            return pd.DataFrame({n: [] for n in names})
        rows = rows.sort_values("rep")
        ids, held, codes = rows["rep"].to_numpy(), _matrix(rows["vector"]), _matrix(rows["codes"])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for start in range(0, len(queries), _STEP):
            some = queries.iloc[start : start + _STEP]
            wanted, probes = _matrix(some["vector"]), some["probes"].to_numpy()
            looks = _ranks(wanted, tables, seed) < probes[:, None, None]
            marked = np.zeros((len(some), len(ids)), bool)
            for t in range(tables):
                marked |= looks[:, t, codes[:, t]]
            for i, asked in enumerate(some["query"].to_numpy()):
                at = np.flatnonzero(marked[i])
                if not len(at):
                    continue
                near = held[at] @ wanted[i]
                first = at[_top(near[None, :], k)[1]]
                # Summed in one fixed order, so that a pair scores the same wherever it is met.
                score = (held[first] * wanted[i]).sum(axis=1)
                order = np.lexsort((ids[first], -score))[:k]
                out.append((np.full(len(order), asked), ids[first[order]], score[order]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    return best


def index(vectors: DataFrame, id_col: str, vector_col: str, k: int, tables: int, band: float) -> DataFrame:
    """(dim, rep, vector, codes, members, n): each distinct vector once, as its smallest id, with its axis in each table and the
    smallest k + 1 ids that have it."""
    place = W.partitionBy("vector").orderBy("id")
    rows = cleaned(vectors, id_col, vector_col).withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1)
    grouped = rows.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # The middle of a band, not its edge, is at length 1, where scaled vectors are.
    steps = F.log(F.greatest(F.lit(sys.float_info.min), F.least(F.col("norm"), F.lit(sys.float_info.max)))) / math.log(band)
    distinct = grouped.select(F.get("members", F.lit(0)).alias("rep"), F.size("vector").alias("dim"), "vector", "members", norm.alias("norm"))
    distinct = durable(distinct.withColumn("band", F.floor(steps + 0.5)))
    bands = distinct.groupBy("dim", "band").agg((F.max("norm") * (1 + 1e-9)).alias("largest"))
    coded = distinct.join(durable(bands), ["dim", "band"]).withColumn("codes", _coded(tables, SEED)("vector", "largest"))
    return coded.select("dim", "rep", "vector", "codes", "members", F.size("members").cast("bigint").alias("n"))


def cleaned(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part; of rows with the same id the smallest vector."""
    held = df.select(column(id_col).cast("bigint").alias("id"), column(vector_col).cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.size("vector") > 0) & usable & F.exists("vector", lambda x: x != 0)
    held = held.filter(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    # Adding 0.0 makes -0.0 equal to 0.0, so that equal vectors are equal as keys.
    return held.select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))


def probes_for(
    asked: DataFrame, rows: DataFrame, k: int, tables: int, recall: float, sample: int, block_rows: int, seed: int = SEED
) -> DataFrame:
    """(dim, probes, measured): for each length of vector the fewest probes that find the share `recall` of the true first k
    rows of `sample` queries, chosen by hash and compared with all rows; and the share that these find."""
    order = W.partitionBy("dim").orderBy(F.xxhash64("query"), "query")
    chosen = durable(asked.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sample).drop("nth"))
    left, right = in_blocks(chosen, rows.select("dim", "rep", "vector", "codes"), "dim", "query", "rep", sample, block_rows)
    kinds = "query bigint, rep bigint, score double, probe int"
    # A query that is a row itself is not its own neighbour.
    found = left.cogroup(right).applyInPandas(_true(k + 1, tables, seed), kinds).filter(F.col("query") != F.col("rep"))
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc("rep"))
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).join(chosen.select("query", "dim"), "query")
    # One row for each length and probe.
    steps = found.groupBy("dim", "probe").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("dim").orderBy("probe")
    steps = steps.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("dim")))
    reached = steps.filter(F.col("upto") >= recall * F.col("all")).groupBy("dim").agg(F.min(F.struct("probe", (F.col("upto") / F.col("all")).alias("share"))).alias("first"))
    return reached.select("dim", (F.col("first.probe") + 1).alias("probes"), F.col("first.share").alias("measured"))


def _asked(queries: DataFrame) -> DataFrame:
    """(dim, query, vector): equal queries once, as their smallest id."""
    return queries.groupBy("vector").agg(F.min("id").alias("query")).withColumn("dim", F.size("vector"))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    tables: int = TABLES,
    recall: float = RECALL,
    sample: int = SAMPLE,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
    band: float = BAND,
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows of the largest inner product found for each row of `queries`.

    A row is never its own neighbour (rows are told apart by id; of rows with the same id the one with the smallest vector
    takes part, among the queries too). Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids; vectors of another length than the query's are not compared. Where there are fewer rows than `k`, all are
    returned; ties go to the smaller id. Other columns are not read. An empty table gives an empty result.

    Every row is in every table, and a query compares all rows of its `probes` nearest axes there. Where `probes` is not
    given it is the fewest that find the share `recall` of the true neighbours of `sample` queries. Rows are scaled in bands
    of length (a factor of `band`), so that long vectors do not push short ones together. A query that met too few rows to
    fill its list is compared with all.

    Equal vectors are indexed once, as their smallest id. Of each, the smallest k + 1 ids can be among a query's k nearest,
    so these are kept as its members; equal queries are asked once. Of each task, k + 1 distinct vectors a query go on.
    """
    rows = durable(index(vectors, id_col, vector_col, k, tables, band))
    asking = durable(cleaned(queries, id_col, vector_col))
    asked = durable(_asked(asking))
    if probes is None:
        wanted = durable(probes_for(asked, rows, k, tables, recall, sample, block_rows)).select("dim", "probes")
    else:
        wanted = asked.select("dim", F.lit(probes).alias("probes")).distinct()
    held = rows.select("dim", "rep", "vector", "codes")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc("rep"))

    def met_by(looks: DataFrame) -> DataFrame:
        left, right = in_blocks(looks, held, "dim", "query", "rep", block_queries, block_rows)
        return left.cogroup(right).applyInPandas(_best(k + 1, tables, SEED), "query bigint, rep bigint, score double")

    def best_of(met: DataFrame) -> DataFrame:
        return met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")

    # Without probes of its own a length of vector has too few rows for a list; all are compared.
    every = F.lit(1 << 30)
    met = durable(met_by(asked.join(wanted, "dim", "left").withColumn("probes", F.coalesce("probes", every))))
    enough = met.join(rows.select("rep", "n"), "rep").groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") > k).select("query")
    short = durable(asked.join(enough, "query", "left_anti").withColumn("probes", every))
    all_met = met.join(short.select("query"), "query", "left_anti").union(met_by(short))
    found = durable(best_of(all_met).select(F.col("query").alias("asked"), "rep", "score"))
    members = found.join(rows.select("rep", "members"), "rep").select("asked", "score", F.explode("members").alias("vec_id"))
    # Equal queries have equal candidates; of k + 1, no more than the query itself falls away.
    best = W.partitionBy("asked").orderBy(F.desc("score"), F.asc("vec_id"))
    members = members.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")
    askers = asking.join(asked.select("vector", F.col("query").alias("asked")), "vector").select(F.col("id").alias("query_id"), "asked")
    out = durable(askers).join(durable(members), "asked").filter(F.col("query_id") != F.col("vec_id"))
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    out = out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
