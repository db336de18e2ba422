"""Top-k inner products between many queries and many items, exact or inside shared hash cells."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from basketry.operators import lists
from basketry.operators.skew import newest
from basketry.session import durable

# The most queries that a task holds, the most results that it keeps for them, and the items from which on they are dealt to
# lists. Items move once per block of queries, so blocks are as large as a task's memory allows.
QUERY_BLOCK = 131_072
RESULTS = 5_000_000
EXCLUDED = 20
ITEM_BLOCK = 8192
# Of given pairs: the most that a task holds, how many are worth a task, and how many are multiplied at once.
PAIR_BLOCK = 4_000_000
LEAST_PAIRS = 65_536
PAIR_CHUNK = 20_000
# Queries that are multiplied with a batch of items at once.
CHUNK = 256
# What a chunk has found is merged once it is this part of what it keeps.
MERGED_AT = 3
# Where the queries are few, they are still dealt to about as many tasks as run at once.
LEAST_QUERIES = 1024
SCORE_PLACES = 9
# Scores that round to the same are less than this apart.
SLACK = 2e-9
# Products are first worked out in single precision, which is off by less than this times both lengths, component for component,
# and only pairs that may be among the results again in double. Longer vectors than this are left to double alone.
SINGLE_ERROR = 2.0**-22
SINGLE_LENGTH = 1e12
# Of the hashed form: items per cell, about; tables; and the most bits a cell has.
ROWS_PER_CELL = 64
TABLES = 4
MAX_BITS = 16
PLANE_PLACES = 6


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors of unequal length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class Meeting:
    """Which items a query meets: all of them, those of its nearest lists, or those that share a hash cell."""

    centres: np.ndarray | None = None
    sizes: np.ndarray | None = None
    probes: int = 0
    sides: np.ndarray | None = None

    def of_queries(self, vectors: np.ndarray, fetch: np.ndarray, bits: int) -> np.ndarray | None:
        """Per query: a bit for every list that it searches, or its home cell in every table."""
        if self.centres is not None:
            order = lists.places(vectors, self.centres)[:, : self.probes]
            allowed = np.zeros((len(vectors), len(self.centres)), bool)
            np.put_along_axis(allowed, order, True, axis=1)
            # Too few there: all lists.
            allowed |= (self.sizes[order].sum(axis=1) < fetch)[:, None]
            return np.packbits(allowed, axis=1)
        if self.sides is not None:
            return _homes(vectors, self.sides, bits)
        return None

    def pairs(self, own: np.ndarray, homes: list, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of the hashed form, each pair once: items are found by their sorted cells."""
        steps = np.concatenate([[0], 1 << np.arange(bits)])
        found = []
        for t, (order, held) in enumerate(homes):
            near = (own[:, t, None] ^ steps).ravel()
            first, last = np.searchsorted(held, near, "left"), np.searchsorted(held, near, "right")
            times = last - first
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
            found.append(np.repeat(np.arange(len(near)) // len(steps), times) * n + order[at])
        both = np.unique(np.concatenate(found))
        return both // n, both % n


def _single(lengths: np.ndarray) -> bool:
    """Whether vectors of these lengths keep their products in single precision; a missing one has no products anyway."""
    return not (lengths > SINGLE_LENGTH).any()


def _once(key: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Where each key and id has its best score, in the order of the rows."""
    order = np.lexsort((-scores, ids, key))
    first = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])]
    return np.sort(order[first])


class _Block:
    """The queries of one task and the best items that they have met so far; items stream by."""

    def __init__(self, held: pa.Table, by: list[str], meeting: Meeting, carried: tuple[str, ...] = ()):
        self.meeting, self.keys = meeting, held.select([*by, *carried])
        self.vectors = _matrix(held["vector"])
        self.lengths = np.linalg.norm(self.vectors, axis=1)
        self.single = self.vectors.astype(np.float32) if _single(self.lengths) else None
        self.fetch = held["fetch"].to_numpy().astype(np.int64)
        self.bits = int(held["bits"][0].as_py())
        out = held["out"].combine_chunks()
        self.out_ids = out.flatten().to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(out), 0).to_numpy(zero_copy_only=False)
        self.out_rows = np.repeat(np.arange(held.num_rows), counts)
        code = np.zeros(held.num_rows, np.int64)
        for name in by:
            part = held[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            code = np.unique(code * (int(part.max()) + 1) + part, return_inverse=True)[1]
        self.code = code
        self.floor = np.full(held.num_rows, -np.inf)
        self.starts = range(0, held.num_rows, CHUNK)
        self.own = [meeting.of_queries(self.vectors[s : s + CHUNK], self.fetch[s : s + CHUNK], self.bits) for s in self.starts]
        nothing = np.zeros(0, np.int64)
        self.kept = [(nothing, nothing, np.zeros(0)) for _ in self.starts]
        # Found since the last merge.
        self.found = [[] for _ in self.starts]

    def meet(self, items: pa.Table) -> None:
        ids, m = items["article_id"].to_numpy().astype(np.int64), _matrix(items["held"])
        # No item of the batch scores above q.c + |q| r; nearby items come together.
        centre = m.mean(axis=0)
        bound = self.vectors @ centre + self.lengths * np.linalg.norm(m - centre, axis=1).max() + lists.MARGIN
        live = ~(bound < self.floor)
        lengths = np.linalg.norm(m, axis=1)
        single = m.astype(np.float32) if self.single is not None and _single(lengths) else None
        # How far a product in the precision used may be from the true one, times the length of the query.
        off = 0.0 if single is None else (m.shape[1] + 4) * SINGLE_ERROR * np.nanmax(lengths, initial=0.0)
        room = np.empty((CHUNK, len(ids)), np.float64 if single is None else np.float32)
        cells = homes = None
        if self.meeting.centres is not None:
            cells = items["cell"].to_numpy().astype(np.int64)
        if self.meeting.sides is not None:
            of_items = _homes(m, self.meeting.sides, self.bits)
            orders = [np.argsort(of_items[:, t], kind="stable") for t in range(of_items.shape[1])]
            homes = [(order, of_items[order, t]) for t, order in enumerate(orders)]
        for c, start in enumerate(self.starts):
            rows = start + np.flatnonzero(live[start : start + CHUNK])
            if not len(rows):
                continue
            if homes is not None:
                row, col = self.meeting.pairs(self.own[c][rows - start], homes, self.bits, len(ids))
            else:
                allowed = None if cells is None else np.unpackbits(self.own[c][rows - start], axis=1).astype(bool)
                if single is None:
                    scores = np.matmul(self.vectors[rows], m.T, out=room[: len(rows)])
                else:
                    scores = np.matmul(self.single[rows], single.T, out=room[: len(rows)])
                row, col = self._likely(rows, scores, off * self.lengths[rows], allowed, cells)
            found = np.einsum("ij,ij->i", self.vectors[rows[row]], m[col])
            floor = self.floor[rows[row]] - SLACK
            good = found >= (floor if homes is not None else np.maximum(floor, np.finfo(np.float64).min))
            row, col, found = row[good], col[good], found[good]
            if len(row):
                self.found[c].append((rows[row], ids[col], np.round(found, SCORE_PLACES)))
                # Sorting takes longer than some more products would that a newer floor leaves out.
                if MERGED_AT * sum(len(x[0]) for x in self.found[c]) >= len(self.kept[c][0]):
                    self._merge(c)

    def _likely(self, rows: np.ndarray, scores: np.ndarray, off: np.ndarray, allowed: np.ndarray | None, cells: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all that may be among the results, by products that are less than `off` from the true ones."""
        off = off + SLACK
        floor = np.maximum(self.floor[rows] - off, np.finfo(scores.dtype).min).astype(scores.dtype)
        # Rounded down, so that nothing is lost to the precision of the floor.
        with np.errstate(over="ignore"):
            mask = scores >= np.nextafter(floor, scores.dtype.type(-np.inf))[:, None]
        if np.count_nonzero(mask) > 2 * self.fetch[rows].sum():
            given = np.where(np.isnan(scores), -np.inf, scores) if allowed is None else np.where(allowed[:, cells] & mask, scores, -np.inf)
            most = min(int(self.fetch[rows].max()), scores.shape[1])
            last = np.partition(given, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
            mask &= given >= (last.astype(np.float64) - 2 * off)[:, None]
        # Far faster over one dimension than over two.
        row, col = np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])
        if allowed is not None:
            met = allowed[row, cells[col]]
            row, col = row[met], col[met]
        return row, col

    def _merge(self, c: int) -> None:
        row, ids, scores = (np.concatenate(x) for x in zip(self.kept[c], *self.found[c]))
        self.found[c] = []
        if self.meeting.sides is not None:
            once = _once(row, ids, scores)
            row, ids, scores = row[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.fetch[row]
        self.kept[c] = (row[keep], ids[keep], scores[keep])
        last = place == self.fetch[row] - 1
        self.floor[row[last]] = scores[last]

    def best(self, k: int) -> Iterator[pa.RecordBatch]:
        """The first k of each key, without what it excludes. Queries come by key, so those of one key are together."""
        open_ = None
        for c, start in enumerate(self.starts):
            self._merge(c)
            row, ids, scores = self.kept[c]
            a, b = np.searchsorted(self.out_rows, [start, start + CHUNK])
            if a < b and len(row):
                known, at = np.unique(np.concatenate([ids, self.out_ids[a:b]]), return_inverse=True)
                key = np.concatenate([row, self.out_rows[a:b]]) * len(known) + at
                fresh = ~np.isin(key[: len(row)], key[len(row) :])
                row, ids, scores = row[fresh], ids[fresh], scores[fresh]
            if open_ is not None:
                row, ids, scores = (np.concatenate(x) for x in zip(open_, (row, ids, scores)))
            if not len(row):
                continue
            if self.meeting.sides is not None:
                once = _once(self.code[row], ids, scores)
                row, ids, scores = row[once], ids[once], scores[once]
            run = np.cumsum(np.r_[True, self.code[row[1:]] != self.code[row[:-1]]])
            order = np.lexsort((ids, -scores, run))
            row, ids, scores = row[order], ids[order], scores[order]
            place = np.arange(len(run)) - np.searchsorted(run, run)
            keep = place < k
            row, ids, scores, place, run = row[keep], ids[keep], scores[keep], place[keep], run[keep]
            # The last key may go on in the next chunk.
            cut = len(run) if c == len(self.kept) - 1 else int(np.searchsorted(run, run[-1]))
            open_ = (row[cut:], ids[cut:], scores[cut:])
            yield self._rows(row[:cut], ids[:cut], scores[:cut], place[:cut])
        if open_ is not None and len(open_[0]):
            yield self._rows(*open_, np.arange(len(open_[0])))

    def _rows(self, row, ids, scores, place) -> pa.RecordBatch:
        table = self.keys.take(pa.array(row)).combine_chunks()
        columns = [c.combine_chunks() for c in table.columns] + [pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(place + 1, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*table.column_names, "article_id", "score", "rank"])


def united(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, for Arrow. What a part lacks is null, but empty in columns of arrays: for each row of a batch Spark's
    Arrow writer goes over all null arrays since the last one that is not null once more."""
    arrays = {f.name: f.dataType for p in parts for f in p.schema if isinstance(f.dataType, ArrayType)}
    filled = [p.withColumns({c: F.array().cast(t) for c, t in arrays.items() if c not in p.columns}) for p in parts]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), filled)


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each row that grows where the value changes."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[0, codes[1:] != codes[:-1]])


def _merged(batches: Iterator[pa.RecordBatch], size: int, weighed: bool) -> Iterator[pa.RecordBatch]:
    """The results of all queries of a list as one, a list after the other: the best score of each item, with the label of
    the first query that returned it, the first `size` of them. With `weighed` the score is times the query's weight, not
    rounded yet; items that may be among the first `size` once it is rounded stay."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        # The last list may go on in the next batch.
        run = _runs(rows[0])
        cut = int(np.searchsorted(run, run[-1]))
        held = rows.slice(cut)
        if cut:
            yield _merged_lists(rows.slice(0, cut), size, weighed)
    if held is not None:
        yield _merged_lists(held, size, weighed)


def _merged_lists(rows: pa.Table, size: int, weighed: bool) -> pa.RecordBatch:
    run, ids, scores = _runs(rows[0]), rows["article_id"].to_numpy(), rows["score"].to_numpy()
    if weighed:
        scores = scores * rows["weight"].to_numpy()
    order = np.lexsort((rows[1].to_numpy(), ids, run))
    starts = np.flatnonzero(np.r_[True, (run[order[1:]] != run[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])])
    best, first = np.maximum.reduceat(scores[order], starts), order[starts]
    again = np.lexsort((ids[first], -best, run[first]))
    best, first = best[again], first[again]
    lists_ = run[first]
    heads = np.searchsorted(lists_, lists_)
    place = np.arange(len(lists_)) - heads
    keep = place < size
    if weighed:
        last = np.minimum(heads + size, np.searchsorted(lists_, lists_, "right")) - 1
        keep = best >= best[last] - SLACK
    taken = rows.select([rows.column_names[0], "label"]).take(pa.array(first[keep])).combine_chunks()
    columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in taken.columns]
    return pa.RecordBatch.from_arrays(
        [columns[0], pa.array(ids[first[keep]], pa.int64()), pa.array(best[keep], pa.float64()), columns[1], pa.array(place[keep] + 1, pa.int32())],
        names=[rows.column_names[0], "article_id", "score", "label", "rank"],
    )


def _streamed(by: list[str], k: int, meeting: Meeting, carried: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch["_block"].to_numpy() * 2 + batch["_side"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if place[a] // 2 != at:
                    if block is not None:
                        yield from block.best(k)
                    at, held, block = place[a] // 2, [], None
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if not place[a] % 2:
                    held.append(part)
                    continue
                if held:
                    block, held = _Block(pa.concat_tables(held).combine_chunks(), by, meeting, carried), []
                if block is not None:
                    block.meet(part)
        if block is not None:
            yield from block.best(k)

    return run


def block_for(k: int) -> int:
    """How many queries a task holds where each asks for k results and has some items to leave out."""
    return max(1, min(QUERY_BLOCK, RESULTS // (k + EXCLUDED)))


def _grid(n_query: int, n_item: int, query_block: int, item_block: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of items. Each block of queries meets all items in one task, where they stream by; only where
    the queries are too few to keep all cores busy are items cut too."""
    queries = max(1, -(-n_query // query_block), min(tasks, -(-n_query // LEAST_QUERIES)))
    if queries > tasks:
        queries = -(-queries // tasks) * tasks
    items = max(1, min(-(-n_item // item_block), -(-tasks // queries)))
    return queries, items


def _search(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude: DataFrame | None,
    by: list[str],
    n_query: int,
    n_item: int,
    query_block: int | None = None,
    item_block: int = ITEM_BLOCK,
    meeting: Meeting = Meeting(),
    bits: Column | None = None,
    merge: tuple[int, bool] | None = None,
) -> DataFrame:
    """(by..., article_id, score, rank): the first k of what each query meets, without what it excludes.

    A query moves once, items once per block of queries, and of the results only the first k of each query leave a task.
    Items may have a `cell`; a block takes them in its order. With `merge` (size, weighed) see `top_k_merged`."""
    spark = queries.sparkSession
    n_qb, n_ib = _grid(n_query, n_item, query_block or block_for(k), item_block, spark.sparkContext.defaultParallelism)
    asked = _with_fetch(queries.filter(F.col("vector").isNotNull()), exclude, k, by)
    cell = F.col("cell") if "cell" in items.columns else F.lit(0)
    # All queries of a list go to one block where they are merged.
    qb = F.pmod(F.xxhash64(*(by if merge is None else by[:1])), F.lit(n_qb)).cast("int")
    carried = () if merge is None else ("label", "weight")
    left = asked.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_ib - 1)), lambda i: qb * n_ib + i)).alias("_block"),
        F.lit(0).alias("_side"),
        *by,
        *carried,
        F.col("vector").cast("array<double>").alias("vector"),
        "fetch",
        F.coalesce("out", F.array().cast("array<bigint>")).alias("out"),
        (F.lit(0) if bits is None else bits).cast("int").alias("bits"),
    )
    ib = F.pmod(F.xxhash64("article_id"), F.lit(n_ib)).cast("int")
    right = items.filter(F.col("vector").isNotNull()).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_qb - 1)), lambda q: q * n_ib + ib)).alias("_block"),
        F.lit(1).alias("_side"),
        F.col("article_id").cast("bigint").alias("article_id"),
        F.col("vector").alias("held"),
        cell.cast("int").alias("cell"),
    )
    rows = united(left, right)
    # The first key alone tells most rows apart, as one number.
    place = (F.col("_block") * 2 + F.col("_side")).cast("bigint") * 2**32 + F.coalesce("cell", F.lit(0))
    dealt = rows.repartitionById(n_qb * n_ib, F.col("_block")).sortWithinPartitions(place, *by)
    schema = StructType([queries.schema[c] for c in (*by, *carried)])
    schema = schema.add("article_id", LongType()).add("score", "double").add("rank", IntegerType())
    streamed = _streamed(by, k, meeting, carried)
    if merge is not None and n_ib == 1:
        size, weighed = merge
        out = StructType([queries.schema[by[0]], schema["article_id"], schema["score"], queries.schema["label"], schema["rank"]])
        return dealt.mapInArrow(lambda batches: _merged(streamed(batches), size, weighed), out)
    found = dealt.mapInArrow(streamed, schema)
    if n_ib == 1:
        return found
    return newest(found.drop("rank"), by, [F.desc("score"), F.asc("article_id")], k, "rank")


def _with_fetch(queries: DataFrame, exclude: DataFrame | None, k: int, by: list[str]) -> DataFrame:
    """Each query (with `out`, what it excludes) asks for k plus as many as it excludes, so dropping those still leaves k."""
    if "out" in queries.columns:
        return queries.withColumn("fetch", F.lit(k) + F.coalesce(F.size("out"), F.lit(0)))
    if exclude is None:
        return queries.withColumns({"out": F.lit(None).cast("array<bigint>"), "fetch": F.lit(k)})
    dropped = exclude.groupBy(*by).agg(F.collect_set(F.col("article_id").cast("bigint")).alias("out"))
    return queries.join(dropped, by, "left").withColumn("fetch", F.lit(k) + F.coalesce(F.size("out"), F.lit(0)))


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude: DataFrame | None = None,
    query_block: int | None = None,
    item_block: int = ITEM_BLOCK,
    by: tuple[str, ...] = ("query_id",),
    merge: tuple[int, bool] | None = None,
    n_query: int | None = None,
) -> DataFrame:
    """Exact: queries (by..., vector), items (article_id, vector), exclude (by..., article_id). Queries may have what they
    exclude as an array, `out`, instead. `n_query` is their number, or a little more, where counting would work them out twice.

    Items of more than one block are dealt to lists of about a block, so that nearby items stream by together and a query
    leaves out those whose bound does not reach its results."""
    names = list(by)
    out = [c for c in ("out",) if c in queries.columns]
    asked = queries.select(*names, *(() if merge is None else ("label", "weight")), "vector", *out)
    stock = items.select("article_id", "vector")
    n_query, n_item = asked.count() if n_query is None else n_query, stock.count()
    held = lists.build(stock, -(-n_item // item_block)).items if n_item > item_block else stock
    return _search(asked, held, k, exclude, names, n_query, n_item, query_block, item_block, merge=merge)


def top_k_merged(
    intents: DataFrame,
    items: DataFrame,
    k: int,
    exclude: DataFrame | None,
    size: int,
    weighed: bool = False,
    query_block: int | None = None,
    item_block: int = ITEM_BLOCK,
    n_query: int | None = None,
) -> DataFrame:
    """The first k of each intent (list_id, intent_rank, label, weight, vector), merged per list: (list_id, article_id, score,
    label, rank) of the first `size` items by their best score, or, with `weighed`, by score times weight, rounded. `out` and
    `n_query` are as in `top_k`.

    A list's intents are in one task, so their results are merged there and only the list leaves it; where items are cut
    too, Spark merges what the tasks found."""
    by = ("list_id", "intent_rank")
    found = top_k(intents, items, k, exclude, query_block, item_block, by, (size, weighed), n_query)
    if "intent_rank" in found.columns:
        score = F.col("score") * F.col("weight") if weighed else F.col("score")
        found = found.groupBy("list_id", "article_id").agg(F.max(score).alias("score"), F.min_by("label", "intent_rank").alias("label"))
    elif not weighed:
        return found
    else:
        found = found.drop("rank")
    if weighed:
        found = found.withColumn("score", F.round("score", SCORE_PLACES))
    return newest(found, ["list_id"], [F.desc("score"), F.asc("article_id")], size, "rank")


class _Pairs:
    """The candidates of one task, by article, and the vectors of their lists; items stream by."""

    def __init__(self, held: list[pa.Table], sides: list[pa.Table], key: str, names: list[str], products: list[str], extra: list[str]):
        self.rows = pa.concat_tables(held).combine_chunks()
        articles = self.rows["article_id"].combine_chunks()
        known = np.flatnonzero(pc.is_valid(articles).to_numpy(zero_copy_only=False))
        ids = pc.fill_null(articles, 0).to_numpy(zero_copy_only=False)
        self.order = known[np.argsort(ids[known], kind="stable")]
        self.ids, self.names, self.products, self.extra = ids[self.order], names, products, extra
        self.sides = []
        lists_ = pa.concat_tables(sides).combine_chunks() if sides else None
        for name in products:
            given = None if lists_ is None else lists_.filter(pc.is_valid(lists_[name]))
            if given is None or not given.num_rows:
                self.sides.append(None)
                continue
            place = pc.index_in(self.rows[key].combine_chunks(), given[key].combine_chunks(), skip_nulls=True)
            self.sides.append((pc.fill_null(place, -1).to_numpy(zero_copy_only=False), _matrix(given[name])))

    def meet(self, items: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = items["article_id"].to_numpy()
        first, last = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        there = pc.is_valid(items["held"]).combine_chunks().to_numpy(zero_copy_only=False)
        m = np.zeros((len(ids), 0))
        if there.any():
            some = _matrix(items["held"].filter(pa.array(there)))
            m = np.zeros((len(ids), some.shape[1]))
            m[there] = some
        ends = np.cumsum(last - first)
        # As many pairs at once as a batch of vectors holds, whatever the number of candidates that an item has.
        for a in range(0, int(ends[-1]), PAIR_CHUNK):
            at = np.arange(a, min(a + PAIR_CHUNK, int(ends[-1])))
            item = np.searchsorted(ends, at, "right")
            row = self.order[first[item] + at - (ends[item] - (last - first)[item])]
            columns = [c.combine_chunks() for c in self.rows.take(pa.array(row)).columns]
            columns += [c.combine_chunks() for c in items.select(self.extra).take(pa.array(item)).columns]
            for side in self.sides:
                found = np.zeros(len(row))
                if side is not None:
                    place, vectors = side
                    good = (place[row] >= 0) & there[item]
                    found[good] = np.einsum("ij,ij->i", vectors[place[row[good]]], m[item[good]])
                columns.append(pa.array(found, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*self.names, *self.extra, *self.products])


def _whole(v: Column) -> Column:
    """The vector, or null where a component is missing."""
    return F.when(~F.exists(v, lambda x: x.isNull()), v)


def with_products(rows: DataFrame, sides: DataFrame, items: DataFrame, key: str = "list_id") -> DataFrame:
    """rows (key, article_id, ...) whose article is in items (article_id, vector, ...), with what else the item has and the
    product of its vector and each vector of the row's list: sides (key, vectors...), a row per key. A product is 0 where a
    vector or a component is missing.

    Rows move once, without vectors; items move once per block of rows and stream past them."""
    products = [c for c in sides.columns if c != key]
    names, extra = rows.columns, [c for c in items.columns if c not in ("article_id", "vector")]
    rows = durable(rows)
    n_row, tasks = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-n_row // PAIR_BLOCK), min(tasks, -(-n_row // LEAST_PAIRS)))
    block = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    of_lists = sides.select(
        block.alias("_block"), F.lit(0).alias("_side"), F.col(key).alias(key), *[_whole(F.col(p).cast("array<double>")).alias(p) for p in products]
    )
    of_rows = rows.select(block.alias("_block"), F.lit(1).alias("_side"), *names)
    of_items = items.filter(F.col("article_id").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block"), F.lit(2).alias("_side"), "article_id", _whole(F.col("vector")).alias("held"), *extra
    )
    dealt = united(of_lists, of_rows, of_items).repartitionById(n, F.col("_block")).sortWithinPartitions(F.col("_block") * 3 + F.col("_side"))
    schema = StructType([*[rows.schema[c] for c in names], *[items.schema[c] for c in extra]])
    for p in products:
        schema = schema.add(p, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, pairs = None, {0: [], 1: []}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch["_block"].to_numpy() * 3 + batch["_side"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if place[a] // 3 != at:
                    at, held, pairs = place[a] // 3, {0: [], 1: []}, None
                side, part = place[a] % 3, pa.Table.from_batches([batch.slice(a, b - a)])
                if side < 2:
                    held[side].append(part.select([key, *products] if side == 0 else names))
                    continue
                if pairs is None and held[1]:
                    pairs, held = _Pairs(held[1], held[0], key, names, products, extra), {0: [], 1: []}
                if pairs is not None:
                    yield from pairs.meet(part)

    return dealt.mapInArrow(run, schema)


def pairs_within_bounds(queries: DataFrame, held: lists.Lists, k: int) -> DataFrame:
    """(pairs, everything): products that the exact search works out for `queries` (query_id, vector), and all there are."""
    asked = durable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(k).alias("fetch")))
    found = top_k_of_lists(asked, held, k)
    last = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    first = asked.select("query_id", F.explode(held.first()("vector", "fetch")).alias("cell"))
    rest = asked.join(last, "query_id").select("query_id", F.explode(held.within()("vector", "floor")).alias("cell"))
    sizes = held.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    pairs = first.unionByName(rest).distinct().join(sizes, "cell").agg(F.sum("n").alias("pairs"))
    everything = asked.select(F.count(F.lit(1))).scalar() * sizes.select(F.sum("n")).scalar()
    return pairs.select("pairs", everything.alias("everything"))


def top_k_of_lists(asked: DataFrame, held: lists.Lists, k: int) -> DataFrame:
    """The exact search over lists that are built already; `asked` has query_id, vector and fetch."""
    return _search(asked.select("query_id", "vector"), held.items, k, None, ["query_id"], asked.count(), int(held.sizes.sum()))


def top_k_listed(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude: DataFrame | None = None,
    recall: float = lists.RECALL,
    judged: int = lists.JUDGED,
    held: lists.Lists | None = None,
    probes: int | None = None,
) -> DataFrame:
    """Approximate: a query searches its `probes` nearest lists, whole. If not given, they are the fewest that hold the share
    `recall` of the true first k of `judged` queries, chosen by a hash of the id and searched exactly; queries that find
    fewer than they ask for there search all lists."""
    stock = items.select("article_id", "vector")
    held = held or lists.build(stock, lists.lists_for(stock.count()))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if probes is None:
        probes = probes_of(asked, held, k, recall, judged)
    meeting = Meeting(centres=held.centres, sizes=held.sizes, probes=probes)
    return _search(asked, held.items, k, exclude, ["query_id"], asked.count(), int(held.sizes.sum()), meeting=meeting)


def probes_of(asked: DataFrame, held: lists.Lists, k: int, recall: float = lists.RECALL, judged: int = lists.JUDGED) -> int:
    """How many of its nearest lists a query has to search for the wanted recall, by the exact results of some queries."""
    some = durable(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(judged).select("query_id", "vector").withColumn("fetch", F.lit(k)))
    return lists.probes_for(durable(top_k_of_lists(some, held, k)), some, held, recall)


def listed_share(queries: DataFrame, held: lists.Lists, probes: int) -> DataFrame:
    """Pairs that the search of the `probes` nearest lists compares, over all pairs."""
    sizes = held.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    near = queries.select(F.explode(held.nearest(probes)(F.col("vector").cast("array<double>"))).alias("cell")).join(sizes, "cell")
    everything = queries.select(F.count(F.lit(1))).scalar() * sizes.select(F.sum("n")).scalar()
    return near.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).select(F.try_divide(F.col("pairs"), everything).alias("share_compared"))


def planes(dim: int, tables: int = TABLES, bits: int = MAX_BITS, seed: int = 0) -> np.ndarray:
    """Random hyperplanes (table, bit, component); the first bits are the same whatever their number."""
    return np.round(np.random.RandomState(seed).normal(size=(tables, bits, dim)), PLANE_PLACES)


def bits_for(items: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> Column:
    """Enough bits that a cell holds about `rows_per_cell` items, so a query's work does not grow with the catalogue."""
    wanted = F.ceil(F.log2(F.count(F.lit(1)) / rows_per_cell)).cast("int")
    return items.agg(F.greatest(F.lit(1), F.least(F.lit(MAX_BITS), F.coalesce(wanted, F.lit(1))))).scalar()


def _homes(vectors: np.ndarray, sides: np.ndarray, used: int) -> np.ndarray:
    """The cell of each vector in each table, by its first `used` bits."""
    weights = 1 << np.arange(used)
    return np.stack([(vectors @ sides[t, :used].T > 0) @ weights for t in range(len(sides))], axis=1)


def _cells(sides: np.ndarray, probes: bool):
    """Of each vector: its cell in each table and, as a query, those one bit away."""

    def assign(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, bits in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            used = int(bits.iloc[0])
            weights = 1 << np.arange(used)
            m = np.stack(vectors.to_list()).astype(np.float64)
            home = _homes(m, sides, used)
            steps = np.concatenate([[0], weights]) if probes else np.zeros(1, np.int64)
            near = home[:, :, None] ^ steps[None, None, :]
            near = near + (np.arange(len(sides)) << MAX_BITS)[None, :, None]
            yield pd.Series(list(near.reshape(len(m), -1)))

    return F.pandas_udf(assign, "array<bigint>")


def in_cells(df: DataFrame, bits: Column, dim: int, probes: bool, tables: int = TABLES, seed: int = 0) -> DataFrame:
    assign = _cells(planes(dim, tables, seed=seed), probes)
    vector = F.col("vector").cast("array<double>")
    return df.withColumn("_bits", bits).withColumn("cell", F.explode(assign(vector, F.col("_bits")))).drop("_bits")


def top_k_hashed(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    dim: int,
    exclude: DataFrame | None = None,
    rows_per_cell: int = ROWS_PER_CELL,
    tables: int = TABLES,
    seed: int = 0,
) -> DataFrame:
    """Approximate: sign hashes on random hyperplanes; a query looks in its own cell and those one bit away. Cells hold
    about `rows_per_cell` items however large the catalogue is."""
    asked, stock = queries.select("query_id", "vector"), items.select("article_id", "vector")
    meeting = Meeting(sides=planes(dim, tables, seed=seed))
    return _search(asked, stock, k, exclude, ["query_id"], asked.count(), stock.count(), meeting=meeting, bits=bits_for(stock, rows_per_cell))


def compared_share(
    queries: DataFrame, items: DataFrame, dim: int, rows_per_cell: int = ROWS_PER_CELL, tables: int = TABLES, seed: int = 0
) -> DataFrame:
    """Pairs that the hashed form compares (a pair counts in each table where it meets) over all pairs."""
    bits = bits_for(items, rows_per_cell)
    looks = in_cells(queries.select("vector"), bits, dim, True, tables, seed).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    held = in_cells(items.select("vector"), bits, dim, False, tables, seed).groupBy("cell").agg(F.count(F.lit(1)).alias("i"))
    everything = queries.select(F.count(F.lit(1))).scalar() * items.select(F.count(F.lit(1))).scalar()
    pairs = looks.join(held, "cell").agg(F.coalesce(F.sum(F.col("q") * F.col("i")), F.lit(0)).alias("pairs"))
    return pairs.select(F.try_divide(F.col("pairs"), everything).alias("share_compared"))


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate search also gave."""
    hit = found.select("query_id", "article_id").withColumn("hit", F.lit(1))
    return truth.join(hit, ["query_id", "article_id"], "left").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.count(F.lit(1))).alias("recall"),
    )
