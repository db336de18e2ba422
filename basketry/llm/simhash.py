"""Near-duplicates by SimHash fingerprints, with a pigeonring filter before the Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WORD, by_row, keyed, movable, unpacked
from basketry.session import durable

SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 8
SEED = 42
# Groups of fingerprints that agree in a key are cut further above this size.
GROUP_ROWS = 20_000
# A text's shingles are hashed in runs of this many.
RUN = 200_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = WORD.findall(text.encode().lower())  # bytes lower-case in A-Z only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, RUN):
        h = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + RUN], stops[at : at + RUN])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(_id, _h, fp): one row per row of `docs`; fp holds the 64 bits as a signed number."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return keyed(docs, id_col, text_col).select("_id", "_h", F.pandas_udf(of, "bigint")("_text").alias("fp"))


def chain(segments: int, max_bits: int) -> tuple[int, int]:
    """How many segments at the start of a chain may not differ at all, and how many may differ in one bit together.

    Pigeonring: if two prints differ in at most n bits over m segments in a ring, some segment starts a chain where the
    first l segments differ in at most l * n / m bits together, for every l.
    """
    if not max_bits:
        return segments, segments
    return -(-segments // max_bits) - 1, min(segments, -(-2 * segments // max_bits) - 1)


def ring_keys(fp: Column, segments: int, max_bits: int) -> Column:
    """Keys of a print: for each start, the segments without difference and, of those with one bit, all but one."""
    width, (same, near) = 64 // segments, chain(segments, max_bits)
    piece = lambda s: F.shiftrightunsigned(fp, width * (s % segments)).bitwiseAND((1 << width) - 1)
    keys = []
    for start in range(segments if max_bits else 1):
        loose = range(same, near)
        for k, kept in enumerate(combinations(loose, max(0, len(loose) - 1))):
            parts = [piece(start + s) for s in (*range(same), *kept)]
            packed_key = F.xxhash64(*parts) if width * len(parts) > 63 else reduce(
                lambda a, b: F.shiftleft(a, width).bitwiseOR(b), parts
            )
            keys.append(F.struct(F.lit(start * segments + k).alias("ring"), packed_key.alias("key")))
    return F.array(*keys)


def _within(prints: np.ndarray, most: int, segments: int) -> list[tuple[int, int]]:
    """Links that join what is connected among the prints of one group: each print to the one it was reached from.

    From each print reached, the rest is filtered by the budgets of the ring, then by the full distance; a print leaves
    the rest once reached, so a tight group costs one pass.
    """
    width, m = 64 // segments, segments
    budget = np.array([(l * most) // m for l in range(1, m + 1)])
    ones = np.uint64((1 << width) - 1)
    out, rest = [], np.arange(len(prints))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            differ = prints[rest] ^ prints[here]
            parts = np.stack([np.bitwise_count((differ >> np.uint64(width * s)) & ones) for s in range(m)])
            alive = np.zeros(len(rest), bool)
            for start in range(m):
                sums = np.cumsum(np.roll(parts, -start, axis=0), axis=0)
                alive |= (sums <= budget[:, None]).all(axis=0)
            near = np.flatnonzero(alive)
            near = near[np.bitwise_count(differ[near]) <= most]
            found = rest[near]
            out += [(int(here), int(x)) for x in found]
            queue += found.tolist()
            rest = np.delete(rest, near)
    return out


def _pairs(prints: np.ndarray, groups: np.ndarray, most: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal groups. Small runs are compared all at once, shifted by 1, 2, ...; others one by one."""
    edges = np.flatnonzero(np.diff(groups)) + 1
    starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(groups)]])
    left, right = [], []
    small = np.repeat(stops - starts <= 8, stops - starts)
    for shift in range(1, 8):
        if shift >= len(prints):
            break
        a = np.flatnonzero((groups[:-shift] == groups[shift:]) & small[:-shift])
        a = a[np.bitwise_count(prints[a] ^ prints[a + shift]) <= most]
        left.append(prints[a])
        right.append(prints[a + shift])
    for i in np.flatnonzero(stops - starts > 8):
        own = prints[starts[i] : stops[i]]
        links = np.array(_within(own, most, segments), np.int64).reshape(-1, 2)
        left.append(own[links[:, 0]])
        right.append(own[links[:, 1]])
    return np.concatenate([*left, prints[:0]]), np.concatenate([*right, prints[:0]])


def _linker(most: int, segments: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[["ring", "key", "part"]].to_numpy()
            change = (np.diff(keys, axis=0) != 0).any(axis=1)
            a, b = _pairs(rows["fp"].to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(change)]), most, segments)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

        for batch in batches:  # sorted by key; the last group may go on in the next batch
            if not len(batch):
                continue
            last = batch[["ring", "key", "part"]].to_numpy()[-1]
            ends = (batch[["ring", "key", "part"]].to_numpy() == last).all(axis=1)
            if ends.all() and held and (held[-1][["ring", "key", "part"]].to_numpy()[-1] == last).all():
                held.append(batch)
                continue
            cut = int(np.argmax(ends))
            if cut or held:
                yield done(pd.concat([*held, batch[:cut]]))
            held = [batch[cut:]]
        if held:
            yield done(pd.concat(held))

    return link


def links(
    prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Distinct prints (fp) -> links (a, b) at `max_bits` or fewer, enough to connect all that any links connect.

    Prints meet where they share a key of the pigeonring. A group above `group_rows` is cut by one further segment, for
    each of those outside the key: they hold at most `max_bits` differences, so where there are more of them, one is equal.
    """
    index = prints.select("fp", F.explode(ring_keys(F.col("fp"), segments, max_bits)).alias("_k")).select("fp", "_k.*")
    sizes = index.groupBy("ring", "key").count().filter(F.col("count") > 1)
    met = durable(index.join(durable(sizes), ["ring", "key"]))
    same, near = chain(segments, max_bits)
    width, inside = 64 // segments, same + max(0, near - same - 1)
    parts = F.array(F.lit(-1).cast("bigint"))
    if segments - inside > max_bits:
        # The segments outside the key: those after the chain, and the one left out of it.
        start, left_out = F.floor(F.col("ring") / segments), F.lit(near - 1) - F.col("ring") % segments
        outside = [start + s for s in range(near, segments)] + ([start + left_out] if near > same else [])
        cut = [
            F.lit(k << width).cast("bigint")
            + F.call_function("shiftrightunsigned", F.col("fp"), ((s % segments) * width).cast("int")).bitwiseAND((1 << width) - 1)
            for k, s in enumerate(outside)
        ]
        parts = F.when(F.col("count") > group_rows, F.array(*cut)).otherwise(parts)
    dealt = met.select("fp", "ring", "key", F.explode(parts).alias("part"))
    dealt = dealt.repartition("ring", "key", "part").sortWithinPartitions("ring", "key", "part")
    return dealt.mapInPandas(_linker(max_bits, segments), "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), root being the smallest node reachable. Every round is stored.

    A round gives each node the smallest root among its neighbours' and then that root's own root, so distances halve.
    """
    both = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(seen, roots["node"] == seen["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("to"))
        step = durable(step)
        jump = step.select(F.col("node").alias("at"), F.col("to").alias("beyond"))
        moved = durable(
            step.join(jump, step["to"] == jump["at"]).select("node", F.least("to", "beyond").alias("root"), "old")
        )
        roots = moved.select("node", "root")
        if moved.filter(F.col("root") != F.col("old")).isEmpty():
            return roots


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    segments: int = SEGMENTS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(_id, _h, fp, root, component): one row per row of `docs`.

    fp is the 64-bit SimHash of the text's shingles of words, root names the class, component is the smallest id among the texts that links of at
    most `max_bits` bits reach. Equal prints are one node, so copies are never paired. Texts without words have print 0
    and link like any other. Null ids are passed over for the smallest id (null only if the class has no other).
    An empty table gives an empty result.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    nodes = durable(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    roots = connected(durable(links(nodes, max_bits, segments, group_rows).distinct()))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = durable(named)
    tops = named.groupBy("root").agg(F.min("least").alias("component"))
    members = durable(named.join(tops, "root").select(F.col("fp").alias("print"), "root", "component"))
    return rows.join(members, rows["fp"] == members["print"], "left").drop("print")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with one row of each class: that of the smallest id (of several with it, the smallest text hash); a null id
    comes last."""
    found = durable(classes(docs, id_col, text_col, **how))
    first = F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_h"))
    keep = durable(found.groupBy("root").agg(first.alias("first")).select("first._id", "first._h"))
    rows = by_row(movable(docs, id_col, text_col), keep, "left_semi")
    return unpacked(rows.dropDuplicates(["_id", "_h"]), docs.columns, text_col)
