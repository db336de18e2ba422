"""What the corpus operators share: packed rows, row keys and word spans over bytes."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from basketry.session import durable

# The white space of every word and line rule, and the ASCII letters that get lower-cased.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

T = TypeVar("T")

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, also where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(
    docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] | None = None, **also: Column
) -> DataFrame:
    """_row (the columns to carry, so that no name of theirs can clash), _id, _text ('' for null), _h (hash of the text).

    (_id, _h) names a row: rows equal in both are copies of one another and get equal results. `also` adds columns.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    carried = [column(c) for c in (docs.columns if keep is None else keep)]
    row = F.struct(*carried) if carried else F.lit(None)
    key = [column(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_h")]
    return docs.select(row.alias("_row"), *key, *[c.alias(name) for name, c in also.items()])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same without the carried columns."""
    return packed(docs, id_col, text_col, []).drop("_row")


def movable(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] | None = None) -> DataFrame:
    """packed() for joins: the text is held once, as _raw (null where it was null), and not in _row."""
    others = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    return packed(docs, id_col, text_col, others, _raw=column(text_col)).drop("_text")


def unpacked(df: DataFrame, columns: Sequence[str], raw: str | None = None, **made: Column) -> DataFrame:
    """The carried columns again, with new ones added; a new one replaces a carried one of its name. `raw` names the
    column that _raw holds."""
    old = [(F.col("_raw") if c == raw else F.col("_row")[c]).alias(c) for c in columns if c not in made]
    return df.select(*old, *[c.alias(name) for name, c in made.items()])


def by_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (_id, _h), also where the id is null. `right` has one row per key."""
    names = [c for c in right.columns if c not in ("_id", "_h")]
    other = right.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), *names)
    on = left["_id"].eqNullSafe(other["_id2"]) & (left["_h"] == other["_h2"])
    return left.join(other, on, how).drop("_id2", "_h2")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the quick built-in where the text is ASCII alone."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_of_id(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary"))


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most `most` together; a larger item stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def once(key: tuple, make: Callable[[], T]) -> T:
    """make() once in each worker process: later tasks of the process find what an earlier one made."""
    home = sys.modules.setdefault("basketry_worker", ModuleType("basketry_worker")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 2**32, (n, 2), dtype=np.uint64) @ np.array([1, 2**32], np.uint64) | np.uint64(1)


RUN_BYTES = 1 << 19
_BYTE = _odd(11, 256)
_BASE = _odd(12, 4)
_POWERS: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """1, b, b*b, ... modulo 2**64 for one of a few odd bases."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _BASE[which], np.uint64)
        have[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(have)
        if len(have) > 1 << 22:  # a long text's powers are not kept
            _POWERS.pop(which)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[ord(c) for c in WHITE]] = False


class Words:
    """Words of several texts at once: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        inside = _IS_WORD[raw].view(np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, at)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """One hash a word, of its bytes up to `ends` (the whole word if not given)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        stops = self.ends if ends is None else ends
        sizes = stops - self.starts
        upto = np.cumsum(sizes)
        scale, out = powers(0, int(sizes.max())), np.empty(len(sizes), np.uint64)
        first = 0
        while first < len(sizes):  # in runs, since each byte takes some dozen bytes here
            done = int(upto[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(upto, done + RUN_BYTES, "right")))
            some = sizes[first:last]
            before = np.cumsum(some) - some
            place = np.arange(int(some.sum())) - np.repeat(before, some)
            terms = _BYTE[self.raw[np.repeat(self.starts[first:last], some) + place]] * scale[place]
            out[first:last] = np.add.reduceat(terms, before) + some.astype(np.uint64)
            first = last
        return mixed(out)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of `counts` (n) met at least so often that no more than `most` are. How often is read off a histogram of
    counts in steps of a sixteenth of an octave, which is small whatever the corpus; no task sorts, and only these rows come
    to the driver."""
    step = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"))
    held, least = 0, None
    for row in sorted(sizes.collect(), key=lambda r: -r["step"]):
        held += row["words"]
        if held > most:
            break
        least = row["step"]
    return counts.filter(F.lit(False) if least is None else step >= least)


def in_blocks(
    left: DataFrame, right: DataFrame, place: str, key_left: str, key_right: str, most_left: int, most_right: int
) -> tuple[GroupedData, GroupedData]:
    """Both sides dealt by hash to blocks of about so many rows, for each value of `place` apart, and each block once for
    each of the other side's: grouped by (place, left, right), to be grouped together. How many blocks there are follows
    from counts, one small row a place."""
    n = lambda df, most, name: df.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    sizes = durable(n(left, most_left, "_left").join(n(right, most_right, "_right"), place))

    def dealt(own: DataFrame, key: str, mine: str, other: str) -> GroupedData:
        spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{other}") - 1))
        held = own.join(sizes, place).withColumn(mine, F.pmod(F.xxhash64(key), F.col(f"_{mine}"))).withColumn(other, spread)
        return held.drop("_left", "_right").groupBy(place, "left", "right")

    return dealt(left, key_left, "left", "right"), dealt(right, key_right, "right", "left")
