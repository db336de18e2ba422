"""Passages that occur more than once, found with compressed full-text indexes and removed.

A window is `window` words in a row. Each window belongs to its smallest gram (a hash of a few words in it), so equal
windows share it; windows in a row of one text with the gram at the same place form a segment. Grams that only one segment
has end there. The other segments are dealt by gram to shards of a set number of words, where every distinct segment, with
the number of its occurrences, goes into one FM-index, and all are streamed through it. Where a gram has more words than a
shard, its windows are dealt one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from basketry.llm.bpe import ragged
from basketry.llm.common import Words, _BASE, by_row, keyed, mixed, movable, powers, slices, unpacked
from basketry.session import durable

WINDOW = 35
GRAM = 8
SHARD_WORDS = 100_000
SLICE_CHARS = 1_000_000
# Words of segments that a task has in hand before it sends them to their shards.
SENT_WORDS = 500_000
_PLACE = np.uint64((1 << 24) - 1)


class Ranges:
    """Hashes of runs of words, from running sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.back = np.full(n + 1, pow(int(_BASE[1]), -1, 2**64), np.uint64)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(1, n), dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def segments(texts: Sequence[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, gram, hash) of each segment. At most window - gram + 1 windows share one gram's place."""
    words = Words(texts)
    n, span = len(words), window - gram + 1
    counts = np.maximum(np.diff(words.first) - window + 1, 0)
    if not counts.any():
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    runs = Ranges(words.hashes())
    at = np.arange(n - gram + 1)
    grams = runs.of(at, at + gram)
    # The smallest by its leading bits, the first of equal ones: both depend on the window's words alone. Within blocks of
    # 2**23 places, the lower bits tell the place.
    if n > int(_PLACE) >> 1:
        least = np.concatenate([_smallest(grams[a : a + (1 << 22) + span - 1], span) + a for a in range(0, len(grams) - span + 1, 1 << 22)])
    else:
        least = _smallest(grams, span)
    place = ragged(np.arange(n), words.first[:-1], counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    spot = least[place]
    begins = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])]))
    held = np.diff(np.append(begins, len(place)))
    first = place[begins]
    text = owner[begins]
    return text, first - words.first[text], held, grams[spot[begins]], runs.of(first, first + held + window - 1)


def _smallest(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` grams, the place of the smallest."""
    best = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done * 2 <= span:
        best = np.minimum(best[: len(best) - done], best[done:])
        done *= 2
    if span > done:
        best = np.minimum(best[: len(best) - (span - done)], best[span - done :])
    return (best & _PLACE).astype(np.int64)


class BitLevels:
    """A wavelet tree in one array per level: rows of 64 bits, and the ones before each."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        here = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((here >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            rows = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(rows).astype(np.int64)
            self.bits.append(rows)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(int(len(bit) - bit.sum()))
            here = np.concatenate([here[bit == 0], here[bit == 1]])
        self.first = self._down(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            row = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][row] + np.bitwise_count(self.bits[k][row] & mask)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]


class Index:
    """FM-index over pieces (runs of word hashes) that occur `weights` times each."""

    def __init__(self, pieces: list[np.ndarray], weights: np.ndarray, window: int):
        self.window = window
        sizes = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        ends = self.starts + sizes
        text = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 closes each piece
        inside = np.ones(len(text), bool)
        inside[ends] = False
        kinds, text[inside] = np.unique(np.concatenate(pieces), return_inverse=True)
        text[inside] += 1
        self.text, self.sizes, n = text, sizes, len(text)
        # Sorted by as many words as a window has, at least: no longer match is asked for.
        rank, reach = text, 1
        while reach < window:
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.tree = BitLevels(text[order - 1], len(kinds))
        self.below = np.searchsorted(text[order], np.arange(len(kinds) + 1))
        owner = np.repeat(np.arange(len(pieces)), sizes + 1)
        self.weight = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        # Words that neighbours in the order share, up to one less than a window, and never past the end of a piece.
        common, alive = np.zeros(n + 1, np.int64), np.arange(1, n)
        for k in range(window):
            if k:
                common[alive] = k
            a, b = order[alive - 1] + k, order[alive] + k
            ok = (a < n) & (b < n)
            ok[ok] &= (text[a[ok]] == text[b[ok]]) & (text[a[ok]] > 0)
            alive = alive[ok]
        common[0] = common[n] = -1
        self.common = common.astype(np.int32)
        # Of each place, the nearest places before and after where neighbours share fewer words: the interval of suffixes
        # that share what the place and its neighbour do. And the runs of suffixes that share a window but its last word.
        places = np.arange(n + 1, dtype=np.int32)
        self.before, self.after = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        for d in np.unique(common)[1:]:
            here = common == d
            self.before[here] = np.maximum.accumulate(np.where(common < d, places, 0))[here]
            self.after[here] = np.minimum.accumulate(np.where(common < d, places, n)[::-1])[::-1][here]
        border = common < window - 1
        self.first = np.maximum.accumulate(np.where(border, places, 0))[:n]
        self.last = np.minimum.accumulate(np.where(border, places, n)[::-1])[::-1][1:]

    def repeated(self) -> np.ndarray:
        """At which places of the text a window starts that occurs at least twice. Matching statistics of every piece.

        All pieces are read from their last word to the first at once. A step puts the next word before the match if the
        longer match still occurs twice; if not, the match loses words at its end, as many as it takes for more suffixes
        to share the rest.
        """
        n, window = len(self.text), self.window
        found = np.zeros(n, bool)
        at, stop = self.starts + self.sizes - 1, self.starts
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), n), np.zeros(len(at), np.int64)
        while len(at):
            symbol = self.text[at]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.below[symbol], 2)
            new_low, new_high = both[: len(at)], both[len(at) :]
            grows = self.weight[new_high] - self.weight[new_low] >= 2
            shrinks = ~grows & (length > 0)
            left, right = self.common[low], self.common[high]
            depth = np.maximum(left, right)
            wide_low, wide_high = np.where(left == depth, self.before[low], low), np.where(right == depth, self.after[high], high)
            low = np.where(grows, new_low, np.where(shrinks, wide_low, low))
            high = np.where(grows, new_high, np.where(shrinks, wide_high, high))
            length = np.where(grows, length + 1, np.where(shrinks, np.maximum(depth, 0), length))
            whole = grows & (length == window)
            found[at[whole]] = True
            length[whole] = window - 1
            inside = low[whole]
            low[whole], high[whole] = self.first[inside], self.last[inside]
            at = np.where(shrinks, at, at - 1)
            going = at >= stop
            at, stop, low, high, length = at[going], stop[going], low[going], high[going], length[going]
        return found


def shrunk(name: str) -> Column:
    """A text as compressed bytes, so that a shuffle moves less than half; null stays null."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=3)
        for texts in batches:
            yield pd.Series([None if t is None else press.compress(t.encode()) for t in texts])

    return F.pandas_udf(of, "binary")(name)


def sizes_of(blobs: list[bytes | None]) -> list[int]:
    """Sizes of the texts, without taking them out."""
    return [0 if b is None else zstandard.frame_content_size(b) for b in blobs]


def grown(blobs: list[bytes | None]) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [b"" if b is None else press.decompress(b) for b in blobs]


def _search(window: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [np.asarray(w).view(np.uint64) for w in rows["words"]]
        index = Index(pieces, rows["n"].to_numpy(), window)
        hits = index.repeated()
        owner = np.repeat(np.arange(len(pieces)), index.sizes + 1)
        edges = np.diff(np.concatenate([[False], hits, [False]]).view(np.int8))  # the end of a piece parts runs
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1 + window
        piece = owner[begin]
        shift = index.starts[piece]
        return pd.DataFrame(
            {
                "gram": rows["gram"].to_numpy()[piece],
                "seg": rows["seg"].to_numpy()[piece],
                "begin": (begin - shift).astype(np.int32),
                "end": (end - shift).astype(np.int32),
            }
        )

    return search


def _texts_with(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_h, _z, and wants' fields as arrays) for each text (_h) of `wanted`; one row of a text stands for its copies."""
    fields = wanted.schema["wants"].dataType.elementType.names
    holder = rows.groupBy("_h").agg(F.min("_id").alias("_id"))
    wanted = durable(holder.join(wanted, "_h").select("_id", "_h", "wants"))
    sources = by_row(rows.select("_id", "_h", shrunk("_text").alias("_z")), wanted, "inner")
    return sources.dropDuplicates(["_id", "_h"]).select("_h", "_z", *[F.col(f"wants.{c}").alias(c) for c in fields])


def _wanted_of(batch: pd.DataFrame, window: int) -> Iterator[tuple[int, np.ndarray, Ranges, np.ndarray, dict[str, np.ndarray]]]:
    """(text hash, word hashes, runs, first words, segments) of the segments asked for in each text, as arrays. A text of
    equal hash with other words has another segment at a place; that one is left out."""
    blobs, names = batch["_z"].tolist(), batch["_h"].to_numpy()
    fields = {c: batch[c].tolist() for c in batch.columns if c not in ("_h", "_z")}
    for start, stop in slices(sizes_of(blobs), SLICE_CHARS // 2):
        words = Words(grown(blobs[start:stop]))
        hashes = words.hashes()
        runs = Ranges(hashes)
        for i, first in zip(range(start, stop), words.first):
            own = {c: np.asarray(x[i], np.int64) for c, x in fields.items()}
            begin = first + own["at"]
            end = begin + own["held"] + window - 1
            ok = end <= len(hashes)
            ok[ok] = runs.of(begin[ok], end[ok]).view(np.int64) == own["seg"][ok]
            yield int(names[i]), hashes, runs, begin[ok], {c: x[ok] for c, x in own.items()}


def pieces_by_shard(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(segments, pieces): where each segment that may be repeated lies (_h, at, gram, seg), copies of a row included; and
    each distinct segment once (shard, gram, seg, n, words), dealt to shards of about `shard_words` words.

    All segments of a gram share a shard. Where they have more words than a shard, as those of many near copies do, each of
    their windows becomes a segment of its own: equal ones are counted once, and the distinct ones are dealt by their hash.
    """
    rows = keyed(docs, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, names = [t.encode() for t in batch["_text"]], batch["_h"].to_numpy()
            for start, stop in slices([len(t) for t in texts], SLICE_CHARS):
                text, first, held, least, whole = segments(texts[start:stop], window, gram)
                yield pd.DataFrame(
                    {"_h": names[text + start], "at": first.astype(np.int32), "held": held.astype(np.int32), "gram": least.view(np.int64), "seg": whole.view(np.int64)}
                )

    found = durable(rows.select("_text", "_h").mapInPandas(cut, "_h bigint, at int, held int, gram bigint, seg bigint"))
    shared = durable(found.groupBy("gram").count().filter(F.col("count") > 1).select("gram"))
    met = durable(found.join(shared, "gram", "left_semi"))
    one = F.min(F.struct("_h", "at", "held")).alias("one")
    distinct = durable(met.groupBy("gram", "seg").agg(one, F.count(F.lit(1)).alias("n")).select("gram", "seg", "n", "one.*"))
    words = F.sum(F.col("held") + window - 1).alias("words")
    sizes = durable(distinct.groupBy("gram").agg(words))
    large = durable(sizes.filter(F.col("words") > shard_words).select("gram"))

    # Windows of the large grams, each with the number of rows that hold it there.
    wide = met.join(large, "gram", "left_semi").groupBy("_h", "at", "held", "gram", "seg").agg(F.count(F.lit(1)).alias("n"))
    wide = wide.groupBy("_h").agg(F.collect_list(F.struct("at", "held", "gram", "seg", "n")).alias("wants"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [[np.zeros(0, np.int64)] * 5], 0
            for name, _, runs, begin, w in _wanted_of(batch, window):
                n = w["held"]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                ones = np.repeat(begin, n) + step
                wide = runs.of(ones, ones + window).view(np.int64)
                out.append([np.full(len(ones), name), np.repeat(w["gram"], n), np.repeat(w["n"], n), np.repeat(w["at"], n) + step, wide])
                held += len(ones)
                if held > SENT_WORDS:
                    yield pd.DataFrame(dict(zip(("_h", "gram", "n", "at", "seg"), map(np.concatenate, zip(*out)))))
                    out, held = [[np.zeros(0, np.int64)] * 5], 0
            yield pd.DataFrame(dict(zip(("_h", "gram", "n", "at", "seg"), map(np.concatenate, zip(*out)))))

    windows = durable(_texts_with(rows, wide).mapInPandas(part, "_h bigint, gram bigint, n bigint, at int, seg bigint"))
    single = F.min(F.struct("_h", "at", F.lit(1).alias("held"))).alias("one")
    apart = durable(windows.groupBy("gram", "seg").agg(single, F.sum("n").alias("n")).select("gram", "seg", "n", "one.*"))
    dealt = apart.groupBy("gram").agg((F.count(F.lit(1)) * window).alias("words"))
    dealt = durable(dealt.select("gram", "words", F.ceil(F.col("words") / shard_words).alias("slices")))
    total = lambda df: df.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-(total(sizes.filter(F.col("words") <= shard_words)) + total(dealt)) // shard_words))

    apart = apart.join(dealt.select("gram", "slices"), "gram").withColumn("slice", F.pmod("seg", "slices")).drop("slices")
    wanted = distinct.join(large, "gram", "left_anti").withColumn("slice", F.lit(-1).cast("bigint")).unionByName(apart)
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("gram", "slice"), F.lit(int(shards))))
    wanted = wanted.groupBy("_h").agg(F.collect_list(F.struct("at", "held", "gram", "seg", "n", "shard")).alias("wants"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["shard", "gram", "seg", "n", "words"]
        for batch in batches:
            out, held = [], 0
            for _, hashes, _, begin, w in _wanted_of(batch, window):
                sizes = (w["held"] + window - 1).tolist()
                own = [hashes[a : a + size].view(np.int64) for a, size in zip(begin.tolist(), sizes)]
                out += zip(w["shard"].tolist(), w["gram"].tolist(), w["seg"].tolist(), w["n"].tolist(), own)
                held += sum(sizes)
                if held > SENT_WORDS:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    pieces = _texts_with(rows, wanted).mapInPandas(fetch, "shard bigint, gram bigint, seg bigint, n bigint, words array<bigint>")
    spots = met.join(large, "gram", "left_anti").select("_h", "at", "gram", "seg").unionByName(windows.select("_h", "at", "gram", "seg"))
    return spots, pieces


def repeated_spans(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(_h, spans): for each text that holds repeated windows, the runs of words they cover, begin to before end."""
    spots, pieces = pieces_by_shard(docs, id_col, text_col, window, gram, shard_words)
    hits = durable(pieces.groupBy("shard").applyInPandas(_search(window), "gram bigint, seg bigint, begin int, end int"))
    span = F.struct((F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end"))
    return spots.join(hits, ["gram", "seg"]).groupBy("_h").agg(F.collect_set(span).alias("spans"))


def drop_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    carry: Sequence[str] | None = None,
    gram: int = GRAM,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with n_words, n_removed and kept_text added (replacing such names).

    Every word inside a window whose words also start anywhere else, in the same text or another, is removed; windows are
    judged on the input. kept_text is the other words, joined by one blank. A null or empty text has no words; texts
    shorter than a window keep all. Repeated rows hold each other's windows and lose them; null ids are rows like others.
    An empty table gives an empty result; a very long text is read whole, alone. Words, segments and equal texts are told apart by 64-bit hashes (segments by two).
    """
    columns = list(docs.columns if carry is None else carry)
    spans = durable(repeated_spans(docs, id_col, text_col, window, gram, shard_words))
    rows = movable(docs, id_col, text_col, columns).withColumn("_z", shrunk("_raw"))
    rows = rows.join(spans.withColumnRenamed("_h", "_h2"), rows["_h"] == F.col("_h2"), "left").select("_row", "_z", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end"))
    made = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    schema = StructType([rows.schema["_row"], StructField("_raw", StringType()), *made])
    with_raw = text_col in columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            for start, stop in slices(sizes_of(blobs), SLICE_CHARS):
                texts, given = grown(blobs[start:stop]), [b is not None for b in blobs[start:stop]]
                words = Words(texts)
                steps = np.zeros(len(words) + 1, np.int64)
                for k, step in ((2, 1), (3, -1)):
                    spots = batch.column(k).slice(start, stop - start)
                    places = words.first[pc.list_parent_indices(spots).to_numpy()] + pc.list_flatten(spots).to_numpy()
                    np.add.at(steps, places, step)
                kept = np.cumsum(steps[:-1]) == 0
                upto = np.concatenate([[0], np.cumsum(kept)])[words.first]
                sizes = (words.ends - words.starts + 1)[kept]  # with the white space after it, which becomes a blank
                raw = ragged(words.raw, words.starts[kept], sizes)
                ends = np.cumsum(sizes)
                raw[ends - 1] = ord(" ")
                bounds = np.concatenate([[0], ends])[upto]
                held = np.diff(upto) > 0
                raw = np.delete(raw, bounds[1:][held] - 1)
                bounds = bounds - np.concatenate([[0], np.cumsum(held)])
                text = pa.StringArray.from_buffers(stop - start, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw))
                n = np.diff(words.first)
                raw_text = [t.decode() if with_raw and ok else None for t, ok in zip(texts, given)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(raw_text, pa.string()), pa.array(n), pa.array(n - np.diff(upto)), text],
                    schema.names,
                )

    return unpacked(rows.mapInArrow(keep, schema), columns, text_col, **{f.name: F.col(f.name) for f in made})
