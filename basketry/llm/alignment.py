"""Two tokenizers' ids of the same texts, cut where both end a token, and linked where tokens share bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

from basketry.llm.bpe import byte_letters, ragged
from basketry.llm.common import frequent, once, packed, slices, unpacked
from basketry.llm.packing import ByteCoder
from basketry.session import durable

# The most id pairs whose counts every task holds, the most frequent ones; the counts of all others are met by a join.
HELD_PAIRS = 262_144
# Bytes of the texts that a task has in hand as lists of ids, or one longer text; and links as arrays.
SLICE_BYTES = 1_000_000
SLICE_TOKENS = 125_000
# Slots of the table that finds a held pair at once, where no other pair has taken the slot.
SLOTS = 1 << 20
# Distinct pairs that a task adds up before it hands them on.
COUNTED_PAIRS = 2_000_000
SPACE = "▁"


class Coders:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_file: str, piece_file: str):
        self.a = ByteCoder(byte_file)
        self.a.library.encode_special_tokens = True  # their strings in a text are plain text
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * self.a.library.get_vocab_size()
        for token, i in self.a.library.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=piece_file)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]

        self.a_joined, self.b_joined = Joined(self.a_bytes), Joined(self.b_bytes)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both, or none where a text is empty or the joined bytes of either are not those of blank + text."""
        ours = self.a.encode([" " + t for t in texts])
        theirs = [np.array(b, np.int64) for b in self.b.encode(texts, num_threads=1)]
        none = np.zeros(0, np.int64)
        for text, a, b in zip(texts, ours, theirs):
            whole = b" " + text.encode()
            yield (a, b) if text and self.a_joined.spell(a) == whole and self.b_joined.spell(b) == whole else (none, none)


class Joined:
    """The bytes of all tokens in one array."""

    def __init__(self, tokens: list[bytes]):
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def spell(self, ids: np.ndarray) -> bytes:
        return ragged(self.raw, self.starts[ids], self.sizes[ids]).tobytes()


def coders(byte_file: str, piece_file: str) -> Coders:
    return once(("coders", byte_file, piece_file), lambda: Coders(byte_file, piece_file))


def cuts(a_ends: Sequence[int], b_ends: Sequence[int]) -> tuple[list[int], list[int]]:
    """At which tokens of each list (their indexes) both lists end: one dictionary from end to index for each list, and
    the sorted ends that are keys of both."""
    a_at, b_at = dict(zip(a_ends, range(len(a_ends)))), dict(zip(b_ends, range(len(b_ends))))
    common = list(filter(b_at.__contains__, a_at))  # a dictionary keeps its keys in the order of the text, so these are sorted
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def group_marks(
    coded: Sequence[tuple[np.ndarray, np.ndarray]], a_sizes: np.ndarray, b_sizes: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text's ids of both: which tokens of either list end where one of the other ends. All texts are marked in one
    go; both lists of a text have the same bytes, so their running ends agree over all texts."""
    sides = [(np.concatenate(ids), sizes) for ids, sizes in zip(zip(*coded), (a_sizes, b_sizes))]
    a_ends, b_ends = (np.cumsum(sizes[ids.astype(np.int64)]) for ids, sizes in sides)
    at = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
    at[b_ends] = 1
    a_marks = at[a_ends]
    at[b_ends] = 0
    at[a_ends] = 1
    b_marks = at[b_ends]
    a, b = 0, 0
    for a_ids, b_ids in coded:
        yield a_marks[a : a + len(a_ids)], b_marks[b : b + len(b_ids)]
        a, b = a + len(a_ids), b + len(b_ids)


def links(a_ends: np.ndarray, b_ends: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a, index of b) of all pairs that share bytes, from the groups' last tokens (a_last, b_last).

    A group's bytes fall into runs without an end of either list inside. Each run lies in one token of either list, and the
    bytes that two tokens share are one such run; so the runs of a group are its links. Its last run ends both lists.
    """
    inner_a, inner_b = np.ones(len(a_ends), bool), np.ones(len(b_ends), bool)
    inner_a[a_last] = inner_b[b_last] = False
    ends = np.sort(np.concatenate([a_ends[inner_a], b_ends[inner_b], a_ends[a_last]]), kind="stable")
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Batch:
    """Stored documents side by side: ids, which of them end a group, and all links."""

    def __init__(self, rows: list[tuple], a_sizes: np.ndarray, b_sizes: np.ndarray):
        """rows: (n_a, n_b, ids, marks) of each document, as `store` has them."""
        press = zstandard.ZstdDecompressor()
        self.n_a, self.n_b = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        a, b, a_marks, b_marks = [], [], [], []
        for n, m, ids, marks in rows:
            ids = np.frombuffer(press.decompress(ids), np.uint8) if ids else np.zeros(0, np.uint8)
            wide = len(ids) // max(1, n + m)
            ids = ids.view(np.uint16 if wide == 2 else np.uint32) if len(ids) else np.zeros(0, np.uint16)
            marks = np.unpackbits(np.frombuffer(marks, np.uint8), count=n + m)
            a.append(ids[:n])
            b.append(ids[n:])
            a_marks.append(marks[:n])
            b_marks.append(marks[n:])
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        self.a_last, self.b_last = np.flatnonzero(np.concatenate(a_marks)), np.flatnonzero(np.concatenate(b_marks))
        # A document's tokens of both lists have the same bytes, so their running ends agree over all documents.
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        self.link_a, self.link_b = links(a_ends, b_ends, self.a_last, self.b_last)
        self.a_first = np.concatenate([[0], np.cumsum(self.n_a)])
        self.b_first = np.concatenate([[0], np.cumsum(self.n_b)])
        self.group_first = np.searchsorted(self.a_last, self.a_first)
        self.link_first = np.searchsorted(self.link_a, self.a_first)

    def pairs(self, b_size: int) -> np.ndarray:
        return self.a[self.link_a] * b_size + self.b[self.link_b]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_a)), np.diff(self.link_first))

    def groups(self, numerals: Joined) -> list[str]:
        """'a1,a2|b1;a3|b2,b3' of each document: ids in order, groups in order. `numerals` spells ids, with room for a sign."""
        a_own = np.searchsorted(self.a_last, np.arange(len(self.a)))
        b_own = np.searchsorted(self.b_last, np.arange(len(self.b)))
        # A group's tokens of the first list, then those of the second.
        a_at = np.arange(len(self.a)) + np.concatenate([[0], self.b_last + 1])[a_own]
        b_at = np.arange(len(self.b)) + self.a_last[b_own] + 1
        ids, signs = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        signs[a_at[self.a_last]], signs[b_at[self.b_last]] = ord("|"), ord(";")
        sizes = numerals.sizes[ids]
        raw, ends = ragged(numerals.raw, numerals.starts[ids], sizes), np.cumsum(sizes)
        raw[ends - 1] = signs
        stops = np.concatenate([[0], ends])[self.a_first + self.b_first].tolist()
        text = raw.tobytes().decode("ascii")
        return [text[i : max(i, j - 1)] for i, j in zip(stops, stops[1:])]


def slot_of(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def slotted(table: np.ndarray) -> np.ndarray:
    """For each slot the place of a pair that falls there, 0 for none."""
    out = np.zeros(SLOTS, np.int64)
    out[slot_of(table)] = np.arange(len(table))
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def store(rows: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Each row's ids and group marks: (_row, _nr, n_a, n_b, n_groups, ids, marks). Texts are encoded once."""
    schema = StructType(
        [rows.schema["_row"], *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups")), *(StructField(c, BinaryType()) for c in ("ids", "marks"))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, press = coders(byte_file, piece_file), zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if max(len(both.a_bytes), len(both.b_bytes)) <= 1 << 16 else np.uint32
        a_sizes, b_sizes = both.a_joined.sizes, both.b_joined.sizes
        for batch in batches:
            for start, stop in slices(pc.binary_length(batch.column(1)).to_pylist(), SLICE_BYTES):
                texts = batch.column(1).slice(start, stop - start).to_pylist()
                coded, out = list(both.encode(texts)), []
                marks = group_marks(coded, a_sizes, b_sizes)
                for (a_ids, b_ids), (a_marks, b_marks) in zip(coded, marks):
                    ids = press.compress(np.concatenate([a_ids, b_ids]).astype(kind).tobytes()) if len(a_ids) else b""
                    packed_marks = np.packbits(np.concatenate([a_marks, b_marks])).tobytes()
                    out.append((len(a_ids), len(b_ids), int(np.count_nonzero(a_marks)), ids, packed_marks))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), batch_types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], schema.names)

    batch_types = pa.schema([(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")] + [(c, pa.binary()) for c in ("ids", "marks")])
    stored = rows.select("_row", "_text").mapInArrow(encode, schema)
    return durable(stored.withColumn("_nr", F.monotonically_increasing_id()))


def align(
    docs: DataFrame,
    byte_file: str,
    piece_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    outputs: Sequence[str] = ("a_ids", "b_ids", "groups"),
    digests: dict[str, Column] | None = None,
    held_pairs: int = HELD_PAIRS,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with n_a, n_b, n_groups, n_links, n_best, count_sum, the `outputs`
    and the `digests` added (replacing columns of these names).

    a_ids are a byte-level tokenizer's ids of blank + text, b_ids a piece tokenizer's ids of the text (it adds the blank).
    Byte offsets where both end a token cut them into groups; `groups` has them as 'a1,a2|b1;a3|b2,b3'. A link is a pair of
    tokens that share bytes. The count of its id pair is that of all links of the corpus with this pair; n_best are the links
    whose count is the highest of their b id, ties included, and count_sum adds up the counts of a text's links. `digests`
    are expressions over outputs, worked out before counts are joined, so that outputs not asked for never move.

    Null and empty texts, and texts that the tokens of either do not spell byte by byte, have no tokens: zeros, no ids, ''.
    Very long texts are encoded whole, one at a time. Repeated rows are rows of their own: each counts, each is returned. Ids
    and other columns may be null. An empty table gives an empty result.

    Texts are encoded once and kept as compressed ids. Pair counts grow with the corpus: the most frequent `held_pairs` go to
    every task, the others meet the texts that hold them in a join by pair, where none is frequent.
    """
    digests = digests or {}
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns)
    stored = store(rows, byte_file, piece_file)
    files, context = (byte_file, piece_file), docs.sparkSession.sparkContext

    def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Batch]]:
        """Slices of a record batch whose last four columns are n_a, n_b, ids, marks."""
        n_a, n_b = (batch.column(batch.num_columns - k).to_pylist() for k in (4, 3))
        ids, marks = (batch.column(batch.num_columns - k) for k in (2, 1))
        both = coders(*files)
        for start, stop in slices([x + y for x, y in zip(n_a, n_b)], SLICE_TOKENS):
            part = [c.slice(start, stop - start).to_pylist() for c in (ids, marks)]
            yield start, stop, Batch(list(zip(n_a[start:stop], n_b[start:stop], *part)), both.a_joined.sizes, both.b_joined.sizes)

    last = ["n_a", "n_b", "ids", "marks"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        b_size = len(coders(*files).b_bytes)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys % b_size), pa.array(n)], ["pair", "b", "n"])

        for batch in batches:
            for _, _, held in batches_of(batch):
                more, times = np.unique(held.pairs(b_size), return_counts=True)
                keys, n = _summed(np.concatenate([keys, more]), np.concatenate([n, times]))
                if len(keys) > COUNTED_PAIRS:
                    yield out()
                    keys, n = keys[:0], n[:0]
        yield out()

    counts = stored.select(*last).mapInArrow(count, "pair bigint, b bigint, n bigint")
    counts = durable(counts.groupBy("pair", "b").agg(F.sum("n").alias("n")))
    # One row for each id of the second vocabulary.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = durable(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    held = frequent(counts, held_pairs).toPandas().sort_values("pair")
    sent = context.broadcast((held["pair"].to_numpy(np.int64), held["n"].to_numpy(np.int64), held["best"].to_numpy(bool)))

    token = uuid.uuid4().hex

    def known(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in what is held, and whether it is."""
        table = sent.value[0]
        if not len(table):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        slots = once(("slots", token), lambda: slotted(table))
        at = slots[slot_of(pairs)]
        ours = table[at] == pairs
        others = np.flatnonzero(~ours)
        at[others] = np.minimum(np.searchsorted(table, pairs[others]), len(table) - 1)
        ours[others] = table[at[others]] == pairs[others]
        return at, ours

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_size = len(coders(*files).b_bytes)
        for batch in batches:
            names = batch.column(0).to_numpy()
            for start, _, part in batches_of(batch):
                pairs, owner = part.pairs(b_size), part.owners()
                loose = ~known(pairs)[1]
                pairs, owner = pairs[loose], owner[loose]
                order = np.lexsort((pairs, owner))
                pairs, owner = pairs[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])])[: len(pairs)])
                n = np.diff(np.append(new, len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(names[start + owner[new]]), pa.array(pairs[new]), pa.array(n)], ["_nr", "pair", "times"])

    loose = stored.select("_nr", *last).mapInArrow(rare, "_nr bigint, pair bigint, times bigint")
    met = loose.join(counts, "pair").groupBy("_nr").agg(
        F.sum(F.col("times") * F.col("n")).alias("far_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("far_best")
    )
    met = met.select(F.col("_nr").alias("_nr2"), "far_sum", "far_best")

    kinds = {"a_ids": ArrayType(IntegerType()), "b_ids": ArrayType(IntegerType()), "groups": StringType()}
    if any(name not in kinds for name in outputs):
        raise ValueError(f"outputs are some of {', '.join(kinds)}")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "near_best", "near_sum"]
    schema = StructType([stored.schema["_row"], stored.schema["_nr"], *(StructField(c, LongType()) for c in numbers)])
    for name in outputs:
        schema = schema.add(name, kinds[name])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coders(*files)
        most = max(len(both.a_bytes), len(both.b_bytes))
        numerals = once(("numerals", most), lambda: Joined([f"{i} ".encode() for i in range(most)]))
        b_size = len(both.b_bytes)
        for batch in batches:
            for start, stop, part in batches_of(batch):
                at, ours = known(part.pairs(b_size))
                _, n, best = sent.value
                sums = [np.concatenate([[0], np.cumsum(np.where(ours, x[at] if len(x) else 0, 0))])[part.link_first] for x in (best.astype(np.int64), n)]
                made = {
                    "a_ids": lambda: pa.ListArray.from_arrays(pa.array(part.a_first, pa.int32()), pa.array(part.a, pa.int32())),
                    "b_ids": lambda: pa.ListArray.from_arrays(pa.array(part.b_first, pa.int32()), pa.array(part.b, pa.int32())),
                    "groups": lambda: pa.array(part.groups(numerals), pa.string()),
                }
                figures = [part.n_a, part.n_b, np.diff(part.group_first), np.diff(part.link_first), *map(np.diff, sums)]
                kept = [batch.column(k).slice(start, stop - start) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, figures), *(made[name]() for name in outputs)], schema.names)

    spelled = stored.select("_row", "_nr", *last).mapInArrow(spell, schema)
    spelled = spelled.select("_row", "_nr", *numbers, *[c for c in outputs if not digests], *[c.alias(name) for name, c in digests.items()])
    both = spelled.join(met, spelled["_nr"] == met["_nr2"], "left")
    far = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    made = {c: F.col(c) for c in numbers[:4]} | {"n_best": F.col("near_best") + far("far_best"), "count_sum": F.col("near_sum") + far("far_sum")}
    return unpacked(both, columns, **made, **{c: F.col(c) for c in (digests or outputs)})
