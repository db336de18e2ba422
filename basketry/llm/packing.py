"""Packing of token ids into fixed-length sequences with balanced attention cost."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from basketry.llm.bpe import Remembered, byte_letters
from basketry.llm.common import once, packed, slices, unpacked

SEQUENCE = 1024
END_ID = 0
# Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (every token attends to its own piece).
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
# Documents whose pieces are packed with one another: this many characters, or one longer document.
POOL_CHARS = 2_000_000
# Words whose ids a task remembers.
REMEMBERED = 250_000

# Fixed value: how the byte-level vocabulary splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Texts of these characters are split alike by every Unicode version; others are encoded whole by the library.
KNOWN_LETTERS = "\t\n\r -~¡-ɏ"


class ByteCoder:
    """Ids of a byte-level tokenizer file, remembered by blank-parted word.

    The pattern never joins what follows a blank between two other characters to what stands before it, so such words are
    encoded one by one. Words new to the task go through the merge ranks of the same vocabulary; texts with special tokens
    or unusual characters go whole through the tokenizers library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.library.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile(f"[^{KNOWN_LETTERS}]")
        self.borders = regex.compile(r"(?<=\S)(?= \S)")
        self.words_seen = Remembered(self._ids, REMEMBERED)

    def _ids(self, word: str) -> list[int]:
        return self.ranked.encode_ordinary(word)

    def _words(self, text: str) -> list[str]:
        if any(s in text for s in ("  ", " \n", "\n ", "\n\n", "\t", "\r")):
            return self.borders.split(text)
        # Single blanks and line ends: a blank goes with the word after it, a line end stands alone.
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = {
            k: np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32)
            for k, t in enumerate(texts)
            if self.unusual.search(t) or any(s in t for s in self.special)
        }
        ids, bounds = self.words_seen.ids([[] if k in whole else self._words(t) for k, t in enumerate(texts)])
        return [whole[k] if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def pack(sizes: Sequence[int], length: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, size, sequence, offset) of items of the given sizes.

    Items are taken from the longest down. What fills whole sequences by itself is cut off first; the rest goes to the
    sequence of the lowest cost among all with room for it. Only where none has, it is cut: the cheapest with any room is
    filled up and what is left looks for room again. There are
    as many sequences as the tokens fill; the tokens left over make sequences of falling powers of two, which need no
    padding either.
    """
    out, n = [], 0
    rests = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start = 0
        while sizes[item] - start >= length:
            out.append((item, start, length, n, 0))
            start, n = start + length, n + 1
        if sizes[item] > start:
            rests.append((sizes[item] - start, item, start))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rests)
    room = [length] * (total // length)
    left = total % length
    while left:
        room.append(1 << (left.bit_length() - 1))
        left -= room[-1]
    used, spent = [0] * len(room), [0.0] * len(room)
    # (cost, sequence) heaps by the room left, and a tree of their least entries over ranges of room.
    none, width = (math.inf, -1), 1 << length.bit_length()
    by_room = [[] for _ in range(length + 1)]
    least = [none] * (2 * width)

    def renew(size: int) -> None:
        at = width + size
        least[at] = by_room[size][0] if by_room[size] else none
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def cheapest(size: int) -> int:
        """The sequence of the lowest cost, then the first, of all that have room for `size`; -1 if none has."""
        found, low, high = none, width + size, 2 * width
        while low < high:
            if low & 1:
                found = min(found, least[low])
                low += 1
            low, high = low >> 1, high >> 1
        return found[1]

    def put(s: int, item: int, start: int, size: int) -> None:
        out.append((item, start, size, n + s, used[s]))
        left = room[s] - used[s]
        heapq.heappop(by_room[left])  # a cheapest sequence is the least of its heap
        renew(left)
        used[s] += size
        spent[s] += cost(size, linear, quadratic)
        if left > size:
            heapq.heappush(by_room[left - size], (spent[s], s))
            renew(left - size)

    for s, size in enumerate(room):
        by_room[size].append((0.0, s))
    for size in set(room):
        renew(size)
    for size, item, start in rests:
        while size:
            s = cheapest(size)
            if s < 0:
                s = cheapest(1)
            some = min(size, room[s] - used[s])
            put(s, item, start, some)
            start, size = start + some, size - some
    return out


def pack_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    carry: Sequence[str] | None = None,
    pool_chars: int = POOL_CHARS,
    as_bytes: bool = False,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) once per piece, with ids, start, doc_tokens, sequence_id and offset.

    A document is its ids by the tokenizer file at `path`, then id 0, so a null or empty text is one token. Each task packs
    its rows in pools of `pool_chars` characters as they come: nothing is shuffled, and a pool is all that a task holds.
    sequence_id joins the number of the partition and a count, so it repeats when a lost task runs again. Repeated rows are
    packed each. An empty table gives an empty result. Columns of these names are replaced.

    ids is an array of int, or with `as_bytes` binary, as shards for training hold them: unsigned 32-bit, little-endian.
    """
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns).select("_row", "_text")
    made = {"ids": BinaryType() if as_bytes else ArrayType(IntegerType()), "start": LongType(), "doc_tokens": LongType(), "sequence_id": LongType(), "offset": LongType()}
    schema = StructType([rows.schema["_row"], *[StructField(name, kind) for name, kind in made.items()]])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(("byte coder", path), lambda: ByteCoder(path))
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, stop in slices([len(t) for t in texts], pool_chars):
                ids = [np.append(x, np.int32(END_ID)) for x in coder.encode(texts[first:stop])]
                pieces = pack([len(x) for x in ids], length)
                item, start, size, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
                joined = np.concatenate([ids[i][a : a + n] for i, a, n in zip(item, start, size)])
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                if as_bytes:
                    raw = pa.py_buffer(joined.astype("<u4"))
                    listed = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds * 4), raw])
                else:
                    listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(joined))
                whole = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(item + first)), listed, *[pa.array(x) for x in (start, whole[item], base + sequence, offset)]],
                    schema.names,
                )
                base += int(sequence.max()) + 1

    found = rows.mapInArrow(code, schema)
    return unpacked(found, columns, **{name: F.col(name) for name in made})
