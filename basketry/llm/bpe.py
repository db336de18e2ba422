"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from basketry.llm.common import once, packed, slices, unpacked

# Words whose ids a task remembers; above it, all are forgotten.
REMEMBERED = 400_000
# Borders in the pair table; above it, the table starts anew.
PAIRS = 1_000_000
SLICE_CHARS = 2_000_000
# The white space of the vocabulary's normaliser.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next
    free one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in prints}
    spare = iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


class Merges:
    """Exact merges of one word without replaying them.

    A word is a string of symbols; its last symbol carries the word end. A sequence of tokens is what the merges make of
    it if each neighbouring pair is: so the longest token is tried at each place, shorter ones if the pair does not hold,
    and one place back if none does. A place where nothing holds is marked and not tried again, so time is linear.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.end = word_end
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = self._symbols(a), self._symbols(b)
            if left + right in self.ids:
                self.rank.setdefault((left, right), rank)
                self.made.setdefault(left + right, (rank, left, right))
        tokens = [t for t in self.ids if len(t) == 1 or t in self.made]
        self.usable = {t: self.ids[t] for t in tokens}
        # The automaton reads a word backwards; what ends at a place there starts at it here.
        self.matches = ahocorasick.Automaton()
        for t in tokens:
            self.matches.add_word(t[::-1], len(t))
        self.matches.make_automaton()
        self.shorter = {t: next((k for k in range(len(t) - 1, 0, -1) if t[:k] in self.usable), 0) for t in tokens}
        self.holds: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple[list, list]] = {}

    def _symbols(self, token: str) -> str:
        """The word end folds into the last symbol, moved to a range of its own."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 0x10000)
        return token

    def symbols(self, letters: str) -> str:
        return letters[:-1] + chr(ord(letters[-1]) + 0x10000) if self.end else letters

    def _spine(self, token: str) -> tuple[list, list]:
        """Along the right and the left edge: each part, and the rank at which it is merged into the next larger."""
        if token not in self.spines:
            both = []
            for side in (2, 1):
                part, until, edge = token, len(self.rank), []
                while True:
                    edge.append((part, until))
                    if part not in self.made:
                        break
                    until, part = self.made[part][0], self.made[part][side]
                both.append(edge)
            self.spines[token] = (both[0], both[1])
        return self.spines[token]

    def pair(self, left: str, right: str) -> bool:
        """Do the merges leave this border alone? They cross it where two parts that touch there merge while both last;
        of equal merges the one further left goes first."""
        if len(self.holds) > PAIRS:
            self.holds.clear()
        ends, begins = self._spine(left)[0], self._spine(right)[1]
        fits = self.holds[(left, right)] = not any(
            (rank := self.rank.get((a, b))) is not None and rank < until_a and rank <= until_b
            for a, until_a in ends
            for b, until_b in begins
        )
        return fits

    def encode(self, word: str) -> list[int]:
        n, usable, holds = len(word), self.usable, self.holds
        # Of the matches that end at one place the longest comes first; read in reverse, it is the one that stays.
        longest = dict(reversed(list(self.matches.iter(word[::-1]))))
        dead = set()
        out: list[str] = []
        at, size = 0, longest.get(n - 1, 0)
        while at < n:
            last = out[-1] if out else ""
            while size:
                token = word[at : at + size]
                if at + size not in dead:
                    fits = holds.get((last, token)) if last else True
                    if fits is None:
                        fits = self.pair(last, token)
                    if fits:
                        break
                size = self.shorter[token]
            if size:
                out.append(token)
                at += size
                size = longest.get(n - 1 - at, 0)
            elif out:
                dead.add(at)
                at -= len(last)
                size = self.shorter[out.pop()]
            else:
                raise ValueError(f"no encoding of {word!r}")
        return [usable[t] for t in out]


class Remembered:
    """Ids of words, each worked out once by `ids_of` until more than `most` are held."""

    def __init__(self, ids_of: Callable[[str], list[int]], most: int = REMEMBERED):
        self.ids_of, self.most = ids_of, most
        self.known: dict[str, int] = {}
        self.flat, self.offsets = array("i"), array("q", [0])

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts' words one after another, and where each text's begin (one more entry for the end)."""
        if len(self.known) > self.most:
            self.known, self.flat, self.offsets = {}, array("i"), array("q", [0])
        known = self.known
        for word in set().union(*texts).difference(known):
            known[word] = len(self.offsets) - 1
            self.flat.extend(self.ids_of(word))
            self.offsets.append(len(self.flat))
        places = np.fromiter((known[w] for text in texts for w in text), np.int64, sum(map(len, texts)))
        offsets, flat = np.array(self.offsets), np.array(self.flat)
        counts = offsets[places + 1] - offsets[places]
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = ends[np.cumsum([0, *map(len, texts)])]
        return ragged(flat, offsets[places], counts), bounds


class Coder:
    """One tokenizer file: its added tokens, normaliser, split pattern and merges, and words already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, end)
        self.letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.split = regex.compile(_pattern(spec["pre_tokenizer"]))
        self.other_space = regex.compile(f"[{SPACES.replace(' ', '').replace(chr(10), '')}]")
        tokens = {i: t.encode() for t, i in {**model["vocab"], **self.added}.items()}
        texts = [tokens.get(i, b"") + b" " for i in range(max(tokens) + 1)]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.cumsum([0] + [len(t) for t in texts])
        self.pieces: dict[str, list[int]] = {}
        self.words_seen = Remembered(self._ids)

    def _ids(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = "".join(c.lower() for c in word) if "\u03a3" in word else word.lower()
        out: list[int] = []
        for piece in self.split.findall(word):
            ids = self.pieces.get(piece)
            if ids is None:
                letters = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
                ids = self.pieces[piece] = self.merges.encode(self.merges.symbols(letters))
            out += ids
        return out

    def words(self, text: str) -> list[str]:
        """What white space and added tokens part; each is encoded by itself."""
        if self.specials is not None and "<|" in text:
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [*self._plain(text[at : m.start()]), m.group()]
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if "\n" in text:
            text = text.replace("\n", " ")
        if not (text.isascii() and text.isprintable()):
            text = self.other_space.sub(" ", text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one more entry for the end)."""
        return self.words_seen.ids([self.words(text) for text in texts])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each text joined by blanks, as bytes one after another, and where each text's begin."""
        counts = self.at[ids + 1] - self.at[ids]
        if len(ids):
            counts[bounds[1:][bounds[1:] > bounds[:-1]] - 1] -= 1  # no blank after a text's last token
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ragged(self.blob, self.at[ids], counts), ends[bounds]


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + c] for each (s, c), one after another."""
    ends = np.cumsum(counts)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


def _pattern(spec: dict) -> str:
    for part in spec.get("pretokenizers", [spec]):
        if part["type"] == "Split":
            return part["pattern"]["Regex"]
    raise ValueError("the tokenizer has no split pattern")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with ids (array of int) and decoded (string) added.

    ids are those of the tokenizer file at `path` for the whole text, without added special tokens, except where the text
    spells one out; decoded is the text of the ids, special tokens kept. Only files with a split pattern and merges, and
    no decoder of their own, are read. A null text is empty; empty texts give no ids and ''. Columns of these names are
    replaced. Each task loads the file, which every machine must hold at `path`, and works through its rows in slices.
    """
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns).select("_row", "_text")
    schema = StructType([rows.schema["_row"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(("coder", path), lambda: Coder(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in slices([len(t) for t in texts], SLICE_CHARS):
                ids, bounds = coder.encode(texts[start:stop])
                raw, ends = coder.decode(ids, bounds)
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                decoded = pa.StringArray.from_buffers(stop - start, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), listed, decoded], ["_row", "ids", "decoded"])

    return unpacked(rows.mapInArrow(code, schema), columns, ids=F.col("ids"), decoded=F.col("decoded"))
