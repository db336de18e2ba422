"""Language of a text by string kernels: blended spectrum, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import column, crc_of_id, packed, slices, unpacked
from basketry.session import durable

UNDETERMINED = "und"
# Grams of 1 to this many characters.
LONGEST = 3
# Bounds of the fit: training texts of each language, and how many of these are landmarks.
FITTED = 1000
LANDMARKS = 48
RIDGE = 1e-3
# Of the landmarks' kernel matrix, directions with less than this share of the largest one's weight are left out.
LEAST_WEIGHT = 1e-6
SLICE_CHARS = 2_000_000
SLICE_CELLS = 16_000_000
TABLE_CELLS = 1 << 24
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


class Grams:
    """A dictionary of grams, and which of them each text holds.

    A text is read as lower-cased letters with one sign for every run of other characters, one before and one after it.
    `letters` are the lower-cased letters that have a number of their own; all others share one.
    """

    def __init__(self, letters: str, longest: int = LONGEST):
        self.letters, self.longest, self.base = letters, longest, len(letters) + 2
        number = {c: k + 2 for k, c in enumerate(letters)}  # 0: no letter, 1: another letter
        self.number = number
        self.grams = [np.zeros(0, np.int64) for _ in range(longest)]
        self.size = 0

    def _table(self) -> np.ndarray:
        """The number of each character, worked out as characters are met."""
        if not hasattr(self, "table"):
            self.table = np.full(0x110000, -1, np.int32)
        return self.table

    def _numbers(self, text: str) -> np.ndarray:
        table = self._table()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = table[points]
        if len(out) and out.min() < 0:
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                low = c.lower()[:1]
                table[p] = self.number.get(low, 1) if LETTER.match(c) else 0
            out = table[points]
        return out

    def codes(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of gram from 1: (text, code) of all grams that hold a letter, in place order."""
        parts = [self._numbers(t) for t in texts]
        edge = np.zeros(1, np.int32)
        flat = np.concatenate([edge[:0], *(x for p in parts for x in (edge, p, edge))])
        owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
        # One sign for a run of signs, within a text.
        keep = flat > 0
        keep[:1] = True
        keep[1:] |= (flat[:-1] > 0) | (owner[1:] != owner[:-1])
        flat, owner = flat[keep].astype(np.int64), owner[keep]
        code = np.zeros(len(flat), np.int64)
        for n in range(1, self.longest + 1):
            size = max(0, len(flat) - n + 1)
            code = code[:size] * self.base + flat[n - 1 :]
            whole = (owner[:size] == owner[n - 1 :]) & (code > 0)
            yield owner[:size][whole], code[whole]

    def __getstate__(self) -> dict:
        """Without the tables, which every process makes for itself."""
        return {k: v for k, v in vars(self).items() if k != "table" and not k.startswith("places")}

    def learn(self, texts: Sequence[str]) -> Grams:
        """Take the grams of these texts as the dictionary."""
        for n, (_, code) in enumerate(self.codes(texts)):
            self.grams[n] = np.unique(np.concatenate([self.grams[n], code]))
        self.size = sum(map(len, self.grams))
        return self

    def _find(self, n: int, code: np.ndarray) -> np.ndarray:
        """Place of each gram of n characters among those of its length, -1 if it is not in the dictionary."""
        grams, cells = self.grams[n - 1], self.base**n
        if not len(grams):
            return np.full(len(code), -1, np.int64)
        if cells <= TABLE_CELLS:
            name = f"places{n}"
            if not hasattr(self, name):
                places = np.full(cells, -1, np.int32)
                places[grams] = np.arange(len(grams))
                setattr(self, name, places)
            return getattr(self, name)[code]
        at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        return np.where(grams[at] == code, at, -1)

    def present(self, texts: Sequence[str]) -> np.ndarray:
        """texts x grams, 1 where the text holds the gram."""
        out = np.zeros((len(texts), self.size), np.float32)
        first = 0
        for n, (owner, code) in enumerate(self.codes(texts), 1):
            at = self._find(n, code)
            hit = at >= 0
            out[owner[hit], first + at[hit]] = 1
            first += len(self.grams[n - 1])
        return out


def kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared grams of each text and each landmark over the root of the product of their own numbers of grams."""
    shared = (present @ landmarks.T).astype(np.float64)
    own, theirs = present.sum(axis=1, dtype=np.float64), landmarks.sum(axis=1, dtype=np.float64)
    return shared / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(np.maximum(theirs, 1))[None, :]


class Classifier:
    """Kernel values against landmarks, brought to Nystrom features, and one linear function for each language."""

    def __init__(self, grams: Grams, landmark_texts: Sequence[str], languages: Sequence[str]):
        self.grams, self.languages = grams, list(languages)
        self.landmarks = grams.present(landmark_texts)
        weights, directions = np.linalg.eigh(kernel(self.landmarks, self.landmarks))
        kept = weights > LEAST_WEIGHT * weights.max() if len(weights) else np.zeros(0, bool)
        self.root = directions[:, kept] / np.sqrt(weights[kept])
        self.weights = np.zeros((self.root.shape[1] + 1, len(self.languages)))

    def __getstate__(self) -> dict:
        return vars(self) | {"landmarks": (np.packbits(self.landmarks.astype(bool), axis=1), self.landmarks.shape[1])}

    def __setstate__(self, state: dict) -> None:
        bits, n = state["landmarks"]
        vars(self).update(state | {"landmarks": np.unpackbits(bits, axis=1, count=n).astype(np.float32)})

    def slices(self, texts: Sequence[str]) -> Iterator[tuple[int, int]]:
        """Texts that are looked at together: bounded in characters and in cells of the presence matrix."""
        most = max(1, SLICE_CELLS // max(1, self.grams.size))
        for start, stop in slices([len(t) for t in texts], SLICE_CHARS):
            for a in range(start, stop, most):
                yield a, min(stop, a + most)

    def features(self, texts: Sequence[str]) -> np.ndarray:
        """Nystrom features and a constant."""
        near = kernel(self.grams.present(texts), self.landmarks) @ self.root
        return np.concatenate([near, np.ones((len(near), 1))], axis=1)

    def sums(self, texts: Sequence[str], languages: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ridge regression needs of these texts, for each language of theirs: F'F, and the sum of F, and their number."""
        f, own = self.features(texts), np.array([self.languages.index(x) for x in languages], np.int64)
        k, d = len(self.languages), f.shape[1]
        squares, first = np.zeros((k, d, d)), np.zeros((k, d))
        for c in np.unique(own):
            squares[c], first[c] = f[own == c].T @ f[own == c], f[own == c].sum(axis=0)
        return squares, first, np.bincount(own, minlength=k).astype(np.float64)

    def fit(self, squares: np.ndarray, first: np.ndarray, n: np.ndarray, ridge: float = RIDGE) -> Classifier:
        """Targets are 1 for a language's own texts and -1 for others; every language weighs the same."""
        weigh = 1 / np.maximum(n, 1) / max(1, (n > 0).sum())
        left = (squares * weigh[:, None, None]).sum(axis=0) + ridge * np.eye(squares.shape[1])
        means = first * weigh[:, None]
        right = 2 * means - means.sum(axis=0)[None, :]
        self.weights = np.linalg.solve(left, right.T)
        return self

    def predict(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language, score) of each text; the score is (1 + f) / 2 of its language, kept inside 0 to 1."""
        best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for start, stop in self.slices(texts):
            values = self.features(texts[start:stop]) @ self.weights
            best[start:stop] = values.argmax(axis=1)
            score[start:stop] = np.clip((1 + values.max(axis=1)) / 2, 0, 1)
        return best, score


def _letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lower-cased letters of the texts."""
    seen: set[str] = set()
    for batch in batches:
        for text in batch["_text"]:
            seen.update(text)
    low = {c.lower()[:1] for c in seen if LETTER.match(c)}
    yield pd.DataFrame({"letter": sorted(low)})


def train(
    labelled: DataFrame, fitted: int = FITTED, landmarks: int = LANDMARKS, longest: int = LONGEST, ridge: float = RIDGE
) -> Classifier | None:
    """Fit on `labelled` (_id, _h, _text, _lang): of each language the `fitted` texts that come first by a hash of id and
    text, of these the first `landmarks` as landmarks. None where no row has a language and a letter."""
    labelled = labelled.withColumn("_place", F.xxhash64("_id", "_h"))
    places = labelled.select("_lang", "_place").distinct()
    places = places.withColumn("_nth", F.row_number().over(W.partitionBy("_lang").orderBy("_place"))).filter(F.col("_nth") <= fitted)
    # One row for each language: up to which place its texts are taken, and up to which as landmarks.
    ends = places.groupBy(F.col("_lang").alias("_lang2")).agg(
        F.max("_place").alias("_last"), F.max(F.when(F.col("_nth") <= landmarks, F.col("_place"))).alias("_mark")
    )
    chosen = labelled.join(durable(ends), (F.col("_lang") == F.col("_lang2")) & (F.col("_place") <= F.col("_last")))
    chosen = durable(chosen.select("_text", "_lang", "_place", "_mark").dropDuplicates(["_lang", "_place"]))
    marks = chosen.filter(F.col("_place") <= F.col("_mark"))
    # A few texts of each language; their own letters are the alphabet.
    held = sorted((r["_lang"], r["_place"], r["_text"]) for r in marks.select("_lang", "_place", "_text").toLocalIterator())
    if not held:
        return None
    alphabet = sorted(r["letter"] for r in marks.select("_text").mapInPandas(_letters, "letter string").distinct().collect())
    grams = Grams("".join(alphabet), longest)
    languages = sorted({r[0] for r in held})
    for _, _, text in held:
        grams.learn([text])
    model = Classifier(grams, [r[2] for r in held], languages)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            texts, names = batch["_text"].tolist(), batch["_lang"].tolist()
            for start, stop in model.slices(texts):
                part = model.sums(texts[start:stop], names[start:stop])
                total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            yield pd.DataFrame({"sums": [np.concatenate([x.ravel() for x in total]).tobytes()]})

    # A task's sums are of the model's size, whatever it has read; the sample is bounded, and so are its tasks.
    parts = chosen.select("_text", "_lang").mapInPandas(gather, "sums binary").toLocalIterator()
    k, d = len(languages), model.root.shape[1] + 1
    total = np.zeros(k * d * d + k * d + k)
    for row in parts:
        total += np.frombuffer(row["sums"])
    return model.fit(total[: k * d * d].reshape(k, d, d), total[k * d * d : -k].reshape(k, d), total[-k:], ridge)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: Sequence[str] | None = None,
    fitted: int = FITTED,
    landmarks: int = LANDMARKS,
    longest: int = LONGEST,
    ridge: float = RIDGE,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with held_out, lang_pred and score added (replacing such names).

    Two texts are as near as the share of grams of 1 to `longest` characters that both hold (each counted once). Kernel
    values against landmark texts, brought to Nystrom features, are weighed by one ridge regression for each language against
    the others; the language of the largest value is the prediction, and (1 + value) / 2, kept inside 0 to 1, the score.

    Learned from rows with a language and a letter whose crc32(id as text) mod 3 is not 1 (held_out tells those that are; a
    null id is not): of each language the first `fitted` texts by a hash of id and text, a bound on the fit alone; a repeated
    row is learned from once. Whole texts
    are scored, also very long ones, one at a time. A null text, or one without a letter, is 'und' with score 0, and so is
    every text where nothing could be learned; ties go to the first language in order. Repeated rows are scored each. An
    empty table gives an empty result.
    """
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns, _held=F.coalesce(crc_of_id(column(id_col)) % 3 == 1, F.lit(False)), _lang=column(lang_col))
    letters = F.col("_text").rlike(r"\p{L}")
    labelled = rows.filter(~F.col("_held") & F.col("_lang").isNotNull() & letters).select("_id", "_h", "_text", "_lang")
    model = train(labelled, fitted, landmarks, longest, ridge)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            language, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            at = np.array([i for i, t in enumerate(texts) if model and has_letter(t)], np.int64)
            if len(at):
                best, score[at] = model.predict([texts[i] for i in at])
                language[at] = np.array(model.languages, object)[best]
            yield pd.DataFrame({"lang_pred": language, "score": score})

    judged = rows.select("_row", "_held", F.pandas_udf(judge, "lang_pred string, score double")("_text").alias("_j"))
    return unpacked(judged, columns, held_out=F.col("_held"), lang_pred=F.col("_j.lang_pred"), score=F.col("_j.score"))
