"""A hidden Markov language model over a corpus, and the unigram scores beside it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Words, column, crc_of_id, packed, slices, unpacked
from basketry.llm.common import frequent as common_words
from basketry.session import durable

STATES = 8
ROUNDS = 5
# How likely a state follows itself before training: high, so that states find what lasts, such as a text's language.
STAY = 0.7
# Frequent words with an emission of their own; all others are emitted as a class of words, then a word of the class.
SYMBOLS = 4096
CLASSES = 256
# The most words whose counts every task holds, the most frequent ones; the counts of all others are met by a join.
HELD_COUNTS = 65_536
SMOOTH = 0.1
SLICE_CHARS = 8_000_000
# Bytes of coded texts (two a token) whose steps are worked out side by side.
SLICE_BYTES = 1_200_000
END = -1  # the hash that stands for the end of a text


def tokens(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, first): words lower-cased in A-Z, each text closed by END; `first` is where each text begins."""
    words = Words([t.encode().lower() for t in texts])
    last = words.raw[words.ends - 1].astype(np.int64)
    before = np.where(words.ends - words.starts > 1, words.raw[words.ends - 2], 0).astype(np.int64)
    kind = (last * 131 + before) % CLASSES
    closes = words.first[1:]
    hashes = np.insert(words.hashes().view(np.int64), closes, END)
    return hashes, np.insert(kind, closes, 0), words.first + np.arange(len(texts) + 1)


def held_out(id_col: Column) -> Column:
    """Texts that nothing is learned from."""
    return F.coalesce(crc_of_id(id_col) % 10 == 0, F.lit(False))


def _count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["_text"].tolist()
        for start, stop in slices([len(t) for t in texts], SLICE_CHARS):
            hashes, kinds, _ = tokens(texts[start:stop])
            word, at, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pd.DataFrame({"word": word, "kind": kinds[at], "n": n})


class Vocabulary:
    """What every task needs of the counts; its size does not depend on the corpus."""

    def __init__(self, frequent: pd.DataFrame, kinds: pd.DataFrame, symbols: int = SYMBOLS):
        ranked = frequent.sort_values(["n", "word"], ascending=[False, True])
        ranked = ranked[ranked["word"] != END]
        own = np.sort(ranked["word"].to_numpy(np.int64)[:symbols])
        self.own = own
        self.size = 1 + len(own) + CLASSES  # the end is symbol 0
        ordered = frequent.sort_values("word")
        self.words = ordered["word"].to_numpy(np.int64)
        self.log = np.log10(ordered["n"].to_numpy(np.float64) + SMOOTH)
        # A class holds the words without a symbol of their own.
        rest = ranked.iloc[:symbols].groupby("kind")["n"].agg(["sum", "count"]).reindex(range(CLASSES), fill_value=0)
        total = kinds.set_index("kind").reindex(range(CLASSES), fill_value=0)
        tokens_left = total["tokens"].to_numpy(np.float64) - rest["sum"].to_numpy(np.float64)
        words_left = total["words"].to_numpy(np.float64) - rest["count"].to_numpy(np.float64)
        self.class_log = np.log10(tokens_left + SMOOTH * (words_left + 1))

    @staticmethod
    def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return at, table[at] == hashes

    def symbols(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        at, known = self._find(self.own, hashes)
        return np.where(hashes == END, 0, np.where(known, 1 + at, 1 + len(self.own) + kinds)).astype(np.uint16)


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols, active): the longest sequence first; symbols of one step side by side; how many go on at each."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.zeros(0, np.uint16)
    first = np.cumsum(sizes) - sizes
    step = np.arange(len(flat)) - np.repeat(first, sizes)
    rank = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty_like(flat)
    out[(np.cumsum(active) - active)[step] + rank] = flat
    return order, out, active


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbol by state

    @staticmethod
    def first(symbols: int, frequency: np.ndarray, states: int = STATES, stay: float = STAY) -> Model:
        """States that favour different symbols and successors; the same every time."""
        draw = np.random.RandomState(3)
        emit = (1.0 + 4.0 * (draw.randint(0, states, symbols)[:, None] == np.arange(states))) * frequency[:, None]
        move = draw.rand(states, states) + 0.5
        move = (1 - stay) * move / move.sum(axis=1, keepdims=True) + stay * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def _forward(self, symbols: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(alpha, scales, emissions) of all steps side by side; a step multiplies all sequences that go on at once."""
        emitted = self.emit[symbols]
        alpha, scales = np.empty_like(emitted), np.empty((len(symbols), 1))
        at, before = 0, None
        for n in active.tolist():
            here, scale = alpha[at : at + n], scales[at : at + n]
            if before is None:
                np.multiply(self.start, emitted[:n], out=here)
            else:
                np.matmul(before[:n], self.move, out=here)
                here *= emitted[at : at + n]
            np.add.reduce(here, axis=1, keepdims=True, out=scale)
            here /= scale
            before, at = here, at + n
        return alpha, scales[:, 0], emitted

    def likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of each sequence's probability, by the forward recursion with scaling."""
        order, symbols, active = _by_time(sequences)
        _, scales, _ = self._forward(symbols, active)
        # Step by step, so each sequence's terms are added in the order of its tokens.
        rank = np.arange(len(symbols)) - np.repeat(np.cumsum(active) - active, active)
        result = np.empty(len(sequences))
        result[order] = np.bincount(rank, np.log10(scales), len(sequences))
        return result

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the log10 likelihood of all."""
        _, symbols, active = _by_time(sequences)
        states = len(self.start)
        if not len(symbols):
            return np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emit), states)), 0.0
        alpha, scales, emitted = self._forward(symbols, active)
        emitted /= scales[:, None]
        # beta of every step; a sequence's last step has ones, which no later step overwrites.
        beta, back = np.ones_like(alpha), self.move.T.copy()
        first = (np.cumsum(active) - active).tolist()
        sizes = active.tolist()
        for t in range(len(sizes) - 1, 0, -1):
            at, n = first[t], sizes[t]
            here = emitted[at : at + n]
            here *= beta[at : at + n]
            np.matmul(here, back, out=beta[first[t - 1] : first[t - 1] + n])
        # What each token's next one sends back, times where the token is likely to be; all moves in one product.
        later = np.arange(sizes[0], len(symbols))
        own = later - np.repeat(np.array(sizes[:-1], np.int64), sizes[1:]) if len(sizes) > 1 else later
        moves = alpha[own].T @ emitted[sizes[0] :]
        alpha *= beta
        emits = np.stack([np.bincount(symbols, alpha[:, k], len(self.emit)) for k in range(states)], axis=1)
        return alpha[: sizes[0]].sum(axis=0), moves * self.move, emits, float(np.log10(scales).sum())

    def updated(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, frequency: np.ndarray) -> Model:
        """The next round's model; a little of each symbol's overall frequency keeps every probability above 0."""
        emit = emits + 1.0 * frequency[:, None]
        return Model(
            (starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
        )


def _sequences(symbols: Sequence[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(places, sequences) of similar length together, so that a step works on many of them."""
    order = np.argsort([-len(s) for s in symbols], kind="stable")
    for start, stop in slices([len(symbols[i]) for i in order], SLICE_BYTES):
        yield order[start:stop], [np.frombuffer(symbols[i], np.uint16) for i in order[start:stop]]


def baum_welch(
    coded: DataFrame, size: int, frequency: np.ndarray, rounds: int = ROUNDS, states: int = STATES, stay: float = STAY
) -> Model:
    """Train on the rows of `coded` (symbols). A task adds up the expected counts of all its texts; the sums over tasks,
    a row per symbol, come to the driver, so their size is that of the model."""
    model, names = Model.first(size, frequency, states, stay), [f"s{k}" for k in range(states)]
    context = coded.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast((model.start, model.move, model.emit))

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Model(*sent.value)
            sums = np.zeros((size + states + 1, states))
            for batch in batches:
                for _, sequences in _sequences(batch["symbols"].tolist()):
                    starts, moves, emits, _ = own.expected(sequences)
                    sums += np.concatenate([emits, moves, starts[None]])
            at = np.flatnonzero(sums.any(axis=1))
            yield pd.DataFrame({"item": at, **{n: sums[at, k] for k, n in enumerate(names)}})

        rows = coded.select("symbols").mapInPandas(gather, "item int, " + ", ".join(f"{n} double" for n in names))
        found = rows.groupBy("item").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        sums = np.zeros((size + states + 1, states))
        sums[found["item"].to_numpy()] = found[names].to_numpy()
        model = model.updated(sums[-1], sums[size:-1], sums[:size], frequency)
        sent.unpersist()
    return model


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    states: int = STATES,
    rounds: int = ROUNDS,
    symbols: int = SYMBOLS,
    held_counts: int = HELD_COUNTS,
    stay: float = STAY,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with held_out, n_tokens, n_known, train_tokens, base_score and score
    added (replacing columns of these names). Scores are log10 probabilities of the whole text and its end.

    base_score is the smoothed unigram score. score comes from a hidden Markov model: its states emit frequent words, or one
    of the classes that other words fall in by their last two bytes; a word of a class then has its smoothed share of it.
    Both learn from the rows that are not held out, all of them. Words are told apart by 64-bit hashes.

    Word counts grow with the corpus and are never held whole: the most frequent `held_counts` words go to every task, and
    each text's other words meet their counts in a join by word, where none is frequent. A null text is empty and consists of
    its end; a null id is not held out; without training rows all counts are 0. Repeated rows count and are scored each. An
    empty table gives an empty result.
    """
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns, _held=held_out(column(id_col)))
    learned = rows.filter(~F.col("_held")).select("_text")
    counts = learned.mapInPandas(_count, "word bigint, kind int, n bigint").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    counts = durable(counts)
    frequent = common_words(counts, held_counts).toPandas()
    ends = counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    kinds = counts.groupBy(F.when(F.col("word") == END, -1).otherwise(F.col("kind")).alias("kind"))
    kinds = kinds.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).toPandas()
    trained, distinct = int(kinds["tokens"].sum()), int(kinds["words"].sum())
    vocabulary = Vocabulary(frequent, kinds[kinds["kind"] >= 0], symbols)
    floor = float(np.log10(trained + SMOOTH * (distinct + 1)))
    end_log = float(np.log10(ends + SMOOTH))
    sent = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = Vocabulary.__new__(Vocabulary)
        vars(v).update(sent.value)
        for batch in batches:
            out = []
            texts = batch.tolist()
            for start, stop in slices([len(t) for t in texts], SLICE_CHARS // 2):
                hashes, kinds, first = tokens(texts[start:stop])
                symbol = v.symbols(hashes, kinds)
                at, held = v._find(v.words, hashes)
                ended = hashes == END
                log = np.where(ended, end_log, np.where(held, v.log[at] if len(v.log) else 0.0, 0.0))
                classed = symbol > len(v.own)
                inner = np.where(classed, np.where(held, log, 0.0) - v.class_log[kinds], 0.0)
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])
                known = held & ~ended | ended & (ends > 0)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), log, inner)]
                loose = ~held & ~ended
                cut = upto(loose)[first]
                far = hashes[loose]
                for i in range(stop - start):
                    word, n = np.unique(far[cut[i] : cut[i + 1]], return_counts=True)
                    part = symbol[first[i] : first[i + 1]]
                    out.append((len(part), *[x[i] for x in sums], part.tobytes(), word, n.astype(np.int32)))
            yield pd.DataFrame(out, columns=["tokens", "known", "log", "inner", "symbols", "far", "times"])

    coder = F.pandas_udf(code, "tokens bigint, known bigint, log double, inner double, symbols binary, far array<bigint>, times array<int>")
    coded = rows.select("_row", "_id", "_held", coder("_text").alias("_c")).select("_row", "_id", "_held", "_c.*")
    coded = durable(coded.withColumn("_nr", F.monotonically_increasing_id()))

    far = coded.select("_nr", F.explode(F.arrays_zip("far", "times")).alias("_f")).select("_nr", "_f.far", "_f.times")
    met = far.join(counts.select("word", "n"), far["far"] == counts["word"], "left")
    times = F.col("times")
    met = met.groupBy("_nr").agg(
        F.sum(times * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("far_log"),
        F.sum(F.when(F.col("n").isNotNull(), times).otherwise(0)).alias("far_known"),
    )
    met = met.select(F.col("_nr").alias("_nr2"), "far_log", "far_known")

    training = coded.filter(~F.col("_held"))
    frequency = _frequency(vocabulary, kinds, frequent, ends)
    model = baum_welch(training, vocabulary.size, frequency, rounds, states, stay)
    trained_model = docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own, found = Model(*trained_model.value), np.zeros(len(batch))
            for places, sequences in _sequences(batch.tolist()):
                found[places] = own.likelihood(sequences)
            yield pd.Series(found)

    hidden = F.pandas_udf(of, "double")("symbols")
    scored = coded.select("_row", "_id", "_held", "_nr", "tokens", "known", "log", "inner", hidden.alias("hidden"))
    both = scored.join(met, scored["_nr"] == met["_nr2"], "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    return unpacked(
        both,
        columns,
        held_out=F.col("_held"),
        n_tokens=F.col("tokens"),
        n_known=(F.col("known") + F.coalesce("far_known", F.lit(0))).cast("bigint"),
        train_tokens=F.lit(trained).cast("bigint"),
        base_score=F.col("log") + far_log - F.col("tokens") * floor,
        score=F.col("hidden") + F.col("inner") + far_log,
    )


def _frequency(vocabulary: Vocabulary, kinds: pd.DataFrame, frequent: pd.DataFrame, ends: int) -> np.ndarray:
    """The share of each symbol among the training tokens, smoothed."""
    n = np.zeros(vocabulary.size)
    n[0] = ends
    own = frequent.set_index("word")["n"].reindex(vocabulary.own).to_numpy(np.float64)
    n[1 : 1 + len(own)] = own
    n[1 + len(own) :] = np.maximum(10**vocabulary.class_log, 0)
    n += SMOOTH
    return n / n.sum()
