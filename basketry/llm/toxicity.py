"""A toxicity classifier that is fitted to ignore which group a sentence mentions."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Words, column, crc_of_id, keyed, packed, slices, unpacked
from basketry.session import durable

# Labelled documents of each class that the classifier is fitted on, about; which ones depends on a hash of the id.
SAMPLE_DOCS = 8000
BUCKETS = 1 << 18
# A feature of its own for a bucket met at least once, twice and three times in a text.
LEVELS = 3
FEATURES = LEVELS * BUCKETS
CHOSEN = 4096
STEMS = (4, 5, 6, 7, 8)
MIN_DOCS = 3
MIN_G = 9.0
THRESHOLD = 0.7
RIDGE = 1e-5
SWAP_WEIGHT = 4.0
ROUNDS = 400
SLICE_CHARS = 2_000_000

# Terms for groups of people beside neutral ones. Terms of a set may stand for one another in a sentence.
IDENTITY_SETS = (
    ("person", "woman", "man", "girl", "boy", "lesbian", "transgender", "immigrant", "refugee"),
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gays", "lesbians"),
    ("human", "black", "white", "asian", "latino", "arab", "african", "muslim", "christian", "jewish", "gay", "disabled"),
    ("personne", "femme", "homme", "musulman", "chrétien", "juif", "immigré", "réfugié"),
    ("mensch", "frau", "mann", "muslim", "christ", "jude", "einwanderer", "flüchtling"),
    ("persona", "mujer", "hombre", "musulmán", "cristiano", "judío", "inmigrante", "refugiado"),
)

SENTENCE = re.compile(r"[^.!?\n]+")
TERM = re.compile(r"\w+")
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def buckets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word: the word without marks around it, and each of its beginnings of STEMS bytes
    that more follows, so that a stem's inflected forms count together and the stem as a word of its own apart."""
    words = Words([t.lower().encode() for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    starts, ends = words.starts.copy(), words.ends.copy()
    while True:
        led = (starts < ends) & _MARKS[words.raw[starts]]
        trailed = (starts + led < ends) & _MARKS[words.raw[ends - 1]]
        if not (led.any() or trailed.any()):
            break
        starts, ends = starts + led, ends - trailed
    real = starts < ends
    words.starts, words.ends, owner = starts[real], ends[real], owner[real]
    mask = np.uint64(BUCKETS - 1)
    found, owners = [(words.hashes() & mask).astype(np.int64)], [owner]
    for n in STEMS:
        longer = words.ends - words.starts > n
        words.starts, words.ends, owner = words.starts[longer], words.ends[longer], owner[longer]
        begins = words.hashes(words.starts + n)
        found.append((((begins >> np.uint64(2 * n)) ^ np.uint64(n * 0x9E37)) & mask).astype(np.int64))
        owners.append(owner)
    return np.concatenate(found), np.concatenate(owners)


def present(texts: Sequence[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) for all features of each text; only those marked in `wanted` if given."""
    bucket, owner = buckets(texts)
    if wanted is not None:
        keep = wanted.reshape(LEVELS, BUCKETS).any(axis=0)[bucket]
        bucket, owner = bucket[keep], owner[keep]
    both, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
    reached = [both[times > level] for level in range(LEVELS)]
    feature = np.concatenate([x % BUCKETS + level * BUCKETS for level, x in enumerate(reached)])
    owner = np.concatenate([x // BUCKETS for x in reached])
    if wanted is not None:
        keep = wanted[feature]
        feature, owner = feature[keep], owner[keep]
    return feature, owner


FOLLOWING = {t: s[(i + 1) % len(s)] for s in IDENTITY_SETS for i, t in enumerate(s)}


def swapped(text: str) -> list[tuple[str, str]]:
    """Every sentence with a group term, beside the same with the next term of its set."""
    held = [s for s in SENTENCE.findall(text.lower()) if any(t in FOLLOWING for t in TERM.findall(s))]
    return [(s, TERM.sub(lambda m: FOLLOWING.get(m[0], m[0]), s)) for s in held]


def differences(text: str, wanted: np.ndarray) -> dict[tuple[tuple[int, ...], tuple[int, ...]], float]:
    """(features lost, features gained) by a swap -> its share of the text's sentences that change at all.

    A change of score depends on these features alone, so that sentences with equal ones count as one, and the shares of
    a text add up to 1 whatever its length.
    """
    pairs = swapped(text)
    times: Counter = Counter()
    for start, stop in slices([len(a) + len(b) for a, b in pairs], SLICE_CHARS):
        sides = []
        for side in (0, 1):
            feature, owner = present([p[side] for p in pairs[start:stop]], wanted)
            sides.append(set(zip(owner.tolist(), feature.tolist())))
        lost, gained = defaultdict(list), defaultdict(list)
        for into, found in ((lost, sides[0] - sides[1]), (gained, sides[1] - sides[0])):
            for owner, feature in found:
                into[owner].append(feature)
        for owner in lost.keys() | gained.keys():
            times[tuple(sorted(lost[owner])), tuple(sorted(gained[owner]))] += 1
    total = times.total()
    return {d: n / total for d, n in times.items()}


def fit(
    rows: list[np.ndarray],
    toxic: np.ndarray,
    weight: np.ndarray,
    swaps: list[tuple[np.ndarray, np.ndarray]],
    share: np.ndarray,
    chosen: np.ndarray,
    ridge: float = RIDGE,
    swap_weight: float = SWAP_WEIGHT,
) -> tuple[np.ndarray, float]:
    """Logistic weights of the chosen features, and the bias. Loss: weighted log loss + ridge * |w|^2 + swap_weight *
    mean squared change of a sentence's log odds when its group terms are swapped; `share` says how much each swap
    (features lost, features gained) counts in that mean. Full-batch Adam, always the same."""
    place = np.full(FEATURES, -1)
    place[chosen] = np.arange(len(chosen))
    item = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = place[np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)]
    item, feature = item[feature >= 0], feature[feature >= 0]
    pair = np.concatenate([np.repeat(np.arange(len(swaps)), [len(s[k]) for s in swaps]) for k in (0, 1)]) if swaps else item[:0]
    other = place[np.concatenate([s[k] for k in (0, 1) for s in swaps]).astype(np.int64)] if swaps else feature[:0]
    sign = np.repeat([-1.0, 1.0], [sum(len(s[k]) for s in swaps) for k in (0, 1)])
    pair, sign, other = pair[other >= 0].astype(np.int64), sign[other >= 0], other[other >= 0]
    n, total = len(chosen), max(weight.sum(), 1e-9)
    share = share / max(share.sum(), 1e-9)
    rate = np.clip((weight * toxic).sum() / total, 1e-3, 1 - 1e-3)
    w, bias = np.zeros(n), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(item, w[feature], len(rows))
        wrong = weight * (1 / (1 + np.exp(-z)) - toxic) / total
        slope = np.bincount(feature, wrong[item], n) + 2 * ridge * w
        if swaps:
            change = np.bincount(pair, sign * w[other], len(swaps))
            slope += swap_weight * 2 * np.bincount(other, sign * (share * change)[pair], n)
        g = np.append(slope, wrong.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:n], bias - step[n]
    return w, bias


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        texts, toxic = batch["_text"].tolist(), batch["toxic"].to_numpy()
        for start, stop in slices([len(t) for t in texts], SLICE_CHARS):
            feature, owner = present(texts[start:stop])
            for c in (0, 1):
                seen[c] += np.bincount(feature[toxic[start:stop][owner] == c], minlength=FEATURES)
    at = np.flatnonzero(seen.sum(axis=0))
    yield pd.DataFrame({"feature": at, "clean": seen[0][at], "toxic": seen[1][at]})


def _evidence(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Log-likelihood ratio (G) of a feature's presence in either class against the same rate in both."""
    share = n_toxic / (n_clean + n_toxic)
    held = clean + toxic
    missing = n_clean + n_toxic - held

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (
        term(toxic, held * share) + term(clean, held * (1 - share)) + term(n_toxic - toxic, missing * share)
        + term(n_clean - clean, missing * (1 - share))
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    toxic_col: str,
    sample_docs: int = SAMPLE_DOCS,
    most_features: int = CHOSEN,
    min_docs: int = MIN_DOCS,
    min_g: float = MIN_G,
):
    """(weight of every feature, bias) from labelled documents; None if the labels do not hold both classes.

    About `sample_docs` documents of each class are used, all if there are fewer; a document with any label 1 is toxic.
    Features are chosen by how surely they tell the classes apart: the `most_features` best of those in `min_docs`
    documents or more with a G of at least `min_g`. All sentences with a group term are swapped, and a text counts
    for the same however many it has. What reaches the driver is bounded by the sample, by `most_features` of each
    document and by the different swaps of its sentences.
    """
    marks = labels.filter(column(id_col).isNotNull() & column(toxic_col).isin(0, 1))
    marks = durable(marks.groupBy(column(id_col).alias("_lid")).agg(F.max(column(toxic_col)).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample_docs / sizes[1])).otherwise(min(1.0, sample_docs / sizes[0]))
    picked = marks.filter(F.pmod(F.xxhash64("_lid"), F.lit(1_000_000)) < share * 1_000_000)
    rows = keyed(docs, id_col, text_col)
    # At most about two samples of ids, whatever the table.
    sample = durable(rows.join(F.broadcast(picked), rows["_id"] == picked["_lid"]).select("_text", "toxic"))
    counted = sample.mapInPandas(_counts, "feature bigint, clean bigint, toxic bigint")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(held) < 2:
        return None
    strong = counted.withColumn("g", _evidence(F.col("clean"), F.col("toxic"), held[0], held[1]))
    strong = strong.filter((F.col("clean") + F.col("toxic") >= min_docs) & (F.col("g") >= min_g))
    best = strong.orderBy(F.desc("g"), "feature").limit(most_features).select("feature").toPandas()
    chosen = np.sort(best["feature"].to_numpy())
    wanted = np.zeros(FEATURES, bool)
    wanted[chosen] = True

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["_text"], batch["toxic"]):
                changes = differences(text, wanted)
                out.append((toxic, present([text], wanted)[0].tolist(), list(changes), list(changes.values())))
            yield pd.DataFrame(out, columns=["toxic", "features", "swaps", "shares"])

    shape = "toxic int, features array<bigint>, swaps array<array<array<bigint>>>, shares array<double>"
    found = sample.mapInPandas(reduce, shape).collect()
    found.sort(key=lambda r: (r["toxic"], r["features"]))
    toxic = np.array([r["toxic"] for r in found], float)
    weight = np.where(toxic == 1, sizes[1] / held[1], sizes[0] / held[0])
    shares = defaultdict(list)
    for r in found:
        for (lost, gained), share in zip(r["swaps"], r["shares"]):
            shares[tuple(lost), tuple(gained)].append(share)
    swaps = [tuple(np.array(x, np.int64) for x in d) for d in sorted(shares)]
    share = np.array([math.fsum(shares[d]) for d in sorted(shares)])
    w, bias = fit([np.array(r["features"], np.int64) for r in found], toxic, weight, swaps, share, chosen)
    full = np.zeros(FEATURES, np.float32)
    full[chosen] = w
    return full, bias


def scores(texts: Sequence[str], weights: np.ndarray, bias: float) -> np.ndarray:
    feature, owner = present(texts, weights != 0)
    z = bias + np.bincount(owner, weights[feature].astype(np.float64), len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out(id_col: Column) -> Column:
    """Documents that no label is learned from."""
    return F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    carry: Sequence[str] | None = None,
    threshold: float = THRESHOLD,
    sample_docs: int = SAMPLE_DOCS,
    **choice,
) -> DataFrame:
    """The columns `carry` of `docs` (all if not given) with held_out, score and predicted added (replacing such names).

    Learns from `labels` (id, 0/1) of documents that are not held out; the score depends on the text alone. Words are cut
    to stems by their first bytes, so inflected forms count together. Null and empty texts get the score of no evidence;
    without labels of both classes every score is 0. A null id is not held out. Repeated rows are scored alike; an empty
    table gives an empty result. A text of any length is read whole, in one slice of its own beyond SLICE_CHARS.
    `choice` goes to `train` (most_features, min_docs, min_g).
    """
    model = train(docs, labels.filter(~held_out(column(id_col))), id_col, text_col, toxic_col, sample_docs, **choice)
    columns = list(docs.columns if carry is None else carry)
    rows = packed(docs, id_col, text_col, columns)
    if model is None:
        score = F.lit(0.0)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights, bias = sent.value
            for texts in batches:
                parts = [scores(texts[a:b].tolist(), weights, bias) for a, b in slices(texts.str.len().tolist(), SLICE_CHARS)]
                yield pd.Series(np.concatenate([*parts, np.zeros(0)]))

        score = F.pandas_udf(of, "double")("_text")
    scored = rows.select("_row", "_id", score.alias("_score"))
    return unpacked(
        scored,
        columns,
        held_out=held_out(F.col("_id")),
        score=F.col("_score"),
        predicted=(F.col("_score") >= threshold).cast("int"),
    )
