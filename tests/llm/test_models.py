"""Tokens, packing, neighbours, language model and toxicity, beside plain versions."""

import itertools
import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain
from basketry.llm import bpe, hmm, neighbours, packing, toxicity
from basketry.llm.common import Words
from basketry.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTES_FILE = public_tokenizers.path("byte_bpe_50k.json")


def scribble(n, seed=1):
    r = random.Random(seed)
    signs = "abcdeinrsth   \n\t\r\x0b\x1c\x85\xa0 EéüñßΣ'.,!1290½-—_あ漢字😀́"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return texts + ["", " ", "\n\n a", "it's WE'LL <|endoftext|><|startoftext|> x", "a" * 3000, "ΑΣ ΣΑΣ", "\0 a  b"]


def odd(docs):
    return docs.withColumns({c: F.lit("keep") for c in ("_id", "_h", "_row", "ids", "score", "a.b")})


def test_word_hashes_tell_words_apart():
    texts = [t.encode() for t in scribble(300)]
    words = Words(texts)
    plain_words = [w for t in texts for w in plain.WORD.findall(t.decode())]
    assert len(words) == len(plain_words)
    named = {}
    for word, h in zip(plain_words, words.hashes().tolist()):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)


def test_encoding_is_the_library_s(spark):
    theirs, texts = Tokenizer.from_file(WORDS_FILE), scribble(1500)
    rows = [*enumerate(texts), (None, None)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), WORDS_FILE).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == theirs.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_as_the_library_does():
    theirs, mine = Tokenizer.from_file(WORDS_FILE), bpe.Coder(WORDS_FILE)
    texts = [theirs.decode([i]).replace("</w>", "") for i in range(0, 49406, 7)]
    ids, bounds = mine.encode(texts)
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_small_merges_by_replay():
    def replay(word, merges):
        parts = list(word)
        while True:
            ranks = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
            if not ranks:
                return parts
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(5)
    for _ in range(60):
        words, merges = ["".join(r.choice("ab") for _ in range(12)) for _ in range(6)], []
        for _ in range(8):  # merges as training finds them: the commonest pair of what is merged so far
            pairs = Counter(p for w in words for q in [replay(w, merges)] for p in zip(q, q[1:]))
            if not pairs:
                break
            merges.append(min(pairs, key=lambda p: (-pairs[p], p)))
        vocab = {t: i for i, t in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in merges)])}
        coder = bpe.Merges(vocab, merges)
        for _ in range(30):
            word = "".join(r.choice("ab") for _ in range(r.randint(1, 14)))
            assert coder.encode(word) == [vocab[t] for t in replay(word, merges)], (merges, word)


def test_byte_ids_are_the_library_s():
    theirs, mine, texts = Tokenizer.from_file(BYTES_FILE), packing.ByteCoder(BYTES_FILE), scribble(3000, 2)
    r = random.Random(9)
    texts += ["".join(r.choice("ab é,.  \n\n\t'") for _ in range(30)) for _ in range(2000)]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in mine.encode(texts)] == want


def test_packing_covers_without_padding():
    r = random.Random(4)
    for length, n, top in ((16, 50, 40), (1024, 300, 3000), (1024, 1, 5), (8, 0, 1)):
        sizes = [r.randint(1, top) for _ in range(n)]
        pieces = packing.pack(sizes, length)
        ends, used, costs = {}, {}, Counter()
        for item, start, size, sequence, offset in sorted(pieces, key=lambda p: p[:2]):
            assert start == ends.get(item, 0) and size > 0
            ends[item] = start + size
        for item, start, size, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert offset == used.get(sequence, 0)
            used[sequence] = offset + size
            costs[sequence] += packing.cost(size)
        assert ends == dict(enumerate(sizes))
        assert all(u == length or u < length and u & (u - 1) == 0 for u in used.values())
        assert sum(u < length for u in used.values()) <= length.bit_length()


def test_cheapest_sequence_takes_the_next_longest():
    pieces = packing.pack([4, 4, 4, 4, 3, 3, 2], 12)
    at = {p[0]: p[3] for p in pieces}
    assert at[0] != at[1]  # the second goes to the sequence that has cost nothing yet


def test_no_piece_is_cut_while_a_sequence_has_room():
    r = random.Random(2)
    for median in (60, 150, 400):
        sizes = [max(1, round(r.lognormvariate(math.log(median), 1))) for _ in range(240_000 // median)]
        pieces = [p for p in packing.pack(sizes, 1024) if p[2] < 1024]
        room = {}
        for _, _, size, sequence, _ in pieces:
            room[sequence] = room.get(sequence, 0) + size
        costs = dict.fromkeys(sorted(room), 0.0)
        assert len(room) > 64
        ends = {}
        for item, start, size, sequence, _ in pieces:
            rest = sizes[item] - start
            open_to = [s for s in costs if room[s] >= rest] or [s for s in costs if room[s]]
            assert sequence == min(open_to, key=lambda s: (costs[s], s)) and size == min(rest, room[sequence])
            assert start == ends.get(item, sizes[item] // 1024 * 1024)
            ends[item] = start + size
            room[sequence] -= size
            costs[sequence] += packing.cost(size)


def test_packed_query(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (2, ""), (None, "x " * 3000), (1, "a b c")], "doc_id bigint, text string")
    theirs = Tokenizer.from_file(BYTES_FILE)
    out = packing.pack_documents(odd(docs.repartition(1)), BYTES_FILE).collect()
    assert {r["a.b"] for r in out} == {"keep"}
    assert sum(len(r["ids"]) for r in out) == sum(len(theirs.encode(r["text"] or "").ids) + 1 for r in docs.collect())
    small = QUERIES["op10_packing"](spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in small:
        ids = [*theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert len(ids) == r["doc_tokens"]
        assert plain.ids_crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]


def vectors(n, dim, seed):
    r = np.random.RandomState(seed)
    centres = r.normal(size=(8, dim))
    return centres[r.randint(0, 8, n)] * 0.7 + r.normal(size=(n, dim)) * r.uniform(0.5, 2.0, (n, 1))


def test_neighbours_against_all(spark):
    x = vectors(1500, 24, 0).astype(np.float32)
    x[100:160] = x[100]  # copies, more than k
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, []), (2005, [1.0, 2.0]), (2005, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    asked = frame.filter("vec_id % 20 = 0")
    found = neighbours.search(frame, asked, tables=16, probes=10, block_rows=64, block_queries=8).collect()
    scores = x.astype(np.float64) @ x.astype(np.float64).T
    hits = total = 0
    for q in range(0, 1500, 20):
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21)) and all(r["vec_id"] != q for r in got)
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        assert all(abs(r["score"] - scores[q, r["vec_id"]]) < 1e-9 for r in got)
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(scores[q, i], 9), i))[:20]
        hits += len(set(want) & {r["vec_id"] for r in got})
        total += 20
    assert hits / total >= 0.9
    assert {r["query_id"] for r in found} == set(range(0, 1500, 20))
    copy = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 140), key=lambda r: r["rank"])]
    assert copy == list(range(100, 120)) or scores[140].argmax() not in range(100, 160)
    assert neighbours.search(frame.limit(0), asked).count() == 0


def test_short_lists_are_filled(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").limit(21).collect()
    for n in (1, 10, 21):
        frame = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in table[:n]], "vec_id bigint, embedding array<float>")
        for how in ({}, {"block_rows": 12}, {"probes": 1}):
            found = neighbours.search(frame, frame, **how).collect()
            assert Counter(r["query_id"] for r in found) == {r["vec_id"]: n - 1 for r in table[: n if n > 1 else 0]}
            assert all(r["query_id"] != r["vec_id"] for r in found) and len({r[:2] for r in found}) == len(found)


def test_repeated_ids_count_as_their_smallest_vector(spark):
    x = vectors(60, 8, 3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    again = [(i, (v + 1).tolist()) for i, v in enumerate(x[:20])]  # larger in the first component, so these are not taken
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    both = spark.createDataFrame(again + rows + rows[:5], "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "query", "codes", "a.b")})
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(neighbours.search(frame, frame.filter("vec_id < 30"), k=5))
    assert key(neighbours.search(both, both.filter("vec_id < 30"), k=5)) == want


def test_recall_beside_a_few_very_long_vectors(spark):
    x = np.random.RandomState(5).normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::400] *= 5
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    found = neighbours.search(frame, frame.filter("vec_id % 20 = 7"), block_rows=400).collect()
    hits = 0
    for q in range(7, 1200, 20):
        want = [i for i in np.argsort(-(x @ x[q])) if i != q][:20]
        got = {r["vec_id"] for r in found if r["query_id"] == q}
        assert len(got) == 20
        hits += len(got & set(want))
    assert hits / 1200 >= 0.9


def test_neighbours_recall_on_the_table(spark):
    """Of the hashed search: the probes are few enough that a query meets well under all rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    found = QUERIES["op5_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits += len(want & {r["vec_id"] for r in found if r["query_id"] == ids[q]})
        total += 20
    assert hits / total >= 0.9
    held = neighbours.index(table, "vec_id", "embedding", 20, neighbours.TABLES, neighbours.BAND)
    assert held.count() == len(rows) and all(len(r["codes"]) == neighbours.TABLES for r in held.limit(5).collect())
    asked = neighbours._asked(neighbours.cleaned(table.filter("vec_id % 20 = 0"), "vec_id", "embedding"))
    probes = neighbours.probes_for(asked, held, 20, neighbours.TABLES, neighbours.RECALL, neighbours.SAMPLE, neighbours.BLOCK_ROWS).first()
    assert probes["measured"] >= neighbours.RECALL
    unit = neighbours.lifted(x, np.ones(len(x)) * (1 + 1e-9), False)
    asks = neighbours.lifted(x[ids % 20 == 0], np.ones(len(x)), True)
    met = np.zeros((len(asks), len(x)), bool)
    for t in range(neighbours.TABLES):
        looks = neighbours.axes(asks, t, probes["probes"])
        met |= (looks[:, :, None] == neighbours.axes(unit, t, 1)[None, None, :, 0]).any(axis=1)
    print("probes", probes, "met", met.mean(), "recall", hits / total)
    assert met.mean() < 0.6


def test_pseudo_rotation_keeps_lengths():
    x = np.random.RandomState(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    top = neighbours.axes(x, 1, 64)
    turned = neighbours.rotated(x, 1)
    near = np.take_along_axis(np.stack([turned, -turned], axis=2).reshape(5, -1), top, axis=1)
    assert (np.diff(near, axis=1) <= 1e-12).all() and sorted(top[0]) == list(range(64))


def test_forward_and_expected_counts_by_enumeration():
    r = np.random.RandomState(2)
    own = lambda *shape: (lambda m: m / m.sum(axis=-1, keepdims=True))(r.rand(*shape) + 0.1)
    model = hmm.Model(own(3), own(3, 3), own(3, 5).T)
    texts = [r.randint(0, 5, n).astype(np.uint16) for n in (4, 1, 3, 4, 2)]
    got = model.likelihood(texts)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for text, score in zip(texts, got):
        paths = {}
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
            paths[path] = p * np.prod([model.emit[s, k] for s, k in zip(text, path)])
        total = sum(paths.values())
        assert math.isclose(score, math.log10(total), rel_tol=1e-12)
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for s, k in zip(text, path):
                emits[s, k] += p / total
    a, b, c, total = model.expected(texts)
    assert np.allclose(a, starts) and np.allclose(b, moves) and np.allclose(c, emits)
    assert math.isclose(total, got.sum(), rel_tol=1e-12)


def test_language_model(spark):
    r = random.Random(0)
    texts = [" ".join(r.choice(["the", "a"]) + " " + r.choice(["cat", "dog", f"n{r.randint(0, 40)}"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, "unseenword other"), (None, "The CAT\x0bé É"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    held = lambda i: i is not None and plain.crc(i) % 10 == 0
    coded = lambda t: [*plain.words((t or "").translate(plain.LOWER)), "</end>"]
    counts = Counter(w for i, t in rows if not held(i) for w in coded(t))
    total, distinct = sum(counts.values()), len(counts)
    for held_counts, rounds in ((hmm.HELD_COUNTS, 30), (10, 2)):  # the second leaves most counts to the join
        got = hmm.score_documents(odd(docs), held_counts=held_counts, symbols=8, rounds=rounds, stay=0.0).collect()
        assert len(got) == len(rows)
        texts_of = {(i, t) for i, t in rows}
        better = []
        for g in got:
            assert (g["doc_id"], g["text"]) in texts_of and g["a.b"] == "keep"
            ws = coded(g["text"])
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
            assert (g["held_out"], g["n_tokens"], g["n_known"]) == (held(g["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws))
            assert g["train_tokens"] == total and math.isclose(g["base_score"], base, rel_tol=1e-9)
            assert g["score"] < 0
            if g["held_out"] and len(ws) > 20:
                better.append(g["score"] - g["base_score"])
        assert rounds < 10 or sum(better) > 5  # words alternate, which a unigram score can't see
    assert hmm.score_documents(docs.limit(0)).count() == 0
    assert hmm.score_documents(docs.filter("doc_id = 1001")).count() == 1


def test_class_shares_make_a_distribution():
    """Over all known words and one unknown word of each class, the model's one-word texts add up to at most 1."""
    import pandas as pd

    counts = pd.DataFrame({"word": [-1, 10, 11, 12, 13], "kind": [0, 1, 1, 2, 2], "n": [5, 9, 4, 2, 1]})
    kinds = pd.DataFrame({"kind": [1, 2], "tokens": [13, 3], "words": [2, 2]})
    v = hmm.Vocabulary(counts, kinds, symbols=1)
    shares = {k: [] for k in (1, 2)}
    for word, kind, n in ((11, 1, 4), (12, 2, 2), (13, 2, 1)):
        shares[kind].append(10 ** (math.log10(n + 0.1) - v.class_log[kind]))
    for kind in (1, 2):
        assert math.isclose(sum(shares[kind]) + 0.1 / 10 ** v.class_log[kind], 1.0)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, d).collect()
    marks = dict(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").collect())
    assert all(r["held_out"] == (plain.crc(r["doc_id"]) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    judged = [(marks[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in marks]
    right = sum(a == b for a, b in judged) / len(judged)
    caught = [b for a, b in judged if a]
    assert right >= 0.95 and sum(caught) / max(1, len(caught)) >= 0.6


def test_swapping_groups_changes_little(spark):
    r = random.Random(1)
    neutral = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [r.choice(neutral) for _ in range(20)]
        # Labels lean on a group term although only the insult makes a text toxic.
        if toxic:
            words.insert(5, "scum")
        if r.random() < (0.9 if toxic else 0.1):
            words.insert(8, "muslim")
        elif r.random() < 0.4:
            words.insert(8, "person")
        rows.append((i, " ".join(words) + "."))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    test = spark.createDataFrame(
        [(9001, "w1 w2 muslim w3."), (9002, "w1 w2 human w3."), (9003, "you scum w4."), (9004, None), (9005, ""), (None, "scum")],
        "doc_id bigint, text string",
    )
    out = toxicity.score_documents(odd(docs.unionByName(test)), labels)
    got = {r["doc_id"]: r for r in out.filter("doc_id > 9000").collect()}
    assert abs(got[9001]["score"] - got[9002]["score"]) < 0.15 and got[9001]["predicted"] == 0
    assert got[9003]["predicted"] == 1 and got[9004]["score"] == got[9005]["score"] < 0.5
    assert got[9001]["a.b"] == "keep" and out.count() == 606
    assert toxicity.score_documents(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_swaps_keep_the_rest():
    pairs = toxicity.swapped("A woman left. Nobody came! The people stay")
    assert [a.split() != b.split() for a, b in pairs] == [True, True]
    assert all(len(a.split()) == len(b.split()) for a, b in pairs)


def test_toxicity_features_and_score_beside_plain():
    texts = ["", "Hello, (HELLO) hello... helloing", "-- ?! !", "éclair's ÉCLAIR a\tb\x0cc", "one two " * 40, "x" * 30_000]
    feature, owner = toxicity.present(texts)
    for i, text in enumerate(texts):
        assert set(feature[owner == i].tolist()) == plain.toxicity_features(text)
    r = np.random.default_rng(3)
    weights = np.where(r.random(toxicity.FEATURES) < 0.5, r.normal(size=toxicity.FEATURES), 0).astype(np.float32)
    got = toxicity.scores(texts, weights, -0.25)
    for text, score in zip(texts, got):
        z = -0.25 + math.fsum(float(weights[f]) for f in plain.toxicity_features(text))
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_toxicity_fit_reaches_the_least_loss():
    r = np.random.default_rng(5)
    chosen = np.array([2, 7, 11, 40])
    rows = [chosen[r.random(4) < 0.5] for _ in range(60)]
    toxic = np.array([float(7 in x) if r.random() < 0.9 else float(r.random() < 0.5) for x in rows])
    weight = r.uniform(0.5, 2, 60)
    swaps, share = [(np.array([7, 3]), np.array([11])), (np.array([2]), np.array([], np.int64))], np.array([3.0, 1.0])
    w, bias = toxicity.fit(rows, toxic, weight, swaps, share, chosen, 0.01, 0.5)

    def loss(w, bias):
        of = dict(zip(chosen.tolist(), w))
        z = [bias + sum(of[f] for f in x) for x in rows]
        log_loss = sum(u * math.log(1 + math.exp(-v if y else v)) for u, v, y in zip(weight, z, toxic)) / weight.sum()
        moved = [sum(of.get(f, 0) for f in b) - sum(of.get(f, 0) for f in a) for a, b in swaps]
        return log_loss + 0.01 * sum(x * x for x in w) + 0.5 * sum(s * m * m for s, m in zip(share, moved)) / share.sum()

    least = loss(w, bias)
    for i in range(5):
        for step in (-0.05, 0.05):
            other = np.append(w, bias)
            other[i] += step
            assert loss(other[:4], other[4]) > least


def test_all_swaps_of_a_text_count_as_one_text():
    wanted = np.ones(toxicity.FEATURES, bool)
    texts = ["", "no group here.", "A woman left.", "A woman left. " * 50 + "The people stay! A woman, a woman."]
    for text in texts:
        pairs = toxicity.swapped(text)
        moved = Counter()
        for a, b in pairs:
            a, b = plain.toxicity_features(a), plain.toxicity_features(b)
            moved[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
        got = toxicity.differences(text, wanted)
        assert got == {d: n / moved.total() for d, n in moved.items()}
        assert not got or math.isclose(sum(got.values()), 1)
    assert len(toxicity.swapped(texts[-1])) == 52 and len(got) == 3


@pytest.mark.parametrize("operate", [lambda d: bpe.encode(d, WORDS_FILE), lambda d: packing.pack_documents(d, BYTES_FILE)])
def test_empty_table(spark, operate):
    assert operate(spark.createDataFrame([], SCHEMA)).count() == 0
