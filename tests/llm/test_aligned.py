"""Hard negatives, two tokenizers side by side, and languages, beside plain versions."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain
from basketry.llm import alignment, hard_negatives, language
from basketry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTES_FILE, PIECES_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id bigint, embedding array<double>, label int"


# Hard negatives


def sums(rows, every, **bounds):
    return [tuple(r) for r in plain.hard_negatives(rows, lambda i: i % every == 0, **bounds)]


def mined(spark, rows, every, schema=VECTORS, **how):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **how).collect())


def vectors(n, dim, seed, labels=3, wide=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, wide) for _ in range(dim)], r.randrange(labels)) for i in range(n)]


def test_hard_negatives_are_the_plain_ones(spark):
    rows = vectors(160, 4, 1)
    rows += [(1000 + i, list(rows[8][1]), i % 2) for i in range(40)]  # a group of copies, under two labels
    want = sums(rows, 4)
    assert len(want) > 200 and len({w[0] for w in want}) > 20
    assert mined(spark, rows, 4) == want
    assert mined(spark, rows, 4, block_rows=16, block_anchors=8, sorted_pairs=50) == want
    assert mined(spark, rows, 4, positives=2, negatives=1, floor=10, ceiling=99, block_rows=32) == sums(rows, 4, positives=2, negatives=1, floor=10, ceiling=99)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 3, 2, labels=2)
    bad = [(100, None, 1), (104, [1.0, None, 2.0], 1), (108, [nan, 1.0, 1.0], 0), (112, [inf, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 1), (116, [1.0, 2.0, 3.0], None)]
    zero = [(200, [0.0, 0.0, 0.0], 0), (204, [-0.0, 0.0, 0.0], 1), (208, [], 0), (212, [], 1), (216, [], 0), (220, [1.0], 0), (224, [3.0], 0), (228, [2.0], 1)]
    want = sums(rows + zero, 4)
    assert any(w[4] == 0 for w in want) and any(w[0] == 220 for w in want)
    assert mined(spark, rows + bad + zero, 4) == want
    assert mined(spark, rows + rows + zero, 4, block_rows=8) == want  # repeated rows change nothing
    assert mined(spark, [], 4) == []
    assert mined(spark, [(0, [1.0], 1)], 4) == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0], 0), (9, [1.0, 0.0], 0), (5, [1.0, 0.0], 0)] + [(20 - i, [0.75, 1.0], 1) for i in range(1, 8)]
    got = mined(spark, rows, 50, block_rows=2)
    assert [r[1:4] for r in got] == [(5, 1, 13), (5, 2, 14), (5, 3, 15), (9, 1, 13), (9, 2, 14), (9, 3, 15)]


def test_scores_beyond_floating_point_are_exact(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-(2**21), 2**21)) for _ in range(6)], r.randrange(2)) for i in range(60)]
    want = sums(rows, 3)
    assert max(w[4] for w in want) > 2**53 and mined(spark, rows, 3, block_rows=16) == want
    assert mined(spark, [*rows, (300, [1e30] * 6, 1)], 3) == want  # its scores fit no long


def test_keys_sort_as_asked():
    r = random.Random(4)
    some = [(r.choice([-3, 0, 7, 2**62]), r.randrange(-5, 5) * 2**40, r.random() < 0.5, r.randrange(-9, 9)) for _ in range(500)]
    keys = [hard_negatives.packed_key(*s) for s in some]
    assert [hard_negatives.unpacked_key(k) for k in sorted(keys)] == sorted(some, key=lambda s: (s[0], -s[1], s[2], s[3]))


def test_clashing_columns_do_not_matter(spark):
    rows = vectors(60, 3, 5)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "dim", "anchor", "row", "score", "held", "a.b")})
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 4 == 0).collect()) == sums(rows, 4)


# Two tokenizers


def aligned_plainly(rows):
    a_coder, b_coder = Tokenizer.from_file(BYTES_FILE), SentencePieceProcessor(model_file=PIECES_FILE)
    a_coder.encode_special_tokens = True
    return plain.aligned([t for _, t in rows], a_coder, b_coder)


TEXTS = [
    "Thé quick  brown\n\nfox; it's été, naïve — 東京 😀 ok",
    "the the theatre of the absurd",
    "the the theatre of the absurd",
    "",
    None,
    " ",
    "▁odd",
    "<|endoftext|> <s> </s> <0x41>",
    "\0\t\r\x0b x",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
]


def scribble(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeinrsth   \n\tEéüñß.,!129あ漢😀́") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_alignment_is_the_plain_one(spark):
    rows = list(enumerate(TEXTS + scribble(60, 1) + ["the cat and the hat " * 3000]))
    rows.append((None, "the cat"))
    want = aligned_plainly(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("keep") for c in ("_id", "_row", "_nr", "groups", "n_a", "pair", "a.b")})
    for held in (alignment.HELD_PAIRS, 20, 0):
        got = alignment.align(docs, BYTES_FILE, PIECES_FILE, held_pairs=held)
        assert got.columns[:2] == ["doc_id", "text"] and got.filter("_id = 'keep' and `a.b` = 'keep' and _nr = 'keep'").count() == len(rows)
        found = {(r["doc_id"], r["text"]): r for r in got.collect()}
        assert len(found) == len(rows)
        for (i, text), w in zip(rows, want):
            r = found[i, text]
            assert {k: r[k] for k in w} == w, (i, text[:50] if text else text)
    assert want[1]["count_sum"] > want[1]["n_links"] and want[1] == want[2] and not want[6]["n_a"]


def test_groups_spell_the_text():
    both = alignment.Coders(BYTES_FILE, PIECES_FILE)
    for text, (a, b) in zip(TEXTS[:3], both.encode(TEXTS[:3])):
        ends = [np.cumsum([len(t[i]) for i in ids]) for t, ids in ((both.a_bytes, a), (both.b_bytes, b))]
        a_cut, b_cut = alignment.cuts(ends[0].tolist(), ends[1].tolist())
        for i, k in zip(a_cut, b_cut):
            assert b"".join(both.a_bytes[x] for x in a[: i + 1]) == b"".join(both.b_bytes[x] for x in b[: k + 1])
        pairs = set(zip(*(x.tolist() for x in alignment.links(*ends, np.array(a_cut), np.array(b_cut)))))
        assert pairs == plain.overlaps([len(both.a_bytes[i]) for i in a], [len(both.b_bytes[i]) for i in b])


def test_groups_of_many_texts_are_marked_at_once():
    both = alignment.Coders(BYTES_FILE, PIECES_FILE)
    coded = list(both.encode([*TEXTS[:4], "", "the house", ""]))
    marks = list(alignment.group_marks(coded, both.a_joined.sizes, both.b_joined.sizes))
    assert len(marks) == len(coded)
    for (a, b), (a_marks, b_marks) in zip(coded, marks):
        ends = [np.cumsum(sizes[ids]).tolist() for sizes, ids in ((both.a_joined.sizes, a), (both.b_joined.sizes, b))]
        a_cut, b_cut = alignment.cuts(*ends)
        assert np.flatnonzero(a_marks).tolist() == a_cut and np.flatnonzero(b_marks).tolist() == b_cut
    nothing = list(alignment.group_marks(coded[4:5], both.a_joined.sizes, both.b_joined.sizes))
    assert [len(x) for x in nothing[0]] == [0, 0]


def test_alignment_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(empty, BYTES_FILE, PIECES_FILE).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {(r["n_a"], r["n_links"], r["count_sum"], r["groups"]) for r in alignment.align(nothing, BYTES_FILE, PIECES_FILE).collect()} == {(0, 0, 0, "")}


def test_alignment_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = aligned_plainly([tuple(r) for r in docs])
    got = {r["doc_id"]: r for r in QUERIES["op12_cross_tokenizer"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        r = got[d["doc_id"]]
        sha = hashlib.sha256(w["groups"].encode()).hexdigest() if w["groups"] else ""
        assert r["groups_sha256"] == sha and all(r[k] == w[k] for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))


# Languages


def test_features_and_scores_are_the_plain_ones():
    texts = ["Das ist ein Haus", "the house is red", "la casa roja", "HAUS!! haus", "Ελλάδα ok", "a", "ein 12 ein", "x" * 5000]
    names = ["de", "en", "es", "de", "el", "en", "de", "en"]
    marks = texts[:5]
    grams = language.Grams("".join(sorted({c for t in marks for c in t.lower() if c.isalpha()})))
    for t in marks:
        grams.learn([t])
    held = [plain.grams(t, set(grams.letters), language.LONGEST) for t in marks]
    known = set().union(*held)
    assert grams.size == len(known)
    model = language.Classifier(grams, marks, sorted(set(names)))
    others = ["", "qué casa", "Haus 東京 house", *texts]
    near = language.kernel(grams.present(others), model.landmarks)
    want = [plain.shared_grams(plain.grams(t, set(grams.letters), language.LONGEST) & known, h) for t in others for h in held]
    assert np.allclose(near.ravel(), want)
    model.fit(*[sum(x) for x in zip(model.sums(texts[:3], names[:3]), model.sums(texts[3:], names[3:]))])
    values = plain.ridge(near[3:], names, model.languages, language.kernel(model.landmarks, model.landmarks), language.RIDGE, near)
    best, score = model.predict(others)
    assert (best == values.argmax(axis=1)).all()
    assert np.allclose(score, np.clip((1 + values.max(axis=1)) / 2, 0, 1), atol=1e-6)


def test_odd_texts_and_labels(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house is red", "en"), ("das rote Haus", "de"), ("la casa roja", "es")] * 30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 -- 34", "xx"), (203, "das Haus " * 60000, None), (None, "the red house", "en"), (204, "東京", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("keep") for c in ("_id", "_held", "_lang", "_nth", "score", "a.b")})
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows) and got[0]["_nth"] == got[0]["a.b"] == "keep"
    assert all(r["held_out"] == (i is not None and plain.crc(i) % 3 == 1) for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[202]["score"] == 0 and got[204]["lang_pred"] in ("de", "en", "es")
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(90))


def test_nothing_to_learn_from(spark):
    rows = [(i, "the house", None) for i in range(9)]
    got = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language.identify(spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect() == []


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in df.collect())
    assert key(language.identify(docs)) == key(language.identify(other))


def test_most_held_out_languages_are_right(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n = Counter((r["lang"], r["lang"] == r["lang_pred"]) for r in found.filter("held_out").collect())
    assert all(n[lang, True] >= 0.95 * (n[lang, True] + n[lang, False]) for lang in ("en", "de", "es", "fr"))
