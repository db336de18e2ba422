"""Line, passage and near-duplicate removal, quality rules, sharding and the pipeline, beside plain versions."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain
from basketry.llm import line_dedup, quality, sharding, simhash, substring_dedup
from basketry.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def corpus(seed=0, n=60):
    """Texts with shared lines and passages, near copies, copies, low variety, and the odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéABß") for _ in range(r.randint(1, 6))) + r.choice(["", "", "", ",", "#"])
    line = lambda k: " ".join(word() for _ in range(k))
    passages = [line(50) for _ in range(4)]
    common = ["  Read More ", "read more\t", "ÉTÉ", "all rights reserved"]
    texts = []
    for i in range(n):
        parts = [line(r.randint(1, 60)) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        if i % 2:
            parts.insert(r.randrange(len(parts) + 1), r.choice(common))
        texts.append(r.choice(["\n", "\n\n", "\r\n"]).join(parts))
    for base in texts[:6]:
        ws = base.split(" ")
        for _ in range(4):
            near = list(ws)
            near[r.randrange(len(near))] = word()
            texts.append(" ".join(near))
    texts += [texts[1], texts[1], None, None, "", " \n\t", "a " * 300, "a b c " * 40, "x", "X", "\n".join(["Same"] * 9), "w" * 5000]
    texts.append(" ".join(texts[:20]) + "\x0b\x0cend")
    rows = [(i * 7, t, "en", f"src{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[2], None, None, None), (None, "no id here", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, tuple(str(x) for x in r)))


def odd(docs):
    """Columns whose names clash with the operators' own."""
    return docs.withColumns({c: F.lit("keep") for c in ("_id", "_h", "_row", "n_words", "a.b", "count")})


def test_common_lines(docs, rows):
    got = line_dedup.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    want = plain.common_lines([r[:2] for r in rows])
    assert any(w[2] for w in want)
    assert key(map(tuple, got)) == key(want)


def test_repeated_passages(docs, rows):
    want = key(plain.repeated([r[:2] for r in rows]))
    assert any(0 < w[2] < w[1] for w in want)
    for shard_words in (200_000, 300):  # the second cuts frequent grams into windows
        got = substring_dedup.drop_repeated(docs, shard_words=shard_words)
        assert key(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect())) == want
    assert key(map(tuple, got.select("doc_id", "text").collect())) == key([r[:2] for r in rows])


def test_near_duplicates(docs, rows):
    want, tops = plain.near_classes([r[:2] for r in rows])
    assert len(set(tops)) < len(rows) - 10
    for group_rows in (simhash.GROUP_ROWS, 2):
        found = simhash.classes(docs, group_rows=group_rows)
        got = found.select("_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component").collect()
        assert key(map(tuple, got)) == key(want)
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(tops))
    assert {r["doc_id"] for r in kept} == {w[2] for w in want}


def test_pigeonring_keys_miss_no_pair(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for p in base:
        for _ in range(6):
            q = p
            for b in r.sample(range(64), r.randint(0, 4)):
                q ^= 1 << b
            prints.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp bigint")
    for most in (0, 1, 3, 5):
        found = simhash.connected(simhash.links(frame, most).distinct()).collect()
        root = {p: p for p in prints}
        for p in sorted(prints):
            todo = [p]
            while todo:
                here = todo.pop()
                for q in prints:
                    if (here ^ q).bit_count() <= most and root[q] != root[p]:
                        root[q] = root[p]
                        todo.append(q)
        got = {}
        for row in found:
            got.setdefault(row["root"], set()).add(row["node"] % (1 << 64))
        want = {}
        for q, p in root.items():
            want.setdefault(p, set()).add(q)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_quality_counts(docs, rows):
    got = quality.judge(docs, carry=["doc_id"]).collect()
    want = [(r[0], *plain.measures(r[1]).values()) for r in rows]
    assert key([tuple(g)[:7] for g in got]) == key(want)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, "good", 0) for i in range(40)] + [(100 + i, "bad", "spam", 0) for i in range(200)]
    rows += [(500, good, "spam", 0), (501, good, "tiny", 0), (502, "short", "tiny2", 0), (503, good, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint")
    kept = {r["doc_id"] for r in quality.judge(docs, carry=["doc_id"]).filter("kept").collect()}
    assert kept == {*range(40), 501, 503}  # a good text of a spam host goes with it; one bad text rejects no host


def test_sharding(spark):
    for slots, names in ((13, ["a"]), (101, list("abcdefg")), (2039, [f"s{i}" for i in range(20)])):
        table = {r["slot"]: r["shard"] for r in sharding.lookup(spark, names, slots).collect()}
        assert sorted(table) == list(range(slots)) and set(table.values()) == set(names)
        shares = [list(table.values()).count(n) for n in names]
        assert max(shares) - min(shares) <= 1
        if len(names) > 2:
            less = {r["slot"]: r["shard"] for r in sharding.lookup(spark, names[1:], slots).collect()}
            stayed = sum(table[s] == less[s] for s in table if table[s] != names[0])
            assert stayed >= 0.6 * slots
    with pytest.raises(ValueError):
        sharding.lookup(spark, ["a"], 100)
    placed = sharding.place(spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")).collect()
    assert len(placed) == 3 and len({r["shard"] for r in placed if r["doc_id"] == 1}) == 1


def test_empty_tables_and_clashing_names(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    every = (
        line_dedup.drop_common_lines,
        substring_dedup.drop_repeated,
        simhash.one_of_each,
        quality.judge,
        lambda d: sharding.place(d),
    )
    few = odd(docs.limit(12))
    for operate in every:
        assert operate(empty).count() == 0
        out = operate(few)
        assert out.count() <= 12
        assert {r["a.b"] for r in out.select("`a.b`").collect()} == {"keep"}


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    import public_tokenizers

    coder = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rows = [(i, t) for i, t, _ in rows if judged[i]]
    assert all(not plain.measures(t)["base_failed"] for _, t in rows)
    rows = [(i, k if n else t) for (i, t), (_, _, n, k) in zip(rows, plain.common_lines(rows))]
    _, tops = plain.near_classes(rows)
    first = {}
    for (i, t), top in sorted(zip(rows, tops)):
        first.setdefault(top, (i, t))
    rows = sorted(first.values())
    rows = [(i, k if n else t) for (i, t), (_, _, n, k) in zip(rows, plain.repeated(rows))]
    want = {i: [*coder.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    pieces = corpus_pipeline.run(spark, SF).collect()
    got, ends, used = {}, {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == ends.get(p["doc_id"], 0)
        ends[p["doc_id"]] = p["start"] + len(p["ids"])
        got.setdefault(p["doc_id"], []).extend(p["ids"])
    assert got == want
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == used.get(p["sequence_id"], 0)
        used[p["sequence_id"]] = p["offset"] + len(p["ids"])
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


def test_near_copies_do_not_fill_a_shard(spark):
    """Segments of many near copies share one gram; a shard stays near its size, and equal windows are held once."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(r.randint(0, 2)):
            own[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spots, pieces = substring_dedup.pieces_by_shard(docs, "doc_id", "text", 10, 4, 500)
    sizes = pieces.groupBy("shard").agg(F.sum(F.size("words")).alias("n"), F.max(F.size("words")).alias("longest")).collect()
    assert len(sizes) > 4 and max(s["n"] for s in sizes) < 4 * 500
    assert pieces.groupBy("gram", "seg").count().filter("count > 1").count() == 0
    got = substring_dedup.drop_repeated(docs, window=10, gram=4, shard_words=500).collect()
    want = {w[0]: w[1:] for w in plain.repeated(rows, 10)}
    assert all((x["n_words"], x["n_removed"], x["kept_text"]) == want[x["doc_id"]] for x in got)
