"""Near-duplicates and fingerprints against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cohortlens.llm import fingerprints, near_dedup

WORD = re.compile(r"[^ \t-\r]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower().decode())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[find(x)] = find(y)
    low = {}
    for x, (i, a) in enumerate(sets):
        low[find(x)] = min(low.get(find(x), i), i)
    return {(i, len(a), low[find(x)]) for x, (i, a) in enumerate(sets)}


def family_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=120)
        for _ in range(40):  # similarities on both sides of the threshold
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0].lower(), None, "", " \t\n", "one two", "ONE\ttwo", "one two three", "a b c d e", "a b c d e"]
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = family_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn("bands", F.lit(2))
    got = near_dedup.components(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.unique(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_exact_bounds_with_repeated_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for f in range(12):  # all share a long passage; families differ in the rest
        base = [f"p{i}" for i in range(80)] + [f"f{f}x{i}" for i in range(rng.randint(6, 40))]
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            rows.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(rows) for _ in range(1 + i % 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)  # leaves every pair to the exact way
    got = near_dedup.components(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == components(list(dict(rows).items()))


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(7, text), (7, text), (7, "quite another text of six"), (None, text), (None, None)],
                                 "doc_id bigint, text string")
    got = near_dedup.components(docs)
    assert sorted(r.n_shingles for r in got.collect()) == [0, 1, 26, 26, 26]
    left = sorted((r.doc_id, r.text) for r in near_dedup.unique(docs).filter("doc_id is not null").collect())
    assert left == [(7, "quite another text of six"), (7, text)]
    assert near_dedup.components(docs.limit(0)).count() == 0 and near_dedup.unique(docs.limit(0)).count() == 0


def test_repeated_and_null_ids_do_not_gather(spark, capsys):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=40)) for _ in range(6)]
    rows = [(None, t + tail) for t in base for tail in ("", " more", " MORE")] + [(7, base[0])] * 5 + [(7, base[0] + "  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("extra", F.lit(1))
    left = near_dedup.unique(docs)
    assert [(r.text, r.extra) for r in left.collect() if r.doc_id == 7] == [(base[0], 1)]
    left.explain()
    assert "Window" not in capsys.readouterr().out
    wanted = near_dedup.signed(docs).groupBy("node").agg(F.min("doc_id").alias("first_id")).filter("node is not null")
    sets = near_dedup._sets(docs, wanted)
    assert sorted(bytes(r.node) for r in sets.collect()) == sorted(bytes(r.node) for r in wanted.collect())
    sets.explain()
    assert "isnull(first_id" not in capsys.readouterr().out.split("Join")[1].split("\n")[0]


def test_least_matches_keep_the_threshold():
    for n, m in near_dedup.least_matches(1e-6):
        assert 0 < m < 0.75 * n


def test_fingerprints_in_order(spark):
    rows = [(9, "nine " * 30), (4, "four"), (4, "four"), (1, None), (0, ""), (12, "é" * 10), (None, "last one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("range", F.lit(3)).withColumn("tail", F.lit(True))
    got = fingerprints.fingerprint(docs).collect()
    order = sorted(((i if i is not None else -(1 << 63), t or "", i) for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for (_, a, i), (_, b, _) in zip(order, order[1:] + order[:1]):
        n = len(a) // 3
        want.append((i, len(a), hashlib.sha256((a[:len(a) - n] + b[:n]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert fingerprints.fingerprint(docs.limit(0)).count() == 0


def test_fingerprint_depends_on_the_text_alone():
    rng = random.Random(8)
    texts = ["".join(rng.choices("aab cé\n", k=rng.randint(0, 300))) for _ in range(300)]
    alone = [fingerprints.sketches([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in fingerprints.sketches(texts)] == alone
    assert [s.tolist() for s in fingerprints.sketches(texts[::-1], block=500)] == alone[::-1]


def test_equal_substrings_share_names_at_any_offset():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=4000))
    whole, moved, other = fingerprints.sketches([text, "prefix " + text, "".join(rng.choices("abcdefgh ", k=4000))])
    assert fingerprints.likeness(whole, moved) > 0.9 and fingerprints.likeness(whole, whole) == 1.0
    assert fingerprints.likeness(whole, other) < 0.1
    aaa, zero = fingerprints.sketches(["a" * 100_000, ""])
    assert len(aaa) and not len(zero) and fingerprints.likeness(aaa, zero) == 0.0 and fingerprints.likeness(zero, zero) == 1.0
