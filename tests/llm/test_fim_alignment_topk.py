"""Fill-in-the-middle, token alignment and top-k search against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import fill_in_middle as fim
from cohortlens.llm import token_alignment, top_k

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["word", " ", "  ", "\n", "\t", "é", "中文", ".", "a", "…", "x" * 40, "\x0b", "\r\n", "the", " of ", "😀", "\x1f", " "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------ fill in the middle ---

def plain_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def order(rows):
    return sorted(rows, key=str)


def test_fim_equals_the_plain_rule(spark):
    rng = random.Random(5)
    shared = "".join(rng.choices(PARTS, k=3000))
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 30)))) for i in range(1500)]
    rows += [(2000 + i, "".join(rng.choices(PARTS, k=i)) + shared) for i in range(40)]
    rows += [(3000 + i, t) for i, t in enumerate(["", " ", "\n\n", "a <P> b", "<M>", "<S", "a<", None] * 6)]
    rows += [(4000 + i, "x" * 300_000) for i in range(4)] + [(4100 + i, " " * 50_000 + "w") for i in range(4)]
    rows += [(None, "no id here at all"), (None, None), (7, "same row"), (7, "same row")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit(1)).repartition(3)
    made = fim.transform(docs)
    got = [tuple(r) for r in made.collect()]
    assert order(got) == order([plain_fim(*r) for r in rows])
    texts = Counter((i, sha(t or "")) for i, t in rows)
    digested = fim.digest(made).collect()
    assert Counter((r.doc_id, r.restored_sha256) for r in digested) == texts
    assert Counter(r.output_sha256 for r in digested) == Counter(sha(r[5]) for r in got)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=5), st.integers(1, 4))
def test_chunk_sums_place_every_token(texts, repeat):
    texts = texts + [texts[0] * (repeat * 20)]
    found = fim.Located(pa.array(texts), fim.ChunkMemory())
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        assert found.tokens[i] == len(tokens)
        for k in {0, len(tokens) // 3, len(tokens) // 2, max(0, len(tokens) - 1), len(tokens)}:
            head = "".join(tokens[:k])
            place, chars = found.place(i, k)
            assert (place - int(found.bounds[i]), chars) == (len(head.encode()), len(head))


def test_chunks_are_shared_wherever_they_stand_and_memory_is_bounded():
    rng = random.Random(2)
    body = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000))
    memory = fim.ChunkMemory(room=20_000)
    fim.Located(pa.array([body]), memory)
    known = len(memory.known)
    memory.room = 1 << 30
    fim.Located(pa.array(["some other beginning " * 3 + body]), memory)
    assert known > 50 and memory.hits > 0.9 * known  # the rolling hash finds the same chunks behind a shift
    memory.room = 20_000
    fim.Located(pa.array(["new"]), memory)
    assert memory.held <= 20_000
    assert np.diff(fim.chunk_bounds(np.zeros(50_000, np.uint8), np.array([0, 50_000]))).max() <= fim.LONGEST


# ------------------------------------------------------------- alignment ---

@pytest.fixture(scope="module")
def both():
    return token_alignment.Tokenizers(*map(token_alignment.vocabulary_path, (token_alignment.FIRST, token_alignment.SECOND)))


whole = Tokenizer.from_file(token_alignment.vocabulary_path(token_alignment.FIRST))
whole.encode_special_tokens = True


def plain_groups(both, text):
    """Groups of a text from its whole encodings, offset by offset."""
    if not text:
        return []
    a = whole.encode(f" {text}", add_special_tokens=False).ids
    b = both.b.encode(text)
    raw = f" {text}".encode()
    if b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
        return []
    ends_a = np.cumsum([len(both.a_bytes[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(both.b_bytes[i]) for i in b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups = [([], []) for _ in common]
    for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
        for i, e in zip(ids, ends):
            groups[next(k for k, c in enumerate(common) if e <= c)][side].append(i)
    return groups


def plain_linked(both, rows):
    groups = [plain_groups(both, t) for _, t in rows]
    held = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(link for h in held for link in h)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (doc_id, _), g, h in zip(rows, groups, held):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(h.values()),
                    sum(n for link, n in h.items() if count[link] == top[link[0]]),
                    sum(n * count[link] for link, n in h.items()), sha(text) if g else ""))
    return out


TOKEN_PARTS = [*PARTS, "<|endoftext|>", "<s>", "'s", "don't", " Straße", "naïve", "12345", "▁", "=" * 30, "----", ";\r", "{\r\n",
               "https://x.y/z?q=1", "Übergröße", "é", " ", "\x85", "\x00", "aaaaaaa", "...", " ,", "\n\n", "\t\t", "    "]


def test_alignment_equals_brute_force(spark, both):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices(TOKEN_PARTS, k=rng.randint(0, 12)))) for i in range(900)]
    rows += [(1000 + i, " ".join(rng.choices(["the", "Anblewh", "sttible,", "über", "l'été", "x1", "foo.bar"], k=60))) for i in range(30)]
    rows += [(None, "no id"), (None, None), (5, ""), (6, "twice the row"), (6, "twice the row"), (2000, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("block", F.lit("x")).repartition(3)
    got = [tuple(r) for r in token_alignment.linked(docs, block=4000).select(*token_alignment.OUT).collect()]
    assert order(got) == order(plain_linked(both, rows))
    assert token_alignment.linked(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(0, 40))
def test_open_ends_equal_the_difference_of_sets(a, b, run):
    a, b = np.cumsum([1] * run + a), np.cumsum([1] * run + b)
    last = max(a[-1], b[-1])
    a, b = (np.unique(np.append(x, last)) for x in (a, b))
    open_a, open_b = token_alignment.open_ends(a, b)
    assert open_a.tolist() == (~np.isin(a, b)).tolist() and open_b.tolist() == (~np.isin(b, a)).tolist()


# ----------------------------------------------------------------- top k ---

def plain_top(rows, k, every):
    sound = [(r, i, [int(np.floor(1024 * float(x))) for x in v]) for r, (i, v) in enumerate(rows)
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, i, q in sound:
        if i is not None and i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), c is None, c, s) for s, c, v in sound if s != r and len(v) == len(q))
            out += [(i, n + 1, c, -s) for n, (s, _, c, _) in enumerate(found[:k])]
    return out


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(size=8) * 0.3).tolist()) for i in range(900)]
    rows += [(10_000 + i, [0.5] * 8) for i in range(400)]  # a third of equal vectors: ties go by id
    rows += [(20, rows[20][1]), (20, rows[20][1]), (None, rows[40][1]), (40, None), (60, [float("nan")] * 8), (80, [None, 1.0]),
             (100, [float("inf")] * 8), (2000, [1.0, 2.0]), (2020, [1.0, -2.0]), (2040, []), (2041, []), (2060, [7.0] * 3)]
    rows += [(3000, [3e9, 1.0, 0.0, 5.0]), (3020, [3e9, -1.0, 2.0, 1e-3]), (3001, [-3e9, 4.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    limit = 1 << 63
    want = [(q, n, c, max(-limit, min(limit - 1, s))) for q, n, c, s in plain_top(rows, 10, 20)]
    for size, pivots in ((60, 5), (None, 64)):
        got = [tuple(r) for r in top_k.search(table, every=20, shard_rows=size, pivots=pivots).collect()]
        assert order(got) == order(want)
    assert top_k.search(table.limit(0)).count() == 0


def test_tree_prunes_and_equal_rows_stay_one_leaf():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(4000, 6)) * 50 + np.repeat(rng.normal(size=(40, 6)) * 4000, 100, axis=0)).astype(np.int64)
    tree = top_k.BallTree(points, np.arange(4000), np.arange(4000), 10)
    seen = []
    plain = tree.bounds
    tree.bounds = lambda nodes, *a: (seen.extend(nodes), plain(nodes, *a))[1]
    best = tree.search(points[7], 7, 10, float("-inf"))
    scores = points @ points[7]
    scores[7] = -(1 << 60)
    assert [b[1] for b in best] == np.lexsort((np.arange(4000), -scores))[:10].tolist()
    assert len(set(seen)) < len(tree.radii) / 4
    assert tree.search(points[7], 7, 10, float(best[0][0] + 1)) == []  # a score found elsewhere closes the search
    same = top_k.BallTree(np.ones((100_000, 3), np.int64), np.arange(100_000), np.arange(100_000), 10)
    assert len(same.radii) == 1 and len(same.points) == 11
    assert [b[1] for b in same.search(np.ones(3, np.int64), 3, 10, float("-inf"))] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
