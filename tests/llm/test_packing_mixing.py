"""Packing against the plain algorithm; mixing against exact rules and its SQL twin."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import mixing, packing

DOCS = "doc_id bigint, text string, source string, size int"


def plain_best_fit(lengths, window):
    """Fill of every window, one piece at a time."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            best = min(fits)
            free[free.index(best)] -= length
        else:
            free.append(window - length)
    return sorted(window - f for f in free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_bulk_placement_equals_best_fit_decreasing(lengths):
    counts = Counter(lengths)
    placed = packing.best_fit(dict(counts), 32)
    fill, spots = Counter(), set()
    for length in counts:
        own = sorted(p for p in placed if p[0] == length)
        for i, (_, first, sequence, each, offset) in enumerate(own):
            last = own[i + 1][1] if i + 1 < len(own) else counts[length]
            for rank in range(first, last):
                step = rank - first
                spot = (sequence + step // each, offset + step % each * length)
                spots.update((spot[0], spot[1] + k) for k in range(length))
                fill[spot[0]] += length
    assert len(spots) == sum(lengths)  # nothing overlaps
    assert sorted(fill.values()) == plain_best_fit(lengths, 32)
    assert all(max((o for s, o in spots if s == seq), default=-1) == n - 1 for seq, n in fill.items())


def test_word_ids_equal_the_tokenizer():
    tokens = packing.word_tokens(packing.vocabulary_path())
    texts = ["", "a", "Don't we'll CAN'S 12.5 été, İst K x́.y a.b!!\t\r\n c,d...", "x <|endoftext|> y", "  \n", "中文。 s's.'s ,."]
    for text, ids in zip(texts, tokens.each(pa.array(texts))):
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_small(spark):
    rows = [(1, "hello world " * 1500, "a", 0), (2, None, "a", 0), (2, None, "a", 0), (3, "", None, 1), (None, "one two", "b", 2)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("x"))
    got = packing.pack(docs, keep_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and got.length.sum() == 3001 + 1 + 1 + 1 + 3
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert packing.pack(docs.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rows = [(i, " w" * (i % 40), f"s{min(i % 7, 3)}", i) for i in range(800)] + [(900, None, None, 1), (901, "a b c", None, 2), (901, "a b c", None, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sizes(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    total = got["size"].sum()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum")).reset_index()
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 and (by.target <= 2 * by.source_size + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 3).all()
    again = mixing.mix_sizes(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    out = mixing.mixed(docs.withColumn("mix_part", F.lit(1)))
    assert out.columns == [*docs.columns, "mix_part"]
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == got.taken.sum()
    assert mixing.mix_sizes(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_packs_tokens(spark):
    import zlib

    import numpy as np

    import corpus_pipeline

    rows = [(1, "some text to pack"), (1, "another text of the id"), (2, "word " * 3000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.packed(spark, docs, "").collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        ends[r.sequence_id] = r.offset + r.length


def test_arrow_batches_are_bounded_by_bytes(spark):
    from cohortlens.llm.common import map_batches

    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    size = map_batches(long, lambda batches: (pa.RecordBatch.from_pydict(
        {"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n bigint, size bigint")
    got = size.agg(F.sum("n").alias("n"), F.max("size").alias("most")).first()
    assert got.n == 3000 and got.most < 5 << 20


def test_another_operator_lets_go_of_the_words_of_the_one_before():
    from cohortlens.llm import common

    memory = common.WordMemory(lambda words, first: None)
    common.held("one", lambda: memory)
    memory.numbers(pa.array(["a b c"]))
    common.held("other", object)
    assert common.WordMemory.in_use is None and memory.known == {"": 0}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 31) - 1) | st.integers(0, 70_000), max_size=50))
def test_squeezed_ids_come_back(ids):
    there = np.array(ids, np.uint32)
    assert packing.unsqueeze(packing.squeeze(there), len(ids)).tolist() == ids


def test_packing_stages_and_shuffles_ids_in_little_space(spark):
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "eri", "ost", "ul")]
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(vocabulary, 1500))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    plain = {(r.doc_id, r.start): list(r.ids) for r in packing.pieces(docs, keep_ids=True).collect()}
    out = packing.pack(docs, keep_ids=True)
    assert dict(out.dtypes)["ids"] == "array<int>"
    rows = out.collect()
    assert {(r.doc_id, r.start): list(r.ids) for r in rows} == plain
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    squeezed = packing.pieces(docs, keep_ids=True, squeezed=True).select(F.sum(F.length("ids")).alias("n")).first().n
    assert squeezed < 2 * sum(map(len, plain.values()))
