"""Packing: best-fit decreasing into fixed windows, exact over the whole corpus.

A document longer than a window is cut into full windows and one rest.  Best-fit
decreasing depends on the lengths alone, so it runs on the counts per length
(at most ``window`` rows, whatever the corpus): pieces of one length are placed
in bulk, and a segment tree indexed by remaining capacity finds the tightest
open window.  The outcome is a list of placements, each telling where the pieces
of one length with ranks in a range go; every piece then finds its place from
its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WordMemory, fresh, grown, held, map_batches, slices, stage

END_ID = 1
WINDOW = 2048
SHARDS = 1024
#: Marks that may follow a word's letters; none joins with a letter in any normal form.
MARKS = ".,;:!?"
VOCABULARY = "word_bpe_49k.json"


class WordTokens:
    """Ids of texts; each space-separated word is encoded once and remembered.

    The tokenizer never joins characters across white space, so a text's ids are
    the ids of its words.  The strings of special tokens are cut out before words
    are formed, so a text with one is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; before the first use
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.memory = WordMemory(self._learn)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _encoded(self, words: list[str], together: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many each has; few encodings are there at once."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), together):
            part = [e.ids for e in self.tokenizer.encode_batch_fast(words[i:i + together], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, part), np.int64, len(part)))
            ids.append(np.fromiter(chain.from_iterable(part), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _stems(self, stems: list[str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same for words made of letters alone: many in one call, cut after each word's last id."""
        lines = [stems[i:i + together] for i in range(0, len(stems), together)]
        ids, lengths = self._encoded([" ".join(x) for x in lines], 64)
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        bounds = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        for line, start, end in zip(lines, bounds, bounds[1:]):
            one = ids[start:end]
            size = np.diff(np.flatnonzero(self.last[one]), prepend=-1)
            if len(size) != len(line) or size.sum() != len(one):
                one, size = self._encoded(line)
            found.append(one)
            sizes.append(size)
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, new: list[str], first: int) -> None:
        # each word is letters, then something else; of both, the distinct ones are encoded
        words = pa.array(new, pa.string())
        stems = pc.utf8_rtrim(words, MARKS)
        spelled = pc.utf8_is_alpha(stems)
        lower = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        coded = lower.filter(spelled).dictionary_encode()
        letters = spelled.to_numpy(zero_copy_only=False)
        size = pc.binary_length(words).to_numpy()
        tail = np.where(letters, size - pc.binary_length(stems).to_numpy(), size)  # marks are one byte each
        parts = np.full((len(new), 2), -1, np.int64)
        parts[letters, 0] = coded.indices.to_numpy()
        rests: dict[str, int] = {"": 0}
        more = np.flatnonzero(tail)
        parts[more, 1] = [-1 - rests.setdefault(new[i][-n:], len(rests)) for i, n in zip(more.tolist(), tail[more].tolist())]
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        (spelt, many), (other, more) = self._stems(known), self._encoded(list(rests))
        lengths, flat = np.concatenate([many, more, [0]]), np.concatenate([spelt, other])
        unit = np.where(parts < -1, len(known) - 1 - parts, np.where(parts < 0, len(lengths) - 1, parts)).ravel()
        starts, length = (np.cumsum(lengths) - lengths)[unit], lengths[unit]
        ends = np.cumsum(length)
        used = int(self.start[first - 1] + self.length[first - 1])
        total, last = int(ends[-1]), first + len(new)
        self.ids = grown(self.ids, used + total)
        self.ids[used:used + total] = flat[np.repeat(starts - (ends - length), length) + np.arange(total)]
        self.start, self.length = grown(self.start, last), grown(self.length, last)
        self.length[first:last] = length.reshape(-1, 2).sum(axis=1)
        self.start[first:last] = used + np.cumsum(self.length[first:last]) - self.length[first:last]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the bounds of each text (one more than texts)."""
        numbers, bounds = self.memory.numbers(texts)
        lengths = self.length[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.start[numbers] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[bounds]

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self(texts)
        odd = set()
        for s in self.special:
            odd.update(np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist())
        for i in range(len(texts)):
            if i in odd:
                yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bounds[i]:bounds[i + 1]]


def squeeze(ids: np.ndarray) -> bytes:
    """Ids in little space: the bytes a number takes, then the numbers, compressed."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + pa.compress(ids.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, length: int) -> np.ndarray:
    """The ``length`` ids that ``squeeze`` took."""
    width = data[0]
    raw = pa.decompress(data[1:], decompressed_size=length * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{width}").astype(np.uint32).view(np.int32)


def word_tokens(path: str) -> WordTokens:
    return held(("tokens", path), lambda: WordTokens(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY,
           end_id: int = END_ID, keep_ids: bool = False, squeezed: bool = False) -> DataFrame:
    """Cut every document's ids into full windows and a rest.

    One row per piece: doc_id, start (ids before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens (the document's
    ids, ``end_id`` included), and ``ids`` itself if ``keep_ids``, as ``squeeze``
    makes it if ``squeezed``.  A null or
    empty text is the one id ``end_id``.  Other columns are ignored; a repeated
    row gives its pieces again.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (
        f", ids {'binary' if squeezed else 'array<int>'}" if keep_ids else "")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary_path(vocabulary))
        for part in slices(batches):
            doc_ids = part.column("doc_id").to_pylist()
            out: list[tuple] = []
            kept: list[np.ndarray | bytes] = []
            for doc_id, ids in zip(doc_ids, tokens.each(pc.fill_null(part.column("text"), ""))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if keep_ids:
                        kept.append(squeeze(piece) if squeezed else piece.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary() if squeezed else pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   F.col("text").cast("string").alias("text")), cut, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += count
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that has an open window."""
        at = length + self.leaves
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on the number of pieces per length.

    Returns placements (length, first rank, first sequence, pieces per sequence,
    offset of the first piece): ranks from the first rank on (to the next
    placement of that length) go to sequences in turn, so many in each.  A placement covers equal
    windows at once; there are at most four new groups of windows per length, and
    a window takes pieces of at most sqrt(2 * window) different lengths, so the
    list is bounded by the window size, not by the corpus.
    """
    tree = CapacityTree(window)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first sequence, windows)
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def open_windows(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            groups.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length) if length <= window else None
            if capacity is None:
                capacity, first, n = window, sequences, -(-left // (window // length))
                sequences += n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            full = min(n, left // each)
            offset = window - capacity
            if full:
                placed.append((length, rank, first, each, offset))
                rank, left = rank + full * each, left - full * each
                open_windows(capacity - each * length, first, full)
            if full < n and left:
                placed.append((length, rank, first + full, each, offset))
                open_windows(capacity - left * length, first + full, 1)
                left, full = 0, full + 1
            open_windows(capacity, first + full, n - full)
    return placed


def place(cut: DataFrame, window: int = WINDOW, shards: int = SHARDS) -> DataFrame:
    """Give every piece its sequence_id and offset.

    ``cut`` must be stable between reads (a written table).  The rank among the
    pieces of one length is the rank within a shard of that length plus the
    counts of the shards before it, so a length that a third of all pieces have
    spreads over ``shards`` groups.  Equal pieces may swap places among
    themselves; the set of rows is the same in every run.  Squeezed ``ids``
    travel as they are and come out as numbers.
    """
    spark = cut.sparkSession
    shard, before = fresh(cut, "shard", "before")
    cut = cut.withColumn(shard, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    sizes = cut.groupBy("length", shard).agg(F.count("*").alias(before))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = best_fit(counts, window)
    plan = spark.sparkContext.broadcast(
        {k: np.array(v, np.int64) for k, v in zip(
            ("key", "first_rank", "sequence", "each", "offset"),
            zip(*((length << 44 | rank, rank, first, each, offset)
                  for length, rank, first, each, offset in sorted(placed))))} if placed else {})
    earlier = Window.partitionBy("length").orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length"), F.col(shard),
                         F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("length", shard).orderBy("doc_id", "start", "ids_crc32")
    ranked = (cut.withColumn("rank", F.row_number().over(inside) - 1)
              .join(sizes, ["length", shard])
              .withColumn("rank", F.col("rank") + F.col(before)).drop(shard, before))
    names = [c for c in ranked.columns if c != "rank"]
    squeezed = dict(ranked.dtypes).get("ids") == "binary"

    def column(batch: pa.RecordBatch, name: str) -> pa.Array:
        if not squeezed or name != "ids":
            return batch.column(name)
        return pa.array(list(map(unsqueeze, batch.column("ids").to_pylist(), batch.column("length").to_pylist())),
                        pa.list_(pa.int32()))

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in slices(batches, "ids") if squeezed else batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            step = rank - p["first_rank"][at]
            each = p["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in names), pa.array(p["sequence"][at] + step // each),
                 pa.array(p["offset"][at] + step % each * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {'array<int>' if squeezed and f.name == 'ids' else f.dataType.simpleString()}"
                       for f in ranked.schema if f.name != "rank")
    return map_batches(ranked, locate, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID,
         keep_ids: bool = False, shards: int = SHARDS) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids.

    One row per piece: the columns of ``pieces`` with sequence_id and offset;
    sequences are numbered from 0 and their offsets have no gaps.  An empty
    table gives no rows; a null doc_id is kept.
    """
    return place(stage(pieces(docs, window, vocabulary, end_id, keep_ids, squeezed=True), "pieces"), window, shards)
