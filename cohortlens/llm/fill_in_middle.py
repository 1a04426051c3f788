"""Fill-in-the-middle: documents cut in three and reordered for infilling.

A document of n tokens (white space with the word behind it; white space at the
end is one token) is cut after two token counts drawn from a hash of its id.  To
find the cuts, texts are split into content-defined chunks by a rolling hash.  A
task remembers what it has counted of each chunk, its summary: characters, words
that end inside, and whether it begins with space and ends with a letter, which
decides whether a word ends at its edge.  A chunk seen before is looked up by its
hash and verified by its bytes.  Summaries add up along a document: the sums give
n and the chunk that holds a cut, and only that chunk is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACES, grown, map_batches, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
#: Of 100 documents this many are reordered, and of 100 of these this many suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes that the rolling hash sees, bits of it that are zero at a chunk's end, and a chunk's most bytes.
REACH, BITS, LONGEST = 32, 8, 4096

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Where the rolling hash of the last ``REACH`` bytes calls for a chunk's end (positions behind it)."""
    ends = []
    for start in range(0, len(data), block):
        first = max(0, start - REACH + 1)
        h = _GEAR[data[first:start + block]]
        width = 1
        while width < REACH:  # the hash of twice the width from two of the width
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        ends.append(np.flatnonzero(h[start - first:] >> np.uint32(32 - BITS) == 0) + start + 1)
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of all chunks, 0 first.  They depend on a document's own bytes alone."""
    ends = rolling(data)
    start = bounds[np.searchsorted(bounds, ends, side="left") - 1]
    cut = np.union1d(bounds, ends[ends - start >= REACH])
    extra = (np.diff(cut) - 1) // LONGEST  # an even stretch may never call for an end
    if extra.any():
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        cut = np.union1d(cut, np.repeat(cut[:-1], extra) + step * LONGEST)
    return cut


def word_ends(data: np.ndarray) -> np.ndarray:
    """Positions behind words that end before the end of ``data``."""
    space = _SPACE[data]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


class ChunkMemory:
    """Summaries of chunks by content; starts anew beyond ``room`` bytes of them."""

    def __init__(self, room: int = 24_000_000):
        self.room = room
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = self.hits = 0
        self.counts = np.zeros((1 << 12, 2), np.int64)  # characters, words ending inside
        self.edges = np.zeros((1 << 12, 2), bool)  # begins with space, ends with a letter

    def _learn(self, new: list[bytes]) -> None:
        data = np.frombuffer(b"".join(new), np.uint8)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(sizes) - sizes
        space = _SPACE[data]
        ends = np.append(~space[:-1] & space[1:], False)
        ends[starts + sizes - 1] = False
        first, last = len(self.known), len(self.known) + len(new)
        self.counts, self.edges = grown(self.counts, last), grown(self.edges, last)
        self.counts[first:last, 0] = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
        self.counts[first:last, 1] = np.add.reduceat(ends, starts, dtype=np.int64)
        self.edges[first:last, 0] = space[starts]
        self.edges[first:last, 1] = ~space[starts + sizes - 1]
        self.known.update(zip(new, range(first, last)))
        self.held += len(data)

    def summaries(self, raw: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and edges of all chunks of ``raw`` between the bounds ``cut``."""
        if self.held > self.room:
            self.reset()
        chunks = [raw[a:b] for a, b in pairwise(cut.tolist())]
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        self.hits += len(chunks) - len(new)
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        return self.counts[number], self.edges[number]


class Located:
    """Token counts and cut positions of the documents of one slice."""

    def __init__(self, texts: pa.Array, memory: ChunkMemory):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        self.bounds = offsets - offsets[0]
        body = texts.buffers()[2]
        self.raw = body[int(offsets[0]):int(offsets[-1])].to_pybytes() if body is not None else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        self.cut = chunk_bounds(self.data, self.bounds) if len(self.data) else np.zeros(1, np.int64)
        counts, edges = memory.summaries(self.raw, self.cut)
        self.at = np.searchsorted(self.cut, self.bounds)  # each document's first chunk
        closing = np.zeros(len(counts), bool)  # the next chunk does not go on with this one's last word
        closing[:-1] = edges[1:, 0]
        closing[self.at[1:][np.diff(self.at) > 0] - 1] = True
        self.inner = counts[:, 1]
        self.ends = np.concatenate([[0], np.cumsum(self.inner + (edges[:, 1] & closing))])
        self.chars = np.concatenate([[0], np.cumsum(counts[:, 0])])
        self.words = np.diff(self.ends[self.at])
        filled = np.diff(self.bounds) > 0
        self.tokens = self.words.copy()
        self.tokens[filled] += _SPACE[self.data[self.bounds[1:][filled] - 1]]  # white space at the end

    def place(self, i: int, k: int) -> tuple[int, int]:
        """Where document i's token k ends: byte in the slice, characters from the document's start."""
        first, last = self.at[i], self.at[i + 1]
        if k == 0:
            return int(self.bounds[i]), 0
        if k > self.words[i]:
            return int(self.bounds[i + 1]), int(self.chars[last] - self.chars[first])
        wanted = self.ends[first] + k
        c = int(np.searchsorted(self.ends, wanted)) - 1
        rank, start, end = int(wanted - self.ends[c]), int(self.cut[c]), int(self.cut[c + 1])
        if rank > self.inner[c]:
            return end, int(self.chars[c + 1] - self.chars[first])
        piece = self.data[start:end]
        size = int(word_ends(piece)[rank - 1])
        return start + size, int(self.chars[c] - self.chars[first] + ((piece[:size] & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers from the hash of seed and id (a null id counts as empty)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``form`` is plain (the output is the text; lengths are null), psm (prefix,
    suffix, middle) or spm (suffix, prefix, middle), each part behind its mark.
    An empty or null text, one that holds a mark, and all but ``rate`` of 100
    documents are plain.  Draws depend on the id alone, so rows that share an id
    (a null id counts as an empty one) draw alike, and repeated rows come out
    alike.  Other columns are ignored; an empty table gives no rows.  A text
    stays whole however long; a slice of about 4 MB is in memory at a time, or
    one longer text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = ChunkMemory()
        for part in slices(batches, max_bytes=1 << 22):
            texts = pc.fill_null(part.column("text"), "")
            marked = reduce(pc.or_, (pc.match_substring(texts, m) for m in (PREFIX, SUFFIX, MIDDLE)))
            found = Located(texts, memory)
            raw, bounds = found.raw, found.bounds.tolist()
            rows = []
            for i, (doc_id, n, mark) in enumerate(zip(part.column("doc_id").to_pylist(), found.tokens.tolist(),
                                                      marked.to_pylist())):
                a, b = bounds[i], bounds[i + 1]
                h1, h2, h3, h4 = draws(doc_id, seed)
                if a == b or mark or h3 % 100 >= rate:
                    rows.append((doc_id, n, "plain", None, None, raw[a:b]))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (p, before), (m, upto) = found.place(i, low), found.place(i, high)
                prefix, middle, suffix = raw[a:p], raw[p:m], raw[m:b]
                if h4 % 100 < suffix_first:
                    form, out = "spm", (b"<S>", suffix, b"<P>", prefix, b"<M>", middle)
                else:
                    form, out = "psm", (b"<P>", prefix, b"<S>", suffix, b"<M>", middle)
                rows.append((doc_id, n, form, before, upto - before, b"".join(out)))
            doc_id, n, form, before, between, out = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_id, pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form),
                "prefix_chars": pa.array(before, pa.int64()), "middle_chars": pa.array(between, pa.int64()),
                "output": pa.array(out, pa.string())})

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   F.col("text").cast("string").alias("text")), run, (
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts, found by their marks, in order."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    head = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.split_part(rest, F.lit(MIDDLE), F.lit(2))

    def part(mark: str, number: int) -> Column:
        return F.split_part(head, F.lit(mark), F.lit(number))

    return (F.when(form == "psm", F.concat(part(SUFFIX, 1), middle, part(SUFFIX, 2)))
            .when(form == "spm", F.concat(part(PREFIX, 2), middle, part(PREFIX, 1))).otherwise(output))


def digest(made: DataFrame) -> DataFrame:
    """Hashes in place of the outputs, and of the texts rebuilt from them."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: DuckDB twin of ``digest(transform(documents))``.
ORACLE = """
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
c as (
  select *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as tok,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from t),
k as (
  select *, cast(len(tok) as bigint) as n,
    least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as lo, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as hi,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50
         then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from c),
p as (
  select doc_id, n, form, text, array_to_string(tok[1:lo], '') as pre,
    array_to_string(tok[lo + 1:hi], '') as mid, array_to_string(tok[hi + 1:], '') as suf
  from k)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
