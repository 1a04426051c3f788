"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Byte offsets where tokens of both tokenizers end cut a document into groups; all
tokens of a group are linked.  Groups are found by diagonal run skipping: at the
current shift between the two index ranges, exponential probing compares whole
stretches of the two end arrays and jumps over one-to-one tokens; where the ends
part, the irregular group is resolved token by token and the shift updated.

Texts are handled in blocks of bounded size.  A block lists its distinct links
once, with the number of its documents that hold them; corpus-wide counts come
from these lists alone, and return to a block as one row per distinct link.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import grown, map_batches, on_path, slices, stage, sums

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes of a block; a longer text is a block of its own.
BLOCK = 1 << 21
SPACE_MARK = "\u2581"
#: White space beyond ASCII: a text that holds some is encoded as a whole.
WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_SPACE = f"[{WIDE}]"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def _encoder(path: str, token_bytes: list[bytes]) -> Callable[[str], list[int]]:
    """Encodes a text by the byte-level vocabulary at ``path``; special tokens' strings are ordinary text.

    Where the file has the usual word pattern and its merges in the order of
    their ids, ids are ranks, and the faster library for such tables gives the same.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {t["content"] for t in made["added_tokens"]}
    names = made["model"]["vocab"]
    merged = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in made["model"]["merges"]]
    usual = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if made["normalizer"] is None and made["pre_tokenizer"] == usual and merged == sorted(merged):
        ranks = {token_bytes[i]: i for name, i in names.items() if name not in special}
        return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; before the first use
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        with open(first, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.first = _encoder(first, self.a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        spaces = " \t\n\x0b\x0c\r"
        shown = [p.replace(SPACE_MARK, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        #: White space before which both always cut, if it follows a letter: a space that no piece has behind
        #: a letter, and what no piece has at all.
        self.cuts = [c for c in spaces if not any(c in p.lstrip(" ") if c == " " else c in p for p in shown)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit as it stands (the second tokenizer adds a space, given or taken off)."""
        a = list(map(self.first, units))
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        lone = [self.b.piece_to_id(SPACE_MARK)]  # of nothing the second tokenizer makes nothing, not even the space
        return a, [lone if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, b)]

    def exact(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides' ids give the text's bytes."""
        raw = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw


class UnitMemory:
    """Ids of text units (white space and the word behind it); starts anew beyond ``room`` units or characters."""

    def __init__(self, tokenizers: Tokenizers, room: int = 200_000, chars: int = 16_000_000):
        self.tokenizers, self.room, self.chars = tokenizers, room, chars
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids = [np.zeros(1 << 16, np.int32) for _ in range(2)]
        self.start = [np.zeros(1 << 16, np.int64) for _ in range(2)]
        self.length = [np.zeros(1 << 16, np.int64) for _ in range(2)]
        self.used = [0, 0]
        self.exact = np.zeros(1 << 16, bool)  # both give the unit's bytes

    def _learn(self, new: list[str], together: int = 64) -> None:
        """Encode new units, many on end in one line: tokens end where units do, which tells whose they are."""
        t, wide = self.tokenizers, set(WIDE)
        plain = [i for i, u in enumerate(new) if len(u) < 100 and not u[-1].isspace() and (u.isascii() or wide.isdisjoint(u))]
        lines = [plain[i:i + together] for i in range(0, len(plain), together)]
        texts = ["".join([new[i] for i in line]) for line in lines]
        made = [(line, a, b) for line, text, a, b in zip(lines, texts, *t.encode(texts)) if t.exact(text, a, b)]
        size = np.fromiter((len(u.encode()) for u in new), np.int64, len(new))
        while True:
            order = np.fromiter(chain.from_iterable(line for line, _, _ in made), np.int64)
            ends = np.cumsum(size[order])
            sides = [np.fromiter(chain.from_iterable(x[k] for x in made), np.int32) for k in (1, 2)]
            found = [np.cumsum(w[ids]) for ids, w in zip(sides, (t.a_sizes, t.b_sizes))]
            last = [np.searchsorted(f, ends) for f in found]
            parted = np.zeros(len(order), bool)
            for f, at in zip(found, last):
                parted |= f[at] != ends
            if not parted.any():
                break
            bad = set(order[parted].tolist())  # a token that runs over a unit's end: its line is encoded unit by unit
            made = [x for x in made if bad.isdisjoint(x[0])]
        alone = sorted(set(range(len(new))).difference(order.tolist()))
        rest = t.encode([new[i] for i in alone])
        first = len(self.known)
        self.exact = grown(self.exact, first + len(new))
        self.exact[first + order] = True
        for i, a, b in zip(alone, *rest):
            self.exact[first + i] = t.exact(new[i], a, b)
        order = np.concatenate([order, np.array(alone, np.int64)])
        for k in range(2):
            counts = np.concatenate([np.diff(last[k], prepend=-1), np.fromiter(map(len, rest[k]), np.int64, len(alone))])
            ids = np.concatenate([sides[k], np.fromiter(chain.from_iterable(rest[k]), np.int32)])
            end = self.used[k] + len(ids)
            self.ids[k] = grown(self.ids[k], end)
            self.ids[k][self.used[k]:end] = ids
            self.start[k], self.length[k] = (grown(x, first + len(new)) for x in (self.start[k], self.length[k]))
            self.length[k][first + order] = counts
            self.start[k][first + order] = self.used[k] + np.cumsum(counts) - counts
            self.used[k] = end
        self.known.update(zip(new, range(first, first + len(new))))
        self.held += sum(map(len, new))

    def numbers(self, units: pa.Array) -> np.ndarray:
        if len(self.known) > self.room or self.held > self.chars:
            self.reset()
        coded = units.dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, vocabulary, repeat(-1)), np.int64, len(vocabulary))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            first = len(self.known)
            self._learn([vocabulary[i] for i in unknown.tolist()])
            number[unknown] = np.arange(first, first + len(unknown))
        return number[coded.indices.to_numpy()]

    def tokens(self, k: int, number: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokenizer k for the units with these numbers (none where not kept), and ids per unit."""
        sizes = np.where(kept, self.length[k][number], 0)
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[k][np.repeat(self.start[k][number] - (ends - sizes), sizes) + place], sizes


def unit_starts(data: np.ndarray, bounds: np.ndarray, cuts: Iterable[str], whole: np.ndarray) -> np.ndarray:
    """Where units begin: texts, and white space after a letter.  Texts marked ``whole`` are one unit."""
    space, cut = np.zeros(256, bool), np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    cut[[ord(c) for c in cuts]] = True
    begins = cut[data]
    begins[1:] &= ~space[data[:-1]]
    for i in np.flatnonzero(whole).tolist():
        begins[bounds[i]:bounds[i + 1]] = False
    begins[bounds[:-1]] = True
    return np.flatnonzero(begins)


def open_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose end no token of the other side shares, by diagonal run skipping.

    ``a`` and ``b`` are increasing ends that finish alike.  From a shared boundary
    on, stretches of 1, 2, 4, ... ends at the current shift are compared as bytes;
    a stretch that differs is halved until the run's last token is found.
    """
    x, y = a.astype("<u8").tobytes(), b.astype("<u8").tobytes()
    u, v = memoryview(x).cast("Q"), memoryview(y).cast("Q")
    parted: list[int] = []
    i = j = 0
    n = len(u)
    while i < n:
        step = 1
        while i < n and x[8 * i:8 * (i + step)] == y[8 * j:8 * (j + step)]:
            i += step
            j += step
            step *= 2
        while step > 1 and i < n:
            step //= 2
            if x[8 * i:8 * (i + step)] == y[8 * j:8 * (j + step)]:
                i += step
                j += step
        if i >= n:
            break
        p, q, s, t = u[i], v[j], i, j
        while p != q:
            if p < q:
                i += 1
                p = u[i]
            else:
                j += 1
                q = v[j]
        parted += (s, i, t, j)
        i += 1
        j += 1
    marks = np.array(parted, np.int64).reshape(-1, 4)

    def opened(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        step = np.zeros(size + 1, np.int32)
        step[start] += 1
        step[end] -= 1
        return np.cumsum(step[:-1]) > 0

    return opened(len(a), marks[:, 0], marks[:, 1]), opened(len(b), marks[:, 2], marks[:, 3])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, on end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Aligned:
    """Tokens, groups and links of the documents of one block."""

    def __init__(self, texts: pa.Array, memory: UnitMemory):
        t = memory.tokenizers
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        padded = pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" "))  # a space before each text
        offsets = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset:padded.offset + len(padded) + 1]
        data = np.frombuffer(padded.buffers()[2], np.uint8)[:offsets[-1]]
        starts = unit_starts(data, offsets, t.cuts, whole)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int32)),
                                            padded.buffers()[2])
        number = memory.numbers(units)
        of = np.searchsorted(starts, offsets)  # each document's first unit
        kept = ~empty & (sums((~memory.exact[number]).astype(np.int64), of) == 0)
        units_kept = np.repeat(kept, np.diff(of))
        (self.a, a_sizes), (self.b, b_sizes) = (memory.tokens(k, number, units_kept) for k in (0, 1))
        self.a_doc = np.concatenate([[0], np.cumsum(a_sizes)])[of]
        self.b_doc = np.concatenate([[0], np.cumsum(b_sizes)])[of]
        a_open, b_open = open_ends(np.cumsum(t.a_sizes[self.a]), np.cumsum(t.b_sizes[self.b]))
        self.a_end, self.b_end = np.flatnonzero(~a_open) + 1, np.flatnonzero(~b_open) + 1  # behind each group
        self.in_a = np.diff(self.a_end, prepend=0)
        self.in_b = np.diff(self.b_end, prepend=0)
        self.group_doc = np.searchsorted(self.a_end, self.a_doc, side="right")  # each document's first group
        self.width = len(t.b_bytes)

    def group_texts(self) -> list[bytes]:
        """Each document's groups: ``a1,a2|b1;a3|b2,b3``."""
        tokens = len(self.a) + len(self.b)
        cells = np.zeros((tokens, 8), np.uint8)  # digits, then the sign that follows; unused bytes are 0
        for ids, ends, before, sign in ((self.a, self.a_end, self.b_end - self.in_b, "|"), (self.b, self.b_end, self.a_end, ";")):
            sizes = np.diff(ends, prepend=0)
            place = np.arange(len(ids)) + np.repeat(before, sizes)
            digits = np.char.mod("%d", np.arange(int(ids.max()) + 1 if len(ids) else 0)).astype("S7")
            row = digits.reshape(-1, 1).view(np.uint8).reshape(-1, 7)[ids]
            cells[place, :7] = row
            signs = np.full(len(ids), ord(","), np.uint8)
            signs[ends - 1] = ord(sign)
            cells[place, 7] = signs
        used = cells.ravel() != 0
        flat = cells.ravel()[used].tobytes()
        bound = np.concatenate([[0], np.cumsum(used.reshape(-1, 8).sum(axis=1))])[self.a_doc + self.b_doc].tolist()
        return [flat[a:max(a, b - 1)] for a, b in zip(bound, bound[1:])]  # without the last sign

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, link (a * width + b) and occurrences of each distinct link of each document, sorted."""
        docs = np.repeat(np.arange(len(self.group_doc) - 1), np.diff(self.group_doc))
        single = (self.in_a == 1) & (self.in_b == 1)
        keys = [docs[single] << 40 | self.a[self.a_end[single] - 1].astype(np.int64) * self.width + self.b[self.b_end[single] - 1]]
        times = [np.ones(len(keys[0]), np.int64)]
        many = np.flatnonzero(~single)
        if len(many):
            sides = []
            for ids, ends, sizes in ((self.a, self.a_end, self.in_a), (self.b, self.b_end, self.in_b)):
                group = np.repeat(np.arange(len(many)), sizes[many])
                one, count = np.unique(group << 32 | ids[spread((ends - sizes)[many], sizes[many])], return_counts=True)
                sides.append((one >> 32, one & 0xFFFFFFFF, count))
            (a_group, a_id, a_count), (b_group, b_id, b_count) = sides
            first = np.searchsorted(b_group, np.arange(len(many) + 1))
            partners = np.diff(first)[a_group]  # distinct ids of the other side in the same group
            i, j = np.repeat(np.arange(len(a_id)), partners), spread(first[a_group], partners)
            keys.append(docs[many][a_group[i]] << 40 | a_id[i] * self.width + b_id[j])
            times.append(a_count[i] * b_count[j])
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[new], np.add.reduceat(times, new) if len(new) else times
        return keys >> 40, keys & ((1 << 40) - 1), times


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """Alignments of all documents, and each block's list of distinct links.

    A row of a document (``a`` is null): block, doc_id, n_a, n_b, n_groups,
    n_links, ``groups`` as text, and its links: ``place`` in the block's list (as
    differences) and ``times``.  A row of a block (``a`` is set): the lists ``a``,
    ``b`` of linked ids, and ``held``, the number of its documents with them.

    Null and empty texts, and those whose tokens do not give their bytes back
    (after the space that the second tokenizer adds), have no tokens.  Every row
    is a document, repeated or not; other columns are ignored.  A text stays
    whole however long; a block of texts, or one longer text, is in memory at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(vocabulary_path(first), vocabulary_path(second))
        memory = UnitMemory(tokenizers)
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, max_bytes=block):
            found = Aligned(part.column("text"), memory)
            doc, link, times = found.links()
            listed, place, held = np.unique(link, return_inverse=True, return_counts=True)
            bound = np.searchsorted(doc, np.arange(part.num_rows + 1))
            step = np.diff(place, prepend=0)
            if len(step):
                starts = bound[:-1][np.diff(bound) > 0]
                step[starts] = place[starts]
            rows = part.num_rows
            per_doc = {
                "n_a": np.diff(found.a_doc), "n_b": np.diff(found.b_doc), "n_groups": np.diff(found.group_doc),
                "n_links": sums(found.in_a * found.in_b, found.group_doc)}
            offsets = pa.array(bound, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(rows, number)), "doc_id": part.column("doc_id"),
                **{k: pa.array(v, pa.int64()) for k, v in per_doc.items()},
                "groups": pa.array(found.group_texts(), pa.string()),
                "place": pa.ListArray.from_arrays(offsets, pa.array(step, pa.int32())),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                **{k: pa.nulls(rows, pa.list_(pa.int32())) for k in ("a", "b", "held")}})
            none = {k: pa.nulls(1, pa.int64()) for k in ("doc_id", *per_doc)}
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number]), **none, "groups": pa.nulls(1, pa.string()),
                "place": pa.nulls(1, pa.list_(pa.int32())), "times": pa.nulls(1, pa.list_(pa.int32())),
                **{k: pa.array([v.astype(np.int32)], pa.list_(pa.int32()))
                   for k, v in (("a", listed // found.width), ("b", listed % found.width), ("held", held))}})
            number += 1

    lists = ", ".join(f"{c} array<int>" for c in ("place", "times", "a", "b", "held"))
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   F.col("text").cast("string").alias("text")), run, (
        "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, " + lists))


def link_lists(table: DataFrame) -> DataFrame:
    """block, pos, a, b, held: the blocks' lists of links, a row each."""
    return table.filter(F.col("a").isNotNull()).select(
        "block", F.posexplode(F.arrays_zip("a", "b", "held")).alias("pos", "x")).select("block", "pos", "x.*")


def link_counts(lists: DataFrame) -> DataFrame:
    """a, b, n (documents that hold them linked), best (n is the highest of this a, ties included)."""
    counts = stage(lists.groupBy("a", "b").agg(F.sum("held").alias("n")), "link-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def linked(docs: DataFrame, first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``count_sum`` adds up, over a document's links, the number of documents that
    hold the same ids linked; ``n_best`` counts the links whose number is the
    highest of their first id.  Documents without tokens have zeros and an empty
    string.  Only a block's distinct links cross the network with their counts;
    a block meets them in one group, whose size its bytes bound.
    """
    made = aligned(docs, first, second, block).withColumn("groups_sha256", F.when(
        F.col("a").isNull(), F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))).drop("groups")
    table = stage(made, "aligned")
    lists = link_lists(table)
    known = lists.join(link_counts(lists), ["a", "b"]).select(F.col("block").alias("at"), "pos", "n", "best")
    rows = table.filter(F.col("a").isNull()).drop("a", "b", "held")

    def score(documents: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("pos")
        n = counts.column("n").to_numpy()
        best = counts.column("best").to_numpy().astype(np.int64)
        steps, times = documents.column("place").combine_chunks(), documents.column("times").combine_chunks()
        bound = steps.offsets.to_numpy().astype(np.int64)
        bound -= bound[0]
        step = steps.flatten().to_numpy().astype(np.int64)
        place = np.cumsum(step)
        filled = np.diff(bound) > 0
        place -= np.repeat((np.concatenate([[0], place]))[bound[:-1]][filled], np.diff(bound)[filled])
        times = times.flatten().to_numpy().astype(np.int64)
        out = documents.drop_columns(["place", "times", "block"])
        out = out.append_column("n_best", pa.array(sums(best[place] * times, bound)))
        return out.append_column("count_sum", pa.array(sums(n[place] * times, bound))).select(OUT)

    on_path(docs.sparkSession)
    scored = rows.groupBy("block").cogroup(known.groupBy("at")).applyInArrow(score, ", ".join(
        f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in OUT))
    return scored


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
