"""Secret scanning with one combined deterministic automaton.

All rules are compiled, by subset construction and minimisation, into one array
of transitions that reads a text's bytes once, from the end: a state tells for
which rules a match begins there.  Each rule then takes its leftmost longest
matches one after another, its own small automaton running over the matched
bytes only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.automata import Automaton, compile_rules, match_end, match_starts
from cohortlens.llm.common import map_batches, slices


class Rule(NamedTuple):
    """``head`` then ``secret``; a match whose secret is shorter than ``least`` is dropped.

    A match goes on over ``tail`` as far as that fits.
    """

    kind: str
    head: str
    secret: str
    least: int
    any_case: bool = False
    tail: str = ""


#: What stands between the lines of a key (also as escapes, quoted or indented), a line's
#: characters, and lines that name a cipher or the like.
_GAP, _LINE, _NOTE = r"""([\x20\x09\x0a\x0d"',>]|\\[nr])+""", "[A-Za-z0-9+/]", r"[A-Z][A-Za-z]*(-[A-Z][A-Za-z]*)*:\x20[\x20A-Za-z0-9,.()+/=-]*"
_NOTES, _END = f"({_GAP}{_NOTE})*", "-----END ([A-Z]+ )*PRIVATE KEY-----"
#: The lines of a key up to its END, or, if that is missing, full lines and one short one.
_KEY = f"{_NOTES}({_GAP}{_LINE}+={{0,2}})*({_GAP})?{_END}|{_NOTES}({_GAP}{_LINE}{{16,}}={{0,2}})+({_GAP}{_LINE}{{1,15}}={{0,2}})?"

#: The rules of the contract.  A run of hexadecimal digits is one match, so its
#: least length is part of the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", "", r"[0-9a-f]{24,}", 24),
)
#: Further well-known forms of credentials.
MORE = (
    Rule("private_key", "", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27, tail=_KEY),
    Rule("github", "", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", "://[A-Za-z0-9._-]+:", "[A-Za-z0-9!#$%&*+._~-]+@", 7),
)
RULES = BASE + MORE


class Scanner(NamedTuple):
    rules: tuple[Rule, ...]
    found: Automaton
    own: tuple[tuple[Automaton, Automaton], ...]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted, of all kept matches."""
        out, free = [], [0] * len(self.rules)
        for at, mask in reversed(match_starts(self.found, data)):
            for i, rule in enumerate(self.rules):
                if mask >> i & 1 and at >= free[i]:
                    head, secret = self.own[i]
                    begin = match_end(head, data, at)
                    end = match_end(secret, data, begin)
                    free[i] = end
                    if end - begin >= rule.least:
                        out.append((at, i, end))
        return sorted(out)


def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    case = [r.any_case for r in rules]
    found = compile_rules([r.head + r.secret for r in rules], case, backwards=True, search=True)
    return Scanner(rules, found, tuple(
        (compile_rules([r.head], [r.any_case]), compile_rules([f"{r.secret}({r.tail})?" if r.tail else r.secret], [r.any_case]))
        for r in rules))


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}  # in each Python worker


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = compiled(rules)
    return _SCANNERS[rules]


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points instead of bytes."""
    if not spans or data.isascii():
        return spans
    marks = sorted({x for start, _, end in spans for x in (start, end)})
    count, last, point = 0, 0, {}
    for mark in marks:
        count += len(data[last:mark].decode("utf-8"))
        last = mark
        point[mark] = count
    return [(point[start], i, point[end]) for start, i, end in spans]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the spans of all matches, by start, then rule; in code points, end exclusive.

    Matches of one rule do not overlap; those of different rules may.  A null or
    empty text has no spans, a repeated row gives them again, and other columns
    are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for part in slices(batches):
            out = []
            for data in part.column("text").cast(pa.binary()).to_pylist():
                found = _points(data, scanner.spans(data)) if data else []
                out.append([{"kind": rules[i].kind, "start": start, "end": end} for start, i, end in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, _SPANS)], ["doc_id", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       run, f"doc_id bigint, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every match replaced by ``mark``; overlapping matches become one mark.

    All rows and columns stay; ``n_chars``, if there, is the new length where the
    text changed.  Null texts stay null.
    """
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for part in slices(batches):
            columns = {c: part.column(c) for c in names}
            texts = columns["text"].cast(pa.binary()).to_pylist()
            changed = {}
            for row, data in enumerate(texts):
                found = scanner.spans(data) if data else []
                if found:
                    pieces, at = [], 0
                    for start, _, end in found:
                        if start >= at:
                            pieces += [data[at:start], mark.encode()]
                        at = max(at, end)
                    texts[row] = b"".join([*pieces, data[at:]])
                    changed[row] = len(texts[row].decode())
            if changed:
                columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    for row, n in changed.items():
                        sizes[row] = n
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return map_batches(docs, run, fields)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts per base rule, SHA-256 of the base spans, and all spans as text."""
    kinds = [r.kind for r in base]
    counts = [_count(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias(
        "base_sha256"), listed(F.col("spans")).alias("spans"))
