"""Strings that can hold a match: one automaton over the literals of all patterns.

Every pattern has a set of literals of which a match holds at least one: a group of its ``needs``, or what its expression cannot do without.  All of them,
in lower case, are one Aho-Corasick automaton, so a content is read once, however many rules there are.  A hit leads to the string around it; only strings
with a hit leave the row, each with the patterns to try.  The automaton is a bounded table: its words are counted where it is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from outfall.functions.ship import by_value
from outfall.operators.extract import CONTEXT, MAX_STRING, MIN_STRING, PRINTABLE

#: Characters of all literals together; a larger pack has to be scanned in parts.
MAX_WORD_CHARS = 16 << 20
#: Bytes of small contents that are read as one text, about.
TOGETHER = 1 << 20
_PRINT = np.zeros(256, bool)
_PRINT[9] = True
_PRINT[32:127] = True
_WIDE = re.compile(rf"(?:[{PRINTABLE}]\x00){{{MIN_STRING},{MAX_STRING}}}".encode())
#: Where a row of a range of a file differs from a whole file: bounds of the strings it owns, the offset of its content, bytes to pass over first.
RANGE = ("range_start", "range_end", "content_start", "ascii_skip", "wide_skip")


def required(expression: str) -> list[str] | None:
    """Literals, in lower case, of which every match of ``expression`` holds one; None if it can do without any of three characters or more."""
    try:
        from re import _parser  # the standard library's own reading of an expression

        parsed = _parser.parse(expression)
    except (ImportError, re.error):
        return None

    def best(found: list[list[str]]) -> list[str] | None:
        return max((f for f in found if min(map(len, f)) >= 3), key=lambda f: min(map(len, f)), default=None)

    def walk(items) -> list[list[str]]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            found += [[run]] * bool(run)
            run = ""
            if name == "SUBPATTERN":
                found += walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                found += walk(value[2])
            elif name == "BRANCH":
                sides = [best(walk(side)) for side in value[1]]
                if all(sides):
                    found.append([word for side in sides for word in side])
        return found

    return best(walk(parsed))


def trigger(pattern: dict) -> tuple[str, list[str]]:
    """How to find strings for a pattern: ("words", literals), ("expression", [one]) or ("every", [])."""
    groups = [[x.lower() for x in (g[1:] if g[0] == "(?i)" else g)] for g in pattern["needs"] if g[0] != "re:"]
    if groups:
        return "words", max(groups, key=lambda g: min(map(len, g)))
    if pattern["needs"]:
        return "expression", [pattern["needs"][0][1]]
    words = required(pattern["regex"].replace("(?<", "(?P<") if "(?<" in pattern["regex"] and "(?<=" not in pattern["regex"] and "(?<!" not in pattern["regex"] else pattern["regex"])
    return ("words", words) if words else ("every", [])


@dataclass
class Finder:
    """The automaton, the few expressions without a literal, and what each pattern needs besides."""

    automaton: ahocorasick.Automaton
    patterns: list[list[int]]
    expressions: list[tuple[str, int]] = field(default_factory=list)
    every: list[int] = field(default_factory=list)
    needs: dict[int, list[tuple[bool, list[str]]]] = field(default_factory=dict)

    @staticmethod
    def of(patterns: list[dict]) -> Finder:
        words: dict[str, list[int]] = {}
        finder = Finder(ahocorasick.Automaton(), [])
        for p in patterns:
            kind, values = trigger(p)
            for value in dict.fromkeys(values):
                if kind == "words":
                    words.setdefault(value, []).append(p["pattern_ix"])
                else:
                    finder.expressions.append((value, p["pattern_ix"]))
            if kind == "every":
                finder.every.append(p["pattern_ix"])
            rest = [(g[0] == "(?i)", [x.lower() for x in g[1:]] if g[0] == "(?i)" else g) for g in p["needs"] if g[0] != "re:"]
            if rest:
                finder.needs[p["pattern_ix"]] = rest
        if sum(map(len, words)) > MAX_WORD_CHARS:
            raise ValueError(f"the literals of the pack have more than {MAX_WORD_CHARS} characters")
        for number, (word, own) in enumerate(words.items()):
            finder.automaton.add_word(word, (number, len(word)))
            finder.patterns.append(own)
        if words:
            finder.automaton.make_automaton()
        return finder

    def hits(self, text: str, lowered: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each hit, and the list of patterns it stands for (expressions follow the words)."""
        found = [(end + 1 - size, end + 1, number) for end, (number, size) in self.automaton.iter(lowered)] if self.patterns else []
        for k, (expression, _) in enumerate(self.expressions):
            found += [(*m.span(), len(self.patterns) + k) for m in re.finditer(expression, text)]
        out = np.array(found, np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]

    def wanted(self, number: int) -> list[int]:
        return self.patterns[number] if number < len(self.patterns) else [self.expressions[number - len(self.patterns)][1]]

    def holds(self, pattern: int, string: str, lowered: str) -> bool:
        return all(any(x in (lowered if folded else string) for x in words) for folded, words in self.needs.get(pattern, ()))


def _pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut at every ``MAX_STRING`` characters; what is left below ``MIN_STRING`` is no string."""
    n = -(-(ends - starts) // MAX_STRING)
    first = np.repeat(starts, n) + MAX_STRING * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    last = np.minimum(first + MAX_STRING, np.repeat(ends, n))
    keep = last - first >= MIN_STRING
    return first[keep], last[keep]


def _tried(finder: Finder, text: str, first: np.ndarray, last: np.ndarray) -> list[tuple[int, list[int]]]:
    """Numbers of the strings to look at, each with the patterns that stand a chance."""
    lowered = text.lower()
    begin, end, number = finder.hits(text, lowered)
    at = np.searchsorted(first, begin, side="right") - 1
    inside = at >= 0
    inside[inside] = end[inside] <= last[at[inside]]
    pairs = np.unique(at[inside] * (len(finder.patterns) + len(finder.expressions)) + number[inside])
    out: dict[int, set[int]] = {i: set(finder.every) for i in range(len(first))} if finder.every else {}
    for pair in pairs.tolist():
        i, k = divmod(pair, len(finder.patterns) + len(finder.expressions))
        out.setdefault(i, set()).update(finder.wanted(k))
    good = ((i, [p for p in sorted(own) if finder.holds(p, text[first[i]:last[i]], lowered[first[i]:last[i]])]) for i, own in sorted(out.items()))
    return [(i, own) for i, own in good if own]


Found = tuple[int, str, int, str, int, bytes, list[int]]


def find(finder: Finder, contents: list[bytes], bounds: list[tuple[int, int, int, int, int]]) -> Iterator[Found]:
    """(row, string, offset, encoding, window offset, window, patterns) of the strings of some contents, read as one text.

    ``bounds`` has the values of :data:`RANGE` for each; a content with bytes to pass over has to come alone.
    """
    data = b"\n".join(contents)
    size = np.array([len(c) for c in contents], np.int64)
    start = np.cumsum(size + 1) - size - 1
    ascii_skip, wide_skip = bounds[0][3:]

    def rows(text: str, first: np.ndarray, last: np.ndarray, offset: np.ndarray, encoding: str) -> Iterator[Found]:
        row = np.searchsorted(start, offset, side="right") - 1
        for i, patterns in _tried(finder, text, first, last):
            r = int(row[i])
            (low, high, base, *_), begin = bounds[r], int(start[r])
            at = int(offset[i]) - begin
            if low <= base + at < high:
                left = max(0, at - CONTEXT)
                yield r, text[first[i]:last[i]], base + at, encoding, base + left, contents[r][left:at + 2 * int(last[i] - first[i]) + CONTEXT], patterns

    marks = _PRINT[np.frombuffer(data, np.uint8)[ascii_skip:]].view(np.int8)
    edge = np.flatnonzero(np.diff(marks, prepend=0, append=0)) + ascii_skip
    if len(edge):
        first, last = _pieces(edge[::2], edge[1::2])
        yield from rows(data.decode("latin-1"), first, last, first, "ascii")
    if b"\0" in data:
        spans = np.array([m.span() for m in _WIDE.finditer(data, wide_skip)], np.int64).reshape(-1, 2)
        if len(spans):
            chars = (spans[:, 1] - spans[:, 0]) // 2
            first = np.cumsum(chars + 1) - chars - 1
            yield from rows("\n".join(data[a:b:2].decode("latin-1") for a, b in spans.tolist()), first, first + chars, spans[:, 0], "utf-16le")


def _groups(sizes: list[int | None], bounds: list[tuple[int, ...]]) -> Iterator[list[int]]:
    """Rows to read together, of about ``TOGETHER`` bytes; a null content is in none."""
    group, total = [], 0
    for i, size in enumerate(sizes):
        if size is None:
            continue
        alone = any(bounds[i][3:])
        if group and (alone or total + size > TOGETHER):
            yield group
            group, total = [], 0
        group.append(i)
        total += size
        if alone:
            yield group
            group, total = [], 0
    if group:
        yield group


def _search(finder: Finder, n_keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    names = ["string", "string_offset", "encoding", "window_offset", "window", "pattern_ixs"]
    for batch in batches:
        bounds = list(zip(*(batch.column(n_keys + 1 + i).to_pylist() for i in range(len(RANGE))), strict=True))
        data = batch.column(n_keys)
        for group in _groups(pc.binary_length(data).to_pylist(), bounds):
            found = list(find(finder, [data[i].as_py() for i in group], [bounds[i] for i in group]))
            if found:
                row, *columns = zip(*found, strict=True)
                index = pa.array([group[r] for r in row], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(n_keys)), *map(pa.array, columns, kinds)], names=[*batch.schema.names[:n_keys], *names])


def candidate_strings(artifacts: DataFrame, patterns: list[dict], keys: list[str], content: str = "content") -> DataFrame:
    """Keys, string, string_offset, encoding, window_offset, window, pattern_ixs: strings that at least one pattern may match.

    Rows with the columns of :data:`RANGE` are parts of files and give the strings they own, at offsets of the file.  A null content gives none.
    """
    whole = {"range_start": "0L", "range_end": f"{2**62}L", "content_start": "0L", "ascii_skip": "0L", "wide_skip": "0L"}
    bounds = [name if name in artifacts.columns else f"{whole[name]} AS {name}" for name in RANGE]
    rows = artifacts.selectExpr(*(f"`{k}`" for k in keys), f"`{content}`", *bounds)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    found = "string string, string_offset bigint, encoding string, window_offset bigint, window binary, pattern_ixs array<int>"
    return rows.mapInArrow(partial(_search, Finder.of(patterns), len(keys)), f"{kinds}, {found}")


by_value(__name__)
