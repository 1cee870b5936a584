"""Benchmark decontamination: test items in documents, edits allowed.

An item of m characters may differ by e = floor(error_rate * m) edits
(insertions, deletions, replacements). It is cut into e + 1 pieces; a place
with at most e edits leaves one piece whole (pigeonhole), so an Aho-Corasick
scan for all pieces finds every place. The text around each hit is verified by
Myers' bit-parallel distance, with the item as the bit vector and free ends in
the text. Every result is exact: a pair (document, item) is found if and only
if some part of the document is within the item's budget.

Texts and items are compared with A-Z lower-cased and white space runs as one
blank. Items of fewer than ``min_chars`` characters have no error budget and
match whole words only; null and empty ones match nothing; items with equal
texts match alike. Items are
sent in blocks of at most ``block_chars``, whatever the size of their table;
documents are scanned for one block after the other, and never shuffled. A null
or empty text holds no item. Repeated document rows or ids each give their own
rows. Other columns pass ``remove_contaminated`` unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from themeflow.llm.arrowtext import text_slices, whole_texts


@dataclass(frozen=True)
class MatchSettings:
    error_rate: float = 0.08
    min_chars: int = 24
    block_chars: int = 1 << 20

    def budget(self, item: str) -> int:
        return int(self.error_rate * len(item)) if len(item) >= self.min_chars else 0

    def is_short(self, item: str) -> bool:
        return len(item) < self.min_chars


def plain(texts: pa.Array) -> list[str]:
    """Texts as they are compared."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
    return pc.ascii_trim(pc.binary_join(words, " "), characters=" ").to_pylist()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 parts of about equal length, with their places."""
    cuts = [k * len(item) // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def item_blocks(items: DataFrame, s: MatchSettings, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        text = plain(pa.array([row[1]], pa.string()))[0]
        if not text:
            continue
        if block and size + len(text) > s.block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


class Myers:
    """Least edit distance of one pattern to any part of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.at = defaultdict(int)
        for i, c in enumerate(pattern):
            self.at[c] |= 1 << i

    def least(self, text: str) -> int:
        mask, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = mask, 0, self.m
        best, at = score, self.at
        for c in text:
            eq = at.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (mask & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph, mh = (ph << 1) & mask, (mh << 1) & mask
            plus = mh | (mask & ~(xv | ph))
            minus = ph & xv
        return best


class ItemScanner:
    """All items of a block against one text after the other."""

    def __init__(self, block: list[tuple[int, str]], s: MatchSettings):
        self.texts = [text for _, text in block]
        self.ids = [item for item, _ in block]
        self.budgets = [s.budget(text) for text in self.texts]
        self.short = [s.is_short(text) for text in self.texts]
        self.patterns: dict[int, Myers] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, text in enumerate(self.texts):
            for at, piece in pieces(text, self.budgets[k]):
                places[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(item id, edits) of the items that the text holds."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, at in where:
                start = end + 1 - length - at
                lo = max(0, start - self.budgets[k])
                hi = start + len(self.texts[k]) + self.budgets[k]
                own = windows.setdefault(k, [])
                for w in reversed(own[-4:]):       # hits come in order of their ends
                    if lo <= w[1] and hi >= w[0]:
                        w[0], w[1] = min(w[0], lo), max(w[1], hi)
                        break
                else:
                    own.append([lo, hi])
        for k, own in windows.items():
            budget, item = self.budgets[k], self.texts[k]
            if self.short[k]:       # found somewhere; as words, too?
                if f" {item} " in f" {text} ":
                    yield self.ids[k], 0
                continue
            if item in text:
                yield self.ids[k], 0
                continue
            if k not in self.patterns:
                self.patterns[k] = Myers(item)
            best = min(self.patterns[k].least(text[lo:hi]) for lo, hi in own)
            if best <= budget:
                yield self.ids[k], best


def _blocks(items: DataFrame, s: MatchSettings, id_col: str, text_col: str) -> list:
    sc = items.sparkSession.sparkContext
    return [sc.broadcast(b) for b in item_blocks(items, s, id_col, text_col)]


def contamination(docs: DataFrame, items: DataFrame, s: MatchSettings = MatchSettings(), id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: their ids and the edits."""
    own = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, own), T.StructField(item_col, items.schema[item_col].dataType),
                           T.StructField("edits", T.IntegerType())])
    kind = to_arrow_type(items.schema[item_col].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, s, item_col, item_text_col):
        def scan(batches, block=block):
            scanner = ItemScanner(block.value, s)
            for part in text_slices(batches, text_col):
                rows = [(row, item, edits) for row, text in enumerate(plain(part.column(text_col)))
                        for item, edits in scanner.find(text)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int32())],
                    [id_col, item_col, "edits"])
        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(scan, schema))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, s: MatchSettings = MatchSettings(),
                        text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for block in _blocks(items, s, item_col, item_text_col):
        def keep(batches, block=block):
            scanner = ItemScanner(block.value, s)
            for part in text_slices(batches, text_col):
                clean = [next(scanner.find(text), None) is None for text in plain(part.column(text_col))]
                yield part.filter(pa.array(clean, pa.bool_()))
        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def brute_force(docs: list[tuple], items: list[tuple], s: MatchSettings = MatchSettings()) -> list[tuple]:
    """What ``contamination`` must give, by dynamic programming, for tests."""
    out = []
    for item, text in items:
        p = plain(pa.array([text], pa.string()))[0]
        for doc, body in docs:
            t = plain(pa.array([body], pa.string()))[0]
            if s.is_short(p):
                out += [(doc, item, 0)] if p and f" {p} " in f" {t} " else []
                continue
            row, best = list(range(len(p) + 1)), len(p)
            for c in t:
                new = [0]
                for i, x in enumerate(p, 1):
                    new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
                row, best = new, min(best, new[-1])
            if best <= s.budget(p):
                out.append((doc, item, best))
    return out
