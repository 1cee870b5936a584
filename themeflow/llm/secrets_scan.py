"""Secret scan: fixed patterns, and novelty under a primed zstandard dictionary.

The patterns (assign, access, hex) report their spans always. The method adds
spans of kind novel: a candidate is a run of 16 or more token characters that
follows a sensitive word in its context and overlaps no span of the patterns.
Long words are such runs, too, and up to 64 characters zstandard leaves them as
dear as random ones; so a run with only one of the classes lower, upper, digit
needs ``one_class_chars``. The context has ``context_chars``
characters, also over line ends, and runs on over lines that are one token each
and, from the label of a PEM block, to the block's end. A word inside a run has
the rest of the run as a candidate. Its cost is
the marginal compressed size: bytes of (lead, candidate) less bytes of the lead
alone, with a raw dictionary made of common identifiers and of the code around
the candidate. A string that its surroundings or usual identifiers explain costs
little; one of ``min_bits`` or more bits per character is reported. From 64
literals on zstandard codes them by their frequency, and random text falls to
the entropy of its alphabet; so a longer candidate is judged by windows of
``window_chars``, each with what stands before it, and counts as its costliest
one.

Positions are code points, ends exclusive. A null or empty text has no spans.
Documents are scanned whole and row by row, also repeated rows; other columns
are ignored, whatever their names are.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from themeflow.llm.arrowtext import text_slices

KINDS = ("assign", "access", "hex", "novel")
# The patterns, the sensitive words and usual identifiers.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"key|token|secret|passw|pwd|auth|cred|bearer|private|signature", re.IGNORECASE | re.ASCII)
MIN_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_CANDIDATE)
#: Lines that are one candidate, quotes, commas and the like aside, from a line's end on.
TOKEN_LINES = re.compile(r"""(?:["'`,;:|>()\\+\x20\t\r]*+\n["'`,;:|>()\\\s]*+[A-Za-z0-9+/_=.-]{%d,}+"""
                         r"""(?=["'`,;:|>()\\+\x20\t\r]*+(?:\n|\Z)))+""" % MIN_CANDIDATE)
PEM = re.compile(r"-{4,5}\x20?(BEGIN|END)\x20[A-Z0-9\x20]+-{4}")
#: zstandard leaves fewer literals than this as they are.
RAW_LITERALS = 64
IDENTIFIERS = """access account address admin api apikey app application args array auth authorization aws azure base64
bearer bool bucket bytes class client cloud com config connection const content cookie count credential data database
date debug def default delete dict email encoding endpoint env error example false file float from function get hash
header host html http https id import index input int interface json jwt key kwargs lambda length let license list local
localhost log login master message method model module name new none null number object option org output package
param passwd password path port post private prod public query read region request response result return role root
secret self server service session set signature source ssh static status str string system table test text this time
timestamp token true type undefined uri url user username utf8 value var version void write www xml yaml
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"""


@dataclass(frozen=True)
class SecretSettings:
    min_assign: int = 6
    min_access: int = 20
    min_bits: float = 7.2
    context_chars: int = 48
    around_chars: int = 1024
    window_chars: int = 32
    one_class_chars: int = 24


def pattern_spans(text: str, s: SecretSettings) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and without
    overlap within a kind; matches too short are left out after matching."""
    out = []
    folded = text.casefold()
    if "pass" in folded or "secret" in folded or "token" in folded or "key" in folded:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= s.min_assign]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= s.min_access]
    # runs are maximal, so the length may stand in the pattern
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def marginal_bits(candidate: str, before: str, after: str) -> float:
    """Bits per character that the candidate adds to its surroundings."""
    primed = zstandard.ZstdCompressionDict(
        (IDENTIFIERS + "\n" + after + "\n" + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False,
                                       write_dict_id=False)
    lead = before[-32:].encode()
    return 8 * (len(squeeze.compress(lead + candidate.encode())) - len(squeeze.compress(lead))) / len(candidate)


def is_novel(text: str, a: int, b: int, s: SecretSettings, rest_known: bool = False) -> bool:
    """Whether the candidate, or a window of it if it is long, costs
    ``min_bits``. ``rest_known``: a longer candidate with this end did not."""
    after = text[b:b + s.around_chars]

    def costly(lo: int, hi: int) -> bool:
        return marginal_bits(text[lo:hi], text[max(0, lo - s.around_chars):lo], after) >= s.min_bits

    if b - a < RAW_LITERALS:
        return costly(a, b)
    w = s.window_chars
    return any(costly(lo, lo + w) for lo in ([a] if rest_known else [*range(a, b - w, w // 2), b - w]))


class _Run:
    """A longest run of token characters, and what is known of it."""

    def __init__(self, m: re.Match):
        self.start, self.end = m.span()
        self.classes = None
        self.carry = None
        self.reported = self.rejected = False

    def two_classes(self, text: str, a: int) -> bool:
        """In the part from ``a`` on: where each class is last, is kept."""
        if self.classes is None:
            token = text[self.start:self.end][::-1]
            found = (re.search(c, token) for c in ("[a-z]", "[A-Z]", "[0-9]"))
            self.classes = [self.end - 1 - m.start() if m else -1 for m in found]
        return sum(last >= a for last in self.classes) > 1


def _pem_ends(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Starts of PEM labels, and (end of the label, end of the block) of each."""
    starts, ends = [], []
    if "---" in text:
        for m in PEM.finditer(text):
            if ends and ends[-1][1] < 0:
                ends[-1] = (ends[-1][0], m.start())
            if m[1] == "BEGIN":
                starts.append(m.start())
                ends.append((m.end(), -1))
    # without an end there are only the token lines
    return starts, [(label, max(label, end)) for label, end in ends]


def novel_spans(text: str, base: list[tuple[int, int, int]], s: SecretSettings) -> list[tuple[int, int, int]]:
    if SENSITIVE.search(text) is None:
        return []
    out, runs = [], [_Run(m) for m in CANDIDATE.finditer(text)]
    begins, reach = [a for a, _, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    pem_starts, pem = _pem_ends(text)
    block = 0

    def carried(at: int) -> int:
        """Where the token lines end that follow the line that ends at ``at``."""
        nonlocal block
        if at >= block and (m := TOKEN_LINES.match(text, at)):
            block = m.end()
        return max(at, block)

    def judge(run: _Run, a: int):
        b = run.end
        if b - a < MIN_CANDIDATE or run.reported:
            return
        if b - a < s.one_class_chars and not run.two_classes(text, a):
            return
        before = bisect.bisect_left(begins, b)
        if before and reach[before - 1] > a:
            return
        if is_novel(text, a, b, s, run.rejected):
            out.append((a, 3, b))
            run.reported = True
        run.rejected = True

    at = done = 0       # the run at or behind the word; runs that were judged, or lie before all words
    for word in SENSITIVE.finditer(text):
        here = word.end()
        while at < len(runs) and runs[at].end <= here:
            at += 1
        if at == len(runs):
            break
        # a candidate starts within the context; it may run on beyond
        stop = here + s.context_chars
        line_end = text.rfind("\n", here, stop)
        if line_end >= 0:
            stop = max(stop, carried(line_end))
        label = bisect.bisect_right(pem_starts, word.start()) - 1
        if label >= 0 and here <= pem[label][0]:
            stop = max(stop, pem[label][1], carried(pem[label][0]))
        k = at if runs[at].start < here else max(at, done)
        while k < len(runs) and runs[k].start < stop:
            run = runs[k]
            judge(run, max(run.start, here))
            if run.carry is None:
                run.carry = carried(run.end)
            stop = max(stop, run.carry)
            k = max(k + 1, done)
        done = max(done, k)
    return out


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(docs: DataFrame, s: SecretSettings = SecretSettings(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id, number of spans of each pattern, a digest of
    these, and all spans."""
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [
        T.StructField(c, T.LongType()) for c in names[1:4]] + [T.StructField(c, T.StringType()) for c in names[4:]])

    def scan(batches):
        for part in text_slices(batches, text_col):
            counts, digests, spelled = ([], [], []), [], []
            for text in pc.fill_null(part.column(text_col), "").to_pylist():
                base = pattern_spans(text, s)
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(_spell(base).encode()).hexdigest())
                spelled.append(_spell(sorted(base + novel_spans(text, base, s))))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(digests, pa.string()), pa.array(spelled, pa.string())], names)

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
