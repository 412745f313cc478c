"""Secret scans: assignments, access keys, hexadecimal runs, and strings whose
sliding-window Shannon entropy is high for their character class.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and
then by kind in the order of ``KINDS``. Base kinds are the leftmost
non-overlapping matches of their patterns, those that are too short dropped.
``entropy`` spans are the windows of candidate strings (runs of letters, digits
and ``+/_=-``) whose entropy reaches the threshold of the candidate's class,
merged; the entropy is kept up to date by counts as the window moves. Candidates
are what base spans leave of a run, each part on its own. An
allow-list suppresses candidates that are words, numbers, dates or examples, and windows that touch a filler such as ``xxxx``;
letters whose case changes as often as in random keys aren't words. Random letters
of one case can't be told from words by these means and are left.

Defined results: a null or empty text has no span; the length of a text is not
limited; equal rows give equal results; other columns are kept by ``redact`` and
ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import slices, table, text_column

KINDS = ("assign", "access", "hex", "entropy")

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 starts where the whole run does

#: Every access key and hex run of sufficient length lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINTS = "+/_=-"
WINDOW = 20
#: Bits a character that a window of ``WINDOW`` must have, by class of the candidate.
THRESHOLDS = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
ALLOW = re.compile(
    r"[0-9+/_=-]+"  # numbers and dates
    r"|.*(?:EXAMPLE|example).*"  # said to be no secret
)
#: Fillers: no window that touches one is a secret.
FILLERS = re.compile(r"[xX]{4,}|0123456789|abcdefgh|ABCDEFGH")
#: Words, also joined ones and one number at the end.
WORDS = re.compile(r"[A-Za-z][A-Za-z_/+=-]*[0-9]{0,4}")
#: Where case changes inside a word; with so many changes in a window, letters aren't words.
CASE = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[a-z])")
CASE_CHANGES = 5
_CLOGC = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def character_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def is_allowed(s: str) -> bool:
    """Whether a candidate is words, a number, a date or an example."""
    if ALLOW.fullmatch(s):
        return True
    if not WORDS.fullmatch(s):
        return False
    changes = [m.start() for m in CASE.finditer(s)]
    return all(b - a >= WINDOW for a, b in zip(changes, changes[CASE_CHANGES - 1 :], strict=False))


def entropy_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """The merged windows of ``s`` with an entropy of ``least`` or more."""
    if len(s) < width:
        return []
    table_ = _CLOGC if width == WINDOW else [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total, log_width, found = 0.0, math.log2(width), []
    for i, ch in enumerate(s):
        if i >= width:
            old = s[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += table_[c - 1] - table_[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += table_[c + 1] - table_[c]
        if i >= width - 1 and log_width - total / width >= least - 1e-9:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of the base kinds."""
    return sorted(_assigns(text) + [x for m in RUN.finditer(text) for x in _in_run(m.group(0), m.start())])


def _assigns(text: str) -> list[tuple[int, int, int]]:
    if not ("=" in text or ":" in text):
        return []
    low = text.lower()
    if not any(w in low for w in ASSIGN_WORDS):
        return []
    return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]


def _in_run(run: str, at: int) -> list[tuple[int, int, int]]:
    found = [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= ACCESS_MIN] if "AKIA" in run else []
    return found + [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run)]


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a text, as (start, kind, end)."""
    base, runs = _assigns(text), []
    for m in RUN.finditer(text):
        run, at = m.group(0), m.start()
        base += _in_run(run, at)
        if len(run) >= WINDOW:
            runs.append((run, at))
    base.sort()
    more = []
    for part, bare, at in _outside(runs, base):
        if len(part) >= WINDOW and not is_allowed(bare):
            least = THRESHOLDS[character_class(part)]
            more += [(at + s + a, 3, at + s + b) for s, own in _between_fillers(part) for a, b in entropy_windows(own, WINDOW, least)]
    return base, sorted(base + more)


def _between_fillers(part: str) -> list[tuple[int, str]]:
    """(place, text) of what fillers leave of a candidate; where there is one, what is left must not be words or a number itself."""
    cuts = [m.span() for m in FILLERS.finditer(part)]
    starts, ends = [0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(part)]
    found = [(a, part[a:b]) for a, b in zip(starts, ends, strict=True) if b - a >= WINDOW]
    return [(a, own) for a, own in found if not cuts or not is_allowed(own.strip(JOINTS))]


def _outside(runs: list[tuple[str, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[str, str, int]]:
    """(part, it without separators beside a base span, place): what the spans of
    ``base`` leave of ``runs`` (run, place), both ordered by place."""
    k = done = 0
    for run, at in runs:
        end = at + len(run)
        start = max(at, done)
        while k < len(base) and base[k][0] < end:
            s, _, e = base[k]
            if s > start:
                part = run[start - at : s - at]
                yield part, part.rstrip(JOINTS) if start == at else part.strip(JOINTS), start
            done = max(done, e)
            start = max(start, e)
            k += 1
        if start < end:
            part = run[start - at :]
            yield part, part if start == at else part.lstrip(JOINTS), start


def as_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of (kind, start, end), n_base): all spans of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            both = [find_spans(t) for t in part.column("_text").to_pylist()]
            sums = [hashlib.sha256(as_string(b).encode()).hexdigest() for b, _ in both]
            number = [[sum(k == kind for _, k, _ in b) for b, _ in both] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *(pa.array(n, pa.int64()) for n in number), pa.array(sums, pa.string()), pa.array([as_string(a) for _, a in both], pa.string())],
                names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = df.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(find, f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)


def hide(text: str, mark: str = "[{}]") -> str:
    """The text with every span replaced by its kind; overlapping spans as one."""
    out, done = [], 0
    for s, k, e in find_spans(text)[1]:
        if s >= done:
            out += [text[done:s], mark.format(KINDS[k].upper())]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets in ``text_col`` replaced; a null text stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            i = part.schema.get_field_index(text_col)
            texts = [t if t is None else hide(t) for t in part.column(i).to_pylist()]
            yield part.set_column(i, part.schema.field(i), pa.array(texts, part.schema.field(i).type))

    return df.mapInArrow(work, df.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
