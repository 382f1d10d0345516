"""Secret scans: fixed credential patterns and password guess-cost segmentation.

Values in a credential context (``passphrase: ...``, ``DB_PASS=...``,
``Authorization: Bearer ...``) are segmented into words, dates, repeats, keyboard walks and brute-force
spans; the segmentation of least total guess cost is found by dynamic
programming over end positions.  A value whose cheapest segmentation needs
``10**MIN_LOG10_GUESSES`` guesses or more is a secret; a value that is cheap
to guess is ordinary text and stays.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, fresh
from vantage.llm.spans import joined

KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
MIN_LOG10_GUESSES = 10.0

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN = 12

#: Names of credential contexts that the base kinds do not name, or whose value holds other characters, as parts of a longer name
#: (``DB_PASS``, ``access-token-id``, ``dbPassword``).  A match takes the rest of the name, so that all matches are found in linear time.
CONTEXT = re.compile(
    r"""(?ai)(?:(?<![a-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|auth(?:orization)?|bearer"""
    r"""|credentials?|private[ _-]?key|access[ _-]?key|client[ _-]?secret|login)(?:(?![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))[a-z0-9_-]*+"""
    r"""(?:(?:(?<=api)|(?<=access)|(?<=private))\x20key(?![a-z0-9]))?""")
#: From a context's name to its value: a separator between any blanks, and the scheme of an authorization.
TO_VALUE = re.compile(r"""(?ai)["']?[ \t]*+(?:=>|[:=])[ \t]*+["']?(?:(?:bearer|basic|token)[ \t]++["']?)?(?=[^\s"'<>]{6})""")
#: ``Bearer <value>`` without a separator; such a value holds a digit or a capital after a small letter, as words of prose do not.
TO_BARE = re.compile(r"""(?a)[ \t]++(?=[^\s"'<>]{6})""")
BARE = re.compile(r"[0-9]|[a-z][A-Z]")
VALUE = re.compile(r"""(?a)[^\s"'<>]*""")

# Frequent password words, most frequent first (the position is the guess rank).
WORDS = (
    "password pass admin welcome login letmein dragon monkey master hello freedom whatever shadow sunshine princess football "
    "baseball superman batman trust love secret summer winter spring autumn money computer internet user test guest root "
    "default change example sample token key value name the and for you with that this from your have not are was "
    "service server client data base access private public user account bank home work family friend happy lucky star "
    "silver golden orange purple yellow green black white blue red tiger lion eagle wolf bear horse flower cookie cheese "
    "january february march april may june july august september october november december monday friday sunday"
).split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oleastasi")
_MONTHDAYS = 366 * 119
_SEP = "-/._"


def neighbours() -> dict[str, frozenset[str]]:
    """Keys next to each key: left, right, and the two touched in the rows above and below."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            near = {row[k] for k in (i - 1, i + 1) if 0 <= k < len(row)}
            for other, shift in ((r - 1, (0, 1)), (r + 1, (-1, 0))):
                if 0 <= other < len(ROWS):
                    near |= {ROWS[other][i + s] for s in shift if 0 <= i + s < len(ROWS[other])}
            out[c] = near
    return {c: frozenset(v) for c, v in out.items()}


NEAR = neighbours()
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
#: Counts of a repeat, and keys of a walk, that are segments of their own from every start; of a repeat also as many as there are.
SPELLED = 24


def key_step(a: str, b: str) -> tuple[int, int] | None:
    """Direction from key ``a`` to its neighbour ``b`` (rows, places), or nothing if they are not neighbours."""
    if b not in NEAR.get(a, ()):
        return None
    return _PLACE[b][0] - _PLACE[a][0], _PLACE[b][1] - _PLACE[a][1]


def counts(least: int, most: int) -> list[int]:
    return [*range(least, min(most, SPELLED) + 1), *([most] if most > SPELLED else [])]


DATE = re.compile(r"(?a)(?:(?:19|20)\d\d)([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


class GuessCost:
    """log10 of the guesses for a value under its cheapest segmentation."""

    def __init__(self, words: list[str] | None = None):
        self.rank = {}
        for k, w in enumerate(words if words is not None else WORDS):
            if len(w) > 2:
                self.rank.setdefault(w.lower(), log10(k + 2))
        self.sizes = sorted({len(w) for w in self.rank})

    def brute(self, c: str) -> float:
        """One brute-force character costs the size of its class."""
        if c.isdigit():
            return 1.0
        if c.isalpha():
            return log10(26) if c.isascii() else 2.0
        return log10(33)

    def arcs(self, v: str) -> dict[int, list[tuple[int, float, str]]]:
        """Candidate segments by start: ``(end, cost, kind)``."""
        low, out = v.lower(), {}
        plain = low.translate(LEET) if low.isascii() else low
        add = lambda i, j, cost, kind: out.setdefault(i, []).append((j, cost, kind))
        n = len(v)
        if len(low) == n:
            for i in range(n):
                for size in self.sizes:
                    if i + size > n:
                        break
                    w = low[i:i + size]
                    extra = 0.0 if v[i:i + size] == w else log10(2 if v[i:i + size].istitle() else 4)
                    if w in self.rank:
                        add(i, i + size, self.rank[w] + extra, "word")
                    elif plain[i:i + size] in self.rank:
                        add(i, i + size, self.rank[plain[i:i + size]] + extra + log10(4), "word")
        for m in DATE.finditer(v):
            year = m.end() - m.start() == 4
            add(m.start(), m.end(), log10(119 if year else _MONTHDAYS) + (0 if year or v[m.start():m.end()].isdigit() else log10(len(_SEP))), "date")
        for size in (1, 2, 3, 4):  # repeated blocks from every start: the block and the count
            run = 0  # characters from i on that equal those a block further
            for i in range(n - size - 1, -1, -1):
                run = run + 1 if v[i] == v[i + size] else 0
                most, block = run // size + 1, v[i:i + size]
                if most < (3 if size == 1 else 2) or (size > 1 and len(set(block)) == 1):
                    continue
                price = sum(map(self.brute, block))
                for k in counts(3 if size == 1 else 2, most):
                    add(i, i + k * size, price + log10(k), "repeat")
        if len(low) == n:  # keyboard walks from every start: the start key, then few ways a step
            steps = [key_step(a, b) for a, b in zip(low, low[1:])]
            for i in range(n - 3):
                turns, j = 0, i
                while j < n - 1 and steps[j] and j + 2 - i <= SPELLED:
                    turns += j == i or steps[j] != steps[j - 1]
                    j += 1
                    if j - i >= 3:
                        add(i, j + 1, log10(47) + log10(j - i + 1) + 0.3 * turns, "walk")
        return out

    def segments(self, v: str) -> tuple[float, list[tuple[int, int, str]]]:
        """Least log10 guesses and its segments; linear in the length times the longest word."""
        n, arcs = len(v), self.arcs(v)
        best, back = [0.0] + [float("inf")] * n, [(0, "")] * (n + 1)
        for i in range(n):
            here = best[i]
            c = here + self.brute(v[i])
            if c < best[i + 1]:
                best[i + 1], back[i + 1] = c, (i, "brute")
            for j, cost, kind in arcs.get(i, ()):
                if here + cost < best[j]:
                    best[j], back[j] = here + cost, (i, kind)
        out, j = [], n
        while j:
            i, kind = back[j]
            if out and kind == "brute" == out[-1][2]:
                out[-1] = (i, out[-1][1], kind)
            else:
                out.append((i, j, kind))
            j = i
        return best[n], out[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def blocks(v: str, i: int, j: int, kind: str) -> range:
    """Where a segment of ``v`` can be entered at no more than its cost: its start, and the blocks of a repeat."""
    step = next((p for p in (1, 2, 3, 4) if kind == "repeat" and v[i:j - p] == v[i + p:j]), j - i)
    return range(i, j, step)


def all_spans(text: str, cost: GuessCost, least: float = MIN_LOG10_GUESSES) -> tuple[list, list]:
    """Base spans, and base spans plus ``guess`` spans (the value alone) of costly values that no base span covers."""
    base = base_spans(text)
    starts, ends = [], []  # base spans by start, with the farthest end so far
    for s, e in sorted((s, e) for _, s, e in base):
        starts.append(s)
        ends.append(max(e, ends[-1] if ends else 0))
    more, far = [], 0
    stop = end = 0  # of the last run of value characters, and of the value in it
    ends_at: set[int] = set()  # where a segment of that value's cheap segmentation begins
    for m in CONTEXT.finditer(text):
        bare = None
        to = TO_VALUE.match(text, m.end())
        if not to and m[0].lower().endswith("bearer"):
            to = bare = TO_BARE.match(text, m.end())
        if not to:
            continue
        s = to.end()
        if s >= stop:
            end = stop = VALUE.match(text, s).end()
            while end > s and text[end - 1] in ".,;:!?)]}":
                end -= 1
            ends_at = set()
        e = end
        k = bisect.bisect_right(starts, s)
        # a costly value covers the contexts inside it; a cheap one is cheap from each of its segments on
        if e - s < 6 or e <= far or s in ends_at or k and ends[k - 1] >= e or bare and not BARE.search(text, s, e):
            continue
        total, parts = cost.segments(text[s:e])
        if total >= least:
            more.append(("guess", s, e))
            far = e
        else:
            ends_at |= {s + x for part in parts for x in blocks(text[s:e], *part)}
    return base, base + more


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    runs: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def scan(text: Column, words: list[str] | None = None, least: float = MIN_LOG10_GUESSES) -> Column:
    """Struct of the counts, the base digest, all spans and the redacted text of ``text``."""

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string, redacted string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cost = GuessCost(words)
        for part in parts:
            rows = []
            for t in part:
                base, every = all_spans(t, cost, least)
                n = [sum(k == kind for k, _, _ in every) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base, KINDS).encode()).hexdigest(), joined(every, KINDS), redacted(t, every) if every else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "redacted"])

    return found(F.coalesce(text, F.lit("")))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, counts by kind, ``base_sha256``, ``spans``.

    No shuffle.  A null text is scanned as empty (no spans); a null id stays
    null; repeated rows stay repeated; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    got = docs.select(col(id_col).alias("id"), scan(col(text_col)).alias("got"))
    return got.select(F.col("id").alias(id_col), *[f"got.{c}" for c in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by a mark; all columns and rows stay, null texts stay null."""
    bound_batches(docs.sparkSession)
    (tmp,) = fresh(docs, "scan")
    got = docs.withColumn(tmp, scan(col(text_col))["redacted"])
    return got.select(*[F.coalesce(col(tmp), col(c)).alias(c) if c == text_col else col(c) for c in docs.columns])


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``length_col``, where it exists, set to the code points of the text (a null text keeps its value)."""
    if length_col not in docs.columns:
        return docs
    n = F.coalesce(F.length(col(text_col)).cast(docs.schema[length_col].dataType), col(length_col))
    return docs.select(*[n.alias(c) if c == length_col else col(c) for c in docs.columns])
