"""Secrets in texts: fixed shapes, and strings that are too random to be words.

The second kind slides a window over every candidate string and follows the
Shannon entropy of its characters, class by class, with counts that change by one
character at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanset.llm.common import per_batch, release, small_batches

# Shapes with the least length of what they find (fixed by the contract of the operator).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 12, "access": 18, "hex": 16}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Candidate strings of the entropy scan, and its window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Character classes, narrowest first, with the bits per character from which a window counts as random. Each bound is
# one that at most 1 % of windows drawn evenly from the class stay below (300,000 drawn for each size). Digits
# alone are counters and dates: never random.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    ("digits", frozenset(DIGITS), math.inf),
    ("hex", frozenset(DIGITS + "abcdefABCDEF"), 2.9),
    ("lower", frozenset(LOWER), 3.2),
    ("upper", frozenset(UPPER), 3.2),
    ("base32", frozenset(UPPER + "234567="), 3.3),
    ("lower+digits", frozenset(LOWER + DIGITS), 3.4),
    ("upper+digits", frozenset(UPPER + DIGITS), 3.4),
    ("letters", frozenset(LOWER + UPPER), 3.55),
    ("base62", frozenset(UPPER + LOWER + DIGITS), 3.6),
    ("base64", frozenset(UPPER + LOWER + DIGITS + "+/_=-"), 3.6),
)
# Strings that look random and are not secret, where they stand apart from letters and digits.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # identifiers in the usual grouping
    r"sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*",  # checksums that are meant to be read
)
# Bits that a letter (column) costs after another (row) in words: counted over English, with common German, French and
# Spanish words. Drawn evenly it costs 4.7.
PAIRS = (
    "95449455577443959343468879 37672888369376479456398968 49684892495588389674589989 37762687399475489446486879 "
    "57447666498442867235567588 48773488399467378463498977 48782865495574589356389997 27872877396665389464597978 "
    "56354547998453476543869796 27673777576777367757377777 46662655466465566546565666 36852777297368377854489969 "
    "36872899396746439867596989 49534636496786489842669987 76448466697442659244476889 38773396598488349254598969 "
    "66666666666665666556166666 36552757495755478534487978 48372766397668448842597969 38682795398587469345476965 "
    "55463566679452759344969879 38891889399878389888898999 36663665266665466456566666 35454566466556636653666556 "
    "35455666566554436544665666 37662676377566567666375766"
).split()
# Bits of a step between kinds of characters in names made of words and numbers, before the bits of the character itself.
# What separates parts says nothing, nor do digits after digits: random keys come in groups and with numbers, too.
STEPS = {
    "lower": {"lower": 0.3, "upper": 3.0, "digit": 3.5},
    "upper": {"lower": 0.5, "upper": 0.5, "digit": 3.5},
    "digit": {"lower": 3.0, "upper": 3.0},
}
ALONE = {"lower": 4.5, "upper": 4.5, "digit": math.log2(10)}
# Bits of a character drawn evenly from the letters and digits of each class.
DRAWN = {name: math.log2(sum(c.isalnum() for c in letters)) for name, letters, _ in CLASSES}
# With its separators taken out, a name of short parts has few pairs to tell by: so many bits must speak against words.
GROUPED = 10.0

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    return {
        "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE), "access": re.compile(ACCESS),
        "hex": re.compile("[0-9a-f]{%d,}" % LEAST["hex"]), "candidate": re.compile(CANDIDATE),
    }


@lru_cache(maxsize=8)
def _allow(allowed: tuple[str, ...]) -> re.Pattern:
    inner = "|".join(f"(?:{p})" for p in _renumbered(allowed)) or "(?!)"
    return re.compile(f"(?<![A-Za-z0-9])(?:{inner})(?![A-Za-z0-9])")


def _kind(c: str) -> str:
    return "lower" if c in LOWER else "upper" if c in UPPER else "digit" if c in DIGITS else ""


@lru_cache(maxsize=8192)
def word_step(a: str, b: str) -> float | None:
    """Bits that ``b`` costs after ``a`` where words and numbers are written; none between parts and inside numbers."""
    first, second = _kind(a), _kind(b)
    if not first or not second or first == second == "digit":
        return None
    inside = (first, second) in (("lower", "lower"), ("upper", "upper"), ("upper", "lower"))
    return STEPS[first][second] + (int(PAIRS[ord(a.lower()) - 97][ord(b.lower()) - 97]) if inside else ALONE[second])


def _renumbered(allowed: tuple[str, ...]) -> list[str]:
    """Back references of each pattern shifted by the groups of those before it."""
    out, groups = [], 0
    for pattern in allowed:
        out.append(re.sub(r"\\(\d)", lambda m, g=groups: f"\\{int(m[1]) + g}", pattern))
        groups += re.compile(pattern).groups
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed shapes: leftmost, not overlapping within a kind, long enough."""
    find, out = _patterns(), []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [("assign", m.start(), m.end()) for m in find["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in find["access"].finditer(text) if len(m[0]) >= LEAST["access"]]
    # A shorter run fails whole, and so does each of its ends: asking for the length at once finds the same runs.
    out += [("hex", m.start(), m.end()) for m in find["hex"].finditer(text)]
    return out


def random_runs(text: str, window: int = WINDOW, parts: set[int] | None = None) -> list[tuple[int, int]]:
    """Stretches covered by windows whose entropy reaches the bound of their narrowest class.

    With ``parts``, the places where a new part begins (``GROUPED`` holds if
    there are any), a window does not count if it is at least as likely to be
    made of words and numbers as to be drawn evenly from its class. Only pairs of characters inside the window bear on
    that, so its verdict does not depend on the rest.

    With counts c of the characters in a window of w, the entropy is
    log2(w) - sum(c * log2(c)) / w. Moving on by one character changes two
    counts, so each step costs the same whatever the window.
    """
    n = len(text)
    if n < window:
        return []
    steps = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    outside = [[0] * (n + 1) for _ in CLASSES]
    for row, (_, letters, _) in zip(outside, CLASSES, strict=True):
        for i, c in enumerate(text):
            row[i + 1] = row[i] + (c not in letters)
    least = GROUPED if parts else 0.0
    told, pairs = [0.0] * n, [0] * n
    for i in range(1, n if parts is not None else 0):
        step = None if i in parts else word_step(text[i - 1], text[i])
        told[i], pairs[i] = told[i - 1] + (step or 0.0), pairs[i - 1] + (step is not None)
    counts: dict[str, int] = {}
    total, runs = 0.0, []
    for end in range(n):
        c = counts.get(text[end], 0)
        counts[text[end]] = c + 1
        total += steps[c + 1] - steps[c]
        start = end - window + 1
        if start < 0:
            continue
        entropy = math.log2(window) - total / window
        name, _, bound = next((c for row, c in zip(outside, CLASSES, strict=True) if row[end + 1] == row[start]), ("", "", math.inf))
        if entropy >= bound and (parts is None or told[end] - told[start] > (pairs[end] - pairs[start]) * DRAWN[name] + least):
            if runs and start <= runs[-1][1]:
                runs[-1][1] = end + 1
            else:
                runs.append([start, end + 1])
        c = counts[text[start]]
        counts[text[start]] = c - 1
        total += steps[c - 1] - steps[c]
    return [(a, b) for a, b in runs]


def drawn_runs(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Random stretches of a candidate that are not words, as it stands and with its separators taken out."""
    runs = random_runs(text, window, set())
    parts = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
    if len(parts) > 1:
        places = [i for a, b in parts for i in range(a, b)]
        begins = {at for at in range(1, len(places)) if places[at] > places[at - 1] + 1}
        runs += [(places[a], places[b - 1] + 1) for a, b in random_runs("".join(text[i] for i in places), window, begins)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def entropy_spans(text: str, known: list[Span], window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> list[Span]:
    """Random stretches of candidate strings between the known spans and what is on the allow-list."""
    out = []
    for m in _patterns()["candidate"].finditer(text):
        gaps = [(g.start() + m.start(), g.end() + m.start()) for g in _allow(allowed).finditer(m[0])]
        gaps += [(k[1], k[2]) for k in known if k[1] < m.end() and m.start() < k[2]]
        at = m.start()
        for start, end in [*sorted(gaps), (m.end(), m.end())]:
            out += [("entropy", a + at, b + at) for a, b in drawn_runs(text[at:start], window)] if at < start else []
            at = max(at, end)
    return out


def find_secrets(text: str, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> list[Span]:
    """All spans (kind, start, end) in characters, by start, then kind as listed."""
    # Every shape but an assignment sits in one unbroken word of at least sixteen characters.
    if not any(n in (low := text.lower()) for n in NAMES) and max(map(len, text.split()), default=0) < LEAST["hex"]:
        return []
    base = base_spans(text)
    spans = base + entropy_spans(text, base, window, allowed)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span replaced by a mark; overlapping spans become one."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of each text.

    ``spans`` joins kind:start:end of all finds, ``base_sha256`` is the digest of
    those of the fixed shapes. A null text counts as empty and has none; repeated
    rows and null ids are scanned like any other; an empty table gives an empty
    table. Each row is worked out alone, so nothing is shuffled.
    """
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    )

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f"n_{kind}": [] for kind in KINDS} | {"base_sha256": [], "spans": []}
        for value in batch.column("text"):
            spans = find_secrets(value.as_py() or "", window, allowed)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
            base = written([s for s in spans if s[0] != "entropy"])
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(written(spans))
        counts = {n: pa.array(v, pa.int64()) for n, v in out.items() if n.startswith("n_")}
        texts = {n: pa.array(out[n], pa.string()) for n in ("base_sha256", "spans")}
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | counts | texts

    return per_batch(docs.select("doc_id", "text"), schema, work)


def redact(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; ``n_chars``, where there is one, follows the text.

    No row is lost; null texts stay null and other columns are untouched.
    """
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]
    small_batches(docs.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            texts, lengths = [], []
            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                spans = find_secrets(text, window, allowed) if text else []
                texts.append(redacted(text, spans, mark) if spans else text)
                lengths.append(len(texts[-1]) if spans else batch.column("n_chars")[row].as_py() if "n_chars" in names else None)
            columns = [
                pa.array(texts, pa.string()) if n == "text"
                else pa.array(lengths, batch.schema.field(n).type) if n == "n_chars" else batch.column(n)
                for n in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
