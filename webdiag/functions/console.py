"""Console-entry expressions: severity rank, noise test, fingerprint."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for equal results) ---------
# Severity rank of a console level; any other level ranks 1.
SEVERITY_RANK = {
    "error": 3,
    "warning": 2,
    "warn": 2,
    "info": 1,
    "log": 1,
    "verbose": 0,
    "debug": 0,
}
UNKNOWN_RANK = 1

# Messages matching any of these are dropped as framework noise. Java regex;
# only the deprecation pattern is case-insensitive.
NOISE_PATTERNS = (
    r'^Warning: Each child in a list should have a unique "key" prop',
    r"^Warning: React does not recognize the `\w+` prop on a DOM element",
    r"^\[HMR\]",
    r"^\[vite\]",
    r"^Download the React DevTools",
    r"^Warning: ReactDOM.render is no longer supported",
    r"(?i:is deprecated and will be removed)",
    r"^\[webpack\]",
)

# Fingerprint normalisation, applied in this order.
HEX_RE = r"(?i)0x[0-9a-f]+"
HEX_TO = "0x?"
LINE_COL_RE = r":\d+:\d+"
LINE_COL_TO = ":?:?"
# ASCII word boundary around 5+ digits (Java's \b is Unicode-aware).
LONG_NUMBER_RE = r"(?<![A-Za-z0-9_])\d{5,}(?![A-Za-z0-9_])"
LONG_NUMBER_TO = "?"
FINGERPRINT_CHARS = 200
DEFAULT_LEVEL = "log"
# ------------------------------------------------------------------------


def severity_rank(level: Column) -> Column:
    """Rank of a level (unknown and null → 1)."""
    expr = None
    for rank in sorted(set(SEVERITY_RANK.values()), reverse=True):
        names = [k for k, v in SEVERITY_RANK.items() if v == rank]
        cond = level.isin(names)
        expr = F.when(cond, F.lit(rank)) if expr is None else expr.when(cond, F.lit(rank))
    return expr.otherwise(F.lit(UNKNOWN_RANK))


def min_rank(severity: str) -> int:
    """Threshold of a severity parameter; 'all' (or anything unknown) → 1."""
    return SEVERITY_RANK.get(severity, UNKNOWN_RANK)


def severity_predicate(level: Column, severity: str) -> Column:
    """``rank(level) >= min_rank(severity)`` written as plain IN tests on the
    level column so that a parquet scan can take it as a pushed filter."""
    threshold = min_rank(severity)
    keep = [k for k, v in SEVERITY_RANK.items() if v >= threshold]
    drop = [k for k, v in SEVERITY_RANK.items() if v < threshold]
    if UNKNOWN_RANK >= threshold:
        # unknown levels (and null → "log") survive: drop only the listed low ones
        return level.isNull() | ~level.isin(drop) if drop else F.lit(True)
    return level.isin(keep)


def noise_regex(patterns: Iterable[str] = NOISE_PATTERNS) -> str:
    return "|".join(patterns)


# up to this many patterns one alternation is as cheap as looking at words first
FEW_PATTERNS = 32
PATTERN_BUCKETS = 64
# ASCII characters beside a word, and what stands for a part of a pattern without a known text
_BESIDE = r"[\x01-/:-@\[-^`{-\x7f]"
_WHOLE_WORD = re.compile(rf"(?<={_BESIDE})[a-z0-9_]+(?={_BESIDE})")
_UNKNOWN = "\uffff"
# capitals to small letters, the characters beside words to spaces
_BETWEEN = "".join(c for c in map(chr, range(1, 128)) if not (c.isalnum() or c == "_"))
_TO_WORDS = _BETWEEN + string.ascii_uppercase, " " * len(_BETWEEN) + string.ascii_lowercase
_CLASS = re.compile(r"\[\^?\]?(?:[^\\\[\]&]|\\.)*\]", re.S)


def _known_text(pattern: str) -> str | None:
    """What every match of a Java regex holds, with gaps for what may differ;
    None where this reader isn't sure."""
    out: list[str] = []
    at = 0
    while at < len(pattern):
        c = pattern[at]
        size, piece = 1, c if c.isascii() else _UNKNOWN
        if c == "\\":
            if at + 1 == len(pattern):
                return None
            size, nxt = 2, pattern[at + 1]
            if nxt.isalnum() and nxt not in "wWdDsSbB":
                return None
            piece = _UNKNOWN if nxt.isalnum() or not nxt.isascii() else nxt
        elif c == "[":
            m = _CLASS.match(pattern, at)
            if not m:
                return None
            size, piece = len(m[0]), _UNKNOWN
        elif c == "(":
            depth, end = 0, at
            while end < len(pattern):
                if pattern[end] == "\\":
                    end += 2
                    continue
                if pattern[end] == "[":
                    m = _CLASS.match(pattern, end)
                    if not m:
                        return None
                    end += len(m[0])
                    continue
                depth += (pattern[end] == "(") - (pattern[end] == ")")
                if not depth:
                    break
                end += 1
            if end >= len(pattern):
                return None
            head = next((h for h in ("(?:", "(?i:", "(?=", "(?!", "(?<=", "(?<!") if pattern.startswith(h, at)), None)
            if head is None and pattern.startswith("(?", at):
                return None
            inner = _known_text(pattern[at + len(head or "("):end]) if head in (None, "(?:", "(?i:") else None
            size, piece = end + 1 - at, _UNKNOWN if inner is None else inner
        elif c in ")|":
            return None
        elif c == "^":
            piece = "\n" if at == 0 else _UNKNOWN
        elif c == "$":
            piece = "\n" if at + 1 == len(pattern) else _UNKNOWN
        elif c == ".":
            piece = _UNKNOWN
        elif c in "?*+{":
            return None  # a quantifier of nothing
        at += size
        if at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] != "+":
                piece = _UNKNOWN
            else:
                piece += _UNKNOWN
            end = pattern.find("}", at) if pattern[at] == "{" else at
            if end < 0:
                return None
            at = end + 1
            if at < len(pattern) and pattern[at] in "?+":
                at += 1
        out.append(piece)
    return "".join(out)


def required_words(pattern: str) -> set[str]:
    """The words, in lower case, that every match of ``pattern`` has with no
    letter, digit or underscore beside them, as far as is certain."""
    known = _known_text(pattern)
    return set(_WHOLE_WORD.findall(known.lower())) if known else set()


def is_noise(message: Column, patterns: Iterable[str] = NOISE_PATTERNS) -> Column:
    """Whether any pattern matches. Many patterns are looked up by a word that
    their matches must have, of each the one that fewest patterns share: a
    message is held against the patterns of the few buckets (by hash) of its own
    words, and against those without such a word."""
    patterns = list(patterns)
    if len(patterns) <= FEW_PATTERNS:
        return message.rlike(noise_regex(patterns))
    always: list[str] = []
    buckets: dict[int, list[str]] = {}
    required = [required_words(p) for p in patterns]
    shared = Counter(w for ws in required for w in ws)
    words = set()
    for p, ws in zip(patterns, required):
        if not ws:
            always.append(p)
        else:
            word = min(ws, key=lambda w: (shared[w], -len(w), w))
            words.add(word)
            buckets.setdefault(zlib.crc32(word.encode()) % PATTERN_BUCKETS, []).append(p)
    found = message.rlike("|".join(f"(?:{p})" for p in always)) if always else message.isNull() & F.lit(None)
    if not buckets:
        return found

    def looked_up(hits):
        tests = [F.array_contains(hits, F.lit(k)) & message.rlike("|".join(f"(?:{p})" for p in ps))
                 for k, ps in sorted(buckets.items())]
        while len(tests) > 1:  # a balanced tree of ORs
            tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) & ~1:]
        return (F.size(hits) > 0) & tests[0]

    own = F.filter(F.split(F.translate(message, *_TO_WORDS), " "), lambda w: w.isin(sorted(words)))
    hits = F.transform(own, lambda w: F.pmod(F.crc32(w), F.lit(PATTERN_BUCKETS)).cast("int"))
    return found | F.transform(F.array(hits), looked_up)[0]


def normalized_text(message: Column) -> Column:
    s = F.regexp_replace(message, HEX_RE, HEX_TO)
    s = F.regexp_replace(s, LINE_COL_RE, LINE_COL_TO)
    s = F.regexp_replace(s, LONG_NUMBER_RE, LONG_NUMBER_TO)
    return s


def fingerprint(level: Column, message: Column) -> Column:
    """``level::`` + first 200 chars of the normalised message. The raw level
    is kept, so 'warn' and 'warning' never share a fingerprint."""
    return F.concat(level, F.lit("::"),
                    F.substring(normalized_text(message), 1, FINGERPRINT_CHARS))
