"""Base64 VLQ decoding of source-map segments: as Column expressions, and of
whole pieces of mappings with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (source map v3 format) -----------------------------------
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# one VLQ number: continuation digits (value >= 32: g-z 0-9 + /), then a final digit (A-Z a-f)
VLQ_NUMBER_RE = r"([g-z0-9+/]*[A-Za-f])"
VALID_SEGMENT_RE = r"^(?:[g-z0-9+/]*[A-Za-f])+\z"
# ---------------------------------------------------------------------------


def decode_segment(seg: Column) -> Column:
    """array<bigint> of the signed numbers in one segment ('SAASA' → [9,0,0,9,0])."""
    alphabet = F.lit(BASE64_ALPHABET)

    def number(word: Column) -> Column:
        digits = F.reverse(F.split(word, ""))
        raw = F.aggregate(digits, F.lit(0).cast("bigint"),
                          lambda acc, c: acc * 32 + (F.position(c, alphabet) - 1).bitwiseAND(31).cast("bigint"))
        mag = F.shiftright(raw, 1)
        return F.when(raw.bitwiseAND(1) == 1, -mag).otherwise(mag)

    return F.transform(F.regexp_extract_all(seg, F.lit(VLQ_NUMBER_RE), 1), number)


def valid_segment(seg: Column) -> Column:
    """Well-formed base64 VLQ with 1, 4 or 5 numbers."""
    n = F.size(F.regexp_extract_all(seg, F.lit(VLQ_NUMBER_RE), 1))
    return seg.rlike(VALID_SEGMENT_RE) & n.isin(1, 4, 5)


# by character: its digit, or what else it is
_COMMA, _SEMICOLON, _OTHER = 64, 65, 255
_DIGIT = np.full(256, _OTHER, np.uint8)
_DIGIT[np.frombuffer(BASE64_ALPHABET.encode(), np.uint8)] = np.arange(64)
_DIGIT[ord(",")], _DIGIT[ord(";")] = _COMMA, _SEMICOLON


def _sums_before(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``x`` before each position of ``at``."""
    return np.concatenate([[0], np.cumsum(x)])[at]


def decode_pieces(pieces: list[bytes]):
    """Segments of pieces of mappings, each decoded as if it stood alone: a
    table of the segments that are not empty (piece, line in it, place in the
    line, number of fields, column, and the running sums of the other four
    fields), per piece its last place (line, next place in the line, column and
    the four sums) and whether all its segments are well-formed. The numbers of
    a malformed piece mean nothing; those of the others are right."""
    text = b",".join([*pieces, b""])
    v = _DIGIT[np.frombuffer(text, np.uint8)]
    ends = np.cumsum([len(p) + 1 for p in pieces])
    sep = np.flatnonzero((v == _COMMA) | (v == _SEMICOLON))
    piece = np.searchsorted(ends, sep, "right")  # of each segment, which its separator ends
    good = np.ones(len(pieces), bool)
    # a character that is none, and a number without its last digit
    wrong = np.concatenate([np.flatnonzero(v == _OTHER), sep[sep > 0][(v[sep[sep > 0] - 1] & 0xE0) == 32] - 1])
    good[np.searchsorted(ends, wrong, "right")] = False
    if not good.all():  # a number without its last digit must not run into the next piece
        v = v.copy()
        for i in np.flatnonzero(~good):
            own = v[ends[i] - len(pieces[i]) - 1:ends[i] - 1]
            own[own < _COMMA] = _OTHER
    last = np.flatnonzero(v < 32)  # of each number
    at = np.flatnonzero(v < 64)
    number = np.searchsorted(last, at)
    known = number < len(last)
    at, number = at[known], number[known]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    power = 5 * (np.arange(len(at)) - first[number]) if len(at) else at
    digit = (v[at] & 31).astype(np.int64)
    over = (power > 60) & (digit > 0) | (power == 60) & (digit > 7)  # beyond 63 bits
    good[np.searchsorted(ends, at[over], "right")] = False
    digit = np.where(over | (power > 60), 0, digit) << np.minimum(power, 60)
    raw = np.add.reduceat(digit, first) if len(at) else digit
    value = np.where(raw & 1, -(raw >> 1), raw >> 1)
    seg = np.searchsorted(sep, last)
    fields = np.bincount(seg, minlength=len(sep))
    good[piece[(fields != 0) & (fields != 1) & (fields != 4) & (fields != 5)]] = False
    field = np.arange(len(last)) - (np.cumsum(fields) - fields)[seg]
    f = np.zeros((5, len(sep)), np.int64)
    f[field[field < 5], seg[field < 5]] = value[field < 5]
    # first segments of pieces and of lines
    starts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1])
    new_line = np.zeros(len(sep), bool)
    new_line[starts] = True
    new_line[1:] |= v[sep[:-1]] == _SEMICOLON
    lines = np.flatnonzero(new_line)
    line = np.cumsum(new_line) - 1
    place = np.arange(len(sep)) - lines[line]
    column = np.cumsum(f[0]) - _sums_before(f[0], lines)[line]
    sums = [np.cumsum(x) - _sums_before(x, starts)[piece] for x in f[1:]]
    line = line - line[starts][piece]
    table = [piece, line, place, fields, column, *sums]
    end = np.concatenate([starts[1:], [len(sep)]]) - 1
    ending = [line[end], place[end] + 1, column[end], *[x[end] for x in sums]]
    own = fields > 0
    return [x[own] for x in table], ending, good
