"""Indel string similarity: 100 * 2 * LCS / (len a + len b), over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq.functions import text

try:
    import ahocorasick
except ImportError:  # the values are looked for one after the other then
    ahocorasick = None

FEW_VALUES = 8
PAD_A, PAD_B = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
CELLS = 4_000_000
#: Pairs of long texts that are decoded together.
SLICE = 10_000
#: Entries of a table of marks.
MARKS = 65_536


def _codes(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise longest common subsequence of two padded code matrices."""
    best = np.zeros((a.shape[0], b.shape[1] + 1), dtype=np.int32)
    for i in range(a.shape[1]):
        step = np.where(b == a[:, i : i + 1], best[:, :-1] + 1, best[:, 1:])
        best[:, 1:] = np.maximum.accumulate(np.maximum(step, best[:, 1:]), axis=1)
    return best[:, -1]


def _matrix(codes: list[np.ndarray], pad: np.uint32) -> np.ndarray:
    out = np.full((len(codes), max(1, max(map(len, codes)))), pad, dtype=np.uint32)
    for row, c in zip(out, codes):
        row[: len(c)] = c
    return out


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Indel ratio of each pair; pairs of like length share one matrix."""
    a, b = [_codes(x) for x in left], [_codes(x) for x in right]
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    total = la + lb
    lcs = np.zeros(len(a), dtype=np.int64)
    order = np.lexsort((la, lb))
    start = 0
    while start < len(order):
        end, width = start + 1, max(1, lb[order[start]])
        while end < len(order) and lb[order[end]] <= width + 8 and (end - start + 1) * (width + 8) <= CELLS:
            end += 1
        rows = order[start:end]
        lcs[rows] = _lcs(_matrix([a[i] for i in rows], PAD_A), _matrix([b[i] for i in rows], PAD_B))
        start = end
    return np.where(total == 0, 100.0, 200.0 * lcs / np.maximum(total, 1))


class Texts:
    """Texts of which many pairs are compared, each given by two places; their characters are decoded once."""

    def __init__(self, texts: np.ndarray):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        codes = _codes("".join(texts))
        known = np.bincount(codes) > 0
        self.size = int(known.sum())
        # the number after the last one marks nothing; as many characters as a text has can be read behind each start
        numbers = (np.cumsum(known) - 1)[codes]
        self.numbers = np.append(numbers, np.zeros(max(self.length, default=0), dtype=np.int64)).astype(np.min_scalar_type(self.size))
        self.start = np.concatenate([[0], np.cumsum(self.length)])

    def ratios(self, left: np.ndarray, right: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
        """As ``ratios``. Left texts of up to 63 characters are bits: a row of the table of common subsequences is an integer,
        and a step over all pairs is a few operations on one vector. Where a pair can't have ``least`` characters in common
        any more it is left, and has some ratio of fewer ones."""
        total = self.length[left] + self.length[right]
        lcs = np.zeros(len(left), dtype=np.int64)
        short = self.length[left] < 64
        if short.all():
            return np.where(total == 0, 100.0, 200.0 * self._bitwise(left, right, least) / np.maximum(total, 1))
        far, near = np.flatnonzero(~short), np.flatnonzero(short)
        for at in range(0, len(far), SLICE):
            rest = far[at : at + SLICE]
            out = ratios(self.texts[left[rest]].tolist(), self.texts[right[rest]].tolist())
            lcs[rest] = np.rint(out * total[rest] / 200.0)
        lcs[near] = self._bitwise(left[near], right[near], None if least is None else least[near])
        return np.where(total == 0, 100.0, 200.0 * lcs / np.maximum(total, 1))

    def _bitwise(self, left: np.ndarray, right: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        lcs = np.zeros(len(left), dtype=np.int64)
        # equal left texts that follow each other share a row of marks; so many rows are made at once
        new = np.flatnonzero(np.diff(left, prepend=-1))
        rows = max(1, MARKS // (self.size + 1))
        for at in range(0, len(new), rows):
            end = new[at + rows] if at + rows < len(new) else len(left)
            part = slice(new[at], end)
            lcs[part] = self._marked(left[part], right[part], None if least is None else least[part])
        return lcs

    def _marked(self, left: np.ndarray, right: np.ndarray, least: np.ndarray | None) -> np.ndarray:
        new = np.diff(left, prepend=-1) != 0
        kinds, base = left[new], (np.cumsum(new) - 1) * (self.size + 1)
        lengths = self.length[kinds]
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        number = self.numbers[np.repeat(self.start[kinds], lengths) + at]
        word = np.uint32 if lengths.max() < 32 else np.uint64
        flat = np.zeros(len(kinds) * (self.size + 1), dtype=word)
        np.add.at(flat, np.repeat(np.arange(len(kinds)) * (self.size + 1), lengths) + number, word(1) << at.astype(word))
        la, lb = self.length[left], self.length[right]
        full = (word(1) << la.astype(word)) - word(1)
        width, shortest = int(lb.max()), int(lb.min())
        windows = np.lib.stride_tricks.sliding_window_view(self.numbers, max(1, width))
        codes = np.ascontiguousarray(windows[self.start[right]].T)
        row = np.full(len(left), ~word(0))
        lcs = np.zeros(len(left), dtype=np.int64)
        live = np.arange(len(left))
        looks = set() if least is None else {width // 2, width * 2 // 3, width * 5 // 6}
        for k in range(width):
            code = codes[k] if k < shortest else np.where(k < lb, codes[k], self.size)
            hit = row & flat[base + code]
            row = (row + hit) | (row - hit)
            if k in looks:
                common = np.bitwise_count(~row & full)
                able = np.flatnonzero(common + np.maximum(lb - k - 1, 0) >= least)
                if len(able) < 0.8 * len(row):
                    lcs[live] = common
                    row, base, full, lb, least, live = (x[able] for x in (row, base, full, lb, least, live))
                    codes = codes[:, able]
        lcs[live] = np.bitwise_count(~row & full)
        return lcs


def best_window(short: str, long: str) -> float:
    """Best ratio of the shorter text against every window of the longer, edge windows included."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    best = _slide(short, long)
    return max(best, _slide(long, short)) if len(short) == len(long) else best


def _slide(short: str, long: str) -> float:
    """All windows at once. For patterns of up to 63 characters a row of the LCS table is the bits of one
    integer, so a step over all windows is a few operations on one vector."""
    a, b = _codes(short), _codes(long)
    m, n = len(a), len(b)
    at = np.arange(n + m - 1)
    size = m + np.minimum(np.minimum(at + 1, n + m - 1 - at), m)
    if m < 64:
        marks: dict[int, int] = {}
        for i, code in enumerate(a.tolist()):
            marks[code] = marks.get(code, 0) | 1 << i
        codes, where = np.unique(b, return_inverse=True)
        bits = np.array([marks.get(c, 0) for c in codes.tolist()], dtype=np.uint64)[where]
        edge = np.zeros(m - 1, dtype=np.uint64)
        bits = np.concatenate([edge, bits, edge])
        row = np.full(len(at), np.uint64((1 << m) - 1))
        full = np.uint64((1 << m) - 1)
        for k in range(m):
            hit = row & bits[k : k + len(at)]
            row = ((row + hit) | (row - hit)) & full
        return float((200.0 * (m - np.bitwise_count(row)) / size).max())
    edge = np.full(m - 1, PAD_B, dtype=np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, b, edge]), m)
    best, step = 0.0, max(1, CELLS // m)
    for start in range(0, len(windows), step):
        chunk = windows[start : start + step]
        lcs = _lcs(np.broadcast_to(a, (len(chunk), m)), chunk)
        best = max(best, float((200.0 * lcs / size[start : start + step]).max()))
    return best


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=a.index, dtype="float64")
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        out[known] = ratios(a[known].tolist(), b[known].tolist())
    return out.where(known, None)


@F.pandas_udf(T.DoubleType())
def _window_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else best_window(x, y) for x, y in zip(a, b)], dtype="float64"
    )


def contained(values: list[str], text: str) -> set[str]:
    """Which of the values occur in a text: one pass over the text for all of them where there are several."""
    if len(values) > FEW_VALUES and ahocorasick is not None:
        automaton = ahocorasick.Automaton()
        for v in values:
            automaton.add_word(v, v)
        automaton.make_automaton()
        return {v for _, v in automaton.iter(text)}
    return {v for v in values if v in text}


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _windows_udf(values: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for wanted, page in zip(values, text):
        held = contained(list(wanted), page)
        out.append([100.0 if v in held else best_window(v, page) for v in wanted])
    return pd.Series(out, dtype=object)


# dear to compute: a filter on the result must not compute it a second time
_ratio_udf, _window_udf, _windows_udf = (f.asNondeterministic() for f in (_ratio_udf, _window_udf, _windows_udf))


def indel_ratio(a: Column, b: Column) -> Column:
    return _ratio_udf(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Ratio of the texts with their words in sorted order."""
    return _ratio_udf(text.sorted_words(a), text.sorted_words(b))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best windowed ratio; containment is settled before any row leaves the JVM side."""
    return _window_udf(a, b)


def partial_ratios(values: Column, text: Column) -> Column:
    """partial_ratio of each value of a list with one text."""
    return _windows_udf(values, text)


def best_of(entries: list[tuple[str, str]], scorer: str, cutoff: float):
    """UDF: best dictionary entry for each value, struct<name, score>, ties to the first entry.

    ``entries`` is a fixed dictionary of (name, spelling); ``scorer`` is "ratio" or "window".
    """
    names = [n for n, _ in entries]
    spellings = [" ".join(sorted(s.split())) if scorer == "ratio" else s for _, s in entries]
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def pick(values: pd.Series) -> pd.DataFrame:
        found = []
        for value in values:
            if value is None:
                found.append((None, None))
                continue
            if scorer == "ratio":
                scores = ratios([value] * len(spellings), spellings)
            else:
                scores = np.array([best_window(value, s) for s in spellings])
            at = int(np.argmax(scores)) if scorer == "ratio" else int(np.argmax(scores >= cutoff))
            found.append((names[at], float(scores[at])) if scores[at] >= cutoff else (None, None))
        return pd.DataFrame(found, columns=["name", "score"])

    return pick.asNondeterministic()
