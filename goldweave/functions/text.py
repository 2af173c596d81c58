"""Column functions over names, e-mails and phones, and vectorised Jaro-Winkler."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def initcap(x: Column) -> Column:
    """A capital at the start and behind every character that is no letter, small letters elsewhere."""
    parts = F.split(x, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def null_tokens(x: Column, tokens: tuple[str, ...]) -> Column:
    """Null where a value is one of the tokens."""
    return F.when(~x.isin(*tokens), x)


def email(x: Column, mode: str) -> Column:
    out = F.lower(F.trim(x))
    return F.nullif(out, F.lit("")) if mode == "nrt" else out


def phone(x: Column, mode: str) -> Column:
    out = F.regexp_replace(x, "[^0-9+]", "")
    return F.nullif(out, F.lit("")) if mode == "nrt" else out


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def first_word(name: Column) -> Column:
    """The text before the first space."""
    return F.split_part(name, F.lit(" "), F.lit(1))


def other_words(name: Column) -> Column:
    """The text behind the first space, null where there is none."""
    return F.when(F.instr(name, " ") > 0, F.trim(F.substr(name, F.instr(name, " ") + 1)))


def domain(x: Column) -> Column:
    """From the first @ on, null without one."""
    return F.when(F.instr(x, "@") > 0, F.substr(x, F.instr(x, "@")))


def phone_suffix(x: Column, n: int = 4) -> Column:
    d = digits(x)
    return F.when(F.length(d) >= n, F.right(d, F.lit(n)))


def file_date(file: Column) -> Column:
    """The date at the start of a file name, null where it is none."""
    return F.try_to_date(F.split_part(file, F.lit("_crm_"), F.lit(1)), "yyyy-MM-dd")


def _codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows, filled up with zeros, and lengths."""
    lengths = np.array([len(v) for v in values], np.int32)
    width = max(int(lengths.max()) if len(values) else 0, 1)
    rows = np.frombuffer("".join(v.ljust(width, "\0") for v in values).encode("utf-32-le", "surrogatepass"), "<u4")
    return rows.reshape(len(values), width), lengths


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of pairs, from 0 to 1: all pairs go through each step together.

    Two empty texts give 1, one empty text gives 0. The common prefix counts where Jaro is over 0.7.
    """
    a, la = _codes(left)
    b, lb = _codes(right)
    n = len(la)
    if n == 0:
        return np.zeros(0)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    hit_a, hit_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    far = int(reach.max())
    for i in range(a.shape[1]):
        open_ = i < la
        for j in range(max(0, i - far), min(b.shape[1], i + far + 1)):
            hit = open_ & (abs(i - j) <= reach) & (j < lb) & ~hit_b[:, j] & (a[:, i] == b[:, j])
            if hit.any():
                hit_b[:, j] |= hit
                hit_a[:, i] |= hit
                open_ = open_ & ~hit
    m = hit_a.sum(1)
    front_a = np.take_along_axis(a, np.argsort(~hit_a, 1, kind="stable"), 1)
    front_b = np.take_along_axis(b, np.argsort(~hit_b, 1, kind="stable"), 1)
    width = min(a.shape[1], b.shape[1])
    swapped = ((front_a[:, :width] != front_b[:, :width]) & (np.arange(width) < m[:, None])).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swapped // 2) / m) / 3, 0.0)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    head = min(4, width)
    prefix = np.cumprod((a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(la, lb)[:, None]), 1).sum(1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def _most_similar(left: list[str], right: list[str]) -> np.ndarray:
    """A bound that the similarity of pairs can't exceed: from their lengths, the characters they have in common, and the common prefix."""
    a, la = _codes(left)
    b, lb = _codes(right)
    bags = []
    for rows, lengths in ((a, la), (b, lb)):
        at, i = np.nonzero(np.arange(rows.shape[1]) < lengths[:, None])
        bags.append(np.bincount(at * 32 + rows[at, i] % 32, minlength=32 * len(rows)).reshape(-1, 32))  # characters that share a place only raise the bound
    m = np.minimum(*bags).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + 1) / 3, 0.0)
    head = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod((a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(la, lb)[:, None]), 1).sum(1)
    return np.where((la == 0) & (lb == 0), 1.0, jaro + 0.1 * prefix * (1 - jaro))


def jaro_winkler_from(least: float):
    """jaro_winkler for pairs whose similarity may be `least` or more; null for others, for which a bound settles that it is not."""

    @F.pandas_udf(DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        known = np.flatnonzero((left.notna() & right.notna()).to_numpy())
        x, y = left.to_numpy()[known], right.to_numpy()[known]
        order = np.argsort([max(len(p), len(q)) for p, q in zip(x, y)], kind="stable")
        at = 0
        while at < len(order):
            size = max(1, min(4096, 1_000_000 // (max(len(x[order[at]]), len(y[order[at]])) + 16)))
            part = order[at : at + size]
            near = part[_most_similar(x[part].tolist(), y[part].tolist()) >= least - 1e-9]
            out[known[near]] = similarity(x[near].tolist(), y[near].tolist())
            at += size
        return pd.Series(out).where(~np.isnan(out), None)

    return run


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; null where a side is. Pairs of like lengths go together, so that a long value costs its own chunk only."""
    out = np.full(len(left), np.nan)
    known = (left.notna() & right.notna()).to_numpy()
    x, y = left[known].tolist(), right[known].tolist()
    order = sorted(range(len(x)), key=lambda i: max(len(x[i]), len(y[i])))
    found, at = np.empty(len(x)), 0
    while at < len(x):
        size = max(1, min(4096, 1_000_000 // (max(len(x[order[at]]), len(y[order[at]])) + 16)))
        part = order[at : at + size]
        found[part] = similarity([x[i] for i in part], [y[i] for i in part])
        at += size
    out[known] = found
    return pd.Series(out).where(known, None)
