"""Records that differ in formatting only, collapsed with their copy counts.

The code points of a batch stream through a lookup table that folds case and
marks what is skipped (space and punctuation), straight into polynomial
hashes; no canonical string is built. A title is the multiset of the hashes
of its separated parts, a URL the sequence of its scheme, host and path, the
set of its parameters, and its fragment. Rows whose 128-bit key collides are
compared with the record's first row by two cursors that skip and fold as
they go; rows that differ there are told apart by their folded form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.runtime import materialize

# Characters that set off the parts of a title; dashes count
# only with space on both sides.
SEPARATORS = "|｜·»«_•¦‖"
DASHES = "-–—―"
# Delimiters and closing punctuation of URLs.
URL_DELIMITERS = "/?#&;.,:!'\"()<>[]»*|"

_TABLE = 0x110000
# Planes that hold assigned characters; all others are unassigned or private.
_ASSIGNED = [range(0x40000), range(0xE0000, 0xE1000)]


@lru_cache(maxsize=1)
def fold_table() -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, ...]]]:
    """(folded code or 0 to skip, separator flag, folds into several codes),
    of every code point; those of private or later use stand for themselves."""
    fold = np.arange(_TABLE, dtype=np.uint32)
    several: dict[int, tuple[int, ...]] = {}
    for code in (c for plane in _ASSIGNED for c in plane):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind[0] not in "LNM":
            fold[code] = code if kind in ("Cn", "Co") else 0
            continue
        folded = char.casefold()
        fold[code] = ord(folded[0])
        if len(folded) > 1:
            several[code] = tuple(map(ord, folded))
    part = np.zeros(_TABLE, dtype=bool)
    part[[ord(c) for c in SEPARATORS]] = True
    return fold, part, several


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes keep their strength."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the row of each."""
    values = texts.fillna("").tolist()
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(values)), lengths)


def _segment_hashes(codes: np.ndarray, segment: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of each run of equal ``segment``; (segments, hashes)."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    position = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    power = np.full(int(position.max()) + 1, 0xD6E8FEB86659FD93 ^ (seed << 1), dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return segment[starts], _mix(np.add.reduceat(_mix(codes.astype(np.uint64), seed) * power[position], starts), seed)


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, rows, values)
    return out


def title_hashes(titles: pd.Series, seed: int = 1) -> np.ndarray:
    """One order-free hash of the parts of each title."""
    fold, part, several = fold_table()
    codes, rows = _codes(titles)
    n = len(titles)
    if not len(codes):
        return np.zeros(n, dtype=np.int64)
    cut = part[codes]
    same = np.r_[False, rows[1:] == rows[:-1]]
    space = _spaces(codes)
    dash = np.isin(codes, [ord(c) for c in DASHES])
    before = ~same | np.r_[True, space[:-1]]
    after = np.r_[~same[1:] | space[1:], True]
    cut |= dash & before & after
    colon = codes == 0x3A
    double = colon & np.r_[False, colon[:-1]] & same
    cut |= double
    kept = fold[codes]
    segment = (rows.astype(np.int64) << 34) + np.cumsum(cut)
    keep = kept > 0
    kept, segment = kept[keep], segment[keep]
    kept, segment = _expand(kept, segment, codes[keep], several)
    ids, hashes = _segment_hashes(kept, segment, seed)
    return _row_sums(ids >> 34, hashes, n).view(np.int64)


def _spaces(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200F)) | np.isin(codes, [0x85, 0x1C, 0x1D, 0x1E, 0x1F, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])


def _expand(kept: np.ndarray, segment: np.ndarray, raw: np.ndarray, several: dict[int, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Put the further code points of folds such as that of sharp s."""
    hit = np.flatnonzero(np.isin(raw, np.fromiter(several, dtype=np.uint32)))
    if not len(hit):
        return kept, segment
    repeat = np.ones(len(kept), dtype=np.int64)
    repeat[hit] = [len(several[int(raw[i])]) for i in hit]
    at = np.cumsum(repeat) - repeat
    kept, segment = np.repeat(kept, repeat), np.repeat(segment, repeat)
    for i in hit:
        for j, code in enumerate(several[int(raw[i])]):
            kept[at[i] + j] = code
    return kept, segment


def url_hashes(urls: pd.Series, seed: int = 2) -> np.ndarray:
    """Hash of scheme, host and path in order, parameters as a set, fragment."""
    n = len(urls)
    codes, rows = _codes(urls)
    if not len(codes):
        return np.zeros(n, dtype=np.int64)
    solid = ~_spaces(codes)
    codes, rows = codes[solid], rows[solid]
    if not len(codes):
        return np.zeros(n, dtype=np.int64)
    fold, _, several = fold_table()
    folded = np.where(fold[codes] > 0, fold[codes], codes)
    first = np.r_[True, rows[1:] != rows[:-1]]
    # Section of each code point: 0 up to "?", 1 up to "#", 2 beyond.
    start = np.flatnonzero(first)
    sizes = np.diff(np.r_[start, len(codes)])
    asks, hashes = np.cumsum(codes == 0x3F), np.cumsum(codes == 0x23)
    asked = (asks - np.repeat(asks[start] - (codes[start] == 0x3F), sizes)) > 0
    marked = (hashes - np.repeat(hashes[start] - (codes[start] == 0x23), sizes)) > 0
    section = np.where(marked, 2, np.where(asked, 1, 0))
    # In the parameters every "&" (and a further "?") begins a new segment.
    head = (section == 1) & np.isin(codes, [0x26, 0x3F, 0x3B]) | (section == 2) & (codes == 0x23)
    block = rows.astype(np.int64) * 4 + section
    # A delimiter is skipped at the end of its segment and where it repeats.
    border = np.r_[(block[1:] != block[:-1]) | head[1:], True]
    delimiter = np.isin(codes, [ord(c) for c in URL_DELIMITERS])
    index = np.arange(len(codes))
    # Next code point that is no delimiter, and the end of the own segment.
    following = np.where(delimiter, len(codes), index)
    following = np.minimum.accumulate(following[::-1])[::-1]
    end = np.where(border, index, len(codes))
    end = np.minimum.accumulate(end[::-1])[::-1]
    trailing = delimiter & (following > end)
    repeated = delimiter & np.r_[False, (codes[1:] == codes[:-1]) & (block[1:] == block[:-1])]
    keep = ~(trailing | repeated | head)
    step = np.cumsum(head | np.r_[True, block[1:] != block[:-1]])
    segment = (rows.astype(np.int64) << 34) + (section.astype(np.int64) << 32) + step
    kept, segment = _expand(folded[keep], segment[keep], codes[keep], several)
    ids, values = _segment_hashes(kept, segment, seed)
    if not len(ids):
        return np.zeros(n, dtype=np.int64)
    owner, kind = ids >> 34, (ids >> 32) & 3
    values = _mix(values, 11) * (kind.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])]
    return _row_sums(owner[fresh], values[fresh], n).view(np.int64)


# The comparison of two texts by cursors. Parts are runs between separators.


def _title_parts(text: str) -> list[tuple[int, int]]:
    """Bounds of the parts of a title."""
    out, begin, size = [], 0, len(text)
    for i, c in enumerate(text):
        if c in SEPARATORS or c == ":" and i and text[i - 1] == ":" or c in DASHES and (i == 0 or _is_space(text[i - 1])) and (i + 1 == size or _is_space(text[i + 1])):
            out.append((begin, i))
            begin = i + 1
    out.append((begin, size))
    return out


_SPACE_CODES = {int(c) for c in np.flatnonzero(_spaces(np.arange(0x10000, dtype=np.uint32)))}


def _is_space(c: str) -> bool:
    return ord(c) in _SPACE_CODES


class _Folds(dict):
    """Folds of code points as they are met: a tuple, empty to skip."""

    def __missing__(self, char: str) -> tuple[int, ...]:
        fold, _, several = fold_table()
        code = ord(char)
        self[char] = several.get(code, (int(fold[code]),)) if fold[code] else ()
        return self[char]


_FOLDS = _Folds()


def _folded(text: str, begin: int, end: int):
    """The folded code points of a part, one by one."""
    for i in range(begin, end):
        yield from _FOLDS[text[i]]


def _equal_runs(a: str, x: tuple[int, int], b: str, y: tuple[int, int]) -> bool:
    left, right = _folded(a, *x), _folded(b, *y)
    while True:
        p, q = next(left, None), next(right, None)
        if p != q:
            return False
        if p is None:
            return True


def same_title(a: str, b: str) -> bool:
    """Two-cursor comparison of titles, parts in any order."""
    if a == b:
        return True
    filled = lambda t: [x for x in _title_parts(t) if next(_folded(t, *x), None) is not None]
    left, right = filled(a), filled(b)
    if len(left) != len(right):
        return False
    for x in left:
        hit = next((i for i, y in enumerate(right) if _equal_runs(a, x, b, y)), None)
        if hit is None:
            return False
        right.pop(hit)
    return True


def _url_runs(url: str) -> list[tuple[int, int, int]]:
    """(section, begin, end) of the runs of a URL: all up to the query, each
    parameter, each part of the fragment."""
    out, section, begin = [], 0, 0
    for i, c in enumerate(url):
        if c == "#" or section == 0 and c == "?" or section == 1 and c in "&?;":
            out.append((section, begin, i))
            section, begin = 2 if c == "#" else max(section, 1), i + 1
    out.append((section, begin, len(url)))
    return out


def _url_codes(url: str, section: int, begin: int, end: int):
    """Folded code points of a run without space, without delimiters at its
    end, and without those that repeat."""
    while end > begin and (url[end - 1] in URL_DELIMITERS or _is_space(url[end - 1])):
        end -= 1
    last = ""
    for i in range(begin, end):
        c = url[i]
        if _is_space(c):
            continue
        if c != last or c not in URL_DELIMITERS:
            yield from _FOLDS[c] or (ord(c),)
        last = c


def _run_hash(url: str, run: tuple[int, int, int]) -> int | None:
    """Rolling hash of a run, None where nothing of it counts."""
    value, some = run[0], False
    for code in _url_codes(url, *run):
        value, some = (value * 0x9E3779B1 + code + 1) & 0xFFFFFFFFFFFFFFFF, True
    return value if some else None


def _same_codes(a: str, x: tuple[int, int, int], b: str, y: tuple[int, int, int]) -> bool:
    return x[0] == y[0] and all(p == q for p, q in zip_longest(_url_codes(a, *x), _url_codes(b, *y)))


def same_url(a: str, b: str) -> bool:
    """Two-cursor comparison of URLs: the parameters in any order, each once.
    Runs are matched by rolling hash, and runs of equal hash by cursors."""
    if a == b:
        return True
    left: dict[int, list] = {}
    right: dict[int, list] = {}
    for url, runs in ((a, left), (b, right)):
        for run in _url_runs(url):
            value = _run_hash(url, run)
            if value is not None:
                runs.setdefault(value, []).append(run)
    return left.keys() == right.keys() and all(
        all(any(_same_codes(a, x, b, y) for y in right[h]) for x in left[h]) and all(any(_same_codes(a, x, b, y) for x in left[h]) for y in right[h]) for h in left
    )


def canonical_key(title: str, url: str) -> str:
    """Exact folded form, only for the rows whose hashes collide wrongly."""
    parts = sorted("".join(map(chr, _folded(title, *x))) for x in _title_parts(title))
    runs = sorted({(run[0], "".join(map(chr, _url_codes(url, *run)))) for run in _url_runs(url)})
    return "\x1f".join([*filter(None, parts), "\x1e", *(f"{k}{v}" for k, v in runs if v)])


def collapse_records(rows: DataFrame, key: str = "result_id", title: str = "title", url: str = "url", salts: int = 128) -> DataFrame:
    """Membership of every row with a title and a URL: ``first_id``, ``copy_id``.

    ``first_id`` is the smallest key of the record, also for the first row
    itself (``copy_id`` = ``first_id``). Rows with a null or blank title or
    URL belong to no record and are left out. The key must be unique; columns
    besides the three are ignored. An empty table gives no rows.

    A record with a third of all rows is pre-aggregated map-side, and its rows
    meet its head on a salted key, so it is never gathered in one task: heads
    are first spread over the salts that their record has, at most ``salts``.
    The hashes and the members are written once each while this is built.
    """

    @F.pandas_udf("struct<t:bigint,u:bigint>")
    def hashed(titles: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"t": title_hashes(titles), "u": url_hashes(urls)})

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([q is None or same_title(p, q) and same_url(r, s) for p, q, r, s in zip(a, b, x, y)])

    @F.pandas_udf("string")
    def exact(titles: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([canonical_key(t, u) for t, u in zip(titles, urls)], dtype=object)

    filled = rows.select(F.col(key).alias("id"), F.col(title).alias("t"), F.col(url).alias("u")).filter(F.col("t").rlike(r"(?U)\S") & F.col("u").rlike(r"(?U)\S"))
    hashes = filled.withColumn("h", hashed("t", "u")).select("id", "t", "u", F.col("h.t").alias("ht"), F.col("h.u").alias("hu"))
    hashes = materialize(hashes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")), "record-hashes")
    groups = hashes.groupBy("ht", "hu", "salt").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    ids = groups.groupBy("ht", "hu").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n")).filter("n > 1")
    heads = ids.join(hashes.select(F.col("id").alias("first_id"), F.col("t").alias("rt"), F.col("u").alias("ru")), "first_id").select("ht", "hu", "first_id", "rt", "ru")
    spread = groups.select("ht", "hu", "salt").join(heads, ["ht", "hu"])
    joined = hashes.join(spread, ["ht", "hu", "salt"], "left")
    single = F.col("first_id").isNull() | (F.col("first_id") == F.col("id"))
    checked = joined.withColumn("same", F.when(~single, verified("t", "rt", "u", "ru")).otherwise(F.lit(True)))
    members = materialize(checked.select("id", "same", "ht", "hu", F.coalesce("first_id", "id").alias("first_id"), F.when(~F.col("same"), F.col("t")).alias("t"), F.when(~F.col("same"), F.col("u")).alias("u")), "record-members")
    agreed = members.filter("same").select("first_id", F.col("id").alias("copy_id"))
    apart = members.filter("not same").withColumn("k", exact("t", "u"))
    firsts = apart.groupBy("ht", "hu", "k").agg(F.min("id").alias("f"))
    return agreed.unionByName(apart.join(firsts, ["ht", "hu", "k"]).select(F.col("f").alias("first_id"), F.col("id").alias("copy_id")))


def record_counts(rows: DataFrame, **names: str) -> DataFrame:
    """One row per record: ``first_id`` and its number of copies ``n_copies``."""
    return collapse_records(rows, **names).groupBy("first_id").agg(F.count("*").alias("n_copies"))
