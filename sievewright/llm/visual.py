"""Text that looks the same but differs in its characters, in one form.

A compiled transducer reads a text once, chunk by chunk between spaces, longest
match first over grapheme clusters: a base with its marks, a run of conjoining
jamo, a half-width kana with its voicing mark, or a single character of the
mapping; the words of the chunk then get one script. The mapping is derived
from the Unicode data by rule and checked for conflicts when built: no output
holds a character that is itself replaced. Look-alike letters are replaced
word by word, by the script the word is otherwise written in.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts by the Latin letter they look like.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏⅼ", "n": "ո", "o": "оοօσ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "τ", "u": "υսц", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# Letters whose likeness is too weak to rename a word written in them alone.
_WEAK = set("гцσωαƅЬυγτκ")
# Punctuation that looks like an ASCII mark.
MARK_ALIKES = {"-": "\u2010\u2011\ufe63\u2043", "/": "\u2044\u2215", ":": "\u2236\u02d0\ua789", ".": "\u2024", ";": "\u037e", "!": "\u01c3", "'": "\u02b9\u02bc\u02c8", ",": "\ua4f9", "|": "\u01c0\u2223"}
# Full-width marks that Chinese, Japanese and Korean writing uses itself.
_CJK_MARKS = set("！（），－．／：；＜＝＞？［］｛｜｝～％＆＋＠＃＄＊｟｠￥￦＂＇＼＾＿｀")

_LATIN_OF = {x: latin for latin, others in LOOK_ALIKES.items() for x in others}
_CYRILLIC_OF = {latin: x for latin, others in LOOK_ALIKES.items() for x in others if "CYRILLIC" in unicodedata.name(x, "")}
_GREEK_OF = {latin: x for latin, others in LOOK_ALIKES.items() for x in others if "GREEK" in unicodedata.name(x, "")}


@lru_cache(maxsize=1)
def singles() -> dict[str, str]:
    """The mapping of single characters, by rule."""
    out: dict[str, str] = {}
    for code in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Zs":
            out[char] = " "
        elif kind == "Cf" and not 0x600 <= code <= 0x605 or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            out[char] = ""
        elif 0xFF01 <= code <= 0xFF5E and char not in _CJK_MARKS:
            out[char] = chr(code - 0xFEE0)
        elif 0xFF61 <= code <= 0xFFDC or 0x2E80 <= code <= 0x2FD5 or 0xF900 <= code <= 0xFB06 or 0x2F800 <= code <= 0x2FA1D or 0x1D400 <= code <= 0x1D7FF or 0x2160 <= code <= 0x217F or code in (0x132, 0x133, 0x2126, 0x212A, 0x212B) or 0x1C4 <= code <= 0x1CC or 0x1F1 <= code <= 0x1F3 or code in (0x2102, 0x210A, 0x210B, 0x210C, 0x210D, 0x210E, 0x2110, 0x2111, 0x2112, 0x2113, 0x2115, 0x2119, 0x211A, 0x211B, 0x211C, 0x211D, 0x2124, 0x2128, 0x212C, 0x212D, 0x212F, 0x2130, 0x2131, 0x2133, 0x2134):
            flat = unicodedata.normalize("NFKC", char)
            if flat != char:
                out[char] = flat
    for mark, others in MARK_ALIKES.items():
        out.update(dict.fromkeys(others, mark))
    # Conflict check: an output must be stable under the mapping and composed.
    for char, text in list(out.items()):
        stable = "".join(out.get(c, c) for c in unicodedata.normalize("NFC", text))
        if any(c in out for c in stable):
            raise ValueError(f"conflicting mapping of U+{ord(char):04X}")
        out[char] = stable
    return out


def _class(chars: list[str]) -> str:
    """A character class of sorted runs."""
    codes, parts, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\U{codes[i]:08x}" if i == j else f"\\U{codes[i]:08x}-\\U{codes[j]:08x}")
        i = j + 1
    return "[" + "".join(parts) + "]"


_MARK_RANGES = [(0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F)]
_JAMO_RANGES = [(0x1100, 0x115E), (0x1161, 0x11FF), (0xA960, 0xA97C), (0xD7B0, 0xD7FF)]


@lru_cache(maxsize=1)
def _machine() -> tuple[re.Pattern, regex.Pattern, re.Pattern]:
    """The clusters, the words, and what of a text the transducer takes in at
    once: what stands between spaces and holds a character beyond ASCII."""
    marks = _class([chr(c) for a, b in _MARK_RANGES for c in range(a, b + 1)])
    jamo = _class([chr(c) for a, b in _JAMO_RANGES for c in range(a, b + 1)]) + "+"
    kana = "[ｦ-ﾝ][ﾞﾟ]?"
    cluster = re.compile(f"{jamo}|{kana}|[^\\s{marks[1:-1]}]{marks}+|{_class(list(singles()))}")
    return cluster, regex.compile(r"[\p{L}\p{M}]+"), re.compile("[\x21-\x7e]*[^\x00-\x7f][^\x00-\x20]*")


@lru_cache(maxsize=1)
def _open() -> np.ndarray:
    """Of every code point, whether the transducer may change it or its
    neighbour: 1 for clusters and single characters, 2 for look-alike letters."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for a, b in [*_MARK_RANGES, *_JAMO_RANGES, (0xFF66, 0xFF9F)]:
        out[a : b + 1] = 1
    out[[ord(c) for c in singles()]] = 1
    out[[ord(c) for c in _LATIN_OF]] |= 2
    return out


def _script(char: str) -> str:
    if char.isascii():
        return "L"
    name = unicodedata.name(char, "")
    for s in ("LATIN", "CYRILLIC", "GREEK"):
        if name.startswith(s):
            return s[0]
    return "" if unicodedata.category(char)[0] == "M" else "O"


@lru_cache(maxsize=200_000)
def _cluster_form(cluster: str) -> str:
    if len(cluster) == 1 and cluster in singles():
        return singles()[cluster]
    flat = unicodedata.normalize("NFKC" if cluster[0] >= "｡" else "NFC", cluster)
    return "".join(singles().get(c, c) for c in flat)


@lru_cache(maxsize=200_000)
def _word_form(word: str, latin_context: bool) -> str:
    """A word with look-alikes put into the script it is written in."""
    scripts = [_script(c) for c in word]
    known = set(scripts) - {""}
    if known == {"L"}:
        return word
    others = [c for c, s in zip(word, scripts) if s not in ("L", "")]
    if all(c in _LATIN_OF for c in others):
        if "L" in known or latin_context and not any(c in _WEAK for c in others):
            return "".join(_LATIN_OF.get(c, c) for c in word)
        return word
    if "L" in known and known <= {"L", "C"}:
        latin = [c for c, s in zip(word, scripts) if s == "L"]
        if all(c in _CYRILLIC_OF for c in latin):
            return "".join(_CYRILLIC_OF[c] if s == "L" else c for c, s in zip(word, scripts))
    if "L" in known and known <= {"L", "G"}:
        latin = [c for c, s in zip(word, scripts) if s == "L"]
        if all(c in _GREEK_OF for c in latin):
            return "".join(_GREEK_OF[c] if s == "L" else c for c, s in zip(word, scripts))
    return word


@lru_cache(maxsize=200_000)
def _chunk_form(chunk: str, latin_context: bool) -> str:
    """The form of what stands between spaces: longest clusters first, then
    its words."""
    cluster, word, _ = _machine()
    flat = cluster.sub(lambda m: _cluster_form(m.group()), chunk)
    return flat if flat.isascii() else word.sub(lambda m: _word_form(m.group(), latin_context), flat)


def _rewritten(text: str, alike: bool) -> str:
    chunk = _machine()[2]
    latin = False
    if alike:
        # Words in scripts of their own vouch for the words beside them.
        own = any(_own(c) for c in text if c > "\x7f")
        latin = not own and sum(c.isascii() and c.isalpha() for c in text) > len(text) // 3
    return chunk.sub(lambda m: _chunk_form(m.group(), latin), text)


@lru_cache(maxsize=20_000)
def _own(char: str) -> bool:
    """Whether a letter is Cyrillic or Greek and like no Latin letter."""
    return char not in _LATIN_OF and _script(char) in ("C", "G")


def normalize(text: str) -> str:
    """The one form of a text; a text in that form comes back unchanged."""
    return text if text.isascii() else normalize_all([text])[0]


def normalize_all(texts: list[str]) -> list[str]:
    """The one form of each text. A table of all code points tells which texts
    hold nothing that could change; only the others are read."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return list(texts)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    found = np.bitwise_or.reduceat(_open()[codes], np.cumsum(lengths) - lengths)
    return [_rewritten(t, bool(f & 2)) if f else t for t, f in zip(texts, found.tolist())]


def is_disguised(text: str) -> bool:
    """Whether ``normalize`` changes more than nothing."""
    return not text.isascii() and normalize(text) != text


def normalized(rows: DataFrame, fields: tuple[str, ...] = ("title", "snippet")) -> DataFrame:
    """``rows`` with the fields in the one form; nulls stay null."""

    @F.pandas_udf("string")
    def one_form(values: pd.Series) -> pd.Series:
        return pd.Series(normalize_all(values.fillna("").tolist()), dtype=object)

    return rows.withColumns({f: F.when(F.col(f).rlike(r"[^\x00-\x7f]"), one_form(F.col(f))).otherwise(F.col(f)) for f in fields})


def disguised_fields(rows: DataFrame, garbled: DataFrame | None = None, key: str = "result_id", fields: tuple[str, ...] = ("title", "snippet")) -> DataFrame:
    """The fields that hold other characters than they seem to: ``key, field``.

    ``garbled`` (``key, field``) lists fields of wrong decoding, which are left
    out. Null, empty and pure ASCII fields are never cases; plain tabs and
    line breaks, CJK punctuation, typographic quotes, dashes, ellipses and
    symbols with a look of their own stay as they are. Repeated rows count each.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for field in fields:
                values = frame[field].dropna()
                unique = list(dict.fromkeys(values))
                changed = {v for v, w in zip(unique, normalize_all(unique)) if v != w}
                hit = values[values.isin(changed)].index
                yield pd.DataFrame({key: frame.loc[hit, key], "field": field})

    some = rows.select(key, *[F.when(F.col(f).rlike(r"[^\x00-\x7f]"), F.col(f)).alias(f) for f in fields]).filter(" or ".join(f"{f} is not null" for f in fields))
    found = some.mapInPandas(scan, f"{key} {rows.schema[key].dataType.simpleString()}, field string")
    return found if garbled is None else found.join(garbled.select(key, "field"), [key, "field"], "left_anti")


assert sys.maxunicode == 0x10FFFF
