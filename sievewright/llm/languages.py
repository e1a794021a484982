"""Languages of documents and of their segments, by a string kernel.

Sentences are compared by a blended spectrum kernel: the number of character
n-grams of length one to three two sentences share, by presence, normalised.
The kernel is approximated by Nystroem landmarks, and one kernel ridge
regression per language is fitted on a bounded sample of labelled documents,
twice: sentences that the first fit contradicts are left out of the second.
As the kernel is a dot product of presence vectors, landmarks and regression
weights fold into one matrix, and a batch of sentences is scored by one
matrix product. A path through each document's sentences, with a cost for
every change of language, yields the segments.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1 << 13
# The languages and their codes in use, by two-letter code.
LANGUAGES = {
    "en": ["en", "eng"], "de": ["de", "deu", "ger"], "fr": ["fr", "fra", "fre"], "es": ["es", "spa"], "pt": ["pt", "por"], "it": ["it", "ita"],
    "nl": ["nl", "nld", "dut"], "ru": ["ru", "rus"], "zh": ["zh", "zho", "chi", "cmn"], "ja": ["ja", "jpn"], "ko": ["ko", "kor"],
}
_CODE = {x: code for code, others in LANGUAGES.items() for x in others}

# Quotes that pair.
_QUOTED = re.compile("“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|《[^》\n]*》|‹[^›\n]*›|\"[^\"\n]*\"")
_STOP = re.compile(r"[.!?](?=[\s\"'”’»)\]]|$)|[。！？]")
_LETTERS = re.compile(r"[^\W\d_]+")
_JUNK_LINE = re.compile(r"^\s*(?:(?:https?|ftp)://\S+|www\.\S+|\[?\d{4}-\d\d-\d\d[T ].*|\[\d+\]\s.*|[\W\d\s]*)\s*$")
# The same for sentences without "/" and "@".
_NOISE_PLAIN = re.compile(r"www\.\S+|[#\[]\d+\]?|\d[\d.,:%|/x-]*")
_NOISE = re.compile(r"(?:https?|ftp)://\S+|www\.\S+|(?<!\S)[^\s@]+@\S+|(?<![\w./-])[\w./-]*/[\w./-]+|[#\[]\d+\]?|\d[\d.,:%|/x-]*")


def plain_code(label: str | None) -> str | None:
    """Two-letter code of a language label in any usual form, else None."""
    if not label:
        return None
    return _CODE.get(re.split(r"[-_]", label.strip().lower())[0])


def _masked(text: str) -> str:
    """The text with what stands in quotes blanked, lengths kept."""
    return _QUOTED.sub(lambda m: m.group()[0] + "\x01" * (len(m.group()) - 2) + m.group()[-1], text)


@lru_cache(maxsize=100_000)
def _cleaned(part: str, full: str) -> str:
    """A sentence without what is in no language; "" if hardly any is left.
    What is blanked in ``part`` is taken back from ``full`` in that case."""
    noise = _NOISE if "/" in full or "@" in full else _NOISE_PLAIN
    clean = noise.sub(" ", part.replace("\x01", ""))
    letters = sum(map(len, _LETTERS.findall(clean)))
    if letters < 6 and part != full:
        clean = noise.sub(" ", full)
        letters = sum(map(len, _LETTERS.findall(clean)))
    return clean.strip() if letters >= 4 and (letters >= 8 or not clean.isascii()) and letters * 3 > len(clean.strip()) else ""


def sentences(text: str) -> list[str]:
    """The sentences of a text, without lines and parts in no language; words
    in quotes are blanked, unless the sentence is hardly more than them."""
    out = []
    for line, raw in zip(_masked(text).split("\n"), text.split("\n")):
        line = raw if line == raw else line
        if not line.strip() or _JUNK_LINE.match(raw):
            continue
        begin = 0
        for end in [*(m.end() for m in _STOP.finditer(line)), len(line)]:
            full = raw[begin:end]
            part = full if line is raw else line[begin:end]
            begin = end
            clean = _cleaned(part, full)
            if clean:
                out.append(clean)
    return out


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    """Whether a code point of the basic plane is of a word, or a line end."""
    return np.array([chr(c) == "\n" or chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in range(0x10000)])


def spectrum(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of length one to three that each text holds, each once:
    the cells, by text, and how many each text has."""
    joined = " \n ".join(t.replace("\n", " ") for t in texts).lower()
    codes = np.frombuffer(f"  {joined}  ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Marks count as space, and space counts once.
    codes = np.where(_word_table()[np.minimum(codes, 0xFFFF)], codes, 32).astype(np.uint32)
    codes = codes[(codes != 32) | np.r_[True, codes[:-1] != 32]]
    last = codes == 10
    place = np.cumsum(last) * DIMENSIONS
    inside = ~last
    held = np.zeros(len(texts) * DIMENSIONS, dtype=bool)
    total = np.zeros(len(codes), dtype=np.uint32)
    for n, multiplier in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        size = len(codes) - n
        inside = inside[:size] & ~last[n:]
        total = total[:size] + codes[n:] * np.uint32(multiplier)
        key = total + np.uint32(0x27D4EB2F * (n + 1))
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        held[(place[:size] + (key >> np.uint32(19)))[inside]] = True
    hit = np.flatnonzero(held)
    return hit & (DIMENSIONS - 1), np.bincount(hit // DIMENSIONS, minlength=len(texts))


def projected(texts: list[str], matrix: np.ndarray, batch: int = 256) -> np.ndarray:
    """Unit presence vectors times a matrix, one row a text: as the vectors
    are sparse, the rows of the matrix that a text holds are summed up."""
    out = np.zeros((len(texts), matrix.shape[1]), dtype=np.float32)
    for begin in range(0, len(texts), batch):
        cells, sizes = spectrum(texts[begin : begin + batch])
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            out[begin + some] = np.add.reduceat(matrix[cells], starts) / np.sqrt(sizes[some, None], dtype=np.float32)
    return out


def presence(texts: list[str]) -> np.ndarray:
    """Presence vectors of the n-grams of each text, scaled to unit length."""
    cells, sizes = spectrum(texts)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    rows = np.repeat(np.arange(len(texts)), sizes)
    out[rows, cells] = 1.0 / np.sqrt(sizes[rows])
    return out


class LanguageModel:
    """Ridge regressions over landmarks, folded into one matrix."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = 600, ridge: float = 0.05, temperature: float = 6.0):
        self.codes = list(LANGUAGES)
        self.temperature = temperature
        y = np.array([self.codes.index(c) for c in labels], dtype=np.int64)
        rng = np.random.default_rng(7)
        keep = np.ones(len(y), dtype=bool)
        self.matrix = np.zeros((DIMENSIONS, len(self.codes)), dtype=np.float32)
        for _ in range(2):
            known = np.flatnonzero(keep)
            if not len(known):
                return
            # Landmarks: as many of each language as of any other.
            each = max(1, landmarks // max(1, len(np.unique(y[known]))))
            chosen = np.concatenate([rng.permutation(known[y[known] == c])[:each] for c in np.unique(y[known])])
            marks = presence([texts[i] for i in chosen])
            # Kernel rows batch by batch: presence vectors are never all held.
            kernel = projected(texts, np.ascontiguousarray(marks.T), batch=32)
            k = kernel[known]
            target = np.where(y[known, None] == np.arange(len(self.codes)), 1.0, -1.0).astype(np.float32)
            balance = (1.0 / np.bincount(y[known], minlength=len(self.codes))[y[known]]).astype(np.float32)
            balance *= len(known) / balance.sum()
            weighted = k * balance[:, None]
            gram = (marks @ marks.T).astype(np.float64)
            solved = np.linalg.solve((weighted.T @ k).astype(np.float64) + ridge * len(known) / landmarks * (gram + 1e-4 * np.eye(len(chosen))), (weighted.T @ target).astype(np.float64))
            self.matrix = (marks.T @ solved).astype(np.float32)
            keep = (kernel @ solved).argmax(axis=1) == y

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log probabilities of the languages, one row a text."""
        z = self.temperature * projected(texts, self.matrix).astype(np.float64)
        if not len(z):
            return z
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit_languages(documents: DataFrame, per_language: int = 400, sentences_each: int = 6, key: str = "doc_id", text: str = "text", label: str = "lang") -> LanguageModel:
    """Model fitted on at most ``per_language`` documents of each label, the
    first by a hash of the key, ``sentences_each`` sentences from each."""
    spark = documents.sparkSession
    code = F.lower(F.split(F.trim(label), "[-_]")[0])
    mapping = F.create_map(*[F.lit(v) for kv in _CODE.items() for v in kv])
    labelled = documents.select(key, F.try_element_at(mapping, code).alias("code"), F.xxhash64(key).alias("h")).filter("code is not null")
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return LanguageModel([], [])
    # A first cut by hash leaves a few times the sample of each label.
    share = F.coalesce(*[F.when(F.col("code") == c, F.lit(min(1.0, 4.0 * per_language / n))) for c, n in counts.items()])
    some = labelled.filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", key))).filter(F.col("r") <= per_language)

    def picked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for code_of, value in zip(frame["code"], frame[text]):
                found = sentences(value) if isinstance(value, str) else []
                step = max(1, len(found) // sentences_each)
                out += [(code_of, s) for s in found[::step][:sentences_each]]
            yield pd.DataFrame(out, columns=["code", "sentence"])

    sample = documents.select(key, text).join(F.broadcast(first.select(key, "code")), key)
    rows = sample.select("code", text).mapInPandas(picked, "code string, sentence string").orderBy("code", "sentence").toArrow()
    return LanguageModel(rows["sentence"].to_pylist(), rows["code"].to_pylist())


def _path(logs: np.ndarray, cost: float) -> np.ndarray:
    """Best sequence of languages under a cost for every change."""
    n, k = logs.shape
    each = logs.argmax(axis=1)
    if (each == each[0]).all():
        return each
    best, back = logs[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - cost
        back[i] = np.where(best >= change, np.arange(k), top)
        best = np.maximum(best, change) + logs[i]
    out = np.empty(n, dtype=np.int64)
    out[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def segments(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", label: str = "lang", change_cost: float = 5.0) -> DataFrame:
    """One row per segment: ``doc_id, seg_no, lang, confidence, n_sentences,
    n_segments, label_ok``.

    Confidence is the mean probability of the segment's language over its
    sentences. Documents whose text is null, empty or in no language have no
    segment. ``label_ok`` tells whether the label names a language of a
    segment. Repeated rows count each; the key should be unique.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = shared.value
        known: dict[str, np.ndarray] = {}
        for frame in frames:
            for begin in range(0, len(frame), 500):
                some = frame.iloc[begin : begin + 500]
                parts = [sentences(t) if isinstance(t, str) else [] for t in some[text]]
                if len(known) > 100_000:
                    known.clear()
                unique = [s for s in dict.fromkeys(s for p in parts for s in p) if s not in known]
                known.update(zip(unique, lm.scores(unique)))
                out = []
                for doc, given, p in zip(some[key], some[label], parts):
                    if not p:
                        continue
                    own = np.array([known[s] for s in p])
                    path = _path(own, change_cost)
                    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
                    found = [(lm.codes[path[a]], float(np.exp(own[a:b, path[a]]).mean()), b - a) for a, b in zip(cuts, cuts[1:])]
                    ok = plain_code(given if isinstance(given, str) else None) in {f[0] for f in found}
                    out += [(doc, i + 1, *f, len(found), ok) for i, f in enumerate(found)]
                yield pd.DataFrame(out, columns=[key, "seg_no", "lang", "confidence", "n_sentences", "n_segments", "label_ok"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text, label).mapInPandas(scan, f"{key} {kind}, seg_no int, lang string, confidence double, n_sentences int, n_segments int, label_ok boolean")


def document_languages(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The main language of each document, by sentences, with its confidence."""
    by = parts.groupBy(key, "lang").agg(F.sum("n_sentences").alias("n"), (F.sum(F.col("confidence") * F.col("n_sentences")) / F.sum("n_sentences")).alias("c"))
    best = by.groupBy(key).agg(F.max(F.struct("n", "c", "lang")).alias("b"), F.sum("n").alias("t"))
    return best.select(key, F.col("b.lang").alias("lang"), (F.col("b.c") * F.col("b.n") / F.col("t")).alias("confidence"))
