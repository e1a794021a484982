"""Text that went through a wrong character decoding, found and restored.

A wrong decoding is a substitution cipher over the bytes of the text. Between
pages of one byte a letter it is one over letters: its table starts from the
two public code pages and is learned per source by expectation-maximisation
against the letter pairs of all documents (the letters on both sides of an
observed character vote for what it stands for), and is applied by
``translate``. Swaps that involve pages of several bytes a letter are no
tables of letters; they are read through the codecs. Which cipher a text has
is decided by its likelihood under the same model, and by the shares of the
ciphers at its source, learned by expectation-maximisation as well.

No code page reads a space as part of a letter, so words are independent of
each other: every distinct word is deciphered and scored once, and the gain
of a text is the sum over its words.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.ngrams import PairModel, pair_counts
from sievewright.llm.visual import normalize
from sievewright.runtime import join_small, materialize

# Keys: (read with, written in). "cp1252" passes undefined bytes through, so
# it also stands for Latin-1.
_LATIN = [("cp1252", y) for y in ("utf-8", "gb18030", "euc_jp", "cp949", "shift_jis", "big5", "cp1251", "koi8_r")] + [("cp850", "cp1252"), ("cp850", "utf-8"), ("mac_roman", "utf-8")]
_CYRILLIC = [("cp1251", "utf-8"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("koi8_r", "utf-8"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("iso8859_5", "cp1252"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("iso8859_5", "utf-8"), ("cp866", "cp1251"), ("cp1251", "cp866")]
_BOXES = [("cp437", "utf-8"), ("cp437", "cp1252"), ("cp850", "utf-8"), ("cp850", "cp1252"), ("cp866", "utf-8"), ("cp866", "cp1251"), ("mac_roman", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "koi8_r"), ("koi8_r", "cp866")]
_EAST = [("gb18030", "utf-8"), ("big5", "gb18030"), ("gb18030", "big5"), ("shift_jis", "utf-8"), ("shift_jis", "euc_jp"), ("euc_jp", "shift_jis"), ("cp949", "utf-8"), ("big5", "utf-8"), ("euc_jp", "utf-8"), ("gb18030", "euc_jp"), ("gb18030", "cp949"), ("gb18030", "shift_jis"), ("shift_jis", "gb18030"), ("cp949", "gb18030"), ("cp949", "euc_jp")]
_CENTRAL = [("cp1250", "utf-8"), ("cp1250", "cp1252"), ("cp1254", "utf-8"), ("iso8859_7", "cp1252"), ("cp1253", "cp1252"), ("iso8859_7", "utf-8"), ("cp1253", "utf-8"), ("iso8859_2", "utf-8"), ("iso8859_2", "cp1252")]
# Pages of one byte a letter: between two of them text keeps its length, so
# one changed letter says little, and more is asked of it.
_NARROW = {"cp1251", "koi8_r", "cp1252", "iso8859_5", "cp866", "mac_roman", "cp850", "cp437", "cp1250", "iso8859_7", "cp1253", "iso8859_2"}
_SEEN = [
    (re.compile("[\u0080-ÿŒ-ƒˆ˜–-›€™]"), _LATIN),
    (re.compile("[Ѐ-џҐґ]"), _CYRILLIC),
    (re.compile("[─-■Α-ω⌐⌠⌡√∞≈≠≤≥¬₧ﬁﬂ◊Ω∫∆∂]"), _BOXES),
    (re.compile("[　-鿿가-힣豈-﫿｡-ﾟ︰-﹯]"), _EAST),
    (re.compile("[Ă-őŔ-ŷŹ-ž΄-ώ]"), _CENTRAL),
]
KEYS = ["+".join(k) for k in dict.fromkeys(_LATIN + _CYRILLIC + _BOXES + _EAST + _CENTRAL)]
# Pages in which UTF-8 read wrongly can be read wrongly once more.
_AGAIN = {"cp1252", "cp1251", "cp437", "cp850", "cp866", "mac_roman"}
KEYS = ["identity", "lost", *KEYS, *[k + "+twice" for k in KEYS if k.endswith("+utf-8") and k.split("+")[0] in _AGAIN]]
_INDEX = {k: i for i, k in enumerate(KEYS)}

_NARROW_KEYS = {i for i, k in enumerate(KEYS) if set(k.split("+")[:2]) <= _NARROW}

_HIGH = re.compile("[^\x00-\x7f]")
# No page reads these as part of a letter.
_PIECE = re.compile(r"([^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*)")
# Quotes and spaces that isolate a sequence which is spoken about.
_ALONE = "[\\s\"'“”„‘’«»‹›「」()]"
_SUBJECT = re.compile(f"(?<={_ALONE})([^\x00-\x7f\\s“„«‹「]{{1,4}})(?={_ALONE})")
_ENGLISH = re.compile(r"\b(?:the|of|and|with|from|how|what|why|shows|sign)\b", re.IGNORECASE)


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_UTF8_RUN = re.compile(rb"(?:" + _UTF8.pattern + rb")+")
_DOUBLE = {"gb18030", "big5", "euc_jp", "cp949", "shift_jis"}
_STRANGE = re.compile("[\u0080-¿Ā-ɏÂÃâ€™�ˆ˜╨├Γ√РС]")


def _handlers(read: str) -> tuple[str, str]:
    """Error handlers: undefined bytes of cp1252 pass through, and bytes the
    key doesn't explain stay as they were read."""
    up, down = f"sw-e-{read}", f"sw-d-{read}"
    try:
        codecs.lookup_error(up)
    except LookupError:

        def through(error: UnicodeEncodeError) -> tuple[bytes, int]:
            text = error.object[error.start : error.end]
            if read == "cp1252" and all(ord(c) < 256 for c in text):
                return bytes(map(ord, text)), error.end
            raise error

        @functools.lru_cache(1 << 16)
        def as_read(raw: bytes) -> str:
            try:
                return raw.decode(read)
            except UnicodeDecodeError:
                return raw.decode("latin-1") if read == "cp1252" else "�"

        def back(error: UnicodeDecodeError) -> tuple[str, int]:
            return as_read(error.object[error.start : error.end]), error.end

        codecs.register_error(up, through)
        codecs.register_error(down, back)
    return up, down


@functools.cache
def _held(read: str) -> re.Pattern:
    """Maximal runs of the characters that a page has."""
    gone = np.zeros(0x10001, dtype=bool)
    # The mark of a lost letter is no letter of any page.
    gone[[0xFFFD, 0x10000]] = True

    def note(error: UnicodeEncodeError) -> tuple[bytes, int]:
        gone[error.start : error.end] = True
        return b"", error.end

    codecs.register_error(f"sw-n-{read}", note)
    "".join(map(chr, range(0x10000))).encode(read, f"sw-n-{read}")
    if read == "cp1252":
        gone[:256] = False
    edges = np.flatnonzero(np.diff(gone, prepend=True))
    spans = [f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2])]
    return re.compile(f"[{''.join(spans)}{'\\U00010000-\\U0010ffff' if read == 'gb18030' else ''}]+")


def _runs(text: str, read: str) -> tuple[list[str], bytes]:
    """A text in maximal runs: what stands between those that the page has (as
    it is, with the runs of ASCII alone), and their bytes, parted by zeros.
    No page takes a zero into a letter."""
    up = _handlers(read)[0]
    try:
        if "�" in text:
            raise UnicodeError
        return ["", ""], text.encode(read, up)
    except UnicodeError:
        between: list[str] = []
        runs: list[str] = []
        at = 0
        for m in _held(read).finditer(text):
            if not m.group().isascii():
                between.append(text[at : m.start()])
                runs.append(m.group())
                at = m.end()
        return [*between, text[at:]], "\0".join(runs).encode(read, up)


def _written(runs: tuple[list[str], bytes], read: str, written: str) -> str:
    between, raw = runs
    if len(between) == 1:
        return between[0]
    down = f"sw-d-{read}"
    # A lone byte of a page of two bytes a letter is no letter of that page either.
    errors = "replace" if read in _DOUBLE else down
    found = _utf8_inside(raw, read, down) if written == "utf-8" else raw.decode(written, errors)
    if len(between) == 2:
        return between[0] + found + between[1]
    parts = found.split("\0")
    return "".join([x for pair in zip(between, parts) for x in pair] + [between[-1]])


def _utf8_inside(raw: bytes, read: str, down: str) -> str:
    """Bytes with their sequences of UTF-8 deciphered, the others as read."""
    out, at = [], 0
    for m in _UTF8_RUN.finditer(raw):
        out += [raw[at : m.start()].decode(read, down), m.group().decode("utf-8", down)]
        at = m.end()
    return "".join([*out, raw[at:].decode(read, down)])


def decipher(text: str, read: str, written: str) -> str:
    """``text`` as it was written, if it was written in one page and read in
    another; what the key doesn't explain stays as it is."""
    text = text.replace("\0", " ")
    return _written(_runs(text, read), read, written)


def readings(text: str) -> list[tuple[int, str]]:
    """The decipherings of a text that change it."""
    out: dict[int, str] = {}
    runs: dict[str, tuple[list[str], bytes]] = {}
    text = text.replace("\0", " ")
    for seen, keys in _SEEN:
        if not seen.search(text):
            continue
        for read, written in keys:
            i = _INDEX[f"{read}+{written}"]
            if i in out:
                continue
            if read not in runs:
                runs[read] = _runs(text, read)
            # Without a sequence of UTF-8 there is nothing that it explains.
            if written == "utf-8" and not _UTF8.search(runs[read][1]):
                continue
            try:
                found = _written(runs[read], read, written)
            except (UnicodeError, LookupError):
                continue
            if found != text:
                out[i] = found
                if written == "utf-8" and read in _AGAIN:
                    again = decipher(found, read, written) if _STRANGE.search(found) else found
                    out[_INDEX[f"{read}+{written}+twice"]] = again
    return list(out.items())


class Words:
    """Gains of the decipherings of words, each word worked out once."""

    def __init__(self, lm: PairModel, most: int = 200_000):
        self.lm, self.most = lm, most
        self.known: dict[str, list[tuple[int, float, str]]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        for begin in range(0, len(fresh), 2048):
            part = fresh[begin : begin + 2048]
            trials = [(i, k, found) for i, w in enumerate(part) for k, found in readings(w)]
            by: list[list[tuple[int, float, str]]] = [[] for _ in part]
            if trials:
                unique = list(dict.fromkeys(f for _, _, f in trials))
                total = dict(zip(unique, self.lm.totals(unique).tolist()))
                base = self.lm.totals(part).tolist()
                for i, k, found in trials:
                    by[i].append((k, total[found] - base[i], found))
            self.known.update(zip(part, by))

    def readings(self, pieces: list[str], least: float) -> list[tuple[int, float, str]]:
        """(key, gain, reading) of a text in pieces, for gains over ``least``."""
        gains: dict[int, float] = {}
        for piece in pieces[1::2]:
            for k, gain, _ in self.known[piece]:
                gains[k] = gains.get(k, 0.0) + gain
        out = []
        for k, gain in gains.items():
            if gain > least:
                out.append((k, gain, "".join(next((f for j, _, f in self.known.get(p, ()) if j == k), p) for p in pieces)))
        return out


def is_subject(text: str) -> bool:
    """Whether the only strange sequences of a text are spoken about: each
    stands alone between quotes or spaces, in a language that has no words of
    one accented letter."""
    if not _SUBJECT.search(text):
        return False
    rest = _SUBJECT.sub("", text)
    return not _STRANGE.search(rest) and bool(_ENGLISH.search(rest))


def lost_letters(text: str) -> bool:
    """Whether letters were replaced by U+FFFD, other than by a cut at the end
    and other than as the subject of the text."""
    if "ï¿½" in text:
        return True
    if "�" not in text:
        return False
    body = text.rstrip().rstrip("�")
    if "�" not in body:
        return len(text.rstrip()) - len(body) > 3
    return not is_subject(text)


def _changes_letters(text: str, found: str) -> bool:
    """Whether a reading of equal length changes a letter, or a mark inside a
    word, and not only marks that stand alone."""
    padded = f" {text} "
    return any(a != b and (a.isalpha() or padded[i].isalpha() and padded[i + 2].isalpha()) for i, (a, b) in enumerate(zip(text, found)))


def _breaks_words(text: str, found: str) -> bool:
    """Whether a reading of equal length puts a mark inside a word in place of
    a letter; apostrophes and hyphens belong there."""
    return any(a != b and a.isalpha() and not b.isalnum() and b not in "'’-‐­" and found[i - 1 : i].isalpha() and found[i + 1 : i + 2].isalpha() for i, (a, b) in enumerate(zip(text, found)))


def _likelier(words: Words, texts: list[str], most_unseen: float, per_change: float) -> dict[int, list[tuple[int, float, str]]]:
    """The readings of each text that are likelier than the text, with their
    gains, by the text's place."""
    pieces = [_PIECE.split(t) for t in texts]
    words.learn({w for some in pieces for w in some[1::2]})
    trials = [(i, *r) for i, some in enumerate(pieces) for r in words.readings(some, per_change)]
    if not trials:
        return {}
    # The rival explanation: characters that merely look alike.
    asked = [i for i in dict.fromkeys(t[0] for t in trials) if not is_subject(texts[i])]
    plain: dict[int, float] = {}
    if asked:
        flat = [normalize(texts[i]) for i in asked]
        changed = [(i, f) for i, f in zip(asked, flat) if f != texts[i]]
        plain = dict.fromkeys(asked, 0.0)
        if changed:
            less = words.lm.totals([texts[i] for i, _ in changed])
            plain.update({i: max(0.0, x) for (i, _), x in zip(changed, words.lm.totals([f for _, f in changed]) - less)})
    good = [t for t in trials if t[0] in plain and t[2] - plain[t[0]] > per_change]
    if not good:
        return {}
    by: dict[int, list[tuple[int, float, str]]] = {}
    for (i, k, gain, found), odd in zip(good, words.lm.score([t[3] for t in good])[2]):
        high = len(_HIGH.findall(found)) + 1
        narrow = k in _NARROW_KEYS
        if narrow and (not _changes_letters(texts[i], found) or len(found) == len(texts[i]) and _breaks_words(texts[i], found)):
            continue
        if odd <= (most_unseen / 2 if narrow else most_unseen) * high:
            by.setdefault(i, []).append((k, float(gain - plain[i]), found))
    return by


def _merged(options: list[tuple[int, float, str]], apart: float = 30.0) -> list[tuple[list[int], float, str]]:
    """Readings of one text under one option with all their keys, the likeliest
    first. One that is ``apart`` nats behind the first cannot be the choice of
    any source of less than 10^11 texts, whatever its shares."""
    keys: dict[str, list[int]] = {}
    gains: dict[str, float] = {}
    for k, gain, found in options:
        keys.setdefault(found, []).append(k)
        gains[found] = max(gain, gains.get(found, gain))
    most = max(gains.values(), default=0.0)
    return [(sorted(keys[f]), g, f) for f, g in sorted(gains.items(), key=lambda x: (-x[1], x[0])) if g > most - apart]


def _fit_source(rows: pd.DataFrame, steps: int) -> pd.DataFrame:
    """Key shares of one source from its histogram of log-likelihood gains."""
    sets = [([k.tolist() for k in keys], np.array(g, dtype=float), n) for keys, g, n in zip(rows["keys"], rows["gains"], rows["n"])]
    total = float(rows["total"].iloc[0])
    share = dict.fromkeys(sorted({k for s, _, _ in sets for same in s for k in same}), 1e-3)
    for _ in range(steps):
        counts = dict.fromkeys(share, 0.05)
        for options, gains, n in sets:
            each = np.exp(np.clip(gains, -50, 50))
            of = [sum(share[k] for k in same) for same in options]
            whole = 1.0 + float(each @ np.array(of))
            for same, odds in zip(options, each):
                for k in same:
                    counts[k] += n * odds * share[k] / whole
        share = {k: min(0.5, c / (total + 1.0)) for k, c in counts.items()}
    return pd.DataFrame({"source": rows["source"].iloc[0], "key": list(share), "log_share": [float(np.log(v)) for v in share.values()]})


@functools.cache
def page_table(key: int) -> dict[str, str]:
    """The letters that a swap of pages of one byte a letter exchanges."""
    read, written = KEYS[key].split("+")[:2]
    out = {}
    for byte in range(128, 256):
        raw = bytes([byte])
        try:
            a, b = raw.decode(read), raw.decode(written)
        except UnicodeDecodeError:
            continue
        if a != b:
            out[a] = b
    return out


def learn_table(key: int, contexts: pd.DataFrame, lm: PairModel, rounds: int = 3, trust: float = 12.0) -> dict[str, str]:
    """The letter table of a swap at one source, learned from its texts.

    ``contexts`` has what was observed: a character with its left and right
    neighbour as observed, each once. In each round the neighbours are
    deciphered by the table so far, and every letter that the documents have
    beyond ASCII is scored by the pairs it would form; the code page's letter
    is ahead by ``trust`` nats, so it gives way only to repeated evidence.
    """
    table = dict(page_table(key))
    letters = np.array([c for c in np.flatnonzero(lm.single > 0) if 0x80 <= c < 0x530 and chr(c).isalpha()], dtype=np.uint32)
    if not len(letters):
        return table
    of = {c: g for c, g in contexts.groupby("c")}
    for _ in range(rounds):
        before = dict(table)
        for c, g in of.items():
            known = before.get(c, c)
            # A cipher has a letter once: those that other characters stand for are taken.
            taken = {ord(before.get(x, x).lower()) for x in of if x != c and x.isupper() == c.isupper()}
            options = np.array(sorted(set(letters.tolist()) - taken | {ord(known.lower())}), dtype=np.uint32)
            left = np.array([ord(before.get(x, x)) for x in g["l"]], dtype=np.uint32)
            right = np.array([ord(before.get(x, x)) for x in g["r"]], dtype=np.uint32)
            grid = np.broadcast_to(options[:, None], (len(options), len(left)))
            # Each context votes once, however often one text repeats it.
            score = (lm.steps(np.broadcast_to(left, grid.shape), grid) + lm.steps(grid, np.broadcast_to(right, grid.shape))).sum(axis=1)
            score[options == ord(known.lower())] += trust
            best = chr(int(options[score.argmax()]))
            # The model folds case; the code page's letter keeps its own.
            table[c] = known if best == known.lower() else best.upper() if c.isupper() else best
        if table == before:
            break
    return table


def prose_model(documents: DataFrame, columns: tuple[str, ...] = ("text", "title")) -> PairModel:
    """Pair model of clean prose, from all documents."""
    return PairModel(pair_counts(documents, columns))


def garbled_fields(
    rows: DataFrame, model: PairModel, key: str = "result_id", source: str = "engine", fields: tuple[str, ...] = ("title", "snippet"),
    most_unseen: float = 0.4, per_change: float = 3.0, steps: int = 10,
) -> DataFrame:
    """The garbled fields: ``key, field, swap, restored, recovered``.

    ``swap`` names the code pages (``lost`` where letters are gone), and
    ``restored`` is the original where it can be recovered, else null. A
    deciphering counts only if it leaves no more than ``most_unseen`` unseen
    pairs per letter beyond ASCII, and if it is at least ``per_change`` nats
    more likely than the text as it is and than the text with its look-alike
    characters replaced. Null and empty fields are never
    garbled; a null source is a source of its own. Repeated rows count each.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for frame in frames:
            for field in fields:
                values = frame[field]
                some = values[values.notna() & values.str.contains(_HIGH, na=False)]
                texts = list(dict.fromkeys(some))
                if not texts:
                    continue
                best: dict[str, tuple] = {}
                # A few texts at a time, as each has up to some dozens of readings.
                for at in range(0, len(texts), 256):
                    part = texts[at : at + 256]
                    by = _likelier(words, part, most_unseen, per_change)
                    for i, text in enumerate(part):
                        lost = lost_letters(text)
                        # A mark of loss that was itself misread: no key is left.
                        options = [] if "ï¿½" in text else _merged(by.get(i, []))
                        if options or lost:
                            best[text] = (options, lost)
                hit = some[some.isin(best)]
                if len(hit):
                    yield pd.DataFrame(
                        {
                            "id": frame.loc[hit.index, key],
                            "source": frame.loc[hit.index, source],
                            "field": field,
                            "keys": [[o[0] for o in best[t][0]] for t in hit],
                            "gains": [[o[1] for o in best[t][0]] for t in hit],
                            "found": [[o[2] for o in best[t][0]] for t in hit],
                            "lost": [best[t][1] for t in hit],
                            "raw": [t if any(k in _NARROW_KEYS for o in best[t][0] for k in o[0]) else None for t in hit],
                        }
                    )

    kind = rows.schema[key].dataType.simpleString()
    wanted = rows.select(key, F.coalesce(F.col(source).cast("string"), F.lit("")).alias(source), *fields)
    options = materialize(wanted.mapInPandas(scan, f"id {kind}, source string, field string, keys array<array<int>>, gains array<double>, found array<string>, lost boolean, raw string"), "garbled-options")
    totals = wanted.groupBy(F.col(source).alias("source")).agg((F.count("*") * len(fields)).alias("total"))
    bins = options.filter(F.size("keys") > 0).groupBy("source", "keys", F.transform("gains", lambda g: F.round(g - F.greatest(F.array_max("gains") - 40.0, F.lit(0.0)))).alias("gains")).agg(F.count("*").alias("n"))
    shares = bins.join(totals, "source").groupBy("source").applyInPandas(lambda g: _fit_source(g, steps), "source string, key int, log_share double")
    shares = shares.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("key", "log_share"))).alias("shares"))
    scored = join_small(options, shares, ["source"])

    def share(k: Column) -> Column:
        return F.coalesce(F.try_element_at("shares", k), F.lit(-7.0))

    def weighed(o: Column) -> Column:
        # The keys of one text count together; the most usual names it.
        log_share = F.log(F.aggregate(o["keys"], F.lit(0.0), lambda x, k: x + F.exp(share(k))))
        usual = F.array_max(F.transform(o["keys"], lambda k: F.struct(share(k).alias("s"), (-k).alias("k"))))
        return F.struct((o["gains"] + log_share).alias("odds"), (-usual["k"]).alias("k"), o["found"].alias("text"))

    ranked = F.transform(F.arrays_zip("keys", "gains", "found"), weighed)
    scored = scored.withColumn("best", F.array_max(ranked)).withColumn("won", F.coalesce(F.col("best.odds") > 0, F.lit(False)))
    scored = scored.withColumn("key", F.when(F.col("won"), F.col("best.k")))
    tables = _learned_tables(scored.filter(F.col("key").isin(sorted(_NARROW_KEYS))), shared)
    scored = join_small(scored.withColumn("key", F.coalesce("key", F.lit(-1))), tables, ["source", "key"])
    names = F.array(*[F.lit(k) for k in KEYS])
    learned = F.call_function("translate", "raw", "letters", "stand_for")
    text = F.when(F.col("won"), F.when(F.col("letters").isNotNull(), learned).otherwise(F.col("best.text")))
    return scored.filter(F.col("won") | F.col("lost")).select(
        F.col("id").alias(key), "field",
        F.when(F.col("won"), F.element_at(names, F.col("best.k") + 1)).otherwise("lost").alias("swap"),
        text.alias("restored"), F.coalesce(~text.contains("�"), F.lit(False)).alias("recovered"),
    )


def _learned_tables(won: DataFrame, shared) -> DataFrame:
    """Letter tables of the swaps between pages of one byte a letter, as two
    strings: ``source, key, letters, stand_for``. The texts of a source reach
    the fit as distinct characters with their neighbours."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, key, raw in zip(frame["source"], frame["key"], frame["raw"]):
                table, padded = page_table(int(key)), f" {raw} "
                rows += [(source, key, padded[i], padded[i - 1], padded[i + 1]) for i in range(1, len(padded) - 1) if padded[i] in table]
            yield pd.DataFrame(rows, columns=["source", "key", "c", "l", "r"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        key = int(group["key"].iloc[0])
        table = learn_table(key, group, shared.value)
        return pd.DataFrame({"source": [group["source"].iloc[0]], "key": [key], "letters": ["".join(table)], "stand_for": ["".join(table.values())]})

    seen = won.select("source", "key", "raw").mapInPandas(spread, "source string, key int, c string, l string, r string").distinct()
    return seen.groupBy("source", "key").applyInPandas(fit, "source string, key int, letters string, stand_for string")
