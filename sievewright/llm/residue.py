"""Template residue, filler and error notices in place of content.

Character n-gram models are fitted for filler, for notices, for prose about
such things and for natural prose. The first three start from stock phrases
of public software and of typesetting (below; none is a text of the tables)
and learn on: in each round the sentences of all rows that are mostly
explained by them give their n-grams to them, which is expectation-
maximisation with hard decisions. Natural prose is counted over all documents.

A text is read as units (sentences, parts of a title). Unfilled placeholders,
bare traces of missing values and status numbers enter as symbols of their
own, so they are n-grams like others. Windows of high mean log likelihood
ratio localise residue inside a unit. A field is residue if a unit is mostly
covered by such windows, or holds a long run of them, or a placeholder, unless
the model of prose about such things explains the sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.ngrams import fold_codes
from sievewright.llm.visual import normalize_all

CELLS = 1 << 20
# Symbols: placeholder, bare trace of a value, status number, start and end of a unit.
SLOT, TRACE, STATUS, BEGIN, END = "", "", "", "", ""
_TEXT = "\x02"

# Filler of typesetters and the words of placeholder generators.
FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Vivamus vitae massa, felis augue, porta metus, quisque tellus, sagittis ornare, dictum lacus, magna vel, nulla amet.
Aenean lectus. Maecenas mattis ligula. Phasellus ultrices nulla quis nibh. Donec dictum, metus in sagittis porta.
Quisque volutpat condimentum velit. Integer ornare felis, tellus vitae augue. Praesent mauris, fusce nec tellus sed augue semper porta.
sample text sample text
this is sample text only
test test
test text test text
this is a test page
your title goes in here
your heading here
the description goes here
insert your text here
replace this text with your own content
type your text here
text placeholder
placeholder text, please replace
untitled page
untitled document 1
no title given
no description given
add your description here
enter your description here
write something about
todo: write a teaser
todo: add text
tbd
coming soon
content coming soon
more content to follow
dummy text
filler text
asdf qwerty asdf
asdf asdf
foo bar baz qux
xxx xxxx xxx
aaa bbb ccc
text text text
blah blah blah
这里是示例文字，请替换为正式内容
请在此处输入标题
占位文本
测试测试测试
ここに本文を入力してください
これはダミーテキストです
仮のテキスト
여기에 내용을 입력하세요
임시 텍스트입니다
este es un texto de ejemplo
escriba aquí su texto
aquí va el texto
este é um texto de exemplo
insira aqui o seu texto
questo è un testo di esempio
inserire qui il testo
ceci est un texte d’exemple
insérez votre texte ici
dies ist ein Blindtext
hier könnte Ihr Text stehen
Platzhalter für Text
Mustertext
dit is een voorbeeldtekst
hier komt de tekst
это пример текста
введите текст сюда
здесь будет текст"""

_SWITCH = "enable|turn on|activate|switch on|allow"
_OFF = "disabled|turned off|switched off|blocked|not enabled|deactivated"
# Wordings of notices in public software; alternatives stand in
# braces and are written out by ``_written_out``.
NOTICES = f"""{{{_SWITCH}}} JavaScript in your browser and reload this page
please {{{_SWITCH}}} JavaScript and refresh the page
please {{{_SWITCH}}} JavaScript to use this application
you must {{{_SWITCH}}} JavaScript to see this content
JavaScript is {{{_OFF}}} in your web browser, {{enable|allow|activate}} it in your settings
it seems that JavaScript is {{{_OFF}}} in this browser
we have detected that scripts are {{{_OFF}}}, {{enable|allow|activate}} scripts to go on
this {{page|site|app|view}} {{needs|requires}} JavaScript to work
this {{page|site|app|view}} does not work without JavaScript
cannot be shown without {{JavaScript|scripts|JS}}
your browser {{blocks|does not run|does not support}} {{JavaScript|scripts}}
scripting is {{{_OFF}}} in your browser, some content cannot be displayed
if nothing loads, {{{_SWITCH}}} scripts
noscript: this needs JS
Bitte {{aktivieren|erlauben}} Sie JavaScript im Browser, um die Seite zu nutzen
ohne JavaScript funktioniert diese Seite nicht und kann nicht dargestellt werden
diese Anwendung braucht JavaScript
veuillez {{activer|autoriser}} JavaScript dans votre navigateur pour afficher la page
cette page a besoin de JavaScript pour fonctionner
{{active|habilite|permita}} JavaScript en el navegador para ver esta página
esta página necesita JavaScript para funcionar
{{ative|habilite}} o JavaScript no navegador para ver esta página e continuar
esta página precisa do JavaScript para funcionar
{{abilitare|attivare|abilita}} JavaScript nel browser per vedere la pagina e continuare
questa pagina richiede JavaScript per funzionare
{{schakel|zet}} JavaScript in uw browser aan om deze pagina te zien
deze pagina werkt niet zonder JavaScript, JavaScript is nodig
{{включите|разрешите}} JavaScript в браузере, чтобы открыть страницу
для работы страницы нужен JavaScript
请在浏览器中{{启用|开启|打开}} JavaScript 后{{重试|刷新|继续浏览}}
本页面需要 JavaScript 才能{{正常使用|运行|显示}}
JavaScript を{{有効|オン}}にしてからページを再読み込みしてください
このサイトを利用するには JavaScript が必要です
자바스크립트를 {{켜고|활성화하고|허용하고}} 다시 시도해 주세요
이 페이지는 자바스크립트가 필요합니다
the page you {{requested|are looking for|tried to open}} {{could not be found|does not exist|has been moved or removed|cannot be found}}
oops! that page can’t be found, nothing was found here
nothing here, the page has moved or never existed
the requested URL was not found on this server
the link you followed {{may be broken|has expired}}, return to the home page
error {STATUS}: page not found
the server {{returned|responded with}} {{error|status}} {STATUS}
we are sorry, the {{service|site|page}} {{cannot be reached|is not available}} right now
this site can’t be reached
service is temporarily unavailable, error code {STATUS}
the server encountered an internal error and was unable to complete your request
an unexpected error has occurred, reference number 0
something went wrong on our end, try again in a few minutes
oops, something went wrong
an error occurred while processing your request, error id 0
we could not load this page, reload it
upstream request timeout
upstream connect error or disconnect before headers, reset reason: connection timeout
the connection timed out after 0 ms
request timed out
connection refused by the server
connection reset
error establishing a database connection
could not connect to the database in /var/www/index.php on line 0
Warning: Undefined variable $x in /var/www/index.php on line 0
Warning: Undefined array key x in /var/www/index.php on line 0
Notice: Undefined offset in template on line 0
Fatal error: Uncaught Exception in /var/www/index.php on line 0
Parse error: syntax error in index.php on line 0
Exception in thread x: java.lang.NullPointerException at line 0
Traceback (most recent call last): parse failure at offset 0
unhandled exception, stack trace follows
rate limit exceeded, slow down and retry in 0 seconds
too many requests from your address
your session has {{expired|timed out}}, sign in again or reload
access to this {{page|resource|address}} {{is denied|is forbidden|has been blocked}}
you don't have permission to access this resource
your request was blocked by a security rule, event 0
checking that your connection is secure, verify you are human, this may take a few seconds
please complete the security check, solve the captcha
we noticed unusual traffic from your network
attention required
this {{site|page|service}} is {{down|closed|offline}} for {{scheduled |}}maintenance, please {{check back|try again}} in 0 minutes
we are performing planned maintenance, back soon
under maintenance, come back later
{{Fehler|HTTP}} {STATUS}: die {{Seite|angeforderte Seite}} wurde nicht gefunden
diese Seite existiert nicht mehr
der Dienst ist {{vorübergehend|derzeit}} nicht verfügbar
wegen Wartung {{geschlossen|nicht erreichbar}}, bitte später erneut versuchen
die Verbindung wurde unterbrochen
Zugriff verweigert
erreur {STATUS}, cette page est introuvable
la page demandée n’existe pas
le service est temporairement indisponible
le site est en maintenance, merci de revenir plus tard
accès interdit
error {STATUS}, la página no existe o no se ha encontrado
no se encuentra la página
el servicio no está disponible por tareas de mantenimiento
sitio en mantenimiento, vuelva más tarde
acceso no permitido, acceso denegado
erro {STATUS}, esta página não existe ou não foi encontrada
o serviço está indisponível de momento, temporariamente
site em manutenção, volte mais tarde
o acesso foi negado
errore {STATUS}, la pagina non è stata trovata
la pagina richiesta non esiste
il servizio non è disponibile al momento
sito in manutenzione, torna più tardi
accesso negato
fout {STATUS}, deze pagina is niet gevonden
de pagina bestaat niet meer
de server is tijdelijk onbereikbaar
de site is in onderhoud, probeer het later opnieuw
toegang geweigerd
ошибка {STATUS}, такой страницы не существует, страница не найдена
запрошенная страница удалена
сервер временно не отвечает, сервис временно недоступен, попробуйте позже
сайт на техническом обслуживании
доступ к странице запрещён
错误 {STATUS}，找不到该页面
您访问的页面不存在或已被删除
系统正在维护，请稍后再试
服务器暂时无法访问，请稍后重试
没有访问权限，拒绝访问
エラー {STATUS}、ページが見つかりません
指定されたページは存在しません
ただいまメンテナンス中です。しばらくお待ちください
アクセスが集中しているため、しばらくしてからアクセスしてください
アクセス権がありません
오류 {STATUS}, 요청하신 페이지를 찾을 수 없습니다
존재하지 않는 페이지입니다
서비스 점검 중입니다. 잠시 후 다시 이용해 주세요
접속이 지연되고 있습니다
접근 권한이 없습니다"""

# Prose that has such things as its subject.
SUBJECT = """how to design an error page that helps your readers
what to write on a 404 page
ways to fix a 502 error in your proxy, step by step
fixing 500 errors: causes and solutions
why websites ask their visitors to turn on JavaScript
why so many pages need scripts enabled
how browsers run scripts, and what happens without them
how many visitors keep scripts disabled, so the site renders its pages on the server
access control explained, tips for administrators
null, nil, None and undefined: differences explained for beginners
undefined behaviour explained
the history of lorem ipsum, and why designers use it for decades
why designers should use real text instead of lorem ipsum
untitled: a new album, a night of music, an exhibition
a reply with status 503 usually means that the server is overloaded; wait some seconds and look at the logs
the server answers 404 when a page is missing, and the guide explains how it is logged
what does a placeholder like {{variable}} mean in a template file
meaning of ${variable} in scripts
in a template the placeholder is replaced by the value of the field, and filters can be applied
the variable in the template is filled in at run time
you can write placeholders in messages, which the program fills in
how to use variables in templates, the syntax explained
escaping variables in shell scripts and strings
the format string takes a value for each placeholder
the function returns null when the value is missing
maintenance windows explained: how to plan them
captchas explained, and why people dislike them"""


def _written_out(line: str) -> list[str]:
    """A line with every choice of its alternatives, one group at a time."""
    at = re.search(r"\{([^{}]*\|[^{}]*)\}", line)
    return [x for part in at.group(1).split("|") for x in _written_out(line[: at.start()] + part + line[at.end() :])] if at else [line]


def seeds() -> dict[str, list[str]]:
    """The stock phrases by kind; status lines are those of HTTP's registry."""
    status = [f"{prefix}{STATUS}{mark}{s.phrase}" for s in HTTPStatus if s >= 400 for prefix, mark in (("", " "), ("Error ", ": "), ("HTTP ", " - "))]
    status += [s.phrase for s in HTTPStatus if s >= 400] + [f"{s.phrase}. Reference 0" for s in HTTPStatus if s >= 400] + [STATUS, f"Error {STATUS}", f"HTTP {STATUS}"] * 20
    return {"filler": FILLER.split("\n"), "notices": status + [x for line in NOTICES.split("\n") for x in _written_out(line)], "subject": SUBJECT.split("\n")}


_PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%=?[^%\n]+%>|[$#]\{[^{}\n]+\}|\[\[[^\[\]\n]+\]\]|\[%[^%\n]+%\]|%[A-Za-z][\w.]+%"
    r"|__[A-Z][A-Z0-9_]*[A-Z0-9]__|@@\w+@@|\$[A-Z][A-Z0-9_]+\$|\{[A-Za-z_][\w.]*\}|\{\d{1,2}\}"
    r"|\[(?:INSERT|YOUR|ADD|ENTER)\b[^\[\]\n]*\]|<(?!/?(?:b|i|p|a|br|em|strong|span|div|u|s|sup|sub|li|ul|h[1-6])\b)[a-z]+(?:[_.-][a-z]+)*>|(?<![\w%])%[sd](?!\w)"
)
_BARE = re.compile(r"(?<![\w.\"'“‘])(?:undefined|null|NaN|None|nil|\(null\)|\[object Object\])(?![\w.]\w)(?![\"'”’])")
_HINT = re.compile(r"[{}%\[\]<>$@#]|__|undefined|null|NaN|None|nil")
# Ends of units: sentence ends, separators of title parts, spaced dashes, lines.
_BREAK = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|(?<=[。！？])|\s*[|｜·•¦»«‖]\s*|\s+[-–—―]+\s+|\n+|::")
_PRIVATE = re.compile("[-\x02]")


def with_symbols(texts: list[str]) -> list[str]:
    """Texts with placeholders and traces of values as symbols; a trace is
    one that begins or ends a unit."""
    return [_marked(t) for t in normalize_all(texts)]


def _marked(text: str) -> str:
    text = _PRIVATE.sub(" ", text)
    if _HINT.search(text):
        text = _PLACEHOLDER.sub(f" {SLOT * 12} ", text)
        if _BARE.search(text):
            out, at = [], 0
            for m in [*_BREAK.finditer(text), None]:
                unit = text[at : m.start() if m else len(text)]
                out.append(_traced(unit))
                if m:
                    out.append(m.group())
                    at = m.end()
            text = "".join(out)
    return text


def _traced(unit: str) -> str:
    found = [m for m in _BARE.finditer(unit) if not unit[: m.start()].strip(" .,:;'\"()") or not unit[m.end() :].strip(" .,:;'\"()!")]
    if found and len(found) == 1 and found[0].group() in ("None", "nil") and unit.strip(" .'\"()!") != found[0].group() and found[0].start() == len(unit) - len(unit.lstrip()):
        return unit
    for m in reversed(found):
        unit = f"{unit[: m.start()]} {TRACE * 6} {unit[m.end() :]}"
    return unit


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 mark, 1 letter, 2 digit,
    3 space, 4 end of a sentence, 5 mark that may follow it, 6 dash, 7 break."""
    out = np.zeros(0x10000, dtype=np.uint8)
    for c in range(0x10000):
        char = chr(c)
        out[c] = 2 if char.isdecimal() else 1 if char.isalnum() or 0xE000 <= c <= 0xE004 or unicodedata.combining(char) else 3 if char.isspace() else 0
    for chars, kind in ((".!?", 4), ("\"'”’»)]", 5), ("-–—―", 6), ("。！？|｜·•¦«‖\n\x02", 7)):
        out[[ord(c) for c in chars]] = kind
    return out


def _in_units(raw: np.ndarray) -> np.ndarray:
    """Code points with runs of digits as one 0, status numbers as symbols,
    marks as spaces, and units between their begin and end symbols."""
    n = len(raw)
    kind = np.where(raw < 0x10000, _classes()[np.minimum(raw, 0xFFFF)], 1)
    ahead = np.r_[kind[1:], 3, 3]
    behind = np.r_[3, kind[:-1]]
    space = (ahead[:n] == 3) | (ahead[:n] == 7)
    ends = (kind == 4) & (space | (ahead[:n] == 5) & ((ahead[1:] == 3) | (ahead[1:] == 7)))
    dash = (kind == 6) & space & (behind == 3)
    colons = (raw == 0x3A) & (np.r_[raw[1:], 0] == 0x3A)
    border = (kind == 7) | ends | dash | colons | (raw == 0xBB)
    # Status numbers: three digits from 400 to 599 that are no part of another number or word.
    digit = kind == 2
    opens = digit & (behind != 2)
    at = np.flatnonzero(opens & ((raw == 0x34) | (raw == 0x35)))
    if len(at):
        padded, code = np.r_[3, 3, kind, 3, 3, 3, 3, 3], np.r_[32, 32, raw, 32, 32, 32, 32, 32]
        joint = lambda i: np.isin(code[i + 2], (0x2E, 0x2C, 0x3A))
        good = (padded[at + 3] == 2) & (padded[at + 4] == 2) & (padded[at + 5] != 2) & (padded[at + 5] != 1) & (padded[at + 1] != 1) & ~joint(at - 1)
        good &= (code[at + 5] != 0x25) & ~(joint(at + 3) & (padded[at + 6] == 2)) & (code[at + 1] != 0x5F) & (code[at + 5] != 0x5F)
        at = at[good]
    out = np.where(digit, 0x30, np.where(kind == 1, raw, 32)).astype(np.uint32)
    keep = ~digit | opens
    for k in range(3):
        out[at + k], keep[at + k] = 0xE002, True
    keep &= ~((out == 32) & np.r_[False, out[:-1] == 32] & ~border & ~np.r_[False, border[:-1]])
    out[border] = np.where(raw[border] == 2, 2, 10)
    # A border becomes: space, end, the border itself, begin, space.
    out, border = out[keep], border[keep]
    width = np.where(border, 5, 1)
    place = np.cumsum(width) - width + 2
    full = np.empty(int(width.sum()) + 4, dtype=np.uint32)
    full[[0, 1, -2, -1]] = (0xE003, 32, 32, 0xE004)
    full[place[~border]] = out[~border]
    edge = place[border]
    for k, value in enumerate((32, 0xE004, out[border], 0xE003, 32)):
        full[edge + k] = value
    return full


class Units:
    """The n-grams of a batch of texts: their cells and the unit of each, and
    the text and symbols of each unit. N-grams are of five code points in
    scripts with letters, of two in Chinese, Japanese and Korean writing;
    digits are folded, and runs of space or marks count as one space."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer(_TEXT.join(t.replace(_TEXT, " ") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        raw = _in_units(raw)
        first = raw == 2
        border = first | (raw == 10)
        unit = np.cumsum(border)
        keep = ~border
        keep[1:] &= ~((raw[1:] == 32) & (raw[:-1] == 32))
        kept = raw[keep]
        codes = fold_codes(kept).astype(np.uint64)
        n = len(codes)
        padded = np.concatenate([codes, np.full(4, 32, np.uint64)])
        key = padded[:n] * np.uint64(0x9E3779B97F4A7C15) + padded[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        rest = padded[2 : n + 2] * np.uint64(0x165667B19E3779F9) + padded[3 : n + 3] * np.uint64(0x27D4EB2F165667C5) + padded[4 : n + 4] * np.uint64(0xD6E8FEB86659FD93)
        wide = (codes >= 0x2E80) & ~((codes >= 0xE000) & (codes <= 0xE004))
        key += np.where(wide, np.uint64(0), rest)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        self.cells = (key >> np.uint64(44)).astype(np.int64)
        self.unit = unit[keep]
        # N-grams stay within their unit.
        inside = np.ones(n, dtype=bool)
        reach = np.where(wide, 1, 4)
        ahead = np.minimum(np.arange(n) + reach, n - 1)
        inside &= (self.unit[ahead] == self.unit) & (np.arange(n) + reach < n)
        marked = np.r_[(codes == 0xE000) | (codes == 0xE001), np.zeros(4, dtype=bool)]
        touched = marked[:n] | marked[1 : n + 1] | marked[2 : n + 2] | marked[3 : n + 3] | marked[4 : n + 4]
        spaces = np.r_[codes == 32, np.zeros(4, dtype=bool)]
        numbers = np.r_[codes == 0xE002, np.zeros(4, dtype=bool)]
        across = spaces[1 : n + 1] | spaces[2 : n + 2] | spaces[3 : n + 3] | numbers[:n] | numbers[1 : n + 1] | numbers[2 : n + 2] | numbers[3 : n + 3] | numbers[4 : n + 4]
        self.cells, self.unit, codes = self.cells[inside], self.unit[inside], codes[inside]
        self.n_units = int(unit[-1]) + 1 if len(unit) else 0
        self.text = np.cumsum(np.r_[0, first[border]])
        # A character of wide scripts says as much as some letters.
        self.weight = np.where((codes >= 0x2E80) & ~((codes >= 0xE000) & (codes <= 0xE004)), 2.5, 1.0)
        self.symbol = np.where((codes == 0xE000) | (codes == 0xE001), codes, 0)
        self.status = codes == 0xE002
        # N-grams that reach into a placeholder or a trace.
        self.touched = touched[inside]
        self.across = across[inside]
        # Words, to tell how many of them speak for residue; three wide characters are one.
        self.word = (np.cumsum(codes == 32) if len(codes) else np.zeros(0, dtype=np.int64)) + np.cumsum(self.weight > 1) // 3
        self.size = np.bincount(self.unit, minlength=self.n_units)


def _seed_counts(lines: list[str]) -> np.ndarray:
    return np.bincount(Units(with_symbols(lines)).cells, minlength=CELLS).astype(float)


def _summed(texts: DataFrame, columns: tuple[str, ...], count, kinds: int) -> np.ndarray:
    """Sum over all rows of tables of ``kinds`` times ``CELLS`` counts; each
    task sends its non-zero cells, at most that many."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * CELLS, dtype=np.int64)
        for batch in batches:
            values = list(dict.fromkeys(v for column in batch.columns for v in column.drop_null().to_pylist()))
            for i in range(0, len(values), 512):
                for kind, cells in enumerate(count(values[i : i + 512])):
                    total[kind * CELLS : (kind + 1) * CELLS] += np.bincount(cells, minlength=CELLS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["cell", "n"])

    found = texts.select(*columns).mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(kinds * CELLS)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(kinds, CELLS)


def prose_counts(documents: DataFrame, columns: tuple[str, ...] = ("text", "title")) -> np.ndarray:
    """Counts of the n-grams of all documents, by cell; a table of fixed size."""
    return _summed(documents, columns, lambda texts: [Units(texts).cells], 1)[0]


class ResidueModel:
    """Log likelihood ratios of n-grams by cell: residue and subject against
    prose. ``learned`` are the counts that rows add to residue and to prose, beside
    ``few`` n-grams of which nothing is known."""

    def __init__(self, prose: np.ndarray, learned: np.ndarray | None = None, floor: float = 2e-6, window: int = 12, hot: float = 0.8, few: float = 10_000):
        counts = {kind: _seed_counts(lines) for kind, lines in seeds().items()}
        filler, notices, subject = (counts[k] / counts[k].sum() for k in ("filler", "notices", "subject"))
        prose = written = prose / max(prose.sum(), 1.0)
        residue = np.maximum(filler, notices)
        if learned is not None:
            residue, prose = (np.maximum(a, b / (b.sum() + few)) for a, b in zip((residue, prose), learned))
        self.residue = np.log((residue + floor) / (np.maximum(prose, subject / 8) + floor)).astype(np.float32)
        self.subject = np.log((subject + floor) / (np.maximum(written, residue) + floor)).astype(np.float32)
        slots = np.unique(Units([f" {SLOT * 12} {TRACE * 6} "]).cells)
        self.residue[slots] = np.maximum(np.log((1e-3 + floor) / (prose[slots] + floor)), -1)
        self.window, self.hot = window, hot

    def judge(self, units: Units) -> dict[str, np.ndarray]:
        """By unit: share covered by hot windows, longest hot run, sum of the
        ratios inside, mean subject ratio, and the symbols it holds."""
        n, total = len(units.cells), units.n_units
        if not n:
            zero = np.zeros(total)
            return {"cover": zero, "run": zero, "sum": zero, "talk": zero, "peak": zero, "words": zero, "slot": zero > 0, "trace": zero > 0, "status": zero > 0}
        ratio = self.residue[units.cells].astype(np.float64)
        at = np.arange(n)
        start = np.r_[0, np.flatnonzero(units.unit[1:] != units.unit[:-1]) + 1]
        sizes = np.diff(np.r_[start, n])
        end = np.minimum(at + self.window, np.repeat(start + sizes, sizes))
        whole = (end - at == self.window) | np.isin(at, start)
        sums = np.r_[0.0, np.cumsum(ratio)]
        hot = whole & (sums[end] - sums[at] > self.hot * (end - at))
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, at[hot], 1)
        np.add.at(edge, end[hot], -1)
        inside = np.cumsum(edge)[:-1] > 0
        # Runs of hot n-grams within a unit.
        fresh = np.r_[True, (inside[1:] != inside[:-1]) | (units.unit[1:] != units.unit[:-1])]
        runs = np.flatnonzero(fresh)
        length = np.where(inside[runs], np.diff(np.r_[runs, n]), 0)
        run = np.zeros(total)
        np.maximum.at(run, units.unit[runs], length)
        peak = np.full(total, -np.inf)
        np.maximum.at(peak, units.unit, ratio)
        # Words of which two n-grams of their own strongly speak for residue; numbers are none.
        strong = np.flatnonzero((ratio > 2) & ~units.across)
        span = int(units.word.max(initial=0)) + 1
        spoken, times = np.unique(units.unit[strong] * span + units.word[strong], return_counts=True)
        words = np.bincount(spoken[times > 1] // span, minlength=total)
        size = np.maximum(units.size, 1)
        talk = self.subject[units.cells].astype(np.float64)
        known = (np.abs(talk) > 0.05) & ~units.touched
        of = lambda weights: np.bincount(units.unit, weights=weights, minlength=total)
        talked = of(known.astype(float))
        return {
            "cover": of(inside.astype(float)) / size, "run": run, "sum": of(np.where(inside, ratio * units.weight, 0.0)),
            "talk": np.where(talked >= 6, of(np.where(known, talk, 0.0)) / np.maximum(talked, 1), 0.0),
            "peak": peak, "words": words, "status": (units.size <= 3) & (of(units.status.astype(float)) > 0), "slot": of((inside & (units.symbol == 0xE000)).astype(float)) > 0, "trace": of((inside & (units.symbol == 0xE001)).astype(float)) > 0,
        }


def _talked(units: Units, told: dict[str, np.ndarray], least: float) -> np.ndarray:
    """By unit: whether it or its neighbours in the text talk about such things."""
    talk = told["talk"] > least
    same = units.text[1:] == units.text[:-1]
    out = talk.copy()
    out[1:] |= talk[:-1] & same
    out[:-1] |= talk[1:] & same
    return out


def kinds_of(texts: list[str], model: ResidueModel, least_cover: float = 0.55, least_sum: float = 20.0, least_mean: float = 1.3, least_run: int = 48, least_talk: float = 0.0, short: int = 30) -> list[str | None]:
    """``placeholder``, ``trace`` or ``notice`` for each text; None for content.

    Half of ``least_sum``, and three quarters of ``least_mean``, are asked of a
    text that is covered as a whole. A unit
    that is only a status number says enough where little else stands in the
    text, at most ``short`` n-grams."""
    units = Units(with_symbols(texts))
    told = model.judge(units)
    about = _talked(units, told, least_talk)
    size = np.bincount(units.text, weights=units.size, minlength=len(texts))
    whole = np.bincount(units.text, weights=told["cover"] * units.size, minlength=len(texts)) >= 0.9 * size
    less = np.where(whole[units.text], 0.5, 1.0)
    notice = (told["sum"] >= least_sum * less) & (told["sum"] >= least_mean * (1 + less) / 2 * told["cover"] * units.size) & ((told["cover"] >= least_cover) | (told["run"] >= least_run)) & ~about
    notice |= told["status"] & (told["peak"] > 0) & (size[units.text] <= short) & ~about
    own = told["talk"] > least_talk
    out: list[str | None] = [None] * len(texts)
    for name, hit in (("notice", notice), ("trace", told["trace"] & ~own), ("placeholder", told["slot"] & ~own)):
        for i in units.text[np.flatnonzero(hit)].tolist():
            out[i] = name
    return out


def learned_counts(rows: DataFrame, fields: tuple[str, ...], model: ResidueModel) -> np.ndarray:
    """Counts of the n-grams of the units of all rows, in two tables: of those
    that the model takes for residue, and of texts that it takes for content."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return _summed(rows, fields, lambda texts: learned_cells(texts, shared.value), 2)


def learned_cells(texts: list[str], model: ResidueModel, least_cover: float = 0.5, least_sum: float = 25.0, least_talk: float = 0.0, whole: float = 0.6, none: float = 0.3, least_words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Cells of residue and of content. Residue is learned from texts that are
    ``whole`` or more covered, where ``least_words`` words speak for it (one
    may do so by chance), content from those that are ``none`` or less."""
    units = Units(with_symbols(texts))
    told = model.judge(units)
    taken = (told["cover"] >= least_cover) & (told["sum"] >= least_sum) & (told["words"] >= least_words) & ~_talked(units, told, least_talk)
    size = np.bincount(units.text, weights=units.size, minlength=len(texts))
    cover = np.bincount(units.text, weights=told["cover"] * units.size, minlength=len(texts)) / np.maximum(size, 1)
    plain = ~np.isin(units.unit, units.unit[units.symbol > 0])
    return units.cells[(taken & (cover[units.text] >= whole))[units.unit] & plain], units.cells[(cover[units.text] <= none)[units.unit] & plain]


def fit_residue(rows: DataFrame, documents: DataFrame, fields: tuple[str, ...] = ("title", "snippet"), prose: tuple[str, ...] = ("text", "title"), rounds: int = 1) -> ResidueModel:
    """The model from the stock phrases, all documents, and ``rounds`` passes
    over all rows. Runs a job for the documents and one for each round."""
    counts = prose_counts(documents, prose)
    model = ResidueModel(counts)
    for _ in range(rounds):
        model = ResidueModel(counts, learned_counts(rows, fields, model))
    return model


def residue_fields(
    rows: DataFrame, documents: DataFrame, key: str = "result_id", fields: tuple[str, ...] = ("title", "snippet"), prose: tuple[str, ...] = ("text", "title"), rounds: int = 1
) -> DataFrame:
    """The fields that hold residue: ``key, field, kind``.

    Null, empty and blank fields are never cases; repeated rows count each;
    an empty table gives no rows. Without documents, prose is unknown and
    only the example models decide. The models are fitted while this is built.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fit_residue(rows, documents, fields, prose, rounds))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            for field in fields:
                values = frame[field]
                texts = list(dict.fromkeys(values.dropna()))
                kinds = {}
                for i in range(0, len(texts), 512):
                    kinds.update(zip(texts[i : i + 512], kinds_of(texts[i : i + 512], model)))
                found = values.map(kinds, na_action="ignore")
                hit = found.notna()
                if hit.any():
                    yield pd.DataFrame({key: frame.loc[hit, key], "field": field, "kind": found[hit]})

    return rows.select(key, *fields).mapInPandas(scan, f"{key} {rows.schema[key].dataType.simpleString()}, field string, kind string")
