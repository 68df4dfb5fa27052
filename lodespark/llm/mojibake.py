"""Garbled text from wrong character encoding.

A best-first search runs over encode, decode and unescape operations: a state is a string, its successors are what the
operations make of it, states already seen are kept by hash, and the queue is ordered by a character-plausibility cost.
The cheapest reachable text is taken as the original if it is clearly cheaper than what was given. The search runs on
the words that hold characters outside ASCII, once per distinct word of a task; the rest of a text cannot be garbled.

Reading bytes as UTF-8 hardly ever succeeds by chance and proves itself. Taking one single-byte encoding for another
proves nothing, as any letters make other letters: it is tried only on words that no language writes (scripts mixed,
signs inside words, box-drawing), at most once on a way, and the whole document decides which two encodings it was.
Words of the letters of any language in Latin script are left alone; only if the small-letter words of a document in a
known language mostly have letters that the language lacks, and one exchange turns them all into words of its alphabet,
is the document taken as garbled. Every operation but that exchange shortens the text, so the search ends by itself.
"""

from __future__ import annotations

import bisect
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which bytes may have been read by mistake.
MISREAD = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac-roman", "iso8859-15", "koi8-r")
#: Encodings in which text of the corpus' languages may have been written, besides UTF-8.
WRITTEN = ("cp1252", "cp850", "mac-roman")
#: Letters outside ASCII that the corpus' languages use (fixed values: French, German, Spanish, English loans).
LETTERS = frozenset("àâäæçéèêëîïôœöùûüÿñáíóúßÀÂÄÆÇÉÈÊËÎÏÔŒÖÙÛÜŸÑÁÍÓÚẞ")
#: Letters outside ASCII of the other languages in Latin script (fixed values, one language or group a line).
ALPHABETS = frozenset(
    "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"  # Polish
    "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽäĺľŕôÄĹĽŔÔ"  # Czech and Slovak
    "áéíóöőúüűÁÉÍÓÖŐÚÜŰ"  # Hungarian
    "ăâîșțşţĂÂÎȘȚŞŢ"  # Romanian
    "çğıöşüâîûÇĞİÖŞÜÂÎÛəƏ"  # Turkish and Azerbaijani
    "čćđšžČĆĐŠŽ"  # Croatian and Slovene
    "āčēģīķļņšūžōŗĀČĒĢĪĶĻŅŠŪŽŌŖąčęėįšųūžĄČĘĖĮŠŲŪŽ"  # Latvian and Lithuanian
    "äõöüšžÄÕÖÜŠŽåæøáðéíóúýþÅÆØÁÐÉÍÓÚÝÞ"  # Estonian, Finnish and Nordic languages
    "ãõâêôàáéíóúçÃÕÂÊÔÀÁÉÍÓÚÇŀĿòÒìÌ"  # Portuguese, Catalan, Italian
    "ċġħżĊĠĦŻŵŷẁẃẅỳŴŶẀẂẄỲĉĝĥĵŝŭĈĜĤĴŜŬëËẽẼĩĨũŨ"  # Maltese, Welsh, Esperanto, Albanian, Guarani
    "ăâđêôơưĂÂĐÊÔƠƯ"  # Vietnamese, besides the block of its accented letters
) | frozenset(map(chr, range(0x1EA0, 0x1EFA)))
#: Small letters outside ASCII and the commonest words of the languages whose documents are judged as a whole (fixed values).
LANGUAGES = {
    "fr": ("àâæçéèêëîïôœùûüÿ", "le la les des et est une un dans pour que qui sur par il elle au aux du se ne pas ce"),
    "de": ("äöüß", "der die das und ist ein eine den dem des mit von im in zu auf sich nicht auch wurde war als"),
    "es": ("áéíñóúü", "el la los las de del y en que un una por con se su para es al como no fue"),
}
#: Garbled small-letter words, all different, by which a document is judged as a whole.
EVIDENCE = 3
#: Marks outside ASCII that proper text in those languages uses.
MARKS = frozenset("²³¹“”„‘’‚«»–—…¡¿€£°§©®™±½¼¾·•ºª× ​­ ")
LOST = "�"
#: Characters that no misreading by itself leaves behind: small letters and quotes. Bytes of a UTF-8 sequence always give one outside this set.
SAFE = "".join(sorted(c for c in LETTERS if c.islower())) + "“”„’–—…¡¿"
#: How much cheaper the text reached must be, and how much where the bytes read as UTF-8, which hardly happens by chance.
MARGIN = 0.75
PROVEN = 0.15
#: The price of taking one single-byte encoding for another.
SWAP = 0.6
_ENTITY = r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);"
_ODD = rf"[^\x00-\x7F{SAFE}]"
_SMALL = "a-z" + "".join(sorted(c for c in LETTERS if c.islower()))
_CAPITALS = "A-Z" + "".join(sorted(c for c in LETTERS if c.isupper()))
#: Marks of ``SAFE`` between letters, which cp850 and mac-roman leave for letters. A small à, which an ellipsis may stand for, is hardly ever followed by a letter.
_INSIDE = rf"[“”„¡¿](?<=[{_SMALL}{_CAPITALS}].)(?=[{_SMALL}])|[“”„…¡¿](?<=[{_CAPITALS}].)(?=[{_CAPITALS}])"
_WORD = re.compile(r"[^ \t\r\n]+")
_SUSPECT = re.compile(rf"{_ODD}|{_ENTITY}")
_MARK = re.compile(_INSIDE)
_QUOTE = re.compile("[“”„]")
_EDGES = "“”„…¡¿"
#: Longer words are searched in parts: runs outside ASCII with a character on either side.
LONG_WORD = 80
_PART = re.compile(rf"[!-~]?[^\x00-\x7F]{{1,240}}[!-~]?|{_ENTITY}")


def _table(name: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; bytes that the encoding leaves undefined stand for themselves, as decoders do it."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {chr(b): b for b in range(0x80, 0xA0)} if name.startswith("cp12") else {}
    return chars, back | {c: b for b, c in enumerate(chars)}


_TABLES = {name: _table(name) for name in {*MISREAD, *WRITTEN}}

_LEADS = {c for name in MISREAD for c in (_TABLES[name][0][0xC2], _TABLES[name][0][0xC3], _TABLES[name][0][0xE2] + _TABLES[name][0][0x80])} - {"¬"}
#: The first character of a misread sequence at the end of a word of small letters, its second one lost; ¬ also marks hyphenation.
_ORPHAN = re.compile(rf"[{_SMALL}]{{2}}(?:{'|'.join(sorted(map(re.escape, _LEADS)))})[.,;:!?)\"']*$")


def _bytes(text: str, name: str) -> bytes | None:
    back = _TABLES[name][1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=1 << 16)
def _script(char: str) -> str:
    if char.isascii():
        return "a" if char.isalpha() else ""
    category = unicodedata.category(char)
    if category[0] != "L":
        return ""
    return unicodedata.name(char, "OTHER").split(" ")[0]


def _formula(text: str, i: int) -> bool:
    """Whether a Greek letter or micro sign stands as a sign: alone, in a formula or before a unit, not within a word."""
    before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
    if before.isalpha() and _script(before) not in ("GREEK", "MICRO"):
        return False
    tail = len(text[i + 1 :]) - len(text[i + 1 :].lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return not after.isalpha() or tail <= (4 if text[i] in "µμ" else 2)


def _cost(text: str, signs: bool = True) -> float:
    """The implausibility of a word: 0 for ASCII, little for proper letters and marks, much for what garbling makes.

    ``signs`` allows Greek letters as signs of formulas and units.
    """
    total, before, scripts, mixed = 0.0, "", set(), 0
    for i, char in enumerate(text):
        if not char.isascii():
            kind = _script(char)
            if char == LOST:
                total += 3.0
            elif char in LETTERS or char in ALPHABETS:
                # A capital inside a word of small letters is what bytes above 0xC0 turn into.
                inner = before.islower() or (before.isalpha() and text[i + 1 : i + 2].islower())
                total += 1.6 if char.isupper() and inner else 0.3 if char in LETTERS else 0.35
                # One byte is ö in cp850 and î in mac-roman, which mostly follows a vowel: decides between equals.
                total += 0.01 if char in "öî" and (char == "î") != (before in ("a", "o", "u")) else 0.0
                scripts.add("LATIN")
            elif char in MARKS:
                after = text[i + 1 : i + 2]
                inside = before.isalpha() and (char in "±×" or (after.isalpha() and char not in "’‘\u00ad\u200b\u00a0\u202f–—" and (char != "·" or (before.lower(), after.lower()) != ("l", "l"))))
                total += 2.0 if inside or (before and not before.isascii() and before not in MARKS and char not in "”’»…“–—") else 0.4
            elif "\x80" <= char <= "\x9f":
                total += 3.0
            elif kind == "LATIN":
                total += 1.3
                scripts.add(kind)
            elif kind:
                total += 0.15
                if not signs or kind not in ("GREEK", "MICRO") or not _formula(text, i):
                    scripts.add(kind)
                    mixed += 1
            else:
                category = unicodedata.category(char)
                # A combining accent is proper where it makes a letter.
                accent = "\u0300" <= char <= "\u036f" and bool({unicodedata.normalize("NFC", before + char)} & (LETTERS | ALPHABETS))
                total += 0.3 if category == "Cf" or accent or "\ufe00" <= char <= "\ufe0f" else 0.5 if category == "So" and ord(char) > 0x2600 else 1.8
        elif char.isalpha():
            scripts.add("LATIN")
        before = char
    scripts -= {"HIRAGANA", "KATAKANA"} if "CJK" in scripts else set()
    return total + 2.0 * mixed if len(scripts) > 1 else total


def _proven(text: str) -> Iterator[str]:
    """What unescaping and reading as UTF-8 make of ``text``; all of it is shorter."""
    if "&" in text and (plain := html.unescape(text)) != text:
        yield plain
    for name in MISREAD:
        if (raw := _bytes(text, name)) is not None:
            try:
                yield raw.decode("utf-8")
            except UnicodeDecodeError:
                pass


#: The encoding read by mistake and the one written.
Exchange = tuple[str, str]
EXCHANGES: tuple[Exchange, ...] = tuple((name, other) for other in WRITTEN for name in MISREAD if name != other)

#: Rarer encodings cost a little more, which decides between equals.
PRICES = {(read, written): SWAP + (0.02 if written != "cp1252" else 0.0) + (0.06 if read in ("cp1253", "cp1254", "iso8859-15", "koi8-r") else 0.0) for read, written in EXCHANGES}


def _exchanged(text: str, exchange: Exchange) -> str | None:
    raw = _bytes(text, exchange[0])
    return None if raw is None else "".join(_TABLES[exchange[1]][0][b] for b in raw)


@dataclass(frozen=True)
class Found:
    """A word as far as it can be restored, whether it is garbled (restorable or not), and what each exchange of encodings would make of it (gain and text), where it takes one.

    ``weak`` tells that a word of proper letters only reads as UTF-8, which needs other evidence in its document.
    """

    text: str
    garbled: bool
    exchanges: tuple[tuple[Exchange, float, str], ...] = ()
    weak: bool = False


@lru_cache(maxsize=1 << 17)
def restore_word(word: str) -> Found:
    """The cheapest text reachable from ``word``."""
    start = html.unescape(word) if "&" in word else word
    given = _cost(start)
    if given < PROVEN:
        return Found(word, False)
    best: dict[Exchange | None, tuple[float, str]] = {None: (given, start)}
    seen, queue = {hash((start, None))}, [(given, 0, start, None)]

    def reach(text: str, exchange: Exchange | None) -> None:
        if hash((text, exchange)) not in seen and not any(c < " " for c in text):
            seen.add(hash((text, exchange)))
            cost = _cost(text) + (PRICES[exchange] if exchange else 0.0)
            heapq.heappush(queue, (cost, len(seen), text, exchange))

    while queue:
        cost, _, text, exchange = heapq.heappop(queue)
        if exchange not in best or cost < best[exchange][0]:
            best[exchange] = (cost, text)
        for reached in _proven(text):
            reach(reached, exchange)
        # Proper letters are cheap: an exchange pays only where more than letters is wrong.
        if exchange is None and _cost(text) >= MARGIN + SWAP:
            for way in EXCHANGES:
                if (swapped := _exchanged(text, way)) is not None and swapped != text:
                    reach(swapped, way)
    plain_cost, plain = best.pop(None)
    # With its second byte lost, what another encoding makes of the first is no restoration.
    orphan = bool(_ORPHAN.search(word))
    ways = () if orphan else tuple((way, given - cost, text) for way in EXCHANGES if way in best and given - (cost := best[way][0]) >= MARGIN and (text := best[way][1]) and cost < plain_cost - 1e-9)
    if ways:
        return Found(max(ways, key=lambda w: w[1])[2], True, ways)
    changed = given - plain_cost >= PROVEN
    marked = [c for c in start if not c.isascii()]
    weak = changed and start == word and all(c in LETTERS or c in ALPHABETS for c in marked) and given < 0.35 * len(marked) + 0.2
    return Found(plain if changed else word, changed or orphan or LOST in word, (), weak)


def inner_marks(text: str) -> list[int]:
    """The places of marks between letters that stand for letters: not of quotes that lack a space, which have a partner."""
    marks = [m.start() for m in _MARK.finditer(text)]
    if not marks:
        return marks
    inner = set(marks)
    quotes = [m.start() for m in _QUOTE.finditer(text) if m.start() not in inner]
    opens = [not q or text[q - 1].isspace() or text[q - 1] in "([" for q in quotes]
    out = []
    for at in marks:
        i = bisect.bisect(quotes, at)
        opened, closed = i > 0 and opens[i - 1], i < len(quotes) and not opens[i]
        if not (opened and not closed and text[at] in "“”" or closed and not opened and text[at] in "“„"):
            out.append(at)
    return out


def suspects(text: str) -> Iterator[tuple[int, str]]:
    """(place, piece) of what may be garbled: words, or parts of very long words, in linear time."""
    marks = inner_marks(text)

    def marked(start: int, stop: int) -> bool:
        i = bisect.bisect_left(marks, start)
        return i < len(marks) and marks[i] < stop

    for m in _WORD.finditer(text):
        word = m.group()
        if not word.isascii() or "&" in word:
            if len(word) <= LONG_WORD:
                if _SUSPECT.search(word):
                    yield m.start(), word
                elif marked(m.start(), m.end()):
                    # Proper marks around the word stay out of the search.
                    core = word.lstrip(_EDGES)
                    yield m.end() - len(core), core.rstrip(_EDGES)
            else:
                for part in _PART.finditer(word):
                    if _SUSPECT.search(part.group()) or marked(m.start() + part.start(), m.start() + part.end()):
                        yield m.start() + part.start(), part.group()


_SMALL_WORD = re.compile(rf"(?<![^\W_])[{_SMALL}{''.join(sorted(c for c in ALPHABETS if c.islower()))}]+(?![^\W_])")
_COMMON_WORDS = {w: lang for lang, (_, told) in LANGUAGES.items() for w in told.split() if sum(w in other.split() for _, other in LANGUAGES.values()) == 1}
_FOREIGN = re.compile(f"[{''.join(sorted(c for c in ALPHABETS - LETTERS if c.islower()))}]")


_PLAIN_WORD = re.compile(rf"(?<![^\W_])[a-z]+(?![^\W_])")
_GREEK = re.compile("[\u00b5\u0370-\u03ff]")


def foreign_exchange(text: str) -> Exchange | None:
    """The exchange of encodings that a document of proper but wrong letters has undergone, by the document as a whole."""
    if not _FOREIGN.search(text):
        return None
    said = [lang for w in _PLAIN_WORD.findall(text) if (lang := _COMMON_WORDS.get(w))]
    if not said:
        return None
    lang = max(sorted(set(said)), key=said.count)
    own = frozenset(LANGUAGES[lang][0])
    marked = {w for w in _SMALL_WORD.findall(text) if not w.isascii()}
    wrong = sorted(w for w in marked if not all(c.isascii() or c in own for c in w))
    if len(wrong) < EVIDENCE or 2 * len(wrong) < len(marked):
        return None
    for way in EXCHANGES:
        if all((swapped := _exchanged(w, way)) is not None and all((c.isascii() and c.isalpha()) or c in own for c in swapped) for w in wrong):
            return way
    return None


def restore(text: str) -> tuple[bool, str]:
    """(garbled, restored text). Of several exchanges of encodings the one of the greatest gain over the text is taken."""
    hits: list[tuple[int, str, Found]] = []
    signs: list[tuple[int, str]] = []
    for place, piece in suspects(text):
        found = restore_word(piece)
        if found.garbled:
            hits.append((place, piece, found))
        elif _GREEK.search(piece):
            signs.append((place, piece))
    if all(found.weak for *_, found in hits) and len({piece for _, piece, _ in hits}) < EVIDENCE:
        hits = []
    gains: dict[Exchange, float] = {}
    for piece, found in {piece: found for _, piece, found in hits if found.exchanges}.items():
        for way, gain, _ in found.exchanges:
            gains[way] = gains.get(way, 0.0) + gain
    chosen = max(EXCHANGES, key=lambda w: gains.get(w, 0.0)) if gains else None
    if chosen is None and (chosen := foreign_exchange(text)) is not None:
        own = {piece for _, piece, _ in hits}
        for m in _SMALL_WORD.finditer(text):
            if m.group() not in own and _FOREIGN.search(m.group()):
                hits.append((m.start(), m.group(), Found(_exchanged(m.group(), chosen), True)))
    elif chosen is not None and sum(any(way == chosen for way, *_ in found.exchanges) for found in {p: f for _, p, f in hits}.values()) > 1:
        # Where other words show the exchange, what might have been a sign is none.
        for place, piece in signs:
            if (swapped := _exchanged(piece, chosen)) is not None and _cost(piece, signs=False) - _cost(swapped) >= MARGIN:
                hits.append((place, piece, Found(swapped, True)))
    hits.sort(key=lambda h: h[0])
    if not hits:
        return False, text
    out, last = [], 0
    for place, piece, found in hits:
        if place < last:
            continue
        put = next((told for way, _, told in found.exchanges if way == chosen), found.text)
        out += [text[last:place], put]
        last = place + len(piece)
    return True, "".join([*out, text[last:]])


def garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, lossy): the documents with garbled characters, and their text as far as it can be restored.

    ``lossy`` tells that replacement characters remain. Texts without a character that garbling leaves never leave the JVM; null and empty texts
    are not garbled; repeated rows are judged each.
    """
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, content in zip(batch["k"], batch["t"], strict=True):
                hit, restored = restore(content)
                if hit:
                    rows.append((k, restored, LOST in restored))
            yield pd.DataFrame(rows, columns=["k", "restored", "lossy"])

    # ASCII characters are passed over before the larger classes are tried.
    suspect = F.col("t").rlike(rf"(?=[^\x00-\x7F])(?:{_ODD}|{_INSIDE})|{_ENTITY}")
    given = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(suspect)
    return given.mapInPandas(search, "k string, restored string, lossy boolean").select(F.col("k").cast(kind).alias(key), "restored", "lossy")
