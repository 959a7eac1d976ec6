"""One consistent form for text that looks the same.

Differences without a difference in look are: wide or ordinary forms, accents composed or apart, joined
letters or letters singly, characters without width, the kind of space, letters of another script (or
letter symbols) of the same shape. Letter case, accents, punctuation, line ends, tabs, control characters
and the number of spaces stay as they are, as do any two unequal ASCII characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import chain

import regex

#: Scripts whose letters are compared by shape, in the order in which a token is spelled where several can spell it.
PREFERRED = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Hiragana", "Katakana", "Han", "Coptic", "Lisu", "Canadian_Aboriginal", "Tifinagh", "Lycian", "Carian", "Old_Italic", "Deseret", "Osage", "Elbasan")
# Likenesses in Unicode's confusables that are no more than that: other forms, other heights, a dot or serif less.
LOOSE = "ͺαγισυϒϱϺᴦ УЬгѡүҽꙇ ագզռցք ᎥᎩᎽᏂᏏᏒᏔᏕᏧᏳꭵꮁ ᕽᖯᗞ ⲅ"
# Letters of one shape that the confusables leave out or give another double, as letter=double.
EXTRA = "ɑ=a ɡ=g ᴄ=c ᴏ=o ᴠ=v ᴡ=w ᴢ=z ᴜ=u ꜱ=s ӏ=l Ԛ=Q Γ=Г Π=П Φ=Ф ヘ=へ 二=ニ 力=カ 口=ロ 工=エ 卜=ト 夕=タ 八=ハ"
_RANGES = ((0x80, 0x3100), (0xA000, 0xAC00), (0xFB00, 0xFE00), (0x10000, 0x12000), (0x16000, 0x17000), (0x1E000, 0x1F000))
#: Marks that are formatting characters by category but are drawn.
_DRAWN_FORMATS = regex.compile(r"\p{Prepended_Concatenation_Mark}")
_NO_WIDTH = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]")
_FILLERS = "\u115f\u1160\u3164\uffa0"  # ignorable by default, yet as wide as a letter
# Tags of letters drawn as they stand in a word, one or several joined (Arabic presentation forms).
_JOINED = ("<initial", "<medial", "<final", "<isolated")
# Letter symbols of the shape of their letter: micro sign, Hebrew symbols, radicals, single jamo.
_SYMBOLS = ((0xB5, 0xB5), (0x2135, 0x2138), (0x2E80, 0x2FD5), (0x3131, 0x318E))
TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in PREFERRED}
_COMMON = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


def _plain(c: str) -> str | None:
    """What a single character is replaced with wherever it stands, or None if it stays."""
    if c in _FILLERS:
        return None
    if _NO_WIDTH.match(c) and not _DRAWN_FORMATS.match(c):
        return ""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return None if c in " \u1680" else " "  # the ogham space is drawn
    tag, _, codes = unicodedata.decomposition(c).rpartition("> ")
    if not tag:
        return None
    into = "".join(chr(int(x, 16)) for x in codes.split())
    if tag in ("<wide", "<narrow", "<font") or tag in _JOINED and all(unicodedata.category(x)[0] in "LM" for x in into):
        return into
    if tag == "<compat" and kind[0] in "LN" and kind not in ("Nd", "No"):
        # joined letters; letters that number (roman numerals); other single letters mostly have a shape of their own
        if kind == "Nl" or len(into) > 1 and all(unicodedata.category(x)[0] in "LM" for x in into):
            return into
    if tag == "<compat" and any(a <= ord(c) <= b for a, b in _SYMBOLS):
        return into
    return None


@cache
def _simple() -> dict[int, str]:
    table = {}
    # planes and blocks without anything to replace (Han, Hangul, private use) are left out
    for i in chain(range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE1000)):
        into = _plain(chr(i))
        if into is not None:
            table[i] = into
    return table


def letter_shapes(spark) -> dict[str, list[tuple[str, str]]]:
    """Letters by script with the letter whose shape each has.

    Taken from Unicode's confusables in the ICU library that comes with Spark: letters of the scripts above
    (but Latin) whose skeleton is one ASCII letter, less ``LOOSE`` and with ``EXTRA``. ICU writes a capital
    I as l; letters without a small form of that shape are put back.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    empty = lambda kind: gateway.new_array(kind, 0)
    checker = jvm.java.lang.Class.forName("com.ibm.icu.text.SpoofChecker$Builder").getConstructor(empty(jvm.java.lang.Class)).newInstance(empty(jvm.java.lang.Object)).build()
    letters = [c for a, b in _RANGES for c in map(chr, range(a, b)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFD", c) == c]
    doubles = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")))
    extra = dict(pair.split("=") for pair in EXTRA.split())
    found: dict[str, list[tuple[str, str]]] = {}
    for c, double in sorted((doubles | extra).items()):
        if c not in extra:
            if len(double) != 1 or not (double.isascii() and double.isalpha()) or c in LOOSE or _plain(c) is not None or _script(c) not in PREFERRED[1:]:
                continue
            if double == "l" and unicodedata.category(c) != "Ll":
                double = "I"
        found.setdefault(_script(c), []).append((c, double))
    return found


_TABLE: dict[str, list[tuple[str, str]]] = {}


def use(table: dict[str, list[tuple[str, str]]]) -> None:
    """Work with these letter shapes in this process; tasks get them with their function."""
    if table != _TABLE:
        _TABLE.clear()
        _TABLE.update(table)
        _shapes.cache_clear()
        _folds.cache_clear()
        for known in (_forms, _parts, _runs):
            known.clear()


@cache
def _shapes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Prototype of each letter in the table; of each prototype its spelling by script."""
    if not _TABLE:
        raise RuntimeError("letter shapes are not loaded: use(letter_shapes(spark))")
    of: dict[str, str] = {}
    spelled: dict[str, dict[str, str]] = {}
    for name, pairs in _TABLE.items():
        for letter, proto in pairs:
            own = spelled.setdefault(proto, {})
            if not own:
                own[_script(proto)] = proto
                of[proto] = proto
            of[letter] = proto
            own.setdefault(name, letter)
    return of, spelled


@cache
def _script(c: str) -> str:
    """The script of a letter; empty for what goes with any script. Beyond the scripts above, the script's name in that of the letter."""
    if _COMMON.match(c):
        return ""
    for name, pattern in _SCRIPTS.items():
        if pattern.match(c):
            return name
    return re.split(r" (?:LETTER|SYLLABLE|SYLLABICS|CAPITAL|SMALL|VOWEL|SIGN|CHARACTER|IDEOGRAPH|MARK|LIGATURE|CONSONANT)\b|-", unicodedata.name(c, "OTHER"))[0].title()


#: Systems of writing that use several scripts together count as one: Japanese, Korean, and Chinese with its phonetic letters.
_TOGETHER = {"Han": {"Han", "Japanese", "Korean", "Chinese"}, "Hiragana": {"Hiragana", "Japanese"}, "Katakana": {"Katakana", "Japanese"}, "Hangul": {"Hangul", "Korean"}, "Bopomofo": {"Bopomofo", "Chinese"}}
_SHARED = {name: regex.compile(rf"\p{{Script_Extensions={name}}}") for name in (*PREFERRED, "Hangul", "Bopomofo", "Arabic", "Syriac", "Thaana", "Devanagari", "Bengali", "Gujarati", "Gurmukhi", "Kannada", "Malayalam", "Oriya", "Tamil", "Telugu", "Georgian", "Glagolitic", "Gothic", "Ethiopic", "Thai", "Lao", "Hebrew", "Mongolian", "Myanmar", "Khmer", "Tibetan")}


@cache
def _extended(c: str) -> frozenset[str] | None:
    """The scripts a character belongs to, by its extensions, with the systems of writing they are part of; None if it goes with any."""
    if _COMMON.match(c) and not any(p.match(c) for p in _SHARED.values()):
        return None
    names = {n for n, p in _SHARED.items() if p.match(c)} or {_script(c)}
    return frozenset(x for n in names for x in _TOGETHER.get(n, {n}))


def resolved_scripts(token: str) -> frozenset[str] | None:
    """Scripts that all characters of a token share; empty for a mixed token, None if no character tells."""
    sets = [s for c in token if (s := _extended(c)) is not None]
    return frozenset.intersection(*sets) if sets else None


def confusable(token: str) -> str | None:
    """``mixed`` if a token needs several scripts although its shapes can be spelled in one, ``mixed_only`` if they can't either;
    ``whole`` if it stands in one script but its shapes spell it in a preferred other one; None otherwise."""
    token = unicodedata.normalize("NFD", token)
    own = resolved_scripts(token)
    if own is None:
        return None
    form = consistent_token(token)
    if not own:
        return "mixed" if resolved_scripts(form) else "mixed_only"
    return "whole" if form != token and not (resolved_scripts(form) or frozenset()) & own else None


class _Forms(dict):
    """Tokens already brought to their form; emptied when it has grown large."""

    def __missing__(self, token: str) -> str:
        if len(self) > 100_000:
            self.clear()
        form = self[token] = consistent_token(token)
        return form


def consistent_token(token: str) -> str:
    """The consistent spelling of a run of letters and marks (decomposed).

    Each letter stands for its shape, which some scripts can spell. If the intersection over all letters
    is not empty the token can be written in one script; the first preferred one of those is taken, so a
    mixed token is mended and a token whose letters all have the shapes of another script (whole-script
    confusable) is written like its double. If no script spells them all, a letter of several scripts
    takes the one of the nearest letter that has a single script among them, looking left first. All of
    this depends on shapes alone, so tokens that look the same get the same form.
    """
    of, spelled = _shapes()
    protos = [of.get(c, c) for c in token]
    scripts = [set(spelled[p]) if p in spelled else {s} if (s := _script(p)) else None for p in protos]
    known = [s for s in scripts if s is not None]
    if not known:
        return token
    shared = set.intersection(*known)
    if shared:
        script = next((s for s in PREFERRED if s in shared), None)
        return "".join(spelled[p][script] if p in spelled else p for p in protos)
    out = []
    for i, (p, s) in enumerate(zip(protos, scripts)):
        if p not in spelled or len(s) == 1:
            out.append(p)
            continue
        near = next((scripts[j] for j in [*range(i - 1, -1, -1), *range(i + 1, len(protos))] if scripts[j] and len(scripts[j]) == 1 and scripts[j] <= s), set())
        out.append(spelled[p].get(next(iter(near), ""), p))
    return "".join(out)


_forms = _Forms()


def _form(text: str) -> str:
    text = unicodedata.normalize("NFD", text.translate(_simple()))
    if not text.isascii():
        text = TOKEN.sub(lambda m: t if (t := m.group()).isascii() else _forms[t], text)
    return unicodedata.normalize("NFC", text)


class _Recalled(dict):
    """Results of a function of short texts; emptied when there are many."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str):
        made = self.make(text)
        if len(text) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[text] = made
        return made


_parts = _Recalled(_form)


def same_look(text: str) -> str:
    """The consistent form of a text; texts that look the same have the same form, and only those.

    Blanks and line feeds bound everything that is composed or spelled together, so the parts between
    them are brought to their form one by one, ASCII lines and words being it already.
    """
    if text.isascii():
        return text
    return "\n".join(line if line.isascii() else " ".join([w if w.isascii() else _parts[w] for w in line.split(" ")]) for line in text.split("\n"))


@cache
def _folds() -> tuple[dict[int, str], dict[int, str]]:
    """For words: letters to their shapes; then small letters to those their capitals look like."""
    of, _ = _shapes()
    first = {ord(c): p for c, p in of.items() if c != p}
    later = {}
    for letter, proto in chain.from_iterable(_TABLE.get(name, []) for name in ("Cyrillic", "Coptic", "Deseret", "Osage")):
        small = letter.casefold()
        if small != letter and of.get(small) != proto.casefold():
            later[ord(small)] = proto.casefold()
            first.pop(ord(small), None)
    return first, later


_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_ASCII_WORD = regex.compile(r"[a-z0-9]+")


_RUN = re.compile("[A-Za-z0-9\\x80-\U0010ffff]+")


def _run_words(run: str) -> list[str]:
    first, later = _folds()
    run = unicodedata.normalize("NFD", run.translate(_simple()))
    return _WORD.findall(unicodedata.normalize("NFD", run.translate(first).casefold()).translate(later))


_runs = _Recalled(_run_words)


def words(text: str) -> list[str]:
    """Runs of letters (with accents) and digits, compared by look and without letter case.

    Cyrillic, Coptic, Deseret and Osage letters whose capitals have a Latin shape are folded with them in both cases, so that a word
    equals itself in capitals; characters without width vanish first, all else separates. ASCII characters
    other than letters and digits always separate, so runs between them are folded one by one.
    """
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    out: list[str] = []
    for line in text.split("\n"):
        if line.isascii():
            out += _ASCII_WORD.findall(line.lower())
            continue
        for run in _RUN.findall(line):
            if run.isascii():
                out.append(run.lower())
            else:
                out += _runs[run]
    return out
