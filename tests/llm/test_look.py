import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.look import confusable, consistent_token, letter_shapes, resolved_scripts, same_look, words

SAME = [
    ("ＡＢＣ１２３（x）", "ABC123(x)"), ("ﾊﾞｸﾞ", "バグ"), ("été", "été"), ("ﬁle ﬂow oﬃce", "file flow office"), ("co­op​ ﻿x‍y⁠", "coop xy"),
    ("a b c　d", "a b c d"), ("рaypаl", "paypal"), ("сор", "cop"), ("СОР", "COP"), ("Kelvin", "Kelvin"), ("\U0001d41aℂ", "aC"), ("ɡɑp", "gap"), ("пpивeт", "привет"),
    ("Ноmе", "Home"), ("ν1", "v1"), ("օk", "ok"), ("Ⅻ", "XII"), ("ë", "ё"), ("へ", "ヘ"), ("й", "й"), ("x️", "x"), ("\u00b5s", "\u03bcs"), ("\u2f00", "\u4e00"),
    ("\ufefb", "\u0644\u0627"), ("\ufe91\ufe8e", "\u0628\u0627"), ("\uab83\uab93\uabaf", "wzc"), ("\u1d04o\u1d20er", "cover"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a\tb", "a b"), ("a\r\nb", "a\nb"), ("l", "1"), ("O", "0"), ("rn", "m"), ("a.", "a"), ("…", "..."), ("™", "TM"), ("x²", "x2"), ("½", "1⁄2"), ("к", "k"), ("н", "h"), ("а\nb", "а b"), ("a\x1b", "a"), ("’", "'"), ("–", "-"), ("m", "ｎ"), ("\u017f", "s"), ("\u03d1", "\u03b8"), ("\u24d0", "a")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert same_look(a) == same_look(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert same_look(a) != same_look(b)


def test_consistent_spelling_keeps_scripts():
    assert same_look("привет мир") == "привет мир" and same_look("пpивeт") == "привет"
    assert same_look("рaypal") == "paypal" and same_look("人口は二つ") == "人口は二つ" and same_look("ログ") == "ログ"
    assert consistent_token("") == "" and consistent_token("́") == "́"


ALPHABET = "ab AOeé́­‍　Ａａﬁν" + "асеһіјорԛѕѵԝхуАВСЕНІЈКМОРԚЅТΑΒΕΗΙΚ" + "привет日本二口ロ0-_\n\t"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=12))
def test_form_is_stable_and_ascii_is_fixed(t):
    form = same_look(t)
    assert same_look(form) == form and unicodedata.is_normalized("NFC", form)
    if t.isascii():
        assert form == t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde ехорс\n", max_size=12), st.randoms(use_true_random=False))
def test_any_disguise_is_undone(t, rnd):
    swaps = {"a": "аａɑ", "c": "сｃ", "e": "еｅ", "o": "оοօ", "p": "рρ", "x": "х", " ": "  ", "е": "eｅ", "х": "xｘ", "о": "oο", "р": "pρ", "с": "c"}
    random.seed(rnd.random())
    disguised = "".join(random.choice([c, *swaps.get(c, c)]) + random.choice(["", "", "​", "­"]) for c in t)
    assert same_look(disguised) == same_look(t)


def test_words():
    assert words("foo_bar-Baz9 ＱＵＸ") == ["foo", "bar", "baz9", "qux"] and words("so­ft ST​OP") == ["soft", "stop"]
    assert words("Нет ВОР") == words("нет вор") and words("Straße") == words("STRASSE") and words("ét") == words("ÉT") != words("et")
    assert words("Νοte") == ["note"] == words("NOTE") and words("νan") == ["van"] and words("") == words("​…") == []


@pytest.mark.parametrize("a,b", [("\ua4ee\ua4f3", "AO"), ("\u2ca2\u2c9e\u2ca4", "POC"), ("\u2ca3\u2c9f\u2ca5", "poc"), ("аррӏе", "apple"), ("h\u2c9fme", "home"), ("\u15ea\u15f7", "DB"), ("\u2d54K", "OK"), ("\U00010282\U00010292", "BO"), ("\U00010404\U00010415", "OC"), ("\U00010516K", "OK")])
def test_letters_of_more_scripts(a, b):
    assert same_look(a) == b == same_look(b)
    if "ӏ" not in a:
        assert words(a) == words(b)


def test_words_of_more_scripts_stay_their_own():
    for text in ("\u2c89\u2c9f\u2ca9\u2c9f", "\ua4e4\ua4f3\ua4db", "\u1403\u14c4\u1483\u144e\u142f", "\u2d30\u2d54\u2d30", "кхъӏэ"):
        assert same_look(text) == text
    for word in ("\u2c8e\u2c9e\u2cb6", "ӀӘ", "\U00010404\U00010400"):
        assert words(word) == words(word.lower())


def test_shapes_come_from_the_confusables(spark):
    table = letter_shapes(spark)
    assert {"Cyrillic", "Greek", "Cherokee", "Lisu", "Coptic", "Canadian_Aboriginal"} <= table.keys() and sum(map(len, table.values())) > 200
    assert ("а", "a") in table["Cyrillic"] and ("І", "I") in table["Cyrillic"] and not any(c == "α" for c, _ in table["Greek"])


@pytest.mark.parametrize("token,kind", [("pаypal", "mixed"), ("сор", "whole"), ("hello", None), ("привет", None), ("яblok", "mixed_only"), ("カタひら漢字", None), ("한글漢字", None), ("กا", "mixed_only"), ("ー", None), ("1", None), ("ΑΒΕ", "whole"), ("ꓮꓳ", "whole"), ("éa", None)])
def test_mixed_and_whole_script_confusables(token, kind):
    assert confusable(token) == kind


def test_resolved_scripts():
    assert resolved_scripts("漢字かな") == {"Japanese"} and resolved_scripts("漢한") == {"Korean"} and resolved_scripts("กا") == frozenset() and resolved_scripts("--") is None
