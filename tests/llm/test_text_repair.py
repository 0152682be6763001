from __future__ import annotations

import unicodedata

import pytest

from radweave.llm import canonical, encoding

PROPER = [
    "Relative’s words: àyà ń dùn mí fún ọjọ́ 3, ìkọ́ kò dúró.", "ÂGE 32, CÔTÉ 4776, NÃO MOLHAR; film re-scanned", "Note: « fièvre et râles crépitants à droite », âge 59 ans", "unit reads «ВДОХ» at 24°, α1 carrier",
    "naïve film, 37° tilt ± 4 mm, 2 × 3 cm ≥ 5", "RELATIVE’S WORDS: ÀYÀ Ń DÙN MÍ FÚN ỌJỌ́", "Zoëlle Åkerstrand, Pélissade, Ọlátúnbọ̀", "“tent-shaped” – clear", "l​obe and ﬁne ｄｅｎｓｅ", "сlear lung", "país, não, coração",
]


@pytest.mark.parametrize("text", [*PROPER, None, "", "plain ascii"])
def test_proper_text_is_left_alone(text):
    assert encoding.inspect(text) == (False, False, text)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", ["depuis 2 jours, fièvre légère et râles", "Relative’s earlier film – “oval”", "ÂGE 32, CÔTÉ 4776", "mí fún ọjọ́ 3", "37° tilt ± 4 mm"])
def test_misread_utf8_round_trip(text, codec):
    bad = "".join(bytes([b]).decode(codec) if _known(b, codec) else chr(b) for b in text.encode("utf-8"))
    damaged, whole, back = encoding.inspect(bad)
    assert damaged and whole and back == text


def _known(b, codec):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


def test_twice_and_partly():
    twice = "fièvre".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.inspect(f"une {twice}, âge 3")[2] == "une fièvre, âge 3"
    assert encoding.inspect("contrÙle aprËs 3 jours")[2] == "contrôle après 3 jours"
    assert encoding.inspect("r�sum�") == (True, False, "r�sum�")
    assert encoding.inspect("r&eacute;sum&#233; \\u00e9")[2] == "résumé é"
    assert encoding.inspect("The readerís mark isnít here")[2] == "The reader’s mark isn’t here"


def test_escapes_behind_escapes():
    assert encoding.inspect("caf&amp;eacute;") == (True, True, "café")
    assert encoding.inspect("r&amp;amp;#233;sum\\u0026eacute;") == (True, True, "résumé")
    assert encoding.inspect("&amp;#195;&amp;copy;t&amp;eacute;")[2] == "été"
    assert encoding.inspect("A &amp;amp; B") == (False, False, "A &amp;amp; B")


def test_other_scripts_come_back_or_are_left_alone():
    assert encoding.inspect("è´¨") == (True, True, "质")
    assert encoding.inspect("日本 æ—¥æœ¬") == (True, True, "日本 日本")
    assert encoding.inspect("Ñîáàêà") == (True, True, "Собака")
    assert encoding.inspect("&amp;eacute;t&amp;eacute;") == (True, True, "été")
    assert encoding.inspect("日本語 и кириллица, καρδιά, créée") == (False, False, "日本語 и кириллица, καρδιά, créée")
    assert encoding.inspect("fish &amp; chips, 100%25 off") == (False, False, "fish &amp; chips, 100%25 off")


@pytest.mark.parametrize(("read_as", "written"), [("mac_roman", "cp1252")])
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman", "cp437"])
def test_swaps_after_utf8_steps(read_as, written, codec):
    for word in ("fièvre légère", "après contrôle"):
        swapped = word.encode(written).decode(read_as)
        assert encoding.inspect(swapped.encode("utf-8").decode(codec)) == (True, True, word)
    lookalikes = "the pleural аnglеs, heart size liеs, seνré"  # Cyrillic and Greek letters stay what they were
    assert encoding.inspect(f"{lookalikes}, évolutive".encode().decode("cp1252"))[2] == f"{lookalikes}, évolutive"


def test_batches(spark):
    df = spark.createDataFrame([(1, "fiÃ¨vre"), (2, None), (3, "ok"), (4, "fiÃ¨vre"), (5, "x" * 100_000 + " Ã©tÃ©")], "id long, text string")
    df = df.selectExpr("1 AS kinds", "2 AS restored", "id", "text")
    got = {r.id: r for r in encoding.repaired(df).collect()}
    assert set(got) == {1, 4, 5} and got[1].original == "fièvre" and got[5].original.endswith(" été")
    assert encoding.repaired(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "ﬁne"), (1, "ﬁne"), (2, None), (None, "a\xa0b"), (3, "fiÃ¨vre\xa0")], "id long, text string").selectExpr("1 AS kinds", "id", "text")
    assert sorted((r.id or 0, r.canonical) for r in canonical.deviating(odd, skip_damaged=True).collect()) == [(0, "a b"), (1, "fine"), (1, "fine")]
    assert canonical.deviating(odd).count() == 4 and canonical.deviating(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want", "kinds"),
    [
        ("ｄｅｎｓｅ　ｚｏｎｅ", "dense zone", {"compatibility", "blank"}), ("ﬁne ﬂuid", "fine fluid", {"compatibility"}), ("café", "café", {"decomposed"}), ("ọ̀", "ọ̀", {"decomposed"}),
        ("lo​be ﻿x\xady", "lobe xy", {"invisible"}), ("a\xa0b c", "a b c", {"blank"}), ("nоrmal ѕize", "normal size", {"mixed_script"}), ("Ηeart", "Heart", {"mixed_script"}), ("n​о", "no", {"invisible", "mixed_script"}),
    ],
)
def test_deviations(text, want, kinds):
    assert canonical.canonical(text) == (want, kinds)


def test_maybe_characters_compose_with_what_stands_before():
    assert canonical.canonical("\u1112\u1161\u11ab\u1100\u1173\u11af") == ("한글", {"decomposed"})
    assert canonical.canonical("\ud558\u11ab") == ("한", {"decomposed"})
    assert canonical.canonical("\u0b95\u0bc6\u0bbe") == ("\u0b95\u0bca", {"decomposed"})
    assert canonical.canonical("தமிழ், 한글, \u0bbe") == ("தமிழ், 한글, \u0bbe", frozenset())


@pytest.mark.parametrize("text", ["Yılmaz", "kızıl ışık", "ɡene ɑlpha"])
def test_latin_letters_are_no_look_alikes(text):
    assert canonical.canonical(text) == (text, frozenset())


@pytest.mark.parametrize("text", [None, "", "plain", "“typographic” – ’quotes’", "2 × 3 cm, 37° ± 4 ≥ 5 µm²", "ọjọ́ àyà ń", "«ВДОХ» α1", "α β", "tab\tand\r\nends"])
def test_consistent_text_is_left_alone(text):
    assert canonical.canonical(text) == (text, frozenset())


def test_idempotent_and_equal_to_full_normalisation():
    for text in ["éậ", "x̣́y", "ﬃ ⅷ ｶﾞ", "각", "Å ℌ"]:
        once, _ = canonical.canonical(text)
        assert canonical.canonical(once)[0] == once and unicodedata.is_normalized("NFC", once)
