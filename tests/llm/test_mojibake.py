import pytest

from scriptorium.llm import mojibake as M

TEXT = "Le vieux berger a béni l’huile – “la récolte” à Séhar. Großer Töpfer, coração, señal."
RUSSIAN = "Старый пастух искал новую песню для лампы, и пророк хранил масло без страха."
GREEK = "Ο προφήτης θυμήθηκε τον λόγο με υπομονή κοντά στη γέφυρα."


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", [TEXT, RUSSIAN, GREEK])
def test_round_trip(text, wrong):
    fixed, places, lost = M.restore("Plain ü first. " + M.read_as(text.encode(), wrong))
    assert fixed == "Plain ü first. " + text and places > 0 and lost == 0


def test_twice_and_references():
    twice = M.read_as(M.read_as(TEXT.encode(), "cp1252").encode(), "cp1252")
    assert M.restore(twice)[0] == TEXT
    assert M.restore("lecteur-priv&#195;&#169;")[0] == "lecteur-privé"
    assert M.restore("L\x92huile")[0] == "L’huile"


@pytest.mark.parametrize("wrong, right, text", [("cp1252", "cp1251", RUSSIAN), ("cp1252", "cp1253", GREEK), ("cp1251", "koi8-r", RUSSIAN)])
def test_one_byte_encodings_are_found(wrong, right, text):
    garbled = text.encode(right).decode(wrong, "replace")
    assert M.restore(garbled)[1] > 0


def test_latin_read_as_cyrillic():
    assert M.restore("leitor-de-pбgina")[0] == "leitor-de-página"


@pytest.mark.parametrize("text", [TEXT, RUSSIAN, GREEK, None, "", "plain", "MANHÃ DE ORAÇÃO, IRMÃ E IRMÃO JUNTOS.", "“MANHÔ", "the letters thorn (Þ), eth (Ð, ð)", "25°C ± 2 – ½ © § €", "В 1990 году… «СССР»", "ДЕНЬ ПОБЕДЫ", "नगर का राजा।", "第七年。", "AT&amp;T &#8217;"])
def test_correct_text_stays(text):
    assert M.restore(text) == (text, 0, 0)


def test_lost_characters_are_counted():
    assert M.restore("S�gelys�mini")[1:] == (2, 2)


def test_table(spark):
    bad = M.read_as(TEXT.encode(), "cp1252")
    rows = [(1, bad, "x"), (1, bad, "x"), (2, TEXT, bad), (3, None, None), (None, bad, ""), (2**60 + 1, bad * 300, "ok")]
    df = spark.createDataFrame(rows, "k long, text string, field string")
    got = {(r["k"], r["field"]): r["restored"] for r in M.garbled_fields(df, "k", ["text", "field"]).collect()}
    assert got == {(1, "text"): TEXT, (2, "field"): TEXT, (None, "text"): TEXT, (2**60 + 1, "text"): TEXT * 300}
    assert M.garbled_fields(df.limit(0), "k", ["text"]).count() == 0


@pytest.mark.parametrize("text", ["第七年。羊飼い", "Việt Nữ", "ἀρχῇ ἦν", "בְּרֵאשִׁית", "한국어 말씀", "joy 😀 𝄞 𠀀"])
def test_all_blocks_once_and_twice(text):
    for wrong in M.TWICE[:-1]:
        once = M.read_as(text.encode(), wrong)
        assert M.restore(once)[::2] == (text, 0), wrong
        assert M.restore(M.read_as(once.encode(), wrong))[::2] == (text, 0), wrong
    assert M.restore(text) == (text, 0, 0)


@pytest.mark.parametrize("wrong, text", [("cp850", "le café noir"), ("cp437", "le café noir"), ("mac_roman", "le café noir"), ("cp850", "coração"), ("mac_roman", "mañana")])
def test_western_one_byte_pairs(wrong, text):
    assert M.restore(text.encode("cp1252").decode(wrong))[0] == text


def test_windows_cyrillic_read_as_koi8():
    assert M.restore(RUSSIAN.encode("cp1251").decode("koi8-r"))[0] == RUSSIAN


@pytest.mark.parametrize("text", ["verse² and page³", "große Straße", "Þórr and Óðinn", "10 kΩ, 5±2", "naïve façade", "IRMÃO d’Été", "πίστις"])
def test_correct_western_words_stay(text):
    assert M.restore(text) == (text, 0, 0)


TWO = {"gbk": "耶和华是我的牧者，我必不至缺乏。他使我躺卧在青草地上。", "big5": "耶和華是我的牧者，我必不至缺乏。他使我躺臥在青草地上", "cp932": "主は羊飼い、私は乏しいことがない。カタカナ", "euc_jp": "主は羊飼い、私は乏しいことがない。カタカナ", "cp949": "여호와는 나의 목자시니 내게 부족함이 없으리로다"}


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
@pytest.mark.parametrize("right", TWO)
def test_two_byte_text_read_as_western(right, wrong):
    mixed = "Plain ü first. " + M.read_as(TWO[right].encode(right), wrong) + " end."
    assert M.restore(mixed)[::2] == ("Plain ü first. " + TWO[right] + " end.", 0)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
@pytest.mark.parametrize("right, text", [("cp1255", "יהוה רועי לא אחסר בנאות דשא"), ("cp1256", "الرب راعي فلا يعوزني شيء في مراع خضر")])
def test_right_to_left_text_read_as_western(right, text, wrong):
    assert M.restore(M.read_as(text.encode(right), wrong))[::2] == (text, 0)


@pytest.mark.parametrize("wrong", ["gbk", "cp932", "cp949", "big5", "euc_jp"])
def test_utf8_read_as_two_byte_text(wrong):
    """What has a form comes back; what the wrong encoding dropped is counted as lost."""
    for text in ("耶和华是我的牧者", "主は羊飼い", "Großer Töpfer"):
        garbled = text.encode().decode(wrong, "replace")
        fixed, places, lost = M.restore(garbled)
        assert places > 0 or wrong in ("cp932", "big5", "euc_jp")
        assert lost > 0 or fixed == text or "\ufffd" not in garbled
    assert M.restore("Gro脽er")[0] == "Großer" and M.restore("鑰跺拰")[0] == "耶和"


def test_runs_that_cannot_be_told_stay():
    one = M.read_as("的一是不了在人有".encode("gbk"), "cp1252")
    fixed, places, lost = M.restore(one + " and " + "ÿÿþþÿþÿþ")
    assert fixed.startswith("的一是不了在人有") and fixed.endswith("ÿÿþþÿþÿþ") and places >= 1


@pytest.mark.parametrize("text", [*TWO.values(), "יהוה רועי לא אחסר", "الرب راعي", "“«œuvre»” – ÇÀ ET LÀ…", "第3章：約翰福音", "日本語Latin混ぜ", "Ελληνικά καὶ Русский текст"])
def test_correct_wide_text_stays(text):
    assert M.restore(text) == (text, 0, 0)
