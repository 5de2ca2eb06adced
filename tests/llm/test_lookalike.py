import pytest

from skerry.llm import lookalike as L

SCHEMA = "tbl string, record_id string, text string, n int, words string"


@pytest.mark.parametrize(
    "text, want",
    [
        ("ｆｕｌｌ ｗｉｄｔｈ １２，３", "full width 12,3"),
        ("𝐛𝐨𝐥𝐝 𝗌𝖺𝗇𝗌", "bold sans"),
        ("ﬁnal oﬃce", "final office"),
        ("café mañana", "café mañana"),
        ("zero​width so­ft ﻿mark ‏mark‎", "zerowidth soft mark mark"),
        ("no break thin　wide", "no break thin wide"),
        ("Ω Å K", "Ω Å K"),
        ("bell\x07 and\x00 null", "bell and null"),
    ],
)
def test_settled(text, want):
    got, n = L.settled(text)
    assert got == want and n > 0


@pytest.mark.parametrize("text", ["plain\tand\n lines", "“quotes” ‘and’ – dashes — …", "€ £ © ® ™ § ½ ² µ № ·", "Pélandre Sarraño Mälbrug Tjörvald", "шахта рынок 株式 β λ", "می‌خواهم", "👨‍👩‍👧 ❤️", ""])
def test_own_right_stays(text):
    assert L.settled(text) == (text, 0) and L.mixed_words(text) == []


def test_line_ends_are_one_form_uncounted():
    assert L.settled("a\r\nb\n") == ("a\nb\n", 0)


def test_mixed_words():
    assert L.mixed_words("obtαιn the β of шахта and pаyment") == ["obtαιn", "pаyment"]
    assert L.by_table("pаyment") == "payment" and L.by_table("ραуmеnt") == "payment"
    assert L.by_table("шахтa") == "шахта"


def test_trie_spells_by_vocabulary():
    t = L.Trie()
    for w, n in (("investment", 9), ("sun", 1), ("svn", 5), ("syn", 2), ("payment", 3)):
        t.add(w, n)
    assert t.spell("ιnνestment") == "investment"
    assert t.spell("sυn") == "svn"  # the commonest of the spellings that look the same
    assert t.spell("pay​mеnt") == "payment"
    assert t.spell("pаymant") is None and t.spell("pаymant", most=1) == "payment"
    assert t.spell("zzz") is None


def test_trie_with_costs_is_edit_distance():
    t = L.Trie()
    for w in ("cat", "cart", "dog"):
        t.add(w, 1)
    assert t.spell("caat", 1) == "cart" or t.spell("caat", 1) == "cat"
    assert t.spell("dg", 1) == "dog" and t.spell("dgo", 1) is None and t.spell("dgo", 2) == "dog"


def test_a_foreign_letter_without_likeness_stands_for_one_letter():
    t = L.Trie()
    for w, n in (("report", 5), ("resort", 9), ("retort", 2), ("names", 9)):
        t.add(w, n)
    assert t.spell("reжort", 1, L.foreign) == "resort"  # the commonest at the same cost
    assert t.spell("rеport", 1, L.foreign) == "report" and t.spell("nаme", 1, L.foreign) is None
    assert L.spelled("Reжort", t) == "Resort" and L.spelled("reжжort", t) is None
    assert L.key("reжort") in L.keys("report") and L.key("Reжort") in L.keys("resort") and L.key("nаme") == "name"


def test_foreign_letters_are_spelled_by_the_vocabulary(spark):
    data = [("chunks", "1", "harbour fees and harbour dues", 1, ""), ("chunks", "2", "The harbжur fees", 1, ""), ("chunks", "3", "Ꮲrepaid Ꮯosts", 1, ""), ("chunks", "4", "zzжzz unheard", 1, "")]
    got = {r["record_id"]: (r["text"], r["n_changed"]) for r in L.consistent(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["2"] == ("The harbour fees", 1) and got["3"] == ("Prepaid Costs", 2) and got["4"][1] == 1


def test_consistent(spark):
    data = [
        ("chunks", "1", "The payment of any investment is due.", 1, ""),
        ("chunks", "2", "The pаyment of any ιnνestment is duе.", 1, ""),
        ("chunks", "3", "ｔｈｅ café\r\n", 1, ""),
        ("chunks", "3", "ｔｈｅ café\r\n", 1, ""),
        ("chunks", "4", None, 1, ""),
        ("chunks", "5", "", 1, ""),
        ("eval_narrative", "6", "Investment in шахта at β of “1”?\r\n", 1, ""),
        ("eval_narrative", "7", "Ιnνestment IΝVESTMENT unknοwnwοrd", 1, ""),
        ("eval_narrative", None, "pаyment", 1, ""),
        ("chunks", "8", "pаyment " * 20_000, 1, ""),
    ]
    got = {(r["tbl"], r["record_id"]): (r["text"], r["n_changed"]) for r in L.consistent(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["chunks", "1"] == (data[0][2], 0) and got["chunks", "2"] == (data[0][2], 3)
    assert got["chunks", "3"][0] == "the café\n" and got["chunks", "3"][1] > 0
    assert got["chunks", "4"] == (None, 0) and got["chunks", "5"] == ("", 0)
    assert got["eval_narrative", "6"] == ("Investment in шахта at β of “1”?\n", 0)
    assert got["eval_narrative", "7"] == ("Investment INVESTMENT unknownword", 3)
    assert got["chunks", "8"] == ("payment " * 20_000, 1)
    assert len(got) == 9 and got["eval_narrative", None] == ("payment", 1)


def test_empty(spark):
    assert L.consistent(spark.createDataFrame([], SCHEMA)).count() == 0
