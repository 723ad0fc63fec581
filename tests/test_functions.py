"""Text functions, one by one, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx


def value(spark, text, function):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Ho 3.5 kg. Va bene.", ["Ho 3.5 kg.", "Va bene."]),
        ("Mele, pere ecc. e uva. Fine", ["Mele, pere ecc. e uva.", "Fine"]),
        ("Il dott. Rossi (ing. Verdi) viene!", ["Il dott. Rossi (ing. Verdi) viene!"]),
        ("Davvero?! Si: certo; forse", ["Davvero?!", "Si:", "certo;", "forse"]),
        ("alle 10:30 parto", ["alle 10:", "30 parto"]),
        ("fine?: poi", ["fine?:", "poi"]),
        ("fine.; poi", ["fine.", ";", "poi"]),
        ("ECC. resta", ["ECC. resta"]),
        ("", []),
        (" . ", ["."]),
        ("tecc. no", ["tecc.", "no"]),
    ],
)
def test_sentences(spark, text, expected):
    assert value(spark, text, tx.sentences) == expected


def test_message_text(spark):
    assert value(spark, "  ciao \n\n[immagine: gatto]\n[audio]\nfine\r\n[x: y", tx.message_text) == "ciao [audio] fine [x: y"
    assert value(spark, None, tx.message_text) == ""


def test_forms(spark):
    assert value(spark, "L'ho  FATTO, già!", tx.match_form) == "l'ho fatto già"
    assert value(spark, " L'ho  FATTO, già!", tx.quote_form) == "lho fatto già"
    assert value(spark, "Perché il the_x di Città", tx.keywords) == ["perché", "the_x", "città"]


@pytest.mark.parametrize(
    ("generated", "source", "expected"),
    [("48,5", "48.5", []), ("48.5", "48,5", []), ("007", "7", []), ("49", "48", ["49"]), ("due 3", "2 3", []), ("5 5 05", "4", ["5", "05"]), ("1.250,50", "1.250 50", []), ("0", "00", []), ("", "1", [])],
)
def test_unknown_numbers(spark, generated, source, expected):
    got = spark.createDataFrame([(generated, source)], "g string, s string").select(tx.unknown_numbers(F.col("g"), F.col("s")).alias("v")).first().v
    assert got == expected


@pytest.mark.parametrize(("text", "expected"), [("il gatto e la casa", "italiano"), ("the cat and the dog", "inglese"), ("il the a", "misto/indeterminato"), ("", "misto/indeterminato"), ("a in the the the", "inglese"), ("a in a in the", "misto/indeterminato")])
def test_function_word_language(spark, text, expected):
    assert value(spark, text, tx.function_word_language) == expected


@pytest.mark.parametrize(
    ("line", "nav"),
    [("[Sport](/s) [Calcio](/c)", True), ("[a](b) | • [c](d)", True), ("leggi [questo](u) ora", False), ("%cfw-date%", True), ("[svolta [x] su](u)", True), ("![alt](i.png)", True), ("", True), ("é", False)],
)
def test_link_lines(spark, line, nav):
    assert value(spark, line, tx.is_link_line) == nav


def test_plain_text(spark):
    text = "# Titolo\n[a](b)\n\nleggi **[questo [x]](u)** &amp; `codice` ![alt](i)\n%z%"
    assert value(spark, text, tx.plain_text) == "Titolo\nleggi questo [x] & codice"
    assert value(spark, text, tx.without_navigation) == "# Titolo\nleggi **[questo [x]](u)** &amp; `codice` ![alt](i)"


def test_names(spark):
    assert value(spark, "Città à la Ünder_1.pdf", tx.slug) == "citta-a-la-under-1-pdf"
    assert value(spark, "日本", tx.slug) == "documento"
    assert value(spark, "my-long_name", tx.label_form) == "My Long Name" and value(spark, "DSML", tx.label_form) == "DSML"
    assert value(spark, "a/b [c] #d|e", tx.title_form) == "a b c d e"


def test_cuts(spark):
    long = "parola " * 200
    got = value(spark, long, tx.excerpt)
    assert got.endswith("parola…") and len(got) <= 601
    assert value(spark, "a ```x``` <!-- y --> b", tx.excerpt) == "a b"
    assert value(spark, "x" * 9001, lambda c: F.transform(tx.parts(c), lambda p: F.length(p))) == [4000, 4000, 1001]
    assert value(spark, "", lambda c: F.size(tx.parts(c))) == 1
    assert value(spark, ("r" * 99 + "\n") * 20, tx.line_cut).endswith("r\n[...]")
    assert value(spark, "<think>x</think> y", tx.without_thinking) == "y" and value(spark, "<think>x", tx.without_thinking) == "" and value(spark, " z ", tx.without_thinking) == "z"


def test_small_ones(spark):
    seconds = spark.createDataFrame([(s,) for s in (59.9, 60.0, 3599.0, 3600.0, 86400.0)], "s double").select(tx.duration(F.col("s")).alias("v"))
    assert [r.v for r in seconds.collect()] == ["59s", "1m", "59m", "1h", "1g"]
    assert spark.sql("SELECT date'2026-08-16' d").select(tx.italian_date(F.col("d")).alias("v")).first().v == "16 agosto 2026"
    assert value(spark, "il 3/4/2025", tx.has_date) and value(spark, "nel 1999", tx.has_date) and not value(spark, "12 345", tx.has_date)
    assert value(spark, "a1", tx.has_number) and not value(spark, "a", tx.has_number)
