import pytest
from pyspark.sql import functions as F

from redressa.functions import text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "before, after",
    [
        ("the cat and THE dog", "cat dog"),
        ("the, cat", "the, cat"),
        ("a  b", " b"),
        ("I don't know", "don't know"),
        ("not here\nthe", "here\nthe"),
        ("", ""),
    ],
)
def test_remove_stopwords_splits_at_single_spaces(spark, before, after):
    words = text.effective_stop_words()
    if before == "not here\nthe":
        after = "here\nthe"  # the line break keeps "here\nthe" one word
    assert one(spark, before, lambda x: text.remove_stopwords(x, words)) == after


@pytest.mark.parametrize(
    "before, after",
    [
        ("I don't", "I do not"),
        ("don’t stop", "do not stop"),
        ("can't can't", "cannot cannot"),
        ("won't, we're (they've)", "will not, we are (they have)"),
        ("It's Tom's", "It is Tom's"),
        ("I'm sure he'd say who'd", "I am sure he would say who did"),
        ("  two\t\n words ", "two words"),
        ("ain't y'all", "are not you all"),
        ("", ""),
    ],
)
def test_expand_contractions(spark, before, after):
    assert one(spark, before, text.expand_contractions) == after


def test_expansion_table_is_case_blind_and_whole_word(spark):
    assert one(spark, "LES leste", lambda x: text.expand_contractions(x, {"les": "toutes les"})) == "toutes les leste"


def test_remove_special_keeps_white_space_and_drops_accents(spark):
    assert one(spark, "Café—a_b c\x1cd!\n9", text.remove_special_characters) == "Cafab c\x1cd\n9"


def test_preprocess_order(spark):
    # Stop words go first, so the "not" of an expansion stays.
    assert one(spark, "I don't like the  (new) app", text.preprocess) == "do not like new app"


def test_preprocess_is_the_three_steps(spark):
    rows = [(t,) for t in ["it’s the end", " é a  b ", "x y\x1fz", "don't do not", "It's a 'test' of the app's UI"]]
    frame = spark.createDataFrame(rows, "x string")
    words = text.effective_stop_words()
    steps = text.remove_special_characters(text.expand_contractions(text.remove_stopwords(F.col("x"), words)))
    assert frame.filter(text.preprocess(F.col("x")) != steps).count() == 0


def test_contractions_are_no_stop_words():
    words = text.effective_stop_words()
    assert "don't" not in words and "not" in words and len(words) < len(text.STOP_WORDS)


def test_words_that_expansion_knows_are_kept():
    """Expected by hand."""
    assert text.effective_stop_words(["don't", "stop", "Gonna", "it"], {"IT": "that thing"}) == ["stop"]
    assert text.effective_stop_words(["'tis", "it", "you’re"]) == ["'tis", "it"]


def test_a_table_entry_wins_over_the_stop_word(spark):
    clean = lambda x: text.preprocess(x, table={"it": "that thing"})
    assert one(spark, "fix it please, gonna kinda wanna go", clean) == "fix that thing please going to kind of want to go"
    assert one(spark, "don't stop", lambda x: text.preprocess(x, ["don't", "stop"])) == "do not"


@pytest.mark.parametrize("value, tokens", [("", 0), ("abc", 0), ("abcd", 1), ("ééééé", 1), ("12345678", 2)])
def test_estimate_tokens(spark, value, tokens):
    assert one(spark, value, text.estimate_tokens) == tokens


@pytest.mark.parametrize("value, kept", [(" \t ﻿", False), ("", False), (" x ", True), ("\x85", True)])
def test_blank_is_what_a_browser_trims(spark, value, kept):
    assert one(spark, value, text.is_nonblank) is kept


def test_escape_html(spark):
    assert one(spark, "<a href='x'>&\"", text.escape_html) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
