"""Complaint text cleaning as column expressions: no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters (tab to carriage return, the four separators, space
# and the Unicode spaces) as the body of a character class; needs the (?U) flag.
WHITESPACE = r"\s\x1c-\x1f"

# The white space a browser trims from an input field.
BROWSER_WHITESPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# The usual English stop-word list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Contractions that follow no suffix rule.
IRREGULAR_CONTRACTIONS = {
    "ain't": "are not",
    "can't": "cannot",
    "won't": "will not",
    "shan't": "shall not",
    "let's": "let us",
    "y'all": "you all",
    "o'clock": "of the clock",
    "ma'am": "madam",
}

# Informal forms, written without an apostrophe.
INFORMAL_CONTRACTIONS = {
    "gonna": "going to",
    "wanna": "want to",
    "gotta": "got to",
    "kinda": "kind of",
    "sorta": "sort of",
    "outta": "out of",
    "lemme": "let me",
    "gimme": "give me",
    "dunno": "do not know",
}

# Suffix rules, tried in this order; the group keeps the word before the suffix.
SUFFIX_CONTRACTIONS = {
    r"([a-zA-Z])n't": "$1 not",
    r"([a-zA-Z])'re": "$1 are",
    r"([a-zA-Z])'ve": "$1 have",
    r"([a-zA-Z])'ll": "$1 will",
    r"(?<![a-zA-Z0-9_])(how|where|why|what|who|when)'d": "$1 did",
    r"([a-zA-Z])'d": "$1 would",
    r"(?<![a-zA-Z0-9_])(i)'m": "$1 am",
    r"(?<![a-zA-Z0-9_])(he|she|it|that|there|here|what|who|where|when|why|how)'s": "$1 is",
}


def contraction_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) pairs; a rule ends at the end of a word."""
    words = [(f"(?<![a-zA-Z0-9_]){word}", long) for word, long in IRREGULAR_CONTRACTIONS.items()]
    return [(f"(?i){rule}(?![a-zA-Z0-9_])", long) for rule, long in words + list(SUFFIX_CONTRACTIONS.items())]


def contraction_keys(words: Iterable[str], table: Mapping[str, str] | None = None) -> set[str]:
    """Those of ``words`` that a rule, the informal forms or ``table`` would expand."""
    known = set(INFORMAL_CONTRACTIONS) | {key.lower() for key in table or ()}
    rules = [re.compile(pattern) for pattern, _ in contraction_rules()]
    plain = {word: word.lower().replace("’", "'") for word in words}
    return {word for word, form in plain.items() if form in known or any(rule.search(form) for rule in rules)}


def effective_stop_words(words: Iterable[str] = STOP_WORDS, table: Mapping[str, str] | None = None) -> list[str]:
    """Stop words without those that expansion knows, so that "don't" survives to be expanded."""
    words = list(words)
    expanded = contraction_keys(words, table)
    return [word for word in words if word not in expanded]


def remove_stopwords(text: Column, words: Iterable[str]) -> Column:
    """Drop stop words; words are cut at single spaces and empty pieces are kept."""
    stop = [word.lower() for word in words]
    if not stop:
        return text
    return F.array_join(F.filter(F.split(text, " ", -1), lambda w: ~F.lower(w).isin(stop)), " ")


def collapse_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"(?U)[{WHITESPACE}]+", " "))


def has_apostrophe(text: Column) -> Column:
    return text.contains("'") | text.contains("’")


def _expand_word(word: Column) -> Column:
    expanded = F.replace(word, F.lit("’"), F.lit("'"))
    for pattern, replacement in contraction_rules():
        expanded = F.regexp_replace(expanded, pattern, replacement)
    return F.when(has_apostrophe(word), expanded).otherwise(word)


def _map_words(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, " "), change), " ")


def expand_contractions(text: Column, table: Mapping[str, str] | None = None, needed: Column | None = None) -> Column:
    """Expand contractions by rule, then informal forms and the words of ``table``; white space collapses.

    Text that does not need the rules skips them; ``needed`` says so where it is cheaper to
    tell from another column than from ``text``.
    """
    words = collapse_whitespace(text)
    words = F.when(has_apostrophe(text) if needed is None else needed, _map_words(words, _expand_word)).otherwise(words)
    whole = {**INFORMAL_CONTRACTIONS, **{key.lower(): long for key, long in (table or {}).items()}}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(whole.items())])
    return _map_words(words, lambda w: F.when(F.lower(w).isin(list(whole)), F.try_element_at(lookup, F.lower(w))).otherwise(w))


def _keep(text: Column, runs: str) -> Column:
    # Collecting the runs that stay costs far less than replacing each run that goes.
    return F.array_join(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), "")


def remove_special_characters(text: Column) -> Column:
    """Keep ASCII letters, digits and white space; accented letters go too."""
    return _keep(text, f"(?U)[a-zA-Z0-9{WHITESPACE}]+")


def preprocess(text: Column, stop_words: Iterable[str] | None = None, table: Mapping[str, str] | None = None) -> Column:
    """Clean a complaint; ``text`` should be a plain column, as it is read more than once.

    Words that expansion knows are never dropped as stop words, whichever list is passed.
    """
    kept = remove_stopwords(text, effective_stop_words(STOP_WORDS if stop_words is None else stop_words, table))
    # Only plain spaces are left to keep at this point.
    return _keep(expand_contractions(kept, table, has_apostrophe(text)), "[a-zA-Z0-9 ]+")


def estimate_tokens(text: Column) -> Column:
    """Four code points to a token, rounded down."""
    return F.shiftright(F.length(text), 2)


def is_nonblank(text: Column) -> Column:
    return text.rlike(f"[^{BROWSER_WHITESPACE}]")


def escape_html(text: Column) -> Column:
    for char, entity in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
