"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser
evaluates the licence expression behind a tag.

Texts are cut into words (A-Z lower-cased, ASCII other than letters and digits divides). One
automaton over the words, joined by single spaces, finds every place of every phrase, also of
phrases that overlap or hold one another. Where the words of an identifier tag were found, the
expression after the tag is read from the text itself.

Expressions: identifiers joined by ``with``, ``and`` and ``or``, which bind in this order, and
parentheses. The longest valid beginning of the line counts; a tag without one is ignored. An
expression is accepted if its identifiers are (``or``: one side, ``and``: both sides, ``with``:
the exception makes a licence accepted if it is listed). The identifiers that apply are those of
both sides, but of one side of an ``or`` if only that one is accepted: ``mit or gpl-2.0`` leaves
mit, ``mit and gpl-2.0`` both, and is not accepted.

A text is accepted if all its expressions are; without expressions that is null. score: how sure
it is that the text is licensed, and on accepted terms: 1 - 0.4^phrases * 0.1^tags with accepted
expressions * 0.7^other such tags, over all places. It is 0 where nothing was found.

Defined results: null is the empty text; a text without words has no places; repeated rows are
scanned one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import map_texts

#: Phrases that are always looked for, and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The method's own phrases.
NOTICE_PHRASES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "proprietary"),
)
#: The words of an identifier tag.
TAG = "spdx license identifier"
#: Accepted identifiers, and exceptions that make any licence accepted.
ACCEPTED = frozenset("mit isc zlib 0bsd bsd-2-clause bsd-3-clause apache-2.0 bsl-1.0 unlicense cc0-1.0 cc-by-3.0 cc-by-4.0".split())
ACCEPTED_EXCEPTIONS = frozenset("classpath-exception-2.0 llvm-exception gcc-exception-3.1".split())

_TAG_TEXT = re.compile(r"spdx[^0-9a-z\n]+license[^0-9a-z\n]+identifier[\t ]*:[\t ]*([^\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[\t ]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)", re.A)
_BINDS = {"or": 1, "and": 2, "with": 3}

#: Of each byte: itself if it belongs to a word, A-Z in lower case, else a space.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")


def parse_expression(line: str) -> tuple[list, str] | None:
    """The longest valid beginning of ``line`` in postfix order, and its text; None if there is none.

    One pass finds where it ends: the last place at which no operand is due and no parenthesis open
    before the first token that no expression can go on with."""
    tokens: list[str] = []
    at, depth, operand_next, whole, end = 0, 0, True, 0, 0
    while m := _TOKEN.match(line, at):
        token, at = m[1].lower(), m.end()
        opens, closes = token == "(", token == ")"
        if operand_next != (token not in _BINDS and not closes) or (closes and not depth):
            break
        depth += opens - closes
        operand_next = token in _BINDS or opens
        tokens.append(token)
        if not operand_next and not depth:
            whole, end = len(tokens), at
    return (_postfix(tokens[:whole]), line[:end].strip()) if whole else None


def _postfix(tokens: list[str]) -> list[str]:
    """A valid expression in postfix order."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while (last := waiting.pop()) != "(":
                out.append(last)
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(postfix: list[str], accepted: frozenset[str] = ACCEPTED, exceptions: frozenset[str] = ACCEPTED_EXCEPTIONS) -> tuple[set[str], bool]:
    """The identifiers that apply, and whether the expression is accepted."""
    # names are added from the smaller set to the larger one, so a long expression costs little more than its length
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(({token}, token in accepted, token))
            continue
        (right, right_ok, exception), (left, left_ok, _) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_ok or exception in exceptions, ""))
        elif token == "or" and left_ok != right_ok:
            stack.append((left if left_ok else right, True, ""))
        else:
            small, large = sorted((left, right), key=len)
            large |= small
            stack.append((large, left_ok and right_ok if token == "and" else left_ok, ""))
    (names, ok, _), = stack
    return names, ok


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    wanted: dict[str, set[str]] = {}
    for phrase, label in phrases:
        wanted.setdefault(phrase, set()).add(label)
    wanted[TAG] = {""}
    for phrase, labels in wanted.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, phrase, tuple(sorted(labels))))
    found.make_automaton()
    return found


def scan(text: str | None, phrases: tuple[tuple[str, str], ...]) -> tuple[int, list[dict], list[dict], float]:
    """Number of words, places of phrases, tags with their expressions, and the score."""
    words = [w for w in words_of(text or "") if w]
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    places, tagged, word, at = [], False, 0, 1
    for end, (back, phrase, labels) in _automaton(phrases).iter(joined):
        start = end - back + 1
        # ends rise, starts may step back a little, so words are counted from the last place on
        word = word + joined.count(" ", at, start) if start >= at else word - joined.count(" ", start, at)
        at = start
        tagged |= phrase == TAG
        places.extend({"word": word, "phrase": phrase, "label": label} for label in labels if label)
    tags = []
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            if parsed := parse_expression(m[1]):
                names, ok = evaluate(parsed[0])
                tags.append({"start": m.start(), "expression": parsed[1], "identifiers": sorted(names), "accepted": ok})
    places.sort(key=lambda p: (p["word"], p["phrase"], p["label"]))
    good = sum(t["accepted"] for t in tags)
    return len(words), places, tags, 1 - 0.4 ** len(places) * 0.1**good * 0.7 ** (len(tags) - good)


PLACE = T.StructType([T.StructField("word", T.LongType()), T.StructField("phrase", T.StringType()), T.StructField("label", T.StringType())])
TAGGED = T.StructType([T.StructField("start", T.LongType()), T.StructField("expression", T.StringType()), T.StructField("identifiers", T.ArrayType(T.StringType())), T.StructField("accepted", T.BooleanType())])


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = BASE_PHRASES + NOTICE_PHRASES) -> DataFrame:
    """``id_col, n_words, places, tags, score`` of every row.

    places: array of (word, phrase, label), by word (from 0); tags: array of (start, expression,
    identifiers, accepted): start in code points, and those identifiers that apply.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("tags", T.ArrayType(TAGGED)), T.StructField("score", T.DoubleType())]

    def run(texts: list) -> dict:
        n, places, tags, score = zip(*(scan(t, phrases) for t in texts), strict=True)
        return {"n_words": list(n), "places": list(places), "tags": list(tags), "score": list(score)}

    return map_texts(docs, run, fields, id_col=id_col, text_col=text_col)
