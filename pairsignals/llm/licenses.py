"""License scans.

Two Aho-Corasick automata run over each whole text. One finds notice phrases,
word by word, in the text's lower-cased words; the other finds identifier tags
(``SPDX-License-Identifier:``). The expression behind a tag is read by a
shunting-yard parser, which handles ``AND``, ``OR``, ``WITH`` and parentheses,
and is evaluated to the licences named in it and to whether one can choose
licences that are all permissive.

A NULL or empty text has no words and no licences. Each row is scanned by
itself, so repeated rows each give a result. A phrase counts at every word at
which it starts; phrases may overlap.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from pairsignals.llm.common import LOWER_BYTES, WORD_BYTES, map_texts

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notice phrases, in words as the scan sees them (fixed values).
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "boost software license": "boost",
    "the unlicense": "unlicense",
    "creative commons": "creative-commons",
    "cc by": "creative-commons",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: Tags that an expression follows, lower-cased (fixed values).
TAGS = ("spdx-license-identifier:", "license-expression:", "license-id:")

#: Licences one may use without passing on terms of the same kind, by the
#: first word of an identifier (fixed values).
PERMISSIVE = frozenset(
    "mit apache bsd isc boost bsl zlib unlicense cc0 0bsd wtfpl public-domain python psf ncsa".split())

#: First words of other licences' identifiers (fixed values).
OTHERS = frozenset("gpl lgpl agpl mpl epl eupl cddl artistic ofl osl sspl cc licenseref".split())

_TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+:-]*)", re.ASCII | re.IGNORECASE)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def looks_like_identifier(token: str) -> bool:
    return bool(re.search("[0-9]|exception", token)) or token.split("-")[0] in PERMISSIVE | OTHERS


def expression_tokens(text: str) -> list[str]:
    """The tokens at the start of ``text`` that can form an expression,
    lower-cased. What follows an operator in capitals is an identifier; one in
    small letters may be prose ("MIT and more"), so there only a token that
    looks like an identifier goes on."""
    out, at, doubtful = [], 0, False
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        if token in _PRECEDENCE:
            doubtful = m[1] != token.upper()
        elif token not in ("(", ")"):
            if doubtful and not looks_like_identifier(token):
                break
            doubtful = False
        out.append(token)
        at = m.end()
    return out


def postfix(tokens: list[str]) -> tuple[list[str], int]:
    """Shunting-yard: the longest leading part of the tokens that is a whole
    expression, in postfix order, and how many tokens it has. Raises
    ValueError if there is none."""
    best, used = [], 0
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for i, token in enumerate(tokens):
        if token == "(" and operand_next:
            waiting.append(token)
        elif token == ")" and not operand_next and "(" in waiting:
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif token in _PRECEDENCE and not operand_next:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
            continue
        elif token not in ("(", ")") and token not in _PRECEDENCE and operand_next:
            out.append(token)
            operand_next = False
        else:
            break  # what follows is no part of the expression
        if not operand_next and "(" not in waiting:
            best, used = out + waiting[::-1], i + 1
    if not best:
        raise ValueError("no license expression")
    return best, used


def is_permissive(identifier: str) -> bool:
    return identifier.split("-")[0] in PERMISSIVE or identifier in PERMISSIVE


def evaluate(tokens: list[str]) -> tuple[set[str], bool]:
    """Licences named in a postfix expression, and whether it allows a choice
    of permissive licences only (or: either side; and: both; with: the
    licence before the exception)."""
    stack: list[tuple[set[str], bool]] = []
    for token in tokens:
        if token in _PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{x} with {y}" for x in left for y in right}, a))
            else:
                stack.append((left | right, (a or b) if token == "or" else (a and b)))
        else:
            stack.append(({token}, is_permissive(token)))
    return stack[0]


@lru_cache(maxsize=1)
def automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        phrases.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score,
    expressions) of one whole text."""
    phrases, tags = automata()
    words = text.translate(WORD_BYTES).split()
    flat = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, covered = [], set(), set(), 0
    seen = at = 0
    for end, (phrase, label, is_base) in phrases.iter(flat):
        labels.add(label)
        covered += phrase.count(" ") + 1
        if is_base:
            base.add(label)
            start = end - len(phrase) - 1  # the space before the phrase
            # Ends ascend and base phrases differ by few characters, so spaces are counted piece by piece.
            if start >= at:
                seen, at = seen + flat.count(" ", at, start), start
                starts.append(seen)
            else:
                starts.append(flat.count(" ", 0, start))
    expressions, permissive = [], []
    lower = text.translate(LOWER_BYTES).decode("latin-1")
    for end, _ in tags.iter(lower):
        line_end = lower.find("\n", end)
        tokens = expression_tokens(text[end + 1:line_end if line_end >= 0 else len(text)].decode("latin-1"))
        try:
            order, used = postfix(tokens)
        except ValueError:
            continue
        found, free = evaluate(order)
        expressions.append(" ".join(tokens[:used]))
        labels |= found
        permissive.append(free)
    # How sure it is that the text is, or carries, a licence: a parsed tag is certain, phrases add up.
    score = 1.0 if expressions else 1.0 - 0.5 ** covered
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, expressions, all(permissive) if permissive else None)


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts, labels, score (0 to 1), tagged
    expressions and whether all of these can be met by permissive licences
    (NULL without one)."""
    return map_texts(df, {key: df.schema[key].dataType.simpleString()}, text, scan, {
        "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
        "labels": "string", "score": "double", "expressions": "array<string>", "permissive": "boolean"})
