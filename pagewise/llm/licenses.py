"""Licence scan: an Aho-Corasick automaton for tags and notices, and a shunting-yard reader of licence expressions.

One automaton over the words of a text finds the base phrases and the notice phrases. Another over the lower-cased text
finds identifier tags; the expression after a tag is read into postfix order by operator precedence (WITH, AND, OR) and
evaluated to the licences it names, with its choices kept as a tree, in time that grows with the expression's length. Labels of a notice carry its weight, those of a tag or a base
phrase count in full; the score is that of the surest finding.

Defined cases: a null or empty text has no words and no labels. A malformed expression gives the licences read before the
fault. A text of any length is read whole, each character a bounded number of times. Repeated rows give equal results. Columns beside id and text are not used. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, small_batches

shipped(__name__)

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Fixed by the result contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Phrases of common notices: label and how surely it names the licence of the text.
NOTICES = {
    "licensed under the apache license": ("apache-2", 0.8),
    "mit license": ("mit", 0.7),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution 4 0": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by 4 0": ("cc-by", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Labels of whole identifiers; and of those that a version may follow.
IDENTIFIERS = {
    "apache-2": "apache-2", "apache-2.0": "apache-2", "gpl-3": "gpl-3", "gpl-3.0": "gpl-3", "gpl-2": "gpl-2", "gpl-2.0": "gpl-2",
    "bsd-1-clause": "bsd", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "bsd-4-clause": "bsd", "0bsd": "bsd", "unlicense": "public-domain",
    "bsd": "bsd", "isc": "isc", "mit": "mit",
}
VERSIONED = ("agpl", "cc-by", "cc-by-nc", "cc-by-sa", "cc0", "epl", "gpl", "lgpl", "mpl")
VERSION = re.compile(r"-\d+(?:\.\d+)*$")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: A word before a colon is the next tag, no licence.
TOKEN = re.compile(r"[ \t]*+(\(|\)|[a-z0-9][a-z0-9.+-]*+(?!:))")


def label_of(identifier: str) -> str:
    """The family of a known identifier; any other identifier stands for itself."""
    plain = identifier.rstrip(".+").removesuffix("-only").removesuffix("-or-later")
    stem = VERSION.sub("", plain)
    return IDENTIFIERS.get(plain) or (stem if stem in VERSIONED else plain)


def postfix(expression: str, at: int = 0) -> list[str]:
    """The longest well-formed expression that begins at ``at`` of a lower-case text, in postfix order."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next, opened = True, 0
    while match := TOKEN.match(expression, at):
        token = match[1]
        if token in PRECEDENCE and not operand_next:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == "(" and operand_next:
            waiting.append(token)
            opened += 1
        elif token == ")" and not operand_next and opened:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            opened -= 1
        elif token not in PRECEDENCE and token not in "()" and operand_next:
            out.append(token)
            operand_next = False
        else:
            break
        at = match.end()
    out.extend(token for token in reversed(waiting) if token != "(")
    return out


def tree(rest: list[str]) -> list | str | None:
    """A postfix expression as nested lists [operator, operand, ...]; a chain of one operator is one list. An exception belongs to its licence."""
    stack: list[list | str] = []
    for token in rest:
        if token not in PRECEDENCE:
            stack.append(token)
        elif len(stack) > 1:
            right = stack.pop()
            if isinstance(stack[-1], list) and stack[-1][0] == token:
                stack[-1].append(right)
            else:
                stack.append([token, stack.pop(), right])
    return stack[-1] if stack else None


def leaves(root: list | str) -> list[str]:
    """Licences of a tree, without exceptions, in order."""
    found, todo = [], [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            found.append(at)
        else:
            todo.extend([at[1]] if at[0] == "with" else reversed(at[1:]))
    return found


def shown(root: list | str) -> str:
    """A tree as text: ``|`` between choices, ``&`` between licences that hold together, brackets around inner lists."""
    signs = {"or": " | ", "and": " & ", "with": " with "}
    out, todo = [], [(root, True)]
    while todo:
        at, outer = todo.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        # An operand repeated in its list is shown once.
        operands = [*dict.fromkeys(x for x in at[1:] if isinstance(x, str)), *(x for x in at[1:] if isinstance(x, list))] if at[0] != "with" else at[1:]
        parts = [part for operand in operands for part in ((signs[at[0]], True), (operand, False))][1:]
        bare = outer or at[0] == "with"
        todo.extend(reversed(parts if bare else [("(", True), *parts, (")", True)]))
    return "".join(out)


def alternatives(expression: str) -> list[frozenset[str]]:
    """The choices an expression leaves; each is the set of licences that hold together. An exception belongs to its licence.

    Their number may double with every AND, so the scan does without; this is for single expressions.
    """
    stack: list[list[frozenset[str]]] = []
    for token in postfix(expression):
        if token not in PRECEDENCE:
            stack.append([frozenset([token])])
        elif len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            if token == "or":
                stack.append(list(dict.fromkeys([*left, *right])))
            elif token == "and":
                stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
            else:
                stack.append([frozenset(f"{name} with {next(iter(right[0]))}" for name in choice) for choice in left])
    return stack[-1] if stack else []


def automata():
    """Over the words between single spaces, and over the lower-cased text."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES}:
        phrases.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scanned(text: str | None, phrases, tags) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, expressions, score."""
    lowered = (text or "").translate(LOWER)
    words = WORDS.findall(lowered)
    joined = f" {' '.join(words)} "
    starts, base, labels, score, spoken = [], set(), set(), 0.0, []
    counted, at = 0, 0
    for end, phrase in phrases.iter(joined):
        counted += joined.count(" ", at, end)
        at = end
        if phrase in BASE:
            starts.append(counted - len(phrase.split()))
            base.add(BASE[phrase])
            score = 1.0
        else:
            label, weight = NOTICES[phrase]
            labels.add(label)
            score = max(score, weight)
    for end, _ in tags.iter(lowered):
        if root := tree(postfix(lowered, end + 1)):
            score = 1.0
            spoken.append(shown(root))
            labels.update(map(label_of, leaves(root)))
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), spoken, score


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "expressions array<string>, score double"
)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score"]
    phrases, tags = automata()
    for frame in frames:
        out = pd.DataFrame([scanned(text, phrases, tags) for text in frame["text"]], columns=names)
        out.insert(0, "doc_id", frame["doc_id"].to_numpy())
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` the findings of ``scanned``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(_scan, RESULT)


def licence_digest(docs: DataFrame) -> DataFrame:
    return licence_scan(docs).drop("expressions")
