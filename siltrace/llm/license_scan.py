"""Licence scans: Aho-Corasick over normalised words, and a parser for licence expressions.

Expressions come from identifier tags, and from notices: a phrase with the version and suffix
words after it becomes an identifier, and identifiers joined by ``and``, ``or`` or ``with``
become one expression.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.arrow import in_text_parts
from siltrace.llm.words import ALNUM, joined

#: Phrases that any scan reports as base labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
_TAG_PHRASE = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier\s*:[ \t]*([A-Za-z0-9.+\-() \t]*)", re.I)
_PERMISSIVE = re.compile(r"(mit|mit-0|bsd|0bsd|bsd-.*|apache(-.*)?|isc|zlib|unlicense|public-domain|cc0(-.*)?|cc-by(-[0-9.]+)?|bsl-.*|python-.*|ncsa|x11)$")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """The expression's lower-case tokens in postfix order, by the shunting-yard method.

    ``with`` binds tightest, then ``and``, then ``or``. A malformed expression raises
    ``ValueError``.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token == "(":
            if not operand_next:
                raise ValueError("operator expected")
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unopened parenthesis")
            stack.pop()
        elif token in _BINDS:
            if operand_next:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("operator expected")
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError("operand expected")
    while stack:
        if stack[-1] == "(":
            raise ValueError("unclosed parenthesis")
        out.append(stack.pop())
    return out


def longest(text: str) -> str:
    """The longest beginning of ``text`` that is an expression; empty if there is none.

    In running prose an expression ends where an operator was expected; a full stop, hyphen or
    plus of the sentence at its end isn't part of it.
    """
    tokens = re.findall(r"[()]|[^\s()]+", text)
    depth, operand_next, ends = 0, True, []
    for k, token in enumerate(tokens):
        if token.lower() in _BINDS or token == ")":
            if operand_next or token == ")" and not depth:
                break
            depth, operand_next = (depth - 1, False) if token == ")" else (depth, True)
        elif not operand_next:
            break
        else:
            depth, operand_next = (depth + 1, True) if token == "(" else (depth, False)
        if not operand_next and not depth:
            ends.append(k + 1)
            if token.endswith("."):
                break
    return re.sub(r"[.\-]+$", "", " ".join(tokens[: ends[-1]])) if ends else ""


def evaluate(expression: str) -> tuple[bool, list[str]]:
    """Whether the expression lets a user choose permissive terms only, and its licence ids.

    ``or`` needs one permissive side, ``and`` both; ``with`` keeps the left side's answer,
    and its right side is an exception, not a licence.
    """
    stack: list[tuple[bool, list[str]]] = []
    for token in postfix(expression):
        if token in _BINDS:
            (b, names_b), (a, names_a) = stack.pop(), stack.pop()
            stack.append((a or b, names_a + names_b) if token == "or" else (a and b, names_a + names_b) if token == "and" else (a, names_a))
        else:
            stack.append((bool(_PERMISSIVE.match(token.rstrip("+"))), [token]))
    return stack[0][0], sorted(set(stack[0][1]))


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES, _TAG_PHRASE: ""}.items():
        a.add_word(f" {phrase} ", (len(phrase), phrase.count(" ") + 1, label, phrase in BASE_PHRASES))
    a.make_automaton()
    return a


#: Words of Creative Commons names and their short forms (fixed values).
_CC_WORDS = {"nc": "nc", "sa": "sa", "nd": "nd", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}
#: Ways to allow later versions.
_LATER = (("or", "later"), ("or", "any", "later", "version"), ("or", "at", "your", "option", "any", "later", "version"))
#: Words between two notices that say nothing about how they are joined.
_FILLERS = {"the", "a", "an", "this", "either", "both", "license", "licence", "licensed", "under", "terms", "of", "international"}
_JOINED = {("and",): "and", ("or",): "or", ("and", "or"): "or", ("or", "at", "your", "option"): "or", ("at", "your", "option", "or"): "or", ("with",): "with"}


def _identifier(label: str, words: list[str], at: int) -> tuple[str, int]:
    """The label with the version and suffixes that begin at word ``at``, and the word after them."""
    if label == "cc-by":
        while at < len(words) and words[at] in _CC_WORDS:
            label += f"-{_CC_WORDS[words[at]]}"
            at += 1
    if words[at : at + 1] == ["license"]:
        at += 1
    number = at + (words[at : at + 1] in (["version"], ["v"]))
    if number < len(words) and (m := re.fullmatch(r"v?([0-9]{1,2})", words[number])):
        minor = words[number + 1] if number + 1 < len(words) and re.fullmatch(r"[0-9]", words[number + 1]) else "0"
        at = number + 1 + (words[number + 1 : number + 2] == [minor])
        label += f"-{int(m[1])}.{minor}"
    for later in _LATER:
        if tuple(words[at : at + len(later)]) == later:
            return f"{label}+", at + len(later)
    return label, at


def _noticed(words: list[str], found: list[dict], sizes: list[int]) -> list[str]:
    """Expressions of the notices in ``found``; a phrase inside of another notice's words is skipped."""
    out, end = [], 0
    for match, size in sorted(zip(found, sizes), key=lambda x: (x[0]["word"], -x[1])):
        if match["word"] < end:
            continue
        between = tuple(w for w in words[end : match["word"]] if w not in _FILLERS) if out and match["word"] - end <= 12 else ()
        name, end = _identifier(match["label"], words, match["word"] + size)
        if between in _JOINED:
            out[-1] += f" {_JOINED[between]} {name}"
        else:
            out.append(name)
    return out


_built: list = []
MATCH = "array<struct<label: string, base: boolean, word: bigint>>"
EXPRESSION = "array<struct<expression: string, tagged: boolean, valid: boolean, permissive: boolean, ids: array<string>>>"
_MATCH_TYPE = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())]))
_EXPRESSION_TYPE = pa.list_(pa.struct([("expression", pa.string()), ("tagged", pa.bool_()), ("valid", pa.bool_()), ("permissive", pa.bool_()), ("ids", pa.list_(pa.string()))]))


def _evaluated(expression: str, tagged: bool) -> dict:
    try:
        permissive, ids = evaluate(expression)
    except ValueError:
        return {"expression": expression, "tagged": tagged, "valid": False, "permissive": False, "ids": []}
    return {"expression": expression, "tagged": tagged, "valid": True, "permissive": permissive, "ids": ids}


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    if not _built:
        _built.append(_automaton())
    find = _built[0].iter
    texts = batch.column(1)
    data, at = joined(texts)
    low = ALNUM[data]
    inside = low != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    begin[firsts] = inside[firsts]
    counts = np.diff(np.concatenate([[0], np.cumsum(begin)])[at])
    keep = inside.copy()  # words and one blank after each
    keep[1:] |= inside[:-1]
    low[~inside] = 32
    flat, ends = low[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[at].tolist()
    matches, expressions = [], []
    for k in range(batch.num_rows):
        padded = f" {flat[ends[k] : ends[k + 1]].strip(b' ').decode()} "
        hits = list(find(padded))
        found, sizes, stated = [], [], []
        if hits:
            blanks = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)
            for word, (_, (size, words, label, base)) in zip(np.searchsorted(blanks, [end - size - 1 for end, (size, *_) in hits]).tolist(), hits):
                if label:
                    found.append({"label": label, "base": base, "word": word})
                    sizes.append(words)
            if len(found) < len(hits):
                stated = [_evaluated(longest(m[1]) or m[1].strip(), True) for m in _TAG.finditer(texts[k].as_py())]
            if found:
                stated += [_evaluated(e, False) for e in _noticed(padded.split(" ")[1:-1], found, sizes)]
        matches.append(found)
        expressions.append(stated)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(matches, _MATCH_TYPE), pa.array(expressions, _EXPRESSION_TYPE)], names=["id", "n_words", "matches", "expressions"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, matches, expressions`` for each row of ``docs``, without a shuffle.

    A-Z is lower-cased; words are digits, letters and everything past ASCII. ``matches`` lists
    each place where a phrase's words stand consecutively, with the index of its first word;
    occurrences may overlap. ``expressions`` lists the longest expression after each identifier
    tag (``tagged``), with ``valid`` false and no ids where none can be parsed, and those made of
    notices: ``gpl-3.0+`` of "GNU General Public License, version 3 or later", joined where only
    an operator and filler words stand between two. Null and empty texts have no words
    and empty lists; repeated rows and null ids are scanned like others; texts of any length are
    scanned whole; an empty table gives no rows, and other columns are not used.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(in_text_parts(_scan, "t"), f"id {source.schema['id'].dataType.simpleString()}, n_words bigint, matches {MATCH}, expressions {EXPRESSION}")
