"""License scans: Aho-Corasick over identifier tags and notice phrases, and a shunting-yard reader of license expressions.

A text's words are lower-cased and joined by one space; one automaton finds all phrases in it, overlaps included, at word
boundaries. After an identifier tag the expression is read from the text itself up to the end of its line or of its brackets, turned
into postfix order by the shunting-yard method (WITH before AND before OR, brackets, ``+``), and evaluated: an
alternative takes its freer side, a conjunction its stricter side, an exception relaxes copyleft by one step.

``labels`` holds the base labels, the labels of notices and all identifiers of readable expressions; ``terms`` is the
strictest class of what was found (permissive, weak, strong, reserved, unknown), ``score`` how sure the find is:
1 for a readable tag, 0.8 for a notice naming a license, 0.6 for a base phrase alone, 0.3 for an unreadable tag, 0 for nothing.

Defined results: null or empty texts have no words and no labels; an unreadable expression gives no identifier and
leaves all else; repeated rows each get their own row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .data import only, query, ship_package, table

#: Phrases of the contract with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices with their labels.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache", "licensed under the apache license version 2 0": "apache-2.0",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "eclipse public license": "epl", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "public domain": "public-domain", "cc0": "cc0", "isc license": "isc",
    "unlicense": "unlicense", "gnu free documentation license": "gfdl",
}
TAG = "spdx license identifier"
#: How strict a license is, by the beginning of its label, longest first; and what an unlisted one counts as.
TERMS = ("permissive", "weak", "strong", "reserved", "unknown")
STRICT = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "cc0": 0, "public-domain": 0, "unlicense": 0, "zlib": 0, "cc-by-sa": 1, "cc-by-nc": 3, "cc-by-nd": 3, "cc-by": 0,
    "mpl": 1, "lgpl": 1, "epl": 1, "cddl": 1, "gfdl": 2, "gpl": 2, "agpl": 2, "reserved": 3,
}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.\-:]*\+?)")
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = {k: k + 32 for k in range(0x41, 0x5B)}


def strictness(label: str) -> int:
    known = max((k for k in STRICT if label == k or label.startswith((k + "-", k + "+"))), key=len, default=None)
    return len(TERMS) - 1 if known is None else STRICT[known]


def postfix(expression: str) -> list[str] | None:
    """Postfix order of a license expression; None if it is not one."""
    out, stack, operand, at = [], [], True, 0
    text = expression.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            return None
        token, at = found[1], found.end()
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(low)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], int] | None:
    """All license identifiers of an expression and its strictness; None if it can't be read."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[str | None, set[str], int]] = []
    for token in order:
        if token not in _PRECEDENCE:
            stack.append((token, {token}, strictness(token)))
            continue
        (name, right, b), (_, left, a) = stack.pop(), stack.pop()
        if token == "with":
            if name is None:
                return None  # an exception is a single name
            stack.append((None, left, a - 1 if a in (1, 2) else a))
        else:
            stack.append((None, left | right, min(a, b) if token == "or" else max(a, b)))
    return stack[0][1], stack[0][2]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


#: Identifiers of the SPDX list without digit, hyphen or plus, as they are spelled there, so that prose in small letters is none.
PLAIN_NAMES = frozenset(
    "Abstyles Adobe Afmparse Aladdin AMPAS Bahyph Barr Beerware Borceux Caldera ClArtistic Crossword CrystalStacker Cube curl diffmark DOC Dotseqn DSDP "
    "dvipdfm eGenix Entessa Eurosym Fair FTL Giftware Glide Glulxe gnuplot HPND IBM ICU IJG ImageMagick iMatix Imlib Intel IPA ISC JSON Latex2e Leptonica "
    "Libpng libtiff MirOS MIT MITNFA Motosoto MTLL Multics Mup NASA Naumen NCSA NetCDF Newsletr NGPL NLPL Nokia Noweb NPOSL NRL NTP Nunit OML "
    "OpenSSL Plexus PostgreSQL psfrag psutils Qhull Rdisc RSCPL Ruby SAXPath SCEA SendMail SISSL Sleepycat SMLNJ SNIA SWL TCL TMate TOSL Unlicense "
    "VOSTROM Vim VSL W3C Watcom Wsuipa WTFPL Xerox Xinetd xinetd Xnet xpp XSkat Zed Zlib".split())
_TAG_TEXT = re.compile(r"(?<![a-z0-9\x80-\U0010FFFF])spdx[\x00-\x2F\x3A-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x60\x7B-\x7F]+identifier(?![a-z0-9\x80-\U0010FFFF])")
_LEAD = re.compile(r"[: \t]*")
_INNER = re.compile(r"[ \t]*")
_BETWEEN = re.compile(r"(?:[ \t]*[\r\n]+[ \t]*(?:[#*;%]+|//+|--+)?)?[ \t]*")  # over a line's end, and what marks the next line as a comment


def _is_name(token: str) -> bool:
    """Whether a word after an operator is a license and not prose."""
    name = token.rstrip(".:")
    return name in PLAIN_NAMES or any(c.isdigit() or c in "-+" for c in name) or strictness(name.lower()) < len(TERMS) - 1


def expression_at(text: str, at: int) -> str:
    """The license expression that begins at a place of the text, up to the end of its line; while a bracket is open it goes on over line ends."""
    tokens, depth, operand = [], 0, True
    at = _LEAD.match(text, at).end()
    while True:
        found = _TOKEN.match(text, (_BETWEEN if depth else _INNER).match(text, at).end())
        if not found or "\n" in found[0] or "\r" in found[0]:
            break
        token, low = found[1], found[1].lower()
        if token == ")" and (operand or not depth) or token == "(" and not operand or low in _PRECEDENCE and operand:
            break
        if token not in "()" and low not in _PRECEDENCE and not operand:  # words after a whole expression are prose
            break
        if low in _PRECEDENCE:
            after = _TOKEN.match(text, (_BETWEEN if depth else _INNER).match(text, found.end()).end())
            if not after or not depth and ("\n" in after[0] or "\r" in after[0]) or after[1] != "(" and not _is_name(after[1]):
                break
        depth += (token == "(") - (token == ")")
        operand = token == "(" or low in _PRECEDENCE
        # a sentence's full stop or colon does not belong to an identifier
        tokens.append(token.rstrip(".:"))
        at = found.end()
    return " ".join(tokens)


def scan_text(text: str) -> dict:
    """What a text says about its license, in one pass: words and text places are counted on from hit to hit."""
    low = text.translate(_CAPITALS)
    plain = _NOT_WORD.sub(" ", low).strip()
    count = plain.count(" ") + 1 if plain else 0
    joined = f" {plain} "
    tags = _TAG_TEXT.finditer(low)  # the same places as the automaton's, in the same order: both keep to word boundaries
    base, notices, labels, strict, score = set(), set(), set(), [], 0.0
    n_base, first, last, seen, words = 0, None, None, 0, 0
    for end, phrase in automaton().iter(joined) if plain else ():
        if phrase in BASE:
            begin = end - len(phrase)  # of the phrase's first word
            # phrases end in order but may begin in any: step back as well as on
            words += joined.count(" ", seen, begin) if begin >= seen else -joined.count(" ", begin, seen)
            seen = begin
            n_base += 1
            place = words - 1
            first, last = (place, place) if first is None else (min(first, place), max(last, place))
            base.add(BASE[phrase])
            score = max(score, 0.6)
        if phrase in NOTICES:
            notices.add(NOTICES[phrase])
            score = max(score, 0.8)
        if phrase == TAG:
            found = evaluate(expression_at(text, next(tags).end()))
            score = max(score, 0.3 if found is None else 1.0)
            if found:
                labels |= found[0]
                strict.append(found[1])
    strict += map(strictness, base | notices)
    return {
        "n_words": count, "n_base": n_base, "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | notices | labels)), "terms": TERMS[max(strict)] if strict else None, "score": score,
    }


_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
          "labels": pa.string(), "terms": pa.string(), "score": pa.float64()}


def scan(docs: DataFrame) -> DataFrame:
    """Documents with what ``scan_text`` finds in each whole text; all other columns stay."""
    ship_package(docs.sparkSession)
    plain = docs.drop(*_KINDS)
    place = plain.columns.index("text")

    def find(batches):
        for batch in batches:
            found = [scan_text(text.as_py() or "") for text in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[name] for f in found], kind) for name, kind in _KINDS.items())],
                                             names=[*batch.schema.names, *_KINDS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    own = ", ".join(f"{name} {'long' if kind == pa.int64() else 'double' if kind == pa.float64() else 'string'}" for name, kind in _KINDS.items())
    return plain.mapInArrow(find, f"{kinds}, {own}")


@query()
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "terms")
