"""Text search. A document's vector is its lower-case words without the marks at their edges, and their places; there is no stemming.
A query of constant text becomes a condition when the statement is read: words, !, <->, <n>, & and |, as PostgreSQL documents them."""

from __future__ import annotations

import re

from ..dialect.tokens import DialectError
from . import macro, text_of

#: Arrays of the words behind vectors and queries that were made here, by their text, so that a match needn't parse them again.
_arrays: dict[str, str] = {}
_EDGES = "'^[^\\\\p{L}\\\\p{N}]+|[^\\\\p{L}\\\\p{N}]+$'"


@macro("ts_words")
def ts_words(doc):
    return f"filter(transform(split(lower({doc}), '\\\\s+'), w -> regexp_replace(w, {_EDGES}, '')), w -> w <> '')"


@macro("to_tsvector")
def to_tsvector(*args):
    """Of the document, after the configuration where there is one: 'word':place,place in order of first places."""
    words = ts_words(args[-1])
    made = f"array_join(transform(array_distinct({words}), w -> concat('\\'', w, '\\':', array_join(filter(transform({words}, (v, i) -> CASE WHEN v = w THEN i + 1 END), p -> p IS NOT NULL), ','))), ' ')"
    _arrays[made] = words
    return made


@macro("ts_terms")
def ts_terms(query):
    """The terms of a query whose text isn't constant; its operators are dropped, so all terms are asked for."""
    return f"filter(transform(split(lower({query}), '[\\\\s&|!()<>:*]+'), w -> regexp_replace(w, {_EDGES}, '')), w -> w <> '')"


#: Queries of constant text, by their SQL: ("word", w), ("!", a), ("&", a, b), ("|", a, b) or (n, a, b), where b follows a at the distance n.
_trees: dict[str, tuple | None] = {}
_BINDS = {"|": 1, "&": 2, "<": 3}


def _term(text: str) -> tuple | None:
    """The words of a term; several follow each other."""
    tree = None
    for w in text.split():
        if w := re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()):
            tree = ("word", w) if tree is None else (1, tree, ("word", w))
    return tree


def _join(op, a, b):
    """a and b, of which a term without words may be None."""
    return (op, a, b) if a and b else a or b


def _parsed(text: str) -> tuple | None:
    """The tree of a query: ! binds closest, then <->, &, |."""
    tokens = re.findall(r"<->|<\d+>|[&|!()]|'[^']*'|[^\s&|!()<>']+", text)
    at = 0

    def operand():
        nonlocal at
        if at >= len(tokens):
            raise DialectError(f"an operand is missing in the text query {text!r}")
        t, at = tokens[at], at + 1
        if t == "!":
            inner = operand()
            return ("!", inner) if inner else None
        if t == "(":
            inner = chain(1)
            if at >= len(tokens) or tokens[at] != ")":
                raise DialectError(f"a parenthesis is open in the text query {text!r}")
            at += 1
            return inner
        if t[0] in "&|<)":
            raise DialectError(f"an operand is missing in the text query {text!r}")
        return _term(t.strip("'").split(":")[0] if t[0] != "'" else t.strip("'"))

    def chain(least):
        nonlocal at
        left = operand()
        while at < len(tokens) and _BINDS.get(tokens[at][0], 0) >= least:
            op, at = tokens[at], at + 1
            left = _join(op if op in "&|" else 1 if op == "<->" else int(op[1:-1]), left, chain(_BINDS[op[0]] + 1))
        return left

    if not tokens:
        return None
    tree = chain(1)
    if at < len(tokens):
        raise DialectError(f"an operator is missing in the text query {text!r}")
    return tree


def _plain(text: str, op) -> tuple | None:
    tree = None
    for w in re.split(r"[\s&|!()<>:*]+", text):
        tree = _join(op, tree, _term(w))
    return tree


def _web(text: str) -> tuple | None:
    """Words are all asked for, "quoted ones" in their order, those after - not, and or lets one side do."""
    either, all_of = None, None
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or":
            either, all_of = _join("|", either, all_of), None
            continue
        term = _plain(phrase or word, 1)
        all_of = _join("&", all_of, ("!", term) if sign and term else term)
    return _join("|", either, all_of)


def _shown(tree: tuple | None, outer: int = 0) -> str:
    if tree is None:
        return ""
    if tree[0] == "word":
        return "'" + tree[1].replace("'", "''") + "'"
    if tree[0] == "!":
        return "!" + (_shown(tree[1]) if tree[1][0] == "word" else f"( {_shown(tree[1])} )")
    binds = _BINDS.get(tree[0], 3)
    sign = tree[0] if tree[0] in ("&", "|") else "<->" if tree[0] == 1 else f"<{tree[0]}>"
    made = f"{_shown(tree[1], binds)} {sign} {_shown(tree[2], binds + 1)}"
    return f"( {made} )" if binds < outer else made


def _quote(w: str) -> str:
    return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(tree: tuple, words: str) -> str:
    """The ascending places at which a phrase ends, as an array."""
    if tree[0] == "word":
        return f"filter(transform({words}, (w, i) -> CASE WHEN w = {_quote(tree[1])} THEN i END), i -> i IS NOT NULL)"
    if tree[0] in ("&", "|"):
        return f"{'array_intersect' if tree[0] == '&' else 'array_union'}({_places(tree[1], words)}, {_places(tree[2], words)})"
    if tree[0] == "!":
        return f"array_except(coalesce(transform({words}, (w, i) -> i), array()), {_places(tree[1], words)})"
    return f"array_intersect(transform({_places(tree[1], words)}, i -> i + {tree[0]}), {_places(tree[2], words)})"


def _holds(tree: tuple, words: str) -> str:
    """Whether a document of those words, in their order, has what the tree asks for."""
    if tree[0] == "word":
        return f"array_contains({words}, {_quote(tree[1])})"
    if tree[0] == "!":
        return f"(NOT {_holds(tree[1], words)})"
    if tree[0] in ("&", "|"):
        return f"({_holds(tree[1], words)} {'AND' if tree[0] == '&' else 'OR'} {_holds(tree[2], words)})"
    return f"(size({_places(tree, words)}) > 0)"


def _query(query: str, parse) -> str:
    try:
        text = text_of(query)
    except DialectError:
        made = f"array_join(transform({ts_terms(query)}, w -> concat('\\'', w, '\\'')), ' & ')"
        _arrays[made] = ts_terms(query)
        return made
    tree = parse(text)
    made = _quote(_shown(tree))
    _trees[made] = tree
    return made


@macro("to_tsquery")
def to_tsquery(*args):
    return _query(args[-1], _parsed)


@macro("plainto_tsquery")
def plainto_tsquery(*args):
    return _query(args[-1], lambda text: _plain(text, "&"))


@macro("phraseto_tsquery")
def phraseto_tsquery(*args):
    return _query(args[-1], lambda text: _plain(text, 1))


@macro("websearch_to_tsquery")
def websearch_to_tsquery(*args):
    return _query(args[-1], _web)


def _vector_words(v: str) -> str:
    """A vector's words in the order of their places."""
    if v in _arrays:
        return _arrays[v]
    entries = f"arrays_zip(regexp_extract_all({v}, '\\'([^\\']*)\\':([0-9,]+)', 1) AS w, regexp_extract_all({v}, '\\'([^\\']*)\\':([0-9,]+)', 2) AS p)"
    entries = entries.replace(" AS w", "").replace(" AS p", "")
    return f"transform(array_sort(flatten(transform({entries}, e -> transform(split(e['1'], ','), p -> struct(CAST(p AS INT) AS p, e['0'] AS w))))), e -> e.w)"


def _query_words(q: str) -> str:
    return _arrays.get(q) or f"regexp_extract_all({q}, '\\'([^\\']*)\\'', 1)"


@macro("ts_match")
def ts_match(vector, query):
    if query in _trees:  # a query without words finds nothing
        return _holds(_trees[query], _vector_words(vector)) if _trees[query] else f"({vector} IS NULL AND NULL)"
    return f"(size(array_except({_query_words(query)}, {_vector_words(vector)})) = 0)"


@macro("ts_match_words")
def ts_match_words(words, terms):
    """The same of arrays, without the texts between."""
    return f"(size(array_except({terms}, {words})) = 0)"


@macro("ts_rank", "ts_rank_cd")
def ts_rank(vector, query, *rest):
    return f"CAST({ts_match(vector, query)} AS DOUBLE)"


@macro("ts_headline")
def ts_headline(*args):
    """The document as it is."""
    return args[1] if len(args) >= 3 else args[0]
