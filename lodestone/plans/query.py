"""The keyword query language: lexer, parser, and the plan of a query over an index.

    word   title:word url:word anchor:word desc:word   "exact words"   'near words in order'
    a AND b   a OR b   NOT a   a NOT b   (a b)   a b

AND, OR and NOT are upper case; AND and OR bind alike, from the left; neighbours are ANDed; a NOT b is a AND NOT b.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import STOP_WORDS
from ..functions.text import normalize_py
from ..operators.index import Index

#: How far the last word of a near phrase may stand behind the first.
SPAN = 5
FIELDS = ("title", "url", "anchor", "desc")
SPACE = " \t\n\v\f\r"


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # WORD, TITLE, URL, ANCHOR, DESC, QUOTE, PHRASE, AND, OR, NOT, (, ), EOF
    value: str


@dataclass(frozen=True)
class Syntax:
    """Which words are operators and fields, and which words are no condition."""

    operators: tuple[tuple[str, str], ...] = (("AND", "AND"), ("OR", "OR"), ("NOT", "NOT"))  # as it is written, and what it is
    fields: tuple[str, ...] = FIELDS
    stop_words: frozenset[str] = STOP_WORDS


def lex(query: str, syntax: Syntax = Syntax()) -> list[Token]:  # noqa: B008
    operators = dict(syntax.operators)
    out, i, n = [], 0, len(query)
    while i < n:
        c = query[i]
        if c in SPACE:
            i += 1
        elif c in "()":
            out.append(Token(c, c))
            i += 1
        elif c in "\"'":
            end = query.find(c, i + 1)
            if end < 0:
                raise QueryError(f"the quote at {i} isn't closed")
            out.append(Token("QUOTE" if c == '"' else "PHRASE", query[i + 1 : end]))
            i = end + 1
        else:
            end = i
            while end < n and query[end] not in SPACE + "()\"'":
                end += 1
            w, i = query[i:end], end
            field = next((f for f in syntax.fields if w.startswith(f + ":") and len(w) > len(f) + 1), None)
            if w in operators:
                out.append(Token(operators[w], w))
            elif field:
                out.append(Token(field.upper(), w[len(field) + 1 :]))
            else:
                out.append(Token("WORD", w))
    return [*out, Token("EOF", "")]


def token_counts(query: str, syntax: Syntax = Syntax()) -> Counter:  # noqa: B008
    """How often each word and each exact quote is in a query."""
    return Counter(t.value for t in lex(query, syntax) if t.kind in ("WORD", "QUOTE"))


@dataclass(frozen=True)
class Term:
    token: str
    field: str | None = None

    def __str__(self):
        return f"TERM({self.field + ':' if self.field else ''}{self.token})"


@dataclass(frozen=True)
class Quote:
    text: str

    def __str__(self):
        return f"QUOTE({self.text})"


@dataclass(frozen=True)
class Phrase:
    text: str

    def __str__(self):
        return f"PHRASE({self.text})"


@dataclass(frozen=True)
class Not:
    of: object

    def __str__(self):
        return f"NOT({self.of})"


@dataclass(frozen=True)
class Many:
    """AND or OR of two and more."""

    kind: str
    of: tuple

    def __str__(self):
        return f"{self.kind}({', '.join(map(str, self.of))})"


def _many(kind: str, a, b) -> Many:
    """Flat, so that a query of any length is no deeper than its parentheses."""
    return Many(kind, (*(a.of if isinstance(a, Many) and a.kind == kind else (a,)), b))


class Node:
    """A node of one's own in a query's tree, such as a Many may have: tree() says what it is, as rewrite() does."""

    def tree(self, stop_words: frozenset[str]):
        raise NotImplementedError


def parse(query: str, syntax: Syntax = Syntax()):  # noqa: B008
    toks = lex(query, syntax)
    at = 0

    def part():
        nonlocal at
        t = toks[at]
        at += 1
        if t.kind == "NOT":
            return Not(part())
        if t.kind == "(":
            inner = expression()
            if toks[at].kind != ")":
                raise QueryError("a parenthesis isn't closed")
            at += 1
            return inner
        if t.kind == "WORD":
            return Term(t.value)
        if t.kind.lower() in syntax.fields:
            return Term(t.value, t.kind.lower())
        if t.kind == "QUOTE":
            return Quote(t.value)
        if t.kind == "PHRASE":
            return Phrase(t.value)
        raise QueryError(f"{t.kind} can't stand here")

    def expression():
        nonlocal at
        left = part()
        while toks[at].kind not in ("EOF", ")"):
            kind = toks[at].kind
            if kind in ("AND", "OR"):
                at += 1
                left = _many(kind, left, part())
            else:  # a neighbour, or an infix NOT
                left = _many("AND", left, part())
        return left

    if toks[0].kind == "EOF":
        raise QueryError("the query is empty")
    tree = expression()
    if toks[at].kind != "EOF":
        raise QueryError(f"{toks[at].kind} can't stand here")
    return tree


# ---- rewrite: what matches nothing and everything

IDENTITY = "identity"  # a stop word: no condition


@dataclass(frozen=True)
class Leaf:
    """A condition on one document's terms: any of the fields has the token; or body positions of words in a row or near."""

    kind: str
    tokens: tuple[str, ...]
    field: str | None = None


@dataclass(frozen=True)
class Reader:
    """A condition of one's own: ids(index) gives the doc_id of each document for which it holds."""

    name: str
    ids: Callable[[Index], DataFrame]
    kind = "reader"
    tokens: tuple[str, ...] = ()
    field: str | None = None


def rewrite(node, stop_words: frozenset[str] = STOP_WORDS):
    """Leaf, Reader, ("not", x), ("and"/"or", [x, ...]) or IDENTITY. AND and OR with IDENTITY are the other side."""
    if isinstance(node, Node):
        return node.tree(stop_words)
    if isinstance(node, Reader):
        return node
    if isinstance(node, Term):
        if node.field is None and node.token in stop_words:
            return IDENTITY
        t = normalize_py(node.token, False)
        return Leaf("term", (t,), node.field) if t else IDENTITY
    if isinstance(node, (Quote, Phrase)):
        kind = "quote" if isinstance(node, Quote) else "near"
        got = [t for w in node.text.split() if (t := normalize_py(w, True, stop_words))]
        return Leaf(kind, tuple(got)) if got else IDENTITY
    if isinstance(node, Not):
        inner = rewrite(node.of, stop_words)
        return ("all",) if inner == IDENTITY else ("not", inner)
    parts = [x for p in node.of if (x := rewrite(p, stop_words)) != IDENTITY]
    return IDENTITY if not parts else parts[0] if len(parts) == 1 else (node.kind.lower(), parts)


def leaves(tree) -> list[Leaf | Reader]:
    if isinstance(tree, (Leaf, Reader)):
        return [tree]
    out: dict[Leaf | Reader, None] = {}
    if tree != IDENTITY and tree[0] in ("and", "or"):
        for x in tree[1]:
            out |= dict.fromkeys(leaves(x))
    elif tree != IDENTITY and tree[0] == "not":
        out |= dict.fromkeys(leaves(tree[1]))
    return list(out)


def _fold(tree, leaf, all_, not_, and_, or_):
    if isinstance(tree, (Leaf, Reader)):
        return leaf(tree)
    if tree[0] == "all":
        return all_
    if tree[0] == "not":
        return not_(_fold(tree[1], leaf, all_, not_, and_, or_))
    parts = [_fold(x, leaf, all_, not_, and_, or_) for x in tree[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (and_ if tree[0] == "and" else or_)(out, p)
    return out


def in_a_row(lists: list[Column]) -> Column:
    """Whether positions p, p + 1, ... are in the lists."""

    def at(p):
        c = F.lit(True)
        for i, x in enumerate(lists[1:], 1):
            c = c & F.array_contains(x, p + i)
        return c

    return F.exists(lists[0], at)


def near(lists: list[Column], span: int = SPAN) -> Column:
    """Whether from a position in the first list, always taking the next one not before it, the last is within the span."""

    def next_(x: Column, last: Column) -> Column:
        return F.array_min(F.filter(x, lambda q: q >= last))

    def at(p):
        last = p
        for x in lists[1:]:
            last = next_(x, last)
        return F.coalesce(last - p <= span, F.lit(False))

    return F.exists(lists[0], at)


def distance(index: Index, first: str, second: str, d: int) -> DataFrame:
    """doc_id of documents whose body has `second` exactly d positions after `first`."""
    return matches_tree(index, Leaf("distance", (first, second), str(d)))


def matches(index: Index, query, syntax: Syntax = Syntax()) -> DataFrame:  # noqa: B008
    """doc_id of the documents that match a query, or a tree of nodes. A query that can't be parsed, or has only stop words, matches
    none."""
    try:
        tree = rewrite(parse(query, syntax) if isinstance(query, str) else query, syntax.stop_words)
    except QueryError:
        tree = IDENTITY
    return matches_tree(index, tree)


def matches_tree(index: Index, tree) -> DataFrame:
    """One scan of the postings of all the query's terms and one aggregation by document, whatever the query; with a NOT that
    can hold where no term does, a left join from the documents."""
    ids = index.ids
    if tree == IDENTITY:
        return ids.limit(0)
    if tree == ("all",):
        return ids
    found = leaves(tree)
    words_ = sorted({t for x in found for t in x.tokens})
    readers = {x: i for i, x in enumerate(x for x in found if isinstance(x, Reader))}
    spans = any(x.kind not in ("term", "reader") for x in found)
    p = index.positions.filter(F.col("token").isin(*words_)) if words_ else index.positions.limit(0)
    if found and all(x.kind == "term" and x.field for x in found):
        p = p.filter(F.col("field").isin(*sorted({x.field for x in found})))
    name = {x: f"l{i}" for i, x in enumerate(found)}
    flags, arrays = [], {}
    if readers:
        p = p.select("doc_id", "field", "token", "positions", F.lit(None).cast("int").alias("reader"))
        for x, i in readers.items():
            p = p.unionByName(x.ids(index).select("doc_id", F.lit(i).alias("reader")), allowMissingColumns=True)
    for x in found:
        if x.kind == "reader":
            flags.append(F.bool_or(F.coalesce(F.col("reader") == readers[x], F.lit(False))).alias(name[x]))
        elif x.kind == "term":
            c = (F.col("token") == x.tokens[0]) & ((F.col("field") == x.field) if x.field else F.lit(True))
            flags.append(F.bool_or(c).alias(name[x]))
    if spans:
        for w in sorted({t for x in found if x.kind not in ("term", "reader") for t in x.tokens}):
            arrays[w] = f"p{len(arrays)}"
            c = (F.col("token") == w) & (F.col("field") == "body")
            flags.append(F.coalesce(F.any_value(F.when(c, F.col("positions")), True), F.array().cast("array<int>")).alias(arrays[w]))
    by_doc = p.groupBy("doc_id").agg(*flags)

    def leaf(x: Leaf | Reader) -> Column:
        if x.kind in ("term", "reader"):
            return F.coalesce(F.col(name[x]), F.lit(False))
        lists = [F.coalesce(F.col(arrays[t]), F.array().cast("array<int>")) for t in x.tokens]
        if x.kind == "distance":
            return F.arrays_overlap(F.transform(lists[0], lambda q: q + int(x.field)), lists[1])
        return in_a_row(lists) if x.kind == "quote" else near(lists)

    empty = _fold(tree, lambda x: False, True, lambda a: not a, lambda a, b: a and b, lambda a, b: a or b)
    table = ids.join(by_doc, "doc_id", "left") if empty else by_doc
    cond = _fold(tree, leaf, F.lit(True), lambda a: ~a, lambda a, b: a & b, lambda a, b: a | b)
    return table.filter(cond).select("doc_id")
