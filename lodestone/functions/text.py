"""Token normalisation and query-side text functions as Column expressions. All classes are ASCII, as spelled out here."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import STOP_WORDS

UP, LOW = string.ascii_uppercase, string.ascii_lowercase
PUNCT = r"!-/:-@\[-`{-~"
SPACE = r" \t\n\x0B\f\r"
#: Field to the mark its terms carry; the order is that in which a document's fields are indexed.
FIELDS = {"url": "@", "title": "#", "desc": "%", "body": "", "anchor": "$"}
#: Bit of each field in the field flags of a position list.
FLAGS = {"body": 1, "title": 2, "url": 4, "anchor": 8, "desc": 16}
MAX_BYTES = 64


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UP, LOW)


def words(text: Column) -> Column:
    """Split at white space, without empty words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def url_words(url: Column) -> Column:
    """Split at / . - _ ? & =, without empty words."""
    return F.filter(F.split(F.coalesce(url, F.lit("")), r"[/.\-_?&=]+"), lambda w: w != "")


def strip_tags(t: Column) -> Column:
    """Drop what stands between < or { and the next > or } (to the end where there is none), and the closing marks."""
    return F.regexp_replace(F.regexp_replace(t, r"[<{][^>}]*([>}]|$)", ""), "[>}]", "")


def strip_entities(t: Column) -> Column:
    return F.regexp_replace(t, "&[^;]*;", "")


def trim_marks(t: Column) -> Column:
    return F.regexp_replace(t, f"^[{SPACE}{PUNCT}]+|[{SPACE}{PUNCT}]+$", "")


def rejected(t: Column) -> Column:
    """Empty, digits only, with a mark of a URL, or of more than MAX_BYTES bytes."""
    return t.rlike(r"^[0-9]*$|//|\||=|www\.|\.com") | (F.octet_length(t) > MAX_BYTES)


def fold_case(t: Column) -> Column:
    """Words of two and more capitals stay; all else to lower case."""
    return F.when(t.rlike("^[A-Z]{2,}$"), t).otherwise(ascii_lower(t))


def blank_marks(t: Column) -> Column:
    """Each run of punctuation to one blank; none at the start."""
    return F.regexp_replace(F.regexp_replace(t, f"^[{PUNCT}]+", ""), f"[{PUNCT}]+", " ")


def valid(t: Column) -> Column:
    """An ASCII letter, and no byte 0x80 or 0xFF in UTF-8."""
    return t.rlike("[A-Za-z]") & ~(t.rlike(r"[^\x00-\x7F]") & F.hex(F.encode(t, "UTF-8")).rlike("^(..)*(80|FF)"))


#: What most tokens are: nothing is left to do for them.
PLAIN = "^[a-z]{1,64}$"


def is_stop(t: Column, stop_words: frozenset[str]) -> Column:
    """By first letter: inside array functions a long list is gone through word by word."""
    found = F.lit(False)
    for c in sorted({w[0] for w in stop_words}, reverse=True):
        found = F.when(t.startswith(c), t.isin(*sorted(w for w in stop_words if w[0] == c))).otherwise(found)
    return found


class StopWords:
    """Stop words that may be changed while a program runs. current() is what the index and the queries take."""

    def __init__(self, words: frozenset[str] = STOP_WORDS, enabled: bool = True):
        self._words, self.enabled = set(words), enabled

    def add(self, word: str) -> StopWords:
        self._words.add(word)
        return self

    def remove(self, word: str) -> StopWords:
        self._words.discard(word)
        return self

    def __contains__(self, word: str) -> bool:
        return self.enabled and word in self._words

    def current(self) -> frozenset[str]:
        return frozenset(self._words) if self.enabled else frozenset()


def terms(tokens: Column, body: bool, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """Normalised terms of an array of tokens, in order, without those that are dropped. Stop words go in the body only, after
    folding. Each step is an array of its own, so that what a step uses several times is computed once."""
    cleaned = F.transform(tokens, lambda t: F.when(t.rlike(PLAIN), t).otherwise(trim_marks(strip_entities(strip_tags(t)))))
    folded = F.transform(F.filter(cleaned, lambda t: t.rlike(PLAIN) | ~rejected(t)), lambda t: F.when(t.rlike(PLAIN), t).otherwise(blank_marks(fold_case(t))))
    kept = F.filter(folded, lambda t: t.rlike(PLAIN) | valid(t))
    return F.filter(kept, lambda t: ~is_stop(t, stop_words)) if body and stop_words else kept


def normalize(token: Column, body: bool, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """The term a token is indexed under, null where it isn't."""
    return F.try_element_at(terms(F.array(token), body, stop_words), F.lit(1))


def decorated(field: Column, token: Column) -> Column:
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])[field], F.lit(""))
    return F.concat(mark, token)


def format_title(title: Column) -> Column:
    return F.when(F.coalesce(F.size(title), F.lit(0)) <= 0, F.lit("Untitled Document")).otherwise(F.concat_ws(" ", title))


def short_title(title: Column, n: int = 15) -> Column:
    return F.when(F.size(title) > n, F.concat(F.concat_ws(" ", F.slice(title, 1, n)), F.lit("..."))).otherwise(format_title(title))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences, whatever the case (ASCII)."""
    low = ascii_lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / F.lit(max(1, len(word)))).cast("int")


def json_text(s: Column) -> Column:
    """The text as a JSON string."""
    return F.to_json(F.struct(s.alias("v")))


# plain Python, for queries (the driver has them) and for the different tokens of a batch


_TAGS, _TAG_ENDS, _ENTITY = re.compile(r"[<{][^>}]*(?:[>}]|\Z)"), re.compile("[>}]"), re.compile("&[^;]*;")
_MARKS = re.compile(rf"^[{SPACE}{PUNCT}]+|[{SPACE}{PUNCT}]+\Z")
_REJECT, _CAPITALS = re.compile(r"^[0-9]*\Z|//|\||=|www\.|\.com"), re.compile("[A-Z]{2,}")
_HEAD, _INNER, _LETTER, _FOLD = re.compile(f"^[{PUNCT}]+"), re.compile(f"[{PUNCT}]+"), re.compile("[A-Za-z]"), str.maketrans(UP, LOW)


def normalize_py(token: str, body: bool, stop_words: frozenset[str] = STOP_WORDS) -> str | None:
    """normalize() for one token. The index calls it once for each different token of a batch."""
    t = token
    if not (t.isascii() and t.isalpha() and t.islower() and len(t) <= MAX_BYTES):
        t = _MARKS.sub("", _ENTITY.sub("", _TAG_ENDS.sub("", _TAGS.sub("", t))))
        if _REJECT.search(t) or len(t.encode()) > MAX_BYTES:
            return None
        if not _CAPITALS.fullmatch(t):
            t = t.translate(_FOLD)
        t = _INNER.sub(" ", _HEAD.sub("", t))
        if not _LETTER.search(t) or b"\x80" in t.encode() or b"\xff" in t.encode():
            return None
    return None if body and t in stop_words else t


def ranking_tokens(query: str, stop_words: frozenset[str] = STOP_WORDS) -> list[tuple[str, bool]]:
    """Tokens the ranker looks for, and whether each is a stop word: letters in lower case and digits 1 to 9 of each word between
    blanks. Words that go on after title, url, anchor or desc are dropped; the last token is never a stop word."""
    out = []
    parts = query.split(" ")
    for i, part in enumerate(parts):
        t = "".join(c.lower() for c in part if c in UP or c in LOW or c in "123456789")
        if not t or any(t.startswith(p) and len(t) > len(p) for p in ("title", "url", "anchor", "desc")):
            continue
        out.append((t, t in stop_words and i < len(parts) - 1))
    return out
