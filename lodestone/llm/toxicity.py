"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keep_where, stored, table, take

#: Term to weight; a term that ends in * matches every word that begins with it. Labels add more: see learn().
LEXICON = {
    "idiot": 1.0, "moron": 1.0, "scum": 1.0, "worthless": 1.0, "pathetic": 1.0, "disgusting": 1.0, "stupid": 0.9, "loser": 0.9, "trash": 0.8, "clown": 0.8,
}
#: A term inside one of these phrases doesn't count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid question", "sore loser")
#: Rejected are texts of at least this weight, and of this weight for a thousand words.
LEAST_WEIGHT, LEAST_SCORE = 1.5, 1.0
#: A learned term has at least so many words, its shortest and longest length, and at most this probability by chance; it is exp(ODDS) times as common in toxic texts.
WORDS, SHORT, LONG, CHANCE, ODDS = 4, 3, 9, 1e-7, 1.0
#: Thresholds are tried for a text of so many words at most, in longer ones they grow with the words; steps of a weight of 1; a clean text taken costs as much as so many toxic ones missed, also
#: one that is short of the threshold by less than 1 - MARGIN.
PER, STEPS, TOP, COST, MARGIN = (100, 200, 400, 800, 1500), 8, 4000, 20, 0.75
#: More labels than these aren't broadcast.
BROADCAST = 1_000_000

_ALIKE = {
    "i": "1!|lìíîïɩіıľι", "o": "0оοöòóôõø", "e": "3еéèêëε", "a": "4@аàáâäãåα", "s": "5$ѕ", "t": "7т", "c": "сçϲ", "p": "рρ", "d": "ԁ",
    "r": "г", "h": "һ", "u": "υùúûüμ", "n": "ñп", "m": "м", "v": "ν", "j": "ј", "g": "ɡ9", "b": "ьβ", "w": "ѡω", "y": "уýÿ", "k": "кκ", "x": "хχ",
}


def _table() -> dict[int, int]:
    to = {ord(c): ord(k) for k, cs in _ALIKE.items() for c in cs}
    for base in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D670):  # mathematical alphabets
        for k in range(26):
            for off in (0, 26):
                to[base + k + off] = to.get(97 + k, 97 + k)
    for k in range(26):  # full-width letters, lower and upper case
        to[0xFF41 + k] = to[0xFF21 + k] = to.get(97 + k, 97 + k)
    for k in range(10):
        to[0xFF10 + k] = to.get(48 + k, 48 + k)
    return to


FOLD = _table()


def fold(text: str) -> str:
    """Same length as the text: lower case, look-alike letters and digits to one letter; i, l and 1 are one."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower to two characters
        low = "".join(c.lower()[0] for c in text)
    return low.translate(FOLD)


class Lexicon(dict):
    """Term to weight. Learned terms are of a group (a language), of which rejected are texts of LEAST_WEIGHT and the group's least score by its terms alone."""

    def __init__(self, terms: dict[str, float], group: dict[str, str] | None = None, least: dict[str, float] | None = None):
        super().__init__(terms)
        self.group, self.least = group or {}, least or {}


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    words: dict[str, tuple] = {}
    group, least = getattr(lexicon, "group", {}), getattr(lexicon, "least", {})
    for term, weight in lexicon.items():
        stem = term.endswith("*")
        key = fold(unicodedata.normalize("NFC", term.rstrip("*")))
        words[key] = (len(key), float(weight), stem, False, least.get(group.get(term), LEAST_SCORE), group.get(term))
    for phrase in exceptions:
        key = fold(unicodedata.normalize("NFC", phrase))
        words[key] = (len(key), 0.0, False, True, LEAST_SCORE, None)
    for key, value in words.items():
        a.add_word(key, value)
    a.make_automaton()
    return a


def found(text: str, a: ahocorasick.Automaton) -> list[tuple]:
    """Start, end, weight, least score and group of the terms at word borders and outside exception phrases; of learned terms the different words."""
    hits, spans, n, low, seen = [], [], len(text), fold(text), set()
    for end, (size, weight, stem, phrase, least, group) in a.iter(low):
        start = end + 1 - size
        if (start and text[start - 1].isalnum()) or (not stem and end + 1 < n and text[end + 1].isalnum()):
            continue
        if group is not None:
            stop = end + 1
            while stop < n and text[stop].isalnum():
                stop += 1
            if (group, low[start:stop]) in seen:
                continue
            seen.add((group, low[start:stop]))
        if phrase:
            spans.append((start, end))
        else:
            hits.append((start, end, weight, least, group))
    if spans and hits:
        # a span that begins no later reaches no less far: by starts and the farthest end so far
        spans.sort()
        ends = np.maximum.accumulate([e for _, e in spans])
        at = np.searchsorted([s for s, _ in spans], [h[0] for h in hits], "right") - 1
        hits = [h for h, k in zip(hits, at) if k < 0 or ends[k] < h[1]]
    return hits


def weigh(text: str, a: ahocorasick.Automaton) -> tuple[float, int]:
    """Summed weight and number of the terms found."""
    hits = found(text, a)
    return round(sum(h[2] for h in hits), 6), len(hits)


def verdict(text: str | None, a: ahocorasick.Automaton) -> tuple[float, int, int, float, bool]:
    if not text:
        return 0.0, 0, 0, 0.0, False
    hits = found(text, a)
    weight = round(sum(h[2] for h in hits), 6)
    words = len(text.encode().split())
    score = round(1000.0 * weight / words, 4) if words else 0.0
    by: dict[tuple, float] = {}
    for h in hits:
        by[h[4], h[3]] = by.get((h[4], h[3]), 0.0) + h[2]
    toxic = any(round(x, 6) >= LEAST_WEIGHT and words and round(1000.0 * x / words, 4) >= least for (_, least), x in by.items())
    return weight, len(hits), words, score, toxic


def _beginnings(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]+", fold(text)) if len(w) >= SHORT}


def _chosen(rows: list, total: dict, folds: tuple[int, ...], known: list[str]) -> dict[str, dict[str, float]]:
    """By language, the terms and their log odds from the counts of these folds."""
    out: dict[str, dict[str, float]] = {}
    ranked = []
    for lang, s, t, c in rows:
        t, c = sum(t[f] for f in folds), sum(c[f] for f in folds)
        tox, clean = (sum(total.get((lang, f, y), 0) for f in folds) for y in (1, 0))
        if not t or not clean or any(k.startswith(s) or s.startswith(k) for k in known):
            continue
        odds = math.log((t + 0.5) / tox * clean / (c + 0.5))
        by_chance = (t + c) * tox / (tox + clean)
        z = t * math.log(t / by_chance) - t + by_chance
        if odds >= ODDS and z >= -math.log(CHANCE):
            ranked.append((-round(z, 6), len(s), s, lang, odds))
    begun: dict[str, set[str]] = {}  # by language, all beginnings of its terms
    for _, _, s, lang, odds in sorted(ranked):
        terms, starts = out.setdefault(lang, {}), begun.setdefault(lang, set())
        if s not in starts and not any(s[:k] in terms for k in range(1, len(s))):
            terms[s] = odds
            starts |= {s[:k] for k in range(1, len(s) + 1)}
    return out


def learn(docs: DataFrame, labels: DataFrame, lexicon: dict[str, float] = LEXICON) -> dict[str, float]:
    """The lexicon with the beginnings of words that are commoner in texts labelled toxic, weighed by log odds. From all labelled rows.

    For each language (column lang of docs, if there is one) counted is, after folding, in how many pairs of a text and one of its
    words a beginning is. It is a term if at least WORDS different words of toxic texts go on from it and it is in toxic texts more
    often than by chance; of those that go on from each other the most certain, then the shortest. Its weight is the smoothed log
    odds of toxic against clean, scaled so that LEAST_WEIGHT is the language's threshold. That and the least score are set on
    held-out labels: each half of the texts (by hash, copies together) is weighed with terms of the other half, and what counts
    is toxic texts of the language found, less COST for each clean text of any language. A language whose terms lose by this has none.
    labels needs doc_id and toxic; rows with a null are left out, and a doc_id that is labelled both is toxic. docs needs doc_id and
    text; a null text or doc_id has no part, rows that repeat count each time, whatever their length. All words are counted;
    only beginnings that pass the test against chance leave the cluster, all of them. No labels or no texts: the lexicon as it is.
    """
    lab = take(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lab = stored(lab)
    lab = F.broadcast(lab) if lab.count() <= BROADCAST else lab
    has = any(c.lower() == "lang" for c in docs.columns)
    d = take(docs, "doc_id", "text", "lang") if has else take(docs, "doc_id", "text").withColumn("lang", F.lit(""))
    d = d.join(lab, "doc_id").filter("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums: lang, toxic, w (null: all words), n0, n1 by fold."""
        found: dict[tuple, list[int]] = {}

        def batch() -> pa.RecordBatch:
            keys, vals = list(found), list(found.values())
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([v[f] for v in vals], pa.int64()) for f in (0, 1))], names=["lang", "toxic", "w", "n0", "n1"])

        for b in batches:
            for lang, text, fold_, toxic in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "fold", "toxic"))):
                ws = _beginnings(text)
                found.setdefault((lang, toxic, None), [0, 0])[fold_] += len(ws)
                for w in ws:
                    found.setdefault((lang, toxic, w), [0, 0])[fold_] += 1
            if len(found) > 200_000:
                yield batch()
                found.clear()
        yield batch()

    form = "lang string, toxic int, w string, n0 long, n1 long"
    words = stored(d.select("lang", "text", "fold", "toxic").mapInArrow(count, form).groupBy("lang", "toxic", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    sums = words.filter("w is null").collect()  # some for each language
    total = {(r.lang, f, int(r.toxic > 0)): 0 for r in sums for f in (0, 1)}
    for r in sums:
        for f in (0, 1):
            total[r.lang, f, int(r.toxic > 0)] += r[f"n{f}"]
    of = lambda y, f: F.sum(F.when(F.col("toxic") > 0 if y else F.col("toxic") <= 0, F.col(f"n{f}")).otherwise(0))
    starts = words.filter("w is not null").select("lang", "toxic", F.explode(F.transform(F.sequence(F.lit(SHORT), F.least(F.length("w"), F.lit(LONG))), lambda k: F.substring("w", F.lit(1), k))).alias("s"), "n0", "n1")
    by = starts.groupBy("lang", "s").agg(F.sum((F.col("toxic") > 0).cast("int")).alias("words"), *[of(y, f).alias(f"{'ct'[y]}{f}") for y in (0, 1) for f in (0, 1)])
    all_ = words.filter("w is null").groupBy("lang").agg(*[of(y, f).alias(f"all_{'ct'[y]}{f}") for y in (0, 1) for f in (0, 1)])
    passes = F.lit(False)
    for folds in ((0, 1), (0,), (1,)):
        t, c, tox, clean = (sum((F.col(f"{k}{f}") for f in folds), F.lit(0.0)) for k in ("t", "c", "all_t", "all_c"))
        chance = (t + c) * tox / (tox + clean)
        # a little less than _chosen asks, which decides
        z = t * F.log(t / chance) - t + chance >= F.lit(-math.log(CHANCE) - 1e-6)
        passes = passes | F.when((t > 0) & (clean > 0), z & (F.log((t + 0.5) / tox * clean / (c + 0.5)) >= ODDS - 1e-6)).otherwise(False)
    common = by.filter((F.col("words") >= WORDS) & (F.col("t0") + F.col("t1") >= WORDS)).join(all_, "lang").filter(passes)
    rows = [(r.lang, r.s, (r.t0, r.t1), (r.c0, r.c1)) for r in common.select("lang", "s", "t0", "t1", "c0", "c1").collect()]
    known = [fold(k.rstrip("*")) for k in lexicon]
    terms = _chosen(rows, total, (0, 1), known)
    other = [_chosen(rows, total, (1 - f,), known) for f in (0, 1)]
    if not terms:
        return dict(lexicon)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for o in other:  # one automaton a language: languages may share a term
            made.append({g: automaton(Lexicon({s + "*": w for s, w in ts.items()}, {s + "*": g for s in ts}), ()) for g, ts in o.items()})
        seen: dict[tuple, int] = {}
        for b in batches:
            for lang, text, fold_, toxic in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "fold", "toxic"))):
                n = 0
                for g, a in made[fold_].items():
                    if (toxic and g != lang) or not (w := weigh(text, a)[0]):
                        continue
                    n = n or len(text.encode().split())
                    for per in PER:
                        key = g, per, min(TOP, int(STEPS * w / max(1.0, n / per))), toxic
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))] + [pa.array(list(seen.values()), pa.int64())], names=["g", "per", "at", "toxic", "n"])

    at = d.mapInArrow(held, "g string, per long, at long, toxic long, n long").groupBy("g", "per", "at", "toxic").agg(F.sum("n").alias("n")).filter("at > 0").collect()
    out, group, least = dict(lexicon), {}, {}
    for g in sorted(terms):
        best = (0, 0, 0)
        for per in PER:
            bins = [(r.at, r.toxic, r.n) for r in at if r.g == g and r.per == per]
            for k in {b[0] for b in bins}:
                gain = sum(n for x, y, n in bins if y and x >= k) - COST * sum(n for x, y, n in bins if not y and x >= MARGIN * k)
                best = max(best, (gain, -per, k))
        if best[0] <= 0:
            continue
        for s, w in terms[g].items():
            if s + "*" not in out:
                out[s + "*"], group[s + "*"] = w * LEAST_WEIGHT * STEPS / best[2], g
        least[g] = 1000 * LEAST_WEIGHT / -best[1]
    return Lexicon(out, group, least)


def score_toxicity(docs: DataFrame, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """One row for each row of docs: doc_id, weight, hits, n_words, score (weight for a thousand words), toxic.

    Needs doc_id and text; extra columns are dropped. A null or empty text scores 0 and isn't toxic; null doc_ids and
    repeated rows stay as they are. Whole texts are searched, however long. No rows give no rows.
    """
    terms = LEXICON if lexicon is None else lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms, exceptions)
        for b in batches:
            rows = [verdict(t.as_py(), a) for t in b.column("text")]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())))],
                names=["doc_id", "weight", "hits", "n_words", "score", "toxic"],
            )

    d = take(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType
    schema = StructType().add("doc_id", kind).add("weight", "double").add("hits", "long").add("n_words", "long").add("score", "double").add("toxic", "boolean")
    return d.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, lexicon: dict[str, float] | None = None) -> DataFrame:
    """docs, all columns, without the rows whose text is toxic.

    Needs text. Null and empty texts stay, as do null doc_ids; each of repeated rows is judged alike; texts of any length are
    searched whole; a text at exactly the threshold is toxic. Extra columns, whatever their names, stay as they are. No rows give no rows.
    """
    terms = LEXICON if lexicon is None else lexicon

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(terms, EXCEPTIONS)
        for s in batches:
            yield s.map(lambda t: not verdict(t, a)[4]).astype(bool)

    return keep_where(docs, lambda text: clean(F.coalesce(text, F.lit(""))), "text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
