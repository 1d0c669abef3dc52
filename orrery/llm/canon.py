"""Mapping freely written names to a reference list.

Distinct values only are matched, each in two steps:

1. A multi-pattern automaton over the list's names and aliases (former names,
   distinctive words, quoted identifiers) finds every mention embedded in the
   value; of overlapping mentions the longest wins.
2. Values without one go to token-set similarity: a distinctive word of the
   entry must be there up to one edit (also split, joined, or misread as
   scans do), and the value's descriptive words must fit the entry's, as a
   whole, as an abbreviation or as another form of the word. A name without a
   distinctive word must be there as a whole, one of its words up to one edit
   and the others as descriptive words.

A value that two entries fit equally well denotes neither.

The list is held by every worker, so its size is bounded: longer ones are taken
in parts of ``part_rows``, one pass each. Every part gives its mentions with
their places, its quoted identifiers and its best similarities; which of them
wins is decided over all parts together, by the rules of a single pass. How many
entries have a word is counted over the whole list, so parts change nothing.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.durable import durable

#: Designators of a company's legal form or its place in a group (fixed values).
LEGAL = frozenset(
    "ab ag co company corp corporation gmbh group holding holdings inc incorporated kk k llc llp limited lp ltd nv n v oy partners plc pte pty sa s a se spa ulc the and its of subsidiaries affiliates affiliate subsidiary".split()
)
_TOKEN = re.compile(r"[a-z0-9]+")
_JOINED = re.compile(r"(?<=[a-z])(?=[A-Z][a-z]{2})")
_DIGITS = str.maketrans("01", "ol")


def words(text: str) -> list[str]:
    """Lower-case words without accents; a capital inside a word begins a new one."""
    text = "".join(c for c in unicodedata.normalize("NFKD", _JOINED.sub(" ", text)) if not unicodedata.combining(c))
    return [t.translate(_DIGITS) if re.search("[a-z]", t) else t for t in _TOKEN.findall(text.lower())]


def misread(word: str) -> str:
    """A word as scans read it that take rn for m."""
    return word.replace("rn", "m")


def within_one_edit(a: str, b: str) -> bool:
    """Equal up to one inserted, left out, replaced or swapped letter."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def fits(token: str, word: str) -> bool:
    """Whether ``token`` is ``word``, an abbreviation or another form of it."""
    if token == word or (len(token) >= 4 and within_one_edit(token, word)):
        return True
    if len(token) < 2 or token[0] != word[0]:
        return False
    same = 0
    while same < min(len(token), len(word)) and token[same] == word[same]:
        same += 1
    if same == len(token) >= 3 or same >= max(4, len(word) - 4):
        return True
    letters = iter(word)
    return all(c in letters for c in token)


class Matcher:
    """Matches values against entries (identifier, names), given how many entries have each word."""

    def __init__(self, entries: Sequence[tuple[str, Sequence[str]]], frequency: dict[str, int], common: int, prefixes: Sequence[str] = ()):
        import ahocorasick

        self.frequency, self.common = frequency, common
        #: How many entries have words that only other parts of the list have; set for each batch of values.
        self.said: dict[str, int] = {}
        self.forms: dict[str, list[tuple[list[str], list[str]]]] = {}
        self.by_word: dict[str, set[str]] = defaultdict(set)
        #: (identifier, other words) of names of which every word is common, by each of their words.
        self.plain: dict[str, set[tuple[str, tuple[str, ...]]]] = defaultdict(set)
        self.near: dict[str, set[str]] = defaultdict(set)
        alias: dict[str, set[str]] = defaultdict(set)
        tickers: dict[str, set[str]] = defaultdict(set)
        for ident, names in entries:
            for name in names:
                if not (toks := [t for t in words(name) if t not in LEGAL] or words(name)):
                    continue
                rare = [t for t in toks if self.distinctive(t)]
                self.forms.setdefault(ident, []).append((rare, [t for t in toks if t not in rare]))
                alias[" ".join(toks)].add(ident)
                for t in rare:
                    self.by_word[t].add(ident)
                    if self.frequency.get(t, 1) == 1:
                        alias[t].add(ident)
                if not rare:
                    for k, t in enumerate(toks):
                        if len(t) >= 3 and t not in LEGAL:
                            self.plain[t].add((ident, (*toks[:k], *toks[k + 1 :])))
            tickers[f"({ident})"].add(ident)
            for p in prefixes:
                tickers[f"{p}: {ident}"].add(ident)
                tickers[f"{p}:{ident}"].add(ident)
        self.longest = max(map(len, self.by_word.keys() | self.plain.keys()), default=0)
        for t in self.by_word.keys() | self.plain.keys():
            for d in self._deletions(t) | {misread(t)}:
                self.near[d].add(t)
        self.names, self.quoted = ahocorasick.Automaton(), ahocorasick.Automaton()
        for a, ids in alias.items():
            self.names.add_word(f" {a} ", (len(a), ids))
        for a, ids in tickers.items():
            self.quoted.add_word(a, (len(a), ids))
        for automaton in (self.names, self.quoted):
            if len(automaton):
                automaton.make_automaton()

    def rare(self, word: str) -> bool:
        return (self.frequency.get(word) or self.said.get(word, 0)) <= self.common

    def distinctive(self, word: str) -> bool:
        return len(word) >= 3 and word not in LEGAL and self.rare(word)

    @staticmethod
    def _deletions(t: str) -> set[str]:
        return {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}

    def _hits(self, automaton, text: str) -> list[tuple[int, int, set[str]]]:
        """(length, place, identifiers) of every mention in ``text``."""
        return [(n, end - n, ids) for end, (n, ids) in automaton.iter(text)] if len(automaton) else []

    def _agree(self, ident: str, said: Sequence[str], descriptive: Sequence[str]) -> tuple[float, float]:
        """(share of the descriptive words that fit the entry, share of the entry's that are there), for the best of its names with a word in ``said``."""
        best = (-1.0, -1.0)
        for rare, own in self.forms[ident]:
            if rare and not any(t in said for t in rare):
                continue
            hit = [t for t in descriptive if any(fits(t, w) for w in own)]
            best = max(best, (len(hit) / len(descriptive) if descriptive else 1.0, sum(any(fits(t, w) for t in hit) for w in own) / max(1, len(own))))
        return best

    def _spans(self, toks: Sequence[str]) -> Iterator[tuple[int, int]]:
        """Places of the words and runs of words that, joined, are short enough to be one of the list's up to an edit or misreading."""
        for i in range(len(toks)):
            for j in range(i + 1, len(toks) + 1):
                if len(misread("".join(toks[i:j]))) > self.longest + 1:
                    break
                yield i, j

    def _descriptive(self, toks: Sequence[str]) -> list[str]:
        """Words that describe rather than name, as far as the list knows such words."""
        return [t for t in toks if t not in LEGAL and not self.distinctive(t)]

    def mentions(self, value: str) -> list[tuple[int, int, str, bool]]:
        """(length, place, identifier, whether its descriptive words fit) of the names in ``value``."""
        known = [t for t in words(value) if t not in LEGAL]
        descriptive = self._descriptive(known)
        fit = lambda i: not descriptive or self._agree(i, known, descriptive)[0] > 0
        return [(n, at, i, fit(i)) for n, at, ids in self._hits(self.names, f" {' '.join(known)} ") for i in ids]

    def quotes(self, value: str) -> list[tuple[int, int, str, bool]]:
        """The same of the quoted identifiers in ``value``."""
        return [(n, at, i, True) for n, at, ids in self._hits(self.quoted, value) for i in ids]

    def similar(self, value: str) -> tuple[float, list[str]]:
        """(best similarity, identifiers that reach it); 0 and none without one."""
        toks = [t for t in words(value) if t not in LEGAL]
        scores: dict[str, float] = {}
        for i, j in self._spans(toks):
            token = "".join(toks[i:j])
            if len(token) < 3:
                continue
            # A letter more or less makes another word of a short one.
            near = {w for d in self._deletions(token) | {misread(token)} for w in self.near.get(d, ()) if misread(token) == misread(w) or within_one_edit(token, w)} if len(token) >= 5 else {token}
            naming = j > i + 1 or token in self.by_word or self.rare(token)
            rest = [*toks[:i], *toks[j:]]
            there = cache(lambda o, rest=rest: any(fits(t, o) for t in rest))
            for w in near:
                exact = 1.0 if token == w else 0.8 if misread(token) == misread(w) else 0.5
                for ident in self.by_word.get(w, ()) if naming else ():
                    share, cover = self._agree(ident, [w], rest)
                    if rest and share < 0.5:
                        continue
                    score = exact + 0.4 * share * cover if rest else exact + 0.1
                    scores[ident] = max(scores.get(ident, 0.0), score)
                for ident, own in self.plain.get(w, ()):
                    if not all(map(there, own)):
                        continue
                    share = sum(any(fits(t, o) for o in own) for t in rest) / len(rest) if rest else 1.0
                    if share >= 0.5:  # with other words beside it, less than any distinctive word scores
                        scores[ident] = max(scores.get(ident, 0.0), exact + 0.4 if share == 1 else 0.4 * share)
        top = max(scores.values(), default=0.0)
        return top, sorted(i for i, s in scores.items() if s == top)

    def match(self, value: str) -> tuple[float, list[str]]:
        """(score, identifiers that reach it): above 2 from the automaton, up to 2 from similarity, 0 and none without a match."""
        return chosen(self.mentions(value), self.quotes(value)) or self.similar(value)


def _longest(hits: Sequence[tuple[int, int, str, bool]]) -> list[list[tuple[str, bool]]]:
    """What each mention names, longest first, without mentions that overlap a longer one."""
    by_place: dict[tuple[int, int], list[tuple[str, bool]]] = defaultdict(list)
    for n, at, ident, ok in hits:
        by_place[n, at].append((ident, ok))
    taken: list[tuple[int, int]] = []
    out = []
    for n, at in sorted(by_place, key=lambda h: (-h[0], h[1])):
        if all(at >= e or at + n <= s for s, e in taken):
            taken.append((at, at + n))
            out.append(by_place[n, at])
    return out


def chosen(names: Sequence[tuple[int, int, str, bool]], quotes: Sequence[tuple[int, int, str, bool]]) -> tuple[float, list[str]] | None:
    """(score, identifier) of the longest mention that fits one entry only, else of the longest quoted identifier; None without either."""
    for named in _longest(names):
        if len(ok := {i for i, fit in named if fit}) == 1:
            return 3.0, sorted(ok)
    quoted = _longest(quotes)
    return (2.5, [quoted[0][0][0]]) if quoted and len({i for i, _ in quoted[0]}) == 1 else None


def _frequencies(reference: DataFrame, ident: str, names: Sequence[str]) -> DataFrame:
    """(word, n): how many entries have each word."""
    return (
        reference.select(F.col(ident).alias("i"), F.explode(F.array(*names)).alias("name"))
        .where("name IS NOT NULL")
        .mapInPandas(
            lambda frames: (
                pd.DataFrame([(i, w) for i, n in zip(f["i"], f["name"]) for w in set(words(n))], columns=["i", "word"]) for f in frames
            ),
            "i string, word string",
        )
        .distinct()
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: The matcher a Python worker built last, kept from task to task.
_KEPT: dict[tuple, Matcher] = {}


def _matcher(key: tuple, build: Callable[[], Matcher]) -> Matcher:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


_HITS = "array<struct<n:int,at:int,ident:string,fits:boolean>>"


def _gather(matcher: Matcher, value: str) -> dict:
    """All that one part of a list says about a value."""
    hit = lambda hits: [dict(zip(("n", "at", "ident", "fits"), h)) for h in hits]
    score, idents = matcher.similar(value)
    return {"value": value, "names": hit(matcher.mentions(value)), "quotes": hit(matcher.quotes(value)), "score": score, "idents": idents}


def _decide(value: str, parts: Sequence[dict]) -> dict:
    """The one answer from what every part says."""
    hits = lambda k: [(h["n"], h["at"], h["ident"], h["fits"]) for p in parts for h in p[k]]
    top = max((p["score"] for p in parts), default=0.0)
    score, refs = chosen(hits("names"), hits("quotes")) or (top, sorted(i for p in parts if p["score"] == top for i in p["idents"]))
    return {"value": value, "score": score, "refs": refs[:2]}


def map_to_canonical(
    values: DataFrame, value: Column, reference: DataFrame, *, ident: str, names: Sequence[str], prefixes: Sequence[str] = (), unmatched: str = "UNMATCHED", common: int = 11, part_rows: int = 100_000
) -> DataFrame:
    """(value, ref, score): each distinct value with the entry it denotes, or ``unmatched``.

    ``reference`` has an identifier and one or more columns of names, of which
    some may be null. ``prefixes`` are labels that may stand before a quoted
    identifier. A word is distinctive if at most ``common`` entries have it.

    Defined cases: null values are left out, empty ones unmatched; repeated
    values come once; entries with a null identifier or without names can't be
    matched by name; with an empty list everything is unmatched; other columns
    are ignored whatever their names.
    """
    spark = values.sparkSession
    ref = reference.select(F.col(ident).cast("string").alias("i"), *[F.col(n).cast("string").alias(f"n{k}") for k, n in enumerate(names)]).where("i IS NOT NULL")
    cols = [f"n{k}" for k in range(len(names))]
    parts = max(1, -(-ref.count() // part_rows))
    # Matching costs much more than its bytes tell, so distinct values are dealt out by number.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(value.cast("string").alias("value")).where("value IS NOT NULL").distinct().repartition(tasks)
    run = uuid.uuid4().hex

    def shared_part(p: int):
        part = ref if parts == 1 else ref.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p)
        entries = [(r[0], [n for n in r[1:] if n]) for r in part.collect()]
        counts = Counter(w for _, ns in entries for w in {w for n in ns for w in words(n)})
        if parts > 1:  # words of this part, counted over the whole list
            known = spark.createDataFrame([(w,) for w in sorted(counts)], "word string")
            counts = {r.word: r.n for r in frequencies.join(F.broadcast(known), "word").collect()}
        return spark.sparkContext.broadcast((entries, dict(counts)))

    if parts == 1:
        shared = shared_part(0)

        def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher((run, 0), lambda: Matcher(*shared.value, common, prefixes))
            for f in frames:
                hits = [matcher.match(v) for v in f["value"]]
                yield pd.DataFrame({"value": f["value"], "score": [s for s, _ in hits], "refs": [i[:2] for _, i in hits]})

        out = distinct.mapInPandas(match, "value string, score double, refs array<string>")
    else:
        frequencies = durable(_frequencies(ref, "i", cols))
        said = distinct.mapInPandas(lambda frames: (pd.DataFrame([(v, w) for v in f["value"] for w in {*words(v)}], columns=["value", "word"]) for f in frames), "value string, word string")
        counted = said.join(frequencies, "word").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("said"))
        asked = durable(distinct.join(counted, "value", "left").repartition(tasks))
        told = None
        for p in range(parts):
            shared = shared_part(p)

            def tell(frames: Iterator[pd.DataFrame], shared=shared, p=p) -> Iterator[pd.DataFrame]:
                matcher = _matcher((run, p), lambda: Matcher(*shared.value, common, prefixes))
                for f in frames:
                    rows = []
                    for v, m in zip(f["value"], f["said"]):
                        matcher.said = dict(m) if m is not None else {}
                        rows.append(_gather(matcher, v))
                    yield pd.DataFrame(rows, columns=["value", "names", "quotes", "score", "idents"])

            part = asked.mapInPandas(tell, f"value string, names {_HITS}, quotes {_HITS}, score double, idents array<string>")
            told = part if told is None else told.unionByName(part)
        # As many rows a value as there are parts.
        grouped = told.groupBy("value").agg(F.collect_list(F.struct("names", "quotes", "score", "idents")).alias("parts"))
        out = grouped.mapInArrow(
            lambda batches: (pa.RecordBatch.from_pylist([_decide(r["value"], r["parts"]) for r in b.to_pylist()], schema=pa.schema([("value", pa.string()), ("score", pa.float64()), ("refs", pa.list_(pa.string()))])) for b in batches),
            "value string, score double, refs array<string>",
        )
    return out.select("value", F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(unmatched).alias("ref"), "score")
