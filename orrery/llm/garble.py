"""Text that was decoded with the wrong character encoding.

Bytes below 128 mean the same in nearly all encodings, so a garbled sentence and
its clean original agree once everything else is taken out. What the rest tells:

1. Every record is cut into sentences, each kept as a hash of its ASCII
   characters, where the others stand among them, and these others, run by run.
   Copies become one. Records that share a sentence are near-twins, whatever
   else they say.
2. A garbled sentence has as many characters in each run as its original has
   bytes there, and wherever a byte comes again so does its character, whatever
   it was read as. Sentences are joined on their ASCII characters and this form
   (of bytes in UTF-8, in encodings of two bytes a character, or of characters),
   and the joined runs aligned character by character: each aligned pair tells
   which character a byte was read as, or which character another one stands for.
3. What the pairs tell is put together into tables: a table grows from the
   reading most often seen by those seen together with it, as long as no
   character stands for two bytes. An encoding that agrees with a table fills in
   the bytes no pair has shown; a table that none agrees with is used as it is.
4. Every record is searched for stretches that a learned table turns back into
   text. A sentence that a table turns into another sentence of the corpus is
   garbled, whatever the search says, and where characters are gone for good a
   clean near-twin has them.

Counts over the distinct sentences of the corpus tell readable text from
unreadable where the bytes alone don't: how often a character occurs, against how
often a stretch would turn into it (correct text that happens to look garbled
would turn into characters that nobody writes), and how often pairs of
neighbouring characters occur, hashed into a fixed number of buckets.

Characters written as entities of markup count as the characters they stand for.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.durable import durable

#: Encodings that may fill in what the pairs don't show of a reading; one byte a character.
READ = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "iso8859-15", "cp1254", "iso8859-5", "cp1253", "cp1257")
#: The same of what was written one byte a character, and in two.
NARROW = ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp1250", "iso8859-2")
WIDE = ("euc_jp", "euc_kr", "gb2312")

_BUCKETS = 1 << 18
_RUN = re.compile(r"[^\x00-\x7f]+")
_LONG = re.compile(r"[^\x00-\x7f]{2,}")
_WORDS = re.compile(r"(?<![A-Za-z\x80-\U0010ffff])[^\x00-\x7f]+(?![A-Za-z\x80-\U0010ffff])")
#: Sentences end by ASCII characters only, so that garbled and clean text fall into the same ones.
_SENTENCE = re.compile(r"([\n\r]+|(?<=[.!?])[ \t]+)")
_ENTITIES = re.compile(r"(?:&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});){2,}")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: What may be garbled at all.
_SUSPECT = r"[^\x00-\x7F]|&#?\w+;&#?\w+;"
#: ASCII characters, a run of others being as good as two, from which on they tell a twin; where forms are compared too, any number will do.
_TELLING = 20
#: Rows that may be broadcast; more are joined by key.
_BROADCAST_ROWS = 200_000


def _high(read: str) -> list[str]:
    """The characters that bytes 128 to 255 become in an encoding; undefined ones stay control characters."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@dataclass(frozen=True)
class Reading:
    """The byte that each character stands for, where bytes were read one a character."""

    name: str
    own: dict[str, int]

    def back(self, text: str) -> bytes | None:
        """The bytes that were read as ``text``."""
        try:
            return bytes(ord(c) if c < "\x80" else self.own[c] for c in text)
        except KeyError:
            return None

    def undo(self, text: str, written: str) -> str | None:
        b = self.back(text)
        try:
            return b.decode(written) if b is not None else None
        except UnicodeDecodeError:
            return None

    def stretches(self) -> re.Pattern:
        """Characters whose bytes are one character in UTF-8."""
        by = defaultdict(list)
        for c, b in self.own.items():
            by[b].append(re.escape(c))

        def some(a: int, b: int) -> str:
            chars = "".join(x for k in range(a, b + 1) for x in by[k])
            return f"[{chars}]" if chars else r"(?!)"

        tail = some(0x80, 0xBF)
        return re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")


CODECS = {r: Reading(r, {c: 128 + i for i, c in enumerate(_high(r))}) for r in READ}
_PATTERNS = {r: x.stretches() for r, x in CODECS.items()}


@dataclass(frozen=True)
class Transform:
    """What was written, and what it was read as."""

    written: str
    reading: Reading

    def undo(self, text: str) -> str | None:
        return self.reading.undo(text, self.written)


#: Every combination of the encodings above, for corpora without twins.
UNTAUGHT = tuple(Transform(w, CODECS[r]) for w in ("utf-8", *NARROW, *WIDE, "cp932") for r in READ if w != r)


def _readable(c: str) -> bool:
    return c != "�" and unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs")


def _as_it_stands(text: str, start: int, end: int) -> bool:
    """Whether two characters are rather the end of a word in capitals and the punctuation behind it."""
    return (
        end - start == 2
        and text[start].isupper()
        and (text[start + 1] == "…" or unicodedata.category(text[start + 1]) in ("Pd", "Pe", "Pf"))
        and text[start - 1 : start].isupper()
        and not text[end : end + 1].isalpha()
    )


def _buckets(run: str) -> list[int]:
    """Buckets of the neighbouring pairs in a run, its ends included; the same in every process."""
    s = [0, *map(ord, run.lower()), 0]
    return [((a * 2654435761 + b * 40503) & 0xFFFFFFFF) * 2246822519 >> 13 & (_BUCKETS - 1) for a, b in zip(s, s[1:])]


class Model:
    """What is usual in a corpus: its characters and pairs of neighbouring ones."""

    def __init__(self, pairs: dict[int, int], chars: dict[str, int], hits: dict[tuple[int, str], int]):
        self.log = np.zeros(_BUCKETS, np.float32)
        for b, n in pairs.items():
            self.log[b] = math.log1p(n)
        self.top = float(self.log.max())
        self.runs: dict[str, tuple[float, int]] = {}
        #: Characters that stretches read in an encoding don't turn into, as they would do so more often than anyone writes them.
        self.unusual = {(READ[r], c) for (r, c), n in hits.items() if unicodedata.category(c) not in ("Zs", "Cf") and chars.get(c, 0) < n}
        self.rare = {(READ[r], c) for (r, c), n in hits.items() if chars.get(c, 0) < 3 * n}

    def mean(self, runs: Sequence[str]) -> tuple[float, int]:
        """(mean over the pairs in ``runs``, their number); what a run adds is kept, as runs recur."""
        total, n = 0.0, 0
        for r in runs:
            if (x := self.runs.get(r)) is None:
                b = _buckets(r)
                x = (float(self.log[b].sum()), len(b))
                if len(self.runs) < 200_000:
                    self.runs[r] = x
            total, n = total + x[0], n + x[1]
        return (total / n, n) if n else (0.0, 0)

    def doubt(self, runs: Sequence[str]) -> list[float]:
        """The less the cleaner: characters lost, characters, unusual neighbours."""
        return [float(sum(len(_LOST.findall(r)) for r in runs)), float(sum(map(len, runs))), -self.mean(runs)[0]]


class Restorer:
    """Undoes transformations in texts, the learned ones in order, then ``untaught`` ones on more evidence."""

    def __init__(self, learned: Sequence[Transform], model: Model, proven: frozenset[tuple[str, str]] = frozenset(), untaught: Sequence[Transform] = ()):
        self.model = model
        #: (name of a reading, character) of stretches that twins show; these aren't refused as unusual.
        self.proven = proven
        taught = {(t.written, t.reading.name) for t in learned}
        rest = [t for t in untaught if (t.written, t.reading.name) not in taught]
        self.utf8 = [(t.reading, 1) for t in learned if t.written == "utf-8"] + [(t.reading, 2) for t in rest if t.written == "utf-8"]
        self.patterns = {r.name: r.stretches() for r, _ in self.utf8}
        #: Transformations with the least gain and length that they need; those of two bytes a character may take ASCII along.
        self.wide: list = []
        self.narrow: list = []
        for some, gain, least in ((learned, 1.0, 4), (rest, 1.5, 12)):
            for t in some:
                if t.written != "utf-8":
                    (self.wide if t.written in (*WIDE, "cp932") else self.narrow).append((t, gain, least))
        self.undone: dict[tuple[str, int], str | None] = {}
        self.sure = {r.name for r, n in self.utf8 if n == 1}
        self.seen: dict[str, tuple[str, ...]] = {}
        self.still: dict[str, bool] = {}
        #: Encodings whose second byte may be ASCII say nothing of a run by itself.
        self.by_run = not any(t.written == "cp932" for t, *_ in self.wide)

    def _char(self, stretch: str, read: Reading) -> str | None:
        c = read.undo(stretch, "utf-8")
        if c and "\x80" <= c <= "\x9f" and any("\x80" <= x <= "\x9f" for x in stretch):
            return c  # a step on the way back from text that was garbled twice
        refused = self.model.unusual if read.name in self.sure else self.model.rare
        return c if c is not None and all(map(_readable, c)) and ((read.name, c) in self.proven or (read.name, c) not in refused) else None

    def _reads(self, run: str) -> tuple[str, ...]:
        """Readings in which something in a run of characters would turn into others."""
        if (r := self.seen.get(run)) is None:
            r = tuple(read.name for read, _ in self.utf8 if any(self._char(m.group(), read) for m in self.patterns[read.name].finditer(run)))
            if len(self.seen) < 200_000:
                self.seen[run] = r
        return r

    def _undo_utf8(self, text: str) -> tuple[str, int]:
        total = 0
        while True:  # text that was garbled several times over; each layer taken off makes it shorter
            reads = {r for run in set(_LONG.findall(text)) for r in self._reads(run)}
            changed = 0
            for read, least in self.utf8 if reads else ():
                if read.name not in reads:
                    continue
                hits = 0

                def one(m: re.Match, read: Reading = read) -> str:
                    nonlocal hits
                    c = self._char(m.group(), read)
                    if c is None or _as_it_stands(m.string, m.start(), m.end()):
                        return m.group()
                    hits += 1
                    return c

                new = self.patterns[read.name].sub(one, text)
                if hits >= least:
                    text, changed = new, changed + hits
            total += changed
            if not changed:
                return text, total

    def _inert(self, run: str) -> bool:
        """Whether nothing could be made of a run of characters, whatever stands around it; kept, as runs recur."""
        if (x := self.still.get(run)) is None:
            x = not _LOST.search(run) and not self._reads(run)
            if x and (self.wide or self.narrow):
                now = self.model.mean([run])[0]
                x = not any((y := self._whole(run, id(t), t)) is not None and self.model.mean(_RUN.findall(y))[0] > now for t, *_ in (*self.wide, *self.narrow))
            if len(self.still) < 400_000:
                self.still[run] = x
        return x

    def _whole(self, text: str, k: int, t: Transform) -> str | None:
        """``text`` undone, if all of it can be and is readable."""
        if (text, k) in self.undone:
            return self.undone[text, k]
        x = t.undo(text)
        if x is not None and not all(c in "\n\t\r" or _readable(c) for c in x):
            x = None
        if len(text) < 40 and len(self.undone) < 400_000:
            self.undone[text, k] = x
        return x

    def _better(self, was: list[str], how: list, least: int, gain: float) -> list[str] | None:
        """What ``was`` becomes under the transformation in ``how`` after which it reads best, if much better."""
        now, n = self.model.mean([r for w in was for r in _RUN.findall(w)])
        best = None
        if n < least or self.model.top - now < gain:
            return None
        for t, own_gain, own_least in how:
            if n < own_least or self.model.top - now < own_gain:
                continue
            new = []
            for w in was:
                new.append(self._whole(w, id(t), t))
                if new[-1] is None:
                    break
            if new[-1] is None:
                continue
            then, _ = self.model.mean([r for x in new for r in _RUN.findall(x)])
            if then - now >= max(gain, own_gain) and (best is None or then > best[0]):
                best = (then, new)
        return best and best[1]

    def _undo_other(self, text: str) -> tuple[str, int]:
        """Sentences and words that read much better as written in another encoding."""
        if not self.wide and not self.narrow:
            return text, 0
        out, hits = [], 0
        for part in _SENTENCE.split(text):
            if _LONG.search(part):
                words = _WORDS.findall(part)  # words of mixed letters aren't of an alphabet of their own
                if self.wide and (new := self._better([part], self.wide, 6, 1.0)):
                    part, hits = new[0], hits + 1
                elif words and (new := self._better(words, self.narrow, 4, 1.0)):
                    table = iter(new)
                    part, hits = _WORDS.sub(lambda _: next(table), part), hits + 1
                else:

                    def one(m: re.Match) -> str:
                        nonlocal hits
                        new = self._better([m.group()], self.narrow, 5, 1.5)
                        hits += bool(new)
                        return new[0] if new else m.group()

                    part = _WORDS.sub(one, part)
            out.append(part)
        return "".join(out), hits

    def _undo_entities(self, text: str) -> tuple[str, int]:
        """Runs of entities that stand for garbled characters; others stay as they are."""
        total = 0

        def one(m: re.Match) -> str:
            nonlocal total
            stand_for = html.unescape(m.group())
            new, n = self._undo_utf8(stand_for) if not stand_for.isascii() else (stand_for, 0)
            total += n
            return new if n else m.group()

        return (_ENTITIES.sub(one, text), total) if "&" in text else (text, 0)

    def __call__(self, text: str) -> tuple[str, int, bool]:
        """(text as far as it can be restored, stretches found, whether some are lost)."""
        new, e = self._undo_entities(text)
        if new.isascii() or (self.by_run and all(map(self._inert, set(_RUN.findall(new))))):
            return new, e, False
        new, a = self._undo_other(new)
        new, b = self._undo_utf8(new)
        return new, a + b + e, bool(_LOST.search(new))


def dissect(sentence: str) -> tuple[str, list[int], list[str]]:
    """(ASCII characters, where the runs of others stand among them, these runs)."""
    parts = _RUN.split(sentence)
    at, place = [], 0
    for p in parts[:-1]:
        place += len(p)
        at.append(place)
    return "".join(parts), at, _RUN.findall(sentence)


def weave(plain: str, at: Sequence[int], runs: Sequence[str]) -> str:
    """The sentence again."""
    out, last = [], 0
    for k, r in zip(at, runs):
        out += [plain[last:k], r]
        last = k
    return "".join([*out, plain[last:]])


def _hash(plain: str) -> int:
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _sentences(texts: DataFrame) -> DataFrame:
    """(i, n, h, size, at, runs): the n-th sentence of record i, if it has characters beyond ASCII, without its ASCII characters, of which ``h`` is the hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("size", pa.int32()), ("at", pa.list_(pa.int32())), ("runs", pa.list_(pa.string()))])
        for b in batches:
            rows = []
            for k, t in enumerate(b.column(1).to_pylist()):
                for n, s in enumerate(_SENTENCE.split(t)):
                    if not s.isascii():
                        plain, at, runs = dissect(s)
                        rows.append((k, n, _hash(plain), len(plain), at, runs))
            cols = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], ["i", *schema.names[1:]])

    kind = texts.schema["i"].dataType.simpleString()
    return texts.where(F.col("t").rlike(r"[^\x00-\x7F]")).mapInArrow(cut, f"i {kind}, n int, h long, size int, at array<int>, runs array<string>")


def _count(runs: Counter, pairs: Counter, chars: Counter, hits: Counter) -> None:
    for run, n in runs.items():
        for b in _buckets(run):
            pairs[b] += n
        for c in run:
            chars[c] += n
        for k, read in enumerate(READ) if len(run) > 1 else ():
            for m in _PATTERNS[read].finditer(run):
                if (c := CODECS[read].undo(m.group(), "utf-8")) and _readable(c):
                    hits[k, c] += n


def _corpus_model(distinct: DataFrame) -> Model:
    """Counts over the distinct sentences (runs). What comes back is bounded by the buckets and by the characters there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, pairs, chars, hits = Counter(), Counter(), Counter(), Counter()
        for b in batches:
            runs.update(b.column(0).flatten().to_pylist())
            if len(runs) > 100_000:
                _count(runs, pairs, chars, hits)
                runs.clear()
        _count(runs, pairs, chars, hits)
        rows = [(-2, b, n) for b, n in pairs.items()] + [(-1, ord(c), n) for c, n in chars.items()] + [(k, ord(c), n) for (k, c), n in hits.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["k", "x", "n"])

    rows = distinct.select("runs").mapInArrow(count, "k long, x long, n long").groupBy("k", "x").agg(F.sum("n").alias("n")).collect()
    return Model({r.x: r.n for r in rows if r.k == -2}, {chr(r.x): r.n for r in rows if r.k == -1}, {(r.k, chr(r.x)): r.n for r in rows if r.k >= 0})


def form(h: int, at: Sequence[int], runs: Sequence[Sequence]) -> int:
    """The same for all sentences with these ASCII characters whose runs have these lengths and repeat what they repeat at the same places."""
    seen: dict = {}
    return hash((h, *at, *map(len, runs), *[seen.setdefault(x, len(seen)) for r in runs for x in r]))


def _formed(distinct: DataFrame) -> DataFrame:
    """``distinct`` (h, size, at, runs) with the forms of its characters, of their bytes in UTF-8, and in encodings of two bytes."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, utf8, wide = [], [], []
            for h, at, runs in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
                own.append(form(h, at, runs))
                utf8.append(form(h, at, [r.encode("utf-8", "surrogatepass") for r in runs]))
                wide.append([])
                if any(c >= "\u1100" for r in runs for c in r):
                    for w in WIDE:
                        try:
                            wide[-1].append(form(h, at, [r.encode(w) for r in runs]))
                        except UnicodeEncodeError:
                            pass
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64()), pa.array(utf8, pa.int64()), pa.array(wide, pa.list_(pa.int64()))], ["h", "size", "at", "runs", "own", "utf8", "wide"])

    return distinct.mapInArrow(forms, "h long, size int, at array<int>, runs array<string>, own long, utf8 long, wide array<long>")


def twin_pairs(distinct: DataFrame) -> DataFrame:
    """(kind, g, c): runs of sentences with the same ASCII characters and form, of which ``g`` may be ``c`` garbled.

    In pairs of kind one the form is that of both as they stand, and which of
    them is garbled isn't told; where the ASCII characters tell enough, equal
    lengths will do, as only some words may be garbled. A form gives one pair or
    two, so that sentences of one form, however many, aren't paired with each other.
    """
    hashed = F.xxhash64("runs")
    told = distinct.where(F.col("size") + 2 * F.size("at") >= _TELLING)
    long = distinct.where(F.forall("runs", lambda r: F.length(r) >= 2))
    lengths = F.xxhash64("h", "at", F.transform("runs", F.length))
    several = lambda df, k: df.groupBy(k.alias("k")).agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi")).where("lo <> hi").select("k")
    read = long.select(F.col("own").alias("k")).distinct()
    # Forms and hashes first; only sentences of forms that meet are fetched.
    met = {"own": several(distinct, F.col("own")), "lengths": several(told, lengths), "utf-8": distinct.select(F.col("utf8").alias("k")).distinct().join(read, "k"), "wide": distinct.select(F.explode("wide").alias("k")).distinct().join(read, "k")}
    all_met = None
    for name, keys in met.items():
        named_keys = keys.select(F.lit(name).alias("by"), "k")
        all_met = named_keys if all_met is None else all_met.unionByName(named_keys)
    all_met = durable(all_met)
    of = lambda df, k, by: df.select(k.alias("k"), "runs").join(_near(all_met.where(F.col("by") == by).select("k")), "k")
    ends = lambda df: df.groupBy("k").agg(F.min("runs").alias("lo"), F.max("runs").alias("hi"))
    one = ends(of(distinct, F.col("own"), "own")).unionByName(ends(of(told, lengths, "lengths")))
    out = one.select(F.lit("one").alias("kind"), F.col("lo").alias("g"), F.col("hi").alias("c"))
    for kind, key in (("utf-8", F.col("utf8")), ("wide", F.explode("wide"))):
        both = ends(of(long, F.col("own"), kind)).join(of(distinct, key, kind).groupBy("k").agg(F.min("runs").alias("c")), "k")
        out = out.unionByName(both.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("g"), "c").where("g <> c"))
    return out


def aligned(kind: str, g: Sequence[str], c: Sequence[str], model: Model) -> list[tuple[str, list[tuple[int, str]]]]:
    """What aligning two sentences tells, character by character: (written, [(byte or original character, character read)]).

    Nothing is told where one character would stand for two, or two for one. In
    pairs of kind one, runs may be the same in both; in others all characters differ.
    """
    out = []
    if kind == "one":
        other = [(x, y) for x, y in zip(g, c) if x != y]
        g, c = [x for x, _ in other], [y for _, y in other]
        if model.doubt(g) < model.doubt(c):
            g, c = c, g
    for written in {"utf-8": ("utf-8",), "wide": WIDE, "one": ("one",)}[kind]:
        there: dict[int, str] = {}
        back: dict[str, int] = {}
        for read, original in zip(g, c):
            try:
                units = list(map(ord, original)) if written == "one" else list(original.encode(written))
            except UnicodeEncodeError:
                break
            if len(units) != len(read) or any(there.setdefault(u, x) != x or back.setdefault(x, u) != u or (written == "one" and chr(u) == x) for u, x in zip(units, read)):
                break
        else:
            if there and not any(u < 128 for u in there):
                out.append((written, sorted(there.items())))
    return out


def grown(seen: dict[tuple[tuple[int, str], tuple[int, str]], int], least: int = 2) -> list[tuple[tuple[int, str], dict[str, int]]]:
    """(seed, table) for each table of {character read: what it stands for}: from the assignment most often seen, by those seen ``least`` times together with it."""
    often = sorted((a for a, b in seen if a == b and seen[a, b] >= least), key=lambda a: (-seen[a, a], a))
    out: list[tuple[tuple[int, str], dict[str, int]]] = []
    for a in often:
        if any(t.get(a[1]) == a[0] for _, t in out):
            continue
        table = {a[1]: a[0]}
        for b in often:
            if seen.get((min(a, b), max(a, b)), 0) >= least:
                table.setdefault(b[1], b[0])
        out.append((a, table))
    return out


def named(written: str, seed: tuple[int, str], table: dict[str, int], number: int) -> list[Transform]:
    """The transformations that a table amounts to: the encodings that explain it, the most of it first, or itself."""
    if written == "one":
        ways = [(Transform(w, CODECS[r]), {g for g, c in table.items() if CODECS[r].undo(g, w) == chr(c)}) for w in NARROW for r in READ if w != r]
    else:
        ways = [(Transform(written, CODECS[r]), {g for g, b in table.items() if CODECS[r].own.get(g) == b}) for r in READ]
    out: list[Transform] = []
    open_ = set(table)
    while len(open_) >= 2:
        t, agree = max(ways, key=lambda w: (not out and seed[1] in w[1], len(w[1] & open_)))
        # Two garbled texts may look like each other's letters; letters are believed on more than bytes.
        if len(agree & open_) < (6 if written == "one" else 2) or len(agree) < len(table) * (0.8 if written == "one" else 0.5):
            break
        out.append(t)
        open_ -= agree
    if out:
        return out
    # Letters take each other's place in two texts by chance; bytes don't.
    return [Transform(written, Reading(f"table-{number}", dict(table)))] if written != "one" and len(table) >= 6 else []


def learn_transforms(pairs: DataFrame, model, known: Sequence[Transform] = ()) -> list[Transform]:
    """Transformations that twins show, the most often seen first, beside those ``known``.

    Pairs of which a known transformation undoes something tell nothing more:
    two garbled texts may look like each other's letters. What is collected is how often two assignments were seen together, twice or
    more: bounded by the bytes and characters there are.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for kind, g, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if any(t.undo(r) is not None for t in known for r in (*g, *c)):
                    continue
                for written, told in aligned(kind, g, c, model.value):
                    seen.update((written, x, y) for k, x in enumerate(told) for y in told[k:])
        rows = [(w, x[0], x[1], y[0], y[1], n) for (w, x, y), n in seen.items()]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["w", "a", "x", "b", "y", "n"])

    counted = pairs.mapInArrow(tell, "w string, a int, x string, b int, y string, n long").groupBy("w", "a", "x", "b", "y").agg(F.sum("n").alias("n")).where("n >= 2")
    seen: dict[str, dict] = defaultdict(dict)
    for r in counted.collect():
        seen[r.w][(r.a, r.x), (r.b, r.y)] = r.n
    found = [(own[seed, seed], t) for written, own in sorted(seen.items()) for k, (seed, table) in enumerate(grown(own)) for t in named(written, seed, table, k)]
    out: dict[tuple[str, str], Transform] = {}
    for _, t in sorted(found, key=lambda f: -f[0]):
        out.setdefault((t.written, t.reading.name), t)
    return list(out.values())


def proven_stretches(pairs: DataFrame, learned: Sequence[Transform]) -> frozenset[tuple[str, str]]:
    """(name of the reading, character) of the stretches that ``pairs`` show; as many as there are characters at most."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = set()
        for b in batches:
            for g, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for t in learned:
                    if t.written == "utf-8" and all(t.undo(x) == y for x, y in zip(g, c)):
                        shown.update((t.reading.name, x) for y in c for x in y)
        rows = sorted(shown)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["read", "c"])

    return frozenset((r.read, r.c) for r in pairs.where("kind = 'utf-8'").mapInArrow(prove, "read string, c string").distinct().collect())


def _undone_twins(distinct: DataFrame, learned: Sequence[Transform], model) -> DataFrame:
    """(h, at, runs, runs2): sentences that a learned transformation, or several in turn, make another, cleaner sentence of the corpus."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        becomes: dict[str, list[str | None]] = {}

        def turned(run: str) -> list[str | None]:
            """What each transformation makes of a run, readable or None; kept, as runs recur."""
            if (x := becomes.get(run)) is None:
                x = [y if (y := t.undo(run)) is not None and y != run and all(map(_readable, y)) else None for t in learned]
                if len(becomes) < 200_000:
                    becomes[run] = x
            return x

        for b in batches:
            out: list[tuple[int, list[str], list[float]]] = []
            for k, runs in enumerate(b.column(2).to_pylist()):
                layer, known, first = [runs], {tuple(runs)}, True
                while layer:  # text may be garbled several times over; each layer of UTF-8 taken off makes it shorter
                    shorter = []
                    for x in layer:
                        options = [turned(r) for r in x]
                        for n, t in enumerate(learned):
                            if (first or t.written == "utf-8") and any(o[n] is not None for o in options):
                                new = [r if o[n] is None else o[n] for r, o in zip(x, options)]
                                if tuple(new) not in known:
                                    known.add(tuple(new))
                                    if (then := model.value.doubt(new)) < model.value.doubt(runs):
                                        out.append((k, new, then))
                                    if t.written == "utf-8":
                                        shorter.append(new)
                    layer, first = shorter, False
            at = pa.array([k for k, *_ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in range(3)], pa.array([x for _, x, _ in out], pa.list_(pa.string())), pa.array([d for *_, d in out], pa.list_(pa.float64()))], ["h", "at", "runs", "runs2", "doubt"])

    turned = distinct.select("h", "at", "runs").mapInArrow(turn, "h long, at array<int>, runs array<string>, runs2 array<string>, doubt array<double>")
    # Of the corpus only hashes go to meet what the few garbled sentences become.
    there = distinct.select(F.xxhash64("h", "at", "runs").alias("s"))
    met = turned.withColumn("s", F.xxhash64("h", "at", "runs2")).join(there, "s", "left_semi")
    return met.groupBy("h", "at", "runs").agg(F.min_by("runs2", F.struct("doubt", "runs2")).alias("runs2"))


def _whole_twins(distinct: DataFrame, learned: Sequence[Transform], model) -> DataFrame:
    """The same for sentences with characters that are gone: the cleanest one that has the same ASCII characters, others at the same places, and all that isn't gone."""
    lost = F.exists("runs", lambda r: r.rlike(r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]"))
    told = F.col("size") + 2 * F.size("at") >= _TELLING

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, kept = [], []
            for runs in b.column(2).to_pylist():
                gone.append([k for k, r in enumerate(runs) if _LOST.search(r)])
                kept.append([min([r, *(x for t in learned if (x := t.undo(r)) is not None)], key=lambda x: model.value.doubt([x])) for k, r in enumerate(runs) if k not in gone[-1]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.string()))], ["h", "at", "runs", "gone", "kept"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doubt = [model.value.doubt(r) for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(doubt, pa.list_(pa.float64()))], ["h", "at", "runs2", "doubt"])

    broken = distinct.where(lost & told).select("h", "at", "runs").mapInArrow(keep, "h long, at array<int>, runs array<string>, gone array<int>, kept array<string>")
    places = durable(broken.select("h", "at", "gone").distinct())
    near = distinct.where(~lost & told).select("h", "at", F.col("runs").alias("runs2")).join(_near(places.select("h", "at")), ["h", "at"], "left_semi")
    near = near.mapInArrow(judge, "h long, at array<int>, runs2 array<string>, doubt array<double>").join(places, ["h", "at"])
    near = near.withColumn("kept", F.filter("runs2", lambda r, k: ~F.array_contains("gone", k.cast("int"))))
    # A character that is gone left one mark, or one for each of its bytes at most.
    fits = F.forall(F.arrays_zip("runs", "runs2"), lambda x: (F.length(x["runs2"]) <= F.length(x["runs"])) & (F.length(x["runs"]) <= F.octet_length(x["runs2"])))
    both = broken.join(near, ["h", "at", "gone", "kept"]).where(fits)
    return both.groupBy("h", "at", "runs").agg(F.min_by("runs2", F.struct("doubt", "runs2")).alias("runs2"))


def _near(df: DataFrame) -> DataFrame:
    """``df``, which is written already, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def garbled(df: DataFrame, *, ident: Column, text: Column, untaught: bool = False) -> DataFrame:
    """(id, restored, n_stretches, lost, by_twin): the records of which some stretch is garbled.

    ``restored`` is the original as far as it can be had: sentences of which a
    clean twin is there are that twin, in others the stretches that a learned
    transformation explains are undone. ``lost`` tells that characters are gone
    for good, and no twin has them; ``by_twin`` that some sentence is a twin's.
    With ``untaught``, transformations between known encodings that no twin
    shows are tried as well, on more evidence; small corpora have few twins.

    Defined cases: null texts and ids are left out, texts in ASCII without
    entities are never garbled, repeated records come out each time; an empty
    table gives no rows; other columns are ignored whatever their names. A word
    in capitals that ends in an accented letter before punctuation is correct,
    as are unusual characters that undo to nothing readable.
    """
    sc = df.sparkSession.sparkContext
    texts = df.select(ident.alias("i"), text.cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    sentences = durable(_sentences(texts))
    distinct = durable(_formed(sentences.select("h", "size", "at", "runs").distinct()))
    model = sc.broadcast(_corpus_model(distinct))
    pairs = durable(twin_pairs(distinct))
    learned = learn_transforms(pairs.where("kind = 'utf-8'"), model)
    learned += learn_transforms(pairs.where("kind <> 'utf-8'"), model, learned)
    proven = proven_stretches(pairs, learned)
    rest = UNTAUGHT if untaught else ()
    twins = durable(_undone_twins(distinct, learned, model).withColumn("sure", F.lit(True)).unionByName(_whole_twins(distinct, learned, model).withColumn("sure", F.lit(False))))
    patch = F.struct("n", "h", "at", "runs", "runs2", "sure")
    patches = durable(sentences.drop("size").join(_near(twins), ["h", "at", "runs"]).groupBy("i").agg(F.collect_set(patch).alias("p")))
    kind = texts.schema["i"].dataType.simpleString()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo_all = Restorer(learned, model.value, proven, rest)
        for b in batches:
            rows = []
            for k, (t, patch) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                n, twin = 0, False
                if patch:
                    parts = _SENTENCE.split(t)
                    for p in sorted(patch, key=lambda p: p["sure"]):
                        plain, at, runs = dissect(parts[p["n"]]) if p["n"] < len(parts) else ("", [], [])
                        if (_hash(plain), at, runs) == (p["h"], p["at"], p["runs"]):
                            parts[p["n"]] = weave(plain, at, p["runs2"])
                            n, twin = n + max(1, sum(x != y for x, y in zip(runs, p["runs2"]))), True
                    t = "".join(parts)
                new, more, lost = undo_all(t)
                if n or more or lost:
                    # A mark of the byte order is no part of the text.
                    rows.append((k, new.removeprefix("\ufeff"), n + more, lost, twin))
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *[pa.array([r[c + 1] for r in rows], x) for c, x in enumerate(kinds)]], ["id", "restored", "n_stretches", "lost", "by_twin"])

    found = texts.where(F.col("t").rlike(_SUSPECT)).join(_near(patches), "i", "left").select("i", "t", "p")
    return found.mapInArrow(restore, f"id {kind}, restored string, n_stretches long, lost boolean, by_twin boolean")
