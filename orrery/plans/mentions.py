"""Listed companies' names in filing passages: every mention, with the text around it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import passages
from orrery.functions.columns import norm_symbol
from orrery.sources.tables import table

#: Where a company's short name ends in its title (fixed values).
TITLE_END = r"[,/]| Inc| Corp| Co\b| Ltd| plc| Holdings| Group"
#: Characters that a window has to either side of a name, and by which windows of one company are the same (fixed values).
RADIUS, SAME = 420, 80
#: As many names may every task hold; a longer vocabulary is an error.
MAX_NAMES = 200_000
_WORD = re.compile(r"\w+", re.ASCII)


def short_name(title: Column) -> Column:
    """A title up to its legal form; null if less than 4 characters are left."""
    name = F.trim(F.get(F.split(title, TITLE_END, 2), F.lit(0)))
    return F.when(F.length(name) >= 4, name)


class Vocabulary:
    """Names by their first word, longest first."""

    def __init__(self, names: Sequence[str]):
        self.by_word: dict[str, list[str]] = defaultdict(list)
        for n in sorted(names, key=lambda n: (-len(n), n)):
            if m := _WORD.match(n):
                self.by_word[m.group()].append(n)

    def mentions(self, text: str) -> list[tuple[int, str]]:
        """(place, name) from left to right: at each place the longest name that ends with a word, none overlapping one before it."""
        out, free = [], 0
        for m in _WORD.finditer(text):
            if m.start() >= free:
                for n in self.by_word.get(m.group(), ()):
                    end = m.start() + len(n)
                    if text.startswith(n, m.start()) and bool(_WORD.match(text[end - 1])) != bool(_WORD.match(text[end : end + 1])):
                        out.append((m.start(), n))
                        free = end
                        break
        return out


def mentions(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, at, name): every mention of ``names`` in ``texts`` (id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(Vocabulary(names))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, at, n) for k, t in enumerate(b.column(1).to_pylist()) for at, n in shared.value.mentions(t)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["id", "at", "name"])

    return texts.where("text IS NOT NULL").select("id", "text").mapInArrow(find, f"id {texts.schema['id'].dataType.simpleString()}, at int, name string")


def x6_vocabulary(spark, sf_dir):
    """Every mention of another listed company by its whole short name: one word needs a designator behind it; windows that begin alike count once a company."""
    ref = table(spark, sf_dir, "company_ref").select(norm_symbol(F.col("ticker")).alias("cp"), short_name(F.col("title")).alias("name")).where("name IS NOT NULL AND cp IS NOT NULL")
    ref = ref.groupBy("name").agg(F.min("cp").alias("cp"))
    listed = ref.limit(MAX_NAMES + 1).collect()
    if len(listed) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    m = table(spark, sf_dir, "filing_mention").select("id", norm_symbol(F.col("filer_ticker")).alias("filer"), F.col("passage").alias("text"))
    hit = mentions(m, [r.name for r in listed]).join(F.broadcast(spark.createDataFrame([(r.name, r.cp) for r in listed], "name string, cp string")), "name").join(m, "id")
    after = F.substr("text", F.col("at") + F.length("name") + 1, F.lit(24))
    start = F.greatest(F.col("at") - RADIUS, F.lit(0))
    kept = hit.where(~F.col("cp").eqNullSafe(F.col("filer")) & (F.contains("name", F.lit(" ")) | passages.designated(after)))
    near = F.substr("text", start + 1, F.least(F.lit(SAME), F.col("at") + F.length("name") + RADIUS - start))
    return kept.select("id", "name", "cp", "at", near.alias("near")).groupBy("id", "cp", "near").agg(F.min(F.struct("at", "name")).alias("m")).select("id", "cp", "m.name", "m.at", "near")


QUERIES = {"x6_vocabulary": x6_vocabulary}
ORACLE = {
    "x6_vocabulary": rf"""WITH ref AS (SELECT name, min(cp) AS cp FROM (SELECT upper(trim(ticker)) AS cp, trim(string_split_regex(title, '[,/]| Inc| Corp| Co\b| Ltd| plc| Holdings| Group')[1]) AS name FROM company_ref) WHERE length(name) >= 4 GROUP BY name),
pat AS (SELECT '\b(?:' || string_agg(regexp_escape(name), '|' ORDER BY length(name) DESC, name) || ')\b' AS re FROM ref),
m AS (SELECT id, upper(trim(filer_ticker)) AS filer, passage, regexp_extract_all(passage, re) AS hits, string_split_regex(passage, re) AS gaps FROM filing_mention, pat WHERE passage IS NOT NULL),
h AS (SELECT id, filer, passage, unnest(list_transform(range(1, len(hits) + 1), lambda k: {{'name': hits[k], 'pos': CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS INTEGER)}})) AS x FROM m),
n AS (SELECT id, filer, passage, x.name AS name, x.pos AS pos, cp FROM h JOIN ref ON ref.name = x.name),
k AS (SELECT id, cp, name, pos, substring(passage, greatest(pos - 420, 0) + 1, least(80, pos + length(name) + 420 - greatest(pos - 420, 0))) AS near FROM n
  WHERE cp IS DISTINCT FROM filer AND (contains(name, ' ') OR regexp_matches(substring(passage, pos + length(name) + 1, 24), '{passages.DESIGNATOR}')))
SELECT id, cp, arg_min(name, pos) AS name, min(pos) AS "at", near FROM k GROUP BY id, cp, near""",
}
