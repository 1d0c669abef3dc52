"""The nightly load as ordered steps, each of which may run again without harm."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.embedding import embed
from orrery.operators.comovement import edges_blocked
from orrery.operators.panel import closes, panel
from orrery.operators.records import insert_new, merge_latest
from orrery.sources.readers import audit_log
from orrery.sources.sinks import merge_days, publish, published, replace_snapshots


@dataclass(frozen=True)
class Step:
    """``run`` returns what it did; it is left out if one of ``after`` failed or was left out."""

    name: str
    run: Callable[[], str]
    after: Sequence[str] = field(default_factory=tuple)


def run_steps(steps: Sequence[Step]) -> tuple[list[str], list[str]]:
    """(done, errors) of the steps in order; a failure doesn't keep independent steps from running."""
    done, errors, failed = [], [], set()
    for s in steps:
        if blocked := [a for a in s.after if a in failed]:
            failed.add(s.name)
            errors.append(f"{s.name}: left out, as {', '.join(blocked)} failed")
            continue
        try:
            done.append(f"{s.name}: {s.run()}")
        except Exception as e:  # noqa: BLE001
            failed.add(s.name)
            errors.append(f"{s.name}: {e}")
    return done, errors


def merge_bars(spark: SparkSession, fresh: DataFrame, path: str) -> str:
    """Merge ``fresh`` bars (symbol, timestamp, ...) into the table at ``path``, day by day."""
    merge_days(fresh.where("timestamp IS NOT NULL"), path, ["symbol", "timestamp"], F.to_date("timestamp"), merge_latest)
    return f"bars up to {spark.read.parquet(path).agg(F.max('timestamp')).first()[0]}"


def merge_news(spark: SparkSession, articles: DataFrame, tags: DataFrame, root: str) -> str:
    """Articles and tags that aren't there yet, as a new version of either table."""
    out = []
    for name, fresh, keys in (("articles", articles, ["id"]), ("tags", tags, ["article_id", "symbol"])):
        there = published(spark, f"{root}/{name}")
        new = insert_new(fresh.limit(0) if there is None else there, fresh, keys)
        publish(new if there is None else there.unionByName(new), f"{root}/{name}")
        out.append(f"{published(spark, f'{root}/{name}').count()} {name}")
    return ", ".join(out)


def add_vectors(spark: SparkSession, root: str) -> str:
    """Vectors of the articles that have none yet."""
    a, there = published(spark, f"{root}/articles"), published(spark, f"{root}/vectors")
    new = a if there is None else a.join(there.select("id"), "id", "left_anti")
    new = new.select("id", embed(F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit("")))).alias("vec"))
    publish(new if there is None else there.unionByName(new), f"{root}/vectors")
    return f"{published(spark, f'{root}/vectors').count()} vectors"


def extract_fires(spark: SparkSession, log: DataFrame, kind: str, path: str) -> str:
    """Candidates out of an audit log, as a table."""
    publish(audit_log(log, kind), path)
    return f"{published(spark, path).count()} candidates"


def snapshot_comovement(spark: SparkSession, bars_path: str, path: str, *, trail: int = 250, min_abs_corr: float = 0.5) -> str:
    """Co-movement over the ``trail`` sessions before the last one, as that date's snapshot; snapshots of other dates stay."""
    b = spark.read.parquet(bars_path)
    p = panel(closes(b, symbol=F.col("symbol"), day=F.to_date("timestamp"), price=F.col("close")))
    last = p.agg(F.max(F.struct("i", "d")).alias("x")).first().x
    if last is None or last.i < trail:
        raise ValueError(f"only {last.i if last else 0} sessions precede the last one, need {trail}")
    w = p.where((F.col("i") >= last.i - trail) & (F.col("i") < last.i)).select("symbol", "i", "r")
    replace_snapshots(edges_blocked(w, first=last.i - trail, trail=trail, min_abs_corr=min_abs_corr).withColumn("as_of", F.lit(last.d)), path, "as_of")
    return f"snapshot of {last.d}"


def nightly(spark: SparkSession, fresh: DataFrame, root: str, *, trail: int = 250, log: DataFrame | None = None, news: tuple[DataFrame, DataFrame] | None = None) -> tuple[list[str], list[str]]:
    """Candidates from ``log``, bars, the snapshot made of them, ``news`` (articles, tags), and the articles' vectors."""
    bars, snaps = f"{root}/long_bars.parquet", f"{root}/moves_with.parquet"
    steps = [Step("bars", lambda: merge_bars(spark, fresh, bars)), Step("comovement", lambda: snapshot_comovement(spark, bars, snaps, trail=trail), ["bars"])]
    if log is not None:
        steps.insert(0, Step("fires", lambda: extract_fires(spark, log, "alert", f"{root}/fires")))
    if news is not None:
        steps += [Step("news", lambda: merge_news(spark, *news, root)), Step("vectors", lambda: add_vectors(spark, root), ["news"])]
    return run_steps(steps)
