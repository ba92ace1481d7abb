"""Boards that are refreshed from new games only.

The state of a board is a table by season: additive counts per (season, entity), and a
ledger of the games in them.  A refresh takes the games of a log that the ledger does
not know, counts those, adds the counts to the state of their seasons and
overwrites these seasons' folders, no others.  Counts and ledger of a season are in one
folder, so a refresh that is run again, or again after a loss, counts no game twice."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtstats.operators.aggregate import season_and_career
from courtstats.session import checkpoint_dir


class BoardState:
    """``measures``: {name: aggregate expression whose values of two sets of games add up}
    (counts, sums); ``entity``: the columns a row of the board is for."""

    def __init__(self, spark: SparkSession, path: str, entity, measures: dict[str, Column], season: str = "season", game: str = "game"):
        self.spark, self.path, self.season, self.game = spark, path, season, game
        self.entity = [entity] if isinstance(entity, str) else list(entity)
        self.measures = measures

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p) and any(s.isDirectory() for s in fs.listStatus(p))

    def _read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def refresh(self, log: DataFrame) -> list:
        """Add the games of ``log`` that are not in the state; returns the seasons that changed."""
        known = self._exists()
        new = log
        if known:
            ledger = self._read().filter("kind = 'game'").select(self.season, self.game)
            new = log.join(ledger, [self.season, self.game], "left_anti")
        kinds = {c: t for c, t in log.dtypes}
        games = new.select(F.lit("game").alias("kind"), self.season, self.game, *[F.lit(None).cast(kinds[c]).alias(c) for c in self.entity],
                           *[F.lit(0).cast("long").alias(m) for m in self.measures]).distinct()
        counts = new.groupBy(self.season, *self.entity).agg(*[m.alias(n) for n, m in self.measures.items()]).select(
            F.lit("count").alias("kind"), self.season, F.lit(None).cast(kinds[self.game]).alias(self.game), *self.entity, *self.measures)
        base = f"{checkpoint_dir(self.spark).rstrip('/')}/board-{uuid.uuid4().hex}"
        games.unionByName(counts).write.parquet(base + "/new")
        fresh = self.spark.read.parquet(base + "/new")
        seasons = sorted(r[0] for r in fresh.select(self.season).distinct().collect())  # calendar years
        if seasons:
            if known:
                old = self._read().filter(F.col(self.season).isin(seasons))
                fresh = old.select(*fresh.columns).unionByName(fresh).groupBy("kind", self.season, self.game, *self.entity).agg(
                    *[F.sum(m).alias(m) for m in self.measures])
            # a table cannot be read and overwritten in one job
            fresh.write.parquet(base + "/merged")
            merged = self.spark.read.parquet(base + "/merged")
            (merged.repartition(self.season, F.pmod(F.xxhash64(*self.entity, self.game), F.lit(8))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(self.season).parquet(self.path))
        p = self.spark._jvm.org.apache.hadoop.fs.Path(base)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return seasons

    def board(self) -> DataFrame:
        """Season rows and career rows (season NULL, ``scope`` 'career') from the stored counts."""
        d = self._read().filter("kind = 'count'")
        return season_and_career(d, self.entity, self.season, [F.sum(m).alias(m) for m in self.measures])
