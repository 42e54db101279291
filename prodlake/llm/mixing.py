"""Mixing sources to target weights by balanced (cube-method) sampling.

Every document of a source has the same expected number of copies, ``target / source size``.
Its whole part is taken for certain.  The fractions go through the flight phase of the cube
method: they move along the null space of two constraints, the number of documents and the
number of words, until each is 0 or 1.  The flight runs in bounded blocks; a block leaves at
most two fractions, which meet again in the blocks of the next level.  The last block of a
source leaves at most two, the landing problem.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of
its own, last in order; repeated rows are separate units; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
LIMIT = 2.0  # times a source's own words
BLOCK = 4096  # documents of one flight
LONGEST = 256  # documents of a block that are settled first
SEED = 7
_CLOSE = 1e-9


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """One row per source: rank by code point (null last), documents with words, words, target.

    A source stops at ``limit`` times its words; what it leaves is shared by weight among the
    others.  With the sources in order of ``limit * size / weight`` the full ones come first,
    so the level at which the others stand follows from running sums over this table of sums.
    """
    per = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("documents")
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("source_size") * F.lit(limit)
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
    rising = Window.orderBy(cap / F.col("weight"), "rank")
    full = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    open_size = F.sum("source_size").over(every) * share - limit * F.coalesce(F.sum("source_size").over(full), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    per = per.withColumn("level", open_size / open_weight).withColumn("place", F.row_number().over(rising))
    stands = F.when(cap > F.col("weight") * F.col("level"), F.struct("place", "level"))
    per = per.withColumn("level", F.min(stands).over(every)["level"])
    target = F.coalesce(F.least(cap, F.col("weight") * F.col("level")), cap).cast("double")
    return per.select("source", "rank", "documents", "source_size", target.alias("target"))


def _settle_longest(p: np.ndarray, s: np.ndarray, draws: Iterator[float]) -> None:
    """Settle the longest documents while many others can make up for them.

    The direction is the unit vector of the document projected on the null space of both
    constraints, so that all open documents share the opposite move.
    """
    for i in range(min(len(p), LONGEST)):
        while 0 < p[i] < 1:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            if len(open_) < 4:
                return
            off = s[open_] - s[open_].mean()
            u = np.where(open_ == i, 1.0, 0.0) - 1 / len(open_)
            if off.any():
                u -= off * (s[i] - s[open_].mean()) / (off @ off)
            if abs(u[open_ == i][0]) < 1e-6:
                break  # it outweighs all others together
            now, d = p[open_], np.where(np.abs(u) < 1e-12, 1e-12, u)
            up = np.where(d > 0, (1 - now) / d, -now / d).min()
            down = np.where(d > 0, now / d, (now - 1) / d).min()
            moved = now + (up if next(draws) * (up + down) < down else -down) * u
            p[open_] = np.where((moved <= _CLOSE) | (moved >= 1 - _CLOSE), np.round(moved), moved)


def fly(part: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Flight phase, in place: at most two entries of ``part`` stay strictly between 0 and 1.

    Three fractions always have a direction that changes neither their sum nor their sum of
    words; a random end of it, drawn so that expectations stay, settles one at least.
    """
    draws = iter(rng.random(2 * len(part) + LONGEST).tolist())
    part[:] = np.where((part <= _CLOSE) | (part >= 1 - _CLOSE), np.round(part), part)
    _settle_longest(part, size, draws)
    p, s = part.tolist(), size.tolist()
    live: list[int] = []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for k, d in zip(live, u, strict=True):
            if d:
                ahead, behind = ((1 - p[k]) / d, p[k] / d) if d > 0 else (-p[k] / d, (p[k] - 1) / d)
                up, down = min(up, ahead), min(down, behind)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(live, u, strict=True):
            p[k] += step * d
            if p[k] <= _CLOSE or p[k] >= 1 - _CLOSE:
                p[k] = float(round(p[k]))
        live = [k for k in live if 0 < p[k] < 1]
    part[:] = p


def land(part: np.ndarray, rng: np.random.Generator) -> None:
    """Landing phase: systematic sampling of the fractions left keeps the number of documents
    within one and every expectation."""
    left = np.flatnonzero((part > 0) & (part < 1))
    ends = rng.random() + np.concatenate([[0.0], np.cumsum(part[left])])
    part[left] = np.diff(np.floor(ends))


def _flight(last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([SEED, *[int(k) for k in key]])
        # long documents first, so that the fractions left at the end are small in words
        units = units.sort_values(["size", "lot", "doc_id"], ascending=[False, True, True], kind="stable")
        part = units["part"].to_numpy(float).copy()
        fly(part, units["size"].to_numpy(float), rng)
        if last:
            land(part, rng)
        return units.assign(part=part)

    return run


def cube_sample(units: DataFrame, most: int, block: int = BLOCK) -> Iterator[DataFrame]:
    """Settle the fractions ``part`` of ``units`` (rank, doc_id, size, ...); yields each level's
    settled rows.  ``most`` is the largest number of units of one rank."""
    level, blocks = 0, -(-most // block)
    while True:
        of_rank = F.ceil(F.col("documents") / F.lit(block)) if level == 0 else F.lit(blocks)
        key = F.pmod(F.xxhash64(F.lit(level), "lot"), F.greatest(of_rank, F.lit(1)))
        flown = units.withColumn("block", key.cast("long")).withColumn("level", F.lit(level))
        flown = flown.groupBy("rank", "block", "level").applyInPandas(_flight(blocks <= 1), flown.schema)
        flown = stored(flown, f"flight_{level}").drop("block", "level")
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        yield flown.filter(~open_)
        if blocks <= 1:
            return
        units, level, blocks = flown.filter(open_), level + 1, -(-2 * blocks // block)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` is how often the mix repeats the document, ``taken`` the words this makes.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sized, weights, share, limit).coalesce(1), "targets")
    per_copy = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    units = units.drop("of").withColumn("sure", F.floor(per_copy + _CLOSE)).withColumn(
        "part", F.greatest(per_copy - F.col("sure"), F.lit(0.0))
    )
    moving = (F.col("size") > 0) & (F.col("part") > _CLOSE)
    lot = F.xxhash64(F.lit(SEED), "doc_id", "size")
    done = units.filter(~moving).withColumn("part", F.lit(0.0))
    most = targets.agg(F.max("documents")).first()[0] or 0
    for settled in cube_sample(units.filter(moving).withColumn("lot", lot), most, block):
        done = done.unionByName(settled.drop("lot"))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("part").cast("long")).otherwise(0)
    return done.select(
        "doc_id", "source", "size", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it; columns as in ``docs``.

    Rows that agree in doc_id, source and size are told apart by nothing that counts here, so
    each of them gets the copies of one of these rows.  Numbering them moves the texts once more
    and is left out where no two rows agree.
    """
    key = ["doc_id", "source", "size"]
    taken = stored(mix(docs, **options).select(*key, "copies"), "copies")
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=word_count(F.col("text")))
    if taken.groupBy(*key).count().filter("count > 1").limit(1).count():
        of_key = Window.partitionBy(*key)
        taken = taken.withColumn("n", F.row_number().over(of_key.orderBy("copies")))
        rows = rows.withColumn("n", F.row_number().over(of_key.orderBy(F.xxhash64("row"))))
        key.append("n")
    taken = taken.filter("copies > 0").select(*[F.col(c).alias(f"of_{c}") for c in taken.columns])
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    mixed = rows.join(taken, reduce(lambda a, b: a & b, same))
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "of_copies"))).select("row.*")
