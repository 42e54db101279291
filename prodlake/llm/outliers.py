"""Quality rules by robust multivariate outliers.

Each document has a vector of transformed text statistics.  For every language and source a
minimum-covariance-determinant estimate describes the bulk of its documents: from three
deterministic starts, concentration steps keep the half of the documents nearest to the current
centre and estimate anew, until the determinant settles; the start with the smallest determinant
wins, is made consistent, re-weighted, and rejects documents whose squared Mahalanobis distance
lies beyond a chi-square quantile.

All of it is DataFrame work.  Statistics are whole thousandths, so every sum is exact and reruns
agree.  A step is one pass over the vectors: moments are summed per group, start and distance
bucket (map-side, so a hot source is no hot task), and the nearest half is a running sum over a
few hundred buckets.  Groups of fewer than ``LEAST_ROWS`` documents are pooled by language, then
altogether; a pool that is still smaller rejects nothing.

A small variance is added to each statistic (``FLOORS``): most clean documents have no symbols
or repeats at all, and without it the first one to have any would be an outlier.

Defined cases: a null or empty text has no words and fails the base rule; null languages and
sources are values of their own; repeated rows get equal verdicts; words are compared by 64-bit
hashes of five of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, packed, stored, words

SYMBOLS = "#*$%&|<>"  # fixed by the contract, as are the window and the base limits
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words

PRIOR = 50  # words added to each text, so that short ones are not extreme by chance
PRIOR_LENGTH = 6  # characters of such a word
UNIT = 1000  # statistics are counted in thousandths
# added standard deviations: word length, variety, symbols, repeats, repeated lines
FLOORS = (0.04, 0.03, 0.05, 0.10, 0.10)
LEAST_ROWS = 50
SHARE = 0.5  # of a group's documents that the estimate rests on
SETTLED = 0.01  # fall of the logarithm of a determinant that ends the steps
BUCKETS = 16  # per doubling of the squared distance
Z_WEIGHT, Z_REJECT = 1.96, 4.265  # normal quantiles 0.975 and 0.99999

P = len(FLOORS)
STATS = [f"v{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts over each whole text; ``row_key`` names equal rows."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", "lang", "source", F.xxhash64("doc_id", "lang", "source", "text").alias("row_key"),
        words(F.col("text")).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    keys = ["doc_id", "lang", "source", "row_key", "word_chars", "n_symbols"]
    last = F.size("w") - WINDOW
    five = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    counted = base.select(
        *keys, F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, five).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    keys += ["n_words", "n_distinct", "n_lines", "n_dup_lines"]
    # equal windows are neighbours once (hash, place) pairs are sorted; most texts have none and skip this
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    sorted_ = counted.select(*keys, F.when(repeats, F.sort_array(pairs)).alias("s"))
    h = lambda k: F.get("s", k)["h"]
    found = F.filter("s", lambda e, k: F.coalesce(h(k - 1) == e["h"], F.lit(False)) | F.coalesce(h(k + 1) == e["h"], F.lit(False)))
    placed = sorted_.select(*keys, F.sort_array(F.transform(found, lambda e: e["i"])).alias("at"))
    # each window covers five words, less what the one before it covers already
    covered = F.aggregate(
        "at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
    )["n"]
    return placed.select(*keys, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """Mean word length and variety of words by logarithm, rates by square root; all with the
    prior, in whole thousandths."""
    n = F.col("n_words") + PRIOR
    values = [
        F.log((F.col("word_chars") + PRIOR * PRIOR_LENGTH) / n),
        F.log(F.col("n_distinct") + PRIOR) / F.log(n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
    ]
    return [F.round(v * UNIT).cast("long").alias(name) for v, name in zip(values, STATS, strict=True)]


def _grouped(rows: DataFrame) -> DataFrame:
    """Add ``gid``, the group whose estimate judges a row; null where there is none."""
    sizes = rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < LEAST_ROWS, F.col("n")).otherwise(0)
    sizes = sizes.withColumn("of_lang", F.sum(small).over(Window.partitionBy("lang")))
    rest = F.when((F.col("n") < LEAST_ROWS) & (F.col("of_lang") < LEAST_ROWS), F.col("n")).otherwise(0)
    sizes = sizes.withColumn("of_all", F.sum(rest).over(Window.partitionBy()))
    # the level keeps a pool apart from a group whose source is null
    gid = (
        F.when(F.col("n") >= LEAST_ROWS, F.xxhash64(F.lit(2), F.struct(F.isnull("lang"), "lang", F.isnull("source"), "source")))
        .when(F.col("of_lang") >= LEAST_ROWS, F.xxhash64(F.lit(1), F.struct(F.isnull("lang"), "lang")))
        .when(F.col("of_all") >= LEAST_ROWS, F.xxhash64(F.lit(0)))
    )
    groups = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), gid.alias("gid"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(groups, same, "left").drop("_lang", "_source")


def _moments() -> list[Column]:
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(STATS)], *products]


_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]


def _factored(table: DataFrame, keep: list[str]) -> DataFrame:
    """Mean and Cholesky factor from moments (n, s*, q*): ``m``, ``l`` and ``logdet``."""
    n = F.col("n")
    out = table.withColumns({f"m{i}": F.col(f"s{i}") / n / UNIT for i in range(P)})
    out = out.withColumns({
        f"c{i}{j}": F.col(f"q{i}{j}") / n / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(FLOORS[i] ** 2) if i == j else 0.0)
        for i, j in PAIRS
    })
    return _cholesky(out, keep)


def _cholesky(table: DataFrame, keep: list[str]) -> DataFrame:
    out = table
    for j in range(P):
        done = [F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        out = out.withColumn(f"l{j}{j}", F.sqrt(reduce(lambda a, b: a - b, done, F.col(f"c{j}{j}"))))
        below = {}
        for i in range(j + 1, P):
            done = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
            below[f"l{i}{j}"] = reduce(lambda a, b: a - b, done, F.col(f"c{i}{j}")) / F.col(f"l{j}{j}")
        if below:
            out = out.withColumns(below)
    logdet = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") * 2 for i in range(P)])
    factor = F.array(*[F.col(f"l{i}{j}") for i, j in PAIRS])
    return out.select(*keep, F.array(*[F.col(f"m{i}") for i in range(P)]).alias("m"), factor.alias("l"), logdet.alias("logdet"))


def squared_distance(m: Column, l: Column) -> Column:  # noqa: E741
    """Squared Mahalanobis distance of the row's vector by forward substitution."""
    place = {pair: k for k, pair in enumerate(PAIRS)}
    solved: list[Column] = []
    for i in range(P):
        value = F.col(f"v{i}") / UNIT - m[i]
        for k in range(i):
            value = value - l[place[i, k]] * solved[k]
        solved.append(value / l[place[i, i]])
    return reduce(lambda a, b: a + b, [y * y for y in solved])


def _bucket(distance: Column) -> Column:
    return F.floor(F.log2(1 + distance) * BUCKETS).cast("int")


def chi_square(z: float, p: int = P) -> float:
    """Quantile of a chi-square of ``p`` degrees at the normal quantile ``z`` (Wilson-Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _starts(vectors: DataFrame) -> DataFrame:
    """Three first estimates per group: all rows; quartiles of each statistic alone; the
    correlation of values squeezed by a hyperbolic tangent."""
    everything = _factored(vectors.groupBy("gid").agg(*_moments()), ["gid"]).withColumn("start", F.lit(0))
    cuts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = vectors.groupBy("gid").agg(*[F.percentile(v, cuts).alias(f"p{i}") for i, v in enumerate(STATS)])
    scale = {i: F.get(f"p{i}", F.lit(2)) / UNIT - F.get(f"p{i}", F.lit(0)) / UNIT for i in range(P)}
    robust = quartiles.select(
        "gid", *[(F.get(f"p{i}", F.lit(1)) / UNIT).alias(f"m{i}") for i in range(P)],
        *[F.sqrt(F.pow(scale[i] / 1.349, 2) + FLOORS[i] ** 2).alias(f"d{i}") for i in range(P)],
    )
    alone = robust.withColumns({f"c{i}{j}": F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0) for i, j in PAIRS})
    alone = _cholesky(alone, ["gid"]).withColumn("start", F.lit(1))
    squeezed = vectors.join(robust, "gid").withColumns(
        {v: F.round(F.tanh((F.col(v) / UNIT - F.col(f"m{i}")) / F.col(f"d{i}")) * UNIT).cast("long") for i, v in enumerate(STATS)}
    )
    sums = squeezed.groupBy("gid").agg(*_moments()).join(robust, "gid")
    n = F.col("n")
    cov = {(i, j): F.col(f"q{i}{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n + (F.lit(UNIT**2 * 1e-4) if i == j else 0.0) for i, j in PAIRS}
    squeezed = sums.withColumns({
        f"c{i}{j}": cov[i, j] / F.sqrt(cov[i, i] * cov[j, j]) * F.col(f"d{i}") * F.col(f"d{j}") for i, j in PAIRS
    })
    squeezed = _cholesky(squeezed, ["gid"]).withColumn("start", F.lit(2))
    return everything.unionByName(alone).unionByName(squeezed)


def _by_distance(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """Moments per group, start and distance bucket: one pass over the vectors."""
    each = vectors.join(params, "gid").withColumn("bucket", _bucket(squared_distance(F.col("m"), F.col("l"))))
    return each.groupBy("gid", "start", "bucket").agg(*_moments())


def _nearest(buckets: DataFrame, share: float) -> DataFrame:
    """Moments of the nearest buckets that hold ``share`` of a group's rows."""
    within = Window.partitionBy("gid", "start")
    before = F.coalesce(F.sum("n").over(within.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = buckets.withColumn("before", before).withColumn("every", F.sum("n").over(within)).filter(F.col("before") < F.col("every") * share)
    return held.groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("bucket").alias("edge"))


def _consistent(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """``scale``: the median squared distance over its value for normal vectors, 1 at least.

    Statistics that are zero for most documents stay inside their floors, so the median may be
    smaller; that is no reason to narrow the estimate.
    """
    median = _nearest(_by_distance(vectors, params), 0.5)
    value = F.pow(F.lit(2.0), (F.col("edge") + 0.5) / BUCKETS) - 1
    return params.join(median.select("gid", "start", F.greatest(value / chi_square(0.0), F.lit(1.0)).alias("scale")), ["gid", "start"])


def estimates(vectors: DataFrame, share: float = SHARE) -> DataFrame:
    """Per ``gid`` the re-weighted estimate: ``m``, ``l`` and ``scale``.

    ``vectors`` holds gid and the statistics.  A start is settled once a step lowers the logarithm
    of its determinant by less than ``SETTLED``; the floors bound it from below, so all settle.
    The driver only learns how many still fall.
    """
    # a row per group and start; one file, since each step writes this small table
    params = _starts(vectors).select("gid", "start", "m", "l", F.lit(float("inf")).alias("logdet"), F.lit(True).alias("falls"))
    params, step = stored(params.coalesce(1), "starts"), 0
    while params.filter("falls").limit(1).count():
        nearest = _nearest(_by_distance(vectors, params.filter("falls").select("gid", "start", "m", "l")), share)
        now = _factored(nearest, ["gid", "start"]).select("gid", "start", F.struct("m", "l", "logdet").alias("now"))
        lower = F.coalesce(F.col("now.logdet") < F.col("logdet") - SETTLED, F.lit(False))
        taken = [F.when(lower, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in ("m", "l", "logdet")]
        params = stored(params.join(now, ["gid", "start"], "left").select("gid", "start", *taken, lower.alias("falls")).coalesce(1), f"step_{step}")
        step += 1
    best = params.groupBy("gid").agg(F.min(F.struct("logdet", "start", "m", "l")).alias("b")).select("gid", "b.start", "b.m", "b.l")
    raw = stored(_consistent(vectors, best).coalesce(1), "raw")
    inside = squared_distance(F.col("m"), F.col("l")) <= F.col("scale") * chi_square(Z_WEIGHT)
    sums = vectors.join(raw, "gid").filter(inside).groupBy("gid", "start").agg(*_moments())
    weighted = _factored(sums, ["gid", "start"])
    return stored(_consistent(vectors, weighted).coalesce(1), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of every row of ``docs``, ``base_failed``, ``distance`` and ``kept``."""
    rows = text_statistics(docs).withColumn("base_failed", base_failed())
    rows = stored(rows.select("*", *vector()), "statistics")
    rows = _grouped(rows)
    vectors = stored(rows.filter(~F.col("base_failed") & F.col("gid").isNotNull()).select("gid", *STATS), "vectors")
    fitted = estimates(vectors).select("gid", "m", "l", "scale")
    judged = rows.join(fitted, "gid", "left").withColumn("distance", squared_distance(F.col("m"), F.col("l")) / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(Z_REJECT), F.lit(True))
    return judged.withColumn("kept", kept).select(
        "doc_id", "lang", "source", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", "kept",
    )


def keep_inliers(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    kept = judge(docs).filter("kept").select(F.col("row_key").alias("kept_key")).distinct()
    rows = packed(docs, key=F.xxhash64("doc_id", "lang", "source", "text"))
    return rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi").select("row.*")
