"""Quality rules: robust multivariate outliers by minimum-covariance-determinant.

Each text becomes counts, and the counts four transformed statistics: log mean
word length and the square roots of the shares of symbols, of repeated lines
and of words in repeated windows.  Length is not among them: a long clean text
is no outlier, and short ones have a rule of their own.  Per language and
source, concentration steps seek the three quarters of the texts whose
covariance has the least determinant.  They begin at four estimates (medians
with median deviations, and the covariances of squashed values, of directions
and of the rows near the medians); after a few steps the start of least
determinant goes on until that stops falling.  After one reweighting, a text whose squared
Mahalanobis distance passes the chi-square quantile is rejected.

All of it is DataFrame expressions.  Texts are read once; the steps are
aggregates over a narrow staged table whose sums are combined before the
shuffle, so a source of any size is spread over all tasks.

Defined results: a null or blank text has no words and fails the base rule; a
null language or source is a group of its own; a group under ``LEAST_GROUP``
texts takes the estimate of its language, and a language under that the one of
the whole table; ties and repeated rows are each judged alike; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, stage

LEAST_WORDS, REPEAT_PERCENT = 50, 50
LEAST_GROUP = 100
SUBSET = 0.75
#: Steps of every start, and of the best start at most; those end when no group's
#: determinant falls by more than ``LEAST_FALL`` of itself.
FIRST_STEPS, MOST_STEPS, LEAST_FALL = 2, 30, 1e-3
STARTS = 4
REWEIGHT, CUTOFF = 0.975, 0.999
#: Least standard deviation of each statistic in texts of any length, for what
#: chance repeats; sampling noise at the text's own length comes on top.
FLOORS = {"word_length": 0.05, "symbols": 0.04, "lines": 0.05, "repeats": 0.08}
#: Words that one repeated window of three covers, in its two places.
WINDOW_WORDS = 6
NAMES = tuple(FLOORS)
P = len(NAMES)
#: Steps of the grid on which a group's subset is cut, per doubling of the distance.
GRID = 256
#: Estimates of groups are broadcast up to this size, and shuffled beyond it.
GROUP_BYTES, BROADCAST_BYTES = 400, 16 << 20


def chi2_below(x: float, dof: int) -> float:
    """Chi-square distribution function for an even number of degrees."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dof) < p else (low, mid)
    return high


def base_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blanks = F.lit(" \t\n\x0b\x0c\r")
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        text.alias("text"),
        F.xxhash64(text_col).alias("text_hash"),
        F.trim(text, blanks).alias("body"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "source", "text_hash",
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", WHITE)).alias("words"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("words")
    d = d.select(
        "doc_id", "lang", "source", "text_hash", "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )

    # Whole hashes with their places: however long the text, all 64 bits tell windows apart.
    def window(i: Column) -> Column:
        h = F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2))
        return F.struct(h.alias("hash"), i.cast("long").alias("place"))

    starts = F.sequence(F.lit(0), F.size("hashes") - 3)
    no = F.array().cast("array<struct<hash:long,place:long>>")
    d = d.withColumn("windows", F.when(F.size("hashes") >= 3, F.sort_array(F.transform(starts, window))).otherwise(no))
    d = d.drop("hashes")

    def repeated(x: Column, i: Column) -> Column:
        same = F.greatest(
            F.coalesce(F.get("windows", i - 1)["hash"] == x["hash"], F.lit(False)),
            F.coalesce(F.get("windows", i + 1)["hash"] == x["hash"], F.lit(False)),
        )
        return F.when(same, x["place"]).otherwise(F.lit(-1).cast("long"))

    found = F.sort_array(F.filter(F.transform("windows", repeated), lambda p: p >= 0))
    d = d.withColumn("found", found).drop("windows")
    covered = F.transform("found", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("found", i + 1) - p, F.lit(3))))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("found")


def _statistics() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "word_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def _noise() -> dict[str, Column]:
    """``v_x``: the least variance of each statistic at the text's length.

    The root of a share of Poisson counts has a variance of 1/4 over the number
    of places, times what one event adds to the count; words' lengths deviate
    by about half their mean.
    """
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    of = {"word_length": 0.25 / words, "symbols": 0.25 / chars, "lines": 0.25 / lines, "repeats": 0.25 * WINDOW_WORDS / words}
    return {f"v_{x}": F.lit(FLOORS[x] ** 2) + v for x, v in of.items()}


def _covariances(members: DataFrame, scale: float, keys: tuple[str, ...] = ("group",)) -> DataFrame:
    """Per group the means and the covariance of the rows whose statistics aren't null."""
    # Sums and one count: means of their own would make the compiled code too long.
    sums = [F.sum(x).alias(f"s_{x}") for x in NAMES]
    sums += [F.sum(F.col(x) * F.col(y)).alias(f"s{i}{j}") for i, x in enumerate(NAMES) for j, y in enumerate(NAMES[: i + 1])]
    g = members.groupBy(*keys).agg(F.count(NAMES[0]).alias("n"), *sums)
    means = [(F.col(f"s_{x}") / F.col("n")).alias(f"m_{x}") for x in NAMES]
    g = g.select(*keys, *means, *[(F.col(f"s{i}{j}") / F.col("n")).alias(f"p{i}{j}") for i in range(P) for j in range(i + 1)])
    cov = [
        ((F.col(f"p{i}{j}") - F.col(f"m_{x}") * F.col(f"m_{y}")) * F.lit(scale)).alias(f"c{i}{j}")
        for i, x in enumerate(NAMES)
        for j, y in enumerate(NAMES[: i + 1])
    ]
    return g.select(*keys, *[f"m_{x}" for x in NAMES], *cov)


#: Columns of an estimate: means and the lower triangle of the covariance.
FIT = (*(f"m_{x}" for x in NAMES), *(f"c{i}{j}" for i in range(P) for j in range(i + 1)))
#: The inverse of the covariance's factor, by which members are brought to unit variance.
INVERSE = tuple(f"k{i}{j}" for i in range(P) for j in range(i + 1))
#: The group's noise, the mean of that of all its members, which is one in every step.
NOISE = tuple(f"w_{x}" for x in NAMES)


def _shaped(fits: DataFrame) -> DataFrame:
    """With ``logdet`` and ``INVERSE`` of the covariance plus the group's noise."""
    d = _factors(fits, "w")
    for i in range(P):
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l{i}{k}") * F.col(f"k{k}{j}")
            d = d.withColumn(f"k{i}{j}", value / F.col(f"l{i}{i}"))
    logdet = F.lit(0.0)
    for i in range(P):
        logdet = logdet + 2 * F.log(F.col(f"l{i}{i}"))
    return d.withColumn("logdet", logdet).drop(*[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def _group_distance(d: DataFrame) -> DataFrame:
    """With ``d2`` under the covariance of which ``logdet`` is the determinant."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"k{i}{j}") * (F.col(NAMES[j]) - F.col(f"m_{NAMES[j]}"))
        d = d.withColumn(f"z{i}", z)
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return d.withColumn("d2", total)


def _factors(d: DataFrame, noise: str) -> DataFrame:
    """With ``l``, Cholesky factors of the covariance plus a noise of each statistic."""
    for i, x in enumerate(NAMES):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + F.col(f"{noise}_{x}") if i == j else F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The noise keeps the diagonal positive; rounding alone can't undo it.
            value = F.sqrt(F.greatest(rest, F.col(f"{noise}_{x}") / 4)) if i == j else rest / F.col(f"l{j}{j}")
            d = d.withColumn(f"l{i}{j}", value)
    return d


def _distance(d: DataFrame) -> DataFrame:
    """With ``d2``, the squared Mahalanobis distance under the covariance plus the row's own noise."""
    d = _factors(d, "v")
    for i, x in enumerate(NAMES):
        rest = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        d = d.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = F.col("z0") * F.col("z0")
    for i in range(1, P):
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return d.withColumn("d2", total)


def _with(members: DataFrame, groups: DataFrame, few: bool, keys: tuple[str, ...] = ("group",)) -> DataFrame:
    """Joined by group; where the groups are few (their count is checked) the members stay in place."""
    return members.join(F.broadcast(groups) if few else groups, list(keys))


def _nearest(members: DataFrame, share: float, few: bool, keys: tuple[str, ...] = ("group",)) -> DataFrame:
    """Each group's members of least distance, cut on a grid that holds at least ``share``."""
    cell = F.floor(F.log2(F.col("d2") + F.lit(1e-6)) * GRID).cast("int")
    members = members.withColumn("cell", cell)
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = members.groupBy(*keys, "cell").count()
    counts = counts.withColumn("so_far", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
    last = counts.filter(F.col("so_far") >= F.col("all") * share).groupBy(*keys).agg(F.min("cell").alias("last"))
    return _with(members, last, few, keys).filter("cell <= last").drop("last", "cell")


def _starts(members: DataFrame, few: bool) -> DataFrame:
    """``group, start``, an estimate each and the group's noise, about the medians in units of the median deviation."""
    middle = members.groupBy("group").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in NAMES])
    off = _with(members, middle, few)
    spread = off.groupBy("group").agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"s_{x}") for x in NAMES],
        *[F.first(f"m_{x}").alias(f"m_{x}") for x in NAMES],
        *[F.avg(f"v_{x}").alias(f"w_{x}") for x in NAMES],
    )
    unit = {f"u_{x}": F.sqrt(F.greatest(F.pow(F.col(f"s_{x}") * 1.4826, 2), F.col(f"w_{x}"))) for x in NAMES}
    spread = stage(spread.withColumns(unit).select("group", *[f"m_{x}" for x in NAMES], *NOISE, *unit), "quality-start")
    z = [(F.col(x) - F.col(f"m_{x}")) / F.col(f"u_{x}") for x in NAMES]
    d = _with(members, spread, few).select("group", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    norm = F.lit(0.0)
    for i in range(P):
        norm = norm + F.col(f"z{i}") * F.col(f"z{i}")
    norm = F.sqrt(norm)
    # Of a direction each part has a square of 1/P on average; scaled back to one.
    scale = math.sqrt(P) / F.greatest(norm, F.lit(1e-6))
    # Beyond twice the length that normal rows have on average a row counts for nothing.
    near = F.when(norm < 2 * math.sqrt(P), 1.0).otherwise(0.0)
    ways = ((1, F.tanh), (2, lambda x: x * scale), (3, lambda x: x * near))
    d = d.select("group", *[way(F.col(f"z{i}")).alias(f"y{k}{i}") for k, way in ways for i in range(P)])
    cells = [f"{k}_{i}{j}" for k, _ in ways for i in range(P) for j in range(i + 1)]
    sums = [F.sum(F.col(f"y{k}{i}") * F.col(f"y{k}{j}")).alias(f"s{k}_{i}{j}") for k, _ in ways for i in range(P) for j in range(i + 1)]
    found = d.groupBy("group").agg(F.count("*").alias("n"), *sums)
    found = found.select("group", *[(F.col(f"s{c}") / F.col("n")).alias(f"q{c}") for c in cells]).join(spread, "group")

    def estimate(k: int) -> Column:
        cells = []
        for i in range(P):
            for j in range(i + 1):
                units = F.col(f"u_{NAMES[i]}") * F.col(f"u_{NAMES[j]}")
                value = F.col(f"q{k}_{i}{j}") * units if k else units if i == j else F.lit(0.0)
                cells.append(value.alias(f"c{i}{j}"))
        return F.struct(F.lit(k).alias("start"), *cells)

    found = found.select("group", *[f"m_{x}" for x in NAMES], *NOISE, F.explode(F.array(*map(estimate, range(STARTS)))).alias("e"))
    return found.select("group", "e.start", *[f"m_{x}" for x in NAMES], *[f"e.c{i}{j}" for i in range(P) for j in range(i + 1)], *NOISE)


def least_determinant(members: DataFrame, subset: float, few: bool) -> DataFrame:
    """``group``, the estimate of each group's subset of least determinant, and its ``logdet``.

    ``members`` has ``group``, the statistics and their noises.  Distances and
    determinants are those of one covariance, the subset's plus the group's
    noise, so nearest members can't have a larger one but for the grid on which
    they are cut; of all that a group has seen the least is returned.  A group
    whose determinant has stopped falling takes no part in further steps.
    """
    keys = ("group", "start")
    # Makes the covariance of the nearest share of normal data that of all of it.
    scale = subset / chi2_below(chi2_quantile(subset, P), P + 2)
    fit = stage(_shaped(_starts(members, few)), "quality-fit")
    noise = fit.filter("start = 0").select("group", *NOISE)
    values = members.select("group", *NAMES)

    def step(of: DataFrame, fit: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        shape = fit.select(*keys, *[f"m_{x}" for x in NAMES], *INVERSE)
        near = _nearest(_group_distance(_with(of, shape, few, keys)).select(*keys, *NAMES, "d2"), subset, few, keys)
        return stage(_shaped(_covariances(near, scale, keys).join(noise, "group")), "quality-fit")

    each = values.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    seen = None
    for _ in range(FIRST_STEPS):
        fit = step(each, fit, keys)
        seen = fit if seen is None else seen.unionByName(fit)
    columns = [*FIT, *NOISE, *INVERSE, "logdet"]
    least = seen.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("f"))
    least = stage(least.select("group", "f.*", F.lit(True).alias("falls")), "quality-fit")
    for _ in range(MOST_STEPS):
        now = step(values, least.filter("falls"), ("group",))
        both = least.join(now.select("group", F.struct(*columns).alias("now")), "group", "left")
        fall = F.col("logdet") - F.col("now.logdet")
        taken = [F.when(fall > 0, F.col(f"now.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
        least = stage(both.select("group", *taken, F.coalesce(fall > LEAST_FALL, F.lit(False)).alias("falls")), "quality-fit")
        if not least.filter("falls").take(1):
            break
    return least.select("group", *FIT, "logdet")


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    subset: float = SUBSET,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``distance`` and ``text_hash`` of every row."""
    base = base_statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    keys = {
        2: F.to_json(F.struct(F.lit(2).alias("level"), "lang", "source")),
        1: F.to_json(F.struct(F.lit(1).alias("level"), "lang")),
        0: F.lit('{"level":0}'),
    }
    base = base.withColumn("base_failed", failed).withColumns(_statistics() | _noise())
    base = stage(base.withColumns({f"g{i}": k for i, k in keys.items()}), "quality-base")
    judged = base.filter("not base_failed")

    size = judged.groupBy("g2", "g1").agg(F.count("*").alias("n2"))
    size = size.withColumn("n1", F.sum("n2").over(Window.partitionBy("g1")))
    which = F.when(F.col("n2") >= LEAST_GROUP, F.col("g2")).when(F.col("n1") >= LEAST_GROUP, F.col("g1")).otherwise(keys[0])
    chosen = stage(size.select("g2", which.alias("chosen")), "quality-groups")
    needed = chosen.select(F.col("chosen").alias("group")).distinct()
    members = judged.select(*NAMES, *[f"v_{x}" for x in NAMES], F.explode(F.array("g2", "g1", "g0")).alias("group"))
    members = stage(members.join(needed, "group"), "quality-members")

    few = needed.count() * GROUP_BYTES * STARTS <= BROADCAST_BYTES
    fit = least_determinant(members, subset, few).drop("logdet")
    # Nulls, which no mean counts: a filter would be pushed below the distance and repeat it term by term.
    inner = F.col("d2") <= chi2_quantile(REWEIGHT, P)
    near = _distance(_with(members, fit, few)).select("group", *[F.when(inner, F.col(x)).alias(x) for x in NAMES])
    fit = stage(_covariances(near, 1.0), "quality-fit")
    by_source = chosen.join(fit.withColumnRenamed("group", "chosen"), "chosen").drop("chosen")

    out = _distance(base.join(F.broadcast(by_source) if chosen.count() * GROUP_BYTES <= BROADCAST_BYTES else by_source, "g2", "left"))
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(cutoff, P), F.lit(True))
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "distance", "lang", "source", "text_hash",
    )
    # Written, as a caller's filter on a verdict would repeat the distance term by term.
    return stage(out, "quality-verdicts")
