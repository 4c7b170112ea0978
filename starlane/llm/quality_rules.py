"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Everything is DataFrame expressions.  ``text_statistics`` measures each whole
text in its own row, without a shuffle; the statistics (a few numbers a
document) are written once, and all later steps read only those.

The base rule rejects documents of fewer than ten words, and those in which
repeated 5-word windows cover more than a fifth of the words.  The others are
judged per language and source.  A statistic vector is

* the mean word length,
* the square roots of the symbols, capitals and punctuation marks per
  character and of the share of words in repeated windows,

each ratio smoothed by ``PRIOR`` ordinary characters, so that short texts are
not judged on a handful of them.  A group of at least ``MIN_GROUP`` documents
has an estimate of its own; the documents of a smaller one are judged by the
estimate of their whole language, and of a smaller language by that of the
whole corpus (large groups included), so every document is judged.

An estimate starts from medians and absolute deviations, and from the documents
on either side of the median of each component: a cluster that stands apart in
some component is outside one of those halves.  As in the fast algorithm for
the minimum covariance determinant, the starts are screened on a sample (about
``SAMPLE`` documents of each group, drawn at random when the vectors are written)
and the ``BEST`` by determinant go on; from there on, concentration steps, scales
and re-weighting are over all documents.  A concentration step orders the
documents by Mahalanobis distance, keeps the nearer half and takes their mean
and covariance again; they end when the determinant falls no more, and the
least determinant counts.  One aggregation does a step: documents are summed by
the ``FINE`` part of an octave that their distance is in, and the parts up to the
one that reaches half of the group are added up.  The covariance is then scaled so that the median
distance is what a normal vector would have, re-estimated once over all
documents within the 97.5 % quantile, and documents beyond ``CUTOFF`` go.

A hot source costs nothing extra: groups are only ever aggregated (partial sums,
quantile sketches), and the estimates are one short row each.

Null text counts as empty; null language or source is a group of its own.
A corpus of fewer than ``LEAST`` documents past the base rule has no estimate, and
they are kept.  Repeated rows are judged alike.  Extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlane.session import read_table_of, remove_path, write_and_read, write_table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 10
REPEAT_PERCENT = 20
PRIOR = 200
MIN_GROUP = 100
SAMPLE = 2000  # documents of a group, about, on which the starts are screened
STEPS = 30  # at most; large groups end at SETTLED
SETTLED = 1e-3  # fall of the logarithm of the determinant at which a step is the last
SCREEN, BEST = 3, 2  # after so many steps only so many starts of a group go on
FINE, OCTAVES = 32, 4  # parts of an octave, and octaves on either side of the last median
#: Least standard deviation of each component: many texts have none of a mark.
FLOORS = (0.25, 0.04, 0.05, 0.05, 0.06)
D = len(FLOORS)
LEAST = 2 * (D + 1)
#: Quantiles of the chi-squared distribution with five degrees of freedom.
CHI_MEDIAN, CHI_975 = 4.3515, 12.8325
CUTOFF = 45.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once in each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words covered by the windows (hashes by position) that occur twice."""
    n = F.size(windows)

    def gaps(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(places, k + 1), p + 5) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        at = lambda k: F.get(ordered, k)
        same = lambda i, k: at(i)["h"].eqNullSafe(at(k)["h"])
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), at(k)["at"]))
        return F.array_sort(F.filter(places, lambda p: p.isNotNull()))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    counted = _let(_let(ordered, repeated), gaps)
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(counted)


def _repeat_words(words: Column) -> Column:
    def windows(hashes: Column) -> Column:
        part = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), part)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 5, F.lit(0)).otherwise(_let(_let(hashes, windows), _covered))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns as a struct ``row``, and the statistics of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in keep]
    packed = docs.select(F.struct(*quoted).alias("row"), text.alias("text"))
    words = F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), "")
    counted = _let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    measured = packed.select(
        "row",
        counted.alias("w"),
        F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"),
        _duplicate_lines(F.col("text")).alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[!?;:_=~^]")).alias("n_marks"),
    )
    as_long = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")]
    return measured.select("row", "w.*", "n_symbols", "n_dup_lines", "n_upper", "n_marks").select("row", *as_long)


def _vector() -> list[Column]:
    chars = F.col("word_chars") + PRIOR
    return [
        (F.col("word_chars") + PRIOR) / (F.col("n_words") + PRIOR / 5),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_upper") / chars),
        F.sqrt(F.col("n_marks") / chars),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + PRIOR / 5)),
    ]


X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
ESTIMATE = [*[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS]]


def _groups(stats: DataFrame) -> DataFrame:
    """For each language and source: the group whose estimate judges it
    (``grp``), and all groups whose estimates it takes part in (``parts``)."""
    sizes = stats.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = write_and_read(sizes, "quality-sizes")
    whole = sizes.groupBy(F.col("lang").alias("wl")).agg(F.sum("n").alias("in_lang"), F.min("n").alias("least"))
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    own, language, corpus = name("lang", "source"), name("lang"), F.lit("{}")
    of_language = F.col("in_lang") >= MIN_GROUP
    named = sizes.join(whole, F.col("wl").eqNullSafe(F.col("lang")))
    some = sizes.agg(F.sum("n")).first()[0] or 0
    asked = some >= LEAST and not named.filter(~of_language).isEmpty()
    judged_by = F.when(F.col("n") >= MIN_GROUP, own).when(of_language, language).when(F.lit(asked), corpus)
    parts = F.array(
        F.when(F.col("n") >= MIN_GROUP, own),
        F.when(of_language & (F.col("least") < MIN_GROUP), language),
        F.when(F.lit(asked), corpus),
    )
    return named.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), judged_by.alias("grp"), F.array_compact(parts).alias("parts"))


def _substitution() -> list[str]:
    """Forward substitution: ``z`` so that the factor times ``z`` is the point less the mean."""
    rest = [f"{X[i]} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i)) for i in range(D)]
    return [f"({r}) / l{i}{i} AS z{i}" for i, r in enumerate(rest)]


def _factors() -> list[str]:
    """Lower Cholesky factor of the covariance ``c..``, no component of which is below its floor."""
    out = []
    for j in range(D):
        for i in range(j, D):
            rest = f"c{i}{j}" + (f" + {FLOORS[i] ** 2!r}D" if i == j else "")
            rest += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"sqrt({rest}) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return out


LOG_DET = "2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(D)) + ")"


def _distance(points: DataFrame, estimate: DataFrame, how: str = "inner", kept: list[str] | None = None) -> DataFrame:
    """Add the squared Mahalanobis distance ``d2``, and the ``kept`` columns of the estimate."""
    square = "(" + " + ".join(f"z{i} * z{i}" for i in range(D)) + ") / scale AS d2"
    out = points.join(estimate, "grp", how).selectExpr(*points.columns, *(kept or []), "scale", *_substitution())
    return out.selectExpr(*points.columns, *(kept or []), square)


def _factored(moments: DataFrame, kept: list[str]) -> DataFrame:
    """Factor and log-determinant of covariances."""
    factored = moments.selectExpr(*kept, *[f"m{i}" for i in range(D)], *_factors())
    return factored.selectExpr(*kept, *ESTIMATE, "1.0D AS scale", f"{LOG_DET} AS det")


def _estimate(points: DataFrame, by: list[str]) -> DataFrame:
    """Mean, factor and log-determinant of the points of each ``by``."""
    sums = [F.expr(f"avg({X[i]}) AS m{i}") for i in range(D)]
    sums += [F.expr(f"covar_pop({X[i]}, {X[j]}) AS c{i}{j}") for i, j in PAIRS]
    return _factored(points.groupBy(*by).agg(*sums), by)


def _starts(points: DataFrame) -> DataFrame:
    """Coordinate-wise medians and absolute deviations (start 0), and the
    estimates of the documents on either side of each median."""
    middle = points.groupBy("grp").agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(X)])
    off = points.join(middle, "grp").groupBy("grp", *[f"m{i}" for i in range(D)])
    spread = off.agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, x in enumerate(X)])
    factors = [
        (F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS
    ]
    medians = spread.select("grp", F.lit(0).alias("start"), *[f"m{i}" for i in range(D)], *factors, F.lit(1.0).alias("scale"))
    sides = [F.when(F.col(x) <= F.col(f"m{i}"), 2 * i + 1) for i, x in enumerate(X)]
    sides += [F.when(F.col(x) >= F.col(f"m{i}"), 2 * i + 2) for i, x in enumerate(X)]
    halves = points.join(middle, "grp").select("grp", *X, F.explode(F.array_compact(F.array(*sides))).alias("start"))
    return medians.selectExpr("*", f"{LOG_DET} AS det").unionByName(_estimate(halves, ["grp", "start"]))


#: What an estimate carries between concentration steps: its last median
#: distance, and whether its determinant has settled.
STEP = ["grp", "start", *ESTIMATE, "scale", "det", "middle", "settled"]


def _step(points: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step from each row of ``estimate``."""
    means = [f"m{i}" for i in range(D)]
    by = ["grp", "start", "middle", "det", *means]
    measured = _distance(points, estimate, kept=by[1:])
    octave = f"greatest(least(log2(greatest(d2, 1e-30D) / middle), {OCTAVES}D), -{OCTAVES}D)"
    off = [f"{X[i]} - m{i} AS y{i}" for i in range(D)]
    measured = measured.selectExpr(*by, *off, f"CAST(floor({octave} * {FINE}) AS INT) AS part")
    names = [*[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i, j in PAIRS]]
    sums = [f"sum(y{i})" for i in range(D)] + [f"sum(y{i} * y{j})" for i, j in PAIRS]
    parts = measured.groupBy(*by, "part").agg(F.count("*").alias("n"), *[F.expr(f"{v} AS {c}") for v, c in zip(sums, names, strict=True)])
    # At most 2 * FINE * OCTAVES + 1 rows of a group and start are ordered here.
    of = "OVER (PARTITION BY grp, start"
    below = f"coalesce(sum(n) {of} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below"
    near = parts.selectExpr("*", below, f"sum(n) {of}) AS whole").filter("2 * below < whole")
    reached = f"pow(2.0D, (max(part) + 0.5D) / {FINE}) * middle AS reached"
    total = near.groupBy(*by).agg(*[F.expr(f"sum({c}) AS {c}") for c in ("n", *names)], F.expr(reached))
    moments = total.selectExpr(
        "grp",
        "start",
        "reached",
        "det AS before",
        *[f"m{i} + s{i} / n AS m{i}" for i in range(D)],
        *[f"p{i}{j} / n - (s{i} / n) * (s{j} / n) AS c{i}{j}" for i, j in PAIRS],
    )
    done = _factored(moments, ["grp", "start", "reached", "before"])
    return done.selectExpr("grp", "start", *ESTIMATE, "scale", "det", "reached AS middle", f"before - det <= {SETTLED!r}D AS settled")


class _Table:
    """A written table whose older versions are removed."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.name, self.path = df.sparkSession, name, None
        self.put(df)

    def put(self, df: DataFrame) -> None:
        path = write_table(df, self.name)
        self.drop()
        self.path, self.df = path, read_table_of(self.spark, path, df.schema)

    def drop(self) -> None:
        if self.path:
            remove_path(self.spark, self.path)


def _concentrate(points: DataFrame, table: _Table, steps: int, least: int) -> None:
    """Concentration steps for the rows of ``table``: ``least`` of them, and
    then on until they have settled."""
    for done in range(1, steps + 1):
        now = _step(points, table.df.filter("NOT settled"))
        if done < least:
            now = now.withColumn("settled", F.lit(False))
        table.put(now.unionByName(table.df.filter("settled")))
        if done >= least and table.df.filter("NOT settled").isEmpty():
            break


def _best(table: _Table, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("grp").orderBy("det", "start"))
    return table.df.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def _concentrated(points: DataFrame, sample: DataFrame) -> _Table:
    """The estimate of each group with the least determinant, of those that
    concentration steps reach from its starts."""
    more = [F.lit(CHI_MEDIAN).alias("middle"), F.lit(False).alias("settled")]
    table = _Table(_starts(sample).select("*", *more).select(STEP), "quality-step")
    _concentrate(sample, table, SCREEN, SCREEN)
    table.put(_best(table, BEST).withColumn("settled", F.lit(False)))
    _concentrate(sample, table, STEPS, 1)
    table.put(table.df.withColumn("settled", F.lit(False)))
    _concentrate(points, table, STEPS, 2)
    table.put(_best(table, 1).drop("middle", "settled"))
    return table


def robust_estimates(points: DataFrame) -> DataFrame:
    """One row per group of ``points(grp, x.., draw)``: mean, Cholesky factor and
    scale of its MCD estimate; ``draw`` is a random number below 1."""
    sizes = points.groupBy("grp").agg(F.count("*").alias("size"))
    low = points.join(sizes, "grp").filter(F.col("draw") * F.col("size") <= SAMPLE).select("grp", *X)
    sample = _Table(low, "quality-sample")
    table = _concentrated(points, sample.df)
    sample.drop()

    def rescale() -> None:
        middle = _distance(points, table.df).groupBy("grp").agg(F.percentile_approx("d2", 0.5).alias("half"))
        scale = F.greatest(F.col("half") / CHI_MEDIAN, F.lit(1.0))
        table.put(table.df.drop("scale").join(middle, "grp").withColumn("scale", scale).drop("half"))

    rescale()
    table.put(_estimate(_distance(points, table.df).filter(F.col("d2") <= CHI_975), ["grp"]))
    rescale()
    return table.df.drop("start", "det")


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``, the statistics, ``base_failed``, the
    squared distance ``d2`` (null where no estimate applies) and ``kept``."""
    columns = docs.columns if keep is None else keep
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = text_statistics(docs, list(dict.fromkeys([*columns, "lang", "source"])))
    stats = stats.withColumn("base_failed", failed).withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")})
    stats = write_and_read(stats, "quality-stats")
    groups = write_and_read(_groups(stats), "quality-groups")
    same = F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs"))
    stats = stats.join(groups, same, "left").drop("gl", "gs")
    for name, value in zip(X, _vector(), strict=True):
        stats = stats.withColumn(name, F.when(~F.col("base_failed"), value))
    points = stats.filter("NOT base_failed").select(F.explode("parts").alias("grp"), *X, F.rand(17).alias("draw"))
    points = _Table(points, "quality-points")
    estimates = robust_estimates(points.df)
    points.drop()
    judged = _distance(stats.drop("parts"), estimates, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return judged.withColumn("kept", kept).drop("grp", "lang", "source", *X)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    return judge(docs).filter("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
