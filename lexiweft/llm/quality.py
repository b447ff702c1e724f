"""Quality rules: base counts of each text, and robust multivariate outliers among texts of one language and source.

Each text gives a vector of transformed statistics, shrunk towards those of a plain text so that short texts do not vary
more than long ones. For each language and source, the centre and covariance are estimated by minimum covariance
determinant: from three starts (medians and absolute deviations, with three ways to sum deviations up), take the half_set
share of rows that is nearest, estimate again from these alone, and repeat (C-steps) until the determinant no longer falls; of
the starts, the one with the least determinant counts. A text is rejected when its squared Mahalanobis distance, scaled so
that the median row lies no farther than the chi-squared median, exceeds the chi-squared quantile `cutoff`. Groups of under
min_rows rows take the estimates of their language, or else of all rows.

DataFrame functions only. The C-steps read a written table of counts, not the texts. Quantiles are Spark's approximate
ones, whose memory does not grow with the group; the covariances are sums, so a group may hold any share of the rows.

Contract: one row per input row. Null and empty texts have no words and fail. Null languages and sources are groups like
others. Repeated rows repeat; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, materialize, table, words_of

#: The chi-squared median with 4 degrees of freedom, to which distances are scaled.
CHI2_MEDIAN_4 = 3.3567
#: Its quantile at 99.995 %.
CHI2_FAR_4 = 25.0
FEATURES = ["word_length", "symbol_density", "dup_line_share", "repeat_share"]
#: The least standard deviation that a feature is taken to have: most groups have hardly any spread in the last three.
FLOOR = [0.2, 0.3, 0.08, 0.08]
#: Words, lines and symbol-free characters of plain text that each text is taken to have besides its own.
PLAIN_WORDS, PLAIN_LINES, PLAIN_CHARS, PLAIN_LENGTH = 100, 5, 500, 6
STARTS = 3
WINDOW = 8


def n_dup_lines(text: Column) -> Column:
    """\\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size(words) - WINDOW

    def covered(windows: Column) -> Column:
        # Sorted by hash, equal windows are neighbours; the union of their spans is summed in the order of positions.
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(by_hash, lambda a: let(
            F.array_sort(F.filter(F.transform(a, lambda x, k: F.when(
                F.coalesce(F.get(a, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(a, k + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda i: i.isNotNull())),
            lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda s, i: F.struct(
                (s["n"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"])).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])))

    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(last < 1, F.lit(0)).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))).cast("long")


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    t = F.coalesce(docs[text], F.lit(""))
    out = docs.withColumns({"_words": words_of(docs[text]), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"), "n_dup_lines": n_dup_lines(docs[text]), "n_lines": F.size(F.split(t, "\n")).cast("long")})
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_repeat_words": n_repeat_words(F.col("_words"))}).drop("_words")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def features() -> Column:
    n = F.col("n_words") + PLAIN_WORDS
    return F.array(
        (F.col("word_chars") + PLAIN_WORDS * PLAIN_LENGTH) / n,
        F.log1p(200 * F.col("n_symbols") / (F.col("word_chars") + PLAIN_CHARS)),
        F.col("n_dup_lines") / (F.col("n_lines") + PLAIN_LINES),
        F.col("n_repeat_words") / (F.col("n_words") + PLAIN_WORDS / 2),
    )


def _cholesky(cov: list[list[Column]]) -> list[list[Column]]:
    """The factor of a small symmetric matrix, as expressions of its entries."""
    d = len(cov)
    low: list[list[Column]] = [[F.lit(0.0)] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            s = cov[i][j]
            for k in range(j):
                s = s - low[i][k] * low[j][k]
            low[i][j] = F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / low[j][j]
    return low


def _distance(x: Column, mean: Column, low: Column, d: int) -> Column:
    """Squared Mahalanobis distance by forward substitution; low: the factor's rows, flattened."""
    y: list[Column] = []
    for i in range(d):
        s = x[i] - mean[i]
        for k in range(i):
            s = s - low[i * d + k] * y[k]
        y.append(s / low[i * d + i])
    return reduce(lambda a, b: a + b, [v * v for v in y])


#: A table with a row for each group is broadcast up to this many groups (under 50 MB); beyond it, joined with salt.
MOST_BROADCAST_GROUPS = 100_000
SALT = 64


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Join a large table with one that has a row a group, without dealing rows out by a group that may be hot."""
    if groups.count() <= MOST_BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on, "left")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(spread, [*on, "_salt"], "left").drop("_salt")


def fit_mcd(stats: DataFrame, half_set: float = 0.75, most_steps: int = 12, min_rows: int = 50, accuracy: int = 1000) -> DataFrame:
    """The estimates: a row for each (lang, source) of stats with mean and low (the scaled covariance's factor, by rows).

    stats: lang, source and the counts of base_stats. Rows that fail the base rules take no part.
    """
    d, names = len(FEATURES), [f"x{i}" for i in range(len(FEATURES))]
    key = ["g_lang", "g_source"]
    used = stats.where("not base_failed").select("lang", "source", features().alias("x"))
    # A row takes part in its own group and in the wider ones that small groups lean on.
    rows = used.select(F.concat(F.lit("="), F.coalesce("lang", F.lit("\0"))).alias("l"), F.concat(F.lit("="), F.coalesce("source", F.lit("\0"))).alias("s"), "x")
    rows = rows.select(F.explode(F.array(*[F.struct(a.alias("g_lang"), b.alias("g_source")) for a, b in ((F.col("l"), F.col("s")), (F.col("l"), F.lit("*")), (F.lit("*"), F.lit("*")))])).alias("g"), "x").select("g.*", "x")
    centre = materialize(rows.groupBy(key).agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, accuracy) for i in range(d)]).alias("mean")), "mcd", narrow=True)
    spread = _with_groups(rows, centre, key).groupBy(key).agg(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, accuracy).alias(n) for i, n in enumerate(names)])
    # The first estimate: medians, and deviations as a diagonal factor.
    deviation = [F.greatest(1.4826 * F.col(n), F.lit(f)) for n, f in zip(names, FLOOR)]
    diagonal = F.array(*[deviation[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    start = centre.join(spread, key).select(*key, "mean", diagonal.alias("low"), F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start"), F.lit(None).cast("double").alias("det"))
    model = materialize(start, "mcd", narrow=True)
    apart = [F.abs(F.col("x")[i] - F.col("mean")[i]) / F.col("low")[i * d + i] for i in range(d)]
    first = F.when(F.col("start") == 0, reduce(lambda a, b: a + b, [v * v for v in apart])).when(F.col("start") == 1, F.greatest(*apart)).otherwise(reduce(lambda a, b: a + b, apart))
    for step in range(most_steps):
        near = _with_groups(rows, model.drop("det"), key).withColumn("d2", _distance(F.col("x"), F.col("mean"), F.col("low"), d) if step else first)
        cuts = materialize(near.groupBy(*key, "start").agg(F.percentile_approx("d2", half_set, accuracy).alias("cut")), "mcd", narrow=True)
        inner = _with_groups(near, cuts, [*key, "start"]).where("d2 <= cut")
        pairs = [(i, j) for i in range(d) for j in range(i + 1)]
        # Deviations from the last centre keep the sums small.
        shift = [F.col("x")[i] - F.col("mean")[i] for i in range(d)]
        sums = inner.groupBy(*key, "start").agg(F.first("mean").alias("mean"), *[F.avg(shift[i]).alias(f"a{i}") for i in range(d)], *[F.avg(shift[i] * shift[j]).alias(f"p{i}_{j}") for i, j in pairs])
        cov = [[F.col(f"p{max(i, j)}_{min(i, j)}") - F.col(f"a{i}") * F.col(f"a{j}") for j in range(d)] for i in range(d)]
        low = _cholesky([[F.greatest(c, F.lit(FLOOR[i] ** 2)) if i == j else c for j, c in enumerate(row)] for i, row in enumerate(cov)])
        mean = F.array(*[F.col("mean")[i] + F.col(f"a{i}") for i in range(d)])
        after = sums.select(*key, "start", mean.alias("mean"), F.array(*[low[i][j] for i in range(d) for j in range(d)]).alias("low"))
        det = reduce(lambda a, b: a * b, [F.col("low")[i * d + i] for i in range(d)])
        before, model = model, materialize(after.withColumn("det", det), "mcd", narrow=True)
        if step:
            fell = model.alias("a").join(before.alias("b"), [*key, "start"]).agg(F.max(1 - F.col("a.det") / F.col("b.det"))).first()[0]
            if fell is None or fell < 1e-3:
                break
    model = model.groupBy(key).agg(F.min_by(F.struct("mean", "low"), F.struct("det", "start")).alias("best")).select(*key, "best.*")
    model = materialize(model, "mcd", narrow=True)
    # Never below 1: a group without spread, where the floors alone count, is not to be stretched.
    scaled = _with_groups(rows, model, key).withColumn("d2", _distance(F.col("x"), F.col("mean"), F.col("low"), d)).groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx("d2", 0.5, accuracy).alias("mid"))
    model = model.join(scaled, key).select(*key, "n", "mean", F.transform("low", lambda v: v * F.sqrt(F.greatest(F.lit(1.0), F.col("mid") / CHI2_MEDIAN_4))).alias("low"))
    model = materialize(model, "mcd", narrow=True)
    # Each (lang, source) takes its own estimate if it has rows enough, else its language's, else that of all.
    groups = stats.groupBy("lang", "source").agg(F.lit(1)).select("lang", "source", F.concat(F.lit("="), F.coalesce("lang", F.lit("\0"))).alias("l"), F.concat(F.lit("="), F.coalesce("source", F.lit("\0"))).alias("s"))
    picks = [model.select(F.col("g_lang").alias(f"l{k}"), F.col("g_source").alias(f"s{k}"), F.struct("n", "mean", "low").alias(f"m{k}")) for k in range(2)]
    joined = groups.join(picks[0], (F.col("l") == F.col("l0")) & (F.col("s") == F.col("s0")), "left").join(picks[1].where("s1 = '*'"), F.col("l") == F.col("l1"), "left")
    of_all = model.where("g_lang = '*'").first()  # one row, or none where no row can be used
    spare = [F.lit(of_all[c] if of_all else None).cast("array<double>") for c in ("mean", "low")]
    best = [F.when(F.col("m0.n") >= min_rows, F.col(f"m0.{c}")).when(F.col("m1.n") >= min_rows, F.col(f"m1.{c}")).otherwise(s).alias(c) for c, s in zip(("mean", "low"), spare)]
    return joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *best)


def judge(stats: DataFrame, cutoff: float = CHI2_FAR_4, **options) -> DataFrame:
    """stats with d2 and kept."""
    model = materialize(fit_mcd(stats, **options), "mcd", narrow=True).withColumns({"_l": F.coalesce(F.concat(F.lit("="), F.col("_lang")), F.lit("")), "_s": F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit(""))}).drop("_lang", "_source")
    tagged = stats.withColumns({"_l": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), "_s": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))})
    out = _with_groups(tagged, model, ["_l", "_s"]).withColumn("d2", let(features(), lambda x: _distance(x, F.col("mean"), F.col("low"), len(FEATURES))))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).drop("_l", "_s", "mean", "low")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_verdicts(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """key, the counts, base_failed, kept and d2 (null where nothing could be estimated)."""
    picked = docs.select(docs[key].alias(key), docs["lang"].alias("lang"), docs["source"].alias("source"), docs[text].alias("text"))
    stats = materialize(base_stats(picked).drop("text"), "quality")
    return judge(stats, **options).select(key, *COUNTS, "base_failed", "kept", "d2")


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    own = docs.columns
    boxed = docs.select(docs[text].alias("text"), docs["lang"].alias("lang"), docs["source"].alias("source"), F.struct(*own).alias("_row"))
    stats = materialize(base_stats(boxed).drop("text"), "quality")
    return judge(stats, **options).where("kept").select(*[F.col("_row")[c].alias(c) for c in own])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
