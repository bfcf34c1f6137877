"""Quality rules: statistics of whole texts, and robust multivariate outliers per language and source.

All of it is DataFrame expressions. The statistics of a text are array functions of its row, without any shuffle. Their
transformed vectors are compared with a minimum-covariance-determinant estimate of their group: from medians and median
deviations on, concentration steps keep the nearest share ``SHARE`` of a group and estimate mean and covariance from it.
A vector too far from its group by Mahalanobis distance is rejected.

Vectors are rounded to thousandths and summed as integers, distances are ranked by bins; estimates depend neither on row order nor
on partitioning, and every aggregate combines before its shuffle, so a source with a third of all rows is no hot spot.
Groups below ``LEAST_ROWS`` rows are estimated together with the other small ones of their language, and if these are too few
still, with those of all languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm.common import stored, table

SHARE = 0.75
STEPS = 3
LEAST_ROWS = 60
#: Parts into which the rows of each group are dealt for joins with its estimate.
SALTS = 32
#: Groups up to which their table is broadcast: a few hundred bytes each.
BROADCAST_GROUPS = 20_000
#: Squared distance beyond which a vector is rejected: far behind any quantile of a normal cloud, texts are not normal.
CUT = 25.0
#: Corrects the covariance of the nearest 75 % of a four-dimensional normal cloud: .75 / P(chi2 with 6 degrees < 5.385).
CONSISTENCY = 1.49
UNIT = 1000
#: Vector entries and the least standard deviation that counts for each, in their own units.
ENTRIES = ("size", "word", "symbol", "line")
FLOORS = (0.5, 0.15, 0.05, 0.3)
#: Length of a word from which the mean length is measured.
TYPICAL_WORD = 5.0
SPACE = r"[ \t-\r]+"


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows that begin at sorted starts."""
    gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(width)))
    return F.aggregate(gaps, F.lit(width), lambda total, gap: total + gap)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first time included."""

    def repeated(sorted_windows: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.get(sorted_windows, i - 1)["h"]
            after = F.get(sorted_windows, i + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return _let(F.array_sort(F.transform(F.filter(sorted_windows, again), lambda x: x["i"])), lambda p: _covered(p, width))

    def count(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(tagged, repeated)).otherwise(0)

    windows = _let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))))
    return F.when(F.size(words) >= width + 1, _let(windows, count)).otherwise(0).cast("long")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns of docs to keep), n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))

    def stats(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def by_line(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    rows = docs.select(
        (F.struct(*keep) if keep else F.lit(True)).alias("row"),
        F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}).alias("own_group"),
        F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}).alias("lang_group"),
        _let(words, stats).alias("w"),
        _let(lines, by_line).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    rows = rows.select("row", "own_group", "lang_group", "w.*", "l.*", "n_symbols")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vectors(rows: DataFrame) -> DataFrame:
    """Adds the transformed statistics, in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    entries = {
        "size": F.log(n),
        # the mean of few words says little, so it counts by the root of their number up to a hundred
        "word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n / TYPICAL_WORD) * F.sqrt(F.least(n, F.lit(100)) / 100),
        "symbol": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "line": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    }
    return rows.withColumns({name: F.round(UNIT * value).cast("long") for name, value in entries.items()})


def groups(rows: DataFrame) -> DataFrame:
    """own_group, grp: the group that the rows of each language and source with any good row are judged by."""
    own = rows.filter("not base_failed").groupBy("own_group", "lang_group").agg(F.count("*").alias("n"))
    small = own.filter(F.col("n") < LEAST_ROWS).groupBy("lang_group").agg(F.sum("n").alias("together"))
    joined = own.join(small, "lang_group", "left")
    grp = F.when(F.col("n") >= LEAST_ROWS, F.col("own_group")).when(F.col("together") >= LEAST_ROWS, F.col("lang_group"))
    return joined.select("own_group", F.coalesce(grp, F.lit("others")).alias("grp"))


def _small(table: DataFrame) -> DataFrame:
    """A table of groups, broadcast if it is known to be small; else the join is left to the runtime."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns m_*, l_* (mean and Cholesky factor) by forward substitution."""
    solved: list[Column] = []
    for i, name in enumerate(ENTRIES):
        value = F.col(name) - F.col(f"m_{i}")
        for j, y in enumerate(solved):
            value = value - F.col(f"l_{i}{j}") * y
        solved.append(value / F.col(f"l_{i}{i}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


def _factor(cov) -> dict[str, Column]:
    """Cholesky factor of a covariance given as a function of two indices, as named columns."""
    made: dict[str, Column] = {}
    for i in range(len(ENTRIES)):
        for j in range(i + 1):
            value = cov(i, j)
            for k in range(j):
                value = value - made[f"l_{i}{k}"] * made[f"l_{j}{k}"]
            made[f"l_{i}{j}"] = F.sqrt(F.greatest(value, F.lit(1.0))) if i == j else value / made[f"l_{j}{j}"]
    return made


def _beside(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with what is known of their group. The salt spreads a hot group over tasks, and keeps sums combining before a shuffle."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["grp", "_salt"])


def start(good: DataFrame) -> DataFrame:
    """Medians, and median deviations as a diagonal factor; the values are whole thousandths, so few distinct ones."""
    medians = good.groupBy("grp").agg(*(F.percentile(name, 0.5).alias(f"m_{i}") for i, name in enumerate(ENTRIES)))
    off = _beside(good, medians).groupBy("grp").agg(
        *(F.percentile(F.abs(F.col(name) - F.col(f"m_{i}")), 0.5).alias(f"s_{i}") for i, name in enumerate(ENTRIES))
    )
    scale = [F.sqrt((1.4826 * F.col(f"s_{i}")) ** 2 + (UNIT * FLOORS[i]) ** 2) for i in range(len(ENTRIES))]
    return medians.join(off, "grp").select(
        "grp",
        *(f"m_{i}" for i in range(len(ENTRIES))),
        *((scale[i] if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i in range(len(ENTRIES)) for j in range(i + 1)),
    )


def concentrate(good: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: mean and covariance of the share of each group that is nearest by the estimate so far."""
    near = _beside(good, estimate).select("grp", "_salt", *ENTRIES, F.floor(256 * F.log(1 + _distance())).alias("bin"))
    limit = near.groupBy("grp").agg(F.percentile("bin", SHARE).alias("limit"))
    inner = _beside(near, limit).filter("bin <= limit")
    exact = [F.col(name).cast("decimal(19,0)") for name in ENTRIES]
    pairs = [(i, j) for i in range(len(ENTRIES)) for j in range(i + 1)]
    sums = inner.groupBy("grp").agg(
        F.count("*").alias("n"),
        *(F.sum(exact[i]).alias(f"a_{i}") for i in range(len(ENTRIES))),
        *(F.sum(exact[i] * exact[j]).alias(f"b_{i}{j}") for i, j in pairs),
    )
    n = F.col("n").cast("double")
    mean = [F.col(f"a_{i}").cast("double") / n for i in range(len(ENTRIES))]

    def cov(i: int, j: int) -> Column:
        value = CONSISTENCY * (F.col(f"b_{i}{j}").cast("double") / n - mean[i] * mean[j])
        return value + (UNIT * FLOORS[i]) ** 2 if i == j else value

    return sums.select("grp", *(m.alias(f"m_{i}") for i, m in enumerate(mean)), *(c.alias(k) for k, c in _factor(cov).items()))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (all columns of docs, or those to keep), the statistics, distance (null where the base rules failed or no estimate exists), base_failed, kept.

    Null text has no words and fails; so do texts of fewer than ten words. Null languages and sources are groups like
    others; repeated rows count each. A group of equal vectors has its floors as deviations, so nothing is divided by
    zero, and ties at the limit of a concentration step are all in. An empty table gives no rows.
    """
    keep = keep or docs.columns
    wide = "text" in keep
    # texts are not stored for the estimates; with texts to keep, their statistics are worked out once more at the end
    narrow = stored(vectors(measured(docs, [] if wide else keep)), "measured")
    named = stored(groups(narrow), "groups")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt")
    good = narrow.filter("not base_failed").join(_small(named), "own_group").select("grp", salt, *ENTRIES)
    estimate = stored(start(good), "estimate")
    for _ in range(STEPS):
        estimate = stored(concentrate(good, estimate), "estimate")
    known = stored(named.join(estimate, "grp"), "known")
    rows = vectors(measured(docs, keep)) if wide else narrow
    far = rows.join(_small(known), "own_group", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return far.withColumn("kept", kept)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, unchanged."""
    return judged(docs).filter("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sql() -> str:
    """The same rules as one SQL statement."""
    ks = range(len(ENTRIES))
    pairs = [(i, j) for i in ks for j in range(i + 1)]
    solved = ", ".join(
        f"({name} - m_{i}" + "".join(f" - l_{i}{j} * y_{j}" for j in range(i)) + f") / l_{i}{i} as y_{i}" for i, name in enumerate(ENTRIES)
    )
    distance = f"{solved}, " + " + ".join(f"y_{i} * y_{i}" for i in ks) + " as distance"

    def cell(i: int, j: int) -> str:
        cov = f"({CONSISTENCY}::double * (b_{i}{j} / n - m_{i} * m_{j})" + (f" + {(UNIT * FLOORS[i]) ** 2}::double" if i == j else "")
        value = cov + "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j)) + ")"
        return f"sqrt(greatest({value}, 1.0::double)) as l_{i}{j}" if i == j else f"{value} / l_{j}{j} as l_{i}{j}"

    steps = ""
    for k in range(STEPS):
        steps += f""", near{k} as (
    select good.*, {distance}, floor(256 * ln(1 + distance))::bigint as bin from good join e{k} using (grp)
), limit{k} as (select grp, quantile_cont(bin, {SHARE}) as most from near{k} group by grp
), sums{k} as (
    select grp, count(*)::double as n, {", ".join(f"sum({e})::double as a_{i}" for i, e in enumerate(ENTRIES))},
        {", ".join(f"sum({ENTRIES[i]} * {ENTRIES[j]})::double as b_{i}{j}" for i, j in pairs)}
    from near{k} join limit{k} using (grp) where bin <= most group by grp
), e{k + 1} as (
    select grp, {", ".join(f"a_{i} / n as m_{i}" for i in ks)}, {", ".join(cell(i, j) for i, j in pairs)} from sums{k}
)"""
    space = r"\x20\x09-\x0D"
    return f"""
with d as (
    select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(t, '[^{space}]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as lines from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 4], ' ') as window_text from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d) x
), again as (
    select doc_id, i from windows qualify count(*) over (partition by doc_id, window_text) > 1
), covered as (
    select doc_id, sum(case when before is null then 5 else least(5, i - before) end) as n from (
        select doc_id, i, lag(i) over (partition by doc_id order by i) as before from again) x group by doc_id
), b as (
    select d.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        len(lines)::bigint as n_lines, coalesce(n, 0)::bigint as n_repeat_words,
        n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed
    from d left join covered on covered.doc_id = d.doc_id
), v as (
    select *, round({UNIT} * ln(greatest(n_words, 1)::double))::bigint as size,
        round({UNIT} * (ln(greatest(word_chars, 1) / greatest(n_words, 1)::double / {TYPICAL_WORD}::double)
            * sqrt(least(greatest(n_words, 1), 100) / 100::double)))::bigint as word,
        round({UNIT} * sqrt(n_symbols / greatest(word_chars, 1)::double))::bigint as symbol,
        round({UNIT} * sqrt(n_dup_lines / greatest(n_lines, 1)::double))::bigint as line from b
), own as (
    select lang, source, count(*) as n from v where not base_failed group by lang, source
), small as (
    select lang, sum(n) as together from own where n < {LEAST_ROWS} group by lang
), g as (
    select own.lang, own.source, case when n >= {LEAST_ROWS} then to_json([own.lang, own.source])::varchar
        when together >= {LEAST_ROWS} then to_json([own.lang])::varchar else 'others' end as grp
    from own left join small on small.lang is not distinct from own.lang
), good as (
    select grp, {", ".join(ENTRIES)} from v join g on g.lang is not distinct from v.lang and g.source is not distinct from v.source where not base_failed
), med as (
    select grp, {", ".join(f"quantile_cont({e}, 0.5) as m_{i}" for i, e in enumerate(ENTRIES))} from good group by grp
), dev as (
    select grp, {", ".join(f"quantile_cont(abs({e} - m_{i}), 0.5) as s_{i}" for i, e in enumerate(ENTRIES))} from good join med using (grp) group by grp
), e0 as (
    select med.*, {", ".join(f"sqrt(pow(1.4826::double * s_{i}, 2) + {(UNIT * FLOORS[i]) ** 2}::double) as l_{i}{j}" if i == j else f"0::double as l_{i}{j}" for i, j in pairs)}
    from med join dev using (grp)
){steps}, far as (
    select v.*, {distance} from v left join g on g.lang is not distinct from v.lang and g.source is not distinct from v.source
    left join e{STEPS} using (grp)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce(distance <= {CUT}, true) as kept from far
"""
