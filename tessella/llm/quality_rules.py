"""Quality rules: fixed limits, then multivariate outliers by a minimum covariance determinant for each language and source.

Everything is DataFrame and SQL work. The estimator is written as SQL text that Spark and DuckDB both run, so the oracle of
the query is the same formula on another engine; the counts of a text are written twice, once for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE_RUN, cut, let, words

WINDOW = 8
#: Groups with fewer documents are judged with the rest of their language, and then with all such rests.
LEAST_GROUP = 50
#: Quartiles that the starts are centred on; concentration steps of every start, and of the best one; the median of chi-square with
#: 6 degrees.
STARTS, FIRST_STEPS, STEPS, CHI2_MEDIAN = (2, 1, 3), 2, 4, 5.348
#: Variance below which no statistic counts as unusual: log word length, and roots of the other five ratios.
FLOOR = (0.15**2, 0.1**2, 0.1**2, 0.3**2, 0.3**2, 0.2**2)
#: Squared distance (as chi-square with 6 degrees) beyond which a document is rejected.
CUTOFF = 40.0
P = len(FLOOR)
_PAIRS = [(j, k) for j in range(1, P + 1) for k in range(1, j + 1)]
#: The median, and the size of the half that the covariance of a group of n is fitted to, as conditions on a running count.
HALF_OF, NEAREST = "2 * upto >= n", f"2 * upto >= n + {P + 1}"
#: Tables of up to so many groups are broadcast (some 300 bytes a group).
MOST_GROUPS = 100_000

# The characters that the counts are about.
SYMBOLS, MARKS, UPPER = "#*$%&|<>", ".,;:!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _repeat_words(w):
    """Words in windows of WINDOW words that occur twice or more."""

    def covered(h):
        def of(rows):  # (hash, place) in order: a place counts if a neighbour has the same hash
            last = F.size(rows) - 1
            twice = F.filter(rows, lambda x, i: F.coalesce((i > 0) & (F.get(rows, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((i < last) & (F.get(rows, i + 1)["h"] == x["h"]), F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i > 0, F.least(x - F.get(p, i - 1), F.lit(WINDOW))).otherwise(F.lit(WINDOW))), F.lit(0), lambda a, b: a + b))

        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(rows, of))

    n = F.size(w)
    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda v: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(WINDOW)))))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashed, covered))


def counts(docs: DataFrame, extra: list[str]) -> DataFrame:
    """The counts of every whole text. Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def without(c, chars):
        return F.char_length(c) - F.char_length(F.translate(c, chars, ""))

    made = F.struct(
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        without(text, SYMBOLS).cast("long").alias("n_symbols"),
        without(text, MARKS).cast("long").alias("n_marks"),
        without(text, UPPER).cast("long").alias("n_upper"),
    )
    flat = docs.select("doc_id", *extra, made.alias("c")).select("doc_id", *extra, "c.w.*", "c.l.*", "c.n_symbols", "c.n_marks", "c.n_upper")
    return flat.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


# --- the estimator, as SQL for both engines -----------------------------------------------------------------------------

def groups_sql(source: str) -> str:
    """(own, g): the group that each language and source is judged in."""
    sizes = f"SELECT own, min(lang_key) AS lang_key, count(*) AS n FROM {source} GROUP BY own"
    rest = f"SELECT lang_key, sum(n) AS rest FROM ({sizes}) t WHERE n < {LEAST_GROUP} GROUP BY lang_key"
    return f"SELECT s.own AS own, CASE WHEN s.n >= {LEAST_GROUP} THEN s.own WHEN r.rest >= {LEAST_GROUP} THEN s.lang_key ELSE '*' END AS g FROM ({sizes}) s LEFT JOIN ({rest}) r ON s.lang_key = r.lang_key"


VECTOR = {
    "own": "concat('=', coalesce(lang, '?'), '/', coalesce(source, '?'))",
    "lang_key": "concat('=', coalesce(lang, '?'))",
    "x1": "ln(CAST(word_chars AS DOUBLE) / n_words)",
    "x2": "sqrt(CAST(n_symbols AS DOUBLE) / n_words)",
    "x3": "sqrt(CAST(n_upper AS DOUBLE) / word_chars)",
    "x4": "sqrt(CAST(n_dup_lines AS DOUBLE) / n_lines)",
    "x5": "sqrt(CAST(n_repeat_words AS DOUBLE) / n_words)",
    "x6": "sqrt(CAST(n_marks AS DOUBLE) / n_words)",
}


def start_sql(x: str) -> str:
    """Several first centres and scatters of each group: each quartile of STARTS, with the quartile ranges, from counts in steps of 1/64."""
    long = " UNION ALL ".join(f"SELECT g, {j} AS j, CAST(floor(x{j} * 64) AS BIGINT) AS b FROM {x}" for j in range(1, P + 1))
    bins = f"SELECT g, j, b, count(*) AS c FROM ({long}) u GROUP BY g, j, b"
    run = f"SELECT g, j, b, sum(c) OVER (PARTITION BY g, j ORDER BY b) AS upto, sum(c) OVER (PARTITION BY g, j) AS n FROM ({bins}) v"
    at = f"SELECT g, j, max(n) AS n, min(CASE WHEN 4 * upto >= n THEN b END) AS q1, min(CASE WHEN {HALF_OF} THEN b END) AS q2, min(CASE WHEN 4 * upto >= 3 * n THEN b END) AS q3 FROM ({run}) w GROUP BY g, j"
    scatter = ", ".join(f"max(CASE WHEN j = {j} THEN sqrt(power((q3 - q1 + 1) / 64.0 / 1.349, 2) + {FLOOR[j - 1]!r}) END) AS l{j}{j}" if j == k else f"CAST(0 AS DOUBLE) AS l{j}{k}" for j, k in _PAIRS)
    one = [f"SELECT g, {s} AS s, max(n) AS n, {', '.join(f'max(CASE WHEN j = {j} THEN (q{q} + 0.5) / 64 END) AS m{j}' for j in range(1, P + 1))}, {scatter} FROM ({at}) y GROUP BY g" for s, q in enumerate(STARTS)]
    return " UNION ALL ".join(one)


def distance_sql(x: str, fit: str, keep: str) -> str:
    """Each vector with its squared distance d2 from its group's centre, for each start s: the system of the Cholesky factor, row by row."""
    inner = f"SELECT x.*, p.s AS s, p.n AS n, {', '.join(f'p.m{j}' for j in range(1, P + 1))}, {', '.join(f'p.l{j}{k}' for j, k in _PAIRS)} FROM {x} x JOIN {fit} p ON x.g = p.g"
    for j in range(1, P + 1):
        less = "".join(f" - l{j}{k} * y{k}" for k in range(1, j))
        inner = f"SELECT *, (x{j} - m{j}{less}) / l{j}{j} AS y{j} FROM ({inner}) d{j}"
    return f"SELECT {keep}g, s, n, {', '.join(f'x{j}' for j in range(1, P + 1))}, {' + '.join(f'y{j} * y{j}' for j in range(1, P + 1))} AS d2 FROM ({inner}) d"


def level_sql(enough: str, far: str) -> str:
    """The step of the logarithm of d2 below which enough of the group lies."""
    bins = f"SELECT g, s, n, b, count(*) AS c FROM {far} GROUP BY g, s, n, b"
    run = f"SELECT g, s, n, b, sum(c) OVER (PARTITION BY g, s ORDER BY b) AS upto FROM ({bins}) v"
    return f"SELECT g, s, coalesce(min(CASE WHEN {enough} THEN b END), max(b)) AS level FROM ({run}) w GROUP BY g, s"


def binned_sql(x: str, fit: str, keep: str = "") -> str:
    return f"SELECT *, CAST(floor(32 * ln(d2 + 0.000001)) AS BIGINT) AS b FROM ({distance_sql(x, fit, keep)}) e"


def moments_sql(far: str, level: str) -> str:
    """A concentration step: centre and Cholesky factor of the covariance (with the floor) of the nearest half."""
    names = range(1, P + 1)
    sums = ", ".join([f"avg(x{j}) AS m{j}" for j in names] + [f"avg(x{j} * x{k}) AS p{j}{k}" for j, k in _PAIRS])
    q = f"SELECT f.g AS g, f.s AS s, max(f.n) AS n, {sums} FROM {far} f JOIN {level} t ON f.g = t.g AND f.s = t.s WHERE f.b <= t.level GROUP BY f.g, f.s"
    for j, k in _PAIRS:
        less = "".join(f" - l{j}{i} * l{k}{i}" for i in range(1, k))
        body = f"p{j}{k} - m{j} * m{k}{less}"
        body = f"sqrt(greatest({body}, 0.0) + {FLOOR[j - 1]!r})" if j == k else f"({body}) / l{k}{k}"
        q = f"SELECT *, {body} AS l{j}{k} FROM ({q}) c{j}{k}"
    return f"SELECT g, s, n, {', '.join(f'm{j}' for j in names)}, {', '.join(f'l{j}{k}' for j, k in _PAIRS)} FROM ({q}) z"


def best_sql(fit: str) -> str:
    """Of the starts of each group the one with the least determinant (of Cholesky factors: the product of their diagonals)."""
    key = f"CAST(floor(1000 * ({' + '.join(f'ln(l{j}{j})' for j in range(1, P + 1))})) AS BIGINT) * {len(STARTS)} + s"
    cells = ", ".join(f"min_by({c}, k) AS {c}" for c in [*(f"m{j}" for j in range(1, P + 1)), *(f"l{j}{k}" for j, k in _PAIRS)])
    return f"SELECT g, min_by(s, k) AS s, max(n) AS n, {cells} FROM (SELECT *, {key} AS k FROM {fit}) t GROUP BY g"


def verdict_sql(far: str, level: str, keep: str) -> str:
    """The kept columns and whether the row is an outlier: d2, scaled so that its median is that of chi-square, beyond CUTOFF."""
    return f"SELECT {keep}f.n >= {LEAST_GROUP} AND f.d2 > {CUTOFF} * greatest(exp((t.level + 0.5) / 32) / {CHI2_MEDIAN}, 1.0) AS outlier FROM {far} f JOIN {level} t ON f.g = t.g"


def judged(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs``: doc_id, the counts, base_failed and kept, and a struct ``row`` of the columns ``also``.

    A text with under 20 words, or with more than 30 % of them in repeated runs of 8 words, fails outright. The others are
    vectors of six transformed statistics. For each language and source the covariance of least determinant of a half is sought:
    concentration steps from several robust starts, then more from the one whose determinant is least. Orders are taken from
    counts of binned values, so that every step is a grouped sum however large a group is. Vectors far from the centre are
    rejected; equal rows are judged alike. Null lang or source is a group like any other; a group that is too small even with its
    neighbours rejects nothing. A null text is empty and fails. Columns that are not named here are not read, and those in
    ``also`` may have any names. An empty table gives no rows.
    """
    failed, good = _judged(docs, also)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    more = ["row"] if also else []
    return failed.select(*columns, F.lit(False).alias("kept"), *more).union(good.select(*columns, (~F.col("outlier")).alias("kept"), *more))


def _judged(docs: DataFrame, also: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows that fail outright, and the others with outlier. Rows meet only the small tables of groups, never each other."""
    spark = docs.sparkSession
    more = ["row"] if also else []
    base = cut(counts(docs.withColumn("row", F.struct(*also)) if also else docs, ["lang", "source", *more]))
    good = base.where("not base_failed").selectExpr("*", *(f"{e} AS {n}" for n, e in VECTOR.items()))

    def q(text: str, **views: DataFrame) -> DataFrame:
        return spark.sql(text, **views)

    def small(groups: DataFrame) -> DataFrame:
        """A written table with a few rows a group: broadcast if it is known to be small, so that no vector is dealt out by its group."""
        groups = cut(groups)
        return F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups

    groups = small(q(groups_sql("{good}"), good=good))
    x = good.join(groups, "own")
    thin = cut(x.select("g", *(f"x{j}" for j in range(1, P + 1))))
    fit = small(q(start_sql("{x}"), x=thin))
    for step in range(FIRST_STEPS + STEPS):
        far = q(binned_sql("{x}", "{fit}"), x=thin, fit=fit)
        level = small(q(level_sql(NEAREST, "{far}"), far=far))
        fit = small(q(moments_sql("{far}", "{level}"), far=far, level=level))
        if step == FIRST_STEPS - 1:
            fit = small(q(best_sql("{fit}"), fit=fit))
    level = small(q(level_sql(HALF_OF, "{far}"), far=q(binned_sql("{x}", "{fit}"), x=thin, fit=fit)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *more]
    far = q(binned_sql("{x}", "{fit}", ", ".join(names) + ", "), x=x, fit=fit)
    return base.where("base_failed"), q(verdict_sql("{far}", "{level}", "".join(f"f.{n} AS {n}, " for n in names)), far=far, level=level)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, whatever their names; null and empty texts go."""
    return _judged(docs, tuple(docs.columns))[1].where("not outlier").select("row.*")


COUNTS_SQL = f"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_RUN}'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}) t),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) t WHERE c > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) t GROUP BY doc_id),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(length(text) - length(translate(text, '{MARKS}', '')) AS BIGINT) AS n_marks, CAST(length(text) - length(translate(text, '{UPPER}', '')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id) t)"""


def oracle_ctes() -> str:
    """The common table expressions up to ``verdict`` (rid, which is doc_id there, and outlier), for DuckDB."""
    parts = [COUNTS_SQL, f"good AS (SELECT doc_id AS rid, {', '.join(f'{e} AS {n}' for n, e in VECTOR.items())} FROM base WHERE NOT base_failed)"]
    parts += [f"groups AS MATERIALIZED ({groups_sql('good')})", "x AS MATERIALIZED (SELECT good.*, groups.g FROM good JOIN groups ON good.own = groups.own)", f"fit0 AS MATERIALIZED ({start_sql('x')})"]
    fit = "fit0"
    for k in range(FIRST_STEPS + STEPS):
        parts += [f"far{k} AS MATERIALIZED ({binned_sql('x', fit)})", f"level{k} AS MATERIALIZED ({level_sql(NEAREST, f'far{k}')})", f"fit{k + 1} AS MATERIALIZED ({moments_sql(f'far{k}', f'level{k}')})"]
        fit = f"fit{k + 1}"
        if k == FIRST_STEPS - 1:
            parts.append(f"best AS MATERIALIZED ({best_sql(fit)})")
            fit = "best"
    parts += [f"far AS MATERIALIZED ({binned_sql('x', fit, 'rid, ')})", f"level AS MATERIALIZED ({level_sql(HALF_OF, 'far')})", f"verdict AS MATERIALIZED ({verdict_sql('far', 'level', 'f.rid AS rid, ')})"]
    return "WITH " + ",\n".join(parts)


ORACLE_SQL = oracle_ctes() + "\nSELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outlier, false) AS kept FROM base LEFT JOIN verdict ON base.doc_id = verdict.rid"
