"""Queries on the expression vocabulary: each family of functions over a real table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import expressions
from tessella.registered.base import ORACLES, QUERIES, query, table


def family(name: str, source: str, keys: str, columns: dict[str, tuple[str, str | None]], where: str = "true") -> None:
    """Registers ``name``: column to (Spark expression, DuckDB expression). Columns whose value belongs to Spark alone (None)
    go to ``name``_own, which has no oracle."""
    shared = {c: e for c, e in columns.items() if e[1] is not None}
    own = {c: e for c, e in columns.items() if e[1] is None}

    def make(chosen):
        return lambda spark, d: table(spark, d, source).where(where).selectExpr(*keys.split(", "), *(f"{e[0]} AS {c}" for c, e in chosen.items()))

    QUERIES[name] = make(shared)
    ORACLES[name] = f"SELECT {keys}, {', '.join(f'{e[1]} AS {c}' for c, e in shared.items())} FROM {source} WHERE {where}"
    if own:
        QUERIES[f"{name}_own"] = make(own)


def same(*expressions_: str) -> dict:
    return {f"x{k}": (e, e) for k, e in enumerate(expressions_)}


LINE = "l_orderkey, l_linenumber"
family("e_op", "lineitem", LINE, {
    **same("l_quantity + l_tax", "l_quantity - l_tax", "l_quantity * l_tax", "l_partkey % 7", "-l_linenumber", "l_returnflag || l_linestatus", "l_tax = 0.02", "l_tax <> 0.02", "l_quantity < 10", "l_quantity <= 10", "l_quantity > 10", "l_quantity >= 10", "NOT (l_tax > 0.01 AND l_quantity < 20 OR l_linenumber = 1)", "1 + 2 * 3"),
    "ratio": ("try_divide(l_extendedprice, l_quantity)", "l_extendedprice / nullif(l_quantity, 0)"), "other": ("l_linestatus != 'O'", "l_linestatus != 'O'"),
})
family("e_pred", "part", "p_partkey", same("p_brand IS NULL", "p_brand IS NOT NULL", "p_size BETWEEN 5 AND 20", "p_size NOT BETWEEN 5 AND 20", "p_size IN (1, 2, 3)", "p_size NOT IN (1, 2, 3)", "p_type LIKE '%E%'", "p_type NOT LIKE 'A%'"))
family("e_case", "orders", "o_orderkey", same("CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END"))
family("e_cast", "lineitem", LINE, {
    "s": ("cast(l_linenumber as string)", "CAST(l_linenumber AS VARCHAR)"), "i": ("cast(l_partkey as int)", "CAST(l_partkey AS INTEGER)"), "b": ("cast(l_linenumber as bigint)", "CAST(l_linenumber AS BIGINT)"),
    "f": ("cast(cast(l_tax as float) as double) between 0 and 1", "CAST(CAST(l_tax AS FLOAT) AS DOUBLE) BETWEEN 0 AND 1"), "d": ("cast(l_linenumber as double)", "CAST(l_linenumber AS DOUBLE)"), "o": ("cast(l_linenumber as boolean)", "CAST(l_linenumber AS BOOLEAN)"),
    "t": ("date_format(cast('2024-01-02 03:04:05' as timestamp), 'yyyy-MM-dd HH:mm:ss')", "strftime(CAST('2024-01-02 03:04:05' AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"), "a": ("cast(l_shipdate as date)", "CAST(l_shipdate AS DATE)"), "j": ("cast('{\"a\":1}' as string)", "'{\"a\":1}'"),
})
family("e_null", "part", "p_partkey", {
    **same("coalesce(nullif(p_size, 5), -1)", "nullif(p_size, 5)"),
    "nvl": ("nvl(nullif(p_size, 5), 0)", "ifnull(nullif(p_size, 5), 0)"), "nvl2": ("nvl2(nullif(p_size, 5), 1, 2)", "CASE WHEN nullif(p_size, 5) IS NOT NULL THEN 1 ELSE 2 END"), "ifn": ("ifnull(nullif(p_size, 5), 7)", "ifnull(nullif(p_size, 5), 7)"),
    "nan": ("nanvl(cast('NaN' as double), p_retailprice)", "p_retailprice"), "i": ("if(p_size > 10, 'x', 'y')", "CASE WHEN p_size > 10 THEN 'x' ELSE 'y' END"),
})


def near(e: str) -> str:
    return f"round({e}, 6)"


_MATH = ["sqrt(p_retailprice)", "cbrt(p_retailprice)", "ln(p_retailprice)", "exp(p_size / 10.0D)", "log2(p_retailprice)", "log10(p_retailprice)", "sin(p_size)", "cos(p_size)", "tan(p_size)", "asin(p_size / 100.0D)", "acos(p_size / 100.0D)", "atan(p_size)", "atan2(p_size, 3)", "degrees(p_size)", "radians(p_size)", "pow(p_size, 2)", "power(p_size, 3)"]
family("e_math", "part", "p_partkey", {
    **{f"m{k}": (near(e), near(e.replace("0D)", "0)"))) for k, e in enumerate(_MATH)},
    "abs": ("abs(p_size - 20)", "abs(p_size - 20)"), "ceil": ("ceil(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"), "ceiling": ("ceiling(p_retailprice)", "CAST(ceiling(p_retailprice) AS BIGINT)"), "floor": ("floor(p_retailprice)", "CAST(floor(p_retailprice) AS BIGINT)"),
    "rounded": ("round(p_retailprice)", "round(p_retailprice)"), "bround": ("bround(p_size + 0.5D, 0)", "round_even(p_size + 0.5::DOUBLE, 0)"), "lg": (near("log(2, p_retailprice)"), near("log2(p_retailprice)")),
    "sgn": ("cast(sign(p_size - 20) as int)", "CAST(sign(p_size - 20) AS INTEGER)"), "sgnum": ("cast(signum(p_size - 20) as int)", "CAST(sign(p_size - 20) AS INTEGER)"), "md": ("mod(p_size - 30, 7)", "(p_size - 30) % 7"), "pm": ("pmod(p_size - 30, 7)", "((p_size - 30) % 7 + 7) % 7"),
    "gr": ("greatest(p_size, 10, null)", "greatest(p_size, 10)"), "le": ("least(p_size, 10, null)", "least(p_size, 10)"), "pos": ("positive(p_size)", "p_size"), "neg": ("negative(p_size)", "-p_size"), "bn": ("bin(p_size)", "bin(p_size)"), "hx": ("hex(p_size)", "hex(p_size)"), "uh": ("cast(unhex('4142') as string)", "CAST(unhex('4142') AS VARCHAR)"), "cv": ("conv(cast(p_size as string), 10, 16)", "hex(p_size)"),
    "r1": ("rand(7)", None), "r2": ("randn(7)", None),
})
family("e_str", "customer", "c_custkey", {
    **same("lower(c_name)", "upper(c_name)", "ltrim('  a ')", "rtrim(' a  ')", "lpad(c_mktsegment, 12, '*')", "rpad(c_mktsegment, 12, '*')", "reverse(c_name)", "translate(c_name, 'Cus', 'xyz')", "replace(c_name, '#', '-')", "concat(c_name, '/', c_mktsegment)", "concat_ws('-', c_name, c_mktsegment)", "substring(c_name, 2, 5)", "left(c_name, 4)", "right(c_name, 4)", "repeat(c_mktsegment, 2)", "ascii(c_name)", "chr(65)", "regexp_extract(c_name, '([0-9]+)', 1)", "trim('  a ')"),
    "ln": ("bigint(length(c_name))", "length(c_name)"), "ins": ("bigint(instr(c_name, '#'))", "instr(c_name, '#')"), "lev": ("bigint(levenshtein(c_name, c_mktsegment))", "levenshtein(c_name, c_mktsegment)"), "cl": ("bigint(char_length(c_name))", "length(c_name)"), "chl": ("bigint(character_length(c_name))", "length(c_name)"), "bl": ("cast(bit_length(c_name) as bigint)", "bit_length(c_name)"), "ol": ("cast(octet_length(c_name) as bigint)", "CAST(strlen(c_name) AS BIGINT)"), "lc": ("lcase(c_name)", "lower(c_name)"), "uc": ("ucase(c_name)", "upper(c_name)"),
    "ic": ("initcap(lower(c_mktsegment))", "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"), "rr": ("regexp_replace(c_name, '[0-9]', 'd')", "regexp_replace(c_name, '[0-9]', 'd', 'g')"), "sp": ("split(c_name, '#')[0]", "string_split(c_name, '#')[1]"), "sb": ("substr(c_name, 3)", "substr(c_name, 3)"),
    "lo": ("bigint(locate('0', c_name, 3))", "CASE WHEN strpos(substr(c_name, 3), '0') > 0 THEN strpos(substr(c_name, 3), '0') + 2 ELSE 0 END"), "fn": ("format_number(c_custkey * 1000, 0)", "format('{:,}', c_custkey * 1000)"), "ov": ("overlay(c_name placing 'XX' from 2)", "left(c_name, 1) || 'XX' || substr(c_name, 4)"),
    "en": ("decode(encode(c_name, 'UTF-8'), 'UTF-8')", "c_name"), "b6": ("base64(cast(c_name as binary))", "base64(encode(c_name))"), "u6": ("cast(unbase64(base64(cast(c_name as binary))) as string)", "c_name"), "sx": ("soundex(c_name)", None),
})


def day(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


def spark_day(e: str) -> str:
    return f"date_format({e}, 'yyyy-MM-dd HH:mm:ss')"


_O = "CAST(o_orderdate AS DATE)"
family("e_date", "orders", "o_orderkey", {
    "da": ("date_add(o_orderdate, 3)", f"{_O} + 3"), "db": ("date_sub(o_orderdate, 3)", f"{_O} - 3"), "dd": ("datediff(o_orderdate, date'1995-01-01')", f"CAST({_O} - DATE '1995-01-01' AS INTEGER)"), "am": ("add_months(o_orderdate, 2)", f"CAST({_O} + INTERVAL 2 MONTH AS DATE)"),
    "df": ("date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"), "td": ("to_date('2024-02-29')", "DATE '2024-02-29'"), "tt": (spark_day("to_timestamp('2024-02-29 01:02:03')"), day("TIMESTAMP '2024-02-29 01:02:03'")), "fu": ("from_unixtime(86400)", "'1970-01-02 00:00:00'"), "ut": ("unix_timestamp(o_orderdate)", "epoch_us(o_orderdate) // 1000000"),
    **{n: (f"{n}(o_orderdate)", f"CAST({n}(o_orderdate) AS INTEGER)") for n in ("year", "month", "day", "dayofmonth", "hour", "minute", "second", "dayofyear", "weekofyear", "quarter")},
    "dw": ("dayofweek(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"), "ld": ("last_day(o_orderdate)", "last_day(o_orderdate)"), "nd": ("next_day(o_orderdate, 'MO')", f"CAST({_O} + CAST(((1 - dayofweek(o_orderdate) + 6) % 7 + 1) AS INTEGER) AS DATE)"),
    "dt": (spark_day("date_trunc('month', o_orderdate)"), day("date_trunc('month', o_orderdate)")), "tr": ("trunc(o_orderdate, 'year')", "CAST(date_trunc('year', o_orderdate) AS DATE)"), "md": ("make_date(2024, 2, 29)", "make_date(2024, 2, 29)"), "mt": (spark_day("make_timestamp(2024, 2, 29, 1, 2, 3)"), day("make_timestamp(2024, 2, 29, 1, 2, 3.0)")),
    "mb": ("months_between(add_months(trunc(o_orderdate, 'month'), 5), trunc(o_orderdate, 'month'))", "CAST(5 AS DOUBLE)"), "nw": ("now() >= current_timestamp()", "true"), "cd": ("current_date() > date'2000-01-01'", "true"),
})
family("e_hash", "customer", "c_custkey", {
    "m5": ("md5(c_name)", "md5(c_name)"), "s1": ("sha1(c_name)", "sha1(c_name)"), "s0": ("sha(c_name)", "sha1(c_name)"), "s2": ("sha2(c_name, 256)", "sha256(c_name)"), "h": ("hash(c_name)", None), "x": ("xxhash64(c_name)", None), "c": ("crc32(cast(c_name as binary))", None),
})


def text(spark_array: str, duck_list: str) -> tuple[str, str]:
    return f"array_join(transform({spark_array}, x -> cast(x as string)), ',')", f"coalesce(array_to_string({duck_list}, ','), '')"


_A, _B = "array(o_orderkey % 3, o_orderkey % 5, o_orderkey % 3)", "[o_orderkey % 3, o_orderkey % 5, o_orderkey % 3]"
family("e_arr", "orders", "o_orderkey", {
    "sz": (f"size({_A})", f"CAST(len({_B}) AS INTEGER)"), "ac": (f"array_contains({_A}, 2L)", f"list_contains({_B}, 2)"), "ad": text(f"array_sort(array_distinct({_A}))", f"list_sort(list_distinct({_B}))"), "au": text(f"array_sort(array_union({_A}, array(9L)))", f"list_sort(list_distinct(list_concat({_B}, [9])))"),
    "ai": text(f"array_sort(array_intersect({_A}, array(0L, 1L)))", f"list_sort(list_distinct(list_intersect({_B}, [0, 1])))"), "ae": text(f"array_sort(array_except({_A}, array(0L, 1L)))", f"list_sort(list_distinct(list_filter({_B}, lambda x: x NOT IN (0, 1))))"), "aj": (f"array_join({_A}, '-')", f"array_to_string({_B}, '-')"),
    "ap": (f"array_position({_A}, 2L)", f"CAST(coalesce(list_position({_B}, 2), 0) AS BIGINT)"), "srt": text(f"array_sort({_A})", f"list_sort({_B})"), "fl": text(f"flatten(array({_A}, {_A}))", f"flatten([{_B}, {_B}])"), "sq": text("sequence(1, 4)", "range(1, 5)"), "sa": text(f"sort_array({_A}, false)", f"list_reverse_sort({_B})"), "sl": text(f"slice({_A}, 2, 2)", f"({_B})[2:3]"), "ea": (f"try_element_at({_A}, 2)", f"({_B})[2]"),
})
_M, _D = "map_from_arrays(array('a', 'b'), array(p_size, p_size + 1))", "map(['a', 'b'], [p_size, p_size + 1])"
family("e_map", "part", "p_partkey", {
    "mk": text(f"array_sort(map_keys({_M}))", f"list_sort(map_keys({_D}))"), "mv": text(f"array_sort(map_values({_M}))", f"list_sort(map_values({_D}))"), "mf": (f"{_M}['b']", "p_size + 1"), "mc": (f"map_concat({_M}, map('c', 0))['c']", "0"), "sm": ("str_to_map('a:1,b:2')['b']", "'2'"),
})
family("e_json", "events", "event_id", {
    "g": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), "f": ("from_json(props, 'k int').k", "CAST(json_extract_string(props, '$.k') AS INTEGER)"), "t": ("to_json(named_struct('a', user_id))", "'{\"a\":' || user_id || '}'"), "s": ("schema_of_json('{\"k\": 1}')", "'STRUCT<k: BIGINT>'"),
})
family("e_conv", "part", "p_partkey", {
    "i": ("int(p_retailprice)", "CAST(trunc(p_retailprice) AS INTEGER)"), "b": ("bigint(p_size)", "CAST(p_size AS BIGINT)"), "f": ("cast(float(p_size) as double)", "CAST(p_size AS DOUBLE)"), "d": ("double(p_size)", "CAST(p_size AS DOUBLE)"), "s": ("string(p_size)", "CAST(p_size AS VARCHAR)"), "o": ("boolean(p_size)", "CAST(p_size AS BOOLEAN)"), "a": ("date('2024-01-02')", "DATE '2024-01-02'"), "t": (spark_day("timestamp('2024-01-02 03:04:05')"), day("TIMESTAMP '2024-01-02 03:04:05'")), "n": ("try_cast(p_name as int)", "TRY_CAST(p_name AS INTEGER)"),
})


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS s, count(*) AS c, round(avg(l_quantity), 6) AS a, min(l_tax) AS mn, max(l_tax) AS mx, count(DISTINCT l_suppkey) AS cd, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS f, arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS l,
CAST(len(list(l_linenumber)) AS INTEGER) AS cl, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS cs, min(l_returnflag) AS av, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 4) AS vr, count(*) FILTER (WHERE l_tax > 0.04) AS ci, round(sum(l_quantity) FILTER (WHERE l_tax > 0.04), 2) AS si, round(avg(l_quantity) FILTER (WHERE l_tax > 0.04), 6) AS ai,
round(quantile_cont(l_quantity, 0.5), 6) AS p, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS fs, round(sum(DISTINCT l_quantity), 2) AS ds, true AS approx FROM lineitem GROUP BY l_returnflag""")
def e_agg(spark, d):
    q, tax = F.col("l_quantity"), F.col("l_tax") > 0.04
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem")
    # each distinct aggregate on its own two columns: together they would multiply every row
    suppliers = rows.groupBy("l_returnflag").agg(expressions.count_distinct(F.col("l_suppkey")).alias("cd"))
    quantities = rows.groupBy("l_returnflag").agg(F.round(F.sum_distinct(q), 2).alias("ds"))
    one = rows.groupBy("l_returnflag").agg(
        F.round(F.sum(q), 2).alias("s"), F.count(F.lit(1)).alias("c"), F.round(F.avg(q), 6).alias("a"), F.min("l_tax").alias("mn"), F.max("l_tax").alias("mx"), F.approx_count_distinct("l_suppkey", 0.02).alias("about"),
        F.min_by("l_partkey", order).alias("f"), F.max_by("l_partkey", order).alias("l"), F.count("l_linenumber").cast("int").alias("cl"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("cs"), F.any_value("l_returnflag").alias("av"),
        F.round(F.stddev(q), 6).alias("sd"), F.round(F.variance(q), 4).alias("vr"), F.count_if(tax).alias("ci"), F.round(expressions.sum_if(q, tax), 2).alias("si"), F.round(expressions.avg_if(q, tax), 6).alias("ai"), F.round(F.percentile(q, 0.5), 6).alias("p"),
        F.expr("round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2)").alias("fs"),
    )
    both = one.join(suppliers, "l_returnflag").join(quantities, "l_returnflag")
    return both.withColumn("approx", F.abs(F.col("about") - F.col("cd")) <= F.greatest(F.col("cd") * 0.1, F.lit(2))).drop("about")


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS numbers, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, CAST(len(list(l_linenumber)) AS INTEGER) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS middle FROM lineitem GROUP BY 1")
def e_agg_lists(spark, d):
    """Aggregates that gather: on a key whose groups are short."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey")
    gathered = own.agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"), F.sort_array(F.collect_set("l_returnflag")).alias("s"), F.round(F.percentile("l_quantity", 0.5), 6).alias("middle"))
    return gathered.select("l_orderkey", F.array_join("l", ",").alias("numbers"), F.array_join("s", ",").alias("flags"), F.size("l").alias("n"), "middle")


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS middle, true AS near FROM lineitem GROUP BY 1")
def e_agg_percentile_approx(spark, d):
    # the exact one over counts of values, of which there are few, and not over rows
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    exact = counts.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("middle"))
    about = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 10000).alias("about"))
    return about.join(exact, "l_returnflag").select("l_returnflag", F.round("middle", 6).alias("middle"), (F.abs(F.col("about") - F.col("middle")) <= 1).alias("near"))


_FRAMES = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"""SELECT o_orderkey, round(sum(o_totalprice) OVER ({_FRAMES} ROWS UNBOUNDED PRECEDING), 2) AS a, round(sum(o_totalprice) OVER ({_FRAMES} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS b, count(*) OVER ({_FRAMES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') NULLS LAST, o_orderkey) AS n FROM orders""")
def e_win(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    by_key = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-100, 0)
    last = Window.partitionBy("o_custkey").orderBy(F.nullif(F.col("o_orderstatus"), F.lit("F")).asc_nulls_last(), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("a"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-1, 1)), 2).alias("b"), F.count(F.lit(1)).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("c"), F.count(F.lit(1)).over(by_key).alias("r"), F.row_number().over(last).cast("long").alias("n"))


_W = "PARTITION BY o_custkey ORDER BY o_orderpriority"
_U = "PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query(f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, rank() OVER ({_W}) AS rk, dense_rank() OVER ({_W}) AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lg, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ld,
first_value(o_orderkey) OVER ({_U}) AS fv, last_value(o_orderkey) OVER ({_U}) AS lv, nth_value(o_orderkey, 2) OVER ({_U}) AS nv, round(cume_dist() OVER ({_W}), 8) AS cd, round(percent_rank() OVER ({_W}), 8) AS pr FROM orders""")
def e_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    u = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    k = "o_orderkey"
    whole = {"rn": F.row_number().over(w), "rk": F.rank().over(s), "dr": F.dense_rank().over(s), "nt": F.ntile(4).over(w)}
    return table(spark, d, "orders").select(k, *(c.cast("long").alias(n) for n, c in whole.items()), F.lag(k, 1, -1).over(w).alias("lg"), F.lead(k).over(w).alias("ld"), F.first_value(k).over(u).alias("fv"), F.last_value(k).over(u).alias("lv"), F.nth_value(k, 2).over(u).alias("nv"), F.round(F.cume_dist().over(s), 8).alias("cd"), F.round(F.percent_rank().over(s), 8).alias("pr"))


@query("SELECT vec_id, CAST(p AS INTEGER) AS pos, CAST(e AS DOUBLE) AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS e FROM embeddings) t")
def e_arr_posexplode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


@query("SELECT vec_id, CAST(p AS INTEGER) AS pos, CAST(e AS DOUBLE) AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS e FROM embeddings) t")
def e_arr_posexplode_whole(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, x AS n, y AS sq FROM events CROSS JOIN (VALUES (1, 1), (2, 4)) t(x, y)")
def e_json_tuple_inline(spark, d):
    rows = table(spark, d, "events").select("event_id", F.json_tuple("props", "k").alias("k"))
    return rows.select("event_id", "k", F.inline(F.expr("array(named_struct('n', 1, 'sq', 1), named_struct('n', 2, 'sq', 4))")))


@query("SELECT event_id, x AS v FROM events CROSS JOIN (VALUES (1), (2)) t(x)")
def e_arr_explode(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))


@query("SELECT event_id, x AS v FROM events CROSS JOIN (VALUES (1), (2)) t(x)")
def e_arr_explode_whole(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS doubled FROM customer")
def e_udf(spark, d):
    expressions.register(spark, "doubled_and_one", "x double", "double", "x * 2 + 1")
    return table(spark, d, "customer").selectExpr("c_custkey", "doubled_and_one(c_acctbal) AS doubled")
