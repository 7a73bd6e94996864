"""Rows of a Spark query and of its oracle, in a form that compares."""

import decimal


def value(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 7) + 0.0)
    return repr(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(value, row)) for row in df.select(*(f"`{c}`" for c in names)).collect())


def duck_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    order = [found.columns.index(c) for c in names]
    return names, sorted(tuple(value(row[k]) for k in order) for row in found.fetchall())
