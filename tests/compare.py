"""Rows of two results as comparable tuples."""

import datetime
import math


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, datetime.datetime):
        return x.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def same(spark_df, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(spark_df.columns) == sorted(names)
    assert rows(spark_df.columns, spark_df.collect()) == rows(names, cursor.fetchall())
