"""Rows of either engine in one comparable form."""

import datetime
import math


def plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return str(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "null" if v is None else str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())
