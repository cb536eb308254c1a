"""Rows of frames in an order that does not depend on Spark."""


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())
