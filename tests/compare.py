"""Comparison of a Spark result with DuckDB's, regardless of the order of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x if isinstance(x, (int, bool)) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if "datetime" in str(frame[c].dtype):
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]").astype(str)})
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)
