"""Compare a query's rows with its oracle's, as multisets; doubles to nine places."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    out = []
    for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None):
        out.append(tuple(round(float(x), 9) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in row))
    return sorted(out, key=str)


def same_rows(spark, query, sql, sf_dir=SMALL):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        expected = con.sql(sql).df()
    found = query(spark, sf_dir).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    assert rows_of(found, columns) == rows_of(expected, columns)
