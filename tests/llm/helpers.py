import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def oracle(sql, tables=None):
    """Columns and rows of DuckDB SQL over the smallest tables, or over the rows given."""
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    for name, (schema, rows) in (tables or {}).items():
        con.sql(f"DROP VIEW IF EXISTS {name}")
        con.sql(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def same(df, found):
    cols, rows = found
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)

    def plain(rows_):
        return sorted((tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in order) for r in rows_), key=repr)

    assert plain(df.collect()) == plain([dict(zip(cols, r, strict=True)) for r in rows])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    n = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (n - len(r))) for r in rows], schema)
