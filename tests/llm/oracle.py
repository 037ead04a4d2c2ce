"""A registered query against its SQL over the same tables."""

import duckdb


def same_as_sql(spark, name, query, sql, folder, tables):
    got = query(spark, folder)
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        want = found.fetchall()
    assert sorted(names) == sorted(got.columns), name
    rows = got.select(names).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows), name
    return rows
