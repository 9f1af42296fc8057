"""Holds a query's rows against those of its SQL, as multisets."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def differences(df, sql: str, sf_dir: str) -> tuple[int, int]:
    con = connection(sf_dir)
    got = df.toArrow()
    con.register("got", got)
    con.sql(f"create table want as {sql}")
    names = [c[0] for c in con.sql("describe want").fetchall()]
    assert sorted(names) == sorted(got.column_names)
    c = ", ".join(f'"{n}"' for n in sorted(names))
    count = lambda a, b: con.sql(f"select count(*) from (select {c} from {a} except all select {c} from {b})").fetchall()[0][0]
    return count("got", "want"), count("want", "got")
