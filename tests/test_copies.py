"""Queries over tables that were repeated with shifted keys, against their SQL."""

import shutil

import duckdb

from inkveil import oracle, queries
from tests.test_oracle import DATA, shown


def test_faces_of_one_corner(spark, tmp_path):
    """Parts 10,500 apart give faces of one image and corner, and so one key, in sizes of their own."""
    con = duckdb.connect()
    for t in ("customer", "orders"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    con.execute(f"COPY (SELECT p.* REPLACE (p_partkey + 10500 * i AS p_partkey, 1 + (p_size + 13 * i) % 50 AS p_size) FROM '{DATA}/part.parquet' p, (SELECT unnest(range(4)) AS i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for t in ("customer", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = queries.queries()["wb_detect_pixels"](spark, str(tmp_path))
    want = con.execute(oracle.ORACLE["wb_detect_pixels"])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    assert len({(r[columns.index("image_id")], r[columns.index("source")], r[columns.index("seq")]) for r in rows}) < len(rows)
    assert shown([tuple(r) for r in got.collect()], got.columns) == shown(rows, columns)
