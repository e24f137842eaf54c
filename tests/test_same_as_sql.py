"""Queries against their SQL where the tables of the smallest scale have too little to tell: odd texts, ties."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quern.plans.catalog import ORACLE_SQL, QUERIES

ODD = [
    None, "", "\n", "Page 3\r\nCHAPTER\r\n", "# h\r\n---\r\nABCDE\r\n| a | b |\r\n", "ABCD\u2028\nABCD\x85\nABCD\x0c", "---\u2028\n---\x85\n---\r", "\x0b# a\n#\x0bx\n#\x85x\n#\xa0x",
    "\x0b| a |\n| a |\x0b\n|\u2028|\n|\x85|\n|\r|\n|\xa0| \n\xa0|a|", "\u017fection 3\nse\u0131te 3\nSE\u0130TE 3\nPage 3\n\u212aapitel 4\nKAPITEL IV\nAb\u017fchnitt 3", "a\r```py\nb\r```\nc\n",
    "a\u2028```py\nb\u2028```\nc\n", "a\x85```x\nb\n", "```\n```\n```\nz", "x" * 41 + "\n" * 639, "x" * 323 + "\n" * 639, "\n".join("x" * k for k in range(128)), "\U0001f600\nab\u0301a", "a\x0c\n\n\n\n\n\n",
]


def test_document_profile_of_odd_texts(spark, tmp_path, same_rows):
    """Line ends other than \\n, letters with a third form, halves that doubles can't hold, and texts that are missing count as in the SQL."""
    pq.write_table(pa.table({"doc_id": pa.array(range(len(ODD)), pa.int64()), "text": pa.array(ODD, pa.string())}), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got, want = QUERIES["document_profile"](spark, str(tmp_path)).toPandas(), db.execute(ORACLE_SQL["document_profile"]).df()
    assert len(want) == len(ODD) - 1
    same_rows(got, want)


def test_yearly_totals_whatever_the_partitions(spark, tmp_path, same_rows):
    """Equal orders make equal totals though their rows lie in other files, so that customers decide, as in the SQL by one thread."""
    prices = [[round(0.1 * (k * j % 97) + 1234.07 * j, 2) for j in range(1, 6)] for k in range(1, 60)]
    rows = [(k + 1000 * copy, p, (copy, j)) for copy in (0, 1) for k, own in enumerate(prices) for j, p in enumerate(own)]
    parts = [[r for r in rows if r[2] == (0, 0)], [r for r in rows if r[2] != (0, 0)]]
    (tmp_path / "orders.parquet").mkdir()
    keys, when = iter(range(10_000)), datetime.datetime(1997, 5, 6)
    for name, part in zip("ab", parts, strict=True):
        part = sorted(part, key=lambda r: r[2])
        made = {"o_orderkey": pa.array([next(keys) for _ in part], pa.int64()), "o_custkey": pa.array([r[0] for r in part], pa.int64()), "o_totalprice": [r[1] for r in part], "o_orderdate": pa.array([when] * len(part), pa.timestamp("us"))}
        pq.write_table(pa.table(made), tmp_path / "orders.parquet" / f"{name}.parquet")
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    same_rows(QUERIES["sql_cte_window"](spark, str(tmp_path)).toPandas(), db.execute(ORACLE_SQL["sql_cte_window"]).df())
