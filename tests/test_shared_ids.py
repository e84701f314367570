"""Queries against their SQL on tables in which two lines have the same short mention id."""

import datetime
import shutil

import duckdb
import pytest

import __spark_entry__ as entry

#: Lines whose ids are both 93d4ed13cfb4, then e8ba8a92b83e, e9f7791b7c9f: order, number, part, supplier, quantity.
TWINS = [(8699588, 2, 1152823, 57840, 38.0), (483846, 5, 70006, 3906, 32.0), (4589470, 5, 609440, 30685, 34.0), (3581428, 3, 467603, 23291, 25.0), (6793423, 2, 919698, 45141, 37.0), (4710063, 4, 632104, 31595, 22.0)]


@pytest.fixture(scope="module")
def twins(spark, sf_dir, tmp_path_factory):
    """The smallest tables' first orders and the twins, each of whose persons has three more lines."""
    out = tmp_path_factory.mktemp("twins")
    con = duckdb.connect()
    lines = [*TWINS, *[(o + k, n, p, s, q) for o, n, p, s, q in TWINS for k in (1, 2, 3)]]
    lines += [(o, 9, lines[(i + 4) % len(lines)][2], s, q) for i, (o, _, _, s, q) in enumerate(lines)]  # co-authors
    con.execute("CREATE TABLE x (o BIGINT, n INTEGER, p BIGINT, s BIGINT, q DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?, ?, ?)", lines)
    of = lambda t: f"SELECT * FROM '{sf_dir}/{t}.parquet'"
    one = lambda t: f"(SELECT * FROM '{sf_dir}/{t}.parquet' LIMIT 1)"
    queries = {
        "lineitem": f"{of('lineitem')} WHERE l_orderkey < 150 UNION ALL SELECT t.* REPLACE (o AS l_orderkey, n AS l_linenumber, p AS l_partkey, s AS l_suppkey, q AS l_quantity) FROM {one('lineitem')} t, x",
        "orders": f"{of('orders')} UNION ALL SELECT t.* REPLACE (o AS o_orderkey) FROM {one('orders')} t, (SELECT DISTINCT o FROM x)",
        "part": f"{of('part')} UNION ALL SELECT t.* REPLACE (p AS p_partkey, ['red bolt', 'red ring', 'hot bolt'][p % 3 + 1] AS p_name, (p % 2)::INTEGER AS p_size) FROM {one('part')} t, (SELECT DISTINCT p FROM x)",
        "supplier": f"{of('supplier')} UNION ALL SELECT t.* REPLACE (s AS s_suppkey, (s % 25)::INTEGER AS s_nationkey) FROM {one('supplier')} t, (SELECT DISTINCT s FROM x)",
    }
    for name, sql in queries.items():
        con.execute(f"COPY ({sql}) TO '{out}/{name}.parquet'")
    shutil.copy(f"{sf_dir}/nation.parquet", out)
    for name in (*queries, "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet'")
    return str(out), con


def plain(rows):
    return sorted([tuple(x.isoformat() if isinstance(x, datetime.date) else x for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", ["b_cubed", "pairwise", "conflict_rate", "subset_metrics", "string_baselines"])
def test_lines_that_share_an_id(spark, twins, name):
    sf_dir, con = twins
    ids = entry.queries()["trace_redacted"](spark, sf_dir).groupBy("mention_id").count().where("count > 1").count()
    got, want = entry.queries()[name](spark, sf_dir), con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert ids == 3 and plain(got.select(*columns).collect()) == plain(want.fetchall())
