"""Queries over tables that are not the given ones."""

import os

import duckdb
import pyarrow.compute as pc
import pyarrow.parquet as pq

from skein.plans import catalog


def changed(sf, folder, **tables):
    """The tables of sf in a folder, those named after what their function makes of them."""
    for f in os.listdir(sf):
        name = f.split(".")[0]
        if name in tables:
            pq.write_table(tables[name](pq.read_table(f"{sf}/{f}")), f"{folder}/{f}")
        else:
            os.symlink(f"{sf}/{f}", f"{folder}/{f}")
    return str(folder)


def by_sql(name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return sorted(con.execute(catalog.oracle_sql()[name]).fetchall())


def test_impact_of_a_part_of_any_path(spark, sf, tmp_path):
    """A part whose size is divisible by ten lies at another path."""
    sized = lambda t: t.set_column(t.schema.get_field_index("p_size"), "p_size", pc.if_else(pc.equal(t["p_partkey"], 4), 10, t["p_size"]).cast(t.schema.field("p_size").type))
    folder = changed(sf, tmp_path, part=sized)
    got = sorted(map(tuple, catalog.queries()["p68_tool_impact"](spark, folder).collect()))
    assert got and got == by_sql("p68_tool_impact", folder)
