import re

import duckdb


def compare_with_sql(found, sql, sf_dir):
    """The rows of a DataFrame and of DuckDB SQL over the same tables, by column name."""
    con = duckdb.connect()
    for name in set(re.findall(r"\b(?:documents|embeddings|pages|benchmark|labels|conversations|events|orders|lineitem|customer|part|supplier|nation|region)\b", sql)):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    expected = con.execute(sql).df()
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    got = found.select(names).toPandas()
    norm = lambda rows: sorted((tuple(None if x is None or x != x else x for x in r) for r in rows), key=repr)
    a = norm(got.astype(object).itertuples(index=False, name=None))
    b = norm(expected[names].astype(object).itertuples(index=False, name=None))
    assert len(a) == len(b)
    assert [repr(x) for x in a] == [repr(x) for x in b] or a == b
