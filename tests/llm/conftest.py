import pytest

#: Columns that operators use inside, in tables that have more than they need.
CLASHES = ("key", "words", "block", "score", "path", "seed", "fingerprint", "label", "stage_key", "part")


@pytest.fixture
def make(spark):
    """A table from rows, with further columns whose names clash with inner ones."""
    def table(rows, schema):
        given = [c.split()[0] for c in schema.split(", ")]
        more = [c for c in CLASHES if c not in given]
        return spark.createDataFrame([(*r, *("clash",) * len(more)) for r in rows], schema + "".join(f", {c} string" for c in more))

    return table


def by_id(df, *columns):
    """Rows by their first column; several rows with one id are a list."""
    out = {}
    for row in df.select(*columns).collect():
        out.setdefault(row[0], []).append(tuple(row)[1:] if len(columns) > 2 else row[1])
    return out
