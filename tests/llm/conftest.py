import duckdb
import pytest

#: Columns that operators use inside; a table that has them must come through all the same.
CLASH = ("key", "line", "lines", "n", "root", "a", "b", "bin", "tile", "score", "toxic", "lang", "item", "terms", "held", "r", "h", "size", "doc", "at", "orig", "t", "o", "u", "v", "count", "copy", "problem", "__gone", "gone", "paperloom_gone", "paperloom_key", "Paperloom_Version", "version", "last", "place", "links", "class_id", "rep", "family", "weight")
SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, clash=False, extra=""):
        rows = [(i, t, "s", None if t is None else len(t), *rest) for i, t, *rest in rows]
        df = spark.createDataFrame(rows, SCHEMA + (", " + extra if extra else "")).repartition(3)
        if clash:
            for c in CLASH:
                if c not in df.columns:
                    from pyspark.sql import functions as F

                    df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture
def duck():
    """Rows of a query's SQL over some DataFrames, by column name."""

    def run(sql, **tables):
        c = duckdb.connect()
        for name, df in tables.items():
            c.register(name, df.toArrow())
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        return sorted((dict(zip(names, row, strict=True)) for row in r.fetchall()), key=repr)

    return run


@pytest.fixture
def same(duck):
    """Whether a DataFrame has the rows of the SQL; floats up to rounding."""

    def check(df, sql, **tables):
        flat = lambda rows: sorted(repr(tuple((k, float(f"{v:.9g}") if isinstance(v, float) else v) for k, v in sorted(r.items()))) for r in rows)
        assert flat(r.asDict() for r in df.collect()) == flat(duck(sql, **tables))

    return check
