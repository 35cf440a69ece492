"""What the tests share."""


def compared(df, con, sql):
    """Rows of the frame and of the SQL, columns by name, in any order."""
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())
    return ours, theirs


def applied(spark, values, build, kind="string"):
    """``build(column)`` over the values, in one job."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", build("v").alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]
