from martloom.sources.tables import small_table


def table(spark, schema, *rows):
    return small_table(spark, rows, schema)


def rows(df, *order):
    got = [tuple(r) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((v is not None, v) for v in r)) if not order else got


def dicts(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
