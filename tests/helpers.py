import datetime as dt

PRODUCTION = (
    "api_number string, well_name string, operator string, production_month date, "
    "production_year int, production_quarter string, oil_and_gas_group string, "
    "production double, shale_play string, basin string, well_length_ft double"
)


def month(number: int) -> dt.date:
    """First day of the ``number``-th month after January 2018."""
    return dt.date(2018 + number // 12, number % 12 + 1, 1)


def fact(well="w1", t=0, group="O", value=1.0, operator="OP", play="P", name=None, length=None):
    day = month(t)
    return (
        well, name or well, operator, day, day.year, f"Q{(day.month + 2) // 3}", group,
        None if value is None else float(value), play, play, length,
    )


def production(spark, rows):
    return spark.createDataFrame(rows, PRODUCTION)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def fields(schema):
    """Names and types; nullability follows the data."""
    return [(f.name, f.dataType) for f in schema]
