"""Reading small results in the tests."""


def by_key(df, column):
    """{(series_id, channel): values in seq order} of a small result."""
    pdf = df.toPandas().sort_values(["series_id", "channel", "seq"])
    return {k: g[column].to_numpy() for k, g in pdf.groupby(["series_id", "channel"])}
