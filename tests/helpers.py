"""Plain helpers of the tests; nothing may be imported from a conftest, as several of them can exist."""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
