"""Small helpers that several test modules use."""

def rows(df, *columns):
    """Sorted list of tuples, nulls first."""
    picked = df.select(*columns).collect()
    return sorted((tuple(r) for r in picked), key=lambda t: tuple((x is not None, x) for x in t))
