"""Helpers of the tests, under a module name of their own: ``conftest`` would be
ambiguous with other folders' conftest files."""


def rows(df, *cols):
    """Collected rows as tuples, in the given column order, sorted."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
