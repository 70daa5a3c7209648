"""What several test modules share (a module of its own: ``conftest`` exists once per folder)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows(df, *cols):
    """Collect as a list of tuples (in the DataFrame's column order, or ``cols``)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
