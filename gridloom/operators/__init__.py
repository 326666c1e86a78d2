"""Row transforms for ``DataFrame.transform``."""

from .transforms import (  # noqa: F401
    bool_as,
    cast,
    cast_strict,
    chunk,
    filter_rows,
    map_cells,
    map_rows,
    null_as,
    slice_rows,
    trim,
)
