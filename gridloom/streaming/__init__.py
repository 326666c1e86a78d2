"""Documents that keep arriving in a folder, as a stream of rows."""

from .documents import read_stream  # noqa: F401
