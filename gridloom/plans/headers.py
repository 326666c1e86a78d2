"""Header schemas: flat or nested column paths and the projections they stand for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidDocument, MissingColumn

Path = tuple[str, ...]
Normalizer = Callable[[str], str] | None


def definition_paths(definition: Any) -> list[Path]:
    """Paths of a nested definition: names, lists of names, and mappings from a group to what it holds."""
    if isinstance(definition, str):
        return [(definition,)]
    if isinstance(definition, Mapping):
        return [(str(k), *rest) for k, v in definition.items() for rest in ([()] if v is None or v is True else definition_paths(v))]
    out: list[Path] = []
    for item in definition:
        out += [tuple(item)] if isinstance(item, tuple) else definition_paths(item)
    return out


def _alias_paths(aliases: Mapping[str, Any], before: Path = ()) -> dict[Path, str]:
    found: dict[Path, str] = {}
    for name, value in aliases.items():
        if isinstance(value, Mapping):
            found |= _alias_paths(value, (*before, str(name)))
        else:
            found[(*before, str(name))] = str(value)
    return found


@dataclass(frozen=True)
class HeaderPaths:
    """Column paths in order, each with the physical column it is read from."""

    paths: tuple[Path, ...]
    indices: tuple[int, ...]

    # building

    @classmethod
    def _of(cls, paths: Sequence[Path], indices: Sequence[int] | None = None) -> HeaderPaths:
        made = cls(tuple(paths), tuple(range(len(paths)) if indices is None else indices))
        made._validate()
        return made

    @classmethod
    def flat(cls, names: Sequence[Any], normalizer: Normalizer = None) -> HeaderPaths:
        """From one row of names; the normalizer sees only names that are not empty."""
        return cls._of([(_text(n, normalizer),) for n in names])

    @classmethod
    def from_rows(cls, rows: Sequence[Sequence[Any]], normalizer: Normalizer = None) -> HeaderPaths:
        """From one or more header rows, the upper ones naming groups."""
        rows = [list(r) for r in rows]
        if len(rows) == 1:
            return cls.flat(rows[0], normalizer)
        return cls._of(_grouped([[_text(c, normalizer) for c in r] for r in rows]))

    @classmethod
    def from_definition(cls, definition: Any) -> HeaderPaths:
        """From a nested definition, as writers take it."""
        return cls._of(definition_paths(definition))

    @classmethod
    def injected(cls, headers: Any, header_rows: int = 1, normalizer: Normalizer = None) -> HeaderPaths:
        """From headers given by the caller: names, rows of names, or a nested definition."""
        if isinstance(headers, Mapping):
            return cls.from_definition(headers)
        headers = list(headers)
        if headers and all(isinstance(r, (list, tuple)) for r in headers) and (header_rows > 1 or len(headers) == 1):
            return cls.from_rows(headers, normalizer)
        if any(isinstance(h, Mapping) for h in headers):
            return cls.from_definition(headers)
        return cls.flat(headers, normalizer)

    def _validate(self) -> None:
        seen: set[Path] = set()
        for path in self.paths:
            if path in seen:
                raise InvalidDocument(f"Duplicate header: {'.'.join(path)}")
            seen.add(path)
        groups = {p[:k] for p in self.paths for k in range(1, len(p))}
        for path in self.paths:
            if path in groups:
                raise InvalidDocument(f"Header '{'.'.join(path)}' and headers below it cannot coexist")

    # looking

    @property
    def is_flat(self) -> bool:
        return all(len(p) == 1 for p in self.paths)

    @property
    def names(self) -> list[str]:
        """Dotted paths."""
        return [".".join(p) for p in self.paths]

    @property
    def depth(self) -> int:
        return max(map(len, self.paths), default=1)

    def __len__(self) -> int:
        return len(self.paths)

    # changing

    def require(self, columns: Any) -> None:
        """Raise MissingColumn with all paths that are not there."""
        if missing := [".".join(p) for p in definition_paths(columns) if p not in self.paths]:
            raise MissingColumn(missing)

    def select(self, columns: Any) -> HeaderPaths:
        """The given columns in the given order; all must be there. A group stands for all that it holds."""
        place = dict(zip(self.paths, self.indices))
        chosen: list[Path] = []
        missing = []
        for path in definition_paths(columns):
            below = [path] if path in place else [p for p in self.paths if p[: len(path)] == path]
            if not below:
                missing.append(".".join(path))
            chosen += below
        if missing:
            raise MissingColumn(missing)
        return self._of(chosen, [place[p] for p in chosen])

    def rename(self, aliases: Mapping[str, Any]) -> HeaderPaths:
        """Leaves renamed by a tree of aliases; names that are not there are passed over."""
        known = _alias_paths(aliases)
        return self._of([(*p[:-1], known[p]) if p in known else p for p in self.paths], self.indices)

    # rows and frames

    def key_row(self, row: Sequence[Any]) -> dict[str, Any]:
        """A row as a (nested) mapping; short rows are padded with None and long ones cut."""
        out: dict[str, Any] = {}
        for path, i in zip(self.paths, self.indices):
            at = out
            for name in path[:-1]:
                at = at.setdefault(name, {})
            at[path[-1]] = row[i] if i < len(row) else None
        return out

    def flatten_row(self, row: Mapping[str, Any]) -> list[Any]:
        """The leaves of a (nested) mapping in the order of the columns."""
        out = []
        for path in self.paths:
            at: Any = row
            for name in path:
                at = at.get(name) if isinstance(at, Mapping) else None
            out.append(at)
        return out

    def header_rows(self) -> list[list[str]]:
        """Rows to write above the data: a group's name stands over its first column only."""
        out = []
        for level in range(self.depth):
            row, before = [], None
            for path in self.paths:
                if len(path) <= level:
                    row.append("")
                    before = None
                    continue
                leaf = level == len(path) - 1
                row.append("" if not leaf and before == path[: level + 1] else path[level])
                before = None if leaf else path[: level + 1]
            out.append(row)
        return out

    def project(self, column: Callable[[int], Column]) -> list[Column]:
        """Columns of a frame, nested paths as structs; ``column`` gives the physical column of an index."""

        def build(items: list[tuple[Path, int]], level: int) -> list[Column]:
            groups: dict[str, list[tuple[Path, int]]] = {}
            for path, i in items:
                groups.setdefault(path[level], []).append((path, i))
            return [column(g[0][1]).alias(name) if len(g) == 1 and len(g[0][0]) == level + 1 else F.struct(*build(g, level + 1)).alias(name) for name, g in groups.items()]

        return build(list(zip(self.paths, self.indices)), 0)

    def flatten(self, df: DataFrame) -> DataFrame:
        """The leaves of ``df`` in the order of the columns, as c0, c1, ..."""
        return df.select(*[_leaf(path).alias(f"c{i}") for i, path in enumerate(self.paths)])

    @classmethod
    def of_frame(cls, df: DataFrame) -> HeaderPaths:
        """The paths of a frame's columns, structs as groups."""
        from pyspark.sql.types import StructType

        def walk(kind: StructType, before: Path) -> list[Path]:
            out: list[Path] = []
            for f in kind.fields:
                out += walk(f.dataType, (*before, f.name)) if isinstance(f.dataType, StructType) else [(*before, f.name)]
            return out

        return cls._of(walk(df.schema, ()))


def _leaf(path: Path) -> Column:
    return F.col(".".join("`" + name.replace("`", "``") + "`" for name in path))


def _text(cell: Any, normalizer: Normalizer) -> str:
    name = "" if cell is None else str(cell)
    return normalizer(name) if normalizer and name else name


def _grouped(rows: list[list[str]]) -> list[Path]:
    """Paths of hierarchical header rows.

    An empty cell takes the name to its left, unless a row above has begun
    another group in this column; segments that are empty then fall away.
    """
    width = max(map(len, rows), default=0)
    current, paths = [""] * len(rows), []
    for c in range(width):
        new_group = False
        for level, row in enumerate(rows):
            cell = row[c] if c < len(row) else ""
            if cell:
                new_group = new_group or cell != current[level]
                current[level] = cell
            elif new_group:
                current[level] = ""
        paths.append(tuple(s for s in current if s) or ("",))
    return paths


def first_places(columns: Sequence[str], names: Sequence[str]) -> list[int]:
    """The places of ``columns`` in a flat row of names, which may repeat: the first of equal names counts."""
    place: dict[str, int] = {}
    for i, name in enumerate(names):
        place.setdefault(name, i)
    if missing := [c for c in columns if c not in place]:
        raise MissingColumn(missing)
    return [place[c] for c in columns]


def find_header(required: Any, header_rows: int, window: list[list[Any]], normalizer: Normalizer = None) -> HeaderPaths | None:
    """The schema of a full window of rows if it has all required columns."""
    if len(window) < header_rows:
        return None
    try:
        found = HeaderPaths.from_rows(window, normalizer)
        found.require(required)
    except (InvalidDocument, MissingColumn):
        return None
    return found


def detect_header_offset(required: Any, header_rows: int, rows: Any, max_scan: int = 50, normalizer: Normalizer = None) -> int | None:
    """How many non-empty rows stand before the header, among the first ``max_scan``; None if none fits."""
    window: list[list[Any]] = []
    seen = 0
    for row in rows:
        if all(c is None or c == "" for c in row):
            continue
        window = [*window, list(row)][-header_rows:]
        seen += 1
        if find_header(required, header_rows, window, normalizer):
            return seen - header_rows
        if seen >= max_scan:
            break
    return None
