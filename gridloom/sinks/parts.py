"""Folders of workbooks: executors write whole documents, and the driver commits those of the tasks that succeeded.

A document is written into a pending folder under a name of its own for each
attempt, so a repeated task never touches what another has written. Committing
moves the documents into the target folder and drops the rest.
"""

from __future__ import annotations

import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import chain, islice

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..options import Meta, Options
from ..rowid import ROW_ID
from ..stores import store_of
from . import ods, xlsx
from .ods import document as ods_document
from .pieces import leaves
from .xlsx import document as xlsx_document

#: Rows of a document; a sheet has room for 1,048,576.
DOCUMENT_ROWS = 1_000_000
#: Bytes of a document that stay in memory while it is written.
SPOOL_BYTES = 4 << 20


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class DocumentParts(DataSource):
    """A sink for encoded rows (line): ``format("gridloom_parts")``; what stands around the rows comes by options."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_parts"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> _Parts:
        return _Parts(dict(self.options))


class _Parts(DataSourceArrowWriter):
    def __init__(self, said: dict[str, str]):
        self.said = {k.lower(): v for k, v in said.items()}
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def _store(self):
        return store_of(self.said["path"])

    def write(self, batches: Iterator) -> _Written:
        limit, package = int(self.said["rows"]), json.loads(self.said["package"])
        kind = self.said["kind"]
        document = xlsx_document if kind == "xlsx" else ods_document
        options = Options(**package | {"meta": Meta(**package["meta"])})
        opening, header, closing = json.loads(self.said["shell"])
        store, root = self._store()
        store.create_dir(f"{root}/{self.pending}")
        lines = chain.from_iterable(batch.column(0).to_pylist() for batch in batches)
        names: list[str] = []
        while (first := next(lines, None)) is not None:
            with tempfile.SpooledTemporaryFile(SPOOL_BYTES, dir=package["temp_path"]) as spool:
                document(spool, options, opening, header, chain([first], islice(lines, limit - 1)), closing)
                spool.seek(0)
                name = f"part-{TaskContext.get().partitionId():06d}-{len(names):04d}-{uuid.uuid4().hex}.{kind}"
                with store.open_output_stream(f"{root}/{self.pending}/{name}", compression=None) as out:
                    shutil.copyfileobj(spool, out, 1 << 20)
            names.append(name)
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = self._store()
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{root}/{self.pending}/{name}", f"{root}/{name}")
        self._drop(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(*self._store())

    def _drop(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.pending}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.pending}")


def write_parts(df: DataFrame, folder: str, kind: str, options: Options, rows: int = DOCUMENT_ROWS) -> None:
    """Write a folder of workbooks of up to ``rows`` rows each, in order of the row ids if there are any."""
    if rows < 1:
        raise ValueError("a document must hold at least one row")
    sink = xlsx if kind == "xlsx" else ods
    xlsx.sheet_name(options)
    cells, header = leaves(df, options)
    if ROW_ID in cells.columns:
        cells = cells.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID)
    shell = sink.shell(cells, header, options)
    package = {"bold_headers": options.bold_headers, "shared_strings": options.shared_strings, "sheet": options.sheet, "temp_path": options.temp_path, "meta": asdict(options.properties)}
    df.sparkSession.dataSource.register(DocumentParts)
    said = {"kind": kind, "rows": str(rows), "shell": json.dumps(shell), "package": json.dumps(package)}
    cells.select(sink.row_column(cells, options).alias("line")).write.format("gridloom_parts").options(**said).mode("append").save(folder)
