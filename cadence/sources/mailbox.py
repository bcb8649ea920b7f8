"""Messages as files: a sink that publishes all of a job's messages or none, and may be run again.

    spark.dataSource.register(mailbox.Mailbox)
    rows.write.format("mailbox").option("path", folder).mode("append").save()      # columns name and text

A task writes under a name of its own in ``_tmp``; when the job commits each file is moved to its message's name. A job that is run again
finds its messages there, which is fine if they say the same; a name that is taken by another text fails the job before anything is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cadence.sources.recordings import _where


@dataclass
class Sent(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # as written, the name it gets, digest of the text


class MailboxWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        import uuid

        system, folder = _where(self.folder)
        system.create_dir(f"{folder}/_tmp", recursive=True)
        files = []
        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"no name of a message: {name!r}")
                data, now = (text or "").encode(), f"{folder}/_tmp/{uuid.uuid4().hex}"
                with system.open_output_stream(now) as f:
                    f.write(data)
                files.append((now, f"{folder}/{name}", sha256(data).hexdigest()))
        return Sent(files)

    def commit(self, messages: list[Sent | None]) -> None:
        system, _ = _where(self.folder)
        files = [f for m in messages if m for f in m.files]
        wanted: dict[str, str] = {}
        for _, name, digest in files:
            if wanted.setdefault(name, digest) != digest:
                raise ValueError(f"two messages of one name: {name}")
        for info in system.get_file_info(list(wanted)) if wanted else []:
            if info.type == fs.FileType.File:
                with system.open_input_stream(info.path) as f:
                    if sha256(f.read()).hexdigest() != wanted[info.path]:
                        raise ValueError(f"the name is taken by another message: {info.path}")
        for now, name, _ in files:
            system.move(now, name)

    def abort(self, messages: list[Sent | None]) -> None:
        system, _ = _where(self.folder)
        for now, _, _ in (f for m in messages if m for f in m.files):
            if system.get_file_info(now).type == fs.FileType.File:
                system.delete_file(now)


class Mailbox(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def writer(self, schema, overwrite: bool) -> MailboxWriter:
        if overwrite:
            raise ValueError("messages are added, not overwritten")
        return MailboxWriter(self.options["path"])
