"""A sink for runs, as a data source with a two-phase commit.

Rows are (exp, seed, file, pos, value): a line of one file of one run.  Tasks write parts to
a staging folder beside the runs; only the parts of task attempts that the commit
names are moved into place, and a run's folder gets its name last, in one rename.  So a run is there
whole or not at all, whatever executor is lost when, and a run that is there already is never touched.

A file of one part has the plain name; of several it is a folder of numbered parts, in order.
Files that end in .json are arrays (every part is one), others have a value a line.

The file system is one that Arrow opens by its address (local or mounted folders, HDFS, S3).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files that every run has, also where no row is written to them.
RUN_FILES = ("store_after_plant.json", "store_final.json", "run_log.jsonl")


@dataclass
class Parts(WriterCommitMessage):
    """What one task attempt wrote: (exp, seed, file, first pos, part)."""

    parts: list[tuple[str, int, str, int, str]]


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def run_folder(exp: str, seed: int) -> str:
    return f"exp={exp}/seed={seed}"


class RunWriter(DataSourceWriter):
    """Options: path (of the runs), runs (JSON list of [exp, seed] that the rows make up)."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.runs = [tuple(x) for x in json.loads(options["runs"])]
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Parts:
        fs, root = _fs(self.root)
        fs.create_dir(f"{root}/{self.staging}/parts", recursive=True)
        out = []
        for (exp, seed, file), own in groupby(rows, key=lambda r: (r.exp, r.seed, r.file)):
            part, array = f"{self.staging}/parts/{uuid.uuid4().hex}", file.endswith(".json")
            first = None
            with fs.open_output_stream(f"{root}/{part}") as f:
                f.write(b"[" if array else b"")
                for r in own:
                    f.write((b",\n" if array and first is not None else b"") + r.value.encode() + (b"" if array else b"\n"))
                    first = r.pos if first is None else first
                f.write(b"]" if array else b"")
            out.append((exp, seed, file, first, part))
        return Parts(out)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, root = _fs(self.root)
        parts = sorted(p for m in messages if m for p in m.parts)
        for exp, seed in self.runs:
            if fs.get_file_info(f"{root}/{run_folder(exp, seed)}").type.name != "NotFound":
                self.abort(messages)
                raise FileExistsError(f"run exp={exp} seed={seed} is there already; runs are never overwritten")
        for exp, seed in self.runs:
            ready = f"{root}/{self.staging}/ready/{run_folder(exp, seed)}"
            fs.create_dir(ready, recursive=True)
            for file in RUN_FILES:
                own = [p[4] for p in parts if p[:3] == (exp, seed, file)]
                if not own:
                    with fs.open_output_stream(f"{ready}/{file}") as f:
                        f.write(b"[]" if file.endswith(".json") else b"")
                elif len(own) == 1:
                    fs.move(f"{root}/{own[0]}", f"{ready}/{file}")
                else:
                    fs.create_dir(f"{ready}/{file}")
                    for n, p in enumerate(own):
                        fs.move(f"{root}/{p}", f"{ready}/{file}/part-{n:06d}.{file.rpartition('.')[2]}")
        for exp, seed in self.runs:
            fs.create_dir(f"{root}/exp={exp}", recursive=True)
            fs.move(f"{root}/{self.staging}/ready/{run_folder(exp, seed)}", f"{root}/{run_folder(exp, seed)}")
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Parts | None]) -> None:
        fs, root = _fs(self.root)
        if fs.get_file_info(f"{root}/{self.staging}").type.name != "NotFound":
            fs.delete_dir(f"{root}/{self.staging}")


class RunSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mnemoframe_runs"

    def schema(self) -> str:
        return "exp string, seed int, file string, pos long, value string"

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("runs are never overwritten; use append")
        return RunWriter(self.options)
