"""Tables that change all at once: folders that are written once, and a small file that names the live ones.

A change writes new folders and then publishes a new state, a JSON object, as the file of the next number.  That file
appears whole or not at all, so a reader sees the state before or after a change, and a change that fails leaves the
old one in place with some folders that nothing names.  Of two writers that start from one state the second is refused
and starts over from the state of the first.  ``tidy`` removes folders that the last states no longer name.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from trolley.sources.files import file_system

#: States whose folders are kept: readers of an older one must open the table again.
KEPT = 3

_FILE = re.compile(r"(\d{12})\.json")


class Conflict(RuntimeError):
    """Another writer has published a state since this one was read."""


class Versions:
    """The states of the tables below a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self.root = root.rstrip("/")

    def _numbers(self) -> list[int]:
        where, files = file_system(self._spark, f"{self.root}/versions")
        if not files.exists(where):
            return []
        found = (_FILE.fullmatch(s.getPath().getName()) for s in files.listStatus(where))
        return sorted(int(f[1]) for f in found if f)

    def _path(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def _state(self, number: int) -> dict:
        where, files = file_system(self._spark, self._path(number))
        stream = files.open(where)
        try:
            return json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """The number of the last state and the state; 0 and an empty one if there is none."""
        numbers = self._numbers()
        return (numbers[-1], self._state(numbers[-1])) if numbers else (0, {})

    def publish(self, state: dict, after: int) -> int:
        """Make ``state`` the one that follows number ``after``."""
        jvm = self._spark.sparkContext._jvm
        draft, files = file_system(self._spark, f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(self._path(after + 1))
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        never_over = self._spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.getUri(), self._spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), never_over)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(f"state {after + 1} of {self.root} has been published by another writer") from error
            raise
        return after + 1

    def update(self, change: Callable[[dict], dict | None]) -> dict:
        """Publish what ``change`` makes of the current state (None: leave it), starting over after a conflict."""
        while True:
            number, state = self.current()
            new = change(json.loads(json.dumps(state)))
            if new is None:
                return state
            try:
                self.publish(new, number)
            except Conflict:
                continue
            return new

    def tidy(self) -> None:
        """Remove old states, and the folders below the root that only they name."""
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if not old:
            return
        live = {name for number in kept for name in _folders(self._state(number))}
        for number in old:
            for name in sorted(set(_folders(self._state(number))) - live):
                where, files = file_system(self._spark, f"{self.root}/{name}")
                files.delete(where, True)
            where, files = file_system(self._spark, self._path(number))
            files.delete(where, False)


def fresh(name: str) -> str:
    """A folder name that nothing has yet."""
    return f"{name}/version-{uuid.uuid4().hex}"


def _folders(state: object) -> Iterator[str]:
    """All folder names in a state: the texts made by ``fresh``."""
    if isinstance(state, str):
        if "/version-" in state:
            yield state
    elif isinstance(state, dict):
        for value in state.values():
            yield from _folders(value)
    elif isinstance(state, list):
        for value in state:
            yield from _folders(value)
