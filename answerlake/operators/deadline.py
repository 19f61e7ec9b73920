"""A time limit per item inside a task: a sheet that hangs becomes an error row and the others arrive."""

from __future__ import annotations

import os
import pickle
import select
import socket
import struct
import subprocess
import sys
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

START_SECONDS = 120.0  # a reader may take this long to load its models
LOOK_SECONDS = 0.03  # how often it is seen whether a reader that has not answered works or only waits
_ONE_THREAD = {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "MKL_NUM_THREADS": "1"}  # a process with threads should not fork
MOST_WAITING = 32  # readers of a task that may wait at the same time

# What the first process of a task runs: it loads the function once and forks a reader whenever one is asked for.
# A reader takes items from one pipe and answers each by (value, error) on another.
_FIRST = """
import os, pickle, signal, socket, struct, sys
link = socket.socket(fileno=int(sys.argv[1]))
def take(pipe):
    head = pipe.read(8)
    if len(head) < 8:
        return None
    return pickle.loads(pipe.read(struct.unpack("<q", head)[0]))
def reader(inp, out):
    while (item := take(inp)) is not None:
        try:
            answer = (read(item), None)
        except Exception as error:
            answer = (None, str(error) or type(error).__name__)
        data = pickle.dumps(answer)
        out.write(struct.pack("<q", len(data)) + data)
        out.flush()
read = take(sys.stdin.buffer)
link.sendall(b"ready   ")
alive = set()
while True:
    order, ends, _, _ = socket.recv_fds(link, 8, 2)
    if not order:
        break
    pid = struct.unpack("<q", order)[0]
    if pid:
        os.kill(pid, signal.SIGKILL)
        os.waitpid(pid, 0)
        alive.discard(pid)
        continue
    pid = os.fork()
    if not pid:
        link.close()
        try:
            with open(ends[0], "rb") as inp, open(ends[1], "wb") as out:
                reader(inp, out)
        finally:
            os._exit(0)
    alive.add(pid)
    for end in ends:
        os.close(end)
    link.sendall(struct.pack("<q", pid))
for pid in alive:
    os.kill(pid, signal.SIGKILL)
"""


class Reader:
    """One reader process, forked from the first process of the task, with the item it has."""

    def __init__(self, link: socket.socket):
        self.link, self.item, self.due, self.spent = link, None, 0.0, None
        items, self.to = os.pipe()
        self.answers, answers = os.pipe()
        try:
            socket.send_fds(link, [struct.pack("<q", 0)], [items, answers])
            self.pid = struct.unpack("<q", link.recv(8))[0]
        finally:
            os.close(items)
            os.close(answers)

    def give(self, item: dict, seconds: float) -> None:
        data = pickle.dumps(item)
        self.item, self.due, self.spent = item, time.monotonic() + seconds, None
        view = memoryview(struct.pack("<q", len(data)) + data)
        try:
            while view:
                view = view[os.write(self.to, view) :]
        except BrokenPipeError:
            pass  # the answers' end tells

    def take(self) -> tuple:
        head = self._bytes(8)
        data = self._bytes(struct.unpack("<q", head)[0]) if len(head) == 8 else b""
        return pickle.loads(data) if data else (None, "the reader ended")

    def _bytes(self, n: int) -> bytes:
        found = b""
        while len(found) < n and (more := os.read(self.answers, n - len(found))):
            found += more
        return found

    def waits(self) -> bool:
        """Whether it sleeps and did nothing since the last look, so that others lose no time to it. A process
        that cannot be looked at counts as working."""
        before = self.spent
        try:
            with open(f"/proc/{self.pid}/stat", "rb") as file:
                parts = file.read().rpartition(b")")[2].split()
        except OSError:
            return False
        self.spent = int(parts[11]) + int(parts[12])
        return parts[0] in (b"S", b"D") and self.spent == before

    def close(self) -> None:
        self.link.sendall(struct.pack("<q", self.pid))
        os.close(self.to)
        os.close(self.answers)


class Readers:
    """The readers of a task. Items are read one at a time, except that an item which only waits (for the rest of a
    file, a lock, a device) is set aside, up to `MOST_WAITING` of them, and the next ones go on with another reader.
    A reader that hangs at work keeps the others waiting, so that none is late because of the others."""

    def __init__(self, function: Callable[[dict], tuple], seconds: float):
        self.code, self.seconds, self.first = cloudpickle.dumps(function), seconds, None
        self.idle: list[Reader] = []
        self.waiting: dict[int, Reader] = {}
        self.looked = 0.0

    def _start(self) -> None:
        path = os.pathsep.join(p for p in sys.path if p)
        self.link, theirs = socket.socketpair()
        self.link.settimeout(START_SECONDS)
        end = str(theirs.fileno())
        with theirs:
            # what a reader prints must not go into the task's own streams
            self.first = subprocess.Popen(
                [sys.executable, "-c", _FIRST, end], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, pass_fds=[theirs.fileno()], env={**os.environ, "PYTHONPATH": path, **_ONE_THREAD}
            )
        self.first.stdin.write(struct.pack("<q", len(self.code)) + self.code)
        self.first.stdin.flush()
        if self.link.recv(8) != b"ready   ":
            raise RuntimeError("the reader could not be started")

    def read(self, item: dict) -> Iterator[tuple[dict, tuple]]:
        """Answers that have come, (item, (value, error)): of this item or of ones set aside before."""
        if self.first is None:
            self._start()
        # one that was set aside and works again has the task for itself first
        while self.waiting and time.monotonic() - self.looked > LOOK_SECONDS:
            self.looked = time.monotonic()
            if all([r.waits() for r in self.waiting.values()]):
                break
            yield from self.look()
        reader = self.idle.pop() if self.idle else Reader(self.link)
        reader.give(item, self.seconds)
        self.waiting[reader.answers] = reader
        while reader.item is item:
            yield from self.look(reader.answers)
            if reader.item is item and reader.waits() and len(self.waiting) <= MOST_WAITING:
                break

    def look(self, first: int | None = None) -> Iterator[tuple[dict, tuple]]:
        """Answers that come within a short time, or are there when that of the first reader comes."""
        ready = select.select(list(self.waiting) if first is None else [first], [], [], LOOK_SECONDS)[0]
        if first is not None and len(self.waiting) > 1:
            ready += select.select([a for a in self.waiting if a != first], [], [], 0)[0]
        now = time.monotonic()
        for answers in [a for a, r in self.waiting.items() if a in ready or r.due <= now]:
            reader = self.waiting.pop(answers)
            answer = reader.take() if answers in ready else (None, f"not read within {self.seconds:g} s")
            item, reader.item = reader.item, None
            if answers not in ready or answer[1] == "the reader ended":
                reader.close()
            else:
                self.idle.append(reader)
            yield item, answer

    def close(self) -> None:
        if self.first is not None:
            for reader in [*self.idle, *self.waiting.values()]:
                reader.close()
            self.link.close()
            self.first.stdin.close()
            self.first.wait()


def read_each(df: DataFrame, ident: str, function: Callable[[dict], tuple], fields: Mapping[str, str], seconds: float) -> DataFrame:
    """Rows (ident, *fields, error): the function of every row, or why there is none.

    The function takes a row as a dict and returns one value per field. It runs in processes of its own beside the
    task, one row at a time, apart from rows that only wait: they wait side by side. A row that raises gives its
    message; a row that takes longer than `seconds`, or that ends the process, gives an error too, and a
    fresh process, forked from one that has loaded the function, goes on with the next row. No row is
    lost and none stops the job. No process is started for tasks without rows.
    """
    names = [ident, *fields, "error"]
    added = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in (*fields.items(), ("error", "string"))))
    schema = StructType([df.schema[ident], *added.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = Readers(function, seconds)

        def row(item: dict, answer: tuple) -> tuple:
            value, error = answer
            return item[ident], *(value if error is None else [None] * len(fields)), error

        try:
            for batch in batches:
                rows = [row(*done) for item in batch.to_dict("records") for done in readers.read(item)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)
            rows = []
            while readers.waiting:
                rows += [row(*done) for done in readers.look()]
            if rows:
                yield pd.DataFrame(rows, columns=names)
        finally:
            readers.close()

    return df.mapInPandas(run, schema)
