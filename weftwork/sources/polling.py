"""A streaming source that polls a growing log of lines, with offsets that can be read again."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads at most; a batch has as many tasks as it needs.
PART_BYTES = 8 << 20


class _Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _whole(self) -> int:
        """The end of the last whole line: one still being written waits."""
        if not os.path.exists(self.path):
            return 0
        with open(self.path, "rb") as f:
            at = os.path.getsize(self.path)
            while at > 0:
                start = max(0, at - (1 << 16))
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                at = start
        return 0

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        return {"bytes": self._whole()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(at, min(at + PART_BYTES, end["bytes"])) for at in range(start["bytes"], end["bytes"], PART_BYTES)]

    def read(self, part: _Part):
        """Lines that start in the part; (offset, value)."""
        with open(self.path, "rb") as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the line around the start belongs to the part before
            while at < part.end:
                line = f.readline()
                yield at, line.rstrip(b"\r\n").decode()
                at += len(line)


class PolledLines(DataSource):
    """``spark.readStream.format("polled_lines").option("path", ...)``: (offset, value) of the lines of a file that
    all executors reach, as it grows. A stream that starts again from its checkpoint goes on after the last
    batch, and reads a batch that was not finished again from its own offsets."""

    @classmethod
    def name(cls) -> str:
        return "polled_lines"

    def schema(self) -> str:
        return "offset bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])
