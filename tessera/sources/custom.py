"""Sources written against the Python Data Source API."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def squares() -> type[DataSource]:
    """The source squares. A class made here travels to every worker with the query, also to those that don't get the application's files."""

    class SquaresReader(DataSourceReader):
        def __init__(self, options):
            self.low, self.high, self.parts = (int(options.get(k, v)) for k, v in (("low", 0), ("high", 10), ("parts", 1)))

        def partitions(self):
            return [InputPartition(k) for k in range(self.parts)]

        def read(self, partition):
            for i in range(self.low + partition.value, self.high, self.parts):
                yield i, i * i

    class SquaresStream(SimpleDataSourceStreamReader):
        """Five more ids in each batch, up to high."""

        def __init__(self, options):
            self.high = int(options.get("high", 10))

        def initialOffset(self):
            return {"at": 0}

        def read(self, start):
            end = min(start["at"] + 5, self.high)
            return iter([(i, i * i) for i in range(start["at"], end)]), {"at": end}

        def readBetweenOffsets(self, start, end):
            return iter([(i, i * i) for i in range(start["at"], end["at"])])

        def commit(self, end):
            pass

    class Squares(DataSource):
        """ids low..high-1 and their squares, in parts."""

        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "id long, square long"

        def reader(self, schema):
            return SquaresReader(self.options)

        def simpleStreamReader(self, schema):
            return SquaresStream(self.options)

    return Squares
