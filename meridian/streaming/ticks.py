"""Cadence ticks as a stream source: every aligned instant up to now (or up to `end`), each exactly once."""

from __future__ import annotations

import datetime

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TickReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.start = datetime.datetime.fromisoformat(options["start"])
        self.step = int(options["step_seconds"])
        self.end = datetime.datetime.fromisoformat(options["end"]) if "end" in options else None
        self.most = int(options.get("ticks_per_batch", 1000))

    def initialOffset(self):
        return {"tick": 0}

    def _row(self, k):
        at = self.start + datetime.timedelta(seconds=k * self.step)
        return (k, at, (at - datetime.datetime(1970, 1, 1)).total_seconds())

    def read(self, start):
        upper = self.end or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        last = -(-int((upper - self.start).total_seconds()) // self.step)
        first = start["tick"]
        stop = max(first, min(last, first + self.most))
        return iter([self._row(k) for k in range(first, stop)]), {"tick": stop}

    def readBetweenOffsets(self, start, end):
        return iter([self._row(k) for k in range(start["tick"], end["tick"])])


class TickSource(DataSource):
    @classmethod
    def name(cls):
        return "cadence_ticks"

    def schema(self):
        return "tick_index long, anchor timestamp_ntz, epoch_s double"

    def simpleStreamReader(self, schema):
        return TickReader(dict(self.options))
