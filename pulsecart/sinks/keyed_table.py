"""Keyed Parquet table: batches are appended, and the last write of a key wins."""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsecart.operators.keyed import last_by, last_with_ids, with_generated_ids
from pulsecart.session import with_settings

_PART, _WRITE = "_part", "_write"
_WHOLE = "all"


class KeyedTable:
    """A table of Parquet files with one visible row per key.

    Rows lie in ``rows/_write=<token>/_part=<day>/``. A write adds folders under a new token and
    then publishes the token with one empty marker file, so readers never see half a write and no
    file is ever changed. Tokens sort in write order; a reader lets the latest one win per key.
    ``fold`` rewrites a day into a single folder, after which reading it is a plain scan.

    Keys are unique per day when ``day_column`` is set, as with one index per day. A table with
    few rows a day can take one folder per month instead, with ``part_length=7``. One writer at a
    time. A micro-batch that is replayed after it was published is skipped.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str | T.StructType,
        keys: Sequence[str],
        day_column: str | None = None,
        part_length: int = 10,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.keys = list(keys)
        self.day_column = day_column
        self.part_length = part_length

    # -- write ---------------------------------------------------------------------------------

    def write(
        self,
        rows: DataFrame,
        writer: str,
        batch_id: int,
        order: Sequence[str] = (),
        unique: bool = False,
    ) -> bool:
        """Upsert a batch; the last row of a key by ``order`` wins inside it.

        ``unique`` tells that the batch has each key once already. A text key that is null (the
        first key column) gets a generated id, the same if the batch is replayed. Returns False
        when ``writer`` has already published ``batch_id``.
        """
        done = f"{self.path}/batches/{writer}/{batch_id:012d}"
        if self._exists(done):
            return False
        named = isinstance(self.schema[self.keys[0]].dataType, T.StringType)
        source = (self.keys[0], writer, str(batch_id))
        # Streams with state turn adaptive plans off for their batches; what is made of a batch can have them. Without
        # them Spark drops the rebalancing, and every task writes a file for every day.
        with with_settings(rows.sparkSession, {"spark.sql.adaptive.enabled": "true"}):
            if unique:
                self._append(with_generated_ids(rows, *source) if named else rows)
            elif named:
                self._append(last_with_ids(rows, self.row_keys(), order, *source))
            else:
                self._append(last_by(rows, self.row_keys(), order))
        self._touch(done)
        return True

    def upsert_batches(
        self, writer: str, order: Sequence[str] = ()
    ) -> Callable[[DataFrame, int], None]:
        """The same as a ``foreachBatch`` function."""

        def sink(rows: DataFrame, batch_id: int) -> None:
            self.write(rows, writer, batch_id, order)

        return sink

    def fold(self, day: str | None = None) -> None:
        """Rewrite a day, or without one the whole table, so that it holds each key once.

        The new rows are published before the old folders go, and both say the same meanwhile.
        """
        older = {p: t for p, t in self._layout().items() if day is None or p == day}
        if all(len(tokens) < 2 for tokens in older.values()):
            return
        self._append(self._current([day] if day else None, self.schema.names))
        for part, tokens in older.items():
            for token in tokens:
                self._delete(self._folder(part, token))

    # -- read ----------------------------------------------------------------------------------

    def read(self, days: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Current rows, of the given days only if any are named.

        ``columns`` narrows the scan. Days with one write are scanned as they are. Otherwise the
        later writes are reduced to their last rows, which replace rows of the first write.
        """
        wanted = list(columns or self.schema.names)
        if days is None or self.part_length >= 10:
            return self._current(self._parts(days), wanted)
        rows = self._current(self._parts(days), list(dict.fromkeys([*wanted, self.day_column])))
        return rows.filter(F.col(self.day_column).isin(list(days))).select(*wanted)

    def _current(self, parts: Sequence[str] | None, wanted: list[str]) -> DataFrame:
        first, later = [], []
        for part, tokens in self._layout().items():
            if parts is None or part in parts:
                first.append((part, tokens[0]))
                later += [(part, token) for token in tokens[1:]]
        if parts is None:
            first, later = self._folders(first, later), self._folders(later, first)
        else:
            first, later = ([self._folder(*f) for f in fs] for fs in (first, later))
        base = self._load(first, wanted)
        if not later:
            return base.select(*wanted)
        keys = self.row_keys()
        kept = base.join(self._load(later, keys).select(*keys), keys, "left_anti")
        latest = last_by(self._load(later, wanted), keys, [_WRITE])
        return kept.select(*wanted).unionByName(latest.select(*wanted))

    def written_keys(self, days: Sequence[str] | None = None) -> DataFrame:
        """Keys of the given days as they were written, for membership tests; may repeat."""
        days = self._parts(days)
        rows = [
            (part, token)
            for part, tokens in self._layout().items()
            for token in tokens
            if days is None or part in days
        ]
        folders = self._folders(rows, []) if days is None else [self._folder(*r) for r in rows]
        return self._load(folders, self.row_keys()).select(*self.row_keys())

    def parts(self) -> list[str]:
        """Days, or months, with published rows."""
        return sorted(self._layout())

    # -- layout --------------------------------------------------------------------------------

    def row_keys(self) -> list[str]:
        """Columns that tell one row from another: the keys, and the day if each day has its own."""
        extra = [self.day_column] if self.day_column and self.day_column not in self.keys else []
        return self.keys + extra

    def _parts(self, days: Sequence[str] | None) -> list[str] | None:
        return None if days is None else sorted({d[: self.part_length] for d in days})

    def _append(self, rows: DataFrame) -> None:
        token = self._next_token()
        part = F.lit(_WHOLE)
        if self.day_column:
            part = F.substring(self.day_column, 1, self.part_length)
        placed = rows.select(*self.schema.names, F.lit(token).alias(_WRITE), part.alias(_PART))
        if self.day_column:
            # Few files per day, and several for a day that is too large for one task.
            placed = placed.hint("rebalance", _PART)
        placed.write.mode("append").partitionBy(_WRITE, _PART).parquet(f"{self.path}/rows")
        self._touch(f"{self.path}/published/{token}")

    def _load(self, folders: list[str], wanted: list[str]) -> DataFrame:
        names = [f for f in self.schema if f.name in set(wanted) | set(self.row_keys())]
        layout = T.StructType(
            [*names, T.StructField(_PART, T.StringType()), T.StructField(_WRITE, T.StringType())]
        )
        if not folders:
            return self.spark.createDataFrame([], layout)
        reader = self.spark.read.schema(layout).option("basePath", f"{self.path}/rows")
        return reader.parquet(*folders)

    def _folder(self, part: str, token: str) -> str:
        return f"{self.path}/rows/{_WRITE}={token}/{_PART}={part}"

    def _folders(self, mine: list[tuple[str, str]], others: list[tuple[str, str]]) -> list[str]:
        """Folders of day and token pairs that cover the table together with ``others``; a token
        that is not in ``others`` is named as a whole."""
        split = {token for _, token in others}
        whole = {token for _, token in mine} - split
        parts = [self._folder(part, token) for part, token in mine if token in split]
        return [f"{self.path}/rows/{_WRITE}={token}" for token in sorted(whole)] + parts

    def _published(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1] for p in self._glob(f"{self.path}/published/*"))

    def _layout(self) -> dict[str, list[str]]:
        """Published tokens of each day in write order."""
        published = set(self._published())
        found = defaultdict(list)
        for folder in self._glob(f"{self.path}/rows/{_WRITE}=*/{_PART}=*"):
            token, part = (level.split("=", 1)[1] for level in folder.split("/")[-2:])
            if token in published:
                found[part].append(token)
        return {part: sorted(tokens) for part, tokens in found.items()}

    def _next_token(self) -> str:
        last = max(self._published(), default="0-")
        number = max(time.time_ns(), int(last.split("-")[0]) + 1)
        return f"{number:020d}-{uuid.uuid4().hex[:6]}"

    # -- files ---------------------------------------------------------------------------------

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files().exists(self._path(path))

    def _touch(self, path: str) -> None:
        self._files().create(self._path(path), True).close()

    def _delete(self, path: str) -> None:
        self._files().delete(self._path(path), True)

    def _glob(self, pattern: str) -> list[str]:
        statuses = self._files().globStatus(self._path(pattern)) or []
        return [s.getPath().toString() for s in statuses]
