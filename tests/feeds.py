"""Feed a stream file by file: each file has a later modification time than the one before."""

import os
import time

import pyarrow as pa
import pyarrow.parquet as pq


class Feed:
    def __init__(self, folder):
        self.folder = str(folder)
        os.makedirs(self.folder, exist_ok=True)
        self.count = 0
        self.start = time.time() - 100_000

    def add(self, frame):
        """Write one pandas frame as the next file; times become zone-less microseconds."""
        path = f"{self.folder}/part-{self.count:05d}.parquet"
        table = pa.Table.from_pandas(frame, preserve_index=False)
        pq.write_table(table, path, coerce_timestamps="us", allow_truncated_timestamps=True)
        self.count += 1
        stamp = self.start + self.count
        os.utime(path, (stamp, stamp))
        return self
