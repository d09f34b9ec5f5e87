"""Folders of Parquet files whose rows are sorted by their first column, read by ranges of it inside tasks.

Only the row groups whose range holds a wanted value are read, so a few lookups in a large store cost a few row
groups. Paths may name any file system that Arrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


class SortedFiles:
    """The Parquet files below ``path``; none if the folder is absent."""

    def __init__(self, path: str) -> None:
        plain = re.sub(r"^file:/+", "/", path)
        self.fs, root = (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)
        found = self.fs.get_file_info(fs.FileSelector(root, allow_not_found=True))
        self.names = sorted(f.path for f in found if f.path.endswith(".parquet"))
        self._footers: dict[str, list[tuple | None]] = {}

    def ranges(self, name: str) -> list[tuple | None]:
        """(least, most) of every row group of a file, None where it is not known; a file's footer is read once."""
        known = self._footers.get(name)
        if known is None:
            with self.fs.open_input_file(name) as handle:
                meta = pq.read_metadata(handle)
            stats = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
            known = self._footers[name] = [(s.min, s.max) if s is not None and s.has_min_max else None for s in stats]
        return known

    def count(self) -> int:
        """The number of rows, by the footers."""
        total = 0
        for name in self.names:
            with self.fs.open_input_file(name) as handle:
                total += pq.read_metadata(handle).num_rows
        return total

    def read(self, wanted: np.ndarray, columns: list[str], shift: int = 0) -> Iterator[pa.Table]:
        """Tables of the row groups whose range, shifted right, holds a value of ``wanted`` (sorted)."""

        def hit(low: int, high: int) -> bool:
            return np.searchsorted(wanted, high >> shift, side="right") > np.searchsorted(wanted, low >> shift, side="left")

        for table in self._groups(hit, columns):
            yield table

    def between(self, low: int, high: int, columns: list[str]) -> Iterator[pa.Table]:
        """Tables of the rows whose first column is in low .. high."""
        for table in self._groups(lambda a, b: b >= low and a <= high, columns):
            p = table.column(0).to_numpy()
            first, last = np.searchsorted(p, low, side="left"), np.searchsorted(p, high, side="right")
            yield table.slice(int(first), max(0, int(last - first)))

    def _groups(self, hit, columns: list[str]) -> Iterator[pa.Table]:
        for name in self.names:
            wanted = [i for i, r in enumerate(self.ranges(name)) if r is None or hit(*r)]
            if wanted:
                with self.fs.open_input_file(name) as handle:
                    yield pq.ParquetFile(handle).read_row_groups(wanted, columns=columns)
