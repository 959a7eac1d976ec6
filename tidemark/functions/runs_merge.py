"""Merging sorted Parquet files as streams: a block of each in memory, whatever their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

ROWS = 1 << 18  # of all blocks together that are held


def opened(address: str) -> pq.ParquetFile:
    if address.startswith("file:/") and not address.startswith("file:///"):
        address = "file:///" + address[6:]
    if "://" not in address:
        return pq.ParquetFile(address)
    system, path = fs.FileSystem.from_uri(address)
    return pq.ParquetFile(system.open_input_file(path))


def _bounds(file: pq.ParquetFile, group: int) -> tuple[str | None, str | None]:
    """Least and greatest key of a row group, where the file tells."""
    meta = file.metadata.row_group(group)
    column = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == "key")
    s = column.statistics
    return (s.min, s.max) if s is not None and s.has_min_max else (None, None)


def cuts(file: pq.ParquetFile, parts: int) -> list[str]:
    """Up to parts - 1 keys that cut a file into ranges of about as many row groups."""
    groups = file.metadata.num_row_groups
    keys = {_bounds(file, i * groups // parts)[0] for i in range(1, parts)}
    return sorted(k for k in keys if k is not None)


def _at_most(keys: pa.Array, cutoff: str) -> int:
    """How many of the sorted keys don't exceed a key."""
    lo, hi = 0, len(keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if keys[mid].as_py() <= cutoff:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _blocks(file: pq.ParquetFile, columns: list[str], rows: int, low: str | None, high: str | None) -> Iterator[pa.Table]:
    """Rows with low <= key < high, block by block; row groups outside aren't read."""
    wanted = []
    for g in range(file.metadata.num_row_groups):
        least, most = _bounds(file, g)
        if not ((low is not None and most is not None and most < low) or (high is not None and least is not None and least >= high)):
            wanted.append(g)
    for batch in file.iter_batches(batch_size=rows, row_groups=wanted, columns=columns):
        t = pa.Table.from_batches([batch])
        if low is not None:
            t = t.filter(pc.greater_equal(t["key"], low))
        if high is not None:
            t = t.filter(pc.less(t["key"], high))
        if len(t):
            yield t.select(columns)


def _last_of_each(t: pa.Table) -> pa.Table:
    """Of rows sorted by key the last of each key."""
    key = t["key"].combine_chunks()
    if len(key) < 2:
        return t
    return t.filter(pa.concat_arrays([pc.not_equal(key[:-1], key[1:]), pa.array([True])]))


def merge_streams(streams: list[Iterator[pa.Table]], order: list[str]) -> Iterator[pa.Table]:
    """The highest row of each key by ``order``, in key order, out of streams sorted by distinct keys.

    Each round takes from every stream what does not exceed the least of the last keys held, so a key's rows
    are always together, and merges these few sorted pieces. Nulls are lowest.
    """
    held = [next(s, None) for s in streams]
    by = [("key", "ascending"), *((c, "ascending") for c in order)]
    while any(t is not None for t in held):
        ends = [t["key"][len(t) - 1].as_py() for t in held if t is not None]
        cutoff, pieces = min(ends), []
        for i, t in enumerate(held):
            if t is None:
                continue
            n = _at_most(t["key"], cutoff)
            if n:
                pieces.append(t.slice(0, n))
                held[i] = t.slice(n) if n < len(t) else next(streams[i], None)
        if len(pieces) == 1:
            yield pieces[0]
        else:
            both = pa.concat_tables(pieces)
            yield _last_of_each(both.take(pc.sort_indices(both, sort_keys=by, null_placement="at_start")))


def merge_files(files: list[str], columns: list[str], part: int = 0, parts: int = 1, low: str | None = None, high: str | None = None) -> Iterator[pa.Table]:
    """Part ``part`` of the merge of some files (the largest first), whose keys are cut into ``parts`` ranges."""
    sources = [opened(f) for f in files]
    if parts > 1:
        edges = cuts(sources[0], parts)
        if part > len(edges):
            return
        start, stop = edges[part - 1] if part else None, edges[part] if part < len(edges) else None
        low = max(x for x in (low, start, "") if x is not None)
        high = min((x for x in (high, stop) if x is not None), default=None)
    rows = max(1024, ROWS // len(sources))
    yield from merge_streams([_blocks(f, columns, rows, low, high) for f in sources], [c for c in columns if c != "key"])
