"""Messages delivered more than once: exactly one delivery of each message stays (problem 3).

Method. The log stores the kept delivery of every message by range of the hash of its identifier, and in it by day of
arrival, and for every day a Bloom filter of about two bytes an identifier, cut into the same ranges and sized by the
day's count. A range has folders of its own, so a task opens the files of its ranges only. A batch is reduced to the first delivery of each of its messages; a task takes ranges of hashes
and probes the days' filters: an identifier that no filter has is definitely new. Only the others, possible repeats,
are compared exactly, with the row groups of just those days whose filter has them. Nothing stored is shuffled.

Batches may bring an earlier delivery of a stored message; then the new one is kept and the stored one is a repeat
after all. When there are many batches they are merged into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.session import remove_path, scratch_path
from lakesieve.sources.sorted_files import SortedFiles

#: White space that an identifier is stripped of: the blanks of Unicode and the line ends.
BLANKS = "[\\s\\u000B\\u001C-\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
#: Ranges of hashes that days' filters are cut into; bits of a filter per identifier; bits that one sets in a block.
RANGES, BITS_EACH, HASHES = 64, 16, 7
_BLOCK_BITS = 512
#: Folders that the ranges are stored in, by twos: as many as Spark lists without a job of its own.
FOLDERS = 32
#: Bytes of a row group of the stored identifiers.
ROW_GROUP = 1 << 20
_KEPT = "h long, key string, at long, delivery_id long, instead_of long, day int, part int"


def strip_blanks(c: Column) -> Column:
    """``c`` without leading and trailing white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANKS}", ""), f"{BLANKS}\\z", "")


def message_key(tenant: Column, event_id: Column, fingerprint: Column, sent_at: Column) -> Column:
    """What makes deliveries one message, as a text.

    The stripped event id with the tenant; without an event id the fingerprint and the time of sending.
    A missing tenant, fingerprint or time equals another missing one.
    """
    ident = strip_blanks(event_id)
    has = ident.isNotNull() & (ident != "")
    text = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return F.concat_ws("\x01", text(tenant), F.when(has, ident).otherwise(F.lit("")), F.when(has, F.lit("")).otherwise(F.concat_ws("\x02", text(fingerprint), text(sent_at))))


def keyed(deliveries: DataFrame) -> DataFrame:
    """(h, key, at, delivery_id) of every delivery with an id; ``at`` are microseconds, a missing time is the latest."""
    at = F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit((1 << 62) - 1))
    return deliveries.where("delivery_id is not null").select(
        message_key(F.col("tenant"), F.col("event_id"), F.col("fingerprint"), F.col("sent_at")).alias("key"), at.alias("at"), F.col("delivery_id").cast("long").alias("delivery_id")
    ).withColumn("h", F.xxhash64("key"))


def _part(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - RANGES.bit_length() + 1).cast("int")


def _folder(part: int) -> int:
    return part * FOLDERS // RANGES


def _folder_of(part: Column) -> Column:
    return F.floor(part * FOLDERS / RANGES).cast("int")


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits): the block of every hash and its bits there, [hashes, HASHES]."""
    with np.errstate(over="ignore"):
        u = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        u ^= u >> np.uint64(29)
        block = ((u >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
        v = (u * np.uint64(0xBF58476D1CE4E5B9)) ^ (u >> np.uint64(17))
        bits = np.stack([(v >> np.uint64(9 * i)) & np.uint64(_BLOCK_BITS - 1) for i in range(HASHES)], 1).astype(np.int64)
    return block, bits


def bloom_filter(h: np.ndarray) -> bytes:
    """The filter of some hashes: blocks of 512 bits, BITS_EACH bits a hash."""
    blocks = max(1, -(-len(h) * BITS_EACH // _BLOCK_BITS))
    block, bits = _bits(h, blocks)
    flags = np.zeros(blocks * _BLOCK_BITS, dtype=bool)
    flags[(block[:, None] * _BLOCK_BITS + bits).ravel()] = True
    return np.packbits(flags).tobytes()


def may_hold(filter_: bytes, h: np.ndarray) -> np.ndarray:
    """Whether a filter can hold each hash; never false for one that was put in."""
    raw = np.frombuffer(filter_, dtype=np.uint8)
    block, bits = _bits(h, len(raw) * 8 // _BLOCK_BITS)
    at = block[:, None] * _BLOCK_BITS + bits
    return ((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """One table for every run of equal values of ``column``."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        v = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))).tolist() if len(v) else []
        for a, b in zip(cuts, [*cuts[1:], len(v)], strict=True):
            if open_ and open_[-1].column(column)[0].as_py() != v[a]:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
    if open_:
        yield pa.Table.from_batches(open_)


def _probed(runs: list[str]):
    """First deliveries of a batch, sorted by part, to those that are kept, with the stored ones they displace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts(batches, 6):
            part = table.column(6)[0].as_py()
            h, keys = table.column(0).to_numpy(), table.column(1).to_pylist()
            at, ids = table.column(2).to_pylist(), table.column(3).to_pylist()
            best: dict[int, tuple[int, int]] = {}
            for path in runs:
                some: dict[int, np.ndarray] = {}  # by day
                for filters in SortedFiles(f"{path}/filters/folder={_folder(part)}").read(np.array([part]), ["part", "day", "bits"]):
                    for row in filters.to_pylist():
                        if row["part"] == part:
                            hit = np.flatnonzero(may_hold(row["bits"], h))
                            if len(hit):
                                some[row["day"]] = hit
                if not some:
                    continue
                hit = np.unique(np.concatenate(list(some.values())))
                by = hit[np.argsort(h[hit], kind="stable")]
                wanted, days = h[by], np.array(sorted(some))
                for stored in SortedFiles(f"{path}/ids/folder={_folder(part)}").read(days, ["day", "h", "key", "at", "delivery_id"]):
                    sh = stored.column(1).to_numpy()
                    rows = np.flatnonzero(np.isin(sh, wanted))
                    first, last = np.searchsorted(wanted, sh[rows], side="left").tolist(), np.searchsorted(wanted, sh[rows], side="right").tolist()
                    for row, a, b in zip(stored.select([2, 3, 4]).take(pa.array(rows)).to_pylist(), first, last, strict=True):
                        for i in by[a:b].tolist():
                            if keys[i] == row["key"]:
                                old = (row["at"], row["delivery_id"])
                                best[i] = min(best.get(i, old), old)
            kept = np.array([i not in best or (at[i], ids[i]) < best[i] for i in range(len(ids))], dtype=bool)
            instead = pa.array([best[i][1] if i in best else None for i in range(len(ids))], pa.int64())
            rows = pa.table([*(table.column(i) for i in range(4)), instead, table.column(5), table.column(6)], ["h", "key", "at", "delivery_id", "instead_of", "day", "part"])
            yield from rows.filter(pa.array(kept)).to_batches()

    return run


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, day, h), sorted, to the filters (part, day, ids, bits)."""
    for part in _parts(batches, 0):
        for day in _parts(iter(part.combine_chunks().to_batches()), 1):
            h = day.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([day.column(0).slice(0, 1).combine_chunks(), day.column(1).slice(0, 1).combine_chunks(), pa.array([len(h)]), pa.array([bloom_filter(h)])], ["part", "day", "ids", "bits"])


class DeliveryLog:
    """Stored identifiers by day with Bloom filters, for batches that arrive one after another.

    ``path`` gets one folder a batch: ``ids`` (by folder of ranges, sorted by day and hash: the deliveries that were
    kept, with the stored ones they displaced) and ``filters`` (by folder, sorted by range).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = 16) -> None:
        self.spark, self.most_runs = spark, most_runs
        self.path = path or scratch_path(spark, "deliveries")
        self.runs: list[str] = []
        self._made = 0

    def _store(self, kept: DataFrame) -> str:
        self._made += 1
        run = f"{self.path}/run-{self._made}"
        placed = kept.select("day", "h", "key", "at", "delivery_id", "instead_of", "part", _folder_of(F.col("part")).alias("folder")).sortWithinPartitions("folder", "day", "h")
        placed.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("folder").parquet(f"{run}/ids")
        stored = self.spark.read.schema(_KEPT).parquet(f"{run}/ids")
        spread = stored.select("part", "day", "h").repartition(_folder_of(F.col("part"))).sortWithinPartitions("part", "day")
        filters = spread.mapInArrow(_filtered, "part int, day int, ids long, bits binary").withColumn("folder", _folder_of(F.col("part")))
        filters.write.partitionBy("folder").parquet(f"{run}/filters")
        return run

    def add(self, batch: DataFrame) -> None:
        """Take in a batch. A message of many deliveries is reduced to its first one before the shuffle."""
        first = keyed(batch).groupBy("h", "key").agg(F.min(F.struct("at", "delivery_id")).alias("f")).select("h", "key", "f.at", "f.delivery_id")
        day = F.floor(F.col("at") / 86_400_000_000).cast("int")
        placed = first.select("h", "key", "at", "delivery_id", F.lit(None).cast("long").alias("instead_of"), day.alias("day"), _part(F.col("h")).alias("part"))
        placed = placed.repartition(_folder_of(F.col("part"))).sortWithinPartitions("part")
        self.runs.append(self._store(placed.mapInArrow(_probed(list(self.runs)), _KEPT)))
        if len(self.runs) > self.most_runs:
            self.merge_runs()

    def _ids(self) -> DataFrame:
        parts = [self.spark.read.schema(_KEPT).parquet(f"{r}/ids") for r in self.runs]
        ids = parts[0]
        for p in parts[1:]:
            ids = ids.unionByName(p)
        return ids

    def kept(self) -> DataFrame:
        """(delivery_id) of the one delivery of every message that stays."""
        ids = self._ids()
        gone = ids.where("instead_of is not null").select(F.col("instead_of").alias("delivery_id"))
        return ids.select("delivery_id").join(gone, "delivery_id", "left_anti")

    def accept(self, batch: DataFrame) -> DataFrame:
        """(delivery_id) of the batch's deliveries that do not stay, and of stored ones that a delivery of the batch displaces."""
        before = len(self.runs)
        self.add(batch)
        mine = batch.where("delivery_id is not null").select(F.col("delivery_id").cast("long").alias("delivery_id")).distinct()
        fresh = mine.join(self.kept(), "delivery_id", "left_anti")
        if not before:
            return fresh
        last = self.spark.read.schema(_KEPT).parquet(f"{self.runs[-1]}/ids")
        return fresh.union(last.where("instead_of is not null").select("instead_of")).distinct()

    def merge_runs(self) -> None:
        """Merge all batches into one, without displaced deliveries."""
        ids, old = self._ids(), self.runs
        gone = ids.where("instead_of is not null").select(F.col("instead_of").alias("delivery_id")).distinct()
        left = ids.join(gone, "delivery_id", "left_anti").withColumn("instead_of", F.lit(None).cast("long"))
        self.runs = [self._store(left.select(*ids.columns).repartition(_folder_of(F.col("part"))))]
        for r in old:
            remove_path(self.spark, r)


def repeated_deliveries(deliveries: DataFrame, most_runs: int = 16) -> DataFrame:
    """``delivery_id`` of every delivery except the one to keep of each message.

    The batches (``batch_no``, where there is such a column; a missing number comes first) go through a ``DeliveryLog``
    one after another. Kept is the earliest ``received_at`` (a missing one is the latest), then the smallest
    ``delivery_id``, over all batches. Rows without delivery id are ignored; rows that repeat a delivery id count once.
    """
    spark = deliveries.sparkSession
    log = DeliveryLog(spark, most_runs=most_runs)
    if "batch_no" in deliveries.columns:
        none, stored = -(1 << 62), F.col("batch_no") if dict(deliveries.dtypes)["batch_no"] in ("int", "bigint") else F.col("batch_no").cast("long")
        number = F.coalesce(stored.cast("long"), F.lit(none))
        for b in sorted(r[0] for r in deliveries.select(number).distinct().collect()):  # as many as there are batches
            # On the stored column itself, so that row groups of other batches are not read.
            log.add(deliveries.where(stored.isNull() | (stored == b) if b == none else stored == b))
    else:
        log.add(deliveries)
    ids = deliveries.where("delivery_id is not null").select(F.col("delivery_id").cast("long").alias("delivery_id")).distinct()
    return ids.join(log.kept(), "delivery_id", "left_anti") if log.runs else ids
