"""Depth rasters in blocks of time: 16-bit differences and packed sky bits, compressed block by block.

A recording is cut into blocks of BLOCK_FRAMES frame numbers. A block is one row of a Parquet table: the frame numbers it
holds, the shape, and the compressed bytes of its depth (half floats; the first frame as it is, then differences in time
of the bit patterns) and of its sky bits. Rows are sorted by recording and block, so the statistics of the file are the table of
offsets: reading a few frames reads the row groups that hold them. Blocks are coded by themselves, whatever the length
of the recording. Single-file archives, which hold a whole recording, are read block by block and can be written for exchange.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_FRAMES = 64
LEVEL = 6
#: Bytes of a row group: a few blocks of ordinary size.
GROUP_BYTES = 8 << 20
# The head of a compressed archive.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"

FRAMES = "run string, frame_number int, is_metric boolean, h int, w int, depth array<float>, sky array<boolean>"
BLOCKS = "run string, block long, first_frame int, last_frame int, is_metric boolean, h int, w int, frame_numbers array<int>, depth binary, sky binary"


def pack_depth(depth: np.ndarray, level: int = LEVEL) -> bytes:
    """Compressed differences in time of half-float frames (n, h, w)."""
    import zstandard

    bits = np.ascontiguousarray(depth, np.float16).view(np.int16)
    delta = bits.copy()
    delta[1:] -= bits[:-1]
    return zstandard.ZstdCompressor(level=level).compress(delta.tobytes())


def unpack_depth(raw: bytes, n: int, h: int, w: int) -> np.ndarray:
    import zstandard

    delta = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int16).reshape(n, h, w)
    return np.cumsum(delta, axis=0, dtype=np.int16).view(np.float16)


def pack_sky(sky: np.ndarray, level: int = LEVEL) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.packbits(sky).tobytes())


def unpack_sky(raw: bytes, n: int, h: int, w: int) -> np.ndarray:
    import zstandard

    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.unpackbits(bits, count=n * h * w).reshape(n, h, w).astype(bool)


def _rasters(table: pa.Table | pa.RecordBatch, name: str, h: int, w: int) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, h, w)


def _block(level: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_number")
        one = lambda c: table.column(c)[0].as_py()
        h, w, numbers = one("h"), one("w"), table.column("frame_number").to_pylist()
        sky = table.column("sky")
        packed = None if sky.null_count else pack_sky(_rasters(table, "sky", h, w).astype(bool), level)
        row = [one("run"), one("block"), numbers[0], numbers[-1], one("is_metric"), h, w, numbers, pack_depth(_rasters(table, "depth", h, w), level), packed]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return run


def encode(frames: DataFrame, block: int = BLOCK_FRAMES, level: int = LEVEL) -> DataFrame:
    """A row for each block of ``frames`` (FRAMES). Frames of another shape, or without a sky where others have one, are in blocks of
    their own; a frame number that comes twice is kept twice."""
    fields = [x.split() for x in FRAMES.split(", ")]
    rows = frames.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).filter("depth is not null")
    keyed = rows.withColumn("block", F.floor(F.col("frame_number") / block)).withColumn("_bare", F.col("sky").isNull())
    return keyed.groupBy("run", "block", "h", "w", "is_metric", "_bare").applyInArrow(_block(level), BLOCKS)


def write_blocks(frames: DataFrame, path: str, block: int = BLOCK_FRAMES, level: int = LEVEL, mode: str = "errorifexists") -> None:
    """Writes the blocks by recording and time. A write that fails leaves no rows: Spark commits the files of a job together."""
    coded = encode(frames, block, level)
    ordered = coded.repartitionByRange("run", "first_frame").sortWithinPartitions("run", "first_frame")
    ordered.write.mode(mode).option("parquet.block.size", GROUP_BYTES).parquet(path)


def decode(blocks: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The frames of blocks, those that ``wanted`` (a condition on run and frame_number) selects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, h, w = len(r["frame_numbers"]), r["h"], r["w"]
                depth = unpack_depth(r["depth"], n, h, w).astype(np.float32)
                sky = None if r["sky"] is None else unpack_sky(r["sky"], n, h, w)
                yield frame_batch(r["run"], np.array(r["frame_numbers"], np.int32), r["is_metric"], depth, sky)

    out = blocks.mapInArrow(run, FRAMES)
    return out if wanted is None else out.filter(wanted)


def frame_batch(run: str, numbers: np.ndarray, metric: bool, depth: np.ndarray, sky: np.ndarray | None, name: str = "run") -> pa.RecordBatch:
    n, h, w = depth.shape
    cuts = pa.array(np.arange(n + 1) * (h * w), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(depth.reshape(-1).astype(np.float32))), pa.nulls(n, pa.list_(pa.bool_())) if sky is None else pa.ListArray.from_arrays(cuts, pa.array(sky.reshape(-1)))]
    columns = [pa.array([run] * n, pa.string()), pa.array(numbers, pa.int32()), pa.array([metric] * n, pa.bool_()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), *lists]
    return pa.RecordBatch.from_arrays(columns, names=[name, *[x.split()[0] for x in FRAMES.split(", ")][1:]])


def read_blocks(spark: SparkSession, path: str, run: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames of a table of blocks: all, those of one recording, or those from ``first`` to ``last`` (both included). The conditions
    reach the scan, and blocks without a wanted frame are not decoded."""
    blocks, wanted = spark.read.schema(BLOCKS).parquet(path), F.lit(True)
    if run is not None:
        blocks, wanted = blocks.filter(F.col("run") == run), wanted & (F.col("run") == run)
    if first is not None:
        blocks, wanted = blocks.filter(F.col("last_frame") >= first), wanted & (F.col("frame_number") >= first)
    if last is not None:
        blocks, wanted = blocks.filter(F.col("first_frame") <= last), wanted & (F.col("frame_number") <= last)
    return decode(blocks, wanted)


def pack_archive(numbers: np.ndarray, depth: np.ndarray, sky: np.ndarray | None, metric: bool, level: int = 19) -> bytes:
    """A whole recording as one compressed archive."""
    import zstandard

    bits = np.ascontiguousarray(depth, np.float16).view(np.int16)
    delta = bits.copy()
    delta[1:] -= bits[:-1]
    # The names of the archive's arrays.
    arrays = {"frame_indices": numbers.astype(np.int32), "is_metric": np.array(metric), "_depth_delta_i16": delta, "_depth_shape": np.array(depth.shape, np.int64), "_depth_dtype": np.array("float16")}
    if sky is not None:
        arrays |= {"_sky_packed": np.packbits(sky), "_sky_shape": np.array(sky.shape, np.int64)}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=level).compress(out.getvalue())


def archives(frames: DataFrame, level: int = 19) -> DataFrame:
    """run and content, the bytes of its archive. The format is one file a recording, so a recording's frames meet in one task; ``write_blocks``
    has no such bound."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_number")
        one = lambda c: table.column(c)[0].as_py()
        sky = None if table.column("sky").null_count else _rasters(table, "sky", one("h"), one("w")).astype(bool)
        raw = pack_archive(table.column("frame_number").to_numpy(), _rasters(table, "depth", one("h"), one("w")), sky, bool(one("is_metric")), level)
        return pa.table([pa.array([one("run")]), pa.array([raw], pa.binary())], names=["run", "content"])

    fields = [x.split() for x in FRAMES.split(", ")]
    return frames.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).groupBy("run").applyInArrow(run, "run string, content binary")


def open_archive(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of an archive: Zstandard around differences in time of the 16-bit patterns, or a plain archive."""
    if raw[:4] != ZSTD_MAGIC:
        data = np.load(io.BytesIO(raw))
        return {k: data[k] for k in data.files}
    import zstandard

    data = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 33)))
    out = {k: data[k] for k in data.files if not k.startswith(("_depth", "_sky"))}
    if "_depth_delta_i16" in data.files:
        out["depth"] = np.cumsum(data["_depth_delta_i16"], axis=0, dtype=np.int16).view(np.dtype(str(data["_depth_dtype"]))).reshape(tuple(data["_depth_shape"]))
    if "_sky_packed" in data.files:
        shape = tuple(data["_sky_shape"])
        out["sky"] = np.unpackbits(data["_sky_packed"], count=int(np.prod(shape))).reshape(shape).astype(bool)
    return out


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, frame_number, is_metric, h, w, depth (row-major) and sky (null if the file has none) of each frame of archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                a = open_archive(raw.as_py())
                for lo in range(0, len(a["depth"]), BLOCK_FRAMES):
                    part = slice(lo, lo + BLOCK_FRAMES)
                    yield frame_batch(name, a["frame_indices"][part], bool(a.get("is_metric", False)), a["depth"][part], a["sky"][part] if "sky" in a else None, "path")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FRAMES.replace("run ", "path ", 1))
