"""Token-id files with a minimal perfect hash index from document keys to places.

Ids lie raw, little-endian, in shard files, documents in the order of their
key. A shard is a chain of blocks:

    "IDS1" | bytes per id u32 | length of head u32 | number of ids u64 | head | ids | 0x00

The head is an Arrow stream with the key and the number of ids of each document
in the block, from which the index is built; readers of single documents don't
need it.

The index hashes keys into buckets. A bucket of m keys has a chain of bit
arrays (each key sets the bit of the first array in which it meets no other),
which numbers the keys 0 to m - 1 without storing them, and one fingerprint,
file, offset and length per number. Looking up a key is a few hashes and one
comparison, whatever the number of documents; a key that is not there has
another fingerprint, but for one in 2**32.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.llm.encoding import encoder
from sheaf.llm.files import Window as Bytes
from sheaf.llm.files import list_files, rows_of, write_records
from sheaf.llm.words import mixed, slices
from sheaf.operators.numbering import number_documents

MAGIC = b"IDS1"
#: Bytes of ids in a block, about.
BLOCK = 1 << 20
#: Keys in a bucket of the index, about.
BUCKET = 4096
#: Bits per key of each array of the hash.
ROOM = 1.5

_HEAD = pa.schema([("key", pa.string()), ("n", pa.uint32())])


def _block(keys: list, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HEAD) as stream:
        stream.write_batch(pa.record_batch([pa.array(keys, pa.string()), pa.array(sizes, pa.uint32())], schema=_HEAD))
    head = sink.getvalue().to_pybytes()
    lead = MAGIC + np.array([width, len(head)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return lead + head + ids.astype(f"<u{width}").tobytes()


LEAD = 20


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int, width: int = 4) -> None:
    """Encode ``docs`` (doc_id, text) into shards below ``path``/ids, ``end`` closing each document.

    A null or empty text is a document of the end id alone. Documents with the
    same doc_id are kept, next to each other; a null doc_id comes first. Other
    columns are left out. ``width`` is the number of bytes of an id.
    """
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            text, keys = batch.column("text"), batch.column("key").to_pylist()
            for part in slices(text, BLOCK):
                i, n = part.first, len(part)
                ids, bounds = known.encode(text.slice(i, n))
                closed = np.insert(ids, bounds[1:], end)
                if len(closed) and closed.max() >= 1 << (8 * width):
                    raise ValueError(f"ids do not fit {width} bytes")
                block = _block(keys[i : i + n], np.diff(bounds) + 1, closed, width)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.binary())})
        pa.default_memory_pool().release_unused()

    write_records(ordered.mapInArrow(encode, "block binary"), "block", f"{path}/ids")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """``part, key, nth, file, offset, start, n`` of every document; only the heads are read.

    ``offset`` is in bytes of the file, ``start`` in ids of the whole corpus, and
    ``nth`` tells documents of one key apart.
    """
    files = list_files(spark, f"{path}/ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, at, before = Bytes(row["path"], 1 << 16), 0, 0
            while at < row["length"]:
                lead = data.read(at, LEAD)
                if lead[:4] != MAGIC:
                    raise ValueError(f"{row['path']} is damaged at byte {at}")
                width, head = np.frombuffer(lead, "<u4", 2, 4).tolist()
                total = int(np.frombuffer(lead, "<u8", 1, 12)[0])
                table = pa.ipc.open_stream(data.read(at + LEAD, head)).read_all()
                n = table.column("n").to_numpy().astype(np.int64)
                places = np.cumsum(n) - n
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(n), pa.int32()),
                        "piece": pa.array([row["piece"]] * len(n), pa.int32()),
                        "file": pa.array([row["path"]] * len(n), pa.string()),
                        "key": table.column("key").combine_chunks(),
                        "width": pa.array([width] * len(n), pa.int32()),
                        "offset": pa.array(at + LEAD + head + places * width, pa.int64()),
                        "in_file": pa.array(before + places, pa.int64()),
                        "n": pa.array(n, pa.int64()),
                    }
                )
                before += total
                at += LEAD + head + total * width + 1
            data.close()

    heads = files.repartition("path").mapInArrow(
        read, "part int, piece int, file string, key string, width int, offset long, in_file long, n long"
    )
    # one row per file
    totals = heads.groupBy("part", "piece").agg(F.sum("n").alias("_ids"))
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", "piece", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_start"))
    placed = heads.join(starts, ["part", "piece"]).select(
        "key", "file", "width", "offset", (F.col("_start") + F.col("in_file")).alias("start"), "n"
    )
    # a key of very many documents is numbered over ranges of them
    return number_documents(placed, "key", ["start", "offset"]).select(
        "key", (F.col("index") - 1).cast("int").alias("nth"), "file", "width", "offset", "start", "n"
    )


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Two independent 64-bit hashes of (key, nth) and the bucket. A null key is hashed as such."""
    one, two = (F.xxhash64(F.lit(s), F.col("key").isNull(), F.col("key"), F.col("nth")) for s in ("one", "two"))
    return keys.withColumn("h1", one).withColumn("h2", two).withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int"))


def _level(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(h1 + mixed(h2 + np.uint64(level))) % np.uint64(size)).astype(np.int64)


def _prints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h2 ^ mixed(h1)) >> np.uint64(32)).astype(np.uint32)


def build_hash(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bit arrays that number the keys; keys that meet another go on to the next array."""
    levels = []
    while len(h1):
        size = max(64, int(len(h1) * ROOM))
        at = _level(h1, h2, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = ~alone[at]
        h1, h2 = h1[left], h2[left]
        if len(levels) > 200:
            raise ValueError("keys of the index must differ")
    return levels


def number(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's number, from 0 without gaps; for keys not in the hash any number or -1."""
    out = np.full(len(h1), -1, np.int64)
    before = 0
    for k, bits in enumerate(levels):
        rank = np.cumsum(bits) - 1 + before
        at = _level(h1, h2, k, len(bits))
        here = (out < 0) & bits[at]
        out[here] = rank[at[here]]
        before += int(bits.sum())
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def write_index(spark: SparkSession, path: str) -> None:
    """Index all documents of the shards below ``path``/ids into ``path``/index: one row a bucket."""
    heads = read_heads(spark, path)
    buckets = max(1, -(-heads.count() // BUCKET))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        h1, h2 = (_unsigned(group.column(c).combine_chunks()) for c in ("h1", "h2"))
        levels = build_hash(h1, h2)
        order = np.empty(len(h1), np.int64)
        order[number(levels, h1, h2)] = np.arange(len(h1))
        entries = group.take(pa.array(order))
        return pa.table(
            {
                "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()),
                "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
                "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
                "prints": pa.array([_prints(h1, h2)[order].tobytes()], pa.binary()),
                **{
                    c: pa.array([entries.column(c).to_pylist()], pa.list_(kind))
                    for c, kind in (
                        ("file", pa.string()),
                        ("width", pa.int32()),
                        ("offset", pa.int64()),
                        ("start", pa.int64()),
                        ("n", pa.int64()),
                    )
                },
            }
        )

    schema = (
        "bucket int, levels array<binary>, sizes array<int>, prints binary, file array<string>, width array<int>, "
        "offset array<long>, start array<long>, n array<long>"
    )
    index = _hashed(heads, buckets).groupBy("bucket").applyInArrow(build, schema)
    index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index")


def look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The places of ``keys`` (key string, nth int): ``key, nth, file, width, offset, start, n``; none for unknown keys.

    Keys meet their bucket; a bucket answers all its keys at once. Repeated keys
    are answered each time.
    """
    index = spark.read.parquet(f"{path}/index")
    first = index.select("buckets").first()
    out = "key string, nth int, file string, width int, offset long, start long, n long"
    if first is None:
        return spark.createDataFrame([], out)

    found = pa.schema(
        [("key", pa.string()), ("nth", pa.int32()), ("file", pa.string()), ("width", pa.int32())]
        + [(c, pa.int64()) for c in ("offset", "start", "n")]
    )

    def answer(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        names = ["file", "width", "offset", "start", "n"]
        if not len(bucket) or not len(asked):
            return found.empty_table()
        h1, h2 = (_unsigned(asked.column(c).combine_chunks()) for c in ("h1", "h2"))
        sizes = bucket.column("sizes")[0].as_py()
        levels = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
            for x, n in zip(bucket.column("levels")[0].as_py(), sizes, strict=True)
        ]
        at = number(levels, h1, h2)
        prints = np.frombuffer(bucket.column("prints")[0].as_py(), np.uint32)
        known = np.flatnonzero((at >= 0) & (prints[np.maximum(at, 0)] == _prints(h1, h2)))
        return pa.table(
            [asked.column(c).take(pa.array(known)) for c in ("key", "nth")]
            + [bucket.column(c)[0].values.take(pa.array(at[known])) for c in names],
            names=["key", "nth", *names],
        )

    asked = _hashed(keys.select("key", F.col("nth").cast("int").alias("nth")), first[0])
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(answer, out)


def read_documents(places: DataFrame, with_ids: bool = True) -> DataFrame:
    """The ids at ``places`` (from ``look_up``): ``key, nth, start, n, crc32`` and, unless left out, ``ids``.

    ``crc32`` is that of the ids as little-endian unsigned 32-bit numbers.
    Places are read in the order of the files, ahead in steps.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, path = None, None
        for batch in batches:
            crcs, held = [], []
            for file, width, offset, n in zip(
                *(batch.column(c).to_pylist() for c in ("file", "width", "offset", "n")), strict=True
            ):
                if file != path:
                    if data:
                        data.close()
                    data, path = Bytes(file), file
                ids = np.frombuffer(data.read(offset, n * width), f"<u{width}").astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                held.append(ids if with_ids else None)
            columns = [batch.column(c) for c in ("key", "nth", "start", "n")] + [pa.array(crcs, pa.int64())]
            names = ["key", "nth", "start", "n", "crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if data:
            data.close()

    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = "key string, nth int, start long, n long, crc32 long" + (", ids array<long>" if with_ids else "")
    return ordered.mapInArrow(read, schema)


def keys_of(docs: DataFrame) -> DataFrame:
    """``key, nth``: the keys under which ``docs`` were written."""
    counted = docs.groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.count("*").cast("int").alias("_n"))
    return counted.select("key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("nth"))


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end: int, width: int = 4) -> None:
    write_ids(docs, path, tokenizer, end, width)
    write_index(docs.sparkSession, path)
