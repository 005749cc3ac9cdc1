"""Token-id files: ids of all documents in order, boundaries in Elias-Fano form.

A data set is a Parquet folder of records. A record has the ids of consecutive documents as one
little-endian array (16 bits where the vocabulary allows, else 32), their ``doc_id`` values, and
the boundaries between them as an Elias-Fano sequence. Spark's own writer commits the records,
so a lost or repeated task leaves no partial file, on any file system Spark can reach.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import elias_fano
from .textbytes import blocks, texts_of
from .tokens import encoder

#: Ids after which a record ends; a longer document is a record of its own.
RECORD_IDS = 1 << 20
#: Documents whose places are selected at a time.
SELECTED = 1 << 14
#: Text bytes that one sorted partition should have.
PARTITION_BYTES = 16 << 20
END = np.zeros(1, np.uint32)
RECORD = "part int, seq int, n_docs long, n_ids long, width int, ids binary, bounds binary, doc_ids binary"


def write(docs: DataFrame, path: str, tokenizer: str, words: bool = False) -> None:
    """Encode ``text`` of all ``docs``, each followed by id 0, into records under ``path`` in ascending ``doc_id`` order.

    A null text is empty and has the end id alone. Rows with a null ``doc_id`` come first; rows
    that share one are ordered by text. Other columns are left out. One shuffle, of the texts,
    into ranges of the id; ranges are numbered in ascending order, so the number of a record's
    range and its place there order all records.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // PARTITION_BYTES))

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, words)
        kind = "<u2" if encode.vocabulary <= 1 << 16 else "<u4"
        names: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0

        def record():
            nonlocal seq
            joined = np.concatenate(ids)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            values = [
                part, seq, len(sizes), len(joined), np.dtype(kind).itemsize, joined.astype(kind).tobytes(),
                elias_fano.encode(bounds), np.concatenate(names).astype("<i8").tobytes(),
            ]
            seq += 1
            ids.clear(), sizes.clear(), names.clear()
            fields = pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
                 ("ids", pa.binary()), ("bounds", pa.binary()), ("doc_ids", pa.binary())]
            )
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=fields)

        for batch in batches:
            column = batch.column("doc_id")
            # a null id is kept as the least number, which no other id may have
            doc_ids = column.fill_null(np.iinfo(np.int64).min).to_numpy()
            strings = batch.column("text")
            for low, _, texts in blocks(texts_of(strings)):
                found, begin = encode(texts)
                for row in range(len(texts)):
                    own = found[begin[row] : begin[row + 1]]
                    if sizes and held + len(own) + 1 > RECORD_IDS:
                        yield record()
                        held = 0
                    ids += [own, END]
                    sizes.append(len(own) + 1)
                    held += sizes[-1]
                    names.append(doc_ids[low + row : low + row + 1])
        if sizes:
            yield record()

    ordered = texts.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, RECORD).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``
    (with the end id) and ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers).

    Places come from each record's select directory, some documents at a time; the boundaries are
    never decoded as a whole.
    """
    records = spark.read.schema(RECORD).parquet(path)
    nothing = np.iinfo(np.int64).min

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bounds = elias_fano.Sequence(row["bounds"])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                all_names = np.frombuffer(row["doc_ids"], "<i8")
                for first in range(0, len(all_names), SELECTED):
                    names = all_names[first : first + SELECTED]
                    n = len(names)
                    # where these documents begin, and where the last one ends
                    edges = bounds.many(np.arange(first, first + n + 1))
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(names, mask=names == nothing),
                            pa.array(edges[:-1]), pa.array(np.diff(edges)), pa.array(crcs, pa.int64()),
                        ],
                        names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = records.select("part", "seq", "width", "ids", "bounds", "doc_ids").mapInArrow(
        run, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(_before(records), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _before(records: DataFrame) -> DataFrame:
    """Ids before each record: before its range, from one row a range, and before it in its range."""
    sizes = records.select("part", "seq", "n_ids")
    ranges = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(base, "part").select(
        "part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("before")
    )


def document(spark: SparkSession, path: str, part: int, seq: int, number: int) -> np.ndarray:
    """Ids of one document by its place, through the select directory of its record."""
    row = spark.read.schema(RECORD).parquet(path).where((F.col("part") == part) & (F.col("seq") == seq)).first()
    bounds = elias_fano.Sequence(row["bounds"])
    low, high = bounds.select(number), bounds.select(number + 1)
    return np.frombuffer(row["ids"], f"<u{row['width']}")[low:high].astype(np.uint32)
