"""Token ids of documents as flat files of unsigned integers with 64-bit document offsets.

Layout of a folder: for each shard `<name>.ids` (little-endian unsigned ids, 16 bits wide where the vocabulary
allows it, else 32) and `<name>.idx` (n + 1 unsigned 64-bit offsets in ids, n signed 64-bit document ids, n bytes
that are 1 where the id is not null); and the table `manifest`, which names the shards in order with each one's
first document and first id. Those bases are prefix sums over the shards' sizes. Both files can be memory-mapped.

Rows go to shards by ranges of (doc_id, text hash, row number), so neither equal ids nor repeated rows can fill one shard. Each task
attempt writes files of its own name; only names that reached the manifest count, so retries do no harm.

Null text is an empty document (its end id only); null doc_id sorts first; extra columns are ignored; an empty
table gives a manifest without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialize, narrow, scratch_path, ship_package

MANIFEST = "shard int, name string, width int, n_docs long, n_tokens long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _store(folder: str):
    """The file system and path of a folder; s3a:// and s3n:// are other names for s3://."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending id order; returns the manifest with columns
    shard, name, width, n_docs, n_tokens, first_doc, first_token."""
    ship_package(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quillmark.llm.encoding import encoder
        from quillmark.llm.textvec import text_bytes

        enc = encoder(tokenizer_file)
        width = 2 if max(enc.vocab_size - 1, end_id) < 1 << 16 else 4
        sizes: list[np.ndarray] = []
        ids_of: list[np.ndarray] = []
        valid: list[np.ndarray] = []
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4().hex[:12]}"
        out = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = out or store.open_output_stream(f"{place}/{name}.ids")
            for a, b, ids, at in enc.encode_rows(*text_bytes(batch.column("text"))):
                out.write(np.insert(ids, at[1:], end_id).astype(f"<u{width}").tobytes())
                sizes.append(np.diff(at) + 1)
            column = batch.column("doc_id")
            ids_of.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            valid.append(column.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        with store.open_output_stream(f"{place}/{name}.idx") as idx:
            for part in (offsets, np.concatenate(ids_of), np.concatenate(valid)):
                idx.write(part.tobytes())
        row = {"shard": [shard], "name": [name], "width": [width], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = narrow(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    shards = materialize(rows.mapInArrow(write, MANIFEST), "token-shards")
    # one row per shard, not per document
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = shards.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("n_docs", "first_doc"), ("n_tokens", "first_token"))))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


class TokenShard:
    """One shard, memory-mapped where its store is a local or mounted folder."""

    def __init__(self, folder: str, name: str, width: int, n_docs: int):
        store, place = _store(folder)

        def raw(kind: str, dtype: str, shape: int | None = None, offset: int = 0) -> np.ndarray:
            if store.type_name == "local":
                return np.memmap(f"{place}/{name}.{kind}", dtype=dtype, mode="r", offset=offset, shape=shape)
            with store.open_input_file(f"{place}/{name}.{kind}") as f:
                return np.frombuffer(f.read_at(shape * np.dtype(dtype).itemsize, offset), dtype)

        n = n_docs
        self._raw, self._dtype = raw, np.dtype(f"<u{width}")
        self.ids = raw("ids", f"<u{width}") if store.type_name == "local" else None
        self.offsets = raw("idx", "<u8", n + 1)
        self.doc_ids = raw("idx", "<i8", n, 8 * (n + 1))
        self.valid = raw("idx", "u1", n, 8 * (2 * n + 1))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids of the documents [a, b): mapped, or read from a store that can't be mapped, no more than these."""
        first, last = int(self.offsets[a]), int(self.offsets[b])
        return self._raw("ids", self._dtype, last - first, first * self._dtype.itemsize) if self.ids is None else self.ids[first:last]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.range(i, i + 1)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document read back from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(folder, row["name"], row["width"], row["n_docs"])
                for a in range(0, len(shard), 8192):
                    b = min(a + 8192, len(shard))
                    at = shard.offsets[a : b + 1].astype(np.int64)
                    ids = np.asarray(shard.range(a, b)).astype("<u4").tobytes()
                    cut = (4 * (at - at[0])).tolist()
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
                    doc_ids = pa.array(np.asarray(shard.doc_ids[a:b]), mask=np.asarray(shard.valid[a:b]) == 0)
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(row["first_token"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=READ)

    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "name", "width", "n_docs", "first_token")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Writes token files of documents to a new folder in the shared store and reads them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    write_token_files(docs, folder, tokenizer_file, end_id)
    return read_token_files(spark, folder)
