"""Python workers that live on, and the driver, hold no memory that they have freed."""

import os

import pyarrow as pa

from quillmark.runtime import lean, materialize, release


def resident(process="self") -> int:
    with open(f"/proc/{process}/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")


def test_a_task_gives_back_what_it_has_freed():
    kept = []

    def work(batches):
        for batch in batches:
            many = [bytearray(b"x" * 100_000) for _ in range(2000)]
            kept.append(bytearray(b"x" * 100_000))  # so that the heap can't shrink from its end
            yield pa.RecordBatch.from_arrays([pa.array([len(many)])], names=["n"])

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
    before = resident()
    assert [b.column("n")[0].as_py() for b in lean(work)(iter([batch]))] == [2000]
    assert resident() - before < 50_000_000


def test_a_table_made_gives_back_what_the_driver_has_freed(spark):
    jvm = spark.sparkContext._jvm
    process = jvm.java.lang.ProcessHandle.current().pid()
    held = [jvm.java.util.zip.Deflater() for _ in range(4000)]
    for i, d in enumerate(held):
        if i % 20:  # the others stay, so that the heap can't shrink from its end
            d.end()
    freed = resident(process)
    materialize(spark.range(10), "memory")
    assert freed - resident(process) > 150_000_000
    for d in held[::20]:
        d.end()
    release(spark)
