"""Session helpers shared by every operator: package shipping, shared scratch tables, file system access."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, whatever their PYTHONPATH is.

    The sources are zipped and added to the context once; a no-op on later calls.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quillmark_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quillmark-"), "quillmark_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("quillmark", os.path.relpath(path, PACKAGE_DIR)))
    sc.addPyFile(target)
    sc._quillmark_shipped = True


def give_back() -> None:
    """Returns to the system what this process has freed. Python workers live on from task to task, and what the memory
    allocators of C and Arrow keep for them counts against their executor's memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only the C library of GNU has it
        ctypes.CDLL(None).malloc_trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """The same for the driver: for this process and its JVM, in which hundreds of threads plan and compile small jobs; the C
    library keeps what they free for each of them. JVMs without the command, which came with 17.0.9, stay as they are."""
    give_back()
    with contextlib.suppress(Py4JError):
        sc = spark.sparkContext
        named, new = sc._jvm.java.lang.Class.forName, sc._gateway.new_array
        # by reflection, as the class of the server is not open to callers
        types = new(sc._jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = named(name)
        values = new(sc._jvm.java.lang.Object, 4)
        values[0] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = "systemTrimNativeHeap"
        server = sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)


def lean(work):
    """The same function for mapInArrow; it gives back freed memory after some megabytes of input, and at the end of a task."""

    def run(batches):
        def fed():
            passed = 0
            for batch in batches:
                passed += batch.nbytes
                yield batch
                batch = None
                if passed > 1 << 23:
                    passed = 0
                    give_back()

        try:
            yield from work(fed())
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where there is neither, a temporary folder is chosen, but only on a single machine; a cluster's machines would each
    write to a folder of their own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    own = getattr(sc, "_quillmark_scratch", None)
    if own is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="quillmark-shared-")
        sc._quillmark_scratch = own
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; remembered for release()."""
    path = f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex[:12]}"
    _scratch(spark).append(path)
    return path


def _scratch(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_quillmark_paths"):
        sc._quillmark_paths = []
    return sc._quillmark_paths


def mark(spark: SparkSession) -> int:
    """A point in time for release()."""
    return len(_scratch(spark))


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch tables and files made since a mark, but for the paths to keep.

    Results of operators read such tables; call this when what follows no longer reads any of them.
    """
    paths = _scratch(spark)
    for path in paths[since:]:
        if path not in keep:
            delete_path(spark, path)
    paths[since:] = [p for p in paths[since:] if p in keep]


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage.

    Unlike an executor-local cache the table survives lost executors. Its place is in `df.quillmark_path`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillmark_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables made by materialize that nothing will read any more."""
    for t in tables:
        delete_path(t.sparkSession, t.quillmark_path)
        if t.quillmark_path in _scratch(t.sparkSession):
            _scratch(t.sparkSession).remove(t.quillmark_path)
