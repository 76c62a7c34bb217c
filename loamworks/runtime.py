"""Session settings, lineage cuts and size-checked broadcasts."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loamworks")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only on one machine (a local
    master) a temporary folder is used where none is named; elsewhere that is an
    error, as other nodes would not see it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loamworks-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` rows of ``row_bytes`` stay below the limit, else ``df`` for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame, files_per_core: int = 2, bytes_per_task: int = 4 << 20) -> DataFrame:
    """``df`` in enough partitions for work that costs far more than reading.

    Where ``df`` comes from enough files, their splits are kept and nothing is
    shuffled. Few files are dealt round-robin over a number of partitions that
    follows the planner's size estimate, hence no key can make a partition hot.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())
    if files >= files_per_core * cores:
        return df
    if not files:
        # Rows without files have no size estimate to go by.
        return df.repartition(cores)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, min(size // bytes_per_task, 100_000)))
