"""Session helpers: table access, checkpoints and parallelism, all read from the running session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only where none is named (tests, laptops) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stenoflow-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there: the lineage is cut and the result survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _shared_folder(spark: SparkSession) -> str | None:
    """The cluster's shared folder as a local path, where it is one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = (named or "").removeprefix("file://")
    return path if path.startswith("/") else None


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python workers can import it wherever they run.

    Spark's own file service hands the archive out; it is made in the shared folder where there is one.
    """
    import os
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_stenoflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    shared = _shared_folder(spark)
    if shared:
        os.makedirs(shared, exist_ok=True)
    folder = tempfile.mkdtemp(prefix="stenoflow-code-", dir=shared)
    archive = str(Path(folder, f"{root.name}.zip"))
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._stenoflow_shipped = True
