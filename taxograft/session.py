"""Session settings, the shared scratch folder and lineage cuts.

Iterative operators cut their lineage by writing each round to a table in the folder that
``spark.checkpoint.dir`` names. That folder is shared by all executors, so a lost executor never loses
a round. Only where the setting is absent and the master is local is a temporary folder used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "taxograft", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; existing settings of a cluster win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session, else (local masters only) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="taxograft-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables written during one operator call.

    ``keep`` writes a frame and returns it read back, which cuts the lineage after one computation and
    gives the planner real sizes for its broadcast decisions. ``drop`` deletes a superseded table; what
    the caller still reads stays until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._delete, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._scratch = self  # keeps the id valid as long as the frame lives
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(target, True)
        except Exception:  # the session may be gone by then; the folder is scratch
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
