"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 100


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the context's checkpoint folder, else spark.checkpoint.dir; a temporary one only in local
    mode."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpuslens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder.  A checkpoint remembers what its filters imply, and plans that add to it round by round take
    longer each time; a table does not."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """edges: u, v and the columns of by, each of whose values has a graph of its own.  (by ..., node, root), root being the smallest node that
    edges reach.  Each round a node takes the least root of its neighbours and then that root's root, so the rounds grow with the
    logarithm of the longest way."""
    by = list(by)
    both = durable(edges.select(*by, "u", "v").unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    now = durable(both.groupBy(*by, F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
    for _ in range(MAX_ROUNDS):
        near = both.join(now.select(*by, F.col("node").alias("v"), "root"), [*by, "v"]).groupBy(*by, F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, [*by, "node"]).select(*by, "node", F.least("root", "near").alias("root"))
        jump = step.join(step.select(*by, F.col("node").alias("root"), F.col("root").alias("top")), [*by, "root"], "left").select(*by, "node", F.least("root", F.coalesce("top", "root")).alias("root"))
        then = written(jump)
        if not then.join(now, [*by, "node", "root"], "left_anti").limit(1).count():
            return then
        now = then
    raise RuntimeError("components did not settle")
