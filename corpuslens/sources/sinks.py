"""Append-only, run-versioned writes, reports and their publication."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _free(spark: SparkSession, path: str, join: str = "_", ending: str = "", first: int = 1) -> str:
    """path + ending, or with the first number for which nothing is there."""
    fs, p = _fs(spark, path + ending)
    k, name = first, path + ending
    while fs.exists(p):
        name = f"{path}{join}{k}{ending}"
        p, k = _fs(spark, name)[1], k + 1
    return name


def write_artifact(df: DataFrame, path: str, run_id: str | None = None, now: datetime | None = None) -> str:
    """Write df as JSON under path_<run id> (an error if it is there), or without a run under path_<time> (numbered if that is taken),
    and make it the canonical copy: path is a small file that names it, replaced in one rename.  No copy is ever touched again, so
    readers (see read_artifact) find the old one or the new one, whole, at any time.  The name of the new copy."""
    spark, path = df.sparkSession, path.rstrip("/")
    copy = f"{path}_{re.sub(r'[^\w-]', '_', run_id)}" if run_id else _free(spark, f"{path}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}")
    df.write.mode("errorifexists").json(copy)
    _put(spark, f"{path}.next", copy.rsplit("/", 1)[-1])
    _replace(spark, f"{path}.next", path)
    return copy


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename source to target, whether or not target is there."""
    jvm = spark._jvm
    overwrite = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = overwrite
    fs, a = _fs(spark, source)
    qualified = fs.makeQualified(a)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(qualified, fs.makeQualified(_fs(spark, target)[1]), options)


def current_artifact(spark: SparkSession, path: str) -> str:
    """The copy that path names now."""
    name = spark.read.text(path).first()[0]
    return f"{path.rsplit('/', 1)[0]}/{name}" if "/" in path else name


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The canonical copy."""
    return spark.read.json(current_artifact(spark, path))


def write_run(df: DataFrame, path: str, run_id: str) -> bool:
    """Write a run's rows once, under run_id=...; False (nothing written) if the run is there already."""
    spark = df.sparkSession
    target = f"{path}/run_id={run_id}"
    p = spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.mode("errorifexists").parquet(target)
    return True


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the greatest run_id (partition-pruned)."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(path)
    top = rows.agg(F.max(F.col("run_id").cast("string"))).first()[0]
    return rows.where(F.col("run_id").cast("string") == top)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append rows whose key the table lacks; how many there were."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    before = df.count()
    df.write.mode("append").parquet(path)
    return before


def csv_sample(df: DataFrame, path: str, widths: dict[str, int]) -> None:
    """Write a sample sheet with a header, long columns cut to their width."""
    df.select(*(F.left(c, F.lit(widths[c])).alias(c) if c in widths else F.col(c) for c in df.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def html_table(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small aggregate as an HTML page; rows bounds what is read to the driver."""
    return html_report(title, {title: df}, rows=rows)


def html_report(title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None, rows: int = 200) -> str:
    """A page with a section for each small aggregate: its note, a table of at most rows rows (and how many there are), and a bar
    beside the last numeric column's values.  Sections without rows say so."""
    import html

    parts, notes = [], notes or {}
    for name, df in sections.items():
        got, total = df.limit(rows).collect(), df.count()
        kinds = [f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal") for f in df.schema.fields]
        bar = max((k for k, numeric in enumerate(kinds) if numeric), default=None)
        most = max((abs(r[bar]) for r in got if r[bar] is not None), default=0) if bar is not None else 0
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = []
        for r in got:
            cells = "".join(f"<td>{html.escape('' if x is None else str(x))}</td>" for x in r)
            width = round(100 * abs(r[bar]) / most) if most and r[bar] is not None else 0
            body.append(f"<tr>{cells}" + (f'<td><div class="bar" style="width:{width}px"></div></td>' if most else "") + "</tr>")
        note = f"<p>{html.escape(notes[name])}</p>" if name in notes else ""
        table = f"<table><tr>{head}</tr>{''.join(body)}</table><p>{len(got)} of {total} rows</p>" if got else "<p>no rows</p>"
        parts.append(f"<section><h2>{html.escape(name)}</h2>{note}{table}</section>")
    style = "<style>td,th{padding:2px 8px;text-align:left}.bar{height:8px;background:#888}</style>"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title>{style}</head><body><h1>{html.escape(title)}</h1>{"".join(parts)}</body></html>'


def write_page(spark: SparkSession, path: str, text: str) -> None:
    _put(spark, path, text)


def write_topic(spark: SparkSession, topic, folder: str) -> str:
    """A topic's configuration as YAML under its slug; one that is there stays and the new one takes the next number.  Its path."""
    import yaml

    raw = {"name": topic.name, "slug": topic.slug, "event_type": topic.event_type, "description": topic.description, "windows": topic.windows, "queries": topic.queries, **topic.more}
    path = _free(spark, f"{folder}/{topic.slug}", "-", ".yaml", 2)
    _put(spark, path, yaml.safe_dump(raw, allow_unicode=True, sort_keys=False))
    return path


def publish(spark: SparkSession, source: str, target: str, page: str = "index.html") -> list[str]:
    """Copy the report folders of source (those that hold the page) to target, the root of a static host, if their page differs from
    what is there.  The folders that were copied; an error if there is no report."""
    fs, root = _fs(spark, source)
    util = spark._jvm.org.apache.hadoop.fs.FileUtil
    reports = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and fs.exists(_fs(spark, f"{f.getPath()}/{page}")[1])] if fs.exists(root) else []
    if not reports:
        raise ValueError(f"no report under {source}")
    copied = []
    for r in reports:
        to_fs, to = _fs(spark, f"{target}/{r.getName()}")
        if to_fs.exists(to):
            if _text(spark, f"{to}/{page}") == _text(spark, f"{r}/{page}"):
                continue
            to_fs.delete(to, True)
        to_fs.mkdirs(to.getParent())
        util.copy(fs, r, to_fs, to, False, spark._jsc.hadoopConfiguration())
        copied.append(r.getName())
    return sorted(copied)


def _text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def save_stage(spark: SparkSession, path: str, stage: str, **state: object) -> None:
    """Note that a stage is done, with what the next needs (a small JSON file a stage)."""
    import json

    _put(spark, f"{path}/{stage}.json", json.dumps({"stage": stage, **state}))


def done_stages(spark: SparkSession, path: str) -> dict[str, dict]:
    """State of every stage that save_stage noted."""
    import json

    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")]
    return {n[:-5]: json.loads(_text(spark, f"{path}/{n}")) for n in names}
