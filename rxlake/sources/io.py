"""Sources and sinks.

Raw files are read as text (no ``inferSchema``, no read-time schema: a
schema binds by position and would silently swap columns when two yearly
files order them differently, SURVEY D17).  Writes go to Parquet.  Tables
that are rewritten while being read go through a staging path and a swap.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rxlake import fixed_values as FV
from rxlake.functions import text as T
from rxlake.operators import rank as R
from rxlake.operators import shape as S


# ------------------------------------------------------------------ reads ---
def read_csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8",
                  na_words: bool = True) -> DataFrame:
    """Header CSV as text columns, pandas-compatible quoting.

    ``multiLine`` keeps quoted line breaks in one cell and ``escape='"'``
    reads doubled quotes; a UTF-8 BOM is dropped from the header.  For the
    Korean code page pass ``encoding="MS949"`` (needs
    ``spark.sql.legacy.javaCharsets=true``, set by ``rxlake.session``).
    ``multiLine`` makes a file unsplittable: land it as Parquet once.
    """
    df = (spark.read.option("header", True).option("multiLine", True)
          .option("escape", '"').option("encoding", encoding).csv(path))
    if na_words:
        df = df.select(*[T.na_words_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", encoding: str = "UTF-8") -> DataFrame:
    """S3 re-aimed: workbooks are landed as CSV or Parquet, then read here."""
    if fmt == "csv":
        return read_csv_text(spark, path, encoding=encoding)
    if fmt == "cp949":
        return read_csv_text(spark, path, encoding="MS949")
    return spark.read.format(fmt).load(path)


def file_order(df: DataFrame) -> Column:
    """Position of a row of a file scan: (file path, start of its block, row in
    the block), whatever order Spark packs the blocks into partitions.

    Only a DataFrame that still carries the scan's hidden metadata has a file
    order; for any other an order column must be given.
    """
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        raise ValueError("no file order: read the rows from files or give an order column") from None
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


#: formats that are text: parsed once, into a landed copy, by ``load_sources``
TEXT_FORMATS = ("csv", "cp949")


def find_sources(spark: SparkSession, folder: str) -> list:
    """S5 for a folder: ``(year, path, fmt)`` of its files whose name holds one year, by (year, path).

    The year is the only number of four digits from 1900 to 2099 in the name; a name with none
    or with several different ones names no year and is left out.  ``.csv`` is read in the
    original's code page, ``.parquet`` as it is.
    """
    fs, jpath = _fs(spark, folder)
    found = []
    for f in fs.listStatus(jpath):
        name = f.getPath().getName()
        years = set(re.findall(r"(?<!\d)(?:19|20)\d\d(?!\d)", name))
        fmt = {".csv": "cp949", ".parquet": "parquet"}.get(os.path.splitext(name)[1].lower())
        if fmt and len(years) == 1:
            found.append((int(years.pop()), f.getPath().toString(), fmt))
    return sorted(found)


def load_sources(spark: SparkSession, files: list, ord_from_scan: bool = True, landing: str | None = None):
    """Load every source that exists and can be read, tag its year.

    ``files`` is a list of ``(year, path, fmt)``.  Missing, unreadable and
    undecodable sources are skipped and reported.  Returns ``(sources, report)``
    where ``sources`` is a list of ``(year, DataFrame)`` for C1 and ``report`` a
    DataFrame ``(year, path, status, detail, rows_in)``.  Raises when nothing
    loads (as concatenating nothing does in the original).

    ``landing`` is a folder for Parquet copies of the text sources: each is
    parsed once, its rows are counted and checked by the pass that writes the
    copy, and what comes after reads the copy, by column and in splits.  Without
    it a text source is parsed here for the report and again by its reader.
    """
    loaded, report = [], []
    for year, path, fmt in files:
        if not _exists(spark, path):
            report.append((int(year), path, "missing", "", 0))
            continue
        try:
            raw = read_table(spark, path, fmt)
            df = raw.withColumn("ORD", file_order(raw)) if ord_from_scan else raw
            if fmt not in TEXT_FORMATS:
                rows, undecoded = raw.count(), 0
            else:
                marks = _marked(raw)
                if landing:
                    copy = f"{landing.rstrip('/')}/{len(report)}"
                    seen = observed_write(df, copy, {"marked": marks})
                    df = spark.read.schema(df.schema).parquet(copy)
                else:
                    seen = raw.agg(F.count(F.lit(1)).alias("rows"), marks.alias("marked")).first().asDict()
                rows = seen["rows"]
                undecoded = _undecoded(spark, path, fmt, seen["marked"] or 0)
        except Exception as e:  # noqa: BLE001 - a bad file is skipped, whatever its reader raises
            report.append((int(year), path, "failed", str(e)[:500], 0))
            continue
        if undecoded:
            report.append((int(year), path, "failed", f"{undecoded} rows do not decode", rows))
            continue
        loaded.append((int(year), S.normalize_headers(df)))                # P1
        report.append((int(year), path, "loaded", "", rows))
    if not loaded:
        raise ValueError("no source could be loaded: " + "; ".join(f"{p} {s}" for _, p, s, _, _ in report))
    rep = spark.createDataFrame(report, "year int, path string, status string, detail string, rows_in long")
    return loaded, rep


def _marked(df: DataFrame) -> Column:
    """Rows with U+FFFD, which the decoder puts for bytes outside the encoding."""
    marked = F.lit(False)
    for name, kind in df.dtypes:
        if kind == "string":
            marked = marked | F.coalesce(F.col(f"`{name}`").contains("\ufffd"), F.lit(False))
    return F.coalesce(F.sum(marked.cast("long")), F.lit(0))


def _undecoded(spark: SparkSession, path: str, fmt: str, marked: int) -> int:
    """Rows or lines that do not decode, given how many rows show the decoder's mark.

    The Korean code page has no U+FFFD, so there every marked row is a fault.  A UTF-8
    file may truly hold one: only then are its bytes looked at, line by line.
    """
    if not marked or fmt == "cp949":
        return marked
    return spark.read.text(path).where(~F.is_valid_utf8("value")).count()


def require_inputs(spark: SparkSession, paths: dict) -> None:
    """All inputs present, or stop listing the missing ones."""
    missing = [k for k, p in paths.items() if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {missing}")


# ----------------------------------------------------------------- writes ---
def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list | None = None) -> None:
    """Write a table (Parquet by default)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.save(path)


def observed_write(df: DataFrame, path: str, metrics: dict | None = None, fmt: str = "parquet", leave_out: tuple = ()) -> dict:
    """A1: write a new table and return ``rows`` and ``metrics`` (name -> aggregate) of what was written.
    The metrics may read the columns ``leave_out``, which are not written.

    The metrics come from the write's own pass (``DataFrame.observe``), right below the
    write: that is the job's last stage, whose tasks count once however often they ran.
    """
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()])
                .drop(*leave_out), path, fmt=fmt)
    return {"rows": 0} | dict.fromkeys(metrics or {}) | seen.get


def write_staged(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """``observed_write_staged`` without further metrics; returns the rows written."""
    return observed_write_staged(df, path, fmt=fmt)["rows"]


def observed_write_staged(df: DataFrame, path: str, metrics: dict | None = None, fmt: str = "parquet", leave_out: tuple = ()) -> dict:
    """Overwrite ``path`` even when ``df`` reads from it; returns what ``observed_write`` does.

    A staging copy is written next to it, counted by the same pass, and marked complete; then
    the old table is renamed aside, the copy renamed in, and the old one
    deleted.  Every rename is checked, and a failed one is undone, so a crash
    leaves the old or the new table under one of the two names.
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    staging, aside = (f"{path.rstrip('/')}.{what}-{tag}" for what in ("staging", "old"))
    seen = observed_write(df, staging, metrics, fmt, leave_out)
    fs, jpath = _fs(spark, path)
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.create(new_path(f"{staging}/{COMPLETE}"), True).close()
    had = fs.exists(jpath)
    if had and not fs.rename(jpath, new_path(aside)):
        raise OSError(f"could not rename {path}")
    if not fs.rename(new_path(staging), jpath):
        if had:
            fs.rename(new_path(aside), jpath)
        raise OSError(f"could not rename {staging}")
    if had:
        fs.delete(new_path(aside), True)
    return seen


#: written into a table's folder last; Spark's readers skip names that begin with "_"
COMPLETE = "_COMPLETE"


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    r = spark.read.format(fmt)
    return (r.option("header", True).option("multiLine", True).option("escape", '"') if fmt == "csv" else r).load(path)


def is_built(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """The target exists and holds at least one row."""
    return _exists(spark, path) and not _read(spark, path, fmt).isEmpty()


def half_built(spark: SparkSession, path: str, threshold: int | None = None, fmt: str = "parquet") -> bool:
    """The target exists but its build did not finish (no completeness marker).

    ``threshold`` adds the original's rule, ``0 < rows < threshold``, for
    tables that were written by other means; off by default, since it takes a
    small finished table for an interrupted one.
    """
    if not _exists(spark, path):
        return False
    if threshold is not None:
        return 0 < _read(spark, path, fmt).count() < threshold
    return not _exists(spark, f"{path}/{COMPLETE}")


# ---------------------------------------------------------- refresh/upsert ---
def refresh_table(raw: DataFrame, key: str, columns: list, strict: bool = False,
                  name_col: str | None = None, ord_col: str | None = None) -> DataFrame:
    """One safety or pill table, table-driven.

    clean every column (F1/F5) -> drop blank key / blank name (P7) -> first
    row per key in file order (T2) -> map to the output columns (P4/P4b/P5).
    ``ord_col`` is the order column; without one ``raw`` must be a file scan,
    whose order is used (``file_order``).
    """
    ordc = F.col(ord_col) if ord_col else file_order(raw)
    cleaned = _clean_keep_ord(raw.withColumn("_ord", ordc))
    if name_col and name_col in cleaned.columns:
        cleaned = S.drop_blank(cleaned, name_col)
    if key in cleaned.columns:
        cleaned = S.drop_blank(cleaned, key)
        cleaned = R.keep_first_by_ord(cleaned, [key], "_ord")
    mapped = S.select_strict(cleaned, columns) if strict else S.map_columns(cleaned, columns)
    return mapped


def _clean_keep_ord(df: DataFrame) -> DataFrame:
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if name == "_ord":
            out.append(c)
        else:
            out.append((T.clean_text(c) if dtype == "string" else T.to_text(c)).alias(name))
    return df.select(*out)


def upsert(old: DataFrame, new: DataFrame, keys: list, order: list) -> DataFrame:
    """Keyed upsert, last row wins (``INSERT OR REPLACE``).

    ``order`` ranks versions (e.g. ``[batch, ord]``); the highest wins.  One
    grouped ``max_by`` per key: it combines map-side, so a key with millions
    of versions never lands whole in one task.
    """
    both = old.unionByName(new, allowMissingColumns=True)
    value_cols = [c for c in both.columns if c not in keys]
    agg = both.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in value_cols]),
                 F.struct(*[F.col(c) for c in order])).alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


# ----------------------------------------------------------------- appends ---
def append_with_ids(existing: DataFrame, new: DataFrame, order: list, id_col: str = "id",
                    defaults: dict | None = None) -> DataFrame:
    """New rows get ids above the current maximum, in ``order``.

    Ids rise and are dense within the batch; ``defaults`` fills columns the
    requests do not carry (``is_enabled = 1``; a Column such as
    ``F.current_timestamp()`` for ``created_at``).  Returns only the new rows;
    append them with ``write_table(..., mode="append")``.
    """
    # scalar subquery: the current maximum id, evaluated inside the plan
    max_id = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    out = R.sequential_ids(new, order, start=max_id, id_col=id_col)
    for k, v in (defaults or {}).items():
        out = out.withColumn(k, v if isinstance(v, Column) else F.lit(v))
    return out


#: the ledger of a batch-appended table: which ids belong to which batch
LEDGER = "_batches"


def append_batch(df: DataFrame, path: str, batch: str, order: list, id_col: str = "id", defaults: dict | None = None) -> dict:
    """S14/S15 as a job that can be retried: append ``df`` to the table at ``path`` as
    batch ``batch``, with ids that continue after the batches before it.

    * The batch's range of ids is reserved first, as one small file of the ledger
      (written under a temporary name and renamed, so it is there whole or not at
      all).  A batch that is in the ledger keeps its range.
    * Its rows are one partition ``batch=...`` of the table, written with dynamic
      partition overwrite: a retry replaces what a failed attempt left.

    ``order`` ends in a unique key of the batch.  A retried batch therefore leaves
    equal rows and ids; one that comes again with another number of rows is an
    error, since other batches may have their ids after it.  One writer at a time.
    Returns ``{"batch", "first_id", "rows", "retried"}``.
    """
    spark = df.sparkSession
    rows = df.count()
    known = {r["batch"]: r for r in _ledger(spark, path)}
    if batch in known:
        first = known[batch]["first_id"]
        if known[batch]["rows"] != rows:
            raise ValueError(f"batch {batch} was appended with {known[batch]['rows']} rows, now it has {rows}")
    else:
        first = 1 + max((r["first_id"] + r["rows"] - 1 for r in known.values()), default=0)
        _reserve(spark, path, batch, first, rows)
    out = R.sequential_ids(df, order, start=first - 1, id_col=id_col)
    for k, v in (defaults or {}).items():
        out = out.withColumn(k, v if isinstance(v, Column) else F.lit(v))
    out.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("batch").parquet(f"{path.rstrip('/')}/rows")
    return {"batch": batch, "first_id": first, "rows": rows, "retried": batch in known}


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all batches (``schema`` is needed only while there are none)."""
    folder = f"{path.rstrip('/')}/rows"
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    # the batch's name is text, whatever it looks like
    plain = spark.read.parquet(folder)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != 'batch' else 'string'}" for f in plain.schema)
    return spark.read.schema(names).parquet(folder)


def _ledger(spark: SparkSession, path: str) -> list:
    """One row per batch: a few bytes each, read by the driver."""
    folder = f"{path.rstrip('/')}/{LEDGER}"
    if not _exists(spark, folder):
        return []
    fs, jpath = _fs(spark, folder)
    entries = [f.getPath().toString() for f in fs.listStatus(jpath) if f.getPath().getName().startswith("entry-")]
    if not entries:
        return []
    return spark.read.schema("batch string, first_id long, rows long").json(entries).collect()


def _reserve(spark: SparkSession, path: str, batch: str, first: int, rows: int) -> None:
    fs, folder = _fs(spark, f"{path.rstrip('/')}/{LEDGER}")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    name = f"{folder.toString()}/entry-{first:019d}-{uuid.uuid4().hex}.json"
    temporary = jpath(f"{folder.toString()}/.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray((json.dumps({"batch": batch, "first_id": first, "rows": rows}) + "\n").encode()))
    out.close()
    if not fs.rename(temporary, jpath(name)):
        raise OSError(f"could not reserve ids for batch {batch}")


# ------------------------------------------------------------------ helpers ---
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jpath


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table or folder; one that is not there is no error."""
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def _exists(spark: SparkSession, path: str) -> bool:
    if not re.match(r"/|[A-Za-z][A-Za-z0-9+.-]+:", path):      # neither absolute nor with a scheme
        path = os.path.abspath(path)
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over the cluster before CPU-heavy row work (regexes over
    whole texts, the encoder).

    A scan is only as parallel as its files and row groups; a large file
    written as one row group is read by one task.  When the scan has fewer
    partitions than the cluster has cores, repartition round-robin (Spark
    sorts before a round-robin repartition, so a retried task gets the same
    rows).  A big input already split in thousands of partitions is left
    alone: no shuffle is added.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
