"""Text exports of maps, spectra and fit tables as DataFrames of lines, classified, probed and typed.

A lines table has (path, line_no, raw), line_no from 1, and where files differ in format also (delim, mark, note): the
delimiter, the decimal mark and whether every line ends with a cell of text. Files are read whole by Spark's text source
and parted into lines; everything after that is column expressions, and a file that fails is a row
with a reason, never an exception.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.ranking import ranked
from .rejects import split_cells

SKIP = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "ini")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, route, bytes) of all files below ``root``: spc, vendor, text or skip by extension."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    route = F.when(ext.isin(*SKIP), "skip").when(ext == "spc", "spc").when(ext.startswith("l6"), "vendor").when(ext.isin("txt", "csv", "tsv"), "text").otherwise("skip")
    return x.select("path", ext.alias("ext"), route.alias("route"), "bytes")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """The lines table of the text files below ``root``; a final line break opens no line."""
    x = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return x.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("n", "raw")).select("path", (F.col("n") + 1).alias("line_no"), "raw")


def cells(raw: Column, delim: str = "\t") -> Column:
    return F.split(raw, f"\\Q{delim}\\E")


def _with_cells(lines: DataFrame, delim: str) -> DataFrame:
    """The lines with ``cells`` by their file's format, the cell of text left off; a line with broken quoting has none."""
    if "delim" not in lines.columns:
        lines = lines.withColumns({"delim": F.lit(delim), "mark": F.lit("."), "note": F.lit(False)})

    @F.pandas_udf("array<string>")
    def quoted(raw: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else split_cells(r, d) for r, d in zip(raw, by)], dtype=object)

    marked = F.col("raw").contains('"')
    parts = F.when(marked, F.coalesce(quoted(F.when(marked, F.col("raw")), F.col("delim")), F.array().cast("array<string>"))).otherwise(F.split("raw", F.concat(F.lit("\\Q"), F.col("delim"), F.lit("\\E"))))
    x = lines.withColumn("cells", parts)
    return x.withColumn("cells", F.when(F.col("note"), F.slice("cells", 1, F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells")))


def _number(cell: Column) -> Column:
    """The number that a cell spells with its file's decimal mark, else null."""
    text = F.trim(cell)
    other = F.when(~text.contains("."), F.replace(text, F.lit(","), F.lit(".")))
    return F.when(F.col("mark") == ",", other).otherwise(text).try_cast("double")


def _header(cells: Column) -> Column:
    """The numbers of the header's cells, blank ones skipped; empty if any other cell is no number."""
    got = F.transform(F.filter(cells, lambda c: F.trim(c) != ""), _number)
    return F.when(F.forall(got, lambda v: v.isNotNull()), got).otherwise(F.array().cast("array<double>"))


def header_numbers(raw: Column, delim: str = "\t") -> Column:
    """The numbers of a header line, blank cells skipped; empty if any other cell is no number."""
    full = F.filter(cells(raw, delim), lambda c: F.trim(c) != "")
    got = F.transform(full, lambda c: F.trim(c).try_cast("double"))
    return F.when(F.forall(got, lambda v: v.isNotNull()), got).otherwise(F.array().cast("array<double>"))


def plausible_axis(a: Column) -> Column:
    """Whether the numbers can be a spectral axis: enough finite points, one direction, span and median step within bounds."""
    n = F.size(a)
    step = F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(1))), F.slice(a, 1, F.greatest(n - 1, F.lit(1))), lambda y, x: y - x)
    sorted_steps = F.array_sort(F.transform(step, F.abs))
    m = F.size(sorted_steps)
    mid = (F.get(sorted_steps, F.floor((m - 1) / 2).cast("int")) + F.get(sorted_steps, F.floor(m / 2).cast("int"))) / 2
    finite = F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    way = F.forall(step, lambda s: s > 0) | F.forall(step, lambda s: s < 0)
    inside = (F.array_min(a) > C.SHIFT_ENVELOPE[0]) & (F.array_max(a) < C.SHIFT_ENVELOPE[1])
    return F.coalesce((n >= C.AXIS_MIN_POINTS) & finite & way & inside & (F.array_max(a) - F.array_min(a) > C.AXIS_MIN_SPAN) & (mid > C.AXIS_MIN_STEP) & (mid < C.AXIS_MAX_STEP), F.lit(False))


def classify(lines: DataFrame, delim: str = "\t") -> DataFrame:
    """(path, kind) by the first line and the name: fit_table, note, matrix_like, two_column or unknown; the first that fits.

    Every path has a kind; one without a first line is unknown unless its name tells.
    """
    x = _with_cells(lines.where("line_no = 1").dropDuplicates(["path"]), delim).select("path", F.trim("raw").alias("raw"), F.size("cells").alias("n"), F.size(_header(F.col("cells"))).alias("numbers"))
    first = lines.select("path").distinct().join(x, "path", "left")
    low = F.lower("raw")
    kind = (
        F.when(low.contains("g intensity") & low.contains("d3"), "fit_table")
        .when(F.lower(F.element_at(F.split("path", "/"), -1)).contains("note") | low.rlike("^(this is|from |note )"), "note")
        .when(F.col("numbers") >= C.AXIS_MIN_POINTS, "matrix_like")
        .when((F.col("n") == 2) | (F.size(F.split("raw", r"\s+")) == 2), "two_column")
        .otherwise("unknown")
    )
    return first.select("path", kind.alias("kind"))


def read_matrix_maps(lines: DataFrame, delim: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(points, faults): points (path, pt, x, y, w, v) of the files that are maps, and (path, reason) of the others.

    Line 1 holds the axis, every other line one or two coordinates and a reading for each channel; the
    checks run in order: numeric header, coordinate count, plausible axis. Every path is in one of the two; one without a
    first line has no numeric header.
    """
    head = lines.select("path").distinct().join(_with_cells(lines.where("line_no = 1").dropDuplicates(["path"]), delim).select("path", _header(F.col("cells")).alias("w")), "path", "left")
    head = head.withColumn("w", F.coalesce("w", F.array().cast("array<double>")))
    body = _with_cells(lines.where("line_no > 1 AND trim(raw) <> ''"), delim).select("path", "line_no", F.transform("cells", _number).alias("c"))
    width = body.groupBy("path").agg(F.min(F.size("c")).alias("lo"), F.max(F.size("c")).alias("hi"))
    seen = head.join(width, "path", "left")
    coords = F.col("lo") - F.size("w")
    reason = F.when(F.size("w") == 0, "header is not numeric").when(F.col("lo").isNull() | (F.col("lo") != F.col("hi")) | ~coords.isin(1, 2), "coordinate count").when(~plausible_axis(F.col("w")), "axis is not plausible")
    seen = seen.select("path", "w", coords.alias("k"), reason.alias("reason"))
    good = body.join(seen.where("reason IS NULL"), "path")
    points = good.select("path", (F.col("line_no") - 2).alias("pt"), F.get("c", F.lit(0)).alias("x"), F.when(F.col("k") == 2, F.get("c", F.lit(1))).alias("y"), "w", F.expr("slice(c, k + 1, size(w))").alias("v"))
    return points, seen.where("reason IS NOT NULL").select("path", "reason")


def read_fit_tables(lines: DataFrame, delim: str = "\t") -> DataFrame:
    """(path, idx, the nine fit columns): rows after the header whose parameters are all finite; lines with under ten cells are left out."""
    c = lines.where("line_no > 1").select("path", F.transform(cells(F.col("raw"), delim), lambda x: F.trim(x).try_cast("double")).alias("c")).where(F.size("c") >= 10)
    ok = F.forall(F.slice("c", 2, 9), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return c.where(ok).select("path", F.get("c", F.lit(0)).cast("int").alias("idx"), *[F.get("c", F.lit(i + 1)).alias(n) for i, n in enumerate(C.FIT_COLUMNS)])


def contiguous(fits: DataFrame) -> DataFrame:
    """(path, contiguous): whether the indices are 1..n."""
    x = fits.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("u"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return x.select("path", F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("u") == F.col("n")), F.lit(False)).alias("contiguous"))


def fit_quality(fits: DataFrame) -> DataFrame:
    """The fit rows with g_ok, d3_ok, ratio_ok and pinned (a width exactly at its bound in a band that is ok)."""
    g, d = F.col("G_I") > 0, F.col("D3_I") > 0
    at = lambda c: F.col(c).isin(*C.FIT_BOUNDS[c])
    return fits.withColumns({"g_ok": g, "d3_ok": d, "ratio_ok": g & d, "pinned": (at("G_W") & g) | (at("D3_W") & d)})


def read_two_column(lines: DataFrame, kind: str = "spectrum", sep: str = r"[\t ,;]+") -> DataFrame:
    """(path, kind, w, v): one spectrum a file, sorted by axis; lines without two numbers are left out."""
    c = lines.select("path", "line_no", F.transform(F.split(F.trim("raw"), sep), lambda x: x.try_cast("double")).alias("c")).where("size(c) >= 2 AND c[0] IS NOT NULL AND c[1] IS NOT NULL")
    one = c.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.get("c", F.lit(0)).alias("w"), "line_no", F.get("c", F.lit(1)).alias("v")))).alias("a"))
    return one.select("path", F.lit(kind).alias("kind"), F.transform("a", lambda r: r["w"]).alias("w"), F.transform("a", lambda r: r["v"]).alias("v"))


def read_quick_maps(lines: DataFrame, delim: str = "\t") -> DataFrame:
    """(path, i, v): rows of a 2-D table without its header row and first column, cells that are no number null; i counts from 0."""
    x = _with_cells(lines.where("line_no > 1 AND trim(raw) <> ''"), delim)
    x = x.select("path", "line_no", F.transform(F.expr("slice(cells, 2, greatest(size(cells) - 1, 0))"), _number).alias("v"))
    return ranked(x, ["path"], [F.col("line_no").asc()], "n").select("path", (F.col("n") - 1).cast("int").alias("i"), "v")


def read_any_map(lines: DataFrame, delim: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(points, quick): the typed map scan, and of the files it refuses the rows as plain tables with the reason."""
    points, faults = read_matrix_maps(lines, delim)
    quick = read_quick_maps(lines.join(faults.select("path"), "path", "left_semi"), delim)
    return points, quick.join(faults, "path")
