"""Queries of the source operators over the exported lines of ``raw_lines``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.maps import assemble_grid
from ..operators.ranking import ranked
from ..operators.spectral import peak, points
from ..session import table
from ..sources import binary as B
from ..sources import files as S
from ..sources.rejects import load_lines
from .registry import query
from .spectra import POINTS_SQL

DELIMS = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def _file_lines(spark, d):
    """The lines of every file of raw_files with its format; a file without lines has one null line.

    Comment lines are no data; a repeated line counts once, and if a file is listed again the smallest entry counts.
    """
    delim = F.coalesce(*[F.when(F.col("delim") == n, F.lit(c)) for n, c in DELIMS.items()], F.lit("\t"))
    fmt = F.min(F.struct(delim.alias("delim"), F.coalesce("decimal_mark", F.lit(".")).alias("mark"), F.coalesce("has_note", F.lit(False)).alias("note")))
    f = table(spark, d, "raw_files").where("file_id IS NOT NULL").groupBy("file_id").agg(fmt.alias("f")).select("file_id", "f.*")
    x = table(spark, d, "raw_lines").where("file_id IS NOT NULL AND line_no IS NOT NULL AND raw IS NOT NULL AND NOT startswith(raw, '#')").groupBy("file_id", "line_no").agg(F.min("raw").alias("raw"))
    return f.join(x, "file_id", "left").select(F.col("file_id").alias("path"), "line_no", "raw", "delim", "mark", "note")


@query("header_probe_s01", """WITH h AS (SELECT file_id, min(raw) raw FROM raw_lines WHERE line_no = 1 AND raw IS NOT NULL GROUP BY file_id), c AS (SELECT file_id, list_filter(string_split(raw, chr(9)), lambda x: trim(x) <> '') c FROM h),
n AS (SELECT file_id, list_transform(c, lambda x: try_cast(trim(x) AS DOUBLE)) v FROM c) SELECT file_id, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN len(v) ELSE 0 END::INT channels FROM n""")
def header_probe(spark, d):
    h = table(spark, d, "raw_lines").where("line_no = 1 AND raw IS NOT NULL").groupBy("file_id").agg(F.min("raw").alias("raw"))
    return h.select("file_id", F.size(S.header_numbers(F.col("raw"))).alias("channels"))


@query("axis_plausible_s02", """WITH r AS (SELECT DISTINCT acq_id, wavenumber w FROM spectral_images WHERE wavenumber IS NOT NULL), s AS (SELECT acq_id, w, list_transform(list_zip(w[2:], w[:len(w) - 1]), lambda x: x[1] - x[2]) d FROM r)
SELECT acq_id, bool_and(len(w) >= 16 AND (list_min(d) > 0 OR list_max(d) < 0) AND list_max(w) - list_min(w) > 100 AND list_median(list_transform(d, lambda x: abs(x))) BETWEEN 0.05 AND 60 AND list_min(w) > -300 AND list_max(w) < 4500) ok FROM s GROUP BY acq_id""")
def axis_plausible(spark, d):
    x = table(spark, d, "spectral_images").where("wavenumber IS NOT NULL").select("acq_id", S.plausible_axis(F.col("wavenumber")).alias("ok"))
    return x.groupBy("acq_id").agg(F.bool_and("ok").alias("ok"))


@query("matrix_maps_s03")
def matrix_maps(spark, d):
    """Points of the files by the typed map scan; files that are no clean map are left to the loader with rejects."""
    points, _ = S.read_matrix_maps(_file_lines(spark, d))
    return points


@query("map_faults_s16")
def map_faults(spark, d):
    _, faults = S.read_matrix_maps(_file_lines(spark, d))
    return faults


@query("classes_s14")
def classes(spark, d):
    return S.classify(_file_lines(spark, d))


@query("loaded_grid_s04")
def loaded_grid(spark, d):
    """Raster cells of the maps that the loader with rejects types from the raw lines."""
    x = load_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files")).where("reason IS NULL AND line_no > 1")
    return assemble_grid(x.select(F.col("file_id").alias("acq_id"), F.col("line_no").alias("pt"), "x", "y"))


@query("routing_s13", "SELECT CASE WHEN regexp_extract(lower(source_rel), '\\.([a-z0-9]+)$', 1) = 'spc' THEN 'spc' WHEN regexp_extract(lower(source_rel), '\\.([a-z0-9]+)$', 1) LIKE 'l6%' THEN 'vendor' WHEN regexp_extract(lower(source_rel), '\\.([a-z0-9]+)$', 1) IN ('txt', 'csv', 'tsv') THEN 'text' ELSE 'skip' END route, count(*)::BIGINT n FROM manifest WHERE source_rel IS NOT NULL GROUP BY 1")
def routing(spark, d):
    ext = F.regexp_extract(F.lower("source_rel"), r"\.([a-z0-9]+)$", 1)
    route = F.when(ext == "spc", "spc").when(ext.startswith("l6"), "vendor").when(ext.isin("txt", "csv", "tsv"), "text").otherwise("skip")
    return table(spark, d, "manifest").where("source_rel IS NOT NULL").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- readers of files that Spark derives from the tables


def _spectra(spark, d):
    """(path, w, y): the sound mean spectrum of each acquisition by rising axis; of a repeated one the smallest row."""
    s, w = F.col("mean_spectrum"), F.col("wavenumber")
    ok = F.coalesce((F.size(s) == F.size(w)) & (F.size(s) > 1) & F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rising = F.array_sort(F.arrays_zip(w.alias("w"), s.alias("s")))
    r = table(spark, d, "records").where(ok & F.col("acq_id").isNotNull()).groupBy(F.col("acq_id").alias("path"))
    return r.agg(F.min(F.struct(F.transform(rising, lambda x: x["s"]).alias("y"), F.transform(rising, lambda x: x["w"]).alias("w"))).alias("r")).select("path", "r.w", "r.y")


SOUND = """WITH r AS (SELECT acq_id path, list_transform(list_sort(list_zip(wavenumber, mean_spectrum)), lambda x: x[1]) w, list_transform(list_sort(list_zip(wavenumber, mean_spectrum)), lambda x: x[2]) v FROM records WHERE acq_id IS NOT NULL AND len(mean_spectrum) = len(wavenumber) AND len(mean_spectrum) > 1 AND len(list_filter(mean_spectrum, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
o AS (SELECT path, min({'y': v, 'w': w}) m FROM r GROUP BY path) """


@query("spc_files_s09", SOUND + "SELECT path, 'ok' status, len(m.y)::INT n, round(m.w[1], 6) lo, round(m.w[len(m.w)], 6) hi, round(list_sum(list_transform(m.y, lambda x: x::FLOAT::DOUBLE)), 3) total FROM o")
def spc_files(spark, d):
    """The mean spectra written as SPC files and read back: their status, length, ends and sum."""
    x = B.read_spc(_spectra(spark, d).select("path", B.spc_content(F.col("w"), F.col("y")).alias("content")))
    v = F.get("v", F.lit(0))
    return x.select("path", "status", F.size(v).alias("n"), F.round(F.element_at("w", 1), 6).alias("lo"), F.round(F.element_at("w", -1), 6).alias("hi"), F.round(F.aggregate(v, F.lit(0.0), lambda s, a: s + a), 3).alias("total"))


@query("vendor_files_s10")
def vendor_files(spark, d):
    """Strips of eight lines of each full raster written as vendor containers and read back: status, reason, kind and shape."""
    p = points(table(spark, d, "spectral_images")).where("i IS NOT NULL AND j IS NOT NULL")
    strip = p.groupBy("acq_id", F.expr("i div 8").alias("strip")).agg(F.array_sort(F.collect_list(F.struct("j", "i", "y", "w"))).alias("c"), F.countDistinct("i").alias("ny"), F.countDistinct("j").alias("nx"))
    strip = strip.where("ny > 1 AND nx > 1 AND size(c) = nx * ny")  # at most eight cells a column
    axis = lambda n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: k.cast("double"))
    parts = F.array(F.flatten(F.transform("c", lambda r: r["y"])), F.get("c", F.lit(0))["w"], axis("nx"), axis("ny"))
    return B.read_vendor(strip.select(F.concat_ws("/", "acq_id", "strip").alias("path"), B.container_content(parts).alias("content"))).select("path", "status", "reason", "kind", "nx", "ny", F.size("w").alias("channels"), F.size("v").alias("spectra"))


@query("two_column_s06", SOUND + "SELECT path, 'spectrum' kind, len(m.y)::INT n, round(m.w[1], 6) first, round(list_sum(m.y), 3) total FROM o")
def two_column(spark, d):
    """The mean spectra written as two-column text in falling order and read back."""
    x = _spectra(spark, d).select("path", F.posexplode(F.reverse(F.arrays_zip("w", "y"))).alias("n", "r"))
    lines = x.select("path", (F.col("n") + 1).alias("line_no"), F.concat_ws("\t", F.col("r.w").cast("string"), F.col("r.y").cast("string")).alias("raw"))
    got = S.read_two_column(lines)
    return got.select("path", "kind", F.size("v").alias("n"), F.round(F.element_at("w", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, a: s + a), 3).alias("total"))


@query("calibrations_s07", SOUND + ", k AS (SELECT DISTINCT acq_id FROM records WHERE kind = 'autocal') SELECT path, 'autocal' kind, len(m.y)::INT n FROM o WHERE path IN (SELECT acq_id FROM k)")
def calibrations(spark, d):
    """The spectra of calibrations, read with their own kind."""
    own = table(spark, d, "records").where("kind = 'autocal'").select(F.col("acq_id").alias("path"))
    x = _spectra(spark, d).join(own, "path", "left_semi").select("path", F.posexplode(F.arrays_zip("w", "y")).alias("n", "r"))
    lines = x.select("path", (F.col("n") + 1).alias("line_no"), F.concat_ws(" ", F.col("r.w").cast("string"), F.col("r.y").cast("string")).alias("raw"))
    return S.read_two_column(lines, "autocal").select("path", "kind", F.size("v").alias("n"))


#: Nine parameters of each point as a fit table would list them: band maxima, and widths that run over their bounds.
FIT_SQL = """, f AS (SELECT acq_id path, pt, count(*) c, max(v) FILTER (wn BETWEEN 1560 AND 1610) gi, 10.0 + pt % 26 gw, max(v) FILTER (wn BETWEEN 1540 AND 1660) ga, max(v) FILTER (wn BETWEEN 1300 AND 1400) - 300 di, 40.0 + pt % 161 dw, max(v) FILTER (wn BETWEEN 1200 AND 1460) da FROM l GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pt) idx FROM f), h AS (SELECT * FROM g WHERE gi IS NOT NULL AND ga IS NOT NULL AND di IS NOT NULL AND da IS NOT NULL)
SELECT path, count(*)::BIGINT n, bool_and(idx <= q) contiguous, round(avg((gi > 0)::INT), 6) g_ok, round(avg((di > 0)::INT), 6) d3_ok, sum((((gw IN (10.0, 35.0)) AND gi > 0) OR ((dw IN (40.0, 200.0)) AND di > 0))::INT)::BIGINT pinned FROM (SELECT *, count(*) OVER (PARTITION BY path) q FROM h) GROUP BY path"""


@query("fit_tables_s05", POINTS_SQL + FIT_SQL)
def fit_tables(spark, d):
    """Fit tables of every acquisition written as text and read back: rows, contiguity and quality masks (P19)."""
    p = points(table(spark, d, "spectral_images"))
    top = lambda lo, hi: F.coalesce(peak(lo, hi).cast("string"), F.lit("nan"))
    cells = [top(1560, 1610), (10.0 + F.pmod("pt", F.lit(26))).cast("string"), top(1540, 1660), F.coalesce((peak(1300, 1400) - 300).cast("string"), F.lit("nan")), (40.0 + F.pmod("pt", F.lit(161))).cast("string"), top(1200, 1460), F.lit("1.0"), F.lit("2.0"), F.lit("3.0")]
    x = ranked(p.select(F.col("acq_id").alias("path"), "pt", F.concat_ws("\t", *cells).alias("raw")), ["path"], [F.col("pt").asc()], "idx")
    lines = x.select("path", (F.col("idx") + 1).alias("line_no"), F.concat_ws("\t", F.col("idx").cast("string"), "raw").alias("raw"))
    fits = S.fit_quality(S.read_fit_tables(lines))
    out = fits.groupBy("path").agg(F.count("*").alias("n"), F.round(F.avg(F.col("g_ok").cast("int")), 6).alias("g_ok"), F.round(F.avg(F.col("d3_ok").cast("int")), 6).alias("d3_ok"), F.sum(F.col("pinned").cast("int")).alias("pinned"))
    return out.join(S.contiguous(fits), "path").select("path", "n", "contiguous", "g_ok", "d3_ok", "pinned")


@query("fallback_reads_s15")
def fallback_reads(spark, d):
    """How each file was read, as a map or (refused by the map scan) as a plain table, with its rows and numbers."""
    maps, quick = S.read_any_map(_file_lines(spark, d))
    one = lambda x, how, reason: x.groupBy("path").agg(F.lit(how).alias("how"), reason.alias("reason"), F.count("*").alias("rows"), F.sum(F.size(F.filter("v", lambda v: v.isNotNull()))).alias("numbers"))
    return one(maps, "map", F.lit(None).cast("string")).unionByName(one(quick, "quickmap", F.first("reason")))


@query("quick_maps_s08")
def quick_maps(spark, d):
    """Every file of raw lines read as a plain table: its rows without the header row and the first column."""
    return S.read_quick_maps(_file_lines(spark, d))


@query("range_coverage_p36", "WITH a AS (SELECT acq_id, min(list_min(wavenumber)) w0, max(list_max(wavenumber)) w1 FROM spectral_images WHERE acq_id IS NOT NULL AND len(wavenumber) > 0 GROUP BY acq_id) SELECT acq_id, round(greatest(1000, w0 + 1), 6) lo, round(least(1800, w1 - 1), 6) hi, least(1800, w1 - 1) - greatest(1000, w0 + 1) >= 200 covered FROM a")
def range_coverage(spark, d):
    """Whether each acquisition's axis covers at least 200 of the window of 1000 to 1800."""
    a = table(spark, d, "spectral_images").where("acq_id IS NOT NULL AND size(wavenumber) > 0").groupBy("acq_id").agg(F.min(F.array_min("wavenumber")).alias("w0"), F.max(F.array_max("wavenumber")).alias("w1"))
    lo, hi = F.greatest(F.lit(1000.0), F.col("w0") + 1), F.least(F.lit(1800.0), F.col("w1") - 1)
    return a.select("acq_id", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), (hi - lo >= 200).alias("covered"))
