"""Text formats of lines and fields, read and written as distributed text.

The order of rows carries meaning in these formats. Rows are numbered per file from their block and
their place in it, so a large file may be split among tasks; whatever a row means from what stood
before it (which line it belongs to) is a running sum over that number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skein.functions.scalars import parse_number
from skein.functions.vec import Vec3
from skein.operators.geometry import drop_near_kept, global_index, shift_nonnegative
from skein.session import reliable
from skein.skew import explode_range, halo_windows, rank_within, running_sums

POINT_COLUMNS = ["file", "line_id", "pt_idx", "x", "y", "z"]
L_RECORD = 1 << 12       # indices per ``l`` record


def numbered_rows(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """(file, row, value) with row numbers from 0 in each file.

    With ``as_one`` the part files of a folder are taken, in name order, for one file.
    """
    part = F.col("_metadata.file_path")
    raw = spark.read.text(path).select(
        (F.lit(path) if as_one else part).alias("file"),
        part.alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        "value",
    )
    order = ["_part", "_block", "_seq"]
    return rank_within(raw, ["file"], order, "row", dtype="bigint").select("file", "row", "value")


def _words(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")


def _triple(words: Column, first: int) -> dict[str, Column]:
    return {n: parse_number(F.get(words, first + i)) for i, n in enumerate("xyz")}


def _index(points: DataFrame, *extra: str) -> DataFrame:
    """Number the vertices of each line by row; ``extra`` names further columns to keep."""
    ranked = rank_within(points, ["file", "line_id"], ["row"], "pt_idx")
    return ranked.select(*POINT_COLUMNS, *extra)


def _tokens(rows: DataFrame, pattern: str = r"[\s,]+") -> DataFrame:
    """(file, t, word): the words of a file numbered across rows."""
    split = rows.withColumn("_w", F.filter(F.split("value", pattern), lambda w: w != "")).where(
        F.size("_w") > 0
    )
    summed = running_sums(split, ["file"], ["row"], {"_end": F.size("_w").cast("bigint")})
    each = summed.select("file", (F.col("_end") - F.size("_w")).alias("_at"), F.posexplode("_w"))
    return each.select("file", (F.col("_at") + F.col("pos")).alias("t"), F.col("col").alias("word"))


# ------------------------------------------------------------------ lines


def read_obj(
    spark: SparkSession,
    path: str,
    end_markers: Sequence[str] = ("g",),
    downsample: int = 1,
    max_lines: int | None = None,
    scale: Sequence[float] | None = None,
    origin: Sequence[float] | None = None,
    min_step: float | None = None,
    nonnegative: bool = False,
    as_one: bool = False,
    offset: int = 0,
) -> DataFrame:
    """``v x y z`` rows; a row that starts with an end marker closes the line before it.

    An unfinished last line is dropped. ``downsample`` keeps every k-th vertex, ``scale`` and
    ``origin`` transform them, ``min_step`` drops vertices near the last kept one. The first ``offset``
    lines of a file are passed over; ``max_lines`` and the numbers of the others count from there.
    """
    rows = numbered_rows(spark, path, as_one)
    first = F.substring("value", 1, 1)
    ends = first.isin(*end_markers)
    kept = rows.where(ends | F.col("value").startswith("v "))
    lined = running_sums(kept, ["file"], ["row"], {"_ends": ends.cast("bigint")})
    closed = lined.groupBy("file").agg(F.max("_ends").alias("_closed"))
    words = _words(F.col("value"))
    points = (
        lined.where(~ends)
        .join(closed, "file")
        .where(F.col("_ends") < F.col("_closed"))
        .select("file", "row", F.col("_ends").alias("line_id"), words.alias("_w"))
        .select("file", "row", "line_id", *[c.alias(n) for n, c in _triple(F.col("_w"), 1).items()])
    )
    if offset:
        points = points.where(F.col("line_id") >= offset).withColumn("line_id", F.col("line_id") - offset)
    if max_lines is not None:
        points = points.where(F.col("line_id") < max_lines)
    points = _index(points)
    if downsample > 1:
        points = points.where(F.col("pt_idx") % downsample == 0).withColumn(
            "pt_idx", F.floor(F.col("pt_idx") / downsample).cast("int")
        )
    v = Vec3.of()
    if scale is not None:
        v = v * Vec3.lit(*scale)
    if origin is not None:
        v = v + Vec3.lit(*origin)
    points = points.withColumns(v.columns())
    if min_step is not None:
        lines = points.select("file", "line_id").distinct()
        named = reliable(rank_within(lines, [], ["file", "line_id"], "_line", dtype="bigint"))
        own = points.join(named, ["file", "line_id"]).select(F.col("_line").alias("line_id"), "pt_idx", "x", "y", "z")
        slim = _renumber(drop_near_kept(own, min_step)).withColumnRenamed("line_id", "_line")
        points = slim.join(named, "_line").select(*POINT_COLUMNS)
    return shift_nonnegative(points) if nonnegative else points


def _one_file(points: DataFrame) -> DataFrame:
    """Points without the file name, for operators whose lines are known by line_id alone."""
    files = points.select("file").distinct().limit(2).count()
    if files > 1:
        raise ValueError("this option reads one file at a time")
    return points.drop("file")


def _renumber(points: DataFrame) -> DataFrame:
    return points.withColumnRenamed("pt_idx", "_old").transform(
        lambda d: rank_within(d, ["line_id"], ["_old"], "pt_idx")
    ).drop("_old")


def read_indexed_obj(spark: SparkSession, path: str, min_sq_step: float = 1e-4) -> DataFrame:
    """``v``, ``vt`` and ``l`` rows: lines as lists of vertex numbers, with importance from ``vt``.

    Vertices within ``min_sq_step`` (squared) of the last kept one of their line are dropped.
    """
    rows = numbered_rows(spark, path)
    kind = F.when(F.col("value").startswith("v "), "v").when(
        F.col("value").startswith("vt"), "t"
    ).when(F.col("value").startswith("l"), "l")
    typed = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    counted = running_sums(
        typed, ["file"], ["row"],
        {f"_n{k}": (F.col("kind") == k).cast("bigint") for k in "vtl"},
    ).withColumn("_w", _words(F.col("value")))
    vertices = counted.where("kind = 'v'").select(
        "file", F.col("_nv").alias("_id"), *[c.alias(n) for n, c in _triple(F.col("_w"), 1).items()]
    )
    weights = counted.where("kind = 't'").select(
        "file", F.col("_nt").alias("_id"), parse_number(F.get("_w", F.lit(1))).alias("importance")
    )
    uses = counted.where("kind = 'l'").select(
        "file", (F.col("_nl") - 1).alias("line_id"), F.posexplode(F.slice("_w", 2, F.size("_w")))
    ).where(F.col("col") != "").select(
        "file", "line_id", F.col("pos").alias("pt_idx"), F.col("col").cast("bigint").alias("_id")
    )
    lines = uses.join(vertices, ["file", "_id"]).join(weights, ["file", "_id"], "left")
    full = _one_file(lines.select(*POINT_COLUMNS, "importance"))
    kept = drop_near_kept(full, min_sq_step**0.5).select("line_id", "pt_idx")
    return _renumber(full.join(kept, ["line_id", "pt_idx"])).select(
        "line_id", "pt_idx", "x", "y", "z", "importance"
    )


def read_counted_lines(spark: SparkSession, path: str) -> DataFrame:
    """Number of lines, their sizes, then all coordinates, separated by blanks."""
    words = _tokens(numbered_rows(spark, path)).withColumn("value", parse_number(F.col("word")))
    n = words.where("t = 0").select("file", F.col("value").cast("bigint").alias("n"))
    given = words.join(n, "file").where("t > 0")
    sizes = given.where(F.col("t") <= F.col("n")).select(
        "file", (F.col("t") - 1).alias("line_id"), F.col("value").cast("bigint").alias("size")
    )
    placed = running_sums(sizes, ["file"], ["line_id"], {"_end": F.col("size")})
    owners = explode_range(
        placed, F.col("_end") - F.col("size"), F.col("_end") - 1, "gid"
    ).select("file", "gid", "line_id", (F.col("gid") - F.col("_end") + F.col("size")).alias("pt_idx"))
    at = F.col("t") - 1 - F.col("n")
    axis = at % 3
    places = given.where(at >= 0).groupBy("file", F.floor(at / 3).alias("gid")).agg(
        *[F.max(F.when(axis == i, F.col("value"))).alias(c) for i, c in enumerate("xyz")]
    )
    return owners.join(places, ["file", "gid"]).withColumn(
        "pt_idx", F.col("pt_idx").cast("int")
    ).select(*POINT_COLUMNS)


def read_row_lines(spark: SparkSession, path: str) -> DataFrame:
    """One line per row: ``x y z x y z ...``."""
    rows = numbered_rows(spark, path).withColumn("_w", _words(F.col("value")))
    each = rows.select(
        "file", F.col("row").alias("line_id"), "_w",
        F.explode(
            F.sequence(F.lit(0), F.floor(F.size("_w") / 3).cast("int") - 1)
        ).alias("pt_idx"),
    ).where((F.size("_w") >= 3) & (F.col("pt_idx") >= 0))
    at = F.col("pt_idx") * 3
    return each.select(
        "file", "line_id", "pt_idx",
        *[parse_number(F.get("_w", at + i)).alias(c) for i, c in enumerate("xyz")],
    )


def read_planar_lines(spark: SparkSession, path: str, divide: float = 20.0) -> DataFrame:
    """A count of lines, then per line its size in a row of its own and rows ``x y``; z is 0."""
    rows = numbered_rows(spark, path).withColumn("_w", _words(F.col("value"))).where(
        F.trim("value") != ""
    )
    head = F.size("_w") == 1
    lined = running_sums(rows, ["file"], ["row"], {"_heads": head.cast("bigint")})
    x, y = (parse_number(F.get("_w", F.lit(i))) / F.lit(divide) for i in (0, 1))
    return _index(
        lined.where(~head).select(
            "file", "row", (F.col("_heads") - 2).alias("line_id"), x.alias("x"), y.alias("y"),
            F.lit(0.0).alias("z"),
        )
    )


def group_runs(
    rows: DataFrame, id_column: str, max_lines: int | None = None, downsample: int = 1, extra: Sequence[str] = ()
) -> DataFrame:
    """Start a new line whenever the id changes from one row to the next (file, row order).

    ``extra`` names further columns to keep.
    """
    marked = halo_windows(
        rows,
        {"_new": lambda w: (~F.col(id_column).eqNullSafe(F.lag(id_column).over(w))).cast("bigint")},
        1, 0, line="file", idx="row",
    )
    lined = running_sums(marked, ["file"], ["row"], {"_line": F.col("_new")})
    lined = lined.withColumn("line_id", F.col("_line") - 1).drop("_new", "_line")
    if max_lines is not None:
        lined = lined.where(F.col("line_id") < max_lines)
    points = _index(lined, *extra)
    if downsample > 1:
        points = points.where(F.col("pt_idx") % downsample == 0).withColumn(
            "pt_idx", F.floor(F.col("pt_idx") / downsample).cast("int")
        )
    return points


def _separated(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered_rows(spark, path).where("row > 0").withColumn("row", F.col("row") - 1)
    return rows.withColumn("_f", F.split("value", ";"))


def read_trajectories(
    spark: SparkSession, path: str, max_lines: int | None = None, downsample: int = 1
) -> DataFrame:
    """Header, then ``id;hh:mm:ss;x;y;z;``: coordinates over 100, x shifted to start at 0 or above.

    ``t_sec`` is the time of day of each vertex in seconds.
    """
    rows = _separated(spark, path)
    clock = F.split(F.col("_f")[1], ":")
    seconds = parse_number(clock[0]) * 3600 + parse_number(clock[1]) * 60 + parse_number(clock[2])
    parsed = rows.select(
        "file", "row", F.col("_f")[0].alias("id"), seconds.alias("t_sec"),
        *[(parse_number(F.col("_f")[i + 2]) / F.lit(100.0)).alias(c) for i, c in enumerate("xyz")],
    )
    points = group_runs(parsed, "id", max_lines, downsample, ["t_sec"])
    low = F.least(points.agg(F.min("x")).scalar(), F.lit(0.0))
    return points.withColumn("x", F.col("x") - low)


def read_clustered(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Header, then ``id;x;y;f;d;d``: x and y shifted to 0 or above, z is 0.

    A line ends where the id changes, so an id that comes again begins another line.
    """
    rows = _separated(spark, path)
    parsed = rows.select(
        "file", "row", F.col("_f")[0].cast("bigint").alias("id"),
        parse_number(F.col("_f")[1]).alias("x"), parse_number(F.col("_f")[2]).alias("y"),
        F.lit(0.0).alias("z"),
    )
    points = group_runs(parsed, "id", max_lines)
    lows = points.agg(F.struct(*[F.least(F.min(c), F.lit(0.0)).alias(c) for c in "xy"])).scalar()
    return points.withColumn("_l", lows).withColumns(
        {c: F.col(c) - F.col("_l")[c] for c in "xy"}
    ).drop("_l")


def read_query_curves(spark: SparkSession, path: str) -> DataFrame:
    """``id=..,n=..,loop=..``, then n rows ``x y z`` and a row ``#``."""
    rows = numbered_rows(spark, path)
    head = F.col("value").startswith("id=")
    lined = running_sums(rows, ["file"], ["row"], {"_heads": head.cast("bigint")})
    heads = lined.where(head).select(
        "file", "_heads", F.regexp_extract("value", r"id=(-?\d+)", 1).cast("bigint").alias("line_id"),
        F.regexp_extract("value", r"loop=(-?\d+)", 1).cast("int").alias("loop"),
    )
    words = _words(F.col("value"))
    body = lined.where(~head & ~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        "file", "row", "_heads", *[c.alias(n) for n, c in _triple(words, 0).items()]
    )
    joined = body.join(heads, ["file", "_heads"])
    return rank_within(joined, ["file", "line_id"], ["row"], "pt_idx").select(
        *POINT_COLUMNS, "loop"
    )


# ------------------------------------------------------------------ fields


def _grid(rows: DataFrame, cell: Column, cols: Column) -> DataFrame:
    return rows.select(
        "file", (cell % cols).cast("int").alias("col"), F.floor(cell / cols).cast("int").alias("row"),
        F.lit(0).alias("layer"), "u", "v", F.lit(0.0).alias("w"),
    )


def read_vec_field(spark: SparkSession, path: str) -> DataFrame:
    """``Gvec``, columns and rows, then pairs ``u v``."""
    words = _tokens(numbered_rows(spark, path)).where("t > 0").withColumn(
        "value", parse_number(F.col("word"))
    )
    cols = words.where("t = 1").select("file", F.col("value").cast("bigint").alias("n"))
    at = F.col("t") - 3
    cells = words.where(at >= 0).groupBy("file", F.floor(at / 2).alias("cell")).agg(
        F.max(F.when(at % 2 == 0, F.col("value"))).alias("u"),
        F.max(F.when(at % 2 == 1, F.col("value"))).alias("v"),
    )
    return _grid(cells.join(cols, "file"), F.col("cell"), F.col("n"))


def read_txt_field(spark: SparkSession, path: str) -> DataFrame:
    """``G``, ``I=cols,J=rows``, then rows ``_,_,u,v``."""
    rows = numbered_rows(spark, path)
    cols = rows.where("row = 1").select(
        "file", F.regexp_extract("value", r"I=\s*(\d+)", 1).cast("bigint").alias("n")
    )
    f = F.split("value", ",")
    cells = rows.where("row > 1 and trim(value) <> ''").select(
        "file", (F.col("row") - 2).alias("cell"), parse_number(f[2]).alias("u"),
        parse_number(f[3]).alias("v"),
    )
    return _grid(cells.join(cols, "file"), F.col("cell"), F.col("n"))


def read_csv_field(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``u,v,u,v,...,``; rows of unequal length are an error."""
    filled = numbered_rows(spark, path).where("trim(value) <> ''").withColumnRenamed("row", "_row")
    rows = rank_within(filled, ["file"], ["_row"], "row").withColumn(
        "_f", F.filter(F.split("value", ","), lambda w: F.trim(w) != "")
    )
    widths = rows.agg(F.min(F.size("_f")), F.max(F.size("_f"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"rows hold {widths[0]} to {widths[1]} numbers")
    each = rows.select(
        "file", F.col("row").cast("int").alias("row"), "_f",
        F.explode(F.sequence(F.lit(0), F.floor(F.size("_f") / 2).cast("int") - 1)).alias("col"),
    )
    return each.select(
        "file", "col", "row", F.lit(0).alias("layer"),
        parse_number(F.get("_f", F.col("col") * 2)).alias("u"),
        parse_number(F.get("_f", F.col("col") * 2 + 1)).alias("v"), F.lit(0.0).alias("w"),
    )


# ------------------------------------------------------------------ sinks


def _write_ordered(rows: DataFrame, order: Sequence[str], path: str) -> None:
    """Part files whose concatenation in name order is the file."""
    cols = [F.col(c) for c in order]
    rows.repartitionByRange(*cols).sortWithinPartitions(*cols).select("value").write.text(path)


def obj_rows(points: DataFrame, importance: str | None = None) -> DataFrame:
    """Rows (line_id, block, step, value): ``v`` and ``vt`` per vertex, then ``g`` and ``l``.

    A line of more than L_RECORD vertices gets several ``l`` records that share end vertices.
    """
    number = F.format_string("v %f %f %f ", "x", "y", "z")
    extra = F.format_string("vt %s", F.col(importance).cast("string")) if importance else F.lit("vt 0")
    gids = global_index(points)
    vertices = gids.select(
        "line_id", F.lit(0).alias("block"), F.col("pt_idx").cast("bigint").alias("step"),
        F.concat_ws("\n", number, extra).alias("value"),
    )
    lines = gids.groupBy("line_id").agg(
        F.min("gid").alias("_first"), F.max("gid").alias("_last")
    )
    ranked = rank_within(lines, [], ["line_id"], "_ord", dtype="bigint")
    names = ranked.select(
        "line_id", F.lit(1).alias("block"), F.lit(0).cast("bigint").alias("step"),
        F.format_string("g line%d", F.col("_ord") + 1).alias("value"),
    )
    size = F.lit(L_RECORD)
    pieces = explode_range(
        ranked, F.lit(0), F.floor(F.greatest(F.col("_last") - F.col("_first") - 1, F.lit(0)) / size),
        "_piece",
    )
    start = F.col("_first") + F.col("_piece") * size
    numbers = F.sequence(start + 1, F.least(start + size, F.col("_last")) + 1)
    uses = pieces.select(
        "line_id", F.lit(2).alias("block"), F.col("_piece").alias("step"),
        F.concat(F.lit("l "), F.array_join(F.transform(numbers, lambda i: i.cast("string")), " "),
                 F.lit(" ")).alias("value"),
    )
    return vertices.unionByName(names).unionByName(uses)


def write_obj(points: DataFrame, path: str, importance: str | None = None) -> None:
    _write_ordered(obj_rows(points, importance), ["line_id", "block", "step"], path)


def write_csv_field(grid: DataFrame, path: str, layer: int = 0) -> None:
    """Rows ``u,v,`` per cell of ``layer``, one text row per grid row.

    The format holds one layer; a grid that has others is an error, unless its caller selects one.
    """
    if not grid.where(F.col("layer") != layer).isEmpty():
        raise ValueError(f"the grid has layers besides {layer}; write each to a path of its own")
    cell = F.concat(F.col("u").cast("string"), F.lit(","), F.col("v").cast("string"), F.lit(","))
    rows = (
        grid.groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))).alias("_c"))
        .select("row", F.array_join(F.transform("_c", lambda e: e["c"]), "").alias("value"))
    )
    _write_ordered(rows, ["row"], path)


def write_order(order: DataFrame, path: str) -> None:
    """The line numbers of an order, one per row of text, first to be removed first."""
    rows = order.select("rank", F.col("line_id").cast("string").alias("value"))
    _write_ordered(rows, ["rank"], path)


def write_survivors(dump: DataFrame, path: str) -> None:
    """One folder per number of kept lines, rows ``line;x;y;0;0;0`` with line numbers from 1."""
    rows = dump.select(
        "kept", (F.col("line_id") + 1).alias("line"), "x", "y",
        *[F.lit(0).alias(f"zero{i}") for i in range(3)],
    )
    rows.write.partitionBy("kept").option("sep", ";").csv(path)


def write_affinity(pairs: DataFrame, segments: DataFrame, path: str) -> None:
    """Number of segments, then ``i j similarity`` with segments numbered by line and place."""
    numbered = rank_within(segments.select("line_id", "beg"), [], ["line_id", "beg"], "_i",
                           dtype="bigint")
    other = numbered.select(
        F.col("line_id").alias("nbr_line"), F.col("beg").alias("nbr_beg"), F.col("_i").alias("_j")
    )
    body = pairs.join(numbered, ["line_id", "beg"]).join(other, ["nbr_line", "nbr_beg"]).select(
        "_i", "_j", F.concat_ws(" ", "_i", "_j", "similarity").alias("value")
    )
    head = numbered.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit(-1).cast("bigint").alias("_i"), F.lit(-1).cast("bigint").alias("_j"), "value"
    )
    _write_ordered(head.unionByName(body), ["_i", "_j"], path)
