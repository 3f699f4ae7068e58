"""Cutting lines into segments (line_id, beg, end_) with half-open vertex ranges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.vec import Vec3
from skein.operators.geometry import cross_curvature, curvature, line_lengths
from skein.session import BATCH_BYTES, reliable
from skein.skew import chunked_fold, explode_range, halo_windows, line_running_sums

P = Vec3.of()
FOLD = 1 << 12
SPAN = "struct<beg:int,end_:int>"
SEG_KEY = ["line_id", "beg", "end_"]

# Default thresholds of the cutters.
TAC_LIMIT = math.pi / 2
LENGTH_LIMIT = 0.05
TORTUOSITY_LIMIT = 1.10
DEGENERATE = 1e-14


class Policy(str, Enum):
    EVEN = "even"
    CURVATURE = "curvature"
    CROSS_CURVATURE = "cross_curvature"
    RATIO = "ratio"
    TORTUOSITY = "tortuosity"
    GLOBAL = "global"
    GLOBAL_CURVATURE = "global_curvature"


def segment(points: DataFrame, policy: Policy | str, **args) -> DataFrame:
    """Cut with the named policy; the remaining arguments go to its function."""
    table: dict[Policy, Callable[..., DataFrame]] = {
        Policy.EVEN: cut_evenly,
        Policy.CURVATURE: cut_by_curvature,
        Policy.CROSS_CURVATURE: cut_by_cross_curvature,
        Policy.RATIO: cut_by_ratio,
        Policy.TORTUOSITY: cut_by_tortuosity,
        Policy.GLOBAL: cut_globally,
        Policy.GLOBAL_CURVATURE: cut_globally_by_curvature,
    }
    return table[Policy(policy)](points, **args)


def _spans(folded: DataFrame) -> DataFrame:
    return folded.select("line_id", F.explode("out").alias("s")).select(
        "line_id", "s.beg", "s.end_"
    )


def _is_last(w) -> Column:
    return F.lead("pt_idx").over(w).isNull()


def _cut_by_sums(stepped: DataFrame, tac_limit: float, length_limit: float, chunk: int):
    """Cut where the sum of ``tac`` or of ``len`` would pass its limit; both sums restart at 0.

    The last vertex of a line emits the open segment.
    """

    def step(s, e):
        add, tac = e["len"].isNotNull(), F.coalesce(e["tac"], F.lit(0.0))
        trips = (s["tac"] + tac > tac_limit) | (s["len"] + e["len"] > length_limit)
        cut = add & trips & ~e["whole"]
        zero = F.lit(0.0)
        new = {
            "begin": F.when(cut, e["pt_idx"]).otherwise(s["begin"]),
            "tac": F.when(cut, zero).when(add, s["tac"] + tac).otherwise(s["tac"]),
            "len": F.when(cut, zero).when(add, s["len"] + e["len"]).otherwise(s["len"]),
        }
        return new, cut | e["last"], F.struct(s["begin"], e["pt_idx"] + 1)

    carry = {
        "begin": ("int", F.lit(0)),
        "tac": ("double", F.lit(0.0)),
        "len": ("double", F.lit(0.0)),
    }
    elem = [F.col(c) for c in ("tac", "len", "whole", "last")]
    return _spans(chunked_fold(stepped, elem, carry, SPAN, step, chunk))


def cut_by_curvature(
    points: DataFrame,
    tac_limit: float = TAC_LIMIT,
    length_limit: float = LENGTH_LIMIT,
    chunk: int = FOLD,
) -> DataFrame:
    """Greedy cut by total absolute curvature and length; lines under five vertices stay whole.

    Neighbouring segments share the vertex at which the cut was made.
    """
    i = F.col("pt_idx")

    def cols(w):
        fifth = F
        for k in range(4):
            fifth = fifth.when(i == k, F.lead(i, 4 - k).over(w))
        return {
            "len": P.lead(w).dist(P.lag(w)) / F.lit(2.0),
            "last": _is_last(w),
            "whole": (i < 4) & fifth.otherwise(i).isNull(),
        }

    stepped = halo_windows(curvature(points), cols, 1, 4).select(
        "line_id", "pt_idx", (F.col("kappa") * F.col("len")).alias("tac"), "len", "whole", "last"
    )
    return _cut_by_sums(stepped, tac_limit, length_limit, chunk)


def cut_by_cross_curvature(
    points: DataFrame, tac_limit: float, length_limit: float, chunk: int = FOLD
) -> DataFrame:
    """As ``cut_by_curvature`` with the cross-product curvature and the unhalved length."""
    stepped = halo_windows(
        cross_curvature(points),
        {"len": lambda w: P.lead(w).dist(P.lag(w)), "last": _is_last},
        1,
        1,
    ).select(
        "line_id", "pt_idx", (F.abs("kappa") * F.col("len")).alias("tac"), "len",
        F.lit(False).alias("whole"), "last",
    )
    return _cut_by_sums(stepped, tac_limit, length_limit, chunk)


def cut_by_ratio(
    points: DataFrame, ratio_limit: float, length_limit: float, chunk: int = FOLD
) -> DataFrame:
    """Greedy cut when the arc passes ``ratio_limit`` times the chord, or ``length_limit``."""
    q = Vec3.of("nx", "ny", "nz")
    stepped = halo_windows(
        points,
        lambda w: {
            **P.lead(w).columns("nx", "ny", "nz"),
            "inner": F.lag("pt_idx").over(w).isNotNull() & ~_is_last(w),
            "last": _is_last(w),
        },
        1,
        1,
    ).withColumn("len", P.dist(q))

    def step(s, e):
        start = Vec3(*[F.coalesce(s[c], e[c]) for c in "xyz"])
        arc = s["len"] + e["len"]
        nxt = Vec3(e["nx"], e["ny"], e["nz"])
        cut = e["inner"] & ((arc > F.lit(ratio_limit) * nxt.dist(start)) | (arc > length_limit))
        new = {
            "begin": F.when(cut, e["pt_idx"]).otherwise(s["begin"]),
            "len": F.when(cut, F.lit(0.0)).when(e["inner"], arc).otherwise(s["len"]),
        }
        for c, kept in zip("xyz", start.parts):
            new[c] = F.when(cut, e[c]).otherwise(kept)
        return new, cut | e["last"], F.struct(s["begin"], e["pt_idx"] + 1)

    carry = {"begin": ("int", F.lit(0)), "len": ("double", F.lit(0.0))}
    carry.update({c: ("double", F.lit(None)) for c in "xyz"})
    elem = [F.col(c) for c in ("x", "y", "z", "nx", "ny", "nz", "len", "inner", "last")]
    return _spans(chunked_fold(stepped, elem, carry, SPAN, step, chunk))


def cut_by_tortuosity(
    points: DataFrame, limit: float = TORTUOSITY_LIMIT, chunk: int = FOLD
) -> DataFrame:
    """Disjoint segments, closed once arc / chord reaches ``limit``.

    A single vertex left behind by a cut joins the closed segment; leftovers of fewer than three
    vertices belong to no segment.
    """
    flagged = halo_windows(points, {"tail": _is_last}, 0, 1)

    def step(s, e):
        here, start = Vec3.field(e), Vec3(s["sx"], s["sy"], s["sz"])
        fresh = s["px"].isNull()
        full = s["ratio"] >= limit
        swallow = full & e["tail"]
        cut = full & ~e["tail"]
        restart = fresh | cut
        arc = F.when(restart, F.lit(0.0)).otherwise(s["arc"] + here.dist(Vec3(s["px"], s["py"], s["pz"])))
        ratio = F.coalesce(arc / F.nullif(here.dist(start), F.lit(0.0)), F.lit(0.0))
        new = {
            "begin": F.when(restart, e["pt_idx"]).otherwise(s["begin"]),
            "arc": arc,
            "ratio": F.when(restart | (e["pt_idx"] - s["begin"] < 2), F.lit(0.0))
            .when(swallow, F.lit(0.0))
            .otherwise(ratio),
        }
        for c in "xyz":
            new[f"s{c}"] = F.when(restart, e[c]).otherwise(s[f"s{c}"])
            new[f"p{c}"] = e[c]
        rest = e["tail"] & (e["pt_idx"] - s["begin"] >= 2)
        end = F.when(cut, e["pt_idx"]).otherwise(e["pt_idx"] + 1)
        return new, cut | rest, F.struct(s["begin"], end)

    carry = {"begin": ("int", F.lit(0))}
    carry.update({"arc": ("double", F.lit(0.0)), "ratio": ("double", F.lit(0.0))})
    carry.update({f"{k}{c}": ("double", F.lit(None)) for k in "sp" for c in "xyz"})
    elem = [F.col(c) for c in ("x", "y", "z", "tail")]

    return _spans(chunked_fold(flagged, elem, carry, SPAN, step, chunk))


def cut_evenly(points: DataFrame, mean_length: float) -> DataFrame:
    """Segments of equal vertex count with a mean arc length, sharing one vertex."""
    pieces = F.greatest(
        F.lit(1),
        F.floor(F.try_divide(F.col("n"), F.col("arc_length") / F.lit(mean_length))),
    )
    lines = line_lengths(points).withColumn("_k", F.coalesce(pieces, F.col("n")))
    each = explode_range(lines, F.lit(0), F.floor((F.col("n") - 1) / F.col("_k")), "_i")
    beg = F.col("_i") * F.col("_k")
    return each.select(
        "line_id",
        beg.cast("int").alias("beg"),
        F.least(beg + F.col("_k") + 1, F.col("n")).cast("int").alias("end_"),
    ).where(F.col("end_") - F.col("beg") > 1)


# ------------------------------------------------------------------ optimal segmentation


def _costs(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """best[k] + mean squared deviation of vertices k+1..j + penalty[k], rows k, columns j."""
    m = right.pt_idx.to_numpy()[None, :] - left.pt_idx.to_numpy()[:, None]
    inside = m > 0
    count = np.where(inside, m, 1)
    dev = (right.q.to_numpy()[None, :] - left.q.to_numpy()[:, None]) / count
    for c in ("sx", "sy", "sz"):
        dev = dev - ((right[c].to_numpy()[None, :] - left[c].to_numpy()[:, None]) / count) ** 2
    cost = np.maximum(dev, 0.0) + left.penalty.to_numpy()[:, None]
    if "best" in left:
        cost = cost + left.best.to_numpy()[:, None]
    return np.where(inside, cost, np.inf)


SPANS = "line_id bigint, beg int, end_ int"
COSTS = 1 << 19          # costs of links that one task works out at a time


def _solve_whole(rows: DataFrame) -> DataFrame:
    """The best spans of lines that fit one block each; a task takes many lines at once, and no line comes twice.

    ``rows`` has line_id, pt_idx, the sums and the penalty.
    """
    names = ["pt_idx", "sx", "sy", "sz", "q", "penalty"]
    lines = rows.where(F.col("line_id").isNotNull()).groupBy("line_id").agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            line, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            start, held = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            start, size = start[:-1] - start[0], np.diff(start)
            flat = {c: held.field(c).to_numpy(zero_copy_only=False) for c in names}
            order = np.argsort(size, kind="stable")
            lo = 0
            while lo < len(order):
                n = int(size[order[lo]])
                same = int(np.searchsorted(size[order], n, "right"))
                some = order[lo : min(same, lo + max(1, COSTS // (n * n)))]
                at = start[some][:, None] + np.arange(n)[None, :]
                which, beg, end = _spans_of({c: v[at] for c, v in flat.items()})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line[some][which], pa.int64()), pa.array(beg, pa.int32()), pa.array(end, pa.int32())],
                    ["line_id", "beg", "end_"])
                lo += len(some)

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return lines.mapInArrow(run, SPANS)


def _spans_of(v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, beg, end_) on the best paths of lines of one length, each a row of the arrays of ``v``."""
    index = v["pt_idx"].astype(np.int64)
    lines, n = index.shape
    m = index[:, None, :] - index[:, :, None]
    inside = m > 0
    count = np.where(inside, m, 1)
    dev = (v["q"][:, None, :] - v["q"][:, :, None]) / count
    for c in ("sx", "sy", "sz"):
        dev = dev - ((v[c][:, None, :] - v[c][:, :, None]) / count) ** 2
    cost = np.where(inside, np.maximum(dev, 0.0) + v["penalty"][:, :, None], np.inf)
    best, prev, every = np.full((lines, n), np.inf), np.full((lines, n), -1), np.arange(lines)
    best[index[:, 0] == 0, 0] = 0.0
    for j in range(1, n):
        c = best[:, :j] + cost[:, :j, j]
        k = c.argmin(axis=1)
        least = c[every, k]
        better = least < best[:, j]
        best[better, j], prev[better, j] = least[better], k[better]
    out, live, at = [], every, np.full(lines, n - 1)
    while len(live):
        link = prev[live, at]
        live, at, link = live[link >= 0], at[link >= 0], link[link >= 0]
        out.append((live, index[live, link], index[live, at]))
        at = link
    return tuple(np.concatenate(c) for c in zip(*out))


def _best_spans(points: DataFrame, block: int) -> DataFrame:
    """(line_id, beg, end_) of the best cuts: lines that fit one block in a single step, others block by block."""
    sums = {"sx": F.col("x"), "sy": F.col("y"), "sz": F.col("z"), "q": P.sq()}
    rows = line_running_sums(points, sums).select("line_id", "pt_idx", "sx", "sy", "sz", "q", "penalty")
    long = points.where(F.col("pt_idx") >= block).select("line_id").distinct()
    if long.isEmpty():
        return _solve_whole(rows)
    rows = reliable(rows)
    solved = _solve(rows.join(long, "line_id", "left_semi"), block)
    return _solve_whole(rows.join(long, "line_id", "left_anti")).unionByName(_trace_back(solved, block))


def _solve(rows: DataFrame, block: int) -> DataFrame:
    """Exact dynamic program over cut positions, one block of vertices per line and round.

    A round first prices the links from all finished blocks into the next block, one pair of
    blocks per task, and then finishes that block. Lines of up to ``block`` vertices take one
    round; no task sees more than two blocks.
    """
    rows = rows.withColumn("blk", F.floor(F.col("pt_idx") / F.lit(block)).cast("bigint"))
    blocks = rows.agg(F.max("blk")).first()[0] or 0
    if blocks:
        rows = reliable(rows)
    solved = "line_id bigint, pt_idx int, sx double, sy double, sz double, q double, " \
        "penalty double, blk bigint, best double, prev int"

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt_idx", ignore_index=True)
        cost = _costs(pdf, pdf)
        best, prev = pdf.near.to_numpy().copy(), pdf.near_prev.to_numpy().copy()
        index = pdf.pt_idx.to_numpy()
        if index[0] == 0:
            best[0], prev[0] = 0.0, -1
        for j in range(len(pdf)):
            if j and np.isfinite(best[:j]).any():
                c = best[:j] + cost[:j, j]
                k = int(np.argmin(c))
                if c[k] < best[j]:
                    best[j], prev[j] = c[k], index[k]
        return pdf.drop(columns=["near", "near_prev"]).assign(best=best, prev=prev)

    def price(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cost = _costs(left.sort_values("pt_idx"), right)
        k = cost.argmin(axis=0)
        links = pd.DataFrame(
            {
                "line_id": right.line_id,
                "pt_idx": right.pt_idx,
                "near": cost[k, np.arange(len(right))],
                "near_prev": left.pt_idx.sort_values().to_numpy()[k],
            }
        )
        return links

    done = None
    for b in range(blocks + 1):
        todo = rows.where(F.col("blk") == b)
        if done is None:
            near = todo.withColumns(
                {"near": F.lit(float("inf")), "near_prev": F.lit(-1)}
            )
        else:
            pairs = done.select("line_id", F.col("blk").alias("src")).distinct()
            targets = todo.join(pairs, "line_id")
            links = (
                done.withColumn("src", F.col("blk"))
                .groupBy("line_id", "src")
                .cogroup(targets.groupBy("line_id", "src"))
                .applyInPandas(
                    lambda a, t: price(a, t) if len(a) and len(t) else pd.DataFrame(
                        columns=["line_id", "pt_idx", "near", "near_prev"]),
                    "line_id bigint, pt_idx int, near double, near_prev int",
                )
                .groupBy("line_id", "pt_idx")
                .agg(F.min(F.struct("near", "near_prev")).alias("m"))
                .select("line_id", "pt_idx", "m.near", "m.near_prev")
            )
            near = todo.join(links, ["line_id", "pt_idx"])
        part = near.groupBy("line_id", "blk").applyInPandas(finish, solved)
        if blocks:
            part = reliable(part)
        done = part if done is None else reliable(done.unionByName(part))
    return done


def _trace_back(solved: DataFrame, block: int) -> DataFrame:
    """Cut positions on the best path, followed from the end of each line block by block."""
    last = solved.groupBy("line_id").agg(F.max("pt_idx").alias("at"))
    links = solved.select("line_id", "blk", "pt_idx", "prev")
    schema = "line_id bigint, beg int, end_ int, entry int"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        prev = dict(zip(pdf.pt_idx, pdf.prev))
        at, out = int(pdf["at"].iloc[0]), []
        while at in prev and prev[at] >= 0:
            out.append((int(prev[at]), at))
            at = int(prev[at])
        frame = pd.DataFrame(out, columns=["beg", "end_"])
        frame.insert(0, "line_id", pdf.line_id.iloc[0])
        return frame.assign(entry=at)

    spans = None
    heads = last
    while True:
        keyed = heads.withColumn("blk", F.floor(F.col("at") / F.lit(block)).cast("bigint"))
        part = links.join(keyed, ["line_id", "blk"]).groupBy("line_id").applyInPandas(walk, schema)
        if (solved.agg(F.max("blk")).first()[0] or 0) == 0:
            return part.drop("entry")
        part = reliable(part)
        spans = part if spans is None else reliable(spans.unionByName(part))
        heads = part.groupBy("line_id").agg(F.min("entry").alias("at")).where(F.col("at") > 0)
        if heads.isEmpty():
            return spans.drop("entry")


def cut_globally(points: DataFrame, penalty: float, block: int = 1 << 10) -> DataFrame:
    """Segments [k, j) minimising the sum of mean squared deviation plus a penalty per segment."""
    return _best_spans(points.withColumn("penalty", F.lit(float(penalty))), block)


def cut_globally_by_curvature(
    points: DataFrame, penalty: float = 1.0, block: int = 1 << 10
) -> DataFrame:
    """As ``cut_globally`` with the penalty divided by the curvature at the start of a segment.

    Segments are [k, j] closed, so neighbours share a vertex.
    """

    def cols(w):
        r, before = P - P.lag(w), P.lag(w) - P.lag(w, 2)
        bend = F.pow(r.sq() + F.lit(1.0), F.lit(1.5))
        return {"_c": (r - before).sq() / bend}

    curved = halo_windows(
        halo_windows(points, cols, 2, 0),
        lambda w: {
            "_c2": F.when(F.col("pt_idx") == 0, F.lead("_c", 2).over(w))
            .when(F.col("pt_idx") == 1, F.lead("_c", 1).over(w))
            .otherwise(F.col("_c"))
        },
        0,
        2,
    )
    c = F.coalesce(F.nullif(F.col("_c2"), F.lit(0.0)), F.lit(1e-6))
    spans = _best_spans(curved.withColumn("penalty", F.lit(float(penalty)) / c), block)
    return spans.withColumn("end_", F.col("end_") + 1)


# ------------------------------------------------------------------ segment tables


def members(segments: DataFrame) -> DataFrame:
    """One row per segment and vertex index."""
    each = explode_range(segments, F.col("beg"), F.col("end_") - 1, "pt_idx")
    return each.withColumn("pt_idx", F.col("pt_idx").cast("int"))


def segment_points(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Vertices with the segment they belong to; a shared vertex appears once per segment.

    The join is an equi-join on (line_id, pt_idx), so neither long lines nor long segments skew it.
    """
    return members(segments.select(*SEG_KEY)).join(points, ["line_id", "pt_idx"])


def owner_segments(segments: DataFrame) -> DataFrame:
    """(line_id, pt_idx) -> segment; a shared vertex belongs to the later segment."""
    return (
        members(segments.select(*SEG_KEY))
        .groupBy("line_id", "pt_idx")
        .agg(F.max(F.struct("beg", "end_")).alias("s"))
        .select("line_id", "pt_idx", "s.beg", "s.end_")
    )


def trim(points: DataFrame, segments: DataFrame, eps: float = DEGENERATE) -> DataFrame:
    """Drop trailing vertices that coincide with the first; segments of one vertex vanish."""
    first = points.select(
        "line_id", F.col("pt_idx").alias("beg"), *P.named("bx", "by", "bz")
    )
    far = (
        segment_points(points, segments)
        .join(first, ["line_id", "beg"])
        .where(P.dist(Vec3.of("bx", "by", "bz")) >= eps)
    )
    return far.groupBy("line_id", "beg").agg((F.max("pt_idx") + 1).alias("end_"))


def attributes(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Size, centroid, centred end points and direction of each segment, and its spread.

    The end points are moved so that their midpoint is the centroid.
    """
    xyz = F.struct("x", "y", "z")
    base = segment_points(points, segments).groupBy(*SEG_KEY).agg(
        F.count(F.lit(1)).cast("int").alias("cnt"),
        *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        F.min_by(xyz, "pt_idx").alias("_a"),
        F.max_by(xyz, "pt_idx").alias("_b"),
    )
    a, b, c = Vec3.field(F.col("_a")), Vec3.field(F.col("_b")), Vec3.of("cx", "cy", "cz")
    half = (b - a) / F.lit(2.0)
    return base.withColumns(
        {
            **(c - half).columns("sx", "sy", "sz"),
            **(c + half).columns("ex", "ey", "ez"),
            **(b - a).unit0().columns("dx", "dy", "dz"),
        }
    ).drop("_a", "_b")


def deviation(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Sum of the distances of a segment's vertices from its centroid."""
    attrs = attributes(points, segments).select(*SEG_KEY, "cx", "cy", "cz")
    return (
        segment_points(points, segments)
        .join(attrs, SEG_KEY)
        .groupBy(*SEG_KEY)
        .agg(F.sum(P.dist(Vec3.of("cx", "cy", "cz"))).alias("deviation"))
    )
