"""Formats: what is written reads back, and each text layout is understood."""

import struct

import numpy as np
import pytest

from skein.operators import fields as V
from skein.operators import geometry as G
from skein.plans import analysis
from skein.sources import binary, text
from skein.streaming import lines as live

POINTS = "line_id bigint, pt_idx int, x double, y double, z double"


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, i, k + i / 4, i / 8, k / 2) for k, n in enumerate((5, 1, 9, 30)) for i in range(n)]
    return spark.createDataFrame(rows, POINTS)


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


ALL = ["line_id", "pt_idx", "x", "y", "z"]


def test_bsl_layout_and_round_trip(spark, points, tmp_path):
    path = str(tmp_path / "a.bsl")
    binary.write_bsl(points, path)
    raw = open(path, "rb").read()
    assert struct.unpack("<6q", raw[:48]) == (4, 0, 5, 1, 9, 30)
    assert len(raw) == 48 + 45 * 12
    for records in ("3", "7", "1000"):
        back = binary.read_bsl(spark, path, records=records)
        assert table(back, *ALL) == table(points, *ALL)
    assert table(analysis.read_lines(spark, path), *ALL) == table(points, *ALL)


def test_obj_round_trip(spark, points, tmp_path):
    path = str(tmp_path / "a.obj")
    text.write_obj(points.repartition(3), path)
    assert table(text.read_obj(spark, path, as_one=True), *ALL) == table(points, *ALL)


def test_obj_options(spark, tmp_path):
    path = tmp_path / "b.obj"
    path.write_text(
        "# c\nv 0 0 0\nvt 0.5\nv 0 0 1e-9\nvt 1\nv 1 2 3\nvt 0\ng line1\nl 1 2 3\n"
        "v -4 0 0\nvt 7\nv 5 0 0\nvt 8\ng line2\nl 4 5\nv 9 9 9\n"
    )
    path = str(path)
    plain = text.read_obj(spark, path)
    assert [r[:2] for r in table(plain, *ALL)] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert table(text.read_obj(spark, path, min_step=1e-6), *ALL)[1] == (0, 1, 1, 2, 3)
    assert table(text.read_obj(spark, path, nonnegative=True), "x")[0] == (0,)
    assert text.read_obj(spark, path, max_lines=1).count() == 3
    assert table(text.read_obj(spark, path, downsample=2), *ALL)[1][:3] == (0, 1, 1)
    moved = text.read_obj(spark, path, scale=(2, 2, 2), origin=(1, 0, 0))
    assert table(moved, *ALL)[2] == (0, 2, 3, 4, 6)
    indexed = text.read_indexed_obj(spark, path)
    assert table(indexed, *ALL, "importance") == [
        (0, 0, 0, 0, 0, 0.5), (0, 1, 1, 2, 3, 0), (1, 0, -4, 0, 0, 7), (1, 1, 5, 0, 0, 8)
    ]


def test_near_vertices_of_several_files(spark, tmp_path):
    for name, x in (("a", 0), ("b", 50)):
        (tmp_path / f"{name}.obj").write_text(f"v {x} 0 0\nv {x} 0 0.1\nv {x} 0 3\nl 1 2 3\nv {x} 9 9\nl 4\n")
    got = text.read_obj(spark, str(tmp_path), end_markers=("l",), min_step=1.0)
    assert sorted((r.file.rsplit("/", 1)[1], r.line_id, r.pt_idx, r.x, r.z) for r in got.collect()) == [
        (f, *row) for f, x in (("a.obj", 0.0), ("b.obj", 50.0)) for row in [(0, 0, x, 0.0), (0, 1, x, 3.0), (1, 0, x, 9.0)]
    ]


def test_lines_from_an_offset(spark, tmp_path):
    path = tmp_path / "many.obj"
    path.write_text("".join(f"v {k} 0 0\nv {k} 1 0\ng\n" for k in range(5)))
    got = text.read_obj(spark, str(path), offset=2, max_lines=2)
    assert table(got, *ALL) == [(0, 0, 2, 0, 0), (0, 1, 2, 1, 0), (1, 0, 3, 0, 0), (1, 1, 3, 1, 0)]
    assert text.read_obj(spark, str(path), offset=9).count() == 0


def test_text_lines(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("2\n2 1\n0 0 0 1 1 1\n5 6 7\n")
    assert table(text.read_counted_lines(spark, str(a)), *ALL) == [
        (0, 0, 0, 0, 0), (0, 1, 1, 1, 1), (1, 0, 5, 6, 7)
    ]
    b = tmp_path / "b.txt"
    b.write_text("0 0 0 1 1 1\n5 6 7\n")
    assert table(text.read_row_lines(spark, str(b)), *ALL) == table(
        text.read_counted_lines(spark, str(a)), *ALL
    )
    c = tmp_path / "opt.txt"
    c.write_text("2\n2\n20 40\n0 0\n1\n60 80\n")
    assert table(text.read_planar_lines(spark, str(c)), *ALL) == [
        (0, 0, 1, 2, 0), (0, 1, 0, 0, 0), (1, 0, 3, 4, 0)
    ]
    d = tmp_path / "tr.txt"
    d.write_text("head\n7;01:00:01.5;-100;200;300;z\n7;01:00:02;0;200;300;z\n9;0:0:0;100;0;0;\n7;0:0:0;1;1;1;\n")
    got = text.read_trajectories(spark, str(d))
    assert [r[:2] for r in table(got, *ALL)] == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert table(got, *ALL)[0] == (0, 0, 0, 2, 3)
    assert [r[2] for r in table(got, "line_id", "pt_idx", "t_sec")] == [3601.5, 3602, 0, 0]
    e = tmp_path / "cl.txt"
    e.write_text("head\n1;-3;-2;0;0;0\n1;1;2;0;0;0\n2;5;5;0;0;0\n1;0;0;0;0;0\n")
    assert table(text.read_clustered(spark, str(e)), *ALL) == [
        (0, 0, 0, 0, 0), (0, 1, 4, 4, 0), (1, 0, 8, 7, 0), (2, 0, 3, 2, 0)
    ]
    f = tmp_path / "q.txt"
    f.write_text("id=4,n=2,loop=1\n1 2 3\n4 5 6\n#\nid=5,n=1,loop=0\n7 8 9\n#\n")
    assert table(text.read_query_curves(spark, str(f)), *ALL, "loop") == [
        (4, 0, 1, 2, 3, 1), (4, 1, 4, 5, 6, 1), (5, 0, 7, 8, 9, 0)
    ]


def test_fields(spark, tmp_path):
    want = [(0, 0, 1, 2), (0, 1, 5, 6), (1, 0, 3, 4), (1, 1, 7, 8)]
    files = {
        "f.vec": ("Gvec\n2 2\n1 2 3 4\n5 6 7 8\n", text.read_vec_field),
        "f.txt": ("G\nI=2,J=2\n0,0,1,2\n0,0,3,4\n0,0,5,6\n0,0,7,8\n", text.read_txt_field),
        "f.csv": ("1,2,3,4,\n5,6,7,8,\n", text.read_csv_field),
    }
    for name, (body, reader) in files.items():
        (tmp_path / name).write_text(body)
        assert table(reader(spark, str(tmp_path / name)), "col", "row", "u", "v") == want
    out = str(tmp_path / "out")
    text.write_csv_field(text.read_csv_field(spark, str(tmp_path / "f.csv")).drop("file"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["1.0,2.0,3.0,4.0,", "5.0,6.0,7.0,8.0,"]
    (tmp_path / "bad.csv").write_text("1,2,\n1,2,3,4,\n")
    with pytest.raises(ValueError):
        text.read_csv_field(spark, str(tmp_path / "bad.csv"))

    head = (
        "# AmiraMesh BINARY-LITTLE-ENDIAN 2.1\ndefine Lattice 3 2 2\nParameters {\n"
        "  BoundingBox 0 2 0 1 0 1,\n  CoordType \"uniform\"\n}\n"
        "Lattice { float[3] Data } @1\n# Data section follows\n@1\n"
    )
    cells = np.arange(36, dtype="<f4")
    cells[3] = np.nan
    am = tmp_path / "f.am"
    am.write_bytes(head.encode() + cells.tobytes())
    grid = binary.read_amira(spark, str(am), records="5")
    got = {(r.col, r.row, r.layer): r.u for r in grid.collect()}
    assert len(got) == 12 and got[1, 0, 0] is None and got[2, 1, 1] == 33
    assert V.dimensions(grid) == (3, 2, 2)
    am.write_bytes(head.replace("uniform", "curvy").encode() + cells.tobytes())
    with pytest.raises(Exception):
        binary.read_amira(spark, str(am)).count()

    cp = tmp_path / "f.cp"
    cp.write_bytes(
        struct.pack("<I", 2) + struct.pack("<6f", 1, 2, 3, 4, 5, 6) + struct.pack("<2i", 7, 4)
        + struct.pack("<2f", 0.5, 2)
    )
    got = binary.read_critical_points(spark, str(cp), records="1")
    assert table(got, "cp_id", "x", "z", "type", "scale") == [(0, 1, 3, 7, 0.5), (1, 4, 6, 4, 2)]


def test_order_sinks(spark, points, tmp_path):
    order = spark.createDataFrame([(i, 9 - i) for i in range(5)], "rank bigint, line_id bigint")
    binary.write_order_file(order, str(tmp_path / "o.dat"))
    assert np.fromfile(tmp_path / "o.dat", dtype="<i4").tolist() == [9, 8, 7, 6, 5]
    text.write_order(order, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == list("98765")


def test_survivor_and_affinity_sinks(spark, points, tmp_path):
    from skein.operators import ranking

    order = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "rank bigint, line_id bigint")
    dump = ranking.survivors(order, points, 2)
    assert {(r.kept, r.line_id) for r in dump.collect()} == {(2, 3), (2, 1)}
    text.write_survivors(dump, str(tmp_path / "s"))
    kept = spark.read.option("sep", ";").csv(str(tmp_path / "s/kept=2"))
    assert {r[0] for r in kept.collect()} == {"4", "2"} and kept.count() == 31
    assert ranking.survivors(order, points, 5).count() == 0

    segments = spark.createDataFrame([(0, 0), (0, 4), (2, 0)], "line_id bigint, beg int")
    pairs = spark.createDataFrame(
        [(0, 4, 2, 0, 0.5)], "line_id bigint, beg int, nbr_line bigint, nbr_beg int, similarity double"
    )
    text.write_affinity(pairs, segments, str(tmp_path / "a"))
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == ["3", "1 2 0.5"]


def test_convert_folder(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 10 5 0\ng line1\n")
    (made,) = binary.convert_folder(spark, str(tmp_path), str(tmp_path), 0.5)
    assert table(binary.read_bsl(spark, made), *ALL) == [(0, 0, 0, 0, 0), (0, 1, 2, 1, 0)]


def test_analysis_runs_from_file(spark, tmp_path):
    rows = [(k, i, float(i), 0.1 * k + 0.02 * i * i * (k % 3), 0.0) for k in range(6) for i in range(12)]
    path = str(tmp_path / "in.bsl")
    binary.write_bsl(spark.createDataFrame(rows, POINTS), path)
    base = dict(n_lines=5, radius=0.05, pool=4, iterations=2)
    for app in (analysis.Application.NONE, analysis.Application.ALPHA, analysis.Application.CONTRACTION):
        out = analysis.analyze_file(spark, path, analysis.Settings(application=app, **base)).collect()
        assert len(out) == 60
        if app is analysis.Application.ALPHA:
            assert all(0 <= r.alpha <= 1 and r.color is not None for r in out)
    marked = analysis.query_critical_points(
        binary.read_bsl(spark, path), spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double"), 0.15
    )
    assert {r.line_id for r in marked.where("alpha = 1").collect()} == {0, 1}


def test_fading_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "line_id bigint, pt_idx int, alpha double"
    for k, alpha in enumerate((1.0, 0.0, 0.5)):
        spark.createDataFrame([(0, 0, alpha), (0, k + 1, alpha)], schema).coalesce(1).write.mode(
            "append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.fade_stream(stream, str(tmp_path / "st"), str(tmp_path / "cp")).awaitTermination()
    got = {r.pt_idx: r.alpha for r in spark.read.parquet(str(tmp_path / "st/state=2")).collect()}
    assert len(got) == 4
    value = 0.0
    for alpha in (1.0, 0.0, 0.5):
        value += (alpha - value) * 0.1
    assert got[0] == pytest.approx(value)


def test_stream_of_segments_fills_buckets(spark, points, tmp_path):
    from skein.operators import lsh, segmentation

    segments = segmentation.attributes(points, segmentation.cut_evenly(points, 2.0))
    index = lsh.LshIndex(lsh.fit(lsh.draw_functions(3, 1), segments), 2, 1)
    segments.write.parquet(str(tmp_path / "seg"))
    stream = spark.readStream.schema(segments.schema).parquet(str(tmp_path / "seg"))
    live.append_buckets(stream, index, str(tmp_path / "b"), str(tmp_path / "c1")).awaitTermination()
    filed = spark.read.parquet(str(tmp_path / "b")).drop("batch")
    key = ["line_id", "beg", *lsh.BUCKET]
    assert table(filed, *key) == table(index.buckets(segments), *key)
    points.write.parquet(str(tmp_path / "pts"))
    arriving = spark.readStream.schema(points.schema).parquet(str(tmp_path / "pts"))
    live.neighbours_of_stream(
        arriving, points, 1.0, str(tmp_path / "e"), str(tmp_path / "c2")
    ).awaitTermination()
    from skein.operators.search import neighbour_edges

    want = neighbour_edges(points, 1.0)
    got = spark.read.parquet(str(tmp_path / "e"))
    cols = ["line_id", "pt_idx", "nbr_line", "nbr_pt", "dist"]
    assert table(got, *cols) == table(want, *cols)
