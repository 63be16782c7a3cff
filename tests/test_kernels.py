"""Kernels, patches, files and the queue against brute force and round trips."""

import gzip
import json
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxquarry.functions import geometry as G
from voxquarry.operators import aggregate as A
from voxquarry.operators import blocks as B
from voxquarry.operators import metrics as M
from voxquarry.operators import patches as P
from voxquarry.operators import points as Q
from voxquarry.operators import tasks as T
from voxquarry.operators import voxels as V
from voxquarry.sources import arrays, files
from voxquarry.streaming import queue


def frame(spark, a, offset=(0, 0, 0)):
    return spark.createDataFrame(files.array_frame(np.asarray(a), offset))


def array(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


def flood(a, connectivity):
    """Components by flood fill, named as the operator names them."""
    steps = [s for o in B.offsets(connectivity) for s in (o, tuple(-v for v in o))]
    out = np.zeros(a.shape, int)
    for start in zip(*np.nonzero(a)):
        if out[start]:
            continue
        name = 1 + int(np.ravel_multi_index(start, a.shape))
        stack = [start]
        out[start] = name
        while stack:
            p = stack.pop()
            for s in steps:
                q = tuple(i + j for i, j in zip(p, s))
                if all(0 <= i < n for i, n in zip(q, a.shape)) and not out[q] and a[q] == a[start]:
                    out[q] = name
                    stack.append(q)
    return out


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_like_flood_fill(spark, connectivity):
    a = np.random.default_rng(connectivity).choice([0, 0, 1, 2], (5, 9, 8))
    for block in ((2, 3, 4), (5, 9, 8)):
        got = array(B.connected_components(frame(spark, a), a.shape, block, connectivity), a.shape)
        assert np.array_equal(got, flood(a, connectivity))


def test_components_of_snake_and_nothing(spark):
    a = np.zeros((1, 7, 9), int)
    a[0, ::2] = 1
    a[0, 1, -1] = a[0, 3, 0] = a[0, 5, -1] = 1
    assert np.array_equal(array(B.connected_components(frame(spark, a), a.shape, (1, 2, 2)), a.shape), a * 1)
    assert array(B.connected_components(frame(spark, a * 0), a.shape, (1, 2, 2)), a.shape).max() == 0


def test_holes(spark):
    a = np.ones((3, 5, 5), int)
    a[1, 2, 2] = 0
    a[1, 0, 0] = 0
    got = array(B.fill_holes(frame(spark, a), a.shape, (2, 2, 2)), a.shape)
    assert got[1, 2, 2] == 1 and got[1, 0, 0] == 0


def test_median_with_halo(spark):
    a = np.random.default_rng(1).integers(0, 99, (4, 7, 6))
    p = np.pad(a, 1, "symmetric")
    want = np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3, 3)).reshape(*a.shape, -1), axis=3)
    for block in ((4, 7, 6),):
        assert np.array_equal(array(B.median_filter(frame(spark, a), (3, 3, 3), block), a.shape), want)


def test_validate_finds_black_box(spark):
    a = np.random.default_rng(0).integers(1, 256, (64, 64, 64)).astype(float)
    assert B.validate(frame(spark, a), (32, 64, 64)).first().valid
    b = np.zeros_like(a)
    b[:] = a
    b[16:-16, 16:-16, 16:-16] = 0
    assert B.validate(frame(spark, a), (64, 64, 64)).first().valid
    hits = [int((B.correlation(b, t) > 0.9).sum()) for t in B.templates()]
    assert (sum(h > 100 for h in hits) <= 4) == B.validate(frame(spark, b), (32, 64, 64)).first().valid


def test_identity_inference_gives_input(spark):
    a = np.random.default_rng(3).random((9, 20, 17))
    got = P.infer(frame(spark, a), a.shape, (4, 8, 8), (2, 3, 3), augment=True)
    assert np.allclose(array(got, a.shape), a, atol=1e-9)
    assert array(P.infer(frame(spark, a * 0), a.shape, (4, 8, 8), (2, 3, 3)), a.shape).max() == 0


def test_model_registry_and_plugin(spark):
    P.register_model("double", lambda a: np.stack([a, 2 * a]))
    a = np.arange(1, 25.0).reshape(2, 3, 4)
    got = P.infer(frame(spark, a), a.shape, (2, 2, 2), (0, 1, 1), model="double")
    assert np.allclose(array(got.filter("c = 1"), a.shape), 2 * a)
    P.register_plugin("add", lambda df, by=0: df.withColumn("value", F.col("value") + by))
    assert array(P.plugin(frame(spark, a), "add", "by=5"), a.shape).min() == 6
    assert P.parse_args("a=1;b=0.5;c=x") == {"a": 1, "b": 0.5, "c": "x"}


def test_voting_golden(spark):
    rng = np.random.default_rng(1)
    a = rng.random((5, 2, 3, 4))
    rows = pd.concat([files.array_frame(a[c], (0, 0, 0)).assign(c=c) for c in range(5)])
    assert np.array_equal(array(A.channel_voting(spark.createDataFrame(rows)), a.shape[1:]), a.argmax(axis=0) + 1)


def test_identical_segmentations(spark):
    df = spark.createDataFrame(pd.DataFrame({"seg": [1, 1, 2, 2, 3], "gt": [1, 1, 2, 2, 3]}))
    t = M.contingency(df)
    r = M.rand_scores(t).first()
    assert (r.rand_index, r.adjusted_rand_index, r.fowlkes_mallows) == (1, 1, 1) and M.split_vi(t).first().vi == 0


def test_metrics_are_symmetric(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"seg": rng.integers(0, 4, 300), "gt": rng.integers(0, 5, 300)}))
    one, two = M.contingency(df), M.contingency(df, seg="gt", gt="seg")
    assert M.rand_scores(one).first().rand_index == M.rand_scores(two).first().rand_index
    a, b = M.split_vi(one).first(), M.split_vi(two).first()
    assert np.isclose(a.vi, b.vi) and np.isclose(a.false_merge, b.false_split)
    s = M.scores_by_threshold(df, "seg", "gt", [0, 2]).collect()
    assert [r.threshold for r in s] == [0.0, 2.0]


def test_edit_distance_counts_both_ways(spark):
    t = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (2, 2, 70), (3, 2, 5), (0, 1, 99)], "seg long, gt long, n long")
    r = M.edit_distance(t, 10).first()
    assert (r.false_merges, r.false_splits) == (1, 1)


def test_wiggle_room_keeps_each_value(spark):
    """1 is lost by dilation and put back at the only voxel that had 5."""
    df = frame(spark, [[[1, 5, 9]]])
    out = M.wiggle_room_precision_recall(df, F.col("value"), F.col("x") == 0, (2, 2, 2), 1)
    assert sorted(tuple(r) for r in out.collect()) == [(1, pytest.approx(2 / 3), 1), (5, 0.5, 0), (9, 0, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_wiggle_room_like_brute_force(spark, seed):
    shape, margin = (4, 7, 6), 2
    a = np.random.default_rng(seed).integers(0, 120, shape)
    at = list(np.ndindex(shape))
    true = {p: p[1] % 4 == 0 for p in at}
    ball = {p: [q for q in at if sum(abs(i - j) for i, j in zip(p, q)) <= margin] for p in at}
    near = {p: any(true[q] for q in ball[p]) for p in at}
    wide = {p: max(a[q] for q in ball[p]) for p in at}
    for v in set(a.flat) - set(wide.values()):
        wide[next(p for p in at if a[p] == v)] = v
    assert set(wide.values()) < set(a.flat)  # some values are overwritten
    want = []
    for v in sorted(set(a.flat)):
        called = [p for p in at if a[p] >= v]
        want.append((v, sum(near[p] for p in called) / len(called), sum(true[p] for p in at if wide[p] >= v) / sum(true.values())))
    out = M.wiggle_room_precision_recall(frame(spark, a), F.col("value"), F.col("y") % 4 == 0, (2, 3, 4), margin)
    assert np.allclose(sorted(tuple(r) for r in out.collect()), want)


def test_unknown_values_keep_constant_sections(spark):
    a = np.full((2, 3, 3), 7)
    a[1] = 0
    assert np.array_equal(array(A.normalize_contrast(frame(spark, a)), a.shape), a)
    assert np.array_equal(array(A.normalize_section_shang(frame(spark, a)), a.shape), a)


@settings(max_examples=20, deadline=None)
@given(st.tuples(*[st.integers(-40, 40)] * 3), st.tuples(*[st.integers(1, 12)] * 3))
def test_box_text_round_trip(spark, start, size):
    df = spark.createDataFrame([(*start, *[a + s for a, s in zip(start, size)])], "z0 long, y0 long, x0 long, z1 long, y1 long, x1 long")
    text = df.select(F.concat(F.lit("a/b_"), G.format_box(), F.lit(".h5")).alias("t"))
    assert G.parse_box(text, "t").drop("t").first() is not None
    got = G.parse_box(text, "t").select(*df.columns).first()
    assert tuple(got) == tuple(df.first())


def test_text_without_box_gives_nulls(spark):
    df = spark.createDataFrame([("no box",), (None,)], "t string")
    assert all(r.z0 is None for r in G.parse_box(df, "t").collect())


def test_decompositions_differ(spark):
    df = spark.createDataFrame([(0, -1, 0, 0, 4, 2, 2)], "task_id long, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long")
    n = {m: G.decompose(df, (2, 2, 2), mode=m).count() for m in ("full", "aligned", "clamped")}
    assert n == {"full": 2, "aligned": 3, "clamped": 3}
    with pytest.raises(ValueError):
        G.decompose(df, (2, 2, 2), mode="other")


def test_grid_bounds(spark):
    n = lambda **k: G.grid_boxes(spark, (0, 0, 0), (4, 10, 4), (4, 4, 4), **k).count()
    assert n() == 3 and n(bounded=True) == 2
    assert G.grid_boxes(spark, (0, 0, 0), (4, 10, 4), (4, 4, 4), respect_stop=True).agg(F.max("y1")).first()[0] == 10
    assert G.grid_boxes(spark, (1, 1, 1), (3, 3, 3), (4, 4, 4), align=(4, 4, 4)).first().z0 == 0


def test_plans(spark):
    """A point join has no nested loop, a box prunes partitions."""
    a = frame(spark, np.ones((4, 4, 4)))
    from voxquarry.operators.points import close_pairs

    pts = spark.range(10).select(F.col("id").alias("post_idx"), *[F.col("id").alias(k) for k in "zyx"])
    assert "NestedLoop" not in close_pairs(pts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in V.mask(a, a, (2, 2, 2))._jdf.queryExecution().executedPlan().toString()


def test_close_pairs_meet_as_lists(spark):
    """1200 points on few places: the join gives lists, and all pairs come of them, also of cells dealt over parts and of cut lists."""
    rng = np.random.default_rng(5)
    rows = [(int(i), *(int(v) for v in rng.integers(-3, 3, 3))) for i in rng.permutation(400)] + [(int(i), 1, 1, 1) for i in range(400, 1200)]
    rows += [(7, 1, 1, 1), (7, 1, 1, 2), (7, 1, 1, 2), (None, 1, 1, 1), (8, None, 1, 1)]  # ids that come again pair with others, not with each other
    pts = spark.createDataFrame(rows, "post_idx long, z long, y long, x long")
    known = np.array([r for r in rows if None not in r])
    ids, at = known[:, 0], known[:, 1:]
    square = ((at[:, None] - at[None]) ** 2).sum(2)
    a, b = np.nonzero((square <= 4) & (ids[:, None] < ids[None]))
    want = sorted(zip(ids[a].tolist(), ids[b].tolist(), np.sqrt(square[a, b]).tolist()))
    assert Q.close_lists(pts, 2).count() < 216 * 33
    for df in (Q.close_pairs(pts, 2), Q.pairs_of(Q.close_lists(pts, 2, most=50), piece=7)):
        got = df.toPandas().to_numpy()
        assert sorted((int(i), int(j), d) for i, j, d in got) == want
    assert Q.close_lists(pts, 2, most=50).select(F.max(F.size("left"))).first()[0] < 150  # no list of a whole crowded place


def test_duplicate_posts_make_no_pairs(spark):
    """Against brute force, with ids that come twice and pres without a place; 2000 posts at one place give few joined rows."""
    rng = np.random.default_rng(6)
    pre = [(i, *(int(v) for v in rng.integers(0, 4, 3))) for i in range(30)] + [(30, None, 1, 1), (3, 9, 9, 9)]
    post = [(int(i), int(rng.integers(0, 31)), *(int(v) for v in rng.integers(0, 5, 3))) for i in rng.integers(0, 60, 80)]
    labels = [(z, y, x, int(rng.integers(0, 3))) for z in range(5) for y in range(5) for x in range(5)]
    frames = spark.createDataFrame(pre, "pre_idx long, z long, y long, x long"), spark.createDataFrame(post, "post_idx long, pre_idx long, z long, y long, x long"), spark.createDataFrame(labels, "z long, y long, x long, value long")
    value = {r[:3]: r[3] for r in labels}
    o = [(i, at, None if p[1] is None else float(sum((a - b) ** 2 for a, b in zip(at, p[1:])) ** 0.5), value[tuple(at)]) for i, own, *at in post for p in pre if p[0] == own and value[tuple(at)]]
    for radius in (1, 2):
        want = set()
        for a in o:
            for b in o:
                if a[0] < b[0] and a[3] == b[3] and sum((i - j) ** 2 for i, j in zip(a[1], b[1])) <= radius**2:
                    want.add(a[0] if a[2] is not None and b[2] is not None and a[2] > b[2] else b[0])
        got = [r[0] for r in Q.duplicate_posts_on_object(*frames, radius).collect()]
        assert sorted(got) == sorted(want) and want
    crowd = spark.range(2000).select(F.col("id").alias("post_idx"), (F.col("id") % 30).alias("pre_idx"), *[F.lit(i).cast("long").alias(a) for i, a in enumerate("zyx")])
    df = Q.duplicate_posts_on_object(frames[0], crowd, spark.createDataFrame([(0, 1, 2, 1)], "z long, y long, x long, value long"), 1)
    assert "close_pairs" not in Q.duplicate_posts_on_object.__code__.co_names and df.count() == 1999
    assert Q._front(crowd.select("z", F.col("post_idx").alias("id"), (F.col("post_idx") % 7).cast("double").alias("d")), ["z"]).count() <= 4


def test_volume_on_disk(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 9, (4, 6, 6))
    path = str(tmp_path / "v")
    files.save_volume(frame(spark, a), path, (2, 3, 3))
    got = files.load_volume(spark, path, (2, 3, 3), (1, 2, 0), (3, 5, 3))
    assert "PartitionFilters: [isnotnull(" in got._jdf.queryExecution().executedPlan().toString()
    assert np.array_equal(array(got, a.shape)[1:3, 2:5, 0:3], a[1:3, 2:5, 0:3])
    files.save_volume(frame(spark, a[:2] * 0), path, (2, 3, 3))  # a second write replaces its own blocks only
    again = array(files.load_volume(spark, path, (2, 3, 3)), a.shape)
    assert again[:2].max() == 0 and np.array_equal(again[2:], a[2:])


def test_npy_png_swc_json(spark, tmp_path):
    a = np.random.default_rng(4).integers(0, 256, (2, 5, 4))
    np.save(tmp_path / "a.npy", a)
    assert np.array_equal(array(files.load(spark, str(tmp_path / "a.npy")), a.shape), a)
    np.save(tmp_path / "p.npy", np.array([[1, 2, 3]]))
    assert files.load_npy_points(spark, str(tmp_path / "p.npy"), (2, 1, 1)).first().z == 2.0
    (tmp_path / "png").mkdir()
    for r in files.png_sections(frame(spark, a)).collect():
        (tmp_path / "png" / r.name).write_bytes(r.content)
    assert np.array_equal(array(files.load_png(spark, str(tmp_path / "png")), a.shape), a)
    nodes = spark.createDataFrame([(7, 1, 0, 1.0, 2.0, 3.0, 0.5, -1), (7, 2, 0, 1.0, 2.0, 4.0, 0.5, 1)], "object_id long, node long, kind long, x double, y double, z double, radius double, parent long")
    (tmp_path / "7.swc").write_text("# comment\n1 0 1.0 2.0 3.0 0.5 -1\n2 0 1.0 2.0 4.0 0.5 1\n")
    assert files.load_swc(spark, str(tmp_path / "7.swc")).exceptAll(nodes).count() == 0
    files.save_swc(nodes, str(tmp_path / "swc"))
    (tmp_path / "s.json").write_text('{"pre": [[0, 1, 2], [3, 4, 5]], "post": [[0, 1, 2, 3]]}')
    pre, post = files.load_synapses(spark, str(tmp_path / "s.json"))
    assert pre.count() == 2 and tuple(post.first()) == (0, 0, 1, 2, 3)
    (tmp_path / "b.txt").write_text("# x y z\n1,2,3,4,5,6\n")
    assert files.load_text_boxes(spark, str(tmp_path / "b.txt"), "xyz").first().z0 == 3
    with pytest.raises(ImportError):
        files.load(spark, str(tmp_path / "a.h5"))


@pytest.mark.parametrize("codec", ["raw", "gzip", "zlib", "zstd"])
def test_zarr_round_trip(spark, tmp_path, codec):
    a = np.random.default_rng(7).integers(0, 999, (5, 6, 7))
    a[2:4, 3:6, 4:7] = 7  # a chunk of fill values alone is not written
    path = str(tmp_path / "a.zarr")
    df = frame(spark, a).filter("value <> 7")
    assert arrays.save_zarr(df, path, a.shape, (2, 3, 4), dtype="<u2", codec=codec, fill=7) == int((a != 7).sum())
    assert not (tmp_path / "a.zarr" / "1.1.1").exists() and (tmp_path / "a.zarr" / "0.0.0").exists()
    assert np.array_equal(array(files.load(spark, path), a.shape), a)
    arrays.save_zarr(df, path, a.shape, (2, 3, 4), dtype="<u2", codec=codec, fill=7)  # again: the same
    (tmp_path / "a.zarr" / "2.1.1").write_bytes(b"broken")  # not opened by a box beside it
    got = files.load(spark, path, offset=(10, 0, 0), start=(11, 2, 0), stop=(14, 5, 4))
    assert got.count() == 3 * 3 * 4 and all(r.value == a[int(r.z) - 10, int(r.y), int(r.x)] for r in got.collect())
    with pytest.raises(ValueError):
        arrays.save_zarr(df, path, a.shape, (2, 3, 4), codec="none")


def test_n5_and_mrc(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 999, (3, 4, 5)).astype(">u2")
    root = tmp_path / "a.n5"
    root.mkdir()
    (root / "attributes.json").write_text('{"dimensions": [5, 4, 3], "blockSize": [3, 2, 2], "dataType": "uint16", "compression": {"type": "gzip"}}')
    for z in range(2):
        for y in range(2):
            for x in range(2):
                part = a[2 * z : 2 * z + 2, 2 * y : 2 * y + 2, 3 * x : 3 * x + 3]
                name = root / str(x) / str(y) / str(z)
                name.parent.mkdir(parents=True, exist_ok=True)
                name.write_bytes(struct.pack(">HH3I", 0, 3, *part.shape[::-1]) + gzip.compress(part.tobytes()))
    assert np.array_equal(array(files.load(spark, str(root)), a.shape), a)
    for end, stamp in (("<", b"DD"), (">", bytes([17, 17]))):
        b = a.astype(f"{end}f4")
        head = bytearray(1024)
        head[:16], head[92:96], head[212:214] = struct.pack(f"{end}4i", 5, 4, 3, 2), struct.pack(f"{end}i", 8), stamp
        (tmp_path / "a.mrc").write_bytes(bytes(head) + b"extended" + b.tobytes())
        assert np.array_equal(array(files.load(spark, str(tmp_path / "a.mrc")), a.shape), a)
    with pytest.raises(ValueError):
        arrays.decode_mrc(struct.pack("<4i", 1, 1, 1, 4) + bytes(1020))


def test_dvid_lists(spark):
    rows = [
        {"Kind": "PreSyn", "Pos": [3, 2, 1], "Prop": {"conf": "0.5", "user": "a"}},
        {"Kind": "PostSyn", "Pos": [6, 5, 4], "Prop": {"user": "b"}, "Rels": [{"To": [9, 8, 7]}]},
        {"Kind": "PostSyn", "Pos": [6, 5, 5], "Prop": {"user": "b"}, "Rels": []},
        {"Kind": "PostSyn", "Pos": [6, 5, 6], "Prop": {"user": "b"}, "Rels": [{"To": [0, 0, 0]}]},
        {"Kind": "PreSyn", "Pos": [9, 8, 7], "Prop": {"user": "a"}},
    ]
    pre, post = Q.from_dvid(spark.createDataFrame([(json.dumps(rows),)], "json string"))
    assert sorted(tuple(r) for r in pre.select("pre_idx", "z", "y", "x", "conf", "user").collect()) == [(0, 1, 2, 3, 0.5, "a"), (1, 7, 8, 9, 1.0, "a")]
    assert [tuple(r) for r in post.select("pre_idx", "z", "y", "x", "user").collect()] == [(1, 4, 5, 6, "b")]
    more = Q.add_pre(pre, spark.createDataFrame([(0, 1, 1, 1)], "pre_idx long, z long, y long, x long"), 0.25)
    assert more.filter("conf = 0.25").first().pre_idx == 2
    assert Q.same((pre, post), (pre.drop("conf"), post)) and not Q.same((pre, post), (more, post)) and not Q.same((pre, post), (pre, post.withColumn("z", F.col("z") + 1)))
    with pytest.raises(ValueError):
        Q.add_pre(pre, pre, 1.5)


def test_block_payloads(spark):
    a = np.random.default_rng(6).random((3, 4, 5))
    assert np.array_equal(array(B.to_voxels(B.to_blocks(frame(spark, a), (2, 2, 2))), a.shape), a)


def test_queue_works_each_task_once(spark, tmp_path):
    folder, state = str(tmp_path / "tasks"), str(tmp_path / "state")
    files.task_json(spark, [{"bbox": "0-1_0-2_0-3"}, {"bbox": "1-2_0-2_0-3"}, {"bbox": "broken"}], folder)
    seen = []
    handle = lambda df: seen.extend(r.bbox for r in df.collect())
    queue.work(spark, folder, state, handle).awaitTermination()
    files.task_json(spark, [{"bbox": "1-2_0-2_0-3"}, {"bbox": "2-3_0-2_0-3"}], folder)
    queue.work(spark, folder, state, handle).awaitTermination()
    assert sorted(seen) == ["0-1_0-2_0-3", "1-2_0-2_0-3", "2-3_0-2_0-3"]


def test_tasks(spark, tmp_path):
    t = T.create_bbox(spark, (0, 0, 0), size=(1, 2, 3))
    assert t.first().bbox == "0-1_0-2_0-3"
    T.mark_complete(t, str(tmp_path / "done"))
    assert T.not_complete(t, spark.read.parquet(str(tmp_path / "done"))).count() == 0
    p = T.plan_patches(spark, 1e6, (4, 16, 16), (1, 4, 4), 3).first()
    assert p.bytes <= 5e5 and p.n_z >= 1
    assert T.from_names(spark.createDataFrame([("x_0-1_0-2_0-3.h5",), ("none",)], "bbox string")).count() == 1
    assert A.scales((10, 100, 100), (40, 4, 4), 2) == [(1, 2, 2), (1, 2, 2)] and A.method_for("segmentation") == "mode"
    assert files.layer_type_of("float32", 4, 3, True) == "probability_map"
