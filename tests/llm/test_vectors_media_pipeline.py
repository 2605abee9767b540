"""Embeddings, media, components, and the pipeline against its parts."""

import zlib

import numpy as np
import pytest

from tellurion.llm import op4_embedding_dedup as E
from tellurion.llm import op9_media as M
from tellurion.llm.common import connected_components


def vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<double>")


def brute(rows, limit=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and np.any(np.array(v, float))}
    ids = sorted(ok)
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    link = x @ x.T >= limit
    np.fill_diagonal(link, False)
    comp = list(range(len(ids)))
    for _ in ids:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(ids))]
    return {i: (int(link[k].sum()), ids[comp[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [512, 6])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(12):
        base = rng.normal(size=24)
        for s in rng.uniform(0.01, 0.3, 8):
            rows.append((len(rows), (base + s * rng.normal(size=24)).tolist()))
        rows += [(len(rows), base.tolist()), (len(rows) + 1, base.tolist()), (len(rows) + 2, (2 * base).tolist())]
    want = brute(rows)
    bad = [(1000, None), (1001, [0.0] * 24), (1002, [1.0] * 23 + [float("nan")]), (1003, [1.0] * 23 + [None]), (1004, [])]
    got = {r["vec_id"]: r for r in E.dedup(vectors(spark, rows + bad)).collect()}
    assert len(got) == len(rows) + len(bad)
    for i, _ in bad:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    true, found = sum(n for n, _ in want.values()), sum(got[i]["n_links"] for i in want)
    assert all(got[i]["n_links"] <= want[i][0] for i in want) and found >= 0.97 * true
    assert np.mean([got[i]["component_id"] == want[i][1] for i in want]) >= 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_media_pairs_in_any_order_of_matches():
    """Numbers of images and places of corners don't rest on an order of the matches, nor on where the first corner lies."""
    rng = np.random.default_rng(4)
    for x in (np.zeros(0, np.int64), np.array([-5, -5, 3, 9]), rng.integers(-(2**62), 2**62, 50)[rng.integers(0, 50, 400)]):
        assert np.array_equal(M._numbers(x), np.unique(x, return_inverse=True)[1])
    query, image = np.repeat([5, 5, -2**60, 7], [12, 6, 9, 8]), np.repeat([-1, 2**61, 4, 4], [12, 6, 9, 8])
    q = np.column_stack((rng.uniform(-3000, 90000, (35, 2)), np.zeros(35), np.ones(35)))
    c = q + [40.0, -7.0, 0, 0]
    q[18:27, :2], c[18:27, :2] = q[18, :2], c[18, :2]  # nine matches of one corner
    want = {(5, -1, 12), (7, 4, 8)}
    for order in (np.arange(35), rng.permutation(35)):
        assert set(zip(*(v.tolist() for v in M.decide(query[order], image[order], q[order], c[order])), strict=True)) == want
    assert all(len(v) == 0 for v in M.decide(query[:0], image[:0], q[:0], c[:0]))


def test_recall_at_the_limit():
    """Pairs with a cosine just above 0.95 meet in some bucket."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * o
    x, y = E.buckets(a), E.buckets(b)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.95


def test_hadamard():
    h = E.fast_hadamard(np.eye(8))
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and set(np.unique(h)) == {-1.0, 1.0}
    x = np.random.default_rng(0).normal(size=(5, 20))
    assert np.allclose(np.linalg.norm(E.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_no_vectors(spark):
    assert E.dedup(vectors(spark, [])).count() == 0
    same = E.dedup(vectors(spark, [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (9, [1.0, 2.0])])).collect()
    assert {(r["n_links"], r["component_id"]) for r in same} == {(2, 7)}


def test_repeated_ids_on_different_vectors(spark):
    """(7, a), (7, b), (9, ~a), (11, ~b): each links with one other, in two components."""
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = lambda v: (v + 0.05 * np.eye(8)[2]).tolist()
    rows = [(7, a.tolist()), (7, b.tolist()), (9, near(a)), (11, near(b))]
    got = E.dedup(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(7, 1, 7), (7, 1, 7), (9, 1, 7), (11, 1, 7)]


def test_smallest_reachable():
    i, j = np.array([5, 3, 8, 7, 1]), np.array([3, 2, 7, 6, 1])
    assert E.reached(9, i, j).tolist() == [0, 1, 2, 2, 4, 2, 6, 6, 6]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5060)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 4)], "a bigint, b bigint")).collect()}
    comp = {v: v for e in edges for v in e}
    for _ in comp:
        change = False
        for a, b in edges:
            m = min(comp[a], comp[b])
            change |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
        if not change:
            break
    assert got == {v: c for v, c in comp.items() if any(v in e and e[0] != e[1] for e in edges)}


# media -----------------------------------------------------------------------------------------


def png(image, filters):
    import struct

    h, w = image.shape
    raw, prev = b"", np.zeros(w, int)
    for y in range(h):
        line, f = image[y].astype(int), filters[y % len(filters)]
        left = np.concatenate(([0], line[:-1]))
        up_left = np.concatenate(([0], prev[:-1]))
        if f == 4:
            p = left + prev - up_left
            d = np.abs(np.stack([p - left, p - prev, p - up_left]))
            base = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], prev, up_left))
        else:
            base = {0: 0 * line, 1: left, 2: prev, 3: (left + prev) // 2}[f]
        raw += bytes([f]) + ((line - base) & 255).astype(np.uint8).tobytes()
        prev = line

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoders():
    x = np.rint(np.clip(M.render(3, 32), 0, 255))
    assert np.array_equal(M.decode(M.encode_pgm(x)), x)
    assert np.array_equal(M.decode(png(x, [0, 1, 2, 3, 4])), x)
    ppm = b"P6 2 1 255\n" + bytes([0, 3, 6, 9, 9, 9])
    assert M.decode(ppm).tolist() == [[3, 9]]
    for bad in (None, b"", b"junk", b"P5 9 9 255\nxx", b"\x89PNG\r\n\x1a\nzzz"):
        assert M.decode(bad) is None


def test_crops_and_edits_are_found(spark):
    n = 60
    images = spark.createDataFrame([(i, bytearray(M.encode_pgm(M.render(i)))) for i in range(n)] + [(n, bytearray(M.encode_pgm(M.render(0)))), (n + 1, None), (n + 2, bytearray(b"junk")), (None, None)], "id bigint, media binary")
    queries = spark.createDataFrame([(i, bytearray(M.encode_pgm(M.edit(M.render(i), i)))) for i in range(0, n, 3)] + [(999, None)], "id bigint, media binary")
    got = {(r["query_id"], r["match_id"]) for r in M.find_copies(queries, images, "id", "media").collect()}
    want = {(i, i) for i in range(0, n, 3)} | {(0, n)}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    assert M.find_copies(queries.limit(0), images, "id", "media").count() == 0


def pgm(image):
    return bytearray(M.encode_pgm(np.clip(image, 0, 255)))


def test_media_matches_against_brute_force():
    codes = [M.describe(np.stack([f(M.render(i)) for i in range(40)]))[4] for f in (lambda x: x, lambda x: M.warp(x, 0.5, 1.15))]
    far = np.bitwise_count(codes[1][:, None] ^ codes[0][None]).sum(2)
    want = set(zip(*np.nonzero(far <= M.MAX_DISTANCE), strict=True))
    got = set(zip(*M.Tables(codes[1]).matches(codes[0]), strict=True))
    assert got <= want and len(got) >= 0.9 * len(want) > 100
    rng = np.random.default_rng(0)  # pairs at the very bound
    a = rng.integers(0, 256, (3000, 16)).astype(np.uint8)
    b = a ^ np.packbits(rng.permuted(np.arange(128) < M.MAX_DISTANCE + np.zeros((3000, 1)), axis=1), axis=1)
    q, c = M.Tables(a).matches(b)
    assert (q == c).sum() >= 0.9 * 3000


def test_media_turned_rescaled_noisy_repeated(spark):
    n = 40
    images = spark.createDataFrame([(i, pgm(M.render(i))) for i in range(n)] + [(n + i, pgm(M.render(i))) for i in range(0, n, 4)], "id bigint, media binary")
    edits = {100: lambda x, i: M.warp(x, 0.15 + i), 200: lambda x, i: M.warp(x, scale=0.8), 300: lambda x, i: M.warp(x, scale=1.3), 400: lambda x, i: x + np.random.default_rng(i).normal(0, 12, x.shape)}
    queries = spark.createDataFrame([(k + i, pgm(f(M.render(i), i))) for k, f in edits.items() for i in range(0, n, 4)], "id bigint, media binary")
    got = {(r["query_id"], r["match_id"]) for r in M.find_copies(queries, images, "id", "media").collect()}
    for k in edits:
        want = {(k + i, j) for i in range(0, n, 4) for j in (i, n + i)}
        assert len(got & want) >= 0.9 * len(want), k
    assert all(m % n == q % 100 for q, m in got)


def large(seed, side=360):
    return np.block([[M.render(1000 * seed + 5 * i + j) for j in range(side // 72)] for i in range(side // 72)])


def test_media_small_crops_of_large_images(spark):
    """Crops of a tenth of the area."""
    n = 8
    images = spark.createDataFrame([(i, pgm(large(i))) for i in range(n)], "id bigint, media binary")
    at = np.random.default_rng(4).integers(0, 360 - 114, (n, 2))
    queries = spark.createDataFrame([(i, pgm(large(i)[y : y + 114, x : x + 114])) for i, (y, x) in enumerate(at.tolist())], "id bigint, media binary")
    got = {(r["query_id"], r["match_id"]) for r in M.find_copies(queries, images, "id", "media").collect()}
    assert got == {(i, i) for i in range(n)}


def test_media_crops_cut_anywhere():
    """Crops of a twenty-fifth of the picture at random places: at least nine in ten found, whatever cells or corners lie around them."""
    rng, n = np.random.default_rng(5), 36
    whole = [np.clip(np.rint(M.render(i, 360)), 0, 255) for i in range(n)]
    crops = []
    for x in whole:
        y, z = rng.integers(0, 288, 2)
        crops.append(np.clip(np.rint(x[y : y + 72, z : z + 72] * 0.9 + 10), 0, 255))
    q, c = M.describe(np.stack(crops)), M.describe(np.stack(whole))
    a, b = M.Tables(q[4]).matches(c[4])
    at = [np.column_stack((v[1], v[2], v[3])) for v in (q, c)]
    found = M.decide(q[0][a], c[0][b], at[0][a], at[1][b])
    pairs = set(zip(found[0].tolist(), found[1].tolist(), strict=True))
    assert len(pairs & {(i, i) for i in range(n)}) >= 0.9 * n and all(i == j for i, j in pairs)


def test_media_pairs_of_few_matches_go_first():
    """Images with too few matches go before they are decided, which changes nothing, whatever the size of a step."""
    rng, n = np.random.default_rng(6), 30
    whole = [np.clip(np.rint(M.render(i)), 0, 255) for i in range(n)]
    c, q = (M.describe(np.stack(v)) for v in (whole, [np.clip(np.rint(M.alter(x, 4 * i)), 0, 255) for i, x in enumerate(whole)]))
    at = [np.column_stack((v[1], v[2], v[3])) for v in (q, c)]
    a, b = M.Tables(q[4]).matches(c[4])
    few = rng.permutation(np.flatnonzero(q[0][a] == 3))[:5]
    a, b = np.concatenate((a[q[0][a] != 3], a[few])), np.concatenate((b[q[0][a] != 3], b[few]))
    x, y = M.likely(q[0], c[0], a, b)
    assert 0 < len(x) < len(a) and not (q[0][x] == 3).any()
    want = {}
    for i, j in set(zip(q[0][a].tolist(), c[0][b].tolist(), strict=True)):
        here = (q[0][a] == i) & (c[0][b] == j)
        u, v = at[0][a[here]], at[1][b[here]]
        for s, t in zip(u, v, strict=True):
            turn, zoom = t[2] - s[2], s[3] / t[3]
            co, si = np.cos(turn) * zoom, np.sin(turn) * zoom
            ey, ex = t[0] - si * s[1] - co * s[0] + si * u[:, 1] + co * u[:, 0] - v[:, 0], t[1] - co * s[1] + si * s[0] + co * u[:, 1] - si * u[:, 0] - v[:, 1]
            got = len(np.unique(np.rint(u[ey * ey + ex * ex <= M.SLACK**2, :2] / 2), axis=0))
            if got >= M.LEAST:
                want[i, j] = max(got, want.get((i, j), 0))
    assert len(want) > 20
    for most in (1, 100, 1 << 16):
        for a_, b_ in ((a, b), (x, y)):
            f = M.decide(q[0][a_], c[0][b_], at[0][a_], at[1][b_], most)
            assert dict(zip(zip(f[0].tolist(), f[1].tolist(), strict=True), f[2].tolist(), strict=True)) == want
    none = np.zeros(0, np.int64)
    assert [len(v) for v in M.likely(none, none, none, none)] == [0, 0]


def corners(images):
    """(pose, code) of each image."""
    out = []
    for x in images:
        _, y, z, angle, code = M.describe(np.clip(np.rint(x), 0, 255)[None])
        out.append((np.column_stack((y, z, angle)), code))
    return out


def together(parts):
    """Where each image's corners begin and all end, and their poses and codes."""
    return np.cumsum([0, *(len(c) for _, c in parts)]), np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


def plain(query, image):
    """Most distinct corners that share the proposal of one match, all corners compared."""
    (u, a), (v, b) = query, image
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(2) <= M.MAX_DISTANCE)
    most = 0
    for s, t in zip(u[i], v[j], strict=True):
        turn, zoom = t[2] - s[2], s[3] / t[3]
        co, si = np.cos(turn) * zoom, np.sin(turn) * zoom
        ey, ex = co * (u[i, 0] - s[0]) + si * (u[i, 1] - s[1]) - (v[j, 0] - t[0]), co * (u[i, 1] - s[1]) - si * (u[i, 0] - s[0]) - (v[j, 1] - t[1])
        most = max(most, len(np.unique(np.rint(u[i][ey * ey + ex * ex <= M.SLACK**2, :2] / 2), axis=0)))
    return most


def test_media_searched_pairs_of_images_are_few():
    """Lookups by pairs of corners propose nearly all images that plain comparison finds, and few of the others, whose number grows with queries times images."""
    n = 240
    whole = [M.render(i) for i in range(n)]
    c, q = corners(whole), corners([M.alter(x, i) for i, x in enumerate(whole)])
    (cut, pose, code), (at, pose_q, code_q) = together(c), together(q)
    tables = M.Tables(code_q, pose_q, at)
    mine, yours = tables.pictures(code, pose, cut)
    got, want = set(zip(mine.tolist(), yours.tolist(), strict=True)), {(i, i) for i in range(n) if plain(q[i], c[i]) >= M.LEAST}
    assert len(want) >= 0.95 * n and len(got & want) >= 0.98 * len(want)
    assert len({(i, j) for i, j in got if i != j}) < n * n / 200
    i, j = tables.among(code, cut, mine, yours)
    for a, b in list(got)[:60]:
        here = (tables.picture[i] == a) & (np.searchsorted(cut, j, "right") - 1 == b)
        d = np.bitwise_count(q[a][1][:, None] ^ c[b][1][None]).sum(2)
        assert set(zip(i[here] - at[a], j[here] - cut[b], strict=True)) == set(zip(*np.nonzero(d <= M.MAX_DISTANCE), strict=True))


def test_media_rows_against_plain_comparison(spark):
    """Whole rows with their inliers, of all corners of all pairs of images."""
    n = 24
    whole = [M.render(i) for i in range(n)]
    edits = [M.alter(x, i) for i, x in enumerate(whole)]
    images, queries = (spark.createDataFrame([(i, pgm(x)) for i, x in enumerate(v)], "id bigint, media binary") for v in (whole, edits))
    got = {(r["query_id"], r["match_id"], r["inliers"]) for r in M.find_copies(queries, images, "id", "media").collect()}
    c, q = corners(whole), corners(edits)
    want = {(i, j, m) for i in range(n) for j in range(n) if (m := plain(q[i], c[j])) >= M.LEAST}
    assert got <= want and len(got) >= 0.95 * len(want) > 20


def test_media_neighbours(monkeypatch):
    """The nearest corners of each, in pictures together or in strips, whatever their order; few or none left."""
    rng = np.random.default_rng(8)
    sizes = [0, 1, 2, 5, 700, 40, 0, 33, 90]
    cut = np.cumsum([0, *sizes])
    pose = np.column_stack((rng.uniform(0, 3000, (cut[-1], 2)), rng.uniform(-3, 3, cut[-1]), rng.choice(M.SCALES, cut[-1])))
    pose[cut[5] :, :2] = np.rint(pose[cut[5] :, :2] / 40)  # many as near, or the same spot
    want = set()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        for i in range(a, b):
            dy, dx = (pose[a:b, :2] - pose[i, :2]).T
            far = dy**2 + dx**2
            order = [j for j in np.argsort(far + 1e-6 * (dy + 0.618 * dx + 0.414 * pose[a:b, 3])) if far[j] >= (M.NEAR / pose[i, 3]) ** 2]
            want |= {(i, a + int(j)) for j in order[: M.NEIGHBOURS]}
    for large in (512, 0, 1 << 20):
        monkeypatch.setattr(M, "LARGE", large)
        i, j = M.neighbours(cut, pose)
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert len(M.neighbours(np.array([0]), pose[:0])[0]) == 0


def test_media_runs(monkeypatch):
    monkeypatch.setattr(M, "STEP", 4)
    first, size = np.array([5, 0, 9, 2, 7]), np.array([3, 0, 10, 1, 2])
    got = [(int(k), int(v)) for ks, vs in M._runs(first, size) for k, v in zip(ks, vs, strict=True)]
    assert got == [(k, int(f) + i) for k, (f, n) in enumerate(zip(first, size, strict=True)) for i in range(n)]
    assert list(M._runs(first[:0], size[:0])) == []


def test_media_tables_are_built_once_per_worker(monkeypatch):
    """Tasks that a worker gets one after the other, each with a search unpickled anew."""
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import cloudpickle

    (cut, pose, code), built = together(corners([M.render(1), M.render(2)])), []
    monkeypatch.setattr(M, "Tables", lambda *a, make=M.Tables: built.append(1) or make(*a))
    sent = cloudpickle.dumps(M._search(SimpleNamespace(value=(np.array([1, 2]), cut, pose, code)), "one", True))
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([pose[: cut[1]].tobytes()], pa.binary()), pa.array([code[: cut[1]].tobytes()], pa.binary())], ["id", "image", "pose", "code"])
    for _ in range(3):
        got = [r for b in pickle.loads(sent)(iter([rows])) for r in b.to_pylist() if r["kind"] == 1]
        assert [(r["query"], r["image"]) for r in got] == [(1, 1)]
    assert len(built) == 1


def test_media_blocks_of_queries(spark, monkeypatch):
    images = spark.createDataFrame([(i, pgm(M.render(i))) for i in range(12)], "id bigint, media binary")
    whole = sorted(map(tuple, M.find_copies(images, images, "id", "media").collect()))
    monkeypatch.setattr(M, "BLOCK", 100)
    assert [w[:2] for w in whole] == [(i, i) for i in range(12)]
    assert sorted(map(tuple, M.find_copies(images, images, "id", "media").collect())) == whole


# the pipeline ------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, sf_dir):
    """run() against a plain reading of its stages: fitted models as they are, the rest by brute force."""
    from test_text_ops import brute_components, brute_spans, check_packing
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from tellurion.llm import op5_quality, op6_toxicity, op7_packing
    from tellurion.llm.op10_pii import KINDS

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in op5_quality.score_documents(docs, op5_quality.train(docs, labels)).where("predicted = 1").collect()}
    left = docs.where(docs["doc_id"].isin(list(good)))
    good &= {r["doc_id"] for r in op6_toxicity.score_documents(left, op6_toxicity.train(left, labels)).where("predicted = 0").collect()}
    comp = brute_components({i: texts[i] for i in good}, 5, 80)
    kept = {i for i, (_, c) in comp.items() if c == i}

    def clean(text):
        out, at = "", 0
        for a, k, e in brute_spans(text):
            if a >= at:
                out += text[at:a] + f"[{KINDS[k].upper()}]"
            at = max(at, e)
        return out + text[at:]

    path = op7_packing.tokenizer_file("byte_bpe_50k.json")
    rows = P.run(spark, sf_dir).collect()
    check_packing(rows, {i: clean(texts[i]) for i in kept}, Tokenizer.from_file(path), 1024)


def test_pipeline_on_odd_input(spark):
    from test_text_ops import ODD, docs

    import corpus_pipeline as P

    d = docs(spark, ODD)
    d = d.unionAll(d.limit(3)).unionAll(spark.createDataFrame([(None, "a b", None, None, None)], d.schema))
    kept = P.near_duplicates(spark, d, "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == d.columns and ids.count(None) == 1 and len(ids) == len(set(ids))
    assert 5 not in ids and {0, 1, 2, 3, 4} <= set(ids)
    red = P.personal_data(spark, kept, "")
    assert red.columns == d.columns and red.count() == kept.count()
    assert P.near_duplicates(spark, d.limit(0), "").count() == 0


def test_near_duplicates_with_repeated_ids_and_clashes(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (5, "quite another text of some words", 2), (None, text + " end", 3), (4, "Start " + text, 4), (5, text, 1), (None, "alone with no id at all", 6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    got = P.near_duplicates(spark, d, "")
    assert got.columns == d.columns
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in got.collect()) == [(0, 6), (4, 4), (5, 2)]
    with pytest.raises(ValueError):
        P.near_duplicates(spark, d.withColumnRenamed("n_shingles", "__Row"), "")
