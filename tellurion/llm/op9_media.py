"""Media columns: local descriptors find cropped or edited copies of images.

An image's pyramid is searched for corners (Harris, each the strongest of its surroundings, all of them kept); they get an orientation (direction
of the patch's centre of mass) and 128 binary tests of smoothed grey values, turned by it. Single descriptors tell little: of
chance pairs of corners 1 in 150 match, so nearly every two images share some and their number grows with queries times images.
So pairs of images are looked up by pairs of neighbouring corners: tables are keyed by some bits of both descriptors and by how
one corner lies to the other (see Tables); a pair of images goes on if in one place both corners match and agree on a turn, scale and
shift. Of those all corners are compared, none is left out. Geometric consensus decides: each match (MAX_DISTANCE bits at most)
proposes a turn, scale and shift, and the best proposal must be shared by LEAST matches. Images of equal bytes are one class
(by a 64-bit hash), matched once per run of rows. The corners of a bounded block of queries go to all executors, where each
image is looked up, matched and decided at once: only pairs of images found leave the scan. More than BLOCK query corners
take one more pass over the images' corners per block.

Reads binary PGM (P5), PPM (P6) and PNG (8 bits, grey, RGB or RGBA, not interlaced). Null, empty or
unreadable images have no descriptors and match nothing, nor do rows without an id. Very large images are described whole. Repeated rows are
all reported; neighbouring corners of equal strength are both kept. Empty tables give empty results. Only the id and media columns are read, so others
cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship_package

#: A corner is the strongest of all pixels within SPREAD of it each way, at its own scale: so a crop has the corners of the whole, wherever it is cut.
SPREAD, SCALES = 5, (1.0, 0.8, 0.64, 0.5)
#: Of random pairs of corners about 1 in 150 are within 26 bits, of a turned or rescaled picture's own corners about half.
MAX_DISTANCE, LEAST, SLACK, RADIUS, TURNS = 26, 7, 3.0, 7, 128
#: Images described at a time: few, to stay in the processor's cache.
IMAGES = 48
#: Query corners searched for at a time, and pairs of corners looked at at a time; corners of a picture that is gone through in strips, so many at a time.
BLOCK, STEP, LARGE, ROWS = 1 << 19, 1 << 16, 512, 32
#: Tables of pairs of corners, and bits of each corner's code in their keys.
TABLES, WIDTH = 6, 8
#: A corner is paired with its nearest neighbours; nearer ones than NEAR pixels of its scale are the same spot at another scale.
NEIGHBOURS, NEAR = 8, 6.0
#: In keys, directions and turns are told apart by so many parts of a circle, distances by this part of their logarithm. Of true pairs nine in ten differ by
#: less than half of that.
PARTS, RATIO = 32, 0.25


#: Offsets (plus RADIUS) y0 x0 y1 x1 of the binary tests, one hexadecimal digit each: picked greedily from 4000 random pairs so that
#: over corners of 250 drawn and 250 random textures each outcome is even (0.3 to 0.7) and no two correlate above 0.54.
_PICKED = (
    "45a567a70737e70793649727569637b728c8b717c747cb49d9194dacb7e7b93969bb4a7953846a6d8184a81907578d8a6461a143619323a5a375d9a8a6155b9b"
    "437536d56a9d56c570437e5ba6d414c4ca2b4d895541552332c3582a8370aa5dad6c834199ac1a49a295d8489a3a3c6a618581a44b7c4d7c84b272a2493c4a6d"
    "37d6797c25c616d4bb8de79807c89d49a728a97e72658bbc8546488957d958a95582c371e7384473c45461349124b7264998b526a473ac1a64346aa95788a6d7"
    "c889c541865707a8c685aadaa7364d1a3542acb97a2ad9171447e7462336a83bb24617a6144428a937a8cbb894c4da6ac715d57837a6b7468691495c23d6ca9c"
)


def tests() -> np.ndarray:
    """(128, 4) pixel offsets y0 x0 y1 x1 of the binary tests."""
    return np.array([int(c, 16) for c in _PICKED], float).reshape(128, 4) - RADIUS


def _turned() -> tuple[np.ndarray, np.ndarray]:
    """(y, x) offsets of both ends of each test at each of TURNS angles: (TURNS, 2, 128)."""
    at, t = tests(), np.arange(TURNS) * (2 * np.pi / TURNS)
    dy, dx = np.stack((at[:, 0], at[:, 2])), np.stack((at[:, 1], at[:, 3]))
    co, si = np.cos(t)[:, None, None], np.sin(t)[:, None, None]
    return np.rint(si * dx + co * dy).astype(np.int32), np.rint(co * dx - si * dy).astype(np.int32)


_TURNED = _turned()


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    channels = {0: 1, 2: 3, 6: 4}.get(head[3]) if head else None
    if not channels or head[2] != 8 or head[6]:
        return None
    w, h = head[:2]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w * channels), np.int64)
    for y in range(h):
        line, up, f = rows[y, 1:].astype(np.int64), out[y], rows[y, 0]
        if f == 0:
            got = line
        elif f == 2:
            got = (line + up) & 255
        else:
            got = line.copy()
            for x in range(len(line)):
                a = got[x - channels] if x >= channels else 0
                b, c = up[x], up[x - channels] if x >= channels else 0
                if f == 1:
                    add = a
                elif f == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    add = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                got[x] = (got[x] + add) & 255
        out[y + 1] = got
    return out[1:].reshape(h, w, channels)[:, :, :3].mean(2) if channels > 1 else out[1:].astype(float)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of an image, or None."""
    try:
        if not raw:
            return None
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        kind, w, h, top, body = raw.split(maxsplit=4) if raw[:2] in (b"P5", b"P6") else (b"", 0, 0, 0, b"")
        if kind not in (b"P5", b"P6") or int(top) > 255:
            return None
        n = 1 if kind == b"P5" else 3
        body = raw[len(raw) - int(w) * int(h) * n :]
        grey = np.frombuffer(body, np.uint8).reshape(int(h), int(w), n)
        return grey[:, :, 0].astype(float) if n == 1 else grey.mean(2)
    except (ValueError, zlib.error, struct.error, TypeError):
        return None


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def _blur(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing over five pixels each way, edges repeated."""
    for axis in (1, 2):
        wide = [(0, 0)] * 3
        wide[axis] = (2, 2)
        p, n = np.pad(x, wide, mode="edge"), x.shape[axis]
        cut = [slice(None)] * 3

        def at(i, p=p, n=n, cut=cut, axis=axis):
            return p[tuple([*cut[:axis], slice(i, i + n), *cut[axis + 1 :]])]

        x, more = at(0) + at(4), at(1) + at(3)
        more *= 4
        x += more
        x += np.multiply(at(2), 6, out=more)
        x *= np.float32(1 / 16)
    return x


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, int(x.shape[1] * scale)), max(1, int(x.shape[2] * scale))
    y, z = np.arange(h) / scale, np.arange(w) / scale
    y0, z0 = np.minimum(y.astype(int), x.shape[1] - 1), np.minimum(z.astype(int), x.shape[2] - 1)
    y1, z1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(z0 + 1, x.shape[2] - 1)
    fy, fz = (y - y0)[:, None], (z - z0)[None, :]
    upper, lower = x.take(y0, axis=1), x.take(y1, axis=1)
    top = upper.take(z0, axis=2) * (1 - fz) + upper.take(z1, axis=2) * fz
    low = lower.take(z0, axis=2) * (1 - fz) + lower.take(z1, axis=2) * fz
    return top * (1 - fy) + low * fy


def _highest(r: np.ndarray) -> np.ndarray:
    """Whether a value is the highest of the square that reaches SPREAD pixels each way."""
    top = r
    for axis in (1, 2):
        wide = [(0, 0)] * 3
        wide[axis] = (SPREAD, SPREAD)
        p = np.pad(top, wide, constant_values=-np.inf)

        def cut(v, i, n, axis=axis):
            return v[:, i : i + n] if axis == 1 else v[:, :, i : i + n]

        reach, size = 1, p.shape[axis]  # the highest of as many from each on, doubled while that is within the square
        while reach < 2 * SPREAD + 1:
            more = min(reach, 2 * SPREAD + 1 - reach)
            size -= more
            p, reach = np.maximum(cut(p, 0, size), cut(p, more, size)), reach + more
        top = p
    return r >= top


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x, angle with scale, 16 descriptor bytes) of the corners of equally large images."""
    found, levels = [], []
    rim = RADIUS + 3
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = (yy**2 + xx**2 <= RADIUS**2).ravel()
    yy, xx = yy.ravel()[disc], xx.ravel()[disc]
    smooth = _blur(images.astype(np.float32))
    for scale in SCALES:
        x = smooth if scale == 1 else _blur(_resize(smooth, scale).astype(np.float32))
        if min(x.shape[1:]) <= 2 * rim + 2:
            continue
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _blur(gy * gy), _blur(gx * gx), _blur(gy * gx)
        r = a * b
        r -= c * c
        a += b
        r -= np.float32(0.05) * a * a
        peak = (_highest(r) & (r > 1.0))[:, rim:-rim, rim:-rim]
        img, y, z = np.nonzero(peak)
        found.append([img, y + rim, z + rim, np.full(len(img), len(levels))])
        levels.append((scale, x))
    if not found:
        return np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros((0, 2)), np.zeros((0, 16), np.uint8)
    img, y, z, level = (np.concatenate([f[i] for f in found]) for i in range(4))
    scale = np.array([v[0] for v in levels])[level]
    angle, code = np.zeros(len(img)), np.zeros((len(img), 16), np.uint8)
    for k, (_, x) in enumerate(levels):
        on = np.flatnonzero(level == k)
        flat, width = x.ravel(), x.shape[2]
        here = ((img[on] * x.shape[1] + y[on]) * width + z[on])[:, None]
        patch = flat[here + (yy * width + xx)]
        angle[on] = np.arctan2(patch @ yy.astype(np.float32), patch @ xx.astype(np.float32))
        turn = np.rint(angle[on] * (TURNS / (2 * np.pi))).astype(int) % TURNS
        places = (_TURNED[0] * width + _TURNED[1])[turn]
        code[on] = np.packbits(flat[here + places[:, 0]] < flat[here + places[:, 1]], axis=1)
    return img, y / scale, z / scale, np.stack((angle, scale), 1), code


def _words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each code as numbers."""
    both = np.ascontiguousarray(code).view(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted numbers, each once."""
    x = np.sort(x)
    return x[np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))]


def _numbers(x: np.ndarray) -> np.ndarray:
    """The place of each number among the distinct ones; those in order already aren't sorted."""
    if (x[1:] >= x[:-1]).all():
        return np.cumsum(np.concatenate((np.zeros(min(len(x), 1), bool), x[1:] != x[:-1])))
    return np.unique(x, return_inverse=True)[1]


def _runs(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of numbers, STEP at a time or one run: the number of the run, and first, first + 1, ... of each."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + STEP, "right")))
        n = size[a:b]
        yield np.repeat(np.arange(a, b), n), np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a = b


def _nearest(here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of there (y, x, scale; pictures by corners, none: nan) are the NEIGHBOURS nearest to each of here, and how far the last of them is, squared."""
    (y, x, scale), (y2, x2, scale2) = here[:, :, :, None], there[:, :, None, :]
    dy, dx = y2 - y, x2 - x
    far = dy * dy + dx * dx
    out = ~(far >= (NEAR / scale) ** 2)
    far += 1e-6 * (dy + 0.618 * dx + 0.414 * scale2)  # of equally near ones always the same
    far[out] = np.inf
    k = min(NEIGHBOURS, far.shape[2]) - 1
    last = np.partition(far, k, axis=2)[:, :, k]
    return far <= np.minimum(last, np.finfo(float).max)[:, :, None], last


def neighbours(cut: np.ndarray, pose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corner, neighbour): the NEIGHBOURS nearest corners of the same picture, whose rows are those from cut[k] to cut[k + 1]; nearer ones than NEAR are left out."""
    n, at, found = np.diff(cut), np.ascontiguousarray(pose[:, [0, 1, 3]].T), [np.zeros((2, 0), np.int64)]
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 1]
    while len(order) and n[order[0]] <= LARGE:  # pictures of about as many corners together
        some = order[: max(1, min(STEP // int(n[order[0]]) ** 2, int(np.searchsorted(n[order], LARGE, "right"))))]
        most = int(n[some].max())
        if len(some) * most**2 > 2 * STEP:
            some = some[: max(1, 2 * STEP // most**2)]
            most = int(n[some].max())
        order = order[len(some) :]
        row = np.minimum(cut[some][:, None] + np.arange(most), len(pose) - 1)
        here = np.where(np.arange(most) < n[some][:, None], at[:, row], np.nan)
        k, i, j = np.nonzero(_nearest(here, here)[0])
        found.append(np.stack((row[k, i], row[k, j])))
    for p in order.tolist():
        row = cut[p] + np.argsort(at[0, cut[p] : cut[p + 1]], kind="stable")
        mine = at[:, None, row]
        y = mine[0, 0]
        for a in range(0, len(row), ROWS):
            b, reach = min(a + ROWS, len(row)), 32.0
            while True:  # a strip of the picture, wider until no nearer one can lie outside
                lo, hi = np.searchsorted(y, y[a] - reach), np.searchsorted(y, y[b - 1] + reach, "right")
                near, last = _nearest(mine[:, :, a:b], mine[:, :, lo:hi])
                if hi - lo == len(row) or (hi - lo >= NEIGHBOURS and last.max() < (reach - 1) ** 2):
                    break
                reach *= 2
            _, i, j = np.nonzero(near)
            found.append(np.stack((row[i + a], row[j + lo])))
    i, j = np.concatenate(found, 1)
    return i, j


def _agree(q: np.ndarray, c: np.ndarray, q2: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Whether the turn, scale and shift that the match of q and c proposes brings q2 to c2."""
    turn, zoom = c[:, 2] - q[:, 2], q[:, 3] / c[:, 3]
    co, si = np.cos(turn) * zoom, np.sin(turn) * zoom
    (y, x), (there_y, there_x) = (q2 - q)[:, :2].T, (c2 - c)[:, :2].T
    return (co * y + si * x - there_y) ** 2 + (co * x - si * y - there_x) ** 2 <= SLACK**2


def _chosen() -> tuple[np.ndarray, np.ndarray]:
    """Each table's bits of a corner and of its neighbour as weights, (128, 2 * TABLES), and where its parts of circles and of distances begin, (TABLES, 3)."""
    rng, weights = np.random.default_rng(23), np.zeros((128, 2 * TABLES), np.float32)
    for t in range(2 * TABLES):
        weights[rng.permutation(128)[:WIDTH], t] = 2.0 ** np.arange(WIDTH)
    return weights, rng.random((TABLES, 3))


class Tables:
    """Query corners; with their poses and pictures (the rows from cut[k] to cut[k + 1]) also tables of their pairs of neighbours.

    A key holds WIDTH bits of each code, the neighbour's distance and direction as seen from the corner, in its scale and from its angle, and the difference
    of both angles: no crop, turn or scale changes them but by the error of corners. Two pictures that share LEAST corners have many such pairs, of which one
    must meet in one of the tables.
    """

    def __init__(self, code: np.ndarray, pose: np.ndarray | None = None, cut: np.ndarray | None = None):
        self.words = _words(code)
        if pose is None or cut is None:
            return
        self.pose, self.cut, self.picture = pose, cut, np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        self.weights, self.begin = _chosen()
        i, j = neighbours(cut, pose)
        self.bits = int(np.ceil(np.log2(max(len(i), 1)))) + 1
        self.i, self.j, self.tables = i.astype(np.int32), j.astype(np.int32), []
        for key in self.keys(code, pose, i, j):
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.tables.append((np.concatenate(([0], np.cumsum(np.bincount(key, minlength=1 << self.bits)))).astype(np.int32), order))

    def keys(self, code: np.ndarray, pose: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the keys of pairs of corners, hashed to its places."""
        mine = (np.unpackbits(code, axis=1).astype(np.float32) @ self.weights).astype(np.int64)
        (y, x), angle = (pose[j] - pose[i])[:, :2].T, pose[:, 2]
        far = np.log(np.hypot(y, x) * pose[i, 3]) / RATIO
        way, turn = ((v * (PARTS / (2 * np.pi))) for v in (np.arctan2(y, x) - angle[i], angle[j] - angle[i]))
        for t, (a, b, c) in enumerate(self.begin):
            key = np.floor(far + a).astype(np.int64) * PARTS + np.floor(way + b).astype(np.int64) % PARTS
            key = key * PARTS + np.floor(turn + c).astype(np.int64) % PARTS
            key = ((key << WIDTH) + mine[:, 2 * t].take(i) << WIDTH) + mine[:, 2 * t + 1].take(j)
            yield (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pictures(self, code: np.ndarray, pose: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's picture, picture) where a corner and its neighbour both match and agree."""
        i, j = neighbours(cut, pose)
        picture, words, n = np.repeat(np.arange(len(cut) - 1), np.diff(cut)), _words(code), len(cut)
        found = np.zeros(0, np.int64)
        for (start, order), key in zip(self.tables, self.keys(code, pose, i, j), strict=True):
            first = start.take(key)
            for k, place in _runs(first.astype(np.int64), start.take(key + 1) - first):
                pair = order.take(place)
                q, c = self.i.take(pair), i.take(k)
                near = np.flatnonzero(self.distance(q, words, c) <= MAX_DISTANCE)
                q, c, pair, k = q.take(near), c.take(near), pair.take(near), k.take(near)
                q2, c2 = self.j.take(pair), j.take(k)
                near = np.flatnonzero(self.distance(q2, words, c2) <= MAX_DISTANCE)
                q, c, q2, c2 = (v.take(near) for v in (q, c, q2, c2))
                near = _agree(self.pose[q], pose[c], self.pose[q2], pose[c2])
                found = _distinct(np.concatenate((found, self.picture[q[near]] * n + picture[c[near]])))
        return found // n, found % n

    def distance(self, q: np.ndarray, words: tuple[np.ndarray, np.ndarray], c: np.ndarray) -> np.ndarray:
        """Bits by which query corners q and corners c differ."""
        far = np.bitwise_count(self.words[0].take(q) ^ words[0].take(c))
        far += np.bitwise_count(self.words[1].take(q) ^ words[1].take(c))
        return far

    def matches(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, row of code) of all pairs of MAX_DISTANCE bits at most."""
        n = min(len(code), 1) * len(self.words[0])
        return self.compared(code, np.arange(n), np.array([0, n]), np.array([0]), np.array([len(code)]))

    def among(self, code: np.ndarray, cut: np.ndarray, mine: np.ndarray, yours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches between all corners of the queries' pictures mine[k] and the pictures yours[k]."""
        order = np.argsort(yours, kind="stable")
        mine, yours = mine[order], yours[order]
        size = self.cut[mine + 1] - self.cut[mine]
        rows = np.concatenate([np.zeros(0, np.int64), *(place for _, place in _runs(self.cut[mine], size))])
        new = np.flatnonzero(np.diff(yours, prepend=-1))
        return self.compared(code, rows, np.concatenate(([0], np.cumsum(size)))[[*new, len(mine)]], cut[yours[new]], cut[yours[new] + 1])

    def compared(self, code: np.ndarray, rows: np.ndarray, part: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches of query rows part[k] to part[k + 1] of rows with the rows from start[k] to end[k] of code, for each k."""
        (left, right), (first, second), found = _words(code), (w.take(rows)[:, None] for w in self.words), [np.zeros((2, 0), np.int64)]
        for a, b, lo, hi in zip(part[:-1].tolist(), part[1:].tolist(), start.tolist(), end.tolist(), strict=True):
            step, here, there = max(1, STEP // max(hi - lo, 1)), left[lo:hi], right[lo:hi]
            for k in range(a, b, step):
                e = min(k + step, b)
                far = np.bitwise_count(first[k:e] ^ here)
                far += np.bitwise_count(second[k:e] ^ there)
                near = np.flatnonzero(far <= MAX_DISTANCE)
                found.append(np.stack((rows.take(near // (hi - lo) + k), near % (hi - lo) + lo)))
        q, c = np.concatenate(found, 1)
        return q, c


_FEATURES = "id bigint, image bigint, pose binary, code binary"
_FOUND = "kind int, id bigint, image bigint, query bigint, inliers bigint"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id and class (a hash of its bytes); once per class and run of rows, its corners: y, x, angle, scale as doubles and the codes."""
    done: set[int] = set()
    for whole in batches:
        for a in range(0, whole.num_rows, IMAGES):
            b = whole.slice(a, IMAGES)
            names, by_shape = [], {}
            pose, code = [None] * b.num_rows, [None] * b.num_rows
            for k, raw in enumerate(b.column(1)):
                raw = raw.as_py()
                names.append(None if raw is None else int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                if raw is None or names[-1] in done:
                    continue
                if len(done) >= 1 << 18:
                    done.clear()
                done.add(names[-1])
                x = decode(raw)
                if x is not None and x.size:
                    by_shape.setdefault(x.shape, []).append((k, x))
            for group in by_shape.values():
                img, *parts = describe(np.stack([g[1] for g in group]).astype(float))
                rows = np.column_stack((*parts[:2], parts[2]))
                order = np.argsort(img, kind="stable")
                cut = np.searchsorted(img[order], np.arange(len(group) + 1))
                for (k, _), lo, hi in zip(group, cut[:-1], cut[1:], strict=True):
                    if hi > lo:
                        pose[k], code[k] = rows[order[lo:hi]].tobytes(), parts[3][order[lo:hi]].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.int64()), pa.array(pose, pa.binary()), pa.array(code, pa.binary())], ["id", "image", "pose", "code"])


def _unpacked(image: pa.Array, pose: pa.Array, code: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The images that have corners, where each one's corners begin and all end, and (pose, code) by corner."""
    image, pose, code = (c.filter(code.is_valid()) for c in (image, pose, code))
    poses = np.frombuffer(b"".join(pose.to_pylist()), np.float64).reshape(-1, 4)
    codes = [np.frombuffer(c, np.uint8) for c in code.to_pylist()]
    cut = np.cumsum([0, *(len(c) // 16 for c in codes)])
    return image.to_numpy(), cut, poses, np.concatenate([np.zeros(0, np.uint8), *codes]).reshape(-1, 16)


_LOADED: dict = {}


def _loaded(name: str, shared) -> tuple[np.ndarray, Tables]:
    """The queries' images and tables, built once per worker. (Named by the module: what an inner function refers to is sent as a copy with each task.)"""
    if name not in _LOADED:
        _LOADED.clear()
        query, cut, pose, code = shared.value
        _LOADED[name] = query, Tables(code, pose, cut)
    return _LOADED[name]


def _search(shared, name: str, described: bool):
    """Matches of a block of queries. Kind 0: each image's id and class. Kind 1: (query, image, inliers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, tables = _loaded(name, shared)
        for whole in batches if described else _features(batches):
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                n, none = b.num_rows, pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), b.column(0), b.column(1), none, none], ["kind", "id", "image", "query", "inliers"])
                image, cut, pose, code = _unpacked(*b.columns[1:])
                picture = np.repeat(np.arange(len(image)), np.diff(cut))
                q, c = likely(tables.picture, picture, *tables.among(code, cut, *tables.pictures(code, pose, cut)))
                found = decide(tables.picture[q], picture[c], tables.pose[q], pose[c])
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(image[found[1]]), pa.array(query[found[0]]), pa.array(found[2])], ["kind", "id", "image", "query", "inliers"])

    return work


def likely(query: np.ndarray, image: np.ndarray, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches (rows of corners) of pairs of images that have LEAST matches at least: fewer can't agree on a proposal."""
    at_q, at_c = _numbers(query.take(q)), _numbers(image.take(c))
    pair = at_q * (int(at_c.max(initial=0)) + 1) + at_c
    many = np.flatnonzero((np.bincount(pair) >= LEAST).take(pair))
    return q.take(many), c.take(many)


def decide(query: np.ndarray, image: np.ndarray, q: np.ndarray, c: np.ndarray, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, image, inliers) of the pairs of images of whose matches LEAST share one proposal of turn, scale and shift; rows of q and c are y, x, angle, scale."""
    y, x = np.rint(q[:, :2] / 2).astype(np.int64).T
    y, x = y - y.min(initial=0), x - x.min(initial=0)
    spot, spots = y * (int(x.max(initial=0)) + 1) + x, (int(y.max(initial=0)) + 1) * (int(x.max(initial=0)) + 1)  # one corner at two scales counts once
    if len(query):  # most pairs of images share too few corners by chance: those go before any proposal is tried
        at_q, at_c = _numbers(query), _numbers(image)
        pair = at_q * (int(at_c.max()) + 1) + at_c
        corners = np.bincount(_distinct(pair * spots + spot) // spots, minlength=int(pair.max()) + 1)
        many = np.flatnonzero((corners >= LEAST)[pair])
        query, image, q, c, spot = query[many], image[many], q[many], c[many], spot[many]
    order = np.lexsort((image, query))
    query, image, q, c, spot = query[order], image[order], q[order], c[order], spot[order]
    cut = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (image[1:] != image[:-1]), [True]))) if len(query) else np.zeros(1, np.int64)
    first, size = cut[:-1][np.diff(cut) >= LEAST], np.diff(cut)[np.diff(cut) >= LEAST]
    best = np.zeros(len(first), np.int64)
    turn, zoom = c[:, 2] - q[:, 2], q[:, 3] / c[:, 3]
    co, si = np.cos(turn) * zoom, np.sin(turn) * zoom
    (qy, qx), (cy, cx) = (np.ascontiguousarray(v[:, :2].T) for v in (q, c))
    to_y, to_x = cy - si * qx - co * qy, cx - co * qx + si * qy  # a proposal's shift
    for n in np.unique(size).tolist():  # pairs of images of as many matches together, each proposal against each match of its pair
        alike, rows = np.flatnonzero(size == n), min(n, max(1, most // n))
        pairs = max(1, most // (n * n))
        for a in range(0, len(alike), pairs):
            g = alike[a : a + pairs]
            m = first[g][:, None] + np.arange(n)
            y, x, there_y, there_x = (v[m][:, None, :] for v in (qy, qx, cy, cx))
            for k in range(0, n, rows):
                s, t, off_y, off_x = (v[m[:, k : k + rows]][:, :, None] for v in (si, co, to_y, to_x))
                ey, ex = off_y + s * x + t * y - there_y, off_x + t * x - s * y - there_x
                near = ey * ey + ex * ex <= SLACK**2
                of, at = np.nonzero(np.count_nonzero(near, axis=2) >= LEAST)
                owner, on = np.nonzero(near[of, at])
                count = np.bincount(_distinct(owner * spots + spot[m[of[owner], on]]) // spots, minlength=len(of))
                np.maximum.at(best, g[of], count)
    hit = best >= LEAST
    return query[first[hit]], image[first[hit]], best[hit]


def find_copies(queries: DataFrame, images: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(query_id, match_id, inliers): for each query image all images that it is a crop or edit of, or the reverse."""
    spark = images.sparkSession
    ship_package(spark)

    def source(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).where("id is not null and media is not null")

    left = materialise(source(queries).mapInArrow(_features, _FEATURES))
    corners = left.where("code is not null").dropDuplicates(["image"])
    blocks = -(-(corners.agg(F.sum(F.length("code"))).first()[0] or 0) // (16 * BLOCK))
    right = source(images) if blocks <= 1 else materialise(source(images).mapInArrow(_features, _FEATURES))
    parts = []
    for k in range(max(blocks, 1)):
        mine = corners.where(F.pmod(F.xxhash64("image"), F.lit(max(blocks, 1))) == k).orderBy("image").toArrow().combine_chunks()  # about BLOCK corners
        rows = [mine.column(n).combine_chunks() if mine.num_rows else pa.array([], t) for n, t in (("image", pa.int64()), ("pose", pa.binary()), ("code", pa.binary()))]
        shared = spark.sparkContext.broadcast(_unpacked(*rows))
        parts.append(materialise(right.mapInArrow(_search(shared, uuid.uuid4().hex, blocks > 1), _FOUND).where("kind = 1" if k else "true")))
        shared.unpersist()
    found = reduce(DataFrame.unionAll, [p.where("kind = 1") for p in parts]).groupBy("query", "image").agg(F.max("inliers").alias("inliers"))
    members = parts[0].where("kind = 0").select(F.col("id").alias("match_id"), "image")
    out = found.join(left.select(F.col("id").alias("query_id"), F.col("image").alias("query")), "query").join(members, "image")
    return out.select("query_id", "match_id", "inliers")


def render(seed: int, side: int = 72) -> np.ndarray:
    """A picture drawn from a seed: boxes of many greys under a coarse grain."""
    rng = np.random.default_rng(seed)
    out = np.full((side, side), float(rng.integers(60, 200)))
    places, sizes, greys = [rng.integers(0, side, 34).tolist() for _ in range(2)], [rng.integers(6, 26, 34).tolist() for _ in range(2)], rng.integers(0, 256, 34).tolist()
    for y, x, h, w, v in zip(*places, *sizes, greys, strict=True):
        out[y : y + h, x : x + w] = v
    return out + rng.normal(0, 22, (side // 4, side // 4)).repeat(4, axis=0).repeat(4, axis=1)


def edit(image: np.ndarray, seed: int) -> np.ndarray:
    """A crop with changed brightness and contrast."""
    rng = np.random.default_rng(seed)
    y, x = rng.integers(0, 11, 2)
    return np.clip(image[y : y + 60, x : x + 60] * rng.uniform(0.8, 1.0) + rng.uniform(0, 20), 0, 255)


def warp(image: np.ndarray, turn: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """The image turned about its middle (radians; grey corners) and rescaled."""
    h, w = image.shape
    y, x = np.mgrid[: round(h * scale), : round(w * scale)].astype(float)
    y, x = y - y.max() / 2, x - x.max() / 2
    co, si = np.cos(turn), np.sin(turn)
    sy, sx = (y * co - x * si) / scale + (h - 1) / 2, (y * si + x * co) / scale + (w - 1) / 2
    y0, x0 = np.clip(np.floor(sy).astype(int), 0, h - 2), np.clip(np.floor(sx).astype(int), 0, w - 2)
    fy, fx = sy - y0, sx - x0
    out = (1 - fy) * ((1 - fx) * image[y0, x0] + fx * image[y0, x0 + 1]) + fy * ((1 - fx) * image[y0 + 1, x0] + fx * image[y0 + 1, x0 + 1])
    return np.where((sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1), out, 128)


def alter(image: np.ndarray, seed: int) -> np.ndarray:
    """By the seed: a crop, a turned, a rescaled or a noisy picture, each with changed brightness and contrast."""
    rng = np.random.default_rng(seed + 1)
    kind = seed % 4
    if kind == 0:
        return edit(image, seed)
    if kind == 1:
        image = warp(image, rng.uniform(-np.pi, np.pi))
    elif kind == 2:
        image = warp(image, scale=rng.uniform(0.8, 1.3))
    else:
        image = image + rng.normal(0, 8, image.shape)
    return np.clip(image * rng.uniform(0.8, 1.0) + rng.uniform(0, 20), 0, 255)


def _renderer(edited: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                out = []
                for seed in b.column(1).to_pylist():
                    x = None if seed is None else render(seed)
                    out.append(None if x is None else encode_pgm(alter(x, seed) if edited else x))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["page_id", "media"])

    return work


def pictures(pages: DataFrame, edited: bool = False) -> DataFrame:
    """(page_id, media): the tables hold no images, so each page gets one drawn from its id and content."""
    ship_package(pages.sparkSession)
    seed = F.when(F.col("page_id").isNotNull(), F.crc32(F.concat_ws("|", "page_id", F.crc32(F.coalesce("url", F.lit("")).cast("binary"))).cast("binary")))
    return pages.select("page_id", seed.alias("seed")).mapInArrow(_renderer(edited), "page_id bigint, media binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, turned, rescaled and noisy forms of every 100th page's picture, searched among all pages' pictures and repeats of every 100th under ids below 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    some = pages.where(F.col("page_id") % 100 == 0)
    images = pictures(pages).unionAll(pictures(some).withColumn("page_id", -F.col("page_id") - 1))
    return find_copies(pictures(some, edited=True), images, "page_id", "media")
