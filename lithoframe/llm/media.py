"""Copies among images by local descriptors: multiscale corners, binary tests, Hamming tables, geometric consensus.

A corner is a local maximum of the Harris response at one of several scales.
The patch around it is turned to its intensity centroid, and 128 comparisons of
smoothed intensities make its descriptor. A corner and a near one of its level
meet another such pair in a Hamming table if one of four parts of both
descriptors is the same; then both are compared in full, with their direction
and distance. Pairs of images need several corners that agree on one turn, scale
and shift. Links make components.

Two corners in one key tell more than one, so keys of one width serve tables of
any size. An image that is cropped, turned, rescaled a little, brightened or
drawn over keeps enough of its corners.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import lean, sliced, written
from lithoframe.llm.components import components

SCALES = (1.0, 1.2, 1.44, 1.73, 2.07)
PATCH, BITS = 9, 128
TABLES, PART, MATES, CELL = 4, 32, 2, 6
PLACE = ["x", "y", "scale", "angle", "d0", "d1"]
_rng = np.random.default_rng(7)
TESTS = np.clip(_rng.normal(0, PATCH / 2.2, (BITS, 2, 2)), -PATCH + 1, PATCH - 1)
_grid = np.arange(-PATCH, PATCH + 1)
_DISC = np.argwhere(_grid[:, None] ** 2 + _grid[None, :] ** 2 <= PATCH**2) - PATCH


def encode_pgm(gray: np.ndarray) -> bytes:
    return f"P5 {gray.shape[1]} {gray.shape[0]} 255\n".encode() + gray.astype(np.uint8).tobytes()


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM or an 8-bit PNG without interlacing; None for anything else."""
    try:
        if data[:2] in (b"P5", b"P6"):
            parts, at = [], 2
            while len(parts) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                parts.append(int(data[at:end]))
                at = end
            w, h, top = parts
            depth = 3 if data[:2] == b"P6" else 1
            raw = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
            return raw.mean(axis=2) * (255 / top)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body = 8, []
            while at < len(data):
                size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
                if kind == b"IHDR":
                    w, h = int.from_bytes(data[at + 8 : at + 12], "big"), int.from_bytes(data[at + 12 : at + 16], "big")
                    bits, colour, _, _, laced = data[at + 16 : at + 21]
                elif kind == b"IDAT":
                    body.append(data[at + 8 : at + 8 + size])
                at += size + 12
            depth = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            if bits != 8 or laced:
                return None
            rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * depth)
            out = np.zeros((h + 1, w + 1, depth), np.int64)
            for y in range(h):
                line, kind = rows[y, 1:].reshape(w, depth), int(rows[y, 0])
                if kind == 1:
                    out[y + 1, 1:] = line.cumsum(axis=0) & 255
                    continue
                if kind in (0, 2):
                    out[y + 1, 1:] = (line + (out[y, 1:] if kind else 0)) & 255
                    continue
                for x in range(w):
                    a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                    if kind == 4:
                        p = a + b - c
                        pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        add = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                    else:
                        add = (a + b) // 2
                    out[y + 1, x + 1] = (line[x] + add) & 255
            return out[1:, 1:, : 3 if depth > 2 else 1].mean(axis=2)
    except (ValueError, KeyError, IndexError, TypeError, zlib.error):
        pass
    return None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)² with edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=0).cumsum(axis=1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def _smaller(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    a = _box(a, 1)
    ys, xs = (np.arange(int(n / scale)) * scale for n in a.shape)
    y, x = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y + 1, a.shape[0] - 1), np.minimum(x + 1, a.shape[1] - 1)
    fy, fx = (ys - y)[:, None], (xs - x)[None, :]
    return (a[y][:, x] * (1 - fx) + a[y][:, x1] * fx) * (1 - fy) + (a[y1][:, x] * (1 - fx) + a[y1][:, x1] * fx) * fy


def _peaks(a: np.ndarray, apart: int) -> np.ndarray:
    """The largest value within ``apart`` of each place, rows and columns in turn; what lies outside counts as nothing."""
    for axis in (0, 1):
        wide = np.pad(a, [(apart, apart) if i == axis else (0, 0) for i in (0, 1)], constant_values=-np.inf)
        a = np.lib.stride_tricks.sliding_window_view(wide, 2 * apart + 1, axis=axis).max(axis=-1)
    return a


def _sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels, linear in both directions."""
    h, w = a.shape
    y, x = np.clip(y, 0, h - 1.001), np.clip(x, 0, w - 1.001)
    i, j = y.astype(np.int64), x.astype(np.int64)
    u, v = y - i, x - j
    flat, k = a.ravel(), i * w + j
    return (flat[k] * (1 - v) + flat[k + 1] * v) * (1 - u) + (flat[k + w] * (1 - v) + flat[k + w + 1] * v) * u


def describe(gray: np.ndarray, quality: float = 0.02, apart: int = 3) -> tuple[np.ndarray, ...]:
    """x, y (in the image's own pixels), scale, angle and descriptor (two unsigned 64-bit words) of all corners, level by level."""
    found = []
    for scale in SCALES:
        a = _smaller(gray, scale)
        h, w = a.shape
        if min(h, w) < 2 * PATCH + 4:
            break
        gy, gx = np.gradient(_box(a, 1))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = PATCH + 1
        inner = response[edge : h - edge, edge : w - edge]
        top = inner.max(initial=0)
        if top <= 1e-6:
            continue
        y, x = np.nonzero((inner >= quality * top) & (inner == _peaks(response, apart)[edge : h - edge, edge : w - edge]))
        if not len(y):
            continue
        y, x = y + edge, x + edge
        smooth = _box(_box(a, 2), 2)
        words, angles = [], []
        for k in range(0, len(y), 4096):
            at_y, at_x = y[k : k + 4096], x[k : k + 4096]
            patch = smooth[at_y[:, None] + _DISC[:, 0], at_x[:, None] + _DISC[:, 1]]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
            c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            dx, dy = TESTS[None, :, :, 0], TESTS[None, :, :, 1]
            v = _sampled(smooth, at_y[:, None, None] + s * dx + c * dy, at_x[:, None, None] + c * dx - s * dy)
            words.append(np.packbits(v[..., 0] < v[..., 1], axis=1).view(">u8").astype(np.uint64))
            angles.append(angle)
        found.append((x * scale, y * scale, np.full(len(x), scale), np.concatenate(angles), np.concatenate(words)))
    if not found:
        return np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((0, 2), np.uint64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(5))


def mates(x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The ``MATES`` nearest corners of each corner on its own level, as places; -1 where there are fewer."""
    out = np.full((len(x), MATES), -1, np.int64)
    for level in np.unique(scale):
        rows = np.flatnonzero(scale == level)
        for k in range(0, len(rows), 512):
            own = rows[k : k + 512]
            far = np.hypot(x[own][:, None] - x[rows], y[own][:, None] - y[rows])
            far[np.arange(len(own)), np.arange(k, k + len(own))] = np.inf
            n = min(MATES, len(rows) - 1)
            out[own, :n] = rows[np.argsort(far, axis=1, kind="stable")[:, :n]]
    return out


def keys_of(words: np.ndarray, mate: np.ndarray) -> np.ndarray:
    """Table keys of each corner with each mate: a hash of ``PART`` bits of either descriptor, then two bits for the table; -1 without a mate."""
    halves = np.stack([words[:, 0] >> np.uint64(32), words[:, 0] & np.uint64(0xFFFFFFFF), words[:, 1] >> np.uint64(32), words[:, 1] & np.uint64(0xFFFFFFFF)], axis=1)
    parts = halves >> np.uint64(32 - PART)
    both = (parts[:, None, :] << np.uint64(32)) | parts[mate]
    both = (both ^ (both >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    both = (both ^ (both >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = ((both >> np.uint64(3)) << np.uint64(2) | np.arange(TABLES, dtype=np.uint64)).astype(np.int64)
    return np.where((mate >= 0)[:, :, None], keys, -1)


CORNER = "struct<x:double,y:double,scale:double,angle:double,d0:bigint,d1:bigint>"


def described(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """``image_id``, ``digest`` (SHA-256 of the bytes, NULL for none), ``corners``, ``mates`` and ``keys``, in one pass over the images.

    ``mates`` has ``MATES`` places for each corner, ``keys`` has ``TABLES``
    numbers for each of those. Null, empty and unreadable images have no corners.
    """
    corner = pa.struct([*[(c, pa.float64()) for c in PLACE[:4]], ("d0", pa.int64()), ("d1", pa.int64())])

    def run(batches):
        for batch in sliced(batches, 64):
            ids, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            none = describe(np.zeros((1, 1)))
            parts = [none if gray is None else describe(gray) for gray in map(decode_image, data)]
            mate = [mates(p[0], p[1], p[2]) for p in parts]
            key = [keys_of(p[4], m) for p, m in zip(parts, mate, strict=True)]
            ends = np.cumsum([0, *[len(p[0]) for p in parts]])
            x, y, scale, angle, words = (np.concatenate([p[k] for p in parts]) for k in range(5))
            words = words.view(np.int64)
            flat = pa.StructArray.from_arrays([pa.array(v) for v in (x, y, scale, angle, words[:, 0].copy(), words[:, 1].copy())], fields=list(corner))
            lists = lambda v, each: pa.ListArray.from_arrays(pa.array(ends * each, pa.int32()), v)  # noqa: B023, E731
            columns = [pa.array(ids, pa.int64()), pa.array([None if r is None else hashlib.sha256(r).hexdigest() for r in data], pa.string()), lists(flat, 1)]
            columns += [lists(pa.array(np.concatenate(mate).ravel().astype(np.int32)), MATES), lists(pa.array(np.concatenate(key).ravel()), MATES * TABLES)]
            yield pa.RecordBatch.from_arrays(columns, ["image_id", "digest", "corners", "mates", "keys"])

    chosen = images.select(images[id_col].cast("long").alias("image_id"), images[image_col].alias("image"))
    return chosen.mapInArrow(lean(run), f"image_id long, digest string, corners array<{CORNER}>, mates array<int>, keys array<long>")


def buckets(found: DataFrame) -> DataFrame:
    """Corners and mates whose key another image has: ``key, n`` (rows of the key), ``image_id``, ``a``, ``b`` (the two corners), ``way`` and ``far``.

    ``found``: ``image_id, corners, mates, keys``. Only keys travel until it is
    known which of them meet another image's.
    """
    keyed = found.select("image_id", F.posexplode("keys").alias("at", "key")).filter("key >= 0")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("image_id").alias("lo"), F.max("image_id").alias("hi")).filter("lo < hi").select("key", "n")
    met = keyed.join(shared, "key").join(found.select("image_id", "corners", "mates"), "image_id")
    slot = F.floor(F.col("at") / TABLES).cast("int")
    pairs = met.select("key", "n", "image_id", F.get("corners", F.floor(slot / MATES).cast("int")).alias("a"), F.get("corners", F.get("mates", slot)).alias("b"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    return pairs.withColumns({"way": F.atan2(dy, dx) - F.col("a.angle"), "far": F.log(F.hypot(dx, dy) / F.col("a.scale"))})


def _alike(bits: int) -> Column:
    """Whether two bucket rows (``p_`` and ``q_``) agree: descriptors of both corners, direction and distance between them; each pair in the first table it shares."""
    xors = {f"{c}{w}": F.col(f"p_{c}.d{w}").bitwiseXOR(F.col(f"q_{c}.d{w}")) for c in "ab" for w in "01"}
    near = [F.bit_count(xors[f"{c}0"]) + F.bit_count(xors[f"{c}1"]) <= bits for c in "ab"]
    table = F.col("key").bitwiseAND(F.lit(3))
    whole = F.lit((1 << PART) - 1)
    part = lambda c, t: F.shiftrightunsigned(xors[f"{c}{t // 2}"], (32 if t % 2 == 0 else 0) + 32 - PART).bitwiseAND(whole)
    before = reduce(Column.__or__, [(table > t) & (part("a", t) == 0) & (part("b", t) == 0) for t in range(TABLES - 1)])
    return near[0] & near[1] & (F.cos(F.col("p_way") - F.col("q_way")) > 0.75) & (F.abs(F.col("p_far") - F.col("q_far")) < 0.35) & ~before


def _met(few: DataFrame, all_: DataFrame, most: int, bits: int, once: Column) -> DataFrame:
    """Matches of each row of ``few`` with the rows of its key in ``all_`` that have another label, block by block of about ``most`` rows."""
    side = [c for c in all_.columns if c not in ("key", "n")]
    blocks = F.ceil(F.col("n") / most).cast("int")
    p = few.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *[F.col(c).alias(f"p_{c}") for c in side])
    q = all_.select("key", F.pmod(F.xxhash64("image_id", "a.x", "a.y", "a.scale"), blocks).cast("int").alias("block"), *[F.col(c).alias(f"q_{c}") for c in side])
    return p.join(q, ["key", "block"]).filter((F.col("p_label") != F.col("q_label")) & once & _alike(bits))


def agreed(matches: DataFrame, least: int = 6, shift: float = 4.0, part: float = 0.15) -> DataFrame:
    """Image pairs (``a``, ``b``) of which ``least`` corners agree on one turn, scale and shift.

    Every match of two corners gives a turn and a scale; other matches agree
    with it if theirs are alike and their corners fall where it puts them, to
    within ``shift`` pixels and ``part`` of the way. Corners within 6 pixels
    count once, in both images.
    """
    swap = F.col("p_image_id") > F.col("q_image_id")
    side = lambda c, first: F.struct(*[F.when(swap == F.lit(first), F.col(f"q_{c}")[f]).otherwise(F.col(f"p_{c}")[f]).alias(f) for f in PLACE[:4]])
    ids = [F.least("p_image_id", "q_image_id").alias("a"), F.greatest("p_image_id", "q_image_id").alias("b")]
    rows = matches.select(*ids, F.array(*[F.struct(side(c, True).alias("l"), side(c, False).alias("r")) for c in "ab"]).alias("m"))
    lists = rows.groupBy("a", "b").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("m")).filter(F.size("m") >= least)

    def run(batches):
        for batch in sliced(batches, 256):
            both = batch.column(2)
            flat, ends = both.flatten(), np.asarray(both.offsets)
            ends = ends - ends[0]
            left, right = ([flat.field(s).field(f).to_numpy(zero_copy_only=False) for f in PLACE[:4]] for s in ("l", "r"))
            kept = [consents([v[i:j] for v in left], [v[i:j] for v in right], least, shift, part) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return lists.mapInArrow(lean(run), "a long, b long")


def consents(left: list[np.ndarray], right: list[np.ndarray], least: int, shift: float = 4.0, part: float = 0.15) -> bool:
    """Whether one of the matches (x, y, scale, angle of either side) has the agreement of enough corners."""
    n = len(left[0])
    turn, ratio = right[3] - left[3], right[2] / left[2]
    cells = [np.unique((v[0] // CELL).astype(np.int64) << 32 | (v[1] // CELL).astype(np.int64), return_inverse=True)[1] for v in (left, right)]
    step = max(1, (1 << 20) // max(n, 1))
    for at in range(0, n, step):
        own = slice(at, at + step)
        dx, dy = left[0][None] - left[0][own, None], left[1][None] - left[1][own, None]
        c, s, r = np.cos(turn[own])[:, None], np.sin(turn[own])[:, None], ratio[own, None]
        off = np.hypot(right[0][own, None] + r * (c * dx - s * dy) - right[0][None], right[1][own, None] + r * (s * dx + c * dy) - right[1][None])
        alike = (off <= shift + part * r * np.hypot(dx, dy)) & (np.cos(turn[None] - turn[own, None]) > 0.94) & (np.abs(np.log(ratio[None] / r)) < 0.4)
        rows = np.flatnonzero(alike.sum(axis=1) >= least)
        for i in rows.tolist():
            if min(len(np.unique(cell[alike[i]])) for cell in cells) >= least:
                return True
    return False


def _relabelled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Bucket rows with their images' least label, of their own and of ``names``, and ``large`` where a name has it; an image has a bounded number of rows."""
    own = Window.partitionBy("image_id")
    new = {"label": F.min("label").over(own)} | ({"large": F.max("large").over(own)} if "large" in names.columns else {})
    return rows.unionByName(names, allowMissingColumns=True).withColumns(new).filter("key is not null")


def image_links(found: DataFrame, least: int = 6, bits: int = 24, most: int = 512, crowd: int = 4, large: int = 32, rounds: int = 6) -> DataFrame:
    """Links (``a``, ``b``) that connect the same images as all links do. ``found``: ``image_id, corners, mates, keys``.

    Two images link if ``agreed`` over all matches of their corners in the
    tables; nothing else in the table bears on that. First, in each bucket of
    more than ``crowd`` rows, one image meets the others, ``rounds`` times;
    links found so are links, and an image takes the least label of those that it
    links to, so images of one label are joined. Then every two
    images of a bucket that still have different labels meet, whatever the
    bucket's size: only pairs that are joined already are passed over, so
    components are those of all pairs, at every ``crowd``, ``large``, ``most``
    and ``rounds``. A label of more than ``large`` images is met only by images
    that ``_others`` finds able to link with it; ``most`` is the size of a join's
    blocks.
    """
    held = written(buckets(found), "buckets")
    labelled = held.withColumn("label", F.col("image_id"))
    links = []
    for turn in range(rounds):
        crowded = labelled.filter(F.col("n") > crowd)
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))  # noqa: B023, E731
        lead = crowded.groupBy("key").agg(F.min_by("image_id", order("image_id")).alias("image_id"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "image_id")
        new = written(agreed(_met(crowded.join(lead, ["key", "image_id"], "left_semi"), crowded, most, bits, F.lit(True)), least), "links")
        if new.isEmpty():
            break
        links.append(new)
        both = new.union(new.select("b", "a")).toDF("image_id", "to")
        names = labelled.select("image_id", "label").distinct()
        for _ in range(3):  # the least label of what an image links to, and of what that links to
            least_of = both.join(names.withColumnRenamed("image_id", "to"), "to").groupBy("image_id").agg(F.min("label").alias("other"))
            names = written(names.join(least_of, "image_id", "left").select("image_id", F.least("label", "other").alias("label")), "labels")
        labelled = written(_relabelled(labelled, names), "buckets")
    if links:
        joined = components(reduce(DataFrame.union, links), "a", "b")
        sizes = joined.groupBy("component").agg(F.count("*").alias("images"))
        named = joined.join(sizes, "component").select(F.col("node").alias("image_id"), F.col("component").alias("label"), (F.col("images") > large).alias("large"))
        labelled = _relabelled(labelled.withColumn("large", F.lit(False)), named)
    else:
        labelled = labelled.withColumn("large", F.lit(False))
    labelled = written(labelled, "buckets")
    return reduce(DataFrame.union, [*links, *_others(labelled, least, bits, most)])


def _others(labelled: DataFrame, least: int, bits: int, most: int) -> list[DataFrame]:
    """Links between images of different labels: among labels that aren't ``large``, and of any images with large ones.

    An image can only link with one of a label if enough of its own corners lie
    in buckets that hold the label. That is known from one row for each of its
    corners and label; for a large label, only images that pass meet its rows.
    """
    small, big = (labelled.filter(c).drop("large") for c in ("not large", "large"))
    common = small.groupBy("key", "label").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("common"), F.count("*").alias("labels")).filter("labels > 1").select("key", "common")
    open_ = small.join(common, "key")
    once = (F.col("q_label") == F.col("q_common")) | (F.col("p_image_id") < F.col("q_image_id"))
    out = [agreed(_met(open_.filter("label <> common"), open_, most, bits, once), least)]
    if big.isEmpty():
        return out
    at = big.groupBy("key", F.col("label").alias("to")).agg(F.count("*").alias("rows"))
    columns = [c for c in big.columns if c not in ("key", "n")]
    near = labelled.drop("n", "large").join(at, "key").filter("label <> to")
    cell = lambda c: F.struct(F.floor(F.col(c).x / CELL), F.floor(F.col(c).y / CELL))
    cells = near.select("image_id", "to", F.explode(F.array(cell("a"), cell("b"))).alias("cell")).distinct()
    able = cells.groupBy("image_id", "to").agg(F.count("*").alias("cells")).filter(F.col("cells") >= least).select("image_id", "to")
    few = near.join(able, ["image_id", "to"]).select("key", F.col("rows").alias("n"), *columns, "to")
    many = big.join(at.select("key", F.col("to").alias("label"), "rows"), ["key", "label"]).select("key", F.col("rows").alias("n"), *columns, F.col("label").alias("to"))
    return [*out, agreed(_met(few, many, most, bits, F.col("p_to") == F.col("q_label")), least)]


def image_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image", **options) -> DataFrame:
    """One row per row of ``images``: ``image_id``, ``component_id`` (the least id reachable over links) and ``class_id`` (the least id of the same bytes).

    Images of the same bytes are one class, compared once. Null, empty and
    unreadable images, and those without corners, stand alone unless their
    bytes are equal; a null image is a class of its own for each row. Rows that
    repeat an id are one image: the one of the least digest is compared. A row
    without an id gets the ids of its bytes if a row with an id has them, else
    NULL, and links nothing. Other columns play no part; an empty table gives no
    rows.
    """
    held = written(described(images, id_col, image_col), "images")
    classes = held.filter("digest is not null").groupBy("digest").agg(F.min("image_id").alias("class_id"))
    own = held.filter("image_id is not null and size(corners) > 0").groupBy("image_id").agg(F.min("digest").alias("digest"))
    first = own.join(classes, (own.image_id == classes.class_id) & (own.digest == classes.digest), "left_semi")
    found = held.join(first, ["image_id", "digest"], "left_semi").dropDuplicates(["image_id"]).select("image_id", "corners", "mates", "keys")
    nodes = components(image_links(found, **options), "a", "b").select(F.col("node").alias("class_id"), "component")
    labelled = classes.join(nodes, "class_id", "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    salted = labelled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    rows = held.select("image_id", "digest", F.pmod(F.xxhash64("image_id"), F.lit(16)).cast("int").alias("salt"))
    joined = rows.join(salted, ["digest", "salt"], "left")
    return joined.select("image_id", F.coalesce("component_id", "image_id").alias("component_id"), F.coalesce("class_id", "image_id").alias("class_id"))


def rendered(vectors: DataFrame, id_col: str, vector_col: str, size: int = 80) -> DataFrame:
    """Each vector as a grey PGM image: its values are cosine coefficients, from the eighth wave on. Null or empty vectors give null."""

    def run(batches):
        for batch in sliced(batches, 64):
            out = []
            for v in batch.column(1).to_pylist():
                if not v:
                    out.append(None)
                    continue
                side = int(np.ceil(np.sqrt(len(v))))
                k = np.zeros(side * side)
                k[: len(v)] = [x or 0.0 for x in v]
                wave = np.cos(np.pi * np.arange(8, side + 8)[:, None] * (np.arange(size) + 0.5)[None, :] / size)
                a = wave.T @ k.reshape(side, side) @ wave
                out.append(encode_pgm(np.clip(128 + 40 * a / max(a.std(), 1e-9), 0, 255)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "image"])

    return vectors.select(vectors[id_col].cast("long").alias("image_id"), vectors[vector_col].alias("v")).mapInArrow(lean(run), "image_id long, image binary")
