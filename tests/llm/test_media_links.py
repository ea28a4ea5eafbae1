"""Links of images depend on the two images alone, not on buckets or the size of the table; recall of each edit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import media
from lithoframe.llm.components import components

SCHEMA = f"image_id long, corners array<{media.CORNER}>, mates array<int>, keys array<long>"


def words(rng, n):
    return rng.integers(0, 2**64, (n, 2), np.uint64)


def row(image_id, x, y, w):
    """An image with corners at these places, on one level and without turn."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    mate = media.mates(x, y, np.ones(len(x)))
    return image_id, [(*p, 1.0, 0.0, *d) for p, d in zip(zip(x.tolist(), y.tolist(), strict=True), w.view(np.int64).tolist(), strict=True)], mate.ravel().tolist(), media.keys_of(w, mate).ravel().tolist()


def flipped(rng, w, bits):
    w = w.copy()
    for i in range(len(w)):
        for b in rng.choice(128, bits, replace=False).tolist():
            w[i, b // 64] ^= np.uint64(1 << (63 - b % 64))
    return w


def labels(links, images):
    found = {r.node: r.component for r in components(links, "a", "b").collect()}
    return {i: found.get(i, i) for i in images}


def brute(rows, bits=24, least=6):
    """Labels from all pairs of images, each with all pairs of corners that share a key."""
    label = {r[0]: r[0] for r in rows}
    slots = {r[0]: [(p // (media.MATES * media.TABLES), r[2][p // media.TABLES], k) for p, k in enumerate(r[3]) if k >= 0] for r in rows}
    corner = {r[0]: r[1] for r in rows}
    near = lambda p, q: sum(((p[k] ^ q[k]) & (2**64 - 1)).bit_count() for k in (4, 5)) <= bits
    for a in label:
        for b in label:
            if a >= b:
                continue
            m = set()
            for i, j, k in slots[a]:
                for u, v, w in slots[b]:
                    p, q, s, t = corner[a][i], corner[a][j], corner[b][u], corner[b][v]
                    way = lambda c, d: np.arctan2(d[1] - c[1], d[0] - c[0]) - c[3]
                    far = lambda c, d: np.log(np.hypot(d[0] - c[0], d[1] - c[1]) / c[2])
                    if k == w and near(p, s) and near(q, t) and np.cos(way(p, q) - way(s, t)) > 0.75 and abs(far(p, q) - far(s, t)) < 0.35:
                        m |= {(p[:4], s[:4]), (q[:4], t[:4])}
            if len(m) >= least and media.consents([np.array([x[0][f] for x in m]) for f in range(4)], [np.array([x[1][f] for x in m]) for f in range(4)], least):
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return label


PLACES = [(20.0 * (k % 4) + 3 * k, 25.0 * (k // 4) + 2 * k) for k in range(8)]


@pytest.mark.parametrize("fill", [0, 10, 60, 1000])
def test_chain_through_a_large_bucket(spark, fill):
    """0 and 100 each agree with 50 in other corners, not with each other; the fillers share two corners with all, so they meet in one bucket and link with none."""
    rng = np.random.default_rng(5)
    common, left, right = words(rng, 2), words(rng, 6), words(rng, 6)
    x, y = zip(*PLACES, strict=True)
    more = [(300.0 + a, 300.0 + b) for a, b in PLACES[2:]]
    mx, my = zip(*more, strict=True)
    rows = [row(0, x, y, np.concatenate([common, left])), row(50, [*x, *mx], [*y, *my], np.concatenate([common, left, right])), row(100, [*x[:2], *mx], [*y[:2], *my], np.concatenate([common, right]))]
    rows += [row(1000 + i, x, y, np.concatenate([common, words(rng, 6)])) for i in range(fill)]
    for options in ({}, {"crowd": 1, "most": 7}, {"rounds": 0}):
        got = labels(media.image_links(spark.createDataFrame(rows, SCHEMA), **options), [r[0] for r in rows])
        assert got[50] == got[100] == 0 and all(got[i] == i for i in got if i >= 1000)


def test_labels_are_those_of_all_pairs(spark):
    """Groups of near copies with flipped bits and lost corners, among images that share some corners, at every size of bucket."""
    rng = np.random.default_rng(2)
    x, y = map(np.array, zip(*PLACES, strict=True))
    rows, logo = [], words(rng, 2)
    for group in range(6):
        base = words(rng, 8)
        for i in range(9):
            w = flipped(rng, base, int(rng.integers(0, 14)))
            if group % 2:
                w[:2] = logo
            keep = np.sort(rng.permutation(8)[: rng.integers(4, 9)])
            rows.append(row(10 * group + i, x[keep] + 5 * group, y[keep], w[keep]))
    want = brute(rows)
    assert 6 < len(set(want.values())) < 54
    found = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"crowd": 1}, {"crowd": 3, "most": 2, "rounds": 3}, {"rounds": 0, "most": 4}):
        assert labels(media.image_links(found, **options), want) == want


def test_link_does_not_depend_on_the_number_of_images(spark):
    rng = np.random.default_rng(3)
    x, y = zip(*PLACES, strict=True)
    w = words(rng, 8)
    pair = [row(1, x, y, w), row(2, x, y, flipped(rng, w, 3))]
    others = [row(10 + i, x, y, words(rng, 8)) for i in range(2000)]
    for rows in (pair, pair + others):
        assert [(r.a, r.b) for r in media.image_links(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 2)]


def test_a_group_of_copies_makes_few_matches(spark):
    """Images of one group are joined by the first rounds, and their other pairs are passed over."""
    rng = np.random.default_rng(4)
    x, y = zip(*PLACES, strict=True)
    w = words(rng, 8)
    found = spark.createDataFrame([row(i, x, y, w) for i in range(300)], SCHEMA)
    links = media.image_links(found)
    assert set(labels(links, range(300)).values()) == {0} and links.count() < 3 * 300


def picture(rng, n=96):
    a = sum(k * (lambda v: (v - v.mean()) / v.std())(media._box(media._box(rng.normal(size=(n, n)), s), s)) for k, s in ((40, 6), (25, 2))) + 128
    for _ in range(rng.integers(8, 16)):
        y, x, h, w = *rng.integers(0, n, 2), *rng.integers(5, 30, 2)
        a[y : y + h, x : x + w] = rng.integers(0, 255)
    yy, xx = np.mgrid[:n, :n]
    for _ in range(5):
        y, x, r = *rng.integers(0, n, 2), rng.integers(4, 14)
        a[(yy - y) ** 2 + (xx - x) ** 2 < r * r] = rng.integers(0, 255)
    return np.clip(a, 0, 255).round()


def resized(a, f):
    n = round(a.shape[0] * f)
    t = np.clip((np.arange(n) + 0.5) / f - 0.5, 0, a.shape[0] - 1.001)
    i = t.astype(int)
    u = t - i
    r = a[i] * (1 - u)[:, None] + a[i + 1] * u[:, None]
    return (r[:, i] * (1 - u) + r[:, i + 1] * u).round()


def drawn_over(rng, a, share=0.1):
    n = int(a.shape[0] * share**0.5)
    y, x = rng.integers(0, a.shape[0] - n, 2)
    b = a.copy()
    b[y : y + n, x : x + n] = rng.integers(0, 255)
    return b


EDITS = {
    "bright": lambda rng, a: np.clip(a * 1.1 + 10, 0, 255).round(),
    "turn": lambda rng, a: np.rot90(a),
    "crop": lambda rng, a: a[14:, 10:-6],
    "noise": lambda rng, a: np.clip(a + rng.normal(0, 6, a.shape), 0, 255).round(),
    "drawn over": drawn_over,
    **{f"scale {f}": lambda rng, a, f=f: resized(a, f) for f in (0.85, 0.9, 1.1, 1.15, 1.2)},
}


def test_recall_of_each_edit(spark):
    """One edited copy of each of 200 pictures for each edit, none byte-equal, among 1000 other pictures."""
    rng = np.random.default_rng(7)
    pictures = [picture(rng) for _ in range(200)]
    rows = [(100 * i, media.encode_pgm(a)) for i, a in enumerate(pictures)]
    rows += [(100 * i + 1 + k, media.encode_pgm(edit(rng, a))) for i, a in enumerate(pictures) for k, edit in enumerate(EDITS.values())]
    rows += [(1_000_000 + i, media.encode_pgm(picture(rng))) for i in range(1000)]
    assert len({b for _, b in rows}) == len(rows)
    found = media.described(spark.createDataFrame(rows, "image_id long, image binary").repartition(8)).select("image_id", "corners", "mates", "keys")
    links = {(r.a, r.b) for r in media.image_links(found, rounds=0).collect()}  # without rounds, all pairs
    for k, name in enumerate(EDITS):
        assert np.mean([(100 * i, 100 * i + k + 1) in links for i in range(200)]) >= 0.9, name
    wrong = {(a // 100 if a < 1_000_000 else a, b // 100 if b < 1_000_000 else b) for a, b in links}
    assert sum(a != b for a, b in wrong) <= 30  # of 719 400 pairs of different pictures


def test_ties_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    a, b = (media.encode_pgm(picture(rng)) for _ in range(2))
    edited = media.encode_pgm(EDITS["bright"](rng, media.decode_image(a)))
    rows = [(5, a), (5, a), (7, edited), (None, a), (None, b), (None, None), (9, b), (9, a), (3, None), (4, b"")]
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, image binary").withColumn("class_id", F.lit(1)))
    assert got.columns == ["image_id", "component_id", "class_id"] and got.count() == len(rows)
    seen = sorted({(r.image_id or 0, r.component_id or 0, r.class_id or 0) for r in got.collect()})
    assert seen == [(0, 0, 0), (0, 5, 5), (0, 9, 9), (3, 3, 3), (4, 4, 4), (5, 5, 5), (7, 5, 7), (9, 5, 5), (9, 9, 9)]
    large = media.encode_pgm(np.tile(picture(rng), (8, 8)))
    assert media.image_copies(spark.createDataFrame([(1, large), (2, large), (3, a)], "image_id long, image binary")).filter("component_id = 1").count() == 2
