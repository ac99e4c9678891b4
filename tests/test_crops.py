"""Crops against plain loops over small rasters."""

import hashlib
import random

import pytest

from tessella.operators import crops


def raster(seed, n, h, w):
    """Images of patches of classes, with a region that leaves holes; the last image has no region."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        for y in range(h):
            for x in range(w):
                code = (y // 3 + x // 4 + i) % 4 if rng.random() < 0.9 else rng.randrange(4)
                rows.append((i, y, x, code, i < n - 1 and rng.random() < (0.15 if i % 2 else 0.7)))
    return rows


def parts(region):
    """Components of 8 neighbours: cells, in the order that the sampler wants."""
    left, out = set(region), []
    while left:
        todo, own = [min(left)], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.discard((y, x))
                own.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        out.append(own)
    return out


def plain(rows, image, h, w, seed, size, rare, shares, stride, band, least, most, tiny, iou, outside):
    """One image's crops and counters by a loop over strategies."""
    code = {(y, x): c for i, y, x, c, r in rows if i == image and r}
    count = dict.fromkeys(("generated", "accepted", "no_candidate", "duplicate", "high_iou"), 0)
    if not code:
        return None
    total = min(max(-(-h // stride) * -(-w // stride), least), most)
    raw = {k: v * total for k, v in shares.items()}
    quota = {k: int(v) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: (-(raw[k] - int(raw[k])), k))[: total - sum(quota.values())]:
        quota[k] += 1
    taken = []

    def offer(x, y, strategy, forced=False, small=False):
        count["generated"] += 1
        if not any((b, a) in code for a in range(x, x + size) for b in range(y, y + size)):
            count["no_candidate"] += 1
            return False
        if any((x, y) == t[:2] for t in taken):
            count["duplicate"] += 1
            return False
        for t in taken:
            inter = max(0, size - abs(x - t[0])) * max(0, size - abs(y - t[1]))
            if inter / (2 * size * size - inter) >= iou and not forced:
                count["high_iou"] += 1
                return False
        count["accepted"] += 1
        taken.append((x, y, strategy, forced, small))
        return True

    def around(px, py, *more):
        x, y = round(px - size / 2), round(py - size / 2)
        if outside:
            return offer(max(1 - size, min(x, w - 1)), max(1 - size, min(y, h - 1)), *more)
        return offer(0 if w <= size else max(0, min(x, w - size)), 0 if h <= size else max(0, min(y, h - size)), *more)

    def draw(points, salt, n):
        key = lambda p: (hashlib.sha256(f"{seed}:{image}:{salt}:{p[0]}:{p[1]}".encode()).hexdigest(), p)
        return sorted(sorted(points, key=key)[:n])

    def take(points, most_, *more):
        got = 0
        for y, x in points:
            if got >= most_:
                break
            got += around(x, y, *more)
        return got

    def grid(step):
        starts = lambda n: [0] if n <= size else sorted({*range(0, n - size + 1, step), n - size})
        out = [(x, y) for y in starts(h) for x in starts(w)]
        lx, ly = max(0, w - size), max(0, h - size)
        for p in [(0, 0), (lx, 0), (0, ly), (lx, ly), (lx // 2, 0), (lx // 2, ly), (0, ly // 2), (lx, ly // 2)]:
            if p not in out:
                out.append(p)
        return out

    if "spatial_grid" in quota:
        got = 0
        for x, y in grid(stride):
            if got >= quota["spatial_grid"]:
                break
            got += offer(x, y, "spatial_grid", True)
    n = quota.get("edge_candidate", 0)
    if n:
        near = [(y, x) for y, x in code if y < band or x < band or y >= h - band or x >= w - band]
        if not take(draw(near, "edge_candidate", 4 * n), n, "edge_candidate", True):
            ends = [min(code, key=lambda p: ((p[1] - cx) ** 2 + (p[0] - cy) ** 2, p)) for cx, cy in [(0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)]]
            take(ends, n, "edge_candidate", True)
    border = [(y, x) for y, x in code if any(code.get(q, code[y, x]) != code[y, x] for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)))]
    n = quota.get("shade_boundary", 0)
    take(draw(border, "shade_boundary", 3 * n), n, "shade_boundary", True)
    n, got = quota.get("candidate_component", 0), 0
    mean = lambda c, k: round(sum(p[k] for p in c) / len(c), 6)
    for c in sorted(parts(code), key=lambda c: (len(c) > tiny, -len(c), mean(c, 0), mean(c, 1), min(c))):
        y0, y1, x0, x1 = min(p[0] for p in c), max(p[0] for p in c), min(p[1] for p in c), max(p[1] for p in c)
        centres = [(mean(c, 0), mean(c, 1))]
        if y1 - y0 >= size or x1 - x0 >= size:
            centres += [(y, x) for y in range(y0, y1 + 1, max(size // 2, 1)) for x in range(x0, x1 + 1, max(size // 2, 1))]
        got += take(centres, n - got, "candidate_component", len(c) <= tiny, len(c) <= tiny)
    n, got = quota.get("rare_class", 0), 0
    for k in rare:
        own = [p for p in code if code[p] == k]
        if got < n and own:
            got += take(draw(own, "rare_class", max(2 * (n - got), 1)), n - got, "rare_class")
    n = quota.get("uniform_candidate", 0)
    take(draw(code, "uniform_candidate", 3 * n), n, "uniform_candidate")
    left = total - len(taken)
    take(draw(code, "refill", 5 * left), left, "uniform_candidate")
    if "spatial_grid" in quota:
        for x, y in grid(max(1, min(64, stride), stride // 2)):
            if len(taken) >= total:
                break
            offer(x, y, "spatial_grid")
    return count, taken


def test_quotas():
    assert crops.quotas(8, crops.GRID_SHARES) == {"spatial_grid": 3, "edge_candidate": 2, "shade_boundary": 2, "candidate_component": 1, "rare_class": 0, "uniform_candidate": 0}
    for n in range(70):
        for shares in (crops.SHARES, crops.GRID_SHARES):
            assert sum(crops.quotas(n, shares).values()) == n


@pytest.mark.parametrize("shares, size, outside, band", [(crops.GRID_SHARES, 4, False, 2), (crops.SHARES, 3, True, 2), (crops.GRID_SHARES, 5, True, 0), (crops.GRID_SHARES, 14, False, 3)])
def test_sampler_is_the_plain_loop(spark, shares, size, outside, band):
    h, w, rare = 11, 13, [3, 0, 1]
    rows = raster(size, 6, h, w)
    cells = spark.createDataFrame(rows, "image_id long, y int, x int, code int, region boolean")
    images = spark.createDataFrame([(i, w, h) for i in range(6)], "image_id long, width int, height int")
    got = {r.image_id: r for r in crops.sample_crops(images, cells, 7, size, rare, shares, 3, band, 6, 20, 2, 0.4, outside).collect()}
    seen = set()
    for i in range(6):
        want = plain(rows, i, h, w, 7, size, rare, shares, 3, band, 6, 20, 2, 0.4, outside)
        if want is None:
            assert i not in got
            continue
        count, taken = want
        assert [tuple(c) for c in got[i].crops] == taken, i
        assert {k: got[i][k] for k in count} == count
        assert got[i].generated == got[i].accepted + got[i].no_candidate + got[i].duplicate + got[i].high_iou
        seen |= {t[2] for t in taken}
    assert len(seen) > 2 or size > h
    assert crops.sample_crops(images, cells.where("false"), 7, size, rare, shares, 3, band, 6, 20, 2, 0.4, outside).count() == 0


def test_records(spark):
    h, w, size = 6, 7, 3
    rows = raster(1, 2, h, w)
    cells = spark.createDataFrame(rows, "image_id long, y int, x int, code int, region boolean")
    images = spark.createDataFrame([(i, w, h) for i in range(2)], "image_id long, width int, height int")
    found = crops.sample_crops(images, cells, 7, size, [1], stride=2, band=2, least=3, most=9, tiny=2).checkpoint()
    code = {(y, x): c for i, y, x, c, r in rows if i == 0 and r}
    out = crops.crop_records(found, images, cells, [0, 1, 2, 3], size, 1, (0, 3)).collect()
    assert len(out) == 2 * found.first().accepted
    for r in out:
        own = [(y, x) for y, x in code if r.x <= x < r.x + size and r.y <= y < r.y + size]
        assert r.sample_id == f"0__x{r.x}_y{r.y}_k{r.k}" and r.nx == round(r.x / w, 6)
        assert r.region == len(own) and r.center == sum(y == r.y + 1 and x == r.x + 1 for y, x in own)
        assert [r[f"code_{c}"] for c in range(4)] == [sum(code[p] == c for p in own) for c in range(4)]


def test_selection_skips_repeats_and_overlaps(spark):
    # Two equal halves: the best window of the right one shows what the left one's does, and isn't taken again.
    cells = [(0, y, x, x % 4 == 1 and y == 1, x % 4 in (1, 2) and y in (1, 2), False, y == 3) for y in range(4) for x in range(8)]
    df = spark.createDataFrame(cells, "image_id long, y int, x int, transition boolean, shade boolean, dark boolean, line boolean")
    got = crops.select_crops(df, 7, [2, 20], iou=0.5, most=32, least_stride=1).orderBy("place").collect()
    assert [r.category for r in got] == crops.CATEGORIES[:2] + crops.CATEGORIES[2:]
    assert (got[0].x, got[0].y, got[0].score) == (0, 0, 0.25)
    assert (got[1].x, got[1].y, got[1].score) == (1, 1, 1.0)
    assert got[3].y == 2 and got[3].category == "negative"
    assert len({(r.x, r.y) for r in got}) == len(got)
    assert crops.select_crops(df.where("false"), 7, [2], least_stride=1).count() == 0
