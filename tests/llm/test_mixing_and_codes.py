"""Mixing against plain Sainte-Laguë and fill levels, vector codes against plain k-means, both on edge cases."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import mixing, vector_codes as vc

DOCS = "doc_id long, text string, source string, size long, quota long, place string, party long, _at int"


def documents():
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 200])), rnd.choice(["a", "b", "b", "b", "b", "ç", "z", None]), 1, 2, "x", 3, 4) for i in range(400)]
    rows += [(1000, "long " * 30000, "b", 1, 1, "", 1, 1), (1001, None, "a", 1, 1, "", 1, 1), (1002, "", "only empty", 1, 1, "", 1, 1)]
    return rows + rows[:3] + [(None, "no id " * 9, "z", 0, 0, None, 0, 0)]


def plain_targets(sizes):
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, out = sum(sizes.values()) * 1.5, {s: 0.0 for s in sizes}
    free = set(sizes)
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def test_mix(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mix_sources(docs, shard_docs=60).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = plain_targets(sizes), {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum((p["to"] - p["from"]) * p["times"] for p in r.parts)
        assert all(0 <= p["from"] < p["to"] <= r.size for p in r.parts)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(mixing.BLOCK_WORDS, 0.02 * want[s])
    again = mixing.mix_sources(docs.repartition(7), shard_docs=60).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).collect() == []


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(2)
    rows = [(g, p, rnd.choice([0, 1, 3, 3, 10, 55, 200]) * 1.0, seats) for g, seats in [("x", 1), ("y", 17), (None, 100), ("z", 0)] for p in range(12)]
    got = mixing.apportion(spark.createDataFrame(rows, "g string, party long, votes double, seats long"), ["g"], "party", "votes", "seats").collect()
    assert len(got) == len(rows)
    for g, seats in [("x", 1), ("y", 17), (None, 100), ("z", 0)]:
        own = {p: v for h, p, v, _ in rows if h == g}
        quotients = sorted((-v / (2 * k + 1), p) for p, v in own.items() if v for k in range(seats))[:seats]
        assert {r.party: r.quota for r in got if r.g == g} == {p: sum(q == p for _, q in quotients) for p in own}


VECTORS = "vec_id long, embedding array<float>, label int, row long, code string, ints array<long>"


def plain_codes(rows):
    kept = [(k, [max(-vc.LARGEST, min(vc.LARGEST, math.floor(1024.0 * x))) for x in np.asarray(v, np.float32).astype(float)], lab)
            for k, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ends, out = vc.cuts(len(kept[0][1])), [[r[0], "", 0, r[2]] for r in kept]
    books = []
    for a, b in zip(ends, ends[1:]):
        parts = [r[1][a:b] for r in kept]
        book = [list(p) for p in parts[:vc.ENTRIES]]

        def near(p):
            return min((sum((x - y) ** 2 for x, y in zip(p, e)), i) for i, e in enumerate(book))
        for _ in range(vc.ROUNDS):
            sets = {}
            for p in parts:
                sets.setdefault(near(p)[1], []).append(p)
            for i, own in sets.items():
                book[i] = [sum(c) // len(own) for c in zip(*own)]
        for o, p in zip(out, parts):
            d, i = near(p)
            o[1], o[2] = o[1] + f"{i:02x}", o[2] + d
        books += [x for e in book for x in e]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(str((k, c, e, total[lab], digest)) for k, c, e, lab in out)


@pytest.mark.parametrize("width", [8, 10])
def test_codes(spark, monkeypatch, width):
    monkeypatch.setattr(vc, "ENTRIES", 9)
    rnd = random.Random(width)
    rows = [(i, [rnd.choice([rnd.gauss(0, .3), rnd.choice([-0.5, 0.25])]) for _ in range(width)], rnd.choice([0, 1, None]), 1, "c", None) for i in range(150)]
    rows += [(500 + i, rows[3][1], 7, 1, "c", None) for i in range(100)]                     # one very common vector
    rows += [(7, rows[9][1], 2, 1, "c", None), rows[20], (None, rows[30][1], None, 1, "c", None)]   # repeated ids and rows, no id
    rows += [(900, None, 1, 1, "", None), (901, [None] * width, 1, 1, "", None), (902, [float("nan")] * width, 1, 1, "", None),
             (903, [float("inf")] + [0.0] * (width - 1), 1, 1, "", None), (-1, [], 1, 1, "", None), (904, [1.0], 1, 1, "", None)]
    got = vc.compress(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain_codes([r for r in rows if r[0] != -1])
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got.collect()) == want


def test_codes_of_large_components_and_few_rows(spark):
    rows = [(1, [3e38, -3e38, 1e5, 0.5], 1, 1, "", None), (2, [65536.0, -65535.5, 7.0, -0.0], None, 1, "", None)]
    got = vc.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == plain_codes(rows)
    assert vc.compress(spark.createDataFrame([], VECTORS)).collect() == []
    empty = vc.compress(spark.createDataFrame([(1, [], 1, 1, "", None)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error) for r in empty] == [(1, "00000000", 0)]


def test_shortlists_hold_every_nearest_entry():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        points, entries = rnd.integers(-50, 50, (20, 3)), rnd.integers(-50, 50, (12, 3))
        able = vc.shortlists(points.min(0)[None], points.max(0)[None], entries)[0]
        best, error = vc.nearest(points, entries)
        assert able[best].all()
        assert (error == ((points[:, None] - entries) ** 2).sum(2).min(1)).all()
        big, error_big = vc.nearest(points * (1 << 21), entries * (1 << 21))
        assert (big == best).all() and (error_big == error * (1 << 42)).all()


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = vc.hilbert_keys(grid, np.zeros(3, int), np.full(3, 7), bits=3)
    order = grid[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert len(set(keys)) == 512 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
