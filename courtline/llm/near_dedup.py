"""Near duplicates by SetSketch registers.

A document is the set of its distinct word shingles. Register i holds floor(1 - log_b x_i), where x_i
is the smallest of exponentially distributed values of rate ``RATE``, one per shingle, truncated to
[0, LIMIT]; registers of a union are the maxima, and two sets agree in a register about as often
as their Jaccard similarity says. Bands of registers give candidate pairs, the counts of registers
that are equal, larger and smaller give a joint maximum-likelihood estimate that drops hopeless
pairs, and every link is confirmed on the full shingle sets.

Documents with the same set are one class from the start. In a bucket each class is first paired with
one centre (the class that meets most others). Where these links leave parts, members are paired
only if their differences from the centre share enough items (see ``_differing``: any other pair
is provably not linked), so a large group of copies costs far less than its pairs and no link
between different sets is lost. With 60 bands of 10 registers (7 at 0.8) a pair at similarity
0.85 is missed with probability 2e-6, and pairs far below rarely meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hand_back, let, step_table, words

BANDS, MISSED = 60, 5e-6  # rows per band: as many as keep the chance to miss a link at the threshold below MISSED
REGISTERS = 600
ESTIMATED = 240       # registers kept for the estimate
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
SLACK = 0.12          # an estimate this far below the threshold (5 standard errors) drops a pair
_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = _RANDOM.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BAND = _RANDOM.integers(0, 1 << 63, (BANDS, REGISTERS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rows_per_band(percent: int) -> int:
    return max(r for r in range(1, REGISTERS // BANDS + 1) if r == 1 or (1 - (percent / 100) ** r) ** BANDS <= MISSED)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 ``data``, A-Z lowered."""
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    # a word's hash sums a random value for each of its bytes at its place, so that no repetition in a word cancels out
    place = np.arange(len(raw), dtype=np.uint64)
    place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(raw)))).astype(np.uint64)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_mixed(_BYTE[raw] + place * _PLACE), out=sums[1:])
    h = _mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    width = min(width, len(h))
    s = h[:len(h) - width + 1].copy()
    for k in range(1, width):
        s = _mixed(s) * np.uint64(3) + h[k:len(h) - width + 1 + k]
    return np.unique(_mixed(s + np.uint64(width)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set, drawn from the upper half of each hash: 32 bits resolve
    sets of up to some 4 million shingles; beyond, equal registers only become more frequent."""
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(upper), 512):
        least = np.minimum(least, (upper[at:at + 512, None] * _FACTOR + _OFFSET).min(axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates of rows of registers with known set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * top[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    same = np.clip(1 - more - less, 1e-12, 1)
    like = up[:, None] * np.log(more) + down[:, None] * np.log(less) + (a.shape[1] - up - down)[:, None] * np.log(same)
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


def shingle_set(text: Column, width: int) -> Column:
    """Distinct 64-bit shingle hashes as array<bigint>, by built-in functions (for the confirmation)."""
    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)]))
        whole = F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))
        return F.when(F.size(w) >= width, F.array_distinct(each)).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return let(words(ascii_lower(F.coalesce(text, F.lit("")))), hashes)


def sketches(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Step table: id, key, n, cls (hash of the set; null if empty), bands, regs."""
    per_band = rows_per_band(percent)

    def sketch(batches):
        for batch in batches:
            out = []
            for key, body in zip(batch["key"], batch["body"]):
                h = shingle_hashes(body.encode(), width)
                if not len(h):
                    out.append((key, 0, None, None, None))
                    continue
                r = registers(h)
                bands = _mixed((_BAND[:, :per_band] * (r.reshape(BANDS, -1)[:, :per_band].astype(np.uint64) + np.uint64(1))).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
                out.append((key, len(h), hashlib.md5(h.tobytes()).digest(), bands.view(np.int64), r[:ESTIMATED].tobytes()))
            yield pd.DataFrame(out, columns=["key", "n", "cls", "bands", "regs"])
            del out
            hand_back()
    return step_table(rows.select("key", "body").mapInPandas(sketch, "key string, n long, cls binary, bands array<long>, regs binary"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b), root the smallest node of its component: stars
    around ever smaller neighbours, one written table a round, until nothing changes."""
    edges = step_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = step_table(small.where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, key (hash of id and text), n_shingles, component_id, kept.

    Texts are linked when 100 * shared shingles >= percent * all shingles of both. component_id is the
    smallest id reachable by links. Texts with fewer words than ``width`` are one shingle of all their
    words; null and empty texts have none and are linked with nothing. Rows that repeat an id are
    judged by their own texts. A null id counts as no id: it is its own component unless linked with
    one. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body)))
    rows = docs.select(F.col(doc_id).alias("id"), key.alias("key"), body.alias("body"))
    drawn = sketches(rows, width, percent)
    ids = rows.select("id", "key").dropDuplicates(["key"])
    linked = drawn.where("cls is not null")
    classes = linked.groupBy("cls").agg(F.min("key").alias("key"))
    nodes = step_table(linked.dropDuplicates(["key"]).join(classes, ["cls", "key"]))
    buckets = nodes.select("cls", "n", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = buckets.join(sizes, "band")
    degree = shared.groupBy("cls").agg(F.sum("size").alias("degree"))
    placed = step_table(shared.select("band", "cls", "n").join(degree, "cls"))

    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    centre = placed.groupBy("band").agg(F.max(F.struct("degree", "cls", "n")).alias("c"))
    first = placed.join(centre, "band").where(F.col("c.cls") != F.col("cls")).groupBy("cls").agg(F.max("c").alias("c"), F.first("n").alias("nb"))
    first = first.select(F.col("c.cls").alias("a"), F.col("cls").alias("b"), F.col("c.n").alias("na"), "nb").where(near)
    tried = step_table(_likely(first, nodes, percent))
    links = step_table(_confirmed(tried, nodes, rows, width, percent))
    parts = components(links)

    labelled = placed.join(parts, F.col("cls") == F.col("node"), "left").select("band", "cls", "n", "degree", F.coalesce("root", "cls").alias("part"))
    open_bands = labelled.groupBy("band").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("size"),
        F.max(F.struct("degree", "cls", "n", "part")).alias("c")).where("p != q").select("band", "c", "size")
    centred = labelled.join(open_bands, "band").where(F.col("c.cls") != F.col("cls")).groupBy(F.col("c.cls").alias("a"), F.col("cls").alias("b")).agg(
        F.first("c.n").alias("na"), F.first("n").alias("nb"), F.first("c.part").alias("pa"), F.first("part").alias("pb"), F.max("size").alias("size"))
    centred = step_table(centred)
    rest = centred.where((F.col("pa") != F.col("pb")) & near).select("a", "b", "na", "nb").unionByName(
        _differing(centred.where("size > 2"), nodes, rows, width, percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                       F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = step_table(_likely(rest.join(done, ["a", "b"], "left_anti"), nodes, percent))
    parts = components(links.unionByName(_confirmed(rest, nodes, rows, width, percent)))

    # One class or component may hold a third of all rows: ids shrink to one per class before they
    # meet, and rows read theirs from a written table, so that a skewed join can be split.
    member = linked.select("key", "cls").dropDuplicates(["key"]).join(ids, "key")
    least = member.groupBy("cls").agg(F.min("id").alias("id")).join(parts, F.col("cls") == F.col("node"), "left")
    rooted = step_table(least.select("cls", F.coalesce("root", "cls").alias("root"), "id"))
    smallest = step_table(rooted.groupBy("root").agg(F.min("id").alias("component_id")))
    named = step_table(rooted.join(smallest, "root").select("cls", "component_id"))
    named = member.join(named, "cls").select("key", "component_id")
    out = rows.select("id", "key").join(drawn.select("key", "n").dropDuplicates(["key"]), "key").join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), "key", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose joint estimate does not rule out the threshold."""
    least = percent / 100 - SLACK

    @F.pandas_udf("double")
    def similarity(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=float)
        a, b = (np.frombuffer(b"".join(s), dtype="<u2").reshape(len(s), -1) for s in (ra, rb))
        out = [estimate(a[i:i + 500], b[i:i + 500], na.values[i:i + 500].astype(float), nb.values[i:i + 500].astype(float)) for i in range(0, len(a), 500)]
        return pd.Series(np.concatenate(out))

    regs = nodes.select("cls", "regs")
    both = pairs.join(regs.select(F.col("cls").alias("a"), F.col("regs").alias("ra")), "a").join(
        regs.select(F.col("cls").alias("b"), F.col("regs").alias("rb")), "b")
    return both.where(similarity("ra", "rb", "na", "nb") >= least).select("a", "b")


def _paired_sets(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(a, b, set_a, set) of the pairs. Only texts that stand in a pair are read into sets; each pair
    moves the set of b to that of a."""
    named = nodes.select("cls", "key")
    wanted = pairs.select("a", "b").unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    wanted = wanted.join(named, wanted["b"] == named["cls"]).select("a", "b", "key")
    texts = rows.select("key", "body").join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sets = texts.select("key", shingle_set(F.col("body"), width).alias("set"))
    held = step_table(wanted.join(sets, "key").select("a", "b", "set"))
    return held.where("a != b").join(held.where("a = b").select("a", F.col("set").alias("set_a")), "a")


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on the full shingle sets."""
    shared = F.size(F.array_intersect("set", "set_a"))
    return _paired_sets(pairs, nodes, rows, width).select(
        "a", "b", shared.alias("s"), (F.size("set") + F.size("set_a") - shared).alias("u")).where(
        100 * F.col("s") >= percent * F.col("u")).select("a", "b")


def _differing(centred: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of members of different parts of one centre's buckets that can be linked.

    ``centred`` gives centre a and member b. Let D be the symmetric difference of a member's set and
    the centre's. A pair x, y is linked if and only if 100 + percent times |x ^ y| is at most 100 -
    percent times |x| + |y|, and |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|. Were Dx and Dy disjoint, both x
    and y would be linked to the centre, so one part; hence every pair wanted here shares
    ``excess(x) + excess(y)`` over ``2 (100 + percent)`` items of D, and one at least. Items stand in
    one order for all members of a centre (added ones first, as few members share them), so
    only a prefix of D is joined, and a shared item counts only if enough items follow it on both sides.
    """
    up, down = 100 + percent, 100 - percent
    sets = _paired_sets(centred, nodes, rows, width).join(centred.select("a", "b", "pb"), ["a", "b"])
    items = F.concat(F.sort_array(F.array_except("set", "set_a")), F.sort_array(F.array_except("set_a", "set")))
    sets = sets.select(F.col("a").alias("centre"), F.col("b").alias("cls"), F.col("pb").alias("part"), F.size("set").cast("long").alias("n"), items.alias("items"))
    excess = up * F.size("items") - down * F.col("n")
    least = F.greatest(F.lit(1), F.ceil((excess - down * F.col("n") * 100 / percent) / up - 1e-6))
    sets = sets.select("centre", "cls", "part", "n", excess.alias("excess"), F.size("items").alias("size"), F.posexplode(
        F.slice("items", F.lit(1), F.greatest(F.lit(0), F.size("items") - least + 1).cast("int"))).alias("at", "item"))
    sets = step_table(sets.select("centre", "item", "cls", "part", "n", "excess", (F.col("size") - F.col("at")).alias("left")))
    x, y = (sets.select("centre", "item", *[F.col(c).alias(c + side) for c in ("cls", "part", "n", "excess", "left")]) for side in "xy")
    fits = (F.col("clsx") < F.col("clsy")) & (F.col("partx") != F.col("party")) & (
        F.col("excessx") + F.col("excessy") <= 2 * up * F.least("leftx", "lefty")) & (
        100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return x.join(y, ["centre", "item"]).where(fits).select(
        F.col("clsx").alias("a"), F.col("clsy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb")).distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns as they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    kept = near_groups(docs, doc_id, text, width, percent).where("kept").select("key").distinct()
    return rows.join(kept, "key", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
