"""Packing by minimum bin slack.

Each document (its ids and an end id) is cut at multiples of the window; what remains goes into a
multiset of lengths: at most ``window - 1`` counts, whatever the size of the table, and the only
thing the driver sees. The plan takes the largest remaining length and finds, with a bitset
subset-sum dynamic programme over the counts, the multiset that fills the window closest to
capacity; it is backtracked and applied as often as the counts allow. Where slack is left although
pieces remain, one further piece is cut to fill it and its rest returns to the multiset.

Tasks then look up the place of each remainder by its length and its rank among the remainders of
that length; ranks come from counts per file, so no length, however common, meets in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hand_back, step_table
from .tokens import codec, default_path

WINDOW = 2048
END_ID = 1


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """Multiset of the given lengths with the largest sum not above ``target``."""
    reach, steps = 1, []
    mask = (1 << (target + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > target or not counts[length]:
            continue
        steps.append((length, reach))
        left, part = min(counts[length], target // length), 1
        while left:
            part = min(part, left)
            reach |= reach << (part * length) & mask
            left, part = left - part, part * 2
        if reach >> target & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


class Plan:
    """``places[length]``: (first rank, copies per sequence, first sequence, offset, cut, rest rank)."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        self.places: dict[int, list[tuple]] = defaultdict(list)
        self.sequences = 0
        left = {k: v for k, v in counts.items() if v}
        taken: dict[int, int] = defaultdict(int)
        total: dict[int, int] = defaultdict(int, left)
        while left:
            top = max(left)
            rest = {k: v - (k == top) for k, v in left.items()}
            chosen = fill(rest, window - top)
            need = dict(chosen)
            need[top] = need.get(top, 0) + 1
            slack, cut = window - sum(k * v for k, v in need.items()), 0
            if slack:
                longer = [k for k in left if k > slack and left[k] > need.get(k, 0)]
                cut = max(longer, key=lambda k: (left[k] - need.get(k, 0), k)) if longer else 0
            uses = {k: need.get(k, 0) + (k == cut) for k in {*need, *([cut] if cut else [])}}
            times = min(left[k] // v for k, v in uses.items())
            offset = 0
            for k in sorted(need, reverse=True):
                self.places[k].append((taken[k], need[k], self.sequences, offset, 0, 0))
                taken[k] += need[k] * times
                offset += need[k] * k
            if cut:
                self.places[cut].append((taken[cut], 1, self.sequences, offset, slack, total[cut - slack]))
                taken[cut] += times
                total[cut - slack] += times
                left[cut - slack] = left.get(cut - slack, 0) + times
            for k, v in uses.items():
                left[k] -= v * times
            left = {k: v for k, v in left.items() if v}
            self.sequences += times
        self._starts = {k: [p[0] for p in v] for k, v in self.places.items()}

    def pieces(self, length: int, rank: int):
        """(start, length, sequence, offset) of each piece of the ``rank``-th remainder of ``length``."""
        start = 0
        while True:
            first, copies, sequence, offset, cut, rest = self.places[length][bisect_right(self._starts[length], rank) - 1]
            nth, slot = divmod(rank - first, copies)
            if not cut:
                yield start, length, sequence + nth, offset + slot * length
                return
            yield start, cut, sequence + nth, offset
            start, length, rank = start + cut, length - cut, rest + nth


def encode_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                 window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Step table: part, pos (unique row place), doc_id, n (ids with the end id), rest (n modulo
    window), nth (rank of the remainder in its part), full (full windows before it), ids (binary,
    unsigned 16-bit where the vocabulary allows)."""
    path = path or default_path()

    def encode(batches):
        c, part, pos, full = codec(path), TaskContext.get().partitionId(), 0, 0
        seen: dict[int, int] = defaultdict(int)
        wide = "<u2" if max(len(c.bytes_of), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            rows = []
            for key, body in zip(batch["doc_id"], batch["body"]):
                ids = np.append(c.encode(body), np.uint32(end_id)).astype(wide)
                n, rest = len(ids), len(ids) % window
                rows.append((part, pos, key, n, rest, seen[rest], full, ids.tobytes()))
                pos, full = pos + 1, full + n // window
                seen[rest] += 1
            out = pd.DataFrame(rows, columns=["part", "pos", "doc_id", "n", "rest", "nth", "full", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64") if whole else out["doc_id"]
            yield out
            del rows, out
            hand_back()

    kind = dict(docs.dtypes)[doc_id]
    whole = kind in ("bigint", "int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return step_table(rows.mapInPandas(encode, f"part long, pos long, doc_id {kind}, n long, rest long, nth long, full long, ids binary"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit).

    Null and empty texts are documents of one end id. Rows that repeat an id are documents of
    their own. Long texts yield as many full windows as they hold; the only sequence that may
    stay short is the last of the plan. An empty table yields no rows. Other columns are ignored.
    """
    table = encode_table(docs, doc_id, text, path, window, end_id)
    per_part = table.where("rest > 0").groupBy("rest", "part").agg(F.count(F.lit(1)).alias("here"))
    counts = {r["rest"]: r["total"] for r in per_part.groupBy("rest").agg(F.sum("here").alias("total")).collect()}
    plan = Plan(counts, window)  # at most window - 1 counts came to the driver
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("rest", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    kind = dict(table.dtypes)["doc_id"]
    whole = kind in ("bigint", "int")

    def emit(batches):
        for batch in batches:
            rows = []
            for part, key, n, rest, nth, full, raw, ahead in zip(*(batch[c] for c in (
                    "part", "doc_id", "n", "rest", "nth", "full", "ids", "before"))):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for w in range(n // window):
                    rows.append((key, w * window, window, n, (part + 1 << 40) + full + w, 0, ids[w * window:(w + 1) * window].tobytes()))
                if rest:
                    base = n - rest
                    for start, length, sequence, offset in plan.pieces(rest, int(ahead) + nth):
                        at = base + start
                        rows.append((key, at, length, n, sequence, offset, ids[at:at + length].tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64") if whole else out["doc_id"]
            yield out
            del rows, out
            hand_back()

    placed = table.join(starts, ["part", "rest"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return placed.mapInPandas(emit, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
