"""BPE with content-defined chunk reuse.

A rolling (gear) hash cuts each text into chunks whose borders depend on nearby bytes only, so a
passage shared by documents yields the same chunks in each. Chunks seen more than once are encoded
once, by the document that owns their first occurrence; the other documents receive the ids. What
no other document shares is encoded in place, run by run. At every join the text around it is
encoded again, in a window that grows until it agrees with both sides: on each side the window and
the side's own ids must have the same ids up to a quiet border, the place before a space with
no white space around it, where the split pattern always ends a token. So the spliced ids are
those of the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, step_table
from .tokens import Codec, codec, default_path

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 256, 1024, 8192
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
JOIN_BYTES = 48
_BLANK = frozenset(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")


def chunk_ends(data: bytes) -> list[int]:
    """End offsets of the chunks of UTF-8 ``data``; borders lie between characters."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear values of the last 32 bytes, each shifted by its age
        h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(22)) % np.uint32(MEAN_CHUNK - MIN_CHUNK) == 0) + 1).tolist() + [n]:
        while at - last > MAX_CHUNK:
            last = _between(data, last + MAX_CHUNK)
            ends.append(last)
        if at == n or at - last >= MIN_CHUNK:
            last = _between(data, at)
            if last != (ends[-1] if ends else 0):
                ends.append(last)
    return ends


def _between(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _quiet(data: bytes, at: int) -> bool:
    """Whether ``at`` lies before a space with ASCII other than white space on both sides."""
    return (0 < at < len(data) - 1 and data[at] == 32 and data[at - 1] < 128 and data[at + 1] < 128
            and data[at - 1] not in _BLANK and data[at + 1] not in _BLANK)


def join(c: Codec, left: np.ndarray, left_text: bytes, right: np.ndarray, right_text: bytes) -> np.ndarray:
    """Ids of ``left_text + right_text`` from the ids of both."""
    if not len(left) or not len(right):
        return right if not len(left) else left
    size = JOIN_BYTES
    left_ends, right_ends = np.cumsum(c.length_of[left]), np.cumsum(c.length_of[right])
    nl, nr = len(left_text), len(right_text)
    while True:
        a, b = _between(left_text, max(0, nl - size)), min(nr, size)
        while b < nr and right_text[b] & 0xC0 == 0x80:
            b += 1
        i, j = int(np.searchsorted(left_ends, a)), int(np.searchsorted(right_ends, b))
        # the first token border at or after a, the last at or before b, both between characters
        a_at, i = (0, 0) if a == 0 else (int(left_ends[i]), i + 1)
        b_at, j = (nr, len(right)) if b == nr else (int(right_ends[j - 1]) if j else 0, j)
        on_borders = (a_at >= nl or left_text[a_at] & 0xC0 != 0x80) and (b_at >= nr or right_text[b_at] & 0xC0 != 0x80)
        if on_borders:
            middle = left_text[a_at:] + right_text[:b_at]
            ids = c.encode(middle.decode())
            ends = np.cumsum(c.length_of[ids])
            ahead = a_at == 0 or _agrees(middle, ids, ends, left[i:], left_ends[i:] - a_at, nl - a_at, True)
            behind = b_at == nr or _agrees(middle, ids, ends, right[:j], right_ends[:j] + (nl - a_at), nl - a_at, False)
            if ahead and behind:
                return np.concatenate([left[:i], ids, right[j:]])
        size *= 2


def _agrees(middle: bytes, ids, ends, own, own_ends, border: int, before: bool) -> bool:
    """Whether the window and a side have the same ids from the window's edge up to a quiet border
    that lies inside that side's text."""
    m = min(len(ids), len(own))
    if before:
        for k in range(m):
            if ids[k] != own[k]:
                return False
            at = int(ends[k])
            if at >= border - 1:
                return False
            if _quiet(middle, at):
                return True
        return False
    for k in range(1, m + 1):
        if ids[-k] != own[-k]:
            return False
        at = int(ends[-k - 1]) if k < len(ids) else 0
        if at <= border:
            return False
        if _quiet(middle, at):
            return True
    return False


def splice(c: Codec, data: bytes, ready: dict[int, bytes]) -> np.ndarray:
    """Ids of the whole text, given those (as bytes) of some of its chunks by number."""
    ends = chunk_ends(data)
    if not ready:
        return c.encode(data.decode())
    runs: list[tuple[int, int, np.ndarray | None]] = []
    last = 0
    for k, end in enumerate(ends):
        ids = np.frombuffer(ready[k], dtype=c.narrow).astype("<u4") if k in ready else None
        if ids is None and runs and runs[-1][2] is None:
            runs[-1] = (runs[-1][0], end, None)
        else:
            runs.append((last, end, ids))
        last = end
    # the text so far is a list of finished ids and an open tail, so a join touches the last run only
    done: list[np.ndarray] = []
    tail = np.empty(0, dtype="<u4")
    tail_from = 0
    for start, end, ids in runs:
        own = c.encode(data[start:end].decode()) if ids is None else ids
        tail = join(c, tail, data[tail_from:start], own, data[start:end])
        keep = _last_quiet(c, tail, data, tail_from, end)
        if keep:
            done.append(tail[:keep[0]])
            tail, tail_from = tail[keep[0]:], keep[1]
    return np.concatenate([*done, tail]) if done else tail


def _last_quiet(c: Codec, ids: np.ndarray, data: bytes, start: int, end: int, margin: int = 4 * JOIN_BYTES):
    """(number of ids, offset) of a quiet token border at least ``margin`` bytes before ``end``."""
    borders = start + np.cumsum(c.length_of[ids])
    for k in range(int(np.searchsorted(borders, end - margin)) - 1, -1, -1):
        if _quiet(data, int(borders[k])):
            return k + 1, int(borders[k])
    return None


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (the text
    that the ids decode to).

    Null text counts as empty: no ids. Rows that repeat an id keep their own texts. Other columns are
    ignored. The texts are shuffled once, by the hash of the text, and both uses read that exchange.
    """
    path = path or default_path()
    kind = dict(docs.dtypes)[doc_id]
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(digest(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body))), F.lit(b""))
    plain = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), body.alias("body"))

    @F.pandas_udf("binary")
    def squeezed(bodies: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=9, write_checksum=False)
        return bodies.map(lambda x: z.compress(x.encode()))

    rows = plain.select("doc_id", "key", squeezed("body").alias("body"))  # what the exchange carries
    text_of = lambda raw: zstandard.decompress(raw)

    def cut(batches):
        for batch in batches:
            out = []
            for key, body in zip(batch["key"], batch["body"]):
                data, last = body.encode(), 0
                for k, end in enumerate(chunk_ends(data)):
                    out.append((key, k, _hash(data[last:end])))
                    last = end
            yield pd.DataFrame(out, columns=["key", "k", "chunk"])

    def encode_owned(batches):
        c = codec(path)
        for batch in batches:
            out = []
            for body, numbers in zip(batch["body"], batch["own"]):
                data = text_of(body)
                ends = [0, *chunk_ends(data)]
                for k in numbers:
                    piece = data[ends[k]:ends[k + 1]]
                    out.append((_hash(piece), c.encode(piece.decode()).astype(c.narrow).tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "ids"])

    def encode_all(batches):
        c = codec(path)
        for batch in batches:
            out = []
            for doc, body, got in zip(batch["doc_id"], batch["body"], batch["got"]):
                ids = splice(c, text_of(body), {} if got is None else {x["k"]: x["ids"] for x in got})
                out.append((doc, ids.tobytes(), c.decode(ids)))
            out = pd.DataFrame(out, columns=["doc_id", "ids", "decoded"])
            out["doc_id"] = out["doc_id"].astype("Int64") if kind in ("bigint", "int") else out["doc_id"]
            yield out

    pieces = step_table(plain.select("key", "body").mapInPandas(cut, "key binary, k int, chunk binary"))
    shared = pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "k")).alias("first")).where("n > 1")
    own = shared.select("first.key", "first.k").groupBy("key").agg(F.collect_set("k").alias("own"))
    ready = rows.join(own, "key").mapInPandas(encode_owned, "chunk binary, ids binary").dropDuplicates(["chunk"])
    got = pieces.join(ready, "chunk").groupBy("key").agg(F.collect_set(F.struct("k", "ids")).alias("got"))
    return rows.join(got, "key", "left").mapInPandas(encode_all, f"doc_id {kind}, ids binary, decoded string")
