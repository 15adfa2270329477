"""Each operator on a fixture of edge cases (nulls, empty and long texts, ties, repeated rows, clashing
column names), on an empty table, and against brute force."""
import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import bpe_reuse, common, exact_dedup, html_extract, licenses, line_dedup, near_dedup, packing, pii, quality, toxicity
from courtline.llm.tokens import codec, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, key string, spans string, score double"
random.seed(4)
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = ["".join(random.choices("abcdefgé", k=random.randint(2, 7))) for _ in range(400)]


def prose(n, per_line=12):
    w = random.choices(VOCAB, k=n)
    return "\n".join(" ".join(w[i:i + per_line]) for i in range(0, n, per_line))


BASE = prose(150)
SHARED = "\n".join(prose(60).split("\n"))


@lru_cache
def rows():
    texts = [BASE, BASE, BASE.upper(), BASE.replace(VOCAB[0], "changed"), prose(100) + "\n" + SHARED, prose(90) + "\n" + SHARED + "\n" + prose(20),
             None, "", " \n\t ", "one", "one two", "a a a a a a a", prose(20000), "x" * 50000, "1" * 30000,
             "mail bob@example.com now", "card 4111 1111 1111 1111 ok +1 (555) 010-9999", "10.0.0.1 and 300.1.1.1", "<|endoftext|> tail  <|endof",
             "tabs\tand  spaces \r\n end ", "Released under the MIT License.", prose(60)]
    out = [(i, t, "en", "h1" if i % 3 else None, None if t is None else len(t), 7, "k", "s", 0.5) for i, t in enumerate(texts)]
    out.append(out[4])                                                   # a repeated row
    out.append((5, "same id, another text " + prose(60), None, "h1", 3, None, None, None, None))
    out.append((None, BASE, None, None, None, None, None, None, None))   # no id
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(r):
    return r[1] or ""


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows()) and exact_dedup.exact_groups(empty).count() == 0
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for r in rows():
        groups[text_of(r).translate(lower)].append(r[0])
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in groups.items() for i in ids)
    assert want == sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got)


def test_exact_groups_separates_colliding_hashes(docs):
    weak = exact_dedup.exact_groups(docs, hash128=lambda c: F.length(c) % 2)
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_dedup.exact_groups(docs).collect()))


def brute_quality(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    ls = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(cover)


@pytest.mark.parametrize("few", [32, 0])
def test_quality_statistics(docs, empty, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW_WINDOWS", few)
    got = quality.quality_rules(docs).collect()
    assert quality.quality_rules(empty).count() == 0
    assert sorted(brute_quality(text_of(r)) for r in rows()) == sorted(
        (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)


def test_quality_removes_frequent_lines_and_depleted_documents(spark):
    common = "this line stands on every page"
    data = [(i, prose(80) + "\n" + common, "h") for i in range(30)]
    data += [(100, "\n".join([common] * 20), "h"), (101, "\n".join([common] * 20), "other")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.apply_quality_rules(docs, min_docs=20, max_percent=1.0).collect()}
    assert set(out) == set(range(30))
    assert all(common not in r.text and r.text.count("\n") == data[i][1].count("\n") - 1 for i, r in out.items())
    copies = spark.createDataFrame([(i, BASE, "h") for i in range(60)], "doc_id long, text string, source string")
    assert quality.quality_rules(copies, min_docs=20).where("kept").count() == 60  # copies are one document


def brute_lines(data):
    import hashlib as h
    order, seen, gone = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, h.md5(text_of(r).encode()).digest())), {}, defaultdict(set)
    for r in order:
        raw = text_of(r).split("\n")
        ls = [(i, " ".join(re.split("[\x20\x09-\x0d]+", x.strip(" \t\n\r\x0b\x0c"))).translate(ASCII_LOWER)) for i, x in enumerate(raw) if re.search("[^\x20\x09-\x0d]", x)]
        for k in range(len(ls) - 2):
            win, place = tuple(x for _, x in ls[k:k + 3]), (r[0], text_of(r), ls[k][0])
            if seen.setdefault(win, place) != place:
                gone[(r[0], text_of(r))].update(i for i, _ in ls[k:k + 3])
    out = []
    for r in data:
        g = gone[(r[0], text_of(r))]
        left = "\n".join(x for i, x in enumerate(text_of(r).split("\n")) if i not in g)
        out.append((str(r[0]), r[1] if not g else left if left.strip(" \t\n\r\x0b\x0c") else ""))
    return sorted(out, key=str)


def test_line_dedup(docs, empty):
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and line_dedup.line_dedup(empty).count() == 0
    assert sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str) == brute_lines(rows())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_path())


def test_codec_is_the_library(library):
    c = codec(default_path())
    parts = ["a", "é", "  ", " ", "\n", "\t", "\xa0", "'s", "'re", "1", "½", "<|endoftext|>", "<|endof", "!", "　", "日本", "\r\n", "\x1c", "́", "😀"]
    for _ in range(3000):
        t = "".join(random.choices(parts, k=random.randint(0, 25)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == ids and c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_splice_with_any_chunks_ready(monkeypatch):
    c = codec(default_path())
    monkeypatch.setattr(bpe_reuse, "MIN_CHUNK", 8)
    monkeypatch.setattr(bpe_reuse, "MEAN_CHUNK", 24)
    monkeypatch.setattr(bpe_reuse, "MAX_CHUNK", 64)
    parts = [" the", " don't", "é", "\n", "  ", "<|endoftext|>", "12", "日本語", "!", " a", "x", " word", "\t", "…"]
    for _ in range(400):
        t = "".join(random.choices(parts, k=random.randint(0, 200)))
        data, last, ready = t.encode(), 0, {}
        for k, end in enumerate(bpe_reuse.chunk_ends(data)):
            if random.random() < 0.5:
                ready[k] = c.encode(data[last:end].decode()).astype(c.narrow).tobytes()
            last = end
        assert last == len(data)
        assert bpe_reuse.splice(c, data, ready).tolist() == c.encode(t).tolist(), t


def test_encode_documents(docs, empty, library):
    got = bpe_reuse.encode_documents(docs).collect()
    assert bpe_reuse.encode_documents(empty).count() == 0
    want = []
    for r in rows():
        ids = library.encode(text_of(r), add_special_tokens=False).ids
        want.append((str(r[0]), np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(want) == sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in got)


def test_fill_is_optimal():
    for _ in range(200):
        counts = {random.randint(1, 40): random.randint(1, 3) for _ in range(random.randint(0, 6))}
        target = random.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        chosen = packing.fill(counts, target)
        assert all(v <= counts[k] for k, v in chosen.items())
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= target)


@pytest.mark.parametrize("counts", [{}, {2047: 5}, {1500: 1000}, {1100: 400, 3: 7}, {i: 1 + i % 5 for i in range(1, 2048, 3)}])
def test_plan_places_every_remainder_once(counts):
    plan, used = packing.Plan(counts), defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            at = 0
            for start, size, sequence, offset in plan.pieces(length, rank):
                assert start == at
                at += size
                used[sequence].append((offset, size))
            assert at == length
    total = sum(k * v for k, v in counts.items())
    assert len(used) == plan.sequences == -(-total // packing.WINDOW)
    for pieces in used.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= packing.WINDOW


def test_pack(docs, empty, library):
    got = packing.pack(docs).collect()
    assert packing.pack(empty).count() == 0
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[(str(r.doc_id), r.doc_tokens)].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1])
        assert sum(n for _, n in pieces) <= 2048
    want = sorted(np.append(library.encode(text_of(r), add_special_tokens=False).ids, 1).astype("<u4").tobytes() for r in rows())
    have = []
    for (_, n), pieces in by_doc.items():
        whole = b"".join(x for _, x in sorted(pieces))
        have += [whole] if len(whole) == 4 * n else [b"".join(x for _, x in sorted(pieces)[k::2]) for k in (0, 1)]  # a repeated row
    assert sorted(have) == want


def sets(t, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def test_words_that_cancel_out_in_polynomials_are_told_apart(spark):
    """Thue-Morse words of 1024 letters have equal polynomial hashes modulo 2^64 for every multiplier."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, f"{one} x y z"), (2, f"{two} x y z".replace("x y z", "p q r")), (3, one), (4, two)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert not np.intersect1d(near_dedup.shingle_hashes(one.encode(), 3), near_dedup.shingle_hashes(two.encode(), 3)).size


def test_near_groups_of_edited_copies(spark):
    """Copies of one text around the threshold: links that do not run through a bucket's centre are found too."""
    rng, texts = random.Random(11), []
    base = random.Random(12).choices(VOCAB, k=160)
    for i in range(90):
        version, own = list(base), random.Random(i % 9)
        for _ in range(i % 9):                                           # edits of a family of copies
            version[own.randrange(160)] = f"family{own.randrange(40)}"
        for _ in range(i % 4):                                           # and its own edits
            version[rng.randrange(160)] = f"own{rng.randrange(40)}"
        texts.append((i, " ".join(version)))
    sets = {i: {tuple(t.split()[k:k + 3]) for k in range(158)} for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for percent in (85, 92):
        root.update((i, i) for i in sets)
        for a in sets:
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
        got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), width=3, percent=percent).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}
        assert len({top(i) for i in sets}) > 1


def test_near_groups(spark, docs, empty):
    extra = []
    for k in range(60):  # a centre and copies, many of them not linked with each other
        w = BASE.split(" ")
        for _ in range(k % 4):
            w[random.randrange(len(w))] = random.choice(VOCAB)
        extra.append((1000 + k, " ".join(w), None, None, None, None, None, None, None))
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = near_dedup.near_groups(both, width=3, percent=85).collect()
    assert near_dedup.near_groups(empty).count() == 0
    data = rows() + extra
    s = [sets(text_of(r), 3) for r in data]
    root = list(range(len(data)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(data)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = sorted((str(r[0]), len(s[i]), str(low.get(find(i)))) for i, r in enumerate(data))
    assert want == sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)
    kept = near_dedup.near_dedup(both, width=3, percent=85)
    assert kept.columns == docs.columns


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        a = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        b = np.concatenate([a[:int(2000 * share)], rng.integers(0, 1 << 62, 2000 - int(2000 * share)).astype(np.uint64)])
        j = int(2000 * share) / (4000 - int(2000 * share))
        got = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([2000.0]), np.array([2000.0]))
        assert abs(got[0] - j) < 0.12


def brute_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    dig = lambda x: re.sub("[^0-9]", "", x)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(dig(m.group())) <= 19 and luhn(dig(m.group()))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(dig(m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_base_spans():
    parts = ["a", "b@", "c.de", "@", ".", "1", "25", "256", " ", "-", "+4", "4111111111111111", "(", ")", "é", "_x", "%", "007", "\n"]
    for _ in range(5000):
        t = "".join(random.choices(parts, k=random.randint(0, 18)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("9" * 200000) == []


def test_disclosing_terms_and_sanitise(spark, docs, empty):
    data = [(i, f"{VOCAB[i]} {VOCAB[i + 9]} please write agentfox at fox@secret.org or {VOCAB[i + 50]} {VOCAB[i + 70]} soon") for i in range(8)]
    data += [(100 + i, f"please write or call {prose(30)}") for i in range(200)]
    told = spark.createDataFrame(data, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(told).collect()}
    assert all("fox" not in out[i] and "[EMAIL]" in out[i] and "please write" in out[i] for i in range(8))
    assert all(out[i] == t for i, t in data[8:])
    found = pii.find_spans(docs).collect()
    assert len(found) == len(rows()) and pii.find_spans(empty).count() == 0
    assert sorted(str([(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"]) for r in found) == sorted(
        str(brute_spans(text_of(r)) if len(text_of(r)) < 30000 else []) for r in rows())
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows())


def test_sanitise_finds_terms_once(spark):
    docs = spark.createDataFrame([(1, "mail bob@example.com now"), (2, "plain"), (3, None)], "doc_id long, text string")
    out = pii.sanitise(docs)
    evaluated = re.findall(r"ArrowEvalPython \[(\w+)", out._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(evaluated) == ["marked", "replaced"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [EMAIL] now", 2: "plain", 3: None}


def test_freed_memory_goes_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    blocks = [bytearray(3000) for _ in range(40000)]
    last = blocks[-1]  # holds the end of the heap
    del blocks
    before = resident()
    common.hand_back()
    assert len(last) == 3000 and before - resident() > 60e6


def test_disclosing_terms_of_whole_documents(spark):
    """Terms far from the value, short ones and ones with digits go wherever they stand; two documents are enough."""
    far = lambda: prose(40).replace("\n", " ")
    data = [(i, f"Ng{i // 2} {far()} mail u{i // 2}@secret.org {far()} {far()} dept{i // 2}x then ng{i // 2}") for i in range(4)]
    data += [(50 + i, f"copied notice u9@secret.org hapaxword {BASE}") for i in range(3)]  # copies of one document
    data += [(100 + i, f"then mail {prose(60)}") for i in range(300)]
    out = defaultdict(str, {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(data, "doc_id long, text string")).collect()})
    for i in range(4):
        assert not re.search(r"(?i)ng[01]|dept|secret", out[i]) and "[EMAIL]" in out[i] and " mail " in out[i] and " then " in out[i]
    assert "copied notice [EMAIL] hapaxword" in out[50]
    assert all(out[i] == t for i, t in data[7:])


def test_toxicity_learns_and_handles_edges(spark, docs, empty):
    bad = ["grumblefink", "snotwaffle", "dunderpox"]
    data, marks = [], []
    for i in range(500):
        toxic = i % 5 == 0
        w = prose(80).split(" ")
        for _ in range(3 * toxic):
            w.insert(random.randrange(len(w)), random.choice(bad))
        data.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    table, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(rows()) and all(0 <= r.score <= 1 for r in edge)
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, none).count() == 0 and 0 <= none.score("") <= 1


def test_toxicity_learns_varied_vocabulary():
    """Wording too rare for any share floor: no mined string, but the trained dictionary knows it."""
    rng = random.Random(21)
    bad, parts = [], set()
    while len(bad) < 240:  # words that share no three letters
        word = "".join(rng.choices("hijklmnopqrstuvwxyz", k=9))
        own = {word[i:i + 3] for i in range(7)}
        if not own & parts:
            bad.append(word)
            parts |= own

    def text(*wording):
        w = rng.choices(VOCAB, k=80)
        for word in wording:
            w.insert(rng.randrange(len(w)), word)
        return " ".join(w)

    yes = sorted(text(*[bad[(6 * i + k) % 240] for k in range(6)]) for i in range(400))  # each word in 10 rows
    no = sorted(text() for _ in range(1000))
    assert toxicity.toxic_strings(yes, no) == []
    model = toxicity.Model(yes, no)
    assert sum(model.score(text(*rng.sample(bad, 6))) >= 0.5 for _ in range(200)) > 150
    assert sum(model.score(text()) >= 0.5 for _ in range(200)) < 50


def test_license_query_with_nulls(spark, tmp_path):
    from courtline.llm.queries import op3_license_scan
    rows = [(1, "Released under the MIT License.", "en", "a"), (None, "Released under the MIT License.", None, None), (3, None, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.path, r.license) for r in op3_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("a/en/0/1", "MIT"), None: ("///", "MIT"), 3: ("a//0/3", None)}


def test_license_scan(spark, empty):
    filler = prose(300)
    files = spark.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", filler), ("a/b/y.py", "Licensed under the Apache License, Version 2.0.\n" + filler),
        ("a/b/z.py", filler), ("c/w.py", None), ("c/d/COPYING", "Licensed under CC BY-NC 4.0."), ("c/d/e/f.py", ""), (None, filler),
        ("a/x.py", filler)], "path string, text string")
    got = {r.path: (r.license, r.origin, r.via) for r in licenses.license_scan(files).collect()}
    assert got == {"a/LICENSE": ("MIT", "header", "a"), "a/x.py": ("MIT", "inherited", "a"), "a/b/y.py": ("Apache-2.0", "header", "a/b"),
                   "a/b/z.py": ("MIT", "inherited", "a"), "c/w.py": (None, "none", None), "c/d/COPYING": ("CC-BY-NC-4.0", "header", "c/d"),
                   "c/d/e/f.py": ("CC-BY-NC-4.0", "inherited", "c/d"), "": (None, "none", None)}
    assert licenses.license_scan(empty.select(F.col("source").alias("path"), "text")).count() == 0


def test_license_terms_inside_other_words_cost_no_line(spark):
    wanted = {"use", "by-nc", "2.0", "c+d", "gnu"}
    inside = ["because reuse", "used users", "12.0 2.01", "agnu gnus", "by-nca", "caused\nhouse"]
    alone = ["USE", "a\nuse", "x.use.y", "(By-Nc)", "v2 2.0.", "éuseé", "c+d", "-gnu+", "reuse, use", "2.0-gnu", "c+ c+d"]
    rows = spark.createDataFrame([(t,) for t in inside + alone], "t string")
    got = {r.t: r.m for r in rows.select("t", licenses.may_hold(F.col("t"), wanted).alias("m")).collect()}
    assert got == {t: t in alone for t in inside + alone}
    # a term that stands in a line is never missed
    pieces = ["use", "GNU", "2.0", "by", "nc", "c", "d", "1", ".", "+", "-", " ", "\n", "é", "\u212a", "_"]
    made = spark.createDataFrame([("".join(random.choices(pieces, k=random.randint(1, 9))),) for _ in range(3000)], "t string")
    held = F.arrays_overlap(licenses.terms(F.col("t")), F.lit(sorted(wanted)))
    assert made.where(held & ~licenses.may_hold(F.col("t"), wanted)).count() == 0 < made.where(held).count()


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark.createDataFrame([], "page_id long, html string"))


def test_html_extraction(spark, trees):
    p = "<p>" + "A long sentence of the article, with some words. " * 6
    page = ("<html><body><nav class=menu><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class=ad>Buy now</div><article><h1>Title &amp; more</h1>"
            f"{p}{p}<p>One <b>bold\n  word</b> here<script>var x='<p>no</p>'</script></article><footer>&copy; site</footer></body></html>")
    body = ("A long sentence of the article, with some words. " * 6).strip()
    assert html_extract.main_text(page, trees) == "\n".join(["Title & more", body, body, "One bold word here"])
    rows = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (3, "", "", ""), (4, "u", "just text", "t"),
                                  (5, "u", "<div><p>" * 3000 + "deep" + "</b></p>", "t")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract(rows, trees).collect()}
    assert out[2].text == out[3].text == "" and out[4].text == "just text" and out[1].n_chars == len(out[1].text)


def test_html_head_without_end_tag(trees):
    p = "<p>" + "A long sentence of the article, with some words. " * 6
    body = ("A long sentence of the article, with some words. " * 6).strip()
    head = "<html><head><meta charset=utf-8>\n<title>Not this</title><style>p {}</style><script>var x = '<p>no</p>'</script>\n"
    for start in ("<body>", "</head><body>", "", "<head>", "</head>"):
        assert html_extract.main_text(f"{head}{start}<article>{p}{p}</article></html>", trees) == f"{body}\n{body}", start
    assert html_extract.main_text(head + "Bare text", trees) == "Bare text"


def test_html_made_pages(trees):
    right = total = 0
    for seed in range(50_000, 50_100):
        t, y = html_extract._made(seed)
        keep = set(html_extract.decode(t, trees.probability(html_extract.features(t))))
        leaves = [i for i in range(len(t.name)) if t.name[i] == "#text"]
        right += sum((i in keep) == bool(y[i]) for i in leaves)
        total += len(leaves)
        for i in keep:  # no kept leaf below a rejected node: decoding reaches it from the root
            assert t.name[i] == "#text"
    assert right / total > 0.95


def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = spark.createDataFrame(stage(spark, table, "").collect(), table.schema)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in table.collect()}
    assert 0 in kept and 1 in kept and 6 not in kept  # a copy becomes an empty text in the line dedup and stays
    assert corpus_pipeline.STAGES[-1][1](spark, table, "").count() >= table.count()
