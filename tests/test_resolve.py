import random
import string

from pyspark.sql import functions as F

from courtline.operators import resolve
from courtline.sources import views
from courtline.sources.tables import Tables


def _bruteforce(src, hist, threshold):
    """The best partner per name among all pairs of a block, computed on the driver."""
    best = {}
    for r in resolve._block_scored(src, hist).collect():
        if r._score >= threshold:
            best[r.source_id] = min(best.get(r.source_id, (1, "", 0)), (-r._score, r.hname, r.hid))
    return [(i, hid, round(-score, 9)) for i, (score, _, hid) in best.items()]


def test_mapping_golden(spark):
    src = spark.createDataFrame([(101, "Rafael Nadal"), (201, "Camila Osorio"), (301, "Taylor Fritz")],
                                "source_id long, source_name string")
    hist = spark.createDataFrame([(1, "Rafael Nadal"), (3, "R. Federer"), (2, "Camilo Osorio"), (4, "Taylor Fritz"),
                                  (5, "Camila Osorio"), (6, "I. Swiatek")], "historical_id long, historical_name string")
    m = {r.source_id: r.historical_id for r in resolve.map_resolve(resolve.map_cascade(src, hist, checkpoint=False)).collect()}
    assert m == {101: 1, 201: 5, 301: 4}


def test_cascade_passes(spark):
    src = spark.createDataFrame([(1, "NOVAK-DJOKOVIC"), (2, "N Djokovic"), (3, "Alcaraz"), (4, "Jannik Sinnerr"),
                                 (5, "Zzz Unknown")], "source_id long, source_name string")
    hist = spark.createDataFrame([(10, "Novak Djokovic"), (20, "Carlos Alcaraz"), (30, "Jannik Sinner"),
                                  (40, "Nadia Djokovic")], "historical_id long, historical_name string")
    m = {r.source_id: (r.historical_id, r.method) for r in resolve.map_cascade(src, hist, checkpoint=False).collect()}
    assert m[1] == (10, "Exact-Cleaned")
    # 'N Djokovic' hits two historical rows once each: the guard (ids hit more than once) keeps both
    # candidates and resolution takes the smaller id
    assert m[2] == (10, "Initial+Lastname")
    assert m[3] == (20, "Unique Lastname")
    assert m[4][0] == 30 and m[4][1] == "Fuzzy"
    assert 5 not in m


def test_fuzzy_prefix_filter_equals_bruteforce(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    s, h = views.source_players(t), views.historical_players(t)
    for thr in (85.0, 70.0):
        a = sorted((r.source_id, r.historical_id, round(r.confidence, 9)) for r in resolve.map_fuzzy(s, h, thr).collect())
        b = sorted(_bruteforce(s, h, thr))
        assert a == b and len(a) > 0


def test_topk_candidates_and_corrections(spark):
    src = spark.createDataFrame([(1, "Carlos Alcaraz")], "source_id long, source_name string")
    hist = spark.createDataFrame([(20, "Carlos Alcaraz"), (21, "Carla Alcaraz"), (22, "Carlos Alcaras")],
                                 "historical_id long, historical_name string")
    top = resolve.topk_candidates(src, hist, k=2).orderBy("candidate_rank").collect()
    assert [r.candidate_id for r in top] == [20, 22]
    m = resolve.map_cascade(src, hist, checkpoint=False)
    corr = spark.createDataFrame([(1, 22, "Carlos Alcaras")], "source_id long, historical_id long, matched_name string")
    r = resolve.apply_corrections(m, corr).collect()[0]
    assert (r.historical_id, r.confidence, r.method) == (22, 100.0, "Manual Correction")


def test_topk_candidates_offer_names_under_every_floor(spark):
    src = spark.createDataFrame([(1, "Bo Karlsen"), (2, "Ann Kowal"), (3, "Zed Unique"), (4, "")], "source_id long, source_name string")
    names = ["Bo Karlsen", "Bob Karlsen", "Bo Carlsen", "Quentin Kuznetsov", "Anna Kowal", "Ann Kowalski", "Xi K", None]
    hist = spark.createDataFrame(list(enumerate(names)), "historical_id long, historical_name string")
    got = {(r.source_id, r.candidate_name, r.candidate_rank) for r in resolve.topk_candidates(src, hist, k=4).collect()}
    scored = resolve._block_scored(src, hist).collect()
    want = set()
    for i in (1, 2, 3, 4):
        mine = sorted((r for r in scored if r.source_id == i), key=lambda r: (-r._score, r.hname))[:4]
        want |= {(i, r.hname, n + 1) for n, r in enumerate(mine)}
    assert got == want and {i for i, _, _ in got} == {1, 2}


def test_pieces_find_every_pair_of_short_and_edited_names(spark):
    """Random names over a tiny alphabet, all lengths: every pair above the score, and no other."""
    rng = random.Random(7)

    def name():
        return " ".join("".join(rng.choice("abK") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3)))
    names = [name() for _ in range(250)]
    edited = []
    for n in names:
        c = list(n)
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(len(c))] = rng.choice(["", "a", "Kb", " "])
        edited.append("".join(c))
    src = spark.createDataFrame([(i, n) for i, n in enumerate(edited)] + [(900, edited[0]), (901, None), (902, " ")],
                                "source_id long, source_name string")
    hist = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(950, names[0]), (951, None)],
                                 "historical_id long, historical_name string")
    everything = resolve._block_scored(src, hist).select("source_id", "hname", "hid", "_score").collect()
    for score in (85.0, 60.0):
        got = sorted(tuple(r) for r in resolve.fuzzy_scored(src, hist, score).select("source_id", "hname", "hid", "_score").collect())
        want = sorted(tuple(r) for r in everything if r._score >= score)
        assert got == want and len(want) > 100


def test_pieces_leave_few_candidates(spark):
    """One block of 1000 names on each side: an edited name meets hardly any other than its own."""
    rng = random.Random(11)
    names = ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) + " K" + "".join(rng.choice(string.ascii_lowercase) for _ in range(9))
             for _ in range(1000)]
    h = spark.createDataFrame([(n, "K") for n in names], "hname string, _blk string")
    s = spark.createDataFrame([(n[:3] + "x" + n[4:], "K") for n in names], "sname string, _blk string")
    got = {tuple(r) for r in resolve._candidates(resolve._spellings(s, "sname"), resolve._spellings(h, "hname"), 0.15).collect()}
    assert {(n[:3] + "x" + n[4:], n) for n in names} <= got and len(got) < 0.01 * len(names) ** 2


def test_ids_that_share_a_name_are_compared_once(spark):
    src = spark.range(2000).selectExpr("id AS source_id", "'Jannik Sinnerr' AS source_name")
    hist = spark.createDataFrame([(30, "Jannik Sinner"), (31, "Jannik Sinner"), (40, "Jan Sinner")], "historical_id long, historical_name string")
    assert resolve._scored_names(src, hist, 85.0).count() == 1
    assert [tuple(r) for r in resolve.map_fuzzy(src, hist).groupBy("historical_id").count().collect()] == [(30, 2000)]
