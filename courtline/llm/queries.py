"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe_reuse import encode_documents
from . import conversations
from .common import A_TO_Z, a_to_z, read
from .exact_dedup import exact_groups
from . import html_extract
from .licenses import FILE_PERCENT, TEMPLATES, TERM, THRESHOLD, license_scan
from .line_dedup import line_dedup_report
from . import mixing
from .near_dedup import near_groups
from .packing import pack
from .pii import KINDS, find_spans, spans_text
from .quality import DEPLETED_PERCENT, LINE_MAX_PERCENT, LINE_MIN_DOCS, quality_rules
from .toxicity import fit, score
from . import vector_codes

WORD_SPLIT = r"string_split_regex(%s, '[\x20\x09-\x0D]+')"
LOWER = f"translate(%s, '{A_TO_Z}', '{a_to_z}')"
NORMAL_LINE = "trim(regexp_replace(" + LOWER + r", '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


def sql_words(x: str) -> str:
    return "[w FOR w IN " + WORD_SPLIT % x + " IF w <> '']"


def op1_quality_rules(spark, sf_dir):
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words",
                      "base_failed", "kept")


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k FROM documents),
w AS (SELECT doc_id, {sql_words('t')} AS ws FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, k, unnest(string_split(t, chr(10))) AS raw FROM d),
l AS (SELECT doc_id, source, k, raw, len({sql_words('raw')}) AS nw, md5({NORMAL_LINE % 'raw'}) AS h
      FROM ln WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM l GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT k) AS n FROM l GROUP BY source),
freq AS (SELECT l.source, h FROM l JOIN host ON l.source IS NOT DISTINCT FROM host.source
         GROUP BY l.source, h, host.n
         HAVING count(DISTINCT k) > {LINE_MIN_DOCS} AND count(DISTINCT k) * 100.0 > host.n * {LINE_MAX_PERCENT}),
lost AS (SELECT doc_id, sum(nw) AS n_lost_words FROM l JOIN freq ON l.source IS NOT DISTINCT FROM freq.source AND l.h = freq.h
         GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
      FROM d JOIN w USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT 100 * (n_words - n_lost_words) < {DEPLETED_PERCENT} * n_words AS kept
FROM o"""


def op2_html_extraction(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op3_license_scan(spark, sf_dir):
    """The table has no paths: a document's is source/lang/bucket/doc_id, so directories nest; a null is an empty name."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in (
        F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 50).cast("string"), F.col("doc_id").cast("string"))])
    out = license_scan(docs.select(path.alias("path"), "text"))
    return out.select(F.element_at(F.split("path", "/"), -1).try_cast("long").alias("doc_id"), "path", "license", "score", "origin", "via")


def _op3_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{notice}')" for i, (name, notice) in enumerate(TEMPLATES))
    found = f"regexp_extract_all({LOWER}, '{TERM}')"
    return rf"""
WITH f AS (SELECT concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(CAST(doc_id // 50 AS VARCHAR), ''), coalesce(CAST(doc_id AS VARCHAR), '')) AS path, coalesce(text, '') AS t FROM documents),
tm(template, license, notice) AS (VALUES {rows}),
tt AS (SELECT template, license, t, count(*) AS n FROM (SELECT template, license, unnest({found % 'notice'}) AS t FROM tm) GROUP BY ALL),
total AS (SELECT count(*) AS total FROM f),
df AS (SELECT t, count(*) AS n FROM (SELECT DISTINCT path, unnest({found % 't'}) AS t FROM f) WHERE t IN (SELECT t FROM tt) GROUP BY t),
idf AS (SELECT v.t, ln((total + 1.0) / (coalesce(df.n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT t FROM tt) v LEFT JOIN df USING (t), total),
w AS (SELECT template, license, tt.t, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS w FROM tt JOIN idf USING (t)),
ln AS (SELECT path, i - 1 AS pos, ls[i] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i
       FROM (SELECT path, string_split(t, chr(10)) AS ls FROM f)) WHERE regexp_matches(ls[i], '[^ 	-
]')),
lt AS (SELECT path, pos, t, count(*) AS n FROM (SELECT path, pos, unnest({found % 'line'}) AS t FROM ln) GROUP BY ALL),
lw AS (SELECT path, pos, lt.t, n * coalesce(idf, ln(total + 1.0) + 1) AS x FROM lt LEFT JOIN idf USING (t), total),
nm AS (SELECT path, pos, sqrt(sum(x * x)) AS norm FROM lw GROUP BY path, pos),
sc AS (SELECT path, pos, template, license, round(sum(x * w / norm), 6) AS score
       FROM lw JOIN w USING (t) JOIN nm USING (path, pos) GROUP BY ALL HAVING round(sum(x * w / norm), 6) >= {THRESHOLD}),
own AS (SELECT path, license, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS r FROM sc) WHERE r = 1),
lf AS (SELECT path FROM (SELECT path, sum(len({sql_words('line')})) AS hit FROM ln WHERE (path, pos) IN (SELECT path, pos FROM sc) GROUP BY path)
       JOIN f USING (path) WHERE 100 * hit >= {FILE_PERCENT} * len({sql_words('t')})),
dl AS (SELECT dir, license, score FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, score,
       row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, license) AS r FROM own JOIN lf USING (path)) WHERE r = 1),
inh AS (SELECT path, license, score, dir FROM (SELECT f.path, dl.license, dl.score, dl.dir,
        row_number() OVER (PARTITION BY f.path ORDER BY length(dl.dir) DESC) AS r
        FROM f JOIN dl ON dl.dir = '' OR starts_with(f.path, dl.dir || '/')) WHERE r = 1)
SELECT TRY_CAST(string_split(f.path, '/')[-1] AS BIGINT) AS doc_id, f.path, coalesce(own.license, inh.license) AS license,
       coalesce(own.score, inh.score) AS score,
       CASE WHEN own.path IS NOT NULL THEN 'header' WHEN inh.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.path IS NOT NULL THEN regexp_replace(f.path, '/?[^/]*$', '') ELSE inh.dir END AS via
FROM f LEFT JOIN own USING (path) LEFT JOIN inh USING (path)"""


def op4_bpe_reuse(spark, sf_dir):
    out = encode_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup_report(read(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k FROM documents),
every AS (SELECT doc_id, k, i, ls[i] AS raw FROM (SELECT doc_id, k, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT doc_id, k, string_split(t, chr(10)) AS ls FROM d))),
l AS (SELECT doc_id, k, i, {NORMAL_LINE % 'raw'} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
      FROM every WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
win AS (SELECT a.doc_id, a.k, a.n, a.i, md5(a.line || chr(10) || b.line || chr(10) || c.line) AS h
        FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN l c ON a.doc_id = c.doc_id AND c.n = a.n + 2),
later AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY h ORDER BY doc_id, k, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN later w ON l.doc_id = w.doc_id AND l.n BETWEEN w.n AND w.n + 2),
kept AS (SELECT e.doc_id, string_agg(raw, chr(10) ORDER BY i) AS t
         FROM every e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.i = e.i) GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN d.t
                   WHEN regexp_matches(coalesce(kept.t, ''), '[^\x20\x09-\x0D]') THEN kept.t ELSE '' END) AS text_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op6_packing(spark, sf_dir):
    out = pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_near_dedup(spark, sf_dir):
    out = near_groups(read(spark, sf_dir, "documents"), width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op8_pii(spark, sf_dir):
    out = find_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select("doc_id", *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH n AS (SELECT doc_id, {LOWER % "coalesce(text, '')"} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""


def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op11_mixing(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def _op11_sql() -> str:
    most, block, shard = mixing.MAX_REPEATS, mixing.BLOCK_WORDS, mixing.SHARD_DOCS
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len({sql_words("coalesce(text, '')")}) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT d.*, CAST('0x' || substr(place, 1, 8) AS BIGINT) % shards AS shard
      FROM d, (SELECT greatest(1, (count(*) + {shard - 1}) // {shard}) AS shards FROM documents)),
cell AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE greatest(1, (words + {block // 2}) // {block}) END AS blocks
         FROM (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words FROM s GROUP BY source, shard)),
src AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) AS source_blocks FROM cell GROUP BY source),
w AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
             {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM src),
f AS (SELECT *, CAST({most} * source_size AS DOUBLE) / weight AS full_at FROM w),
lv AS (SELECT *, (total * {mixing.BUDGET_PERCENT / 100} - coalesce(sum({most} * source_size) OVER (ORDER BY full_at, source NULLS LAST {earlier}), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST {earlier}), 0)) AS lvl FROM f),
t AS (SELECT source, source_size, source_blocks, CASE WHEN full_at <= fill THEN CAST({most} * source_size AS DOUBLE) ELSE fill * weight END AS target
      FROM lv, (SELECT max(lvl) AS fill FROM lv)),
v AS (SELECT *, target >= {most} * source_size AS filled, CASE WHEN source_size = 0 THEN 0 ELSE target * source_blocks / source_size END AS votes FROM t),
quo AS (SELECT source, votes / (2 * k + 1) AS q FROM (SELECT *, unnest(range(0, CAST(votes AS BIGINT) + (SELECT count(*) FROM v) + 1)) AS k
                                                     FROM v WHERE NOT filled AND votes > 0)),
won AS (SELECT source, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS r FROM quo)
        WHERE r <= (SELECT round(sum(votes)) FROM v WHERE NOT filled) GROUP BY source),
sq AS (SELECT v.*, CASE WHEN filled THEN {most} * source_blocks ELSE least(coalesce(n, 0), {most} * source_blocks) END AS source_quota
       FROM v LEFT JOIN won ON v.source IS NOT DISTINCT FROM won.source),
cquo AS (SELECT source, shard, source_quota, blocks / (2 * k + 1) AS q
         FROM (SELECT cell.*, source_quota, unnest(range(0, {most} * blocks + 3)) AS k
               FROM cell JOIN sq ON cell.source IS NOT DISTINCT FROM sq.source WHERE blocks > 0)),
cwon AS (SELECT source, shard, count(*) AS n
         FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS r FROM cquo) WHERE r <= source_quota GROUP BY source, shard),
cq AS (SELECT cell.*, least(coalesce(n, 0), {most} * blocks) AS quota,
              CASE WHEN blocks = 0 THEN 0 ELSE CAST('0x' || substr(md5('mix:' || coalesce(cell.source, '') || ':' || cell.shard), 1, 8) AS BIGINT) % blocks END AS skip
       FROM cell LEFT JOIN cwon ON cell.source IS NOT DISTINCT FROM cwon.source AND cell.shard = cwon.shard),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size {earlier}), 0) AS start FROM s),
p AS (SELECT doc_id, laid.source, size, source_size, target, laid.shard, start, CASE WHEN blocks = 0 THEN 0 ELSE quota // blocks END AS whole,
             CASE WHEN blocks = 0 THEN 0 ELSE skip * words // blocks END AS a,
             CASE WHEN blocks = 0 THEN 0 ELSE least(skip + quota % blocks, blocks) * words // blocks END AS b,
             CASE WHEN blocks = 0 THEN 0 ELSE greatest(skip + quota % blocks - blocks, 0) * words // blocks END AS c
      FROM laid JOIN cq ON laid.source IS NOT DISTINCT FROM cq.source AND laid.shard = cq.shard
      JOIN sq ON laid.source IS NOT DISTINCT FROM sq.source)
SELECT doc_id, size, source_size, target, source, CAST(shard AS BIGINT) AS shard,
       CAST(whole * size + least(greatest(c - start, 0), size) + least(greatest(b - start, 0), size) - least(greatest(a - start, 0), size) AS BIGINT) AS taken
FROM p"""


def op12_conversations(spark, sf_dir):
    return conversations.repair(read(spark, sf_dir, "conversations"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """All distances of all parts to all entries, round by round; for tables whose vectors are of one width."""
    n, most = vector_codes.PARTS, vector_codes.ENTRIES
    text = f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
       FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {n} + 1 : (part + 1) * len(v) // {n}] AS v FROM k, range({n}) AS r(part)),
b0 AS MATERIALIZED (SELECT part, entry, parts.v FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM k) USING (rid) WHERE entry < {most}),"""
    for i in range(vector_codes.ROUNDS + 1):
        text += f"""
a{i} AS MATERIALIZED (SELECT rid, part, min(struct_pack(d := d, entry := entry)) AS m
        FROM (SELECT rid, p.part, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
              FROM parts p JOIN b{i} b USING (part)) GROUP BY rid, part),"""
        if i < vector_codes.ROUNDS:
            text += f"""
s{i} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT part, m.entry AS entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{i} JOIN parts USING (rid, part)) GROUP BY ALL),
n{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s{i} GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n USING (part, entry)),"""
    return text + f"""
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS}),
codes AS (SELECT rid, string_agg(lpad(lower(hex(m.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{vector_codes.ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN codes USING (rid), books"""


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, OP1_SQL),
    "op2_html_extraction": (op2_html_extraction, None),
    "op3_license_scan": (op3_license_scan, _op3_sql()),
    "op4_bpe_reuse": (op4_bpe_reuse, None),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_packing": (op6_packing, None),
    "op7_near_dedup": (op7_near_dedup, None),
    "op8_pii": (op8_pii, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_mixing": (op11_mixing, _op11_sql()),
    "op12_conversations": (op12_conversations, None),
    "op13_vector_codes": (op13_vector_codes, _op13_sql()),
    "pipeline": (pipeline, None),
}
