"""The ``opN_<name>`` queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from passkit.llm import (conversations, debruijn, decontaminate, langid, licenses, line_templates, merkle, mixing, quality_crf,
                         quality_rules, sentencepiece_wfst, simhash, warc)
from passkit.llm.base import documents, ship

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark, sf_dir, **options):
            ship(spark)
            return fn(spark, sf_dir, **options)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS k FROM tri),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\t]*[-*•][\x20\t]')))::BIGINT AS n_bullet_lines,
        (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (5 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
        + 32 * (10 * n_bullet_lines > 9 * n_lines)::BIGINT + 64 * (2 * n_upper > word_chars)::BIGINT
        + 128 * (5 * n_exclamations > n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, failed_bits = 0 AS kept FROM f
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark, sf_dir):
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))
    base = quality_rules.Policy("base", quality_rules.BASE)
    return rows.withColumn("base_failed", rows["failed_bits"].bitwiseAND(base.mask) != 0)


@query("op8_simhash_bktree")
def op8_simhash_bktree(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op10_benchmark_wand")
def op10_benchmark_wand(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@query("op4_sentencepiece_wfst")
def op4_sentencepiece_wfst(spark, sf_dir, model_path=TOKENIZER):
    model = sentencepiece_wfst.compile_model(model_path)
    rows = sentencepiece_wfst.encode(documents(spark, sf_dir), model, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                       (F.replace("text", F.lit(sentencepiece_wfst.SPACE), F.lit(" ")) == F.col("decoded")).alias("lossless"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no, len(ls) AS n FROM
             (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, line_no, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
        '[^\x20\x09-\x0D]+') AS toks FROM l),
lines AS (SELECT *, array_to_string(toks, ' ') AS line, len(toks) AS n_tok, toks[1:2] AS lead FROM k WHERE len(toks) > 0),
per AS (SELECT DISTINCT doc_id, line, toks, n_tok, lead FROM lines WHERE n_tok >= 5),
leaves AS (SELECT n_tok, lead FROM lines WHERE n_tok >= 5 GROUP BY n_tok, lead HAVING count(DISTINCT line) > 1 AND count(*) >= 3),
held AS (SELECT line, toks, n_tok, lead, count(*) AS w FROM per JOIN leaves USING (n_tok, lead) GROUP BY ALL),
tok AS (SELECT n_tok, lead, line, w, unnest(toks) AS tok, unnest(range(len(toks))) AS p FROM held),
marked AS (SELECT *, sum(w) OVER (PARTITION BY n_tok, lead, p, tok) AS docs FROM tok),
parts AS (SELECT line, n_tok, lead, count(*) AS n, count(*) FILTER (WHERE docs >= 3) AS n_common,
            list_sort(list(docs) FILTER (WHERE docs >= 3), 'DESC')[ceil(0.8::DOUBLE * count(*))::BIGINT] AS part FROM marked GROUP BY line, n_tok, lead),
named AS (SELECT line, string_agg(CASE WHEN docs >= 3 AND docs >= 0.1::DOUBLE * part THEN tok ELSE '<*>' END, ' ' ORDER BY p) AS name
          FROM marked JOIN parts USING (line, n_tok, lead) WHERE n_common >= 0.8::DOUBLE * n GROUP BY line, n_tok, lead),
x AS (SELECT doc_id, line_no, coalesce(name, lines.line) AS t FROM lines LEFT JOIN named ON named.line = lines.line),
known AS (SELECT t, min(doc_id) AS first FROM x GROUP BY t HAVING count(DISTINCT doc_id) >= 3),
first AS (SELECT t, doc_id, min(line_no) AS line_no FROM x JOIN known USING (t) WHERE doc_id = first GROUP BY t, doc_id),
gone AS (SELECT x.doc_id, x.line_no FROM x JOIN first f USING (t) WHERE x.doc_id <> f.doc_id OR x.line_no <> f.line_no)
SELECT l.doc_id, max(l.n)::BIGINT AS n_lines, count(gone.line_no)::BIGINT AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE gone.line_no IS NULL), '') AS text
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line_no = l.line_no GROUP BY l.doc_id
"""


@query("op1_line_templates", OP1_SQL)
def op1_line_templates(spark, sf_dir):
    return line_templates.dedup(documents(spark, sf_dir)).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def _remainder(n: int):
    """crc32 of the id as text, mod n; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query("op5_crossparse_langid")
def op5_crossparse_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.learn(docs, _remainder(4) != 2)
    return langid.identify(docs, model).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op6_quality_crf")
def op6_quality_crf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality_crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _remainder(5) != 0)
    return quality_crf.score(docs, model).select(
        "doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


@query("op9_warc_segments", OP9_SQL)
def op9_warc_segments(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fields = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    rows = warc.round_trip(table, fields)
    return rows.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("type").alias("record_type"), F.col("refers_to_row").cast("long").alias("refers_to"))


@query("op7_debruijn_repeats")
def op7_debruijn_repeats(spark, sf_dir):
    return debruijn.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(k, *(x.replace("'", "''") for x in t)) for k, t in enumerate(licenses.TEMPLATES))
OP2_SQL = rf"""
WITH templates(k, licence, text) AS (VALUES {_TEMPLATE_ROWS}),
files AS (SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS dir, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, unnest(list_concat(
            list_transform(string_split(t, chr(10)), lambda x: struct_pack(x := x, line := true)),
            list_transform(list_filter(string_split_regex(t, '
[ 	
]*
'), lambda x: contains(trim(x, chr(10)), chr(10))),
                           lambda x: struct_pack(x := x, line := false)))) AS u FROM files),
units AS (SELECT doc_id, row_number() OVER () AS unit, u.line AS line, regexp_extract_all(lower(u.x), '[a-z0-9]+') AS terms FROM split),
held AS (SELECT * FROM units WHERE len(terms) > 0),
total AS (SELECT count(*) AS n FROM held),
tt AS (SELECT k, licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM held) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln((1 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM tt CROSS JOIN total LEFT JOIN df ON df.term = tt.term),
tw AS (SELECT k, licence, term, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (term) GROUP BY k, licence, term),
tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tw GROUP BY k),
tf AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest(terms) AS term FROM held) GROUP BY ALL),
w AS (SELECT doc_id, unit, tf.term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM tf CROSS JOIN total LEFT JOIN idf ON idf.term = tf.term),
norm AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
cos AS (SELECT w.unit, tw.k, tw.licence, round(sum(w.w * tw.w) / any_value(tn.norm) / any_value(norm.norm), 6) AS cosine
        FROM w JOIN tw USING (term) JOIN tn ON tn.k = tw.k JOIN norm ON norm.unit = w.unit GROUP BY w.unit, tw.k, tw.licence),
best AS (SELECT unit, arg_max(licence, struct_pack(c := cosine, k := -k)) AS licence, max(cosine) AS cosine FROM cos WHERE cosine >= 0.6 GROUP BY unit),
own AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS own_licences, max(cosine) AS best_cosine,
          sum(len(terms)) FILTER (WHERE line) AS line_terms FROM best JOIN held USING (unit) GROUP BY doc_id),
f AS (SELECT files.*, own_licences, best_cosine, own_licences IS NOT NULL AND 2 * line_terms >= len(regexp_extract_all(lower(t), '[a-z0-9]+')) AS gives
      FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT dir, string_agg(DISTINCT l, ',' ORDER BY l) AS licences FROM (SELECT dir, unnest(string_split(own_licences, ',')) AS l FROM f WHERE gives) GROUP BY dir),
up AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS up FROM (SELECT DISTINCT dir, unnest([0, 1, 2, 3]) AS depth FROM f)),
near AS (SELECT up.dir, arg_max(up.up, depth) AS inherited_from, arg_max(given.licences, depth) AS licences FROM up JOIN given ON given.dir = up.up GROUP BY up.dir)
SELECT doc_id, f.dir || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, own_licences, best_cosine,
  CASE WHEN own_licences IS NULL THEN near.inherited_from END AS inherited_from, coalesce(own_licences, near.licences) AS licences,
  CASE WHEN own_licences IS NOT NULL THEN 'own' WHEN near.licences IS NOT NULL THEN 'directory' ELSE 'none' END AS via
FROM f LEFT JOIN near ON near.dir = f.dir
"""


@query("op2_license_scan", OP2_SQL)
def op2_license_scan(spark, sf_dir):
    """The table has no paths: a document lies in source/lang/<last two digits of its id>/, as <id>.txt."""
    docs = documents(spark, sf_dir).withColumn("path", F.concat_ws(
        "/", F.col("source"), F.col("lang"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licenses.scan(docs, "path", "text", "doc_id")


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: each byte is XORed in, then eight shifts by the reversed polynomial."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))"
    folded = (f"list_reduce(list_concat([4294967295::BIGINT], {steps}), "
              "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)")
    return f"xor({folded}, 4294967295::BIGINT)"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]
_LEAF_SQL = "sha256(" + " || ".join(map(_field_sql, MANIFEST)) + ")"
_SHOWN_SQL = "sha256(" + " || ".join(_field_sql("n_chars + 1" if c == "n_chars" else c) for c in MANIFEST) + ")"
OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF_SQL} AS leaf,
        CASE WHEN ({_crc32_sql('CAST(doc_id AS VARCHAR)')}) % 7 = 0 THEN {_SHOWN_SQL} ELSE {_LEAF_SQL} END AS shown FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
low AS (SELECT lang, 0 AS level, pos, leaf AS h, n FROM base
        UNION ALL
        SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, level, pos // 2),
sub AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lpos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, lpos AS pos, subroot AS h, n FROM sub
        UNION ALL
        SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2),
steps AS (SELECT b.doc_id, b.leaf, l.level AS k, s.h AS sibling, (l.pos & 1) = 1 AS is_left FROM base b
          JOIN low l ON l.lang IS NOT DISTINCT FROM b.lang AND l.pos = b.pos >> l.level AND l.n > 1
          LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = l.level AND s.pos = xor(l.pos, 1)
          UNION ALL
          SELECT b.doc_id, b.leaf, 1000 + l.level, s.h, (l.pos & 1) = 1 FROM base b JOIN sub ON sub.lang IS NOT DISTINCT FROM b.lang
          JOIN high l ON l.pos = sub.lpos >> l.level AND l.n > 1
          LEFT JOIN high s ON s.level = l.level AND s.pos = xor(l.pos, 1)),
path AS (SELECT doc_id, leaf, list({{'sibling': coalesce(sibling, ''), 'is_left': is_left}} ORDER BY k) AS path FROM steps GROUP BY doc_id, leaf),
rows_ AS (SELECT b.doc_id, b.leaf, b.shown, sub.subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(path, []) AS path
          FROM base b JOIN sub ON sub.lang IS NOT DISTINCT FROM b.lang LEFT JOIN path ON path.doc_id IS NOT DISTINCT FROM b.doc_id AND path.leaf = b.leaf),
folded AS (SELECT doc_id, leaf, path, 1 AS k, shown AS h FROM rows_
          UNION ALL
          SELECT doc_id, leaf, path, k + 1, sha256(CASE WHEN path[k].is_left THEN path[k].sibling || h ELSE h || path[k].sibling END) FROM folded WHERE k <= len(path))
SELECT r.doc_id, r.leaf, subroot, root, sha256(array_to_string(list_transform(r.path, lambda s: s.sibling), '')) AS proof_sha256,
  f.h AS folded_root, f.h = root AS verified
FROM rows_ r JOIN folded f ON f.doc_id IS NOT DISTINCT FROM r.doc_id AND f.leaf = r.leaf AND f.k = len(r.path) + 1
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark, sf_dir):
    """Tampering: one character more where 7 divides the CRC-32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = [F.col(c) + F.when(hit, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in MANIFEST]
    rows = merkle.manifest(documents(spark, sf_dir), MANIFEST, shown=merkle.digest(shown))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


OP12_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    ({_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}) % 20 AS lot FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS again
  FROM c WHERE lot <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
f AS (SELECT *, left(role, 1) AS a, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
p AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND (before || a) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM p GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS i, '' AS q, {{'cost': 0::BIGINT, 'audit': '', 'rep': ''}} AS m FROM stats
  UNION ALL
  SELECT conv_id, i, q, min(m) FROM (
    SELECT x.conv_id, f.i, CASE e WHEN 'D' THEN x.q WHEN 'K' THEN f.a ELSE CASE WHEN x.q = 'u' THEN 'a' ELSE 'u' END END AS q,
      {{'cost': (cost + CASE e WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN e <> 'D' AND fault = 't' THEN 5 ELSE 0 END)::BIGINT, 'audit': audit || e,
        'rep': rep || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
                 ELSE chr(10) || CASE WHEN x.q = 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text END}} AS m
    FROM (SELECT conv_id, i, CASE k WHEN 0 THEN q WHEN 1 THEN CASE WHEN q = 'u' THEN 'a' ELSE 'u' END ELSE CASE WHEN q = 'u' THEN 'u' ELSE 'a' END END AS q,
            m.cost + 5 * k AS cost, m.audit || repeat('I', k) AS audit,
            m.rep || CASE k WHEN 0 THEN '' WHEN 1 THEN chr(10) || CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END
              ELSE chr(10) || CASE WHEN q = 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END END AS rep
          FROM dp, (VALUES (0), (1), (2)) t(k)) x
    JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1
    CROSS JOIN (VALUES ('D'), ('K'), ('R')) v(e)
    WHERE e = 'D' OR (fault NOT IN ('b', 'd') AND (e = 'R' OR (f.a = 's' AND x.q = '') OR (f.a = 'u' AND x.q <> 'u') OR (f.a = 'a' AND x.q = 'u'))))
  GROUP BY conv_id, i, q),
ends AS (SELECT dp.conv_id, min({{'cost': m.cost + CASE q WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, 'audit': m.audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    'rep': m.rep || CASE q WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END}}) AS m
  FROM dp JOIN stats s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.i GROUP BY dp.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.m.cost, 0)::BIGINT AS cost,
  coalesce(e.m.audit, '') AS audit, sha256(coalesce(substr(e.m.rep, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark, sf_dir):
    return conversations.repair(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ssize, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
s AS (SELECT *, number % {len(mixing.WEIGHTS)} + 1 AS w FROM s0),
lam AS (SELECT 0 AS round, sum(ssize)::DOUBLE / sum(w)::DOUBLE AS l FROM s
  UNION ALL
  SELECT round + 1, coalesce((SELECT ((SELECT sum(ssize) FROM s) - coalesce(sum({mixing.REPEATS} * ssize) FILTER ({mixing.REPEATS} * ssize < lam.l * w), 0))::DOUBLE
      / (sum(w) FILTER (NOT {mixing.REPEATS} * ssize < lam.l * w))::DOUBLE FROM s), lam.l)
  FROM lam WHERE round <= (SELECT count(*) FROM s)),
t AS (SELECT s.*, CASE WHEN {mixing.REPEATS} * ssize < l * w THEN ({mixing.REPEATS} * ssize)::DOUBLE ELSE l * w END AS target,
    least(ssize, greatest(ceil(ssize / {mixing.BLOCK_WORDS}.0), {mixing.LEAST_BLOCKS}))::BIGINT AS nb FROM s, (SELECT l FROM lam ORDER BY round DESC LIMIT 1)),
q AS (SELECT *, CASE WHEN ssize > 0 THEN least(nb * {mixing.REPEATS}, floor(target * nb / ssize + 0.5)::BIGINT) ELSE 0 END AS quota FROM t),
blocks AS (SELECT number, nb, quota, ssize, unnest(range(nb)) AS block FROM q WHERE ssize > 0),
lots AS (SELECT *, unnest(range((quota + nb - 1) // nb)) AS copy FROM blocks WHERE quota > 0),
ranked AS (SELECT number, block, copy * nb + row_number() OVER (PARTITION BY number, copy ORDER BY md5('{mixing.SEED}/' || number || '/' || copy || '/' || block), block) - 1 AS draw, quota FROM lots),
taken AS (SELECT number, block, count(*) AS copies FROM ranked WHERE draw < quota GROUP BY ALL),
spans AS (SELECT number, block, block * (ssize // nb) + least(block, ssize % nb) AS b, (block + 1) * (ssize // nb) + least(block + 1, ssize % nb) AS e FROM blocks),
placed AS (SELECT d.*, q.number, q.ssize, q.target, sum(size) OVER (PARTITION BY q.number ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop
  FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source),
got AS (SELECT p.doc_id, p.number, p.stop, sum((least(p.stop, e) - greatest(p.stop - p.size, b)) * copies) AS taken
  FROM placed p JOIN spans x ON x.number = p.number AND x.b < p.stop AND x.e > p.stop - p.size JOIN taken k ON k.number = x.number AND k.block = x.block GROUP BY ALL)
SELECT p.doc_id, p.size, p.ssize AS source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN got g ON p.size > 0 AND g.doc_id IS NOT DISTINCT FROM p.doc_id AND g.number = p.number AND g.stop = p.stop
"""


@query("op13_source_mix", OP13_SQL)
def op13_source_mix(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
