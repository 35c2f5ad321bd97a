"""Registered queries of the operators; each reads its whole table.

``QUERIES``: name -> (spark, sf_dir) -> DataFrame. ``ORACLE``: DuckDB SQL for
those that SQL can express. The digest columns a query returns are derived
from its operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import (conversation_repair, decontamination, fingerprints, licenses, mixing, near_dedup, periodic_runs, pii, secrets,
                      sentencepiece_codec, token_counts, toxicity, url_filter)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    lengths = token_counts.document_lengths(table(spark, sf_dir, "documents").select("text"))
    return token_counts.context_limits(token_counts.length_histogram(lengths))


@query("op2_mixing", """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(r % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS ratio,
             coalesce(sum(cap) OVER x, 0) AS caps, coalesce(sum(w) OVER x, 0) AS ws,
             1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w
      FROM w WINDOW x AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - caps) / (all_w - ws)) AS level FROM f WHERE (budget - caps) / (all_w - ws) <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM f, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.u,
             CASE WHEN t.source_size > 0 THEN least(2.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
""")
def op2_mixing(spark, sf_dir):
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    scanned, spans = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(spans, lambda s: s["rank"] < 3)

    def n(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    def joined(xs):
        return F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return scanned.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                          F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


@query("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    return near_dedup.assign_classes(table(spark, sf_dir, "documents"))


@query("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "alias")


@query("op6_pii")
def op6_pii(spark, sf_dir):
    replaced, entities = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return replaced.select("doc_id", "text", F.col(entities).alias("entities"))


@query("op7_decontamination", """
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
               array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT dg.k, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
words AS (SELECT k, count(DISTINCT p) AS n_hit
          FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (k) LEFT JOIN items USING (k)
""")
def op7_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, (score, evidence) = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
                         (F.col(score) >= 0.5).cast("int").alias("predicted"), F.col(evidence).alias("evidence"))


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lookup = fingerprints.lexicon_lookup(fingerprints.lexicon(docs))
    own, fp = fingerprints.fingerprints(docs, lookup)
    pairs = fingerprints.with_next(own, ["text", fp])
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    out = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
                       F.col(fp).alias("own"), F.col(f"next_{fp}").alias("following"))
    out, changed = fingerprints.fingerprints(out, lookup, "edited")
    out = out.withColumnRenamed(changed, "changed")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      fingerprints.as_text(F.col("own")).alias("fingerprint"),
                      fingerprints.as_text(F.col("changed")).alias("edited_fingerprint"),
                      fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                      fingerprints.likeness(F.col("own"), F.col("following")).alias("near_next"))


@query("op10_licenses")
def op10_licenses(spark, sf_dir):
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    words, base = F.transform("base", lambda b: b["word"]), F.transform("base", lambda b: b["label"])
    found = F.transform("detections", lambda d: d["label"])
    score = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ",").alias("labels"),
        score.alias("score"))


@query("op11_sentencepiece")
def op11_sentencepiece(spark, sf_dir):
    out, coded = sentencepiece_codec.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", f"{coded}.*")


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    # a tenth of the documents get a stretch that repeats; only their words are taken apart here
    cut = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    cut = cut.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(h / 10))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    cycles = F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")),
                            F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.flatten(cycles)),
                      F.lit(1), F.col("n").cast("int"))
    docs = cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    out, summary = periodic_runs.summaries(docs)
    return out.select("doc_id", f"{summary}.*")


@query("op13_conversation_repair", """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::UBIGINT],
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT)),
             lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
               lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 20 AS h
  FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM c)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
o AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
             regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM e),
r AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
                     WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal,
             count(*) AS n FROM r GROUP BY conv_id),
ins(q, via, edits, lines, price) AS (VALUES
  (0, 0, '', []::VARCHAR[], 0), (1, 1, '', [], 0), (2, 2, '', [], 0), (3, 3, '', [], 0),
  (0, 2, 'I', ['user:'], 3), (1, 2, 'I', ['user:'], 3), (2, 3, 'I', ['assistant:'], 3), (3, 2, 'I', ['user:'], 3),
  (0, 3, 'II', ['user:', 'assistant:'], 6), (1, 3, 'II', ['user:', 'assistant:'], 6),
  (2, 2, 'II', ['assistant:', 'user:'], 6), (3, 3, 'II', ['user:', 'assistant:'], 6)),
act(via, edit, wants, behind) AS (VALUES
  (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3),
  (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
  (0, 'R', 'user', 2), (1, 'R', 'user', 2), (2, 'R', 'assistant', 3), (3, 'R', 'user', 2)),
steps AS (SELECT ins.q, ins.edits || act.edit AS edits, ins.lines, ins.price, act.* FROM ins JOIN act USING (via)),
best AS (
  SELECT n.conv_id, n.n + 1 AS i, ins.q, min({'cost': ins.price, 'audit': ins.edits, 'out': ins.lines}) AS s
  FROM n, ins WHERE ins.via IN (0, 3) GROUP BY n.conv_id, n.n, ins.q
  UNION ALL
  SELECT r.conv_id, r.i, t.q, min({
           'cost': (s).cost + t.price + CASE t.edit WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END
                   + CASE WHEN t.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
           'audit': t.edits || (s).audit,
           'out': t.lines || CASE t.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [t.wants || ':' || r.text] END || (s).out})
  FROM best JOIN r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i - 1
  JOIN steps t ON t.behind = best.q
   AND (t.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (t.edit = 'R' OR t.wants = r.initial))
  GROUP BY r.conv_id, r.i, t.q)
SELECT k.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate,
       coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0)::BIGINT AS illegal,
       coalesce((b.s).cost, 0)::BIGINT AS cost, coalesce((b.s).audit, '') AS audit,
       sha256(coalesce(array_to_string((b.s).out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM k.conv_id AND b.i = 1 AND b.q = 0
""")
def op13_conversation_repair(spark, sf_dir):
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = table(spark, sf_dir, "conversations").withColumn(
        "h", F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20)
    damaged = rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(filled("role")).alias("role"),
        F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text")).alias("text"),
        (F.col("h") > 0).alias("stays"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return conversation_repair.summaries(damaged, F.col("stays"))
