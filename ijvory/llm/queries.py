"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ijvory.llm import decontam, fingerprints, html_extract, langid, manifest, mixing, pii, simhash, spelling, suffix_dedup, token_counts, topk, toxicity
from ijvory.llm.common import LOWER, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""
WITH RECURSIVE
  src AS (SELECT coalesce(source, '') AS source, count(*) AS m FROM documents GROUP BY 1),
  sh AS (SELECT source, (m + 3) // 4 AS n, greatest(1, round(sqrt(m / (SELECT sum(m) FROM src)::DOUBLE) * 100))::BIGINT AS q FROM src),
  rk AS (SELECT *, row_number() OVER (ORDER BY n / q, source) - 1 AS rnk FROM sh),
  ph AS (SELECT e.rnk AS phase, x.source, x.rnk, x.q, coalesce((x.q * p.n) // p.q, 0) AS first, (x.q * e.n) // e.q AS last
         FROM rk e JOIN rk x ON x.rnk >= e.rnk LEFT JOIN rk p ON p.rnk = e.rnk - 1),
  sz AS (SELECT phase, sum(q)::BIGINT AS slots, max((last - first + q - 1) // q) AS periods FROM ph GROUP BY 1),
  bs AS (SELECT phase, slots, coalesce(sum(slots * periods) OVER (ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM sz),
  live AS (SELECT phase, rnk, q, slots FROM ph JOIN bs USING (phase) WHERE last > first),
  st AS (SELECT phase, sum(q)::BIGINT AS h, list(rnk ORDER BY rnk) AS rs, list(q ORDER BY rnk) AS qs, list(0::BIGINT ORDER BY rnk) AS zero FROM live GROUP BY phase),
  sim(phase, t, h, rs, qs, done, k) AS (
    SELECT phase, -1::BIGINT, h, rs, qs, zero, 0::BIGINT FROM st
    UNION ALL
    SELECT phase, t + 1, h, rs, qs, list_transform(range(1, len(qs) + 1), lambda i: CASE WHEN i = best THEN done[i] + 1 ELSE done[i] END), best
    FROM (SELECT *, list_sort(list_transform(range(1, len(qs) + 1), lambda i: {
            'd': CASE WHEN done[i] < qs[i] AND (done[i] * h) // qs[i] <= t + 1
                      THEN ((done[i] + 1) * h + qs[i] - 1) // qs[i] ELSE 4611686018427387904 END, 'i': i}))[1].i AS best
          FROM sim WHERE t < h - 1)),
  tn AS (SELECT phase, rs[k] AS rnk, done[k] - 1 AS turn, t AS slot FROM sim WHERE t >= 0),
  d AS (SELECT doc_id, coalesce(source, '') AS source,
               row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS at FROM documents)
SELECT d.doc_id, d.source, d.at // 4 AS block, d.at % 4 AS place, ph.phase::INT AS phase,
       bs.base + ((d.at // 4 - ph.first) // ph.q) * bs.slots + tn.slot AS slot
FROM d JOIN ph ON ph.source = d.source AND d.at // 4 >= ph.first AND d.at // 4 < ph.last JOIN bs ON bs.phase = ph.phase
     JOIN tn ON tn.phase = ph.phase AND tn.rnk = ph.rnk AND tn.turn = (d.at // 4 - ph.first) % ph.q""")
def op1_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mix of its sources."""
    return mixing.mix(documents(spark, sf_dir))


def _listed(spans: str):
    """kind:start:end of an array of spans, joined by commas."""
    kind = F.array(*[F.lit(k) for k in pii.KINDS])
    part = lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = pii.personal_data(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[: pii.BASE])]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


_TOKENS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{LOWER.upper()}', '{LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS ws FROM documents),
     b AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
     bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win
            FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k
                  FROM b WHERE len(ws) > 0)),
     dw AS (SELECT r, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win
            FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS k
                  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
     hit AS (SELECT r, k, dw.n, item_id FROM dw JOIN bw USING (n, win)),
     cov AS (SELECT r, count(DISTINCT p) AS n_hit
             FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
     its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
             FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)""")
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a ten-word run of a benchmark item."""
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q) AS copy FROM v WHERE vec_id % 50 = 0),
     s AS (SELECT a.vec_id AS query_id, copy, b.vec_id,
                  list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
           FROM a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, 5)


def held_out():
    """Whether a document of ``doc_id`` is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query()
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: The public vocabulary that op8 counts with; the driver reads it and sends its pieces to the tasks.
VOCABULARY = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), token_counts.Vocabulary.of_sentencepiece(vocabulary))


@query()
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of low quality and of toxicity for every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = toxicity.fit(docs, labels, ["low_quality", "toxic"]).score(docs)
    return scored.withColumn("toxic", F.col("p_toxic") > 0.5)


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 50-byte strings of smaller documents."""
    return suffix_dedup.removed_bytes(documents(spark, sf_dir))


#: DuckDB has no CRC-32: one step of it by a table of its 256 bytes, made from the polynomial.
_CRC = """
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS t FROM range(256) r(b))"""


def _crc32(blob: str) -> str:
    """SQL for the unsigned CRC-32 of ASCII or Latin-1 letters' UTF-8 bytes, beside the table ``crc``."""
    code = f"list_transform(string_split({blob}, ''), lambda c: ord(c))"
    octets = f"flatten(list_transform({code}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + u // 64, 128 + u % 64] END))"
    step = "xor(c // 256, t[xor(c % 256, b::BIGINT) + 1])"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


@query(f"""
WITH RECURSIVE {_CRC},
  runs AS (SELECT doc_id, translate(run, '{LOWER.upper()}', '{LOWER}') AS run, count(*) AS m
           FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2),
  hashed AS (SELECT run, m, {_crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc WHERE doc_id IS NOT NULL
             UNION ALL SELECT run, m, 1 FROM runs WHERE doc_id IS NULL),
  v AS (SELECT w AS word, sum(m)::BIGINT AS n
        FROM (SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w FROM hashed)
        WHERE length(w) >= 5 GROUP BY 1 HAVING sum(m) >= 3),
  del AS (SELECT DISTINCT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM v)),
  near AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.p = b.p AND a.d = b.d AND a.word <> b.word
           UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.d = b.word
           UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.d = b.word),
  best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM near GROUP BY 1),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.m = top) END AS form,
               CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
  up(word, pos) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.pos WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.pos AS root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f g ON g.word = up.pos WHERE g.form IS NULL""")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the spelling that each is a variant of."""
    return spelling.spelling_variants(documents(spark, sf_dir))


_SIZED = {c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in manifest.FIELDS}
_LEAF = "sha256({})".format(" || ".join(_SIZED.values()))
_OTHER = "sha256({})".format(" || ".join((_SIZED | {"n_chars": _SIZED["n_chars"].replace("n_chars", "(n_chars + 1)")}).values()))


@query(f"""
WITH RECURSIVE {_CRC},
  leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree,
                  CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN other ELSE leaf END AS checked
           FROM (SELECT doc_id, lang, {_LEAF} AS leaf, {_OTHER} AS other FROM documents), crc),
  node(tree, level, pos, h, n) AS (
    SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaf
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max((n + 1) // 2) FROM node WHERE n > 1 GROUP BY tree, level, pos // 2),
  sub AS (SELECT tree AS pos, h FROM node WHERE n = 1),
  top(level, pos, h, n) AS (
    SELECT 0, pos, h, count(*) OVER () FROM sub
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max((n + 1) // 2) FROM top WHERE n > 1 GROUP BY level, pos // 2),
  path(doc_id, leaf, tree, level, pos, h, sib) AS (
    SELECT doc_id, leaf, tree, 0, pos, checked, '' FROM leaf
    UNION ALL
    SELECT p.doc_id, p.leaf, p.tree, p.level + 1, p.pos // 2,
           sha256(CASE WHEN x.h IS NULL THEN p.h WHEN p.pos % 2 = 0 THEN p.h || x.h ELSE x.h || p.h END), p.sib || coalesce(x.h, '')
    FROM path p JOIN node o ON o.tree = p.tree AND o.level = p.level AND o.pos = p.pos AND o.n > 1
         LEFT JOIN node x ON x.tree = p.tree AND x.level = p.level AND x.pos = xor(p.pos, 1)),
  low AS (SELECT p.* FROM path p JOIN node o ON o.tree = p.tree AND o.level = p.level AND o.n = 1),
  over_(doc_id, leaf, tree, level, pos, h, sib) AS (
    SELECT doc_id, leaf, tree, 0, tree, h, sib FROM low
    UNION ALL
    SELECT p.doc_id, p.leaf, p.tree, p.level + 1, p.pos // 2,
           sha256(CASE WHEN x.h IS NULL THEN p.h WHEN p.pos % 2 = 0 THEN p.h || x.h ELSE x.h || p.h END), p.sib || coalesce(x.h, '')
    FROM over_ p JOIN top o ON o.level = p.level AND o.pos = p.pos AND o.n > 1 LEFT JOIN top x ON x.level = p.level AND x.pos = xor(p.pos, 1))
SELECT p.doc_id, p.leaf, sub.h AS subroot, r.h AS root, sha256(p.sib) AS proof_sha256, p.h AS folded_root, p.h = r.h AS verified
FROM over_ p JOIN top r ON r.n = 1 AND p.level = r.level JOIN sub ON sub.pos = p.tree""")
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document in a Merkle tree by language, and the check of tampered ones."""
    return manifest.manifest(documents(spark, sf_dir))


@query()
def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with another end, and how near they and the next document are."""
    found = fingerprints.compared_to_next(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.listed(F.col("fp")).alias("fingerprint"), fingerprints.listed(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next", "alike_edited", "alike_next",
    )
