"""The corpus operators as queries over the given tables, and their SQL equivalents where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import chat, embeddings, exact_dedup, fill_middle, line_dedup, merkle, mixing, packing, personal_data
from paceline.llm import quality, secret_scan, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Rows with this remainder of their id's CRC are held out of every fit.
FOLDS = 5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def as_alerts(documents: DataFrame) -> DataFrame:
    """Documents in the columns of the alert log: a source stands for a camera, a language for a zone of it."""
    return documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("notes"), F.col("source").alias("stream_id"),
        F.col("lang").alias("zone_id"))


def documents(s: SparkSession, d: str) -> DataFrame:
    return as_alerts(s.read.parquet(f"{d}/documents.parquet"))


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def training_labels(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/labels.parquet").filter(~held_out("doc_id")).withColumnRenamed("doc_id", "id")


@query
def op1_line_dedup(s, d):
    out = line_dedup.drop_repeated_lines(documents(s, d).select("id", "notes"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("notes", 256).alias("kept_sha256"))


@query
def op2_secret_scan(s, d):
    def text(span):
        return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))

    out = secret_scan.scan_secrets(documents(s, d))
    base = F.filter("spans", lambda span: span["kind"] != "live")
    return out.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), "n_added", "n_live", "n_copied")


@query
def op3_simhash_near_dedup(s, d):
    return simhash.near_duplicates(documents(s, d), words=3).withColumnRenamed("id", "doc_id")


@query
def op4_toxicity(s, d):
    docs = documents(s, d)
    model = toxicity.fit_toxicity(docs, training_labels(s, d))
    return toxicity.score_toxicity(docs.select("id", "notes"), model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


@query
def op5_best_fit_packing(s, d):
    return packing.pack_notes(documents(s, d), tokenizer_path()).withColumnRenamed("id", "doc_id")


@query
def op6_quality(s, d):
    docs = documents(s, d)
    model = quality.fit_quality(docs, training_labels(s, d))
    return quality.score_quality(docs.select("id", "notes"), model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


#: A dialogue whose texts are made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op7_chat_format(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = s.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id bigint, turn bigint, role string, text string")
    both = turns.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    return chat.read_back(chat.format_dialogues(both))


@query
def op8_mixing(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("stream_id"), "n_chars")
    weights = mixing.tempered_weights(docs.select("stream_id"))
    return mixing.mix_streams(docs, weights).withColumnsRenamed({"id": "doc_id", "stream_id": "source"})


@query
def op9_embedding_near_dedup(s, d):
    vectors = s.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("label").alias("stream_id"), F.col("vec_id").alias("track_id"), "embedding")
    return embeddings.near_duplicate_embeddings(vectors).select(
        F.col("track_id").alias("vec_id"), "n_links", "component_id", "kept")


@query
def op10_exact_dedup(s, d):
    return exact_dedup.exact_duplicates(documents(s, d)).withColumnRenamed("id", "doc_id")


@query
def op11_fill_in_middle(s, d):
    out = fill_middle.fill_in_middle(documents(s, d))
    back = fill_middle.unfilled(F.col("filled"), F.col("form"))
    return out.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("filled", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query
def op12_personal_data(s, d):
    def text(span):
        return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))

    base = F.filter("spans", lambda span: span["kind"].isin(*personal_data.BASE))
    return personal_data.scan_personal_data(documents(s, d)).select(
        F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), "n_added",
        F.round(F.aggregate("spans", F.lit(0.0), lambda least, span: F.greatest(least, span["score"])), 3).alias("top_score"))


@query
def op13_merkle_manifest(s, d):
    fields = ("id", "stream_id", "zone_id", "density_count", "notes")
    alerts = s.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("source").alias("stream_id"), F.col("lang").alias("zone_id"),
        F.col("n_chars").alias("density_count"), F.col("text").alias("notes"))
    tampered = F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0
    bare = F.replace("notes", F.lit("\n"), F.lit(""))
    shown = alerts.withColumn("shown", merkle.leaf_digest([*fields[:-1], F.when(tampered, bare).otherwise(F.col("notes"))]))
    proof = F.col("proof")
    return merkle.manifest_proofs(shown, fields, carry=("shown",)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(proof), 256).alias("proof_sha256"),
        merkle.fold(F.col("shown"), proof).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# ---- the same in SQL

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

SQL["op1_line_dedup"] = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), {_UPPER}, {_LOWER}) AS k FROM lines),
held AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, pos, line, owner IS NOT NULL AND owner <> doc_id AS lost FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_ESCAPED = r"(length({0}) + (length({0}) - length(replace({0}, '\', '')))" + "".join(
    f" + (length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}"
    for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]")) + ")"

SQL["op7_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len("<|turn|><|text|><|end|>") + 1} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

_UNIFORM = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

SQL["op8_mixing"] = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * weight / (SELECT sum(weight) FROM counts) / n::DOUBLE AS rate
  FROM counts),
steps AS (
  SELECT source, rate, 0 AS k, 0.0::DOUBLE AS lg, exp(-rate) AS step FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lg + ln(rate / (k + 1)::DOUBLE), step + exp(lg + ln(rate / (k + 1)::DOUBLE) - rate)
  FROM steps WHERE k < ceil(rate + 12.0 * sqrt(rate) + 60.0)),
listed AS (SELECT source, list(step ORDER BY k) AS steps FROM steps GROUP BY source),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, len(list_filter(l.steps, lambda s: s <= {_UNIFORM.format("'42:' || d.doc_id")})) AS times
  FROM documents d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT * EXCLUDE (times), unnest(range(times))::INT AS copy FROM counted WHERE times > 0)
SELECT *, {_UNIFORM.format("'42+:' || doc_id || ':' || copy")} AS mix_key FROM copies
"""

SQL["op9_embedding_near_dedup"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
lengths AS (SELECT *, sqrt(list_inner_product(v, v)) AS size FROM vectors),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM lengths a JOIN lengths b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.93),
reach AS (
  SELECT a AS vec_id, a AS other FROM links
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component FROM reach GROUP BY vec_id),
numbers AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id,
  coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN numbers USING (vec_id)
"""

SQL["op10_exact_dedup"] = f"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), {_SPACES}, '') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM bare
"""

_DRAW = "('0x' || substr(sha256('1:' || doc_id), {0}, 8))::BIGINT"

SQL["op11_fill_in_middle"] = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4 FROM documents),
placed AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
    greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
pieces AS (
  SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m,
    array_to_string(tokens[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces
"""

_ITEM = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_HEAD = " || ".join(_ITEM.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# the checksum of the decimal number, bit by bit: its character comes with the first of every eight steps
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)))"""

SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_HEAD} || {_ITEM.format("text")}) AS leaf,
    sha256({_HEAD} || {_ITEM.format("CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS shown
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS size FROM leaves),
low AS (
  SELECT source, 0 AS level, place, size, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE size > 1 GROUP BY source, level, place // 3, size),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees
  FROM low WHERE size = 1),
high AS (
  SELECT 0 AS level, tree AS place, trees AS size, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE size > 1 GROUP BY level, place // 3, size),
low_beside AS (
  SELECT a.source, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM low a JOIN low b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.size > 1 GROUP BY a.source, a.level, a.place),
high_beside AS (
  SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.size > 1 GROUP BY a.level, a.place),
steps AS (
  SELECT p.source, p.doc_id, p.leaf, p.place AS spot, b.level AS step, b.l, b.r FROM placed p JOIN low_beside b
  ON p.source IS NOT DISTINCT FROM b.source AND p.place // pow(3, b.level)::BIGINT = b.place
  UNION ALL
  SELECT p.source, p.doc_id, p.leaf, p.place, 1000 + b.level, b.l, b.r FROM placed p JOIN subroots s
  ON p.source IS NOT DISTINCT FROM s.source JOIN high_beside b ON s.tree // pow(3, b.level)::BIGINT = b.place),
proofs AS (
  SELECT source, spot, string_agg(l || r, '' ORDER BY step) AS proof, list([l, r] ORDER BY step) AS ways
  FROM steps GROUP BY source, spot)
SELECT p.doc_id, p.leaf, s.subroot, h.digest AS root, sha256(coalesce(f.proof, '')) AS proof_sha256,
  list_reduce(list_prepend([p.shown, ''], coalesce(f.ways, [])), lambda x, w: [sha256(w[1] || x[1] || w[2]), ''])[1] AS folded_root,
  folded_root = h.digest AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN high h ON h.size = 1
LEFT JOIN proofs f ON p.source IS NOT DISTINCT FROM f.source AND p.place = f.spot
"""
