"""The operators as registered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import collocations, decontamination, fingerprints, language_model, licences, mixing, order_minhash, personal_data, quotations, repair, secrets, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.licence_scan(docs, licences.train(docs))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal_data.personal_data(docs, personal_data.train_selector(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon, network, counts = language_model.fit(docs.filter(language_model.fold("doc_id") != language_model.HELD_OUT))
    held_out = F.coalesce(language_model.fold("doc_id") == language_model.HELD_OUT, F.lit(False))
    scored = language_model.score(docs, lexicon, network, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(_table(spark, sf_dir, "conversations"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_licences": op1_licences,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_source_mix": op4_source_mix,
    "op5_personal_data": op5_personal_data,
    "op6_decontamination": op6_decontamination,
    "op7_language_model": op7_language_model,
    "op10_fingerprints": op10_fingerprints,
    "op8_quotations": op8_quotations,
    "op9_order_minhash": op9_order_minhash,
    "op11_collocations": op11_collocations,
    "op12_secrets": op12_secrets,
    "op13_repair": op13_repair,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words"
)

SQL: dict[str, str] = {
    "op6_decontamination": f"""WITH
items AS (SELECT item_id, words, least(13, len(words)) AS k FROM (SELECT item_id, {_WORDS} FROM benchmark) WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS said
  FROM (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} FROM documents),
sizes AS (SELECT DISTINCT k FROM items),
doc_windows AS (
  SELECT r, k, i, array_to_string(words[i:i + k - 1], ' ') AS said
  FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, sizes WHERE len(words) >= k)),
hits AS (SELECT r, i, k, item_id FROM doc_windows JOIN item_windows USING (k, said)),
places AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hits) GROUP BY r),
found AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
  FROM hits WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r)""",
    "op11_collocations": r"""WITH
pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, 5)) AS size FROM worded),
placed AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized WHERE len(w) >= size),
counted AS (SELECT lang, size, w[i:i + size - 1] AS words, count(*) AS f FROM placed GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, words, f AS a FROM counted WHERE size >= 2 AND f >= 30),
cuts AS (SELECT lang, size, words, a, unnest(range(1, size)) AS k FROM candidates),
halves AS (
  SELECT c.lang, c.size, c.words, a, k, p.f AS l, q.f AS r, (2000000::HUGEINT * a // (p.f + q.f))::BIGINT AS score
  FROM cuts c JOIN counted p ON p.lang = c.lang AND p.words = c.words[1:k]
              JOIN counted q ON q.lang = c.lang AND q.words = c.words[k + 1:c.size]),
lowest AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
parts AS (
  SELECT lang, size, words, a, unnest(range(2, size)) AS part FROM candidates WHERE size > 2),
inner_parts AS (
  SELECT lang, a, words[i:i + part - 1] AS words
  FROM (SELECT lang, words, a, part, unnest(range(1, size - part + 2)) AS i FROM parts)),
longest AS (SELECT lang, words, max(a) AS held FROM inner_parts GROUP BY lang, words),
kept AS (
  SELECT x.lang, array_to_string(x.words, ' ') AS phrase, a, l, r, score
  FROM lowest x LEFT JOIN longest y ON x.lang = y.lang AND x.words = y.words
  WHERE held IS NULL OR 100 * held < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000""",
}
