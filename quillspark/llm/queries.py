"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, filter_audit, html_extract, language_id, license_scan, minhash_dedup, mixing, packing, paragraph_dedup, preferences, substring_dedup, topk_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.format_pairs(preferences.swapped_answers(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.select(F.col("id").alias("conv_id"), "prefix_turns", "prompt", "chosen_text", spans("chosen_spans").alias("chosen_spans"), "rejected_text", spans("rejected_spans").alias("rejected_spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    model = language_id.fit(docs.where(~out & F.col("lang").isNotNull()))
    return language_id.predict(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.paragraph_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's place in its source's tree: 0 to 3 levels down, by a hash of its id, in directories by its id div 2000 and coarser hashes
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).cast("binary"))
    level = lambda name, n: F.concat(F.lit(name), F.coalesce(n, F.lit(0)).cast("string"))
    levels = F.array(level("p", F.floor(F.col("doc_id") / 2000)), level("a", F.floor(h / 4) % 3), level("b", F.floor(h / 12) % 3))
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.slice(levels, 1, (h % 4).cast("int")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan.scan(files, "doc_id", "path", "text").withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = mixing.mix(table(spark, sf_dir, "documents"))
    own = docs.withColumn("source", F.col("members")[0])
    return own.join(F.broadcast(sources), own["source"].eqNullSafe(sources["source"])).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.fit(html_extract.labelled_pages(spark))
    texts = html_extract.extract(table(spark, sf_dir, "pages"), model)
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_preferences": op2_preferences,
        "op3_language_id": op3_language_id,
        "op4_packing": op4_packing,
        "op5_paragraph_dedup": op5_paragraph_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_topk_search": op8_topk_search,
        "op9_license_scan": op9_license_scan,
        "op10_mixing": op10_mixing,
        "op11_html_extract": op11_html_extract,
        "op12_collocations": op12_collocations,
        "op13_filter_audit": op13_filter_audit,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rendered(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"


def _spans(turns: str) -> str:
    head, body = "length(coalesce(t.role, 'unknown')) + 5", "length(coalesce(t.text, '')) + 8"
    to = f"CAST(coalesce(list_sum(list_transform(list_filter({turns}, lambda t, j: j <= i), lambda t: {head} + {body})), 0) AS BIGINT)"
    own = body.replace("t.text", f"{turns}[i].text")
    return f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), lambda i: ({to} - ({own})) || '-' || {to}), ',')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_preferences": f"""
            WITH t AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS id, CAST(turn AS BIGINT) AS place, role, text FROM conversations WHERE conv_id IS NOT NULL),
                 talks AS (SELECT id, list({{'role': role, 'text': text}} ORDER BY place NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM t GROUP BY id),
                 own AS (SELECT id, turns, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), len(turns) + 1) AS last FROM talks),
                 pairs AS (SELECT o.id, o.turns AS chosen, list_concat(list_filter(o.turns, lambda x, i: i < o.last),
                                  coalesce(list_filter(n.turns, lambda x, i: i = n.last), list_filter(o.turns, lambda x, i: false))) AS rejected
                           FROM own o LEFT JOIN own n ON n.id = xor(o.id, 1)),
                 cut AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1,
                                  least(len(chosen), len(rejected))) AS n FROM pairs),
                 part AS (SELECT id, n, list_filter(chosen, lambda x, i: i <= n) AS prompt, list_filter(chosen, lambda x, i: i > n) AS chosen, list_filter(rejected, lambda x, i: i > n) AS rejected FROM cut)
            SELECT id AS conv_id, CAST(n AS INTEGER) AS prefix_turns, {_rendered('prompt')} AS prompt, {_rendered('chosen')} AS chosen_text, {_spans('chosen')} AS chosen_spans,
                   {_rendered('rejected')} AS rejected_text, {_spans('rejected')} AS rejected_spans FROM part""",
        "op6_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256({LOWER}) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY {LOWER})""",
        "op8_topk_search": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                       FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
                         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
                       FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
                 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 10""",
        "op12_collocations": r"""
            WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
                 p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
                 g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
                 e AS (SELECT lang, w[i:i + k - 1] AS ws, k FROM g, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
                 f AS (SELECT lang, k, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS a FROM e GROUP BY lang, k, phrase),
                 n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
                 c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
                 x AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS cut FROM c),
                 s AS (SELECT x.lang, x.phrase, x.a, x.k, x.cut, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
                       FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1:], ' ')),
                 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
                 h AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
                 m AS (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY lang, phrase),
                 k AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * b.a),
                 q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
            SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000""",
        "op13_filter_audit": r"""
            WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
                 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
                 m AS (SELECT doc_id, part, CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
                              + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
                              + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask FROM w),
                 k AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
                 c AS (SELECT part, mask, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE good) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE toxic) AS BIGINT) AS toxic
                       FROM m LEFT JOIN k USING (doc_id) GROUP BY part, mask),
                 l AS (SELECT chr(65 + i) AS x, 1 << i AS bit FROM (SELECT unnest(range(0, 5))::INTEGER AS i)),
                 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
                       FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
                 s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
                 r AS (SELECT part, filter_order, step, bit,
                              coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
                              coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
                              coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
                              coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
                       FROM c, s GROUP BY part, filter_order, step, bit)
            SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
                   CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
    }
