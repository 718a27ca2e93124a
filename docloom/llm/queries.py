"""Driver queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import collocations, decontaminate, forest, jaccard, katz, packing, pieces, quality, repair, secrets, shards, url_trust, warc
from docloom.llm.common import prepare, read_table, staged, text_or_empty


def op1_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    records = warc.archive_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.resolved(records)


#: Base32 of the SHA-1 of ``html``: its 160 bits in groups of five, each a letter.
BASE32_SHA1 = """array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
  + 16 * substr(bits, i + 1, 1)::INT + 8 * substr(bits, i + 2, 1)::INT + 4 * substr(bits, i + 3, 1)::INT + 2 * substr(bits, i + 4, 1)::INT + substr(bits, i + 5, 1)::INT, 1)), '')"""
OP1_SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
named AS (SELECT page_id, payload_bytes, {BASE32_SHA1} AS payload_digest FROM hashed),
led AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS leader FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM led
"""


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = katz.fit(docs.where(~katz.held_out()))
    return katz.score(docs, model).select(
        "doc_id", katz.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.counts.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined(F.col("spans"), secrets.KINDS[:3])
    return spans.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return forest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.join_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""


def op6_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = pieces.round_trips(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", pieces.ids_digest().alias("ids_crc32"), "parity", (F.col("decoded") == text_or_empty()).alias("round_trip"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = staged(quality.with_statistics(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "statistics")
    labels = read_table(spark, sf_dir, "labels").where(quality.learnable()).select("doc_id", F.col("quality").alias("label"))
    return quality.scored(found, quality.fit(found, labels)).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = shards.external_shuffle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = text_or_empty()
    return out.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collocations.mine(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM words, (VALUES (1), (2), (3)) AS sizes(k)),
counted AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
cuts AS (SELECT c.lang, c.g, c.k, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM counted WHERE k > 1 AND f >= 10) c
  JOIN counted x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN counted y ON y.lang = c.lang AND y.g = c.g[j + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_ AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM counted WHERE k = 3 AND f >= 10),
kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = s.lang AND i.g = s.g AND 100 * i.f >= 50 * s.a)),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _op13_sql() -> str:
    """Cheapest repairs row by row: of each state (0 to 3, see ``repair``) the least (cost, audit, turns) so far, inserts closed over three times before and after each row."""
    states, least = range(4), lambda xs: xs[0] if len(xs) == 1 else f"list_min([{', '.join(xs)}])"
    way = lambda s, cost, letter, line="": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {f'list_append({s}.t, {line})' if line else f'{s}.t'}}}"

    def closed(source: str, kept: str) -> str:
        for _ in range(3):
            made = [least([f"s{t}", *(way(f"s{s}", repair.INSERT, "I", f"'{repair.ROLE[t]}:'") for s in repair.BEFORE[t])]) + f" AS s{t}" for t in states]
            source = f"(SELECT {kept}, {', '.join(made)} FROM {source})"
        return source

    def passed(t: int) -> str:
        kept = [f"CASE WHEN NOT must_go AND initial = '{i}' THEN {way(f's{s}', 'more', 'K', 'line')} END" for i, to in repair.KEPT.items() for s, end in to.items() if end == t]
        roled = [f"CASE WHEN NOT must_go THEN {way(f's{s}', f'{repair.REROLE} + more', 'R', f"'{repair.ROLE[t]}:' || text")} END" for s in repair.BEFORE[t]]
        return least([way(f"s{t}", repair.DELETE, "D"), *kept, *roled]) + f" AS s{t}"

    begin = ", ".join(f"{{'c': {0 if t == repair.START else 1_000_000_000}::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s{t}" for t in states)
    all_states = ", ".join(f"s{t}" for t in states)
    joined = f"(SELECT w.conv, w.i, {all_states}, initial, must_go, more, line, text FROM walk w JOIN rows r ON r.conv IS NOT DISTINCT FROM w.conv AND r.i = w.i + 1)"
    bit = "list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: {bit}), 4294967295)"
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
seen AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS known FROM placed),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN known THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
rows AS MATERIALIZED (SELECT conv, i, turn, role[1:1] AS initial, fault, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN {repair.TRUNCATED} ELSE 0 END AS more, role || ':' || text AS line, text,
  coalesce(lag(role[1:1]) OVER (PARTITION BY conv ORDER BY i) || role[1:1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal FROM rows GROUP BY conv),
walk AS (SELECT conv, 0::BIGINT AS i, {begin} FROM counts
  UNION ALL SELECT conv, i + 1, {", ".join(map(passed, states))} FROM {closed(joined, "conv, i, initial, must_go, more, line, text")}),
best AS (SELECT conv, list_min([s{repair.START}, s{repair.ASSISTANT}]) AS b FROM {closed("(SELECT w.* FROM walk w JOIN counts c ON c.conv IS NOT DISTINCT FROM w.conv AND w.i = c.n)", "conv")})
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv IS NOT DISTINCT FROM o.conv_id
"""


def op13_bucket_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op2_katz_backoff": op2_katz_backoff,
    "op1_legacy_archive": op1_legacy_archive,
    "op3_randomness_battery": op3_randomness_battery,
    "op4_prefix_forest": op4_prefix_forest,
    "op5_jaccard_rtree": op5_jaccard_rtree,
    "op6_link_trust": op6_link_trust,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_windows": op8_simhash_windows,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_external_shuffle": op10_external_shuffle,
    "op11_pair_naming": op11_pair_naming,
    "op12_cutting_stock": op12_cutting_stock,
    "op13_bucket_queue": op13_bucket_queue,
}

ORACLES: dict[str, str] = {
    "op1_legacy_archive": OP1_SQL,
    "op5_jaccard_rtree": OP5_SQL,
    "op11_pair_naming": OP11_SQL,
    "op13_bucket_queue": _op13_sql(),
}
