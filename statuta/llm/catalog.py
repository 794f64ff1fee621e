"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from statuta.llm import byte_bpe, chat, decontaminate, minhash, ngram_join, ppm, quality, ranked, substring_dedup, token_counts, toxicity, vector_codes, wavelet
from statuta.llm.common import table


def op1_chat_trees(spark, sf_dir):
    """Conversation -1 is one whose texts hold control strings."""
    trap = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(*chat.build(talks.unionByName(spark.createDataFrame(trap, "conv_id long, turn long, role string, text string"))))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.similar(table(spark, sf_dir, "documents"), n=3, num=90)


def op3_wavelet_tokens(spark, sf_dir):
    return wavelet.round_trip(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op6_ppm_score(spark, sf_dir):
    return ppm.language_score(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark, sf_dir):
    return minhash.similar(table(spark, sf_dir, "documents"), n=2, num=80)


def op12_ranked_search(spark, sf_dir):
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_trees, op2_ngram_join, op3_wavelet_tokens, op4_toxicity, op5_substring_dedup, op6_ppm_score, op7_decontaminate, op8_token_counts, op9_byte_bpe, op10_quality_rules, op11_minhash_dedup, op12_ranked_search, op13_vector_codes)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _joined_sql(n: int, num: int, more: str = "") -> str:
    """Components of documents whose sets of n-word shingles are similar enough."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {num} * (x.n + y.n - k)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN twoway l ON r.b = l.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id{more} FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The Lloyd iteration, a round a table."""
    steps = [f"""
p AS MATERIALIZED (SELECT vec_id, label, (pos - 1) // w AS part, list(x ORDER BY pos) AS v FROM (
  SELECT vec_id, label, len(embedding) // {parts} AS w, generate_subscripts(embedding, 1) AS pos, floor(4096 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) GROUP BY vec_id, label, part),
b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry, v FROM p WHERE vec_id IN (SELECT DISTINCT vec_id FROM p ORDER BY vec_id LIMIT {entries}))"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, v, far[1] AS far, far[2] AS entry FROM (
  SELECT p.vec_id, p.label, p.part, any_value(p.v) AS v, min([list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry]) AS far FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.vec_id, p.label, p.part))""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
  SELECT part, entry, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{k}) GROUP BY part, entry, pos) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
WITH {", ".join(steps)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


#: What SQL can express; the others are tested against brute force, libraries or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_trees": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<', chr(92) || '<'), '[', chr(92) || '[')) AS n,
  CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 20 + length(role) + length(regexp_replace(role, '[^<>\\[\\\\]', '', 'g')) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op2_ngram_join": _joined_sql(3, 90),
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
m AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM m),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_minhash_dedup": _joined_sql(2, 80, ", d.doc_id = min(r.b) AS kept"),
    "op12_ranked_search": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
all_of AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN d USING (term) JOIN n USING (doc_id), all_of GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_vector_codes": _codes_sql(),
}
