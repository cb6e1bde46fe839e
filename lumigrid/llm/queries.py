"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import secret_scan

    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import toxicity

    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import media

    return media.round_trip(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import jaccard

    return jaccard.linked(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import pseudonyms

    return pseudonyms.pseudonymized(table(spark, sf_dir, "documents"), spark.conf.get(pseudonyms.KEY, "example key"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import quality

    return quality.judged(table(spark, sf_dir, "documents"))


def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import suffix_tree

    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import lloyd

    return lloyd.digest(table(spark, sf_dir, "embeddings"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import licenses

    return licenses.digest(table(spark, sf_dir, "documents"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumigrid.llm import dialogue

    return dialogue.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _op1_sql() -> str:
    """The spans of all rules by DuckDB: gaps and matches alternate, so places are running sums of their lengths."""
    from lumigrid.llm import secret_scan

    def rule(order: int, r: secret_scan.Rule) -> str:
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        return f"""SELECT doc_id, {order} AS ord, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS hits, regexp_extract_all(t, {pattern}, {r.group}) AS vals FROM d"""

    rules = " UNION ALL ".join(rule(i, r) for i, r in enumerate(secret_scan.RULES))
    base = len(secret_scan.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secret_scan.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({rules}),
      u AS (SELECT doc_id, ord, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
      p AS (SELECT doc_id, ord, kind, least, length(vals[i]) AS v, length(hits[i]) AS n,
        (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM u),
      s AS (SELECT doc_id, ord, kind, start, kind || ':' || start || ':' || (start + n) AS said FROM p WHERE v >= least),
      g AS (SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY start, ord) FILTER (ord < {base}) AS base, string_agg(said, ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
      SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def _op11_sql() -> str:
    """Lloyd's rounds from scratch each time: every part against every entry of its codebook, then new means."""
    from lumigrid.llm.lloyd import ENTRIES, PARTS, ROUNDS, SCALE

    def assigned(n: int) -> str:
        return f"""a{n} AS (SELECT vec_id, p, x, unnest(best) FROM (SELECT vec_id, p, any_value(x) AS x, min({{'far': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best
          FROM parts JOIN b{n} USING (p) GROUP BY vec_id, p))"""

    def updated(n: int) -> str:
        return f"""m{n} AS (SELECT p, e, list(floor(s::DOUBLE / k)::BIGINT ORDER BY j) AS c FROM (SELECT p, e, j, sum(x[j]) AS s, count(*) AS k FROM a{n}, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY p, e, j) GROUP BY p, e),
        b{n + 1} AS (SELECT p, e, coalesce(m{n}.c, b{n}.c) AS c FROM b{n} LEFT JOIN m{n} USING (p, e))"""

    rounds = ", ".join(f"{assigned(n)}, {updated(n)}" for n in range(ROUNDS))
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      parts AS (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, unnest(range({PARTS})) AS t(p)),
      b0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
      {rounds}, {assigned(ROUNDS)},
      coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
      book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


def _op13_sql() -> str:
    """Damage, faults and edits by a recursive query over all conversations that carries the repaired turns along."""
    from lumigrid.llm.dialogue import moves

    options = ", ".join(f"({src}, {dst}, '{edit}', '{letters}', {cost}, {repr(initial) if initial else 'NULL'})" for src, dst, edit, letters, cost, initial in moves())
    # crc32 of a short text, bit by bit; 3988292384 is its reversed polynomial
    crc = """xor(list_reduce(list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda h, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(h, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
    # the roles of what is inserted, in front of a turn: they alternate from the state
    due = "CASE WHEN r.state = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END"
    # a rerole takes the role that is due after the insertions
    role = "CASE WHEN m.edit = 'K' THEN t.role WHEN m.dst = 2 THEN 'user' ELSE 'assistant' END"
    return f"""WITH RECURSIVE named AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
      drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS d FROM named),
      rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM drawn, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM rows),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
        rtrim(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) AS said FROM placed),
      turns AS (SELECT conv_id, i, turn, role, text, role[1] AS initial, CASE WHEN said = '' THEN 1 WHEN again > 1 THEN 2 WHEN said[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered),
      counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id),
      moves(src, dst, edit, letters, cost, initial) AS (VALUES {options}),
      reached AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL SELECT r.conv_id, r.i + 1, m.dst, min({{'cost': r.best.cost + m.cost + CASE WHEN m.edit <> 'D' AND t.fault = 3 THEN 1 ELSE 0 END, 'audit': r.best.audit || m.letters,
          'said': r.best.said || ({due})[1:len(m.letters) - 1] || CASE WHEN m.edit = 'D' THEN [] ELSE [{role} || ':' || t.text] END}})
        FROM reached r JOIN turns t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i JOIN moves m ON m.src = r.state
        WHERE m.edit = 'D' OR (t.fault NOT IN (1, 2) AND (m.edit = 'R' OR m.initial = t.initial)) GROUP BY r.conv_id, r.i, m.dst),
      ended AS (SELECT r.conv_id, min({{'cost': r.best.cost + e.cost, 'audit': r.best.audit || e.letters, 'said': r.best.said || e.said}}) AS best FROM reached r LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM r.conv_id
        JOIN (VALUES (0, 0, '', []::VARCHAR[]), (3, 0, '', []::VARCHAR[]), (2, 2, 'I', ['assistant:']), (1, 4, 'II', ['user:', 'assistant:'])) AS e(state, cost, letters, said) ON e.state = r.state WHERE r.i = coalesce(n.n, 0) GROUP BY r.conv_id)
      SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256 FROM ended e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""


def oracle_sql() -> dict[str, str]:
    """The others have none: a trained model, codecs, a component search, a packing, or Spark's own hashes; tests/llm
    compare them with brute force."""
    return {"op1_secret_scans": _op1_sql(), "op11_delta_lloyd": _op11_sql(), "op13_dialogue_repair": _op13_sql()}
