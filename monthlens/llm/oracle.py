"""DuckDB restatements of the queries that SQL can express at whole-table cost."""


def _vector_codes(rounds: int = 6) -> str:
    """Components as rows, and each round a join of all of them with all entries."""
    nearest = """
near{k} AS (
  SELECT vec_id, part, min(d * 16 + e) % 16 AS e, min(d) AS d
  FROM (SELECT vec_id, part, e, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS d FROM v JOIN book{k} b USING (part, pos) GROUP BY vec_id, part, e)
  GROUP BY vec_id, part)"""
    better = """
book{n} AS MATERIALIZED (
  SELECT e, part, pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT e, part, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM v JOIN near{k} USING (vec_id, part) GROUP BY e, part, pos) m
  USING (e, part, pos))"""
    steps = [text for k in range(rounds) for text in (nearest.format(k=k), better.format(k=k, n=k + 1))] + [nearest.format(k=rounds)]
    return """
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
cell AS (
  SELECT vec_id, i - 1 AS i, len(embedding) // 8 AS w, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
v AS MATERIALIZED (
  SELECT vec_id, i // w AS part, i % w AS pos, x FROM cell),
book0 AS MATERIALIZED (
  SELECT r.e, part, pos, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) r USING (vec_id)),""" + ",".join(steps) + """,
row AS (
  SELECT vec_id, string_agg(format('{:02x}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near%d GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, pos)) FROM book%d) AS codebooks_sha256
FROM row JOIN kept USING (vec_id)""" % (rounds, rounds)


SQL: dict[str, str] = {
    # Windows of 20 words as texts; each but the earliest of its text marks its words.
    "op4_superkmer_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
named AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM win),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM named) WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
lists AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
word AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
kept AS (
  SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i
  WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    # Distinct shingles as texts; links by counting shared ones; reachability step by step.
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM win),
n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(low.m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""",
    # Cuts by substring over code points.
    "op12_fill_in_middle": r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
cut AS (
  SELECT doc_id, n, form, t, least(a, b) AS a, greatest(a, b) AS b, substring(t, 1, least(a, b)) AS p,
         substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substring(t, greatest(a, b) + 1) AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut""",
    "op13_vector_codes": _vector_codes(),
}
