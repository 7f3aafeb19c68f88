"""The queries opN_<name> of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import jaccard_join, license_scan, maxent_lm, multi_index, packing, pii, piece_encoding, quality_rules, source_audit, source_mix, spelling_variants, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.query,
        "op2_best_fit_packing": packing.query,
        "op3_pii": pii.query,
        "op4_license_scan": license_scan.query,
        "op5_multi_index": multi_index.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_piece_encoding": piece_encoding.query,
        "op9_quality_rules": quality_rules.query,
        "op10_maxent_lm": maxent_lm.query,
        "op11_source_audit": source_audit.query,
        "op12_source_mix": source_mix.query,
        "op13_spelling_variants": spelling_variants.query,
    }


_JACCARD = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 k AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 199)) AS i, unnest(list_transform(range(0, len(h) // 2 - 199), lambda i: hash(substr(h, 2 * i + 1, 400)))) AS x FROM d WHERE len(h) >= 400),
 m AS (SELECT doc_id, i FROM k SEMI JOIN (SELECT x FROM k GROUP BY 1 HAVING count(*) > 1) USING (x)),
 g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM m),
 s AS (SELECT doc_id, run, min(i) AS low, max(i) + 200 AS high FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY ALL),
 b AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS prev FROM s),
 c AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (low - prev)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept, sum(high - low) AS gone, count(*) AS n FROM b JOIN d USING (doc_id) GROUP BY 1)
 SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for what SQL can express; the others are held against brute force in tests/llm."""
    return {"op6_jaccard_join": _JACCARD, "op7_suffix_dedup": _REPEATS, "op11_source_audit": source_audit.SQL, "op12_source_mix": source_mix.SQL, "op13_spelling_variants": spelling_variants.SQL}
