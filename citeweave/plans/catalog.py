"""One query for each operator over the stand-in tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import ids, text, titles
from citeweave.operators import curriculum, expansion, fusion, graph, identity, judgment, model_calls, ordering, resolver, selection, summaries
from citeweave.operators.steps import Steps, shared_folder
from citeweave.plans import paths
from citeweave.sources import payloads, response_cache
from citeweave.sources import stand_ins as x
from citeweave.sources.response_cache import request_key
from citeweave.sources.store import Store
from citeweave.streaming.hits import windowed_hits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


STOP = "[" + ", ".join(f"'{w}'" for w in titles.STOPWORDS) + "]"
SAME = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in titles.EQUIVALENT.items()) + " ELSE t END"


def tokens_sql(title: str) -> str:
    raw = f"regexp_extract_all(lower({title}), '[a-z0-9]+')"
    kept = f"list_filter({raw}, lambda t: NOT list_contains({STOP}, t))"
    return f"list_sort(list_distinct(list_transform(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {raw} END, lambda t: {SAME})))"


FP = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '', 'g')"


@query("q01_normalize_doi", "SELECT doc_id, '10.1/' || doc_id || 'abc' AS doi FROM documents")
def _(spark, d):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "  HTTPS://DOI.ORG/10.1/").otherwise("doi:10.1/"), "doc_id", F.lit("ABC "))
    return x.table(spark, d, "documents").select("doc_id", ids.normalize_doi(raw).alias("doi"))


@query("q02_normalize_arxiv", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS arxiv FROM documents")
def _(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/"), "doc_id", F.lit("v"), 1 + F.col("doc_id") % 3)).otherwise(F.concat(F.lit("arXiv:"), "doc_id"))
    return x.table(spark, d, "documents").select("doc_id", ids.normalize_arxiv_id(raw).alias("arxiv"))


@query("q03_normalize_openalex", "SELECT page_id, upper(list_extract(string_split(trim(url), '/'), -1)) AS id FROM pages")
def _(spark, d):
    return x.table(spark, d, "pages").select("page_id", ids.normalize_external_id(F.lit("openalex"), F.col("url")).alias("id"))


@query("q04_title_fingerprint", f"WITH {x.PAPERS} SELECT paper_id, {FP.format('title')} AS fp FROM x_papers")
def _(spark, d):
    return x.papers(spark, d).select("paper_id", text.title_fingerprint(F.col("title")).alias("fp"))


@query("q05_canonical_id", f"WITH {x.PAPERS} SELECT paper_id, CASE WHEN paper_id % 4 < 2 THEN 'arxiv:' || (paper_id // 2) WHEN paper_id % 4 = 2 THEN 'doi:10.1/' || paper_id ELSE 'sig:' || substr(sha1({FP.format('title')} || '|' || coalesce(CAST(year AS VARCHAR), '')), 1, 16) END AS id FROM x_papers")
def _(spark, d):
    pair = lambda ns, value: F.struct(F.lit(ns).alias("ns"), value.cast("string").alias("value"))
    p = F.col("paper_id")
    own = F.when(p % 4 < 2, F.array(pair("pmid", p), pair("arxiv", F.floor(p / 2)))).when(p % 4 == 2, F.array(pair("arxiv", p), pair("doi", F.concat(F.lit("10.1/"), p)))).otherwise(F.array())
    return x.papers(spark, d).select("paper_id", ids.canonical_id(own, F.col("title"), F.col("year")).alias("id"))


def _records(spark, d):
    own = F.when(F.col("paper_id") % 4 < 2, F.struct(F.lit("arxiv").alias("ns"), F.floor(F.col("paper_id") / 2).cast("string").alias("value")))
    return x.papers(spark, d).select("topic", F.col("paper_id").alias("row_id"), "title", "year", F.array_compact(F.array(own)).alias("external_ids"))


_KEYS = f"""{x.PAPERS}, f AS (SELECT topic, paper_id, year, {FP.format('title')} AS fp, CASE WHEN paper_id % 4 < 2 THEN paper_id // 2 END AS own FROM x_papers),
 k AS (SELECT topic, paper_id, 'i' || own AS key FROM f WHERE own IS NOT NULL UNION ALL
   SELECT topic, paper_id, fp || (year + dy) FROM f, (VALUES (-1), (0), (1)) t(dy) WHERE year IS NOT NULL AND length(fp) >= 12),
 low AS (SELECT topic, key, min(paper_id) AS v FROM k GROUP BY ALL),
 e AS (SELECT DISTINCT paper_id AS a, v AS b FROM k JOIN low USING (topic, key) UNION SELECT DISTINCT v, paper_id FROM k JOIN low USING (topic, key)),
 r(a, b) AS (SELECT paper_id, paper_id FROM x_papers UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), one AS (SELECT a AS paper_id, min(b) AS root FROM r GROUP BY 1)"""


#: roots: row_id and root of every record.
_ROOTS = f"""{_KEYS},
 seen AS (SELECT topic, fp, min(root) AS lo, max(root) AS hi FROM f JOIN one USING (paper_id) WHERE year IS NOT NULL AND length(fp) >= 12 GROUP BY ALL),
 mates AS (SELECT topic, fp, min(paper_id) AS v FROM f WHERE year IS NULL AND length(fp) >= 12 GROUP BY ALL),
 e2 AS (SELECT paper_id AS a, root AS b FROM one UNION SELECT root, paper_id FROM one
   UNION SELECT f.paper_id, s.lo FROM f JOIN seen s USING (topic, fp) WHERE f.year IS NULL AND lo = hi UNION SELECT s.lo, f.paper_id FROM f JOIN seen s USING (topic, fp) WHERE f.year IS NULL AND lo = hi
   UNION SELECT f.paper_id, m.v FROM f JOIN mates m USING (topic, fp) LEFT JOIN seen s USING (topic, fp) WHERE f.year IS NULL AND s.lo IS NULL
   UNION SELECT m.v, f.paper_id FROM f JOIN mates m USING (topic, fp) LEFT JOIN seen s USING (topic, fp) WHERE f.year IS NULL AND s.lo IS NULL),
 r2(a, b) AS (SELECT paper_id, paper_id FROM x_papers UNION SELECT r2.a, e2.b FROM r2 JOIN e2 ON r2.b = e2.a),
 roots AS (SELECT a AS row_id, min(b) AS root FROM r2 GROUP BY 1)"""
_CANONICAL = f"coalesce('arxiv:' || own, 'sig:' || substr(sha1({FP.format('title')} || '|' || coalesce(CAST(year AS VARCHAR), '')), 1, 16))"


@query("q06_resolve_entities", f"WITH RECURSIVE {_ROOTS} SELECT row_id, root FROM roots")
def _(spark, d):
    return identity.resolve_entities(_records(spark, d)).select("row_id", "root")


@query("q07_merge_papers", f"""WITH RECURSIVE {_ROOTS}, m AS (SELECT f.topic, r.root, arg_min(p.title, f.paper_id) AS title, min(f.year) AS year, min(CAST(f.own AS VARCHAR)) AS own FROM roots r JOIN f ON f.paper_id = r.row_id JOIN x_papers p ON p.paper_id = f.paper_id GROUP BY ALL)
 SELECT topic, root, title, year, {_CANONICAL} AS paper_id FROM m""")
def _(spark, d):
    records = _records(spark, d)
    return identity.merge_papers(records, identity.resolve_entities(records)).select("topic", "root", "title", "year", "paper_id")


@query("q09_rank_fusion", f"WITH {x.HITS} SELECT paper_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS providers FROM x_hits GROUP BY 1")
def _(spark, d):
    fused = fusion.reciprocal_rank_fusion(x.hits(spark, d))
    return fused.select("paper_id", F.round("score", 9).alias("score"), F.size("found_by").cast("long").alias("providers"))


@query("q10_top_per_topic", f"""WITH {x.HITS}, s AS (SELECT paper_id, round(sum(1.0 / (60 + rank)), 12) AS score, count(*) AS n FROM x_hits GROUP BY 1)
 SELECT row_number() OVER (ORDER BY score DESC, n DESC, paper_id) AS position, paper_id FROM s QUALIFY position <= 25""")
def _(spark, d):
    fused = fusion.reciprocal_rank_fusion(x.hits(spark, d)).withColumn("score", F.round("score", 12))
    return fusion.top_per_topic(fused, 25).select(F.col("position").cast("long").alias("position"), "paper_id")


@query("q11_clean_edges", f"WITH {x.CITES} SELECT topic, citing_id, cited_id FROM x_cites WHERE citing_id <> cited_id")
def _(spark, d):
    return expansion.clean_edges(x.citations(spark, d), x.papers(spark, d))


@query("q12_co_citations", f"WITH {x.COUNTS} SELECT topic, paper_id, n FROM x_counts")
def _(spark, d):
    return expansion.co_citations(x.citations(spark, d), x.seeds(spark, d))


@query("q13_ancestors", f"""WITH {x.COUNTS} SELECT topic, paper_id, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, paper_id) AS position FROM x_counts
 WHERE n >= 3 AND (topic, paper_id) NOT IN (SELECT topic, paper_id FROM x_seeds) QUALIFY position <= 20""")
def _(spark, d):
    s = x.seeds(spark, d)
    return expansion.ancestors(expansion.co_citations(x.citations(spark, d), s), s).withColumn("position", F.col("position").cast("long"))


@query("q14_expand", f"""WITH {x.SEEDS}, s AS (SELECT * FROM x_seeds WHERE seed_rank <= 25),
 one AS (SELECT c.* FROM x_cites c SEMI JOIN s ON s.topic = c.topic AND s.paper_id = c.citing_id),
 n AS (SELECT topic, cited_id AS paper_id, count(*) AS n FROM one GROUP BY ALL),
 a AS (SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY n DESC, paper_id) AS position FROM n WHERE n >= 3 AND (topic, paper_id) NOT IN (SELECT topic, paper_id FROM s)),
 every AS (SELECT *, 1 AS p FROM one UNION ALL SELECT c.*, 2 FROM x_cites c SEMI JOIN (SELECT * FROM a WHERE position <= 12) b ON b.topic = c.topic AND b.paper_id = c.citing_id
   UNION ALL SELECT c.*, 3 FROM x_cites c SEMI JOIN (SELECT * FROM a WHERE position <= 6) b ON b.topic = c.topic AND b.paper_id = c.cited_id)
 SELECT topic, citing_id, cited_id, list_aggregate(list_sort(list_distinct(list(p))), 'string_agg', ',') AS passes FROM every GROUP BY ALL""")
def _(spark, d):
    return expansion.expand(x.citations(spark, d), x.seeds(spark, d).where("seed_rank <= 25")).withColumn("passes", F.array_join(F.col("passes").cast("array<string>"), ","))


@query("q15_forward_on_topic", f"WITH {x.SEEDS} SELECT c.topic, c.citing_id, c.cited_id FROM x_cites c JOIN x_seeds s ON s.topic = c.topic AND s.paper_id = c.cited_id JOIN x_papers p ON p.topic = c.topic AND p.paper_id = c.citing_id WHERE contains(lower(p.title), 'an')")
def _(spark, d):
    return expansion.forward(x.citations(spark, d), x.seeds(spark, d), x.papers(spark, d), F.lower("title").contains("an")).select("topic", "citing_id", "cited_id")


@query("q16_discovered", f"WITH {x.SEEDS} SELECT topic, paper_id FROM (SELECT topic, citing_id AS paper_id FROM x_cites UNION SELECT topic, cited_id FROM x_cites) WHERE (topic, paper_id) NOT IN (SELECT topic, paper_id FROM x_seeds)")
def _(spark, d):
    return expansion.discovered(x.citations(spark, d), x.seeds(spark, d))


@query("q17_outcomes", """SELECT event_type AS provider, bool_and(value >= 1) AS ok, count(*) AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS papers_added,
 max_by(CAST(event_id AS VARCHAR), event_id) FILTER (WHERE NOT coalesce(value >= 1, false)) AS last_error FROM events GROUP BY 1""")
def _(spark, d):
    bad = ~F.coalesce(F.col("value") >= 1, F.lit(False))
    calls = x.table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), F.when(bad, F.col("event_id").cast("string")).alias("error"), F.floor("value").cast("long").alias("papers"))
    return expansion.outcomes(calls)


@query("q18_degrees", f"WITH {x.COUNTS} SELECT topic, paper_id, in_degree, out_degree FROM x_facts")
def _(spark, d):
    return graph.degrees(x.papers(spark, d), x.citations(spark, d))


@query("q19_pagerank", f"""WITH RECURSIVE {x.COUNTS}, size AS (SELECT topic, count(*) AS n FROM x_papers GROUP BY 1),
 rank(i, topic, paper_id, r) AS (SELECT 0, topic, paper_id, CAST(1.0 / n AS DOUBLE) FROM x_papers JOIN size USING (topic) UNION ALL
  SELECT k.i + 1, k.topic, k.paper_id, 0.5 / s.n + 0.5 * (coalesce(g.v, 0) + coalesce(l.v, 0) / s.n) FROM rank k JOIN size s USING (topic)
   LEFT JOIN (SELECT c.topic, c.cited_id AS paper_id, sum(q.r / f.out_degree) AS v FROM rank q JOIN x_cites c ON c.topic = q.topic AND c.citing_id = q.paper_id JOIN x_out f ON f.topic = q.topic AND f.paper_id = q.paper_id GROUP BY ALL) g ON g.topic = k.topic AND g.paper_id = k.paper_id
   LEFT JOIN (SELECT q.topic, sum(q.r) AS v FROM rank q WHERE (q.topic, q.paper_id) NOT IN (SELECT topic, paper_id FROM x_out) GROUP BY 1) l ON l.topic = k.topic WHERE k.i < 20)
 SELECT topic, paper_id, round(r, 9) AS pagerank FROM rank WHERE i = 20""")
def _(spark, d):
    return graph.pagerank(x.papers(spark, d), x.citations(spark, d), iterations=20, tolerance=0.0).withColumn("pagerank", F.round("pagerank", 9))


@query("q63_limited_expansion", f"""WITH {x.SEEDS}, n AS (SELECT topic, paper_id, citation_count AS c FROM x_papers), s AS (SELECT * FROM x_seeds WHERE seed_rank <= 25),
 one AS (SELECT e.* FROM x_cites e SEMI JOIN s ON s.topic = e.topic AND s.paper_id = e.citing_id JOIN n ON n.topic = e.topic AND n.paper_id = e.cited_id QUALIFY row_number() OVER (PARTITION BY e.topic, e.citing_id ORDER BY c DESC NULLS LAST, e.cited_id) <= 2),
 k AS (SELECT topic, cited_id AS paper_id, count(*) AS n FROM one GROUP BY ALL),
 a AS (SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY n DESC, paper_id) AS position FROM k WHERE n >= 2 AND (topic, paper_id) NOT IN (SELECT topic, paper_id FROM s)),
 two AS (SELECT e.* FROM x_cites e SEMI JOIN (SELECT * FROM a WHERE position <= 12) b ON b.topic = e.topic AND b.paper_id = e.citing_id JOIN n ON n.topic = e.topic AND n.paper_id = e.cited_id QUALIFY row_number() OVER (PARTITION BY e.topic, e.citing_id ORDER BY c DESC NULLS LAST, e.cited_id) <= 2),
 three AS (SELECT e.* FROM x_cites e SEMI JOIN (SELECT * FROM a WHERE position <= 6) b ON b.topic = e.topic AND b.paper_id = e.cited_id JOIN n ON n.topic = e.topic AND n.paper_id = e.citing_id QUALIFY row_number() OVER (PARTITION BY e.topic, e.cited_id ORDER BY c DESC NULLS LAST, e.citing_id) <= 1)
 SELECT topic, citing_id, cited_id, list_aggregate(list_sort(list_distinct(list(p))), 'string_agg', ',') AS passes FROM (SELECT *, 1 AS p FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three) GROUP BY ALL""")
def _(spark, d):
    edges = expansion.expand(x.citations(spark, d), x.seeds(spark, d).where("seed_rank <= 25"), least=2, references_per_paper=2, citations_per_paper=1, papers=x.papers(spark, d))
    return edges.withColumn("passes", F.array_join(F.col("passes").cast("array<string>"), ","))


def zed(window: int) -> str:
    """x_z: x_facts with the age-rescaled in-degree z."""
    return f"""{x.COUNTS}, x_near AS (SELECT a.topic, a.paper_id, a.in_degree AS v, b.in_degree AS o, abs(b.year - a.year) <= {window} AS same, row_number() OVER (PARTITION BY a.topic, a.paper_id ORDER BY abs(b.year - a.year), b.year, b.paper_id) AS r
   FROM x_facts a JOIN x_facts b ON a.topic = b.topic AND a.year IS NOT NULL AND b.year IS NOT NULL), x_own AS (SELECT topic, paper_id, count(*) FILTER (WHERE same) AS own FROM x_near GROUP BY ALL),
 x_g AS (SELECT topic, paper_id, any_value(v) AS v, avg(o) AS m, stddev_pop(o) AS s, min(o) AS lo, max(o) AS hi, count(*) AS c FROM x_near JOIN x_own USING (topic, paper_id) WHERE CASE WHEN own >= 5 THEN same ELSE r <= 5 END GROUP BY ALL),
 x_z AS (SELECT f.*, CASE WHEN c IS NULL OR c < 2 OR lo = hi THEN 0.0::DOUBLE ELSE round((v - m) / s, 6) END AS z FROM x_facts f LEFT JOIN x_g USING (topic, paper_id))"""


ZED = zed(3)


def _facts(spark, d):
    edges, seeds = x.citations(spark, d), x.seeds(spark, d)
    nodes = x.papers(spark, d)
    out = nodes.join(graph.degrees(nodes, edges), ["topic", "paper_id"]).join(expansion.co_citations(edges, seeds).withColumnRenamed("n", "co_citations"), ["topic", "paper_id"], "left").join(seeds, ["topic", "paper_id"], "left")
    return out.fillna(0, ["co_citations"])


def _z(spark, d):
    z = graph.age_rescale(_facts(spark, d), "in_degree")
    return z.withColumn("z", F.round("z", 6))


@query("q20_age_rescale", f"WITH {ZED} SELECT topic, paper_id, z FROM x_z")
def _(spark, d):
    return _z(spark, d).select("topic", "paper_id", "z")


@query("q21_age_rescale_sparse", f"WITH {zed(0)} SELECT topic, paper_id, z FROM x_z")
def _(spark, d):
    return graph.age_rescale(_facts(spark, d), "in_degree", window=0).select("topic", "paper_id", F.round("z", 6).alias("z"))


@query("q22_communities")
def _(spark, d):
    return graph.communities(x.papers(spark, d), x.citations(spark, d))


@query("q23_select_papers", f"""WITH {ZED}, f AS (SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY co_citations DESC, z DESC, paper_id) AS r FROM x_z WHERE co_citations >= 3 QUALIFY r <= 9),
 s AS (SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY seed_rank, paper_id) AS r FROM x_z WHERE seed_rank IS NOT NULL AND (topic, paper_id) NOT IN (SELECT topic, paper_id FROM f) QUALIFY r <= 9),
 t AS (SELECT topic, paper_id, 'foundation' AS reason FROM f UNION ALL SELECT topic, paper_id, 'surface' FROM s), n AS (SELECT topic, count(*) AS n FROM t GROUP BY 1),
 e AS (SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY z DESC, paper_id) AS r FROM x_z WHERE (co_citations >= 2 OR in_degree >= 2) AND (topic, paper_id) NOT IN (SELECT topic, paper_id FROM t))
 SELECT * FROM t UNION ALL SELECT e.topic, e.paper_id, 'evidence' FROM e LEFT JOIN n USING (topic) WHERE r <= 24 - coalesce(n, 0)""")
def _(spark, d):
    return selection.select_papers(_z(spark, d))


_PAIRS = f"""{ZED}, x_pairs AS (SELECT c.topic, c.cited_id AS prerequisite_id, c.citing_id AS dependent_id, b.co_citations, row_number() OVER (PARTITION BY c.topic ORDER BY b.co_citations DESC, b.z DESC, c.cited_id, c.citing_id) AS position
  FROM x_cites c JOIN x_z a ON a.topic = c.topic AND a.paper_id = c.citing_id JOIN x_z b ON b.topic = c.topic AND b.paper_id = c.cited_id WHERE a.year IS NULL OR b.year IS NULL OR b.year <= a.year QUALIFY position <= 60)"""


@query("q24_candidate_pairs", f"WITH {_PAIRS} SELECT topic, prerequisite_id, dependent_id, co_citations, position FROM x_pairs")
def _(spark, d):
    return selection.candidate_pairs(_z(spark, d), x.citations(spark, d)).withColumn("position", F.col("position").cast("long"))


@query("q25_topic_evidence", f"WITH {x.COUNTS} SELECT topic, paper_id FROM x_facts WHERE co_citations >= 2 OR in_degree >= 2")
def _(spark, d):
    return _facts(spark, d).where(selection.has_topic_evidence()).select("topic", "paper_id")


@query("q26_roles", f"""WITH {ZED}, m AS (SELECT topic, list_extract(list_sort(list(year)), len(list(year)) // 2 + 1) AS mid FROM x_z WHERE year IS NOT NULL GROUP BY 1)
 SELECT topic, paper_id, CASE WHEN regexp_matches(title, '{titles.SURVEY}') THEN 'survey' WHEN regexp_matches(title, '{titles.CRITIQUE}') THEN 'critique' WHEN co_citations >= 3 AND coalesce(year < mid, false) THEN 'foundation'
  WHEN z >= 1 THEN 'breakthrough' WHEN out_degree > 0 AND NOT coalesce(year < mid, false) THEN 'extension' ELSE 'unclassified' END AS role FROM x_z LEFT JOIN m USING (topic)""")
def _(spark, d):
    return judgment.with_median_year(_z(spark, d)).select("topic", "paper_id", judgment.structural_role().alias("role"))


@query("q27_structural_edges", f"""WITH {_PAIRS}, m AS (SELECT topic, greatest(2, list_extract(list_sort(list(co_citations)), len(list(co_citations)) // 2 + 1)) AS least FROM x_pairs GROUP BY 1)
 SELECT topic, prerequisite_id, dependent_id, 'co_citation' AS source FROM x_pairs JOIN m USING (topic) WHERE co_citations >= least""")
def _(spark, d):
    return judgment.structural_edges(selection.candidate_pairs(_z(spark, d), x.citations(spark, d))).select("topic", "prerequisite_id", "dependent_id", "source")


@query("q28_structural_facts", f"WITH {ZED} SELECT paper_id, printf('%d of the topic''s papers cite it; %d citations inside the topic; %+.2f against its age', co_citations, in_degree, round(z, 2)) AS facts FROM x_z")
def _(spark, d):
    return _z(spark, d).select("paper_id", judgment.structural_facts().alias("facts"))


@query("q29_subtopics")
def _(spark, d):
    return judgment.structural_subtopics(graph.communities(x.papers(spark, d), x.citations(spark, d)))


def _order(spark, d, claim: bool = False):
    claimed = x.citations(spark, d).select("topic", F.col("cited_id").alias("prerequisite_id"), F.col("citing_id").alias("dependent_id")) if claim else None
    return ordering.order_paths(x.papers(spark, d).withColumn("rank", F.col("rn")), x.citations(spark, d), claimed)


_LEVELS = f"""{x.CITES}, lv(topic, paper_id, level) AS (SELECT topic, paper_id, 0 FROM x_papers UNION SELECT c.topic, c.citing_id, l.level + 1 FROM lv l JOIN x_cites c ON c.topic = l.topic AND c.cited_id = l.paper_id),
 top AS (SELECT topic, paper_id, max(level) AS level FROM lv GROUP BY ALL)"""


@query("q30_levels", f"WITH RECURSIVE {_LEVELS} SELECT topic, paper_id, level FROM top")
def _(spark, d):
    return _order(spark, d).select("topic", "paper_id", "level")


@query("q31_order", f"WITH RECURSIVE {_LEVELS} SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY level, rn, paper_id) - 1 AS position FROM top JOIN x_papers USING (topic, paper_id)")
def _(spark, d):
    return _order(spark, d).select("topic", "paper_id", F.col("position").cast("long").alias("position"))


@query("q32_reduction", f"""WITH RECURSIVE {x.CITES}, reach(topic, a, b) AS (SELECT topic, cited_id, citing_id FROM x_cites UNION SELECT r.topic, r.a, c.citing_id FROM reach r JOIN x_cites c ON c.topic = r.topic AND c.cited_id = r.b)
 SELECT topic, cited_id AS prerequisite_id, citing_id AS dependent_id FROM x_cites e WHERE NOT EXISTS (SELECT 1 FROM x_cites f JOIN reach r ON r.topic = f.topic AND r.a = f.citing_id WHERE f.topic = e.topic AND f.cited_id = e.cited_id AND r.b = e.citing_id)""")
def _(spark, d):
    return _order(spark, d, True).select("topic", F.explode("prerequisites").alias("prerequisite_id"), F.col("paper_id").alias("dependent_id"))


def _turned(spark, d):
    """Citations, and some of them the other way round too."""
    edges = x.citations(spark, d)
    back = edges.where((F.col("citing_id") + F.col("cited_id")) % 41 == 0).select("topic", F.col("cited_id").alias("citing_id"), F.col("citing_id").alias("cited_id"))
    return edges.union(back)


@query("q33_cycles")
def _(spark, d):
    return ordering.order_paths(x.papers(spark, d).withColumn("rank", F.col("rn")), _turned(spark, d)).select("topic", F.col("paper_id").alias("from_id"), F.explode("broken").alias("to_id"))


@query("q62_strong_components", f"""WITH RECURSIVE {x.CITES}, e AS (SELECT topic, citing_id AS a, cited_id AS b FROM x_cites UNION SELECT topic, cited_id, citing_id FROM x_cites WHERE (citing_id + cited_id) % 41 = 0),
 r(topic, a, b) AS (SELECT topic, a, b FROM e UNION SELECT r.topic, r.a, e.b FROM r JOIN e ON e.topic = r.topic AND e.a = r.b)
 SELECT f.topic, f.a AS paper_id, min(f.b) AS component FROM r f JOIN r g ON g.topic = f.topic AND g.a = f.b AND g.b = f.a GROUP BY ALL""")
def _(spark, d):
    links = _turned(spark, d).select("topic", F.col("citing_id").alias("a"), F.col("cited_id").alias("b"))
    return ordering.strong_components(links, Steps(spark, "components"))


@query("q34_structural_paths")
def _(spark, d):
    return paths.structural_paths(x.papers(spark, d), x.citations(spark, d), x.seeds(spark, d)).select("topic", "position", "level", "paper_id", "year", "role", "reason", "prerequisites", "explanation.*", "provenance")


@query("q35_tokens", f"WITH {x.PAPERS} SELECT paper_id, array_to_string({tokens_sql('title')}, ' ') AS tokens FROM x_papers")
def _(spark, d):
    return x.papers(spark, d).select("paper_id", F.array_join(titles.tokenize(F.col("title")), " ").alias("tokens"))


def _plan(spark, d):
    """Every paper's first words are looked for in its topic."""
    words = F.slice(F.split("title", " "), 1, 8)
    stage = F.element_at(F.array(*map(F.lit, ("prerequisite", "anchor", "followup"))), (F.col("rn") % 3 + 1).cast("int"))
    return x.papers(spark, d).select("topic", F.col("rn").alias("step"), F.array_join(words, " ").alias("title"), "year", stage.alias("stage"), F.lit("step").alias("concept"))


@query("q36_title_scores", f"""WITH {x.PAPERS}, p AS (SELECT paper_id, {tokens_sql("array_to_string(list_slice(string_split(title, ' '), 1, 8), ' ')")} AS a, {tokens_sql('title')} AS b FROM x_papers)
 SELECT paper_id, round(CASE WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS f1, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 9) AS coverage FROM p""")
def _(spark, d):
    a, b = titles.tokenize(F.array_join(F.slice(F.split("title", " "), 1, 8), " ")), titles.tokenize(F.col("title"))
    return x.papers(spark, d).select("paper_id", F.round(titles.token_f1(a, b), 9).alias("f1"), F.round(titles.coverage(a, b), 9).alias("coverage"))


_RAW = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_WANTED = "array_to_string(list_slice(string_split(title, ' '), 1, 8), ' ')"
#: x_held: papers with their tokens, those of the main title and the content words; x_asked: planned titles likewise.
_TITLES = f"""{x.PAPERS}, x_held AS (SELECT topic, paper_id, year, citation_count, title, {tokens_sql('title')} AS b, {tokens_sql("split_part(title, ':', 1)")} AS main,
  list_transform(list_filter({_RAW.format('title')}, lambda t: NOT list_contains({STOP}, t)), lambda t: {SAME}) AS o FROM x_papers),
 x_asked AS (SELECT topic, rn AS step, year AS wy, {_WANTED} AS wanted, {tokens_sql(_WANTED)} AS a FROM x_papers)"""
_BOTH = "len(list_intersect(a, b))"
_F1 = f"CASE WHEN {_BOTH} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {_BOTH} / (len(a) + len(b)) END"
_QUALIFIED = "coalesce(list_position(list_transform(o, lambda t: list_contains(a, t)), true), 0) BETWEEN 2 AND 3"
_SIMILAR = f"CASE WHEN NOT contains(wanted, ':') AND len(a) > 0 AND main = a THEN 1.0::DOUBLE WHEN {_QUALIFIED} THEN least({_F1}, 0.7::DOUBLE) ELSE {_F1} END"


@query("q37_similarity", f"WITH {_TITLES} SELECT h.paper_id, round({_SIMILAR}, 9) AS similarity FROM x_held h JOIN x_papers p USING (topic, paper_id) JOIN x_asked q ON q.topic = h.topic AND q.step = p.rn")
def _(spark, d):
    plan = _plan(spark, d).select("topic", F.col("step").alias("rn"), F.col("title").alias("wanted"))
    return x.papers(spark, d).join(plan, ["topic", "rn"]).select("paper_id", F.round(titles.title_similarity(F.col("wanted"), F.col("title")), 9).alias("similarity"))


_RESOLVED = f"""WITH {_TITLES}, h AS (SELECT * FROM x_held WHERE NOT regexp_matches(title, '{titles.NOT_A_PAPER}')), w AS (SELECT topic, paper_id, unnest(b) AS word FROM h),
 c AS (SELECT topic, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT topic, step, len(a) AS n, unnest(a) AS word FROM x_asked),
 k AS (SELECT s.topic, step, word FROM s LEFT JOIN c USING (topic, word) QUALIFY row_number() OVER (PARTITION BY s.topic, step ORDER BY coalesce(c.n, 0), word) <= s.n - ceil(0.8 * s.n) + 1),
 m AS (SELECT DISTINCT topic, step, paper_id FROM k JOIN w USING (topic, word)),
 v AS (SELECT m.topic, step, paper_id, citation_count, wy, year, {_SIMILAR} AS sim, {_BOTH} / len(a) AS coverage, {_QUALIFIED} AS q FROM m JOIN x_asked USING (topic, step) JOIN h USING (topic, paper_id)),
 z AS (SELECT *, least(1.0::DOUBLE, sim + CASE WHEN abs(wy - year) <= 1 THEN 0.05::DOUBLE ELSE 0 END) AS score FROM v),
 best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY topic, step ORDER BY score DESC, coalesce(citation_count, -1) DESC, paper_id) = 1)
 SELECT topic, step, paper_id, round(score, 9) AS score, round(coverage, 9) AS coverage, score >= 0.75::DOUBLE AND coverage >= 0.8::DOUBLE AND NOT (sim < 1 AND q) AS accepted,
  score >= 0.9::DOUBLE AND coverage >= 0.8::DOUBLE AND NOT (sim < 1 AND q) AS confident FROM best"""


@query("q38_resolve_titles", _RESOLVED)
def _(spark, d):
    return resolver.resolve_titles(_plan(spark, d), x.papers(spark, d)).withColumn("score", F.round("score", 9)).withColumn("coverage", F.round("coverage", 9))


@query("q39_judged_edges", f"""WITH {_PAIRS}, l AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY position) AS k FROM x_pairs)
 SELECT topic, prerequisite_id, dependent_id, round(0.5::DOUBLE + (k % 6) / 10.0, 2) AS confidence FROM l WHERE k % 2 = 0 AND round(0.5::DOUBLE + (k % 6) / 10.0, 2) >= 0.6""")
def _(spark, d):
    labels = judgment.labelled(selection.candidate_pairs(_z(spark, d), x.citations(spark, d)), "r", "position", batch=12)
    k = F.substring("label", 2, 9).cast("int")
    answers = labels.select("topic", "label", (k % 2 == 0).alias("is_prerequisite"), F.round(0.5 + (k % 6) / 10.0, 2).alias("confidence"))
    unknown = labels.select("topic", F.concat("label", F.lit("x")).alias("label"), F.lit(True).alias("is_prerequisite"), F.lit(0.9).alias("confidence"))
    return judgment.judged_edges(answers.union(unknown), labels).select("topic", "prerequisite_id", "dependent_id", "confidence")


def _steps(spark, d):
    stage = F.element_at(F.array(*map(F.lit, ("prerequisite", "anchor", "followup"))), (F.col("paper_id") % 3 + 1).cast("int"))
    return x.papers(spark, d).select("topic", F.col("rn").alias("position"), "paper_id", "year", stage.alias("stage"), F.lit("step").alias("concept"), (F.col("paper_id") % 5 == 0).alias("approximate"))


_STEPS = f"{x.PAPERS}, st AS (SELECT topic, rn AS position, paper_id, year, list_extract(['prerequisite', 'anchor', 'followup'], paper_id % 3 + 1) AS stage, paper_id % 5 = 0 AS approximate FROM x_papers)"


@query("q40_assemble", f"""WITH {_STEPS} SELECT topic, paper_id, row_number() OVER w - 1 AS level, lag(paper_id) OVER w AS prerequisite_id,
 CASE stage WHEN 'prerequisite' THEN 'foundation' WHEN 'anchor' THEN 'breakthrough' ELSE 'extension' END AS role FROM st WINDOW w AS (PARTITION BY topic ORDER BY position)""")
def _(spark, d):
    return curriculum.assemble(_steps(spark, d)).select("topic", "paper_id", F.col("level").cast("long").alias("level"), "prerequisite_id", "role")


_CHRON = "ch AS (SELECT topic, count(*) AS dated, count(*) FILTER (WHERE year < b - 2) AS inversions FROM (SELECT topic, year, lag(year) OVER (PARTITION BY topic ORDER BY position) AS b FROM st WHERE year IS NOT NULL) GROUP BY 1)"


@query("q41_confidence", f"""WITH {_STEPS}, {_CHRON}, a AS (SELECT topic, count(*) FILTER (WHERE stage = 'anchor') AS an, count(*) FILTER (WHERE stage = 'prerequisite') AS pr, count(*) FILTER (WHERE approximate) AS near, count(*) AS n FROM st GROUP BY 1)
 SELECT topic, round(greatest(0.0, 1.0::DOUBLE - CASE WHEN an = 0 THEN 0.45 ELSE 0 END - CASE WHEN pr = 0 THEN 0.2 ELSE 0 END - least(0.3, 0.1 * near) - CASE WHEN topic LIKE '%1' THEN 0.15 ELSE 0 END - CASE WHEN n < 5 THEN 0.15 ELSE 0 END
  - CASE WHEN coalesce(inversions > 0 AND inversions >= dated // 3, false) THEN 0.1 ELSE 0 END), 6) AS confidence FROM a LEFT JOIN ch USING (topic)""")
def _(spark, d):
    steps = _steps(spark, d)
    return curriculum.confidence(steps, steps.where("topic LIKE '%1'")).select("topic", F.round("confidence", 6).alias("confidence"))


@query("q42_chronology", f"WITH {_STEPS}, {_CHRON} SELECT topic, dated, inversions, inversions > 0 AND inversions >= dated // 3 AS backwards FROM ch")
def _(spark, d):
    return curriculum.chronology(_steps(spark, d))


@query("q43_abstract_positions", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), ' ') AS abstract FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) > 0")
def _(spark, d):
    words = F.expr(r"filter(split(text, r'[ \t\n\r\f\x0B]+'), w -> w <> '')")
    index = x.table(spark, d, "documents").where(F.col("text").rlike(r"[^ \t\n\r\f\x0B]")).select("doc_id", text.positions(words).alias("m"))
    return index.select("doc_id", text.abstract_from_positions(F.col("m")).alias("abstract"))


@query("q44_strip_tags", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def _(spark, d):
    return x.table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("q45_first_sentence", f"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), f AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?] +[A-Z]') THEN regexp_extract(t, '^(.*?[.!?]) +[A-Z]', 1) ELSE t END AS x FROM s)
 SELECT doc_id, CASE WHEN length(x) > 300 THEN substr(x, 1, 297) || '...' ELSE x END AS sentence FROM f""")
def _(spark, d):
    return x.table(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("q46_cache_probe", """WITH r AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations), h AS (SELECT id, min(pos) AS pos FROM r, (VALUES (0), (1)) t(pos) WHERE (id + pos) % 3 = 0 GROUP BY 1)
 SELECT id, 'm' || pos AS model, pos > 0 AS fell_back FROM h""")
def _(spark, d):
    rows = x.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("judge").alias("role"), F.lit("1").alias("prompt_version"), F.col("role").alias("system"), F.concat("text", F.lit("#"), F.col("conv_id"), F.lit("."), F.col("turn")).alias("user"))
    chain = spark.createDataFrame([("judge", 0, "local", "m0"), ("judge", 1, "local", "m1")], "role string, chain_pos int, provider string, model string")
    known = rows.join(chain, "role").where((F.col("id") + F.col("chain_pos")) % 3 == 0).select(model_calls.cache_key().alias("key"), F.lit("{}").alias("data"))
    return model_calls.probe(rows, chain, known)[0].select("id", "model", "fell_back")


@query("q47_windowed_hits", "SELECT date_trunc('hour', ts) AS start, user_id AS item, count(*) AS hits, round(count(*) / 61.0, 9) AS score FROM events GROUP BY ALL")
def _(spark, d):
    events = x.table(spark, d, "events").select("ts", F.col("user_id").alias("item"), F.lit(1).alias("rank"))
    return windowed_hits(events).withColumn("score", F.round("score", 9))


@query("q48_search", f"""WITH RECURSIVE {_ROOTS}, m AS (SELECT f.topic, r.root, arg_min(p.title, f.paper_id) AS title, min(f.year) AS year, min(CAST(f.own AS VARCHAR)) AS own FROM roots r JOIN f ON f.paper_id = r.row_id JOIN x_papers p ON p.paper_id = f.paper_id GROUP BY ALL),
 n AS (SELECT topic, root, title, {_CANONICAL} AS paper_id FROM m),
 h AS (SELECT p.topic, n.paper_id, v, min(CASE v WHEN 'a' THEN rn + 1 ELSE (rn * 7) % 1009 + 1 END) AS rank FROM x_papers p, (VALUES ('a'), ('b')) t(v), roots r, n WHERE r.row_id = p.paper_id AND n.root = r.root AND n.topic = p.topic AND CASE v WHEN 'a' THEN rn + 1 ELSE (rn * 7) % 1009 + 1 END <= 25 GROUP BY ALL),
 s AS (SELECT topic, paper_id, sum(1.0::DOUBLE / (60 + rank) ORDER BY v) AS score, count(*) AS k FROM h GROUP BY ALL)
 SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, k DESC, lower(title), paper_id) AS INTEGER) AS position, paper_id, round(score, 9) AS score FROM s JOIN n USING (topic, paper_id) QUALIFY position <= 300""")
def _(spark, d):
    records = _records(spark, d)
    hits = x.papers(spark, d).select(F.col("paper_id").alias("row_id"), "topic", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("provider"), "rn").select("row_id", "topic", "provider", F.when(F.col("provider") == "a", F.col("rn") + 1).otherwise((F.col("rn") * 7) % 1009 + 1).alias("rank"))
    return paths.search(records, hits.drop("topic").join(records.select("topic", "row_id"), "row_id")).select("topic", "position", "paper_id", F.round("score", 9).alias("score"))


@query("q49_response_key", """SELECT page_id, sha256('web' || chr(0) || url || chr(0) || '{"a":"1","page":"' || page_id || '"}') AS key FROM pages""")
def _(spark, d):
    params = F.create_map(F.lit("page"), F.col("page_id").cast("string"), F.lit("a"), F.lit("1"))
    return x.table(spark, d, "pages").select("page_id", request_key(F.lit("web"), F.col("url"), params).alias("key"))


@query("q50_shortlist", f"""WITH {x.COUNTS}, b AS (SELECT topic, paper_id, 0 AS k, -n AS o FROM x_counts WHERE n >= 2 UNION ALL SELECT topic, paper_id, 1, seed_rank FROM x_seeds WHERE seed_rank <= 20),
 u AS (SELECT *, row_number() OVER (PARTITION BY topic, paper_id ORDER BY k, o) AS r FROM b QUALIFY r = 1) SELECT topic, paper_id, row_number() OVER (PARTITION BY topic ORDER BY k, o, paper_id) AS position FROM u QUALIFY position <= 40""")
def _(spark, d):
    s = x.seeds(spark, d)
    return curriculum.shortlist(expansion.co_citations(x.citations(spark, d), s), s).withColumn("position", F.col("position").cast("long"))


def _answers(spark, d):
    """Every second paper, in the order of its number, with a stage by that number."""
    stage = F.element_at(F.array(*map(F.lit, ("prerequisite", "anchor", "followup"))), (F.col("rn") % 3 + 1).cast("int"))
    return x.papers(spark, d).where("rn % 2 = 0").select("topic", "paper_id", F.col("rn").alias("position"), stage.alias("stage"), F.lit("c").alias("concept"))


_STEPS = ("topic", "position", "paper_id", "stage", "prerequisite_id", "role", "confidence")
_ROLES = "CASE stage WHEN 'prerequisite' THEN 'foundation' WHEN 'anchor' THEN 'breakthrough' ELSE 'extension' END"


@query("q51_rerank_path", f"""WITH {x.SEEDS}, c AS (SELECT c.topic, c.cited_id AS paper_id, count(DISTINCT c.citing_id) AS n FROM x_cites c JOIN x_seeds s ON s.topic = c.topic AND s.paper_id = c.citing_id AND s.seed_rank <= 25 GROUP BY ALL),
 o AS (SELECT topic, paper_id, 0 AS k, -n AS o FROM c WHERE n >= 2 UNION ALL SELECT topic, paper_id, 1, seed_rank FROM x_seeds WHERE seed_rank <= 20),
 f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY topic, paper_id ORDER BY k, o) = 1), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY topic ORDER BY k, o, paper_id) <= 40),
 s AS (SELECT topic, paper_id, year, ['prerequisite', 'anchor', 'followup'][rn % 3 + 1] AS stage, row_number() OVER (PARTITION BY topic ORDER BY rn, paper_id) - 1 AS position FROM l JOIN x_papers USING (topic, paper_id) WHERE rn % 2 = 0),
 t AS (SELECT * FROM s WHERE position < 24), y AS (SELECT topic, year, lag(year) OVER (PARTITION BY topic ORDER BY position) AS before FROM t WHERE year IS NOT NULL),
 i AS (SELECT topic, count(*) AS dated, count(*) FILTER (year < before - 2) AS inv FROM y GROUP BY 1),
 q AS (SELECT topic, 1.0::DOUBLE - CASE WHEN count(*) FILTER (stage = 'anchor') = 0 THEN 0.45 ELSE 0 END - CASE WHEN count(*) FILTER (stage = 'prerequisite') = 0 THEN 0.2 ELSE 0 END - CASE WHEN count(*) < 5 THEN 0.15 ELSE 0 END
   - max(CASE WHEN inv > 0 AND inv >= dated // 3 THEN 0.1 ELSE 0 END) AS c FROM t LEFT JOIN i USING (topic) GROUP BY 1)
 SELECT topic, position, paper_id, stage, lag(paper_id) OVER (PARTITION BY topic ORDER BY position) AS prerequisite_id, {_ROLES} AS role, round(greatest(0, least(1, c)), 6)::DOUBLE AS confidence FROM t JOIN q USING (topic)""")
def _(spark, d):
    return paths.build_path("rerank", x.papers(spark, d), x.citations(spark, d), x.seeds(spark, d), answers=_answers(spark, d)).select(*_STEPS).withColumn("confidence", F.round("confidence", 6))


#: x_syllabus and x_anchor: steps (topic, position, paper_id, year, stage, concept, approximate) of both planners; x_lost: topics with a title that wasn't found.
_PLANNED = f"""{x.CITES}, res AS ({_RESOLVED}), pl AS (SELECT topic, rn AS step, ['prerequisite', 'anchor', 'followup'][rn % 3 + 1] AS stage FROM x_papers),
 x_lost AS (SELECT DISTINCT topic FROM pl ANTI JOIN (SELECT topic, step FROM res WHERE accepted) f USING (topic, step)),
 ph AS (SELECT pl.topic, pl.step, pl.stage, r.paper_id, p.year, r.confident, {FP.format('p.title')} AS fp FROM pl JOIN res r ON r.topic = pl.topic AND r.step = pl.step JOIN x_papers p ON p.topic = r.topic AND p.paper_id = r.paper_id WHERE r.accepted),
 pa AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY topic, paper_id ORDER BY step) = 1), pb AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY topic, fp ORDER BY step) = 1),
 x_syllabus AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY step) - 1 AS position, paper_id, year, stage, 'step' AS concept, NOT confident AS approximate FROM pb QUALIFY position < 24),
 an AS (SELECT topic, paper_id, year, row_number() OVER (PARTITION BY topic ORDER BY step) AS r FROM ph WHERE stage = 'anchor' QUALIFY r <= 2), a1 AS (SELECT topic, paper_id FROM an WHERE r = 1),
 bf AS (SELECT p.topic, p.paper_id, p.year, row_number() OVER (PARTITION BY p.topic ORDER BY p.citation_count DESC, p.paper_id) AS r FROM a1 JOIN x_cites c ON c.topic = a1.topic AND c.citing_id = a1.paper_id JOIN x_papers p ON p.topic = c.topic AND p.paper_id = c.cited_id QUALIFY r <= 12),
 af AS (SELECT p.topic, p.paper_id, p.year, row_number() OVER (PARTITION BY p.topic ORDER BY p.citation_count DESC, p.paper_id) AS r FROM a1 JOIN x_cites c ON c.topic = a1.topic AND c.cited_id = a1.paper_id JOIN x_papers p ON p.topic = c.topic AND p.paper_id = c.citing_id QUALIFY r <= 24),
 al AS (SELECT *, 0 AS k, 'prerequisite' AS stage, 'its references' AS concept FROM bf UNION ALL SELECT *, 1, 'anchor', 'step' FROM an UNION ALL SELECT *, 2, 'followup', 'what cites it' FROM af),
 ao AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY topic, paper_id ORDER BY k, r) = 1),
 x_anchor AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY k, r) - 1 AS position, paper_id, year, stage, concept, false AS approximate FROM ao QUALIFY position < 24)"""


def _assembled(steps: str, more: str) -> str:
    """SQL: `steps` with what stands before, roles and confidence."""
    return f"""t AS ({steps}), y AS (SELECT topic, year, lag(year) OVER (PARTITION BY topic ORDER BY position) AS before FROM t WHERE year IS NOT NULL),
 i AS (SELECT topic, count(*) AS dated, count(*) FILTER (year < before - 2) AS inv FROM y GROUP BY 1),
 q AS (SELECT t.topic, 1.0::DOUBLE - CASE WHEN count(*) FILTER (stage = 'anchor') = 0 THEN 0.45 ELSE 0 END - CASE WHEN count(*) FILTER (stage = 'prerequisite') = 0 THEN 0.2 ELSE 0 END - least(0.3, 0.1 * count(*) FILTER (approximate))
   - max(CASE WHEN l.topic IS NULL THEN 0 ELSE 0.15 END) - CASE WHEN count(*) < 5 THEN 0.15 ELSE 0 END - max(CASE WHEN inv > 0 AND inv >= dated // 3 THEN 0.1 ELSE 0 END) AS c FROM t LEFT JOIN i USING (topic) LEFT JOIN x_lost l USING (topic) GROUP BY 1)
 SELECT topic, position, paper_id, stage, lag(paper_id) OVER (PARTITION BY topic ORDER BY position) AS prerequisite_id, {_ROLES} AS role, round(greatest(0, least(1, c)), 6)::DOUBLE AS confidence, {more} FROM t JOIN q USING (topic)"""


@query("q52_syllabus_path", f"WITH {_PLANNED}, {_assembled('FROM x_syllabus', 'approximate, concept')}")
def _(spark, d):
    return paths.build_path("syllabus", x.papers(spark, d), x.citations(spark, d), x.seeds(spark, d), _plan(spark, d)).select(*_STEPS, "approximate", "concept").withColumn("confidence", F.round("confidence", 6))


@query("q53_anchor_path", f"WITH {_PLANNED}, {_assembled('FROM x_anchor', 'concept')}")
def _(spark, d):
    return paths.build_path("anchor", x.papers(spark, d), x.citations(spark, d), x.seeds(spark, d), _plan(spark, d)).select(*_STEPS, "concept").withColumn("confidence", F.round("confidence", 6))


@query("q54_hybrid_path", f"""WITH {_PLANNED}, good AS (SELECT topic FROM x_syllabus GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (stage = 'anchor') > 0), other AS (SELECT DISTINCT topic FROM x_anchor WHERE topic NOT IN (FROM good)),
 {_assembled("SELECT * FROM x_syllabus WHERE topic NOT IN (FROM other) UNION ALL SELECT * FROM x_anchor WHERE topic IN (FROM other)", "concept")}""")
def _(spark, d):
    return paths.build_path("hybrid", x.papers(spark, d), x.citations(spark, d), x.seeds(spark, d), _plan(spark, d)).select(*_STEPS, "concept").withColumn("confidence", F.round("confidence", 6))


@query("q55_notes", f"WITH {x.COUNTS} SELECT topic, count(*) AS papers, count(*) FILTER (WHERE year IS NULL) AS undated, count(*) FILTER (WHERE seed_rank IS NULL) AS discovered, CAST(sum(out_degree) AS BIGINT) AS edges FROM x_facts GROUP BY 1")
def _(spark, d):
    return summaries.notes(x.papers(spark, d), x.citations(spark, d), x.seeds(spark, d))


@query("q56_path_parts", f"WITH {x.PAPERS} SELECT topic, ['prerequisite', 'anchor', 'followup'][paper_id % 3 + 1] AS part, count(*) AS steps, min(rn) AS first_position, min(year) AS first_year, max(year) AS last_year FROM x_papers GROUP BY ALL")
def _(spark, d):
    return summaries.parts(_steps(spark, d)).withColumn("first_position", F.col("first_position").cast("long"))


@query("q57_prompt_rows", f"WITH {x.PAPERS} SELECT paper_id, substr(text, 1, 400) AS shown, coalesce(CAST(year AS VARCHAR), 'n.d.') AS year, CASE WHEN year IS NULL THEN 'undated' WHEN year < 2015 THEN 'earlier' ELSE 'recent' END AS era FROM x_papers JOIN documents ON doc_id = paper_id")
def _(spark, d):
    texts = x.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return x.papers(spark, d).join(texts, "paper_id").select("paper_id", summaries.shown(F.col("text"), "explain").alias("shown"), summaries.shown_year(F.col("year")).alias("year"), summaries.era(F.col("year")).alias("era"))


@query("q58_subtopic_names", f"""WITH {x.PAPERS}, g AS (SELECT topic, rn % 3 AS community, list_sort(list(paper_id)) AS members FROM x_papers GROUP BY ALL HAVING count(*) > 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY community) AS position FROM g QUALIFY count(*) OVER (PARTITION BY topic) > 1)
 SELECT topic, community, CASE WHEN community = 1 THEN 'name of 1' ELSE 'Group ' || position END AS name, array_to_string(list_slice(members, 1, 6), ',') AS shown FROM o""")
def _(spark, d):
    nodes = x.papers(spark, d).withColumn("community", (F.col("rn") % 3).cast("long"))
    names = nodes.where("community = 1").select("topic", "community", F.lit("name of 1").alias("name")).distinct()
    named = judgment.named_subtopics(judgment.structural_subtopics(nodes), names)
    return named.select("topic", "community", "name", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"))


@query("q59_refined_roles", f"WITH {x.PAPERS} SELECT topic, paper_id, CASE WHEN rn % 2 = 1 THEN 'foundation' ELSE 'unclassified' END AS role FROM x_papers")
def _(spark, d):
    labels = judgment.labelled(x.papers(spark, d), "p", "rn")
    answers = labels.where(F.substring("label", 2, 9).cast("int") % 2 == 0).select("topic", "label", F.lit("foundation").alias("role"))
    return judgment.refine(x.papers(spark, d).select("topic", "paper_id", F.lit("unclassified").alias("role")), answers, labels, ["role"])


@query("q60_replaced_edges", f"WITH {x.CITES}, t AS (SELECT min(topic) AS topic FROM x_papers) SELECT topic, cited_id AS prerequisite_id, citing_id AS dependent_id, CASE WHEN topic IN (FROM t) THEN 'llm_judgment' ELSE 'co_citation' END AS source FROM x_cites WHERE topic NOT IN (FROM t) OR citing_id % 2 = 0")
def _(spark, d):
    edges = x.citations(spark, d).select("topic", F.col("cited_id").alias("prerequisite_id"), F.col("citing_id").alias("dependent_id"))
    first = x.papers(spark, d).agg(F.min("topic").alias("topic"))
    model = edges.where("dependent_id % 2 = 0").withColumn("source", F.lit("llm_judgment"))
    return judgment.replace_edges(edges.withColumn("source", F.lit("co_citation")), model, first)


@query("q61_remapped_edges", f"""WITH {x.CITES} SELECT DISTINCT topic, citing_id // 2 AS citing_id, cited_id // 2 AS cited_id FROM x_cites WHERE citing_id // 2 <> cited_id // 2""")
def _(spark, d):
    raw = x.citations(spark, d).select("topic", F.col("citing_id").alias("citing_row"), F.col("cited_id").alias("cited_row"))
    return expansion.remap_edges(raw, x.papers(spark, d).select(F.col("paper_id").alias("row_id"), F.floor(F.col("paper_id") / 2).alias("paper_id")))


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/citeweave-{name}-{uuid.uuid4().hex}"


@query("q64_cache_upsert", """SELECT sha256(conv_id || ':' || turn) AS key, 'crossref' AS provider, min(CASE WHEN turn % 2 = 0 THEN 'again ' || text ELSE text END) AS body FROM conversations GROUP BY conv_id, turn""")
def _(spark, d):
    turns = x.table(spark, d, "conversations")
    rows = turns.select(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256).alias("key"), F.lit("crossref").alias("provider"), F.col("text").alias("body"), F.lit(1).alias("results"), "turn")
    store = Store(spark, _fresh(spark, "cache"), response_cache.STORED, prefix=1)
    response_cache.keep(store, rows)
    later = rows.where("turn % 2 = 0").withColumn("body", F.concat(F.lit("again "), "body"))
    for _ in range(2):
        response_cache.keep(store, later)
    response_cache.keep(store, rows.withColumn("results", F.lit(0)).withColumn("body", F.lit("empty")))
    return store.read()


def _saved(spark, d):
    """Papers as pages of 25 search results, and citations as what each paper cites, in payloads of two services."""
    p = x.papers(spark, d)
    work = lambda n: F.struct(F.concat(F.lit("https://openalex.org/w"), F.col("paper_id")).alias("id"), F.col("title").alias("title"), F.col("year").alias("publication_year"), F.col("citation_count").cast("int").alias("cited_by_count"))
    pages = p.groupBy("topic", F.floor(F.col("rn") / 25).alias("page")).agg(F.array_sort(F.collect_list(F.struct("rn", work(0).alias("w")))).alias("r"))
    search = pages.select(F.lit("openalex").alias("provider"), F.lit("search").alias("mode"), "topic", F.lit(None).alias("of"), "page", F.to_json(F.struct(F.transform("r", lambda v: v["w"]).alias("results"))).alias("payload"))
    record = F.struct(F.col("cited_id").cast("string").alias("paperId"), F.concat(F.lit("Paper "), "cited_id").alias("title"))
    cited = x.citations(spark, d).groupBy("topic", F.col("citing_id").alias("of")).agg(F.array_sort(F.collect_list(record)).alias("r"))
    refs = cited.select(F.lit("semantic_scholar").alias("provider"), F.lit("cited_by").alias("mode"), "topic", "of", F.lit(0).alias("page"), F.to_json(F.struct(F.col("r").alias("data"))).alias("payload"))
    path = _fresh(spark, "payloads")
    payloads.save(search, path)
    payloads.save(refs, path)
    return path


@query("q65_saved_search", rf"WITH {x.PAPERS} SELECT topic, rn + 1 AS rank, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, year, 'W' || paper_id AS id FROM x_papers WHERE trim(title) <> ''")
def _(spark, d):
    found = payloads.records(spark, _saved(spark, d), "openalex")
    return found.select("topic", F.col("rank").cast("long").alias("rank"), "title", "year", F.get("external_ids", F.lit(0))["value"].alias("id"))


@query("q66_saved_citations", f"WITH {x.CITES} SELECT topic, CAST(citing_id AS VARCHAR) AS citing_id, CAST(cited_id AS VARCHAR) AS cited_id FROM x_cites")
def _(spark, d):
    return payloads.links(payloads.records(spark, _saved(spark, d), "semantic_scholar", "cited_by"), "cited_by").select("topic", "citing_id", "cited_id")
