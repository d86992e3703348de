"""The core's queries by name, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildloom.functions import any_like, code_points, first_case, is_text, like, literal_positions, strict_text, valid_text
from wildloom.operators import hierarchy, hotkeys, orphans, rejects
from wildloom.operators.search import literal_hits
from wildloom.operators.wildcard import MAX_BROADCAST, conjunctive_join, first_match, measure, wildcard_join
from wildloom.plans.patterns import fold_wildcards, literals, prepare_patterns, segments, skeleton, spark_like_column
from wildloom.plans.sqltext import like_join_sql
from wildloom.session import scratch_dir, table
from wildloom.sources import tables, workload
from wildloom.streaming.probe import drain, probe_stream, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- LIKE with constant patterns -----------------------------------------------------------------

FORMS = {
    "like_contains": ("hackernews", "id", "title", "%spell checker%", None),
    "like_prefix": ("hackernews", "id", "title", "Notes from%", None),
    "like_suffix": ("hackernews", "id", "title", "%wildcards", None),
    "like_exact": ("part", "p_partkey", "p_name", "red ring", None),
    "like_underscore": ("part", "p_partkey", "p_name", "_o_ %", None),
    "like_multi_segment": ("documents", "doc_id", "text", "%the%search_box%and%", None),
    "like_unicode": ("documents", "doc_id", "text", "%tr_s l__g%", None),
    "like_newline": ("documents", "doc_id", "text", "%.__It%", None),
    "like_escape": ("hackernews", "id", "text", "%!%!_%", "!"),
    "like_backslash": ("hackernews", "id", "text", "%C:\\temp%", None),
}


def _form(name: str, tab: str, key: str, col: str, pattern: str, escape: str | None) -> None:
    @query(name, f"SELECT {key} FROM {tab} WHERE {col} LIKE {sql_text(pattern)}" + (f" ESCAPE '{escape}'" if escape else ""))
    def run(spark, d):
        return table(spark, d, tab).where(like(F.col(col), pattern, escape)).select(key)


for _name, _args in FORMS.items():
    _form(_name, *_args)


@query("like_wildcard_only", "SELECT p_partkey, p_name LIKE '%' AS anything, p_name LIKE '________' AS eight, p_name LIKE '_________%' AS nine_up, p_name LIKE '' AS nothing FROM part")
def _wild(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", like(n, "%").alias("anything"), like(n, "________").alias("eight"), like(n, "_________%").alias("nine_up"), like(n, "").alias("nothing"))


@query("ilike_any", "SELECT id FROM hackernews WHERE title ILIKE '%ZEPH%' OR title ILIKE '%notes%trainee%' OR title ILIKE 'ask %'")
def _ilike(spark, d):
    return table(spark, d, "hackernews").where(any_like(F.col("title"), ["%ZEPH%", "%notes%trainee%", "ask %"], ignore_case=True)).select("id")


@query("not_ilike", "SELECT id FROM hackernews WHERE NOT (title ILIKE '%the%' OR title ILIKE '%a%')")
def _not_ilike(spark, d):
    return table(spark, d, "hackernews").where(~any_like(F.col("title"), ["%the%", "%a%"], ignore_case=True)).select("id")


# Parts of the product names in the test tables.
STEMS = ("Zeph", "Kort", "Velo", "Tind", "Lumb", "Garn", "Hesk", "Mosk")
ENDS = ("stack", "gate", "loom", "base", "mark", "query", "scan", "post")
SWEEP = [(f"%{s}_{e}%", f"{s} {e}") for e in ENDS for s in STEMS]
SIZES = (1, 2, 4, 8, 16, 32, 64)


def _by_label(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("score").cast("int")).alias("score_sum"), F.avg(F.col("descendants").cast("int")).alias("mean_descendants")).orderBy(F.desc("n_items"), label)


def _sweep(m: int) -> None:
    arms = SWEEP[:m]
    case = "CASE " + " ".join(f"WHEN title LIKE {sql_text(p)} THEN {sql_text(x)}" for p, x in arms) + " ELSE 'other' END"
    cond = " OR ".join(f"title LIKE {sql_text(p)}" for p, _ in arms)
    agg = "count(*) AS n_items, CAST(sum(score) AS BIGINT) AS score_sum, avg(CAST(descendants AS INT)) AS mean_descendants"

    @query(f"filter_or_p{m:03d}", f"SELECT {case} AS label, {agg} FROM hackernews WHERE type IN ('1', '5') AND deleted = '0' AND ({cond}) GROUP BY 1")
    def run_filter(spark, d):
        h = table(spark, d, "hackernews").where(F.col("type").isin(1, 5) & (F.col("deleted") == 0) & any_like(F.col("title"), [p for p, _ in arms]))
        return _by_label(h.withColumn("label", first_case(F.col("title"), arms, "other")), "label")

    values = ", ".join(f"({i}, {sql_text(p)}, {sql_text(x)})" for i, (p, x) in enumerate(arms, 1))

    @query(
        f"first_match_p{m:03d}",
        f"WITH patterns(priority, pattern, label) AS (VALUES {values}) SELECT (SELECT p.label FROM patterns p WHERE h.title LIKE p.pattern ORDER BY p.priority LIMIT 1) AS label, {agg} "
        "FROM hackernews h WHERE type IN ('1', '5') AND deleted = '0' AND EXISTS (SELECT 1 FROM patterns p WHERE h.title LIKE p.pattern) GROUP BY 1",
    )
    def run_join(spark, d):
        pats = spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(arms, 1)], "priority int, pattern string, label string")
        h = table(spark, d, "hackernews").where(F.col("type").isin(1, 5) & (F.col("deleted") == 0)).select("title", "score", "descendants")
        return _by_label(first_match(h, pats, "title", "pattern", "priority", "label", "label").where("label is not null"), "label")


for _m in SIZES:
    _sweep(_m)


@query(
    "case_first_match",
    "SELECT CASE WHEN p_name LIKE '%l%' THEN 'has l' WHEN p_name LIKE '_o_ %' OR p_name LIKE '%ring' THEN 'o or ring' WHEN p_name LIKE 'r__ %' THEN 'r' ELSE 'rest' END AS label, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY 1",
)
def _case(spark, d):
    arms = [("%l%", "has l"), (["_o_ %", "%ring"], "o or ring"), ("r__ %", "r")]
    return table(spark, d, "part").groupBy(first_case(F.col("p_name"), arms, "rest").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sizes"))


# Patterns of one product line and its parts in the test tables.
CURRENT = ["%zeph_stack%", "%zeph_gate%", "%zeph_loom%"]
EARLIER = [("%zepha%", "a line"), (["%zeph_b%", "%zeph_m%"], "b and m line")]


@query(
    "engagement_share",
    """WITH live AS (SELECT id, parent, score, descendants, CASE WHEN type = 1 THEN lower(title) END AS story FROM hackernews WHERE deleted = 0 AND dead = 0),
answers AS (SELECT parent AS id, count(*) AS n, avg(id) AS mid FROM live GROUP BY parent),
labelled AS (
  SELECT id, score, descendants, 'current' AS line FROM live WHERE story LIKE '%zeph_stack%' OR story LIKE '%zeph_gate%' OR story LIKE '%zeph_loom%'
  UNION ALL
  SELECT id, score, descendants, CASE WHEN story LIKE '%zepha%' THEN 'a line' WHEN story LIKE '%zeph_b%' OR story LIKE '%zeph_m%' THEN 'b and m line' ELSE 'first line' END
  FROM live WHERE story LIKE '%zeph%' AND story NOT LIKE '%zeph_stack%' AND story NOT LIKE '%zeph_gate%' AND story NOT LIKE '%zeph_loom%'),
copies AS (SELECT id, score, descendants, line, count(*) AS k FROM labelled GROUP BY ALL),
lines AS (SELECT line, count(*) AS n_stories, sum(score) AS score_sum, sum(descendants) AS descendants_sum, avg(score) AS s, avg(k * n) AS a, avg(mid) AS m FROM copies JOIN answers USING (id) GROUP BY line)
SELECT line, n_stories, CAST(score_sum AS BIGINT) AS score_sum, CAST(descendants_sum AS BIGINT) AS descendants_sum, round(s, 1) AS mean_score, round(a, 1) AS mean_answers, round(m, 1) AS mean_answer_id,
  round(100.0 * CAST(score_sum AS DOUBLE) / CAST(sum(score_sum) OVER () AS DOUBLE), 1) AS score_share, round(100.0 * CAST(n_stories AS DOUBLE) / CAST(sum(n_stories) OVER () AS DOUBLE), 1) AS story_share
FROM lines""",
)
def _engagement(spark, d):
    live = table(spark, d, "hackernews").where("deleted = 0 and dead = 0")
    # answers are counted per story first, so a story with many of them is one row in the join
    answers = live.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("id").alias("mid"))
    stories = live.where("type = 1").select("id", "score", "descendants", "title")
    title = F.col("title")
    now = any_like(title, CURRENT, ignore_case=True)
    current = stories.where(now).withColumn("line", F.lit("current"))
    earlier = stories.where(like(title, "%zeph%", ignore_case=True) & ~now).withColumn("line", first_case(title, EARLIER, "first line", ignore_case=True))
    copies = current.unionByName(earlier).groupBy("id", "score", "descendants", "line").agg(F.count(F.lit(1)).alias("k"))
    lines = copies.join(answers, "id").groupBy("line").agg(
        F.count(F.lit(1)).alias("n_stories"), F.sum("score").alias("score_sum"), F.sum("descendants").alias("descendants_sum"),
        F.round(F.avg("score"), 1).alias("mean_score"), F.round(F.avg(F.col("k") * F.col("n")), 1).alias("mean_answers"), F.round(F.avg("mid"), 1).alias("mean_answer_id"),
    )
    # the share of the total needs all lines in one place; there are four of them
    total = lines.agg(F.sum("score_sum").alias("all_score"), F.sum("n_stories").alias("all_n"))
    share = lambda a, b: F.round(F.lit(100.0) * F.col(a).cast("double") / F.col(b).cast("double"), 1)
    shares = lines.crossJoin(F.broadcast(total)).withColumn("score_share", share("score_sum", "all_score")).withColumn("story_share", share("n_stories", "all_n"))
    return shares.drop("all_score", "all_n").orderBy(F.desc("score_sum"), "line")


# --- wildcard joins ------------------------------------------------------------------------------


def _titles(spark, d, *more):
    return table(spark, d, "hackernews").where("title is not null").select("id", "title", *more)


PAIRS = "SELECT h.id, t.topic_id FROM hackernews h JOIN topics t ON h.title LIKE t.pattern"


def _pairs(name: str, strategy: str) -> None:
    @query(name, PAIRS)
    def run(spark, d):
        return wildcard_join(_titles(spark, d), table(spark, d, "topics"), "title", "pattern", strategy=strategy).select("id", "topic_id")


for _n, _s in (("wildcard_join_pairs", "auto"), ("wildcard_join_nlj", "nested"), ("wildcard_join_ngram", "ngram"), ("wildcard_join_automaton", "automaton")):
    _pairs(_n, _s)


@query("wildcard_join_documents", "SELECT d.doc_id, t.topic_id FROM documents d JOIN topics t ON d.text LIKE t.pattern")
def _docs(spark, d):
    t = table(spark, d, "topics")
    return wildcard_join(table(spark, d, "documents").select("doc_id", "text"), t, "text", "pattern").select("doc_id", "topic_id")


@query("wildcard_join_length", "SELECT h.id, t.topic_id FROM hackernews h JOIN topics t ON h.title LIKE t.pattern WHERE length(replace(replace(t.pattern, '%', ''), '_', '')) = 0")
def _length(spark, d):
    t = table(spark, d, "topics").where("length(replace(replace(pattern, '%', ''), '_', '')) = 0")
    return wildcard_join(_titles(spark, d), t, "title", "pattern", strategy="automaton").select("id", "topic_id")


@query("wildcard_join_ilike", "SELECT h.id, t.topic_id FROM hackernews h JOIN topics t ON h.title ILIKE t.pattern")
def _join_ilike(spark, d):
    return wildcard_join(_titles(spark, d), table(spark, d, "topics"), "title", "pattern", ignore_case=True).select("id", "topic_id")


@query("wildcard_join_escape", "SELECT h.id, p.pid FROM hackernews h JOIN (VALUES (1, '%!%'), (2, '%!_%'), (3, 'We%!%'), (4, '%!!%')) p(pid, pat) ON h.title LIKE p.pat ESCAPE '!'")
def _join_escape(spark, d):
    p = spark.createDataFrame([(1, "%!%"), (2, "%!_%"), (3, "We%!%"), (4, "%!!%")], "pid int, pat string")
    return wildcard_join(_titles(spark, d), p, "title", "pat", escape="!").select("id", "pid")


@query(
    "wildcard_join_agg",
    "WITH good AS (SELECT id, title, score, descendants FROM hackernews WHERE type IN (1, 5) AND deleted = 0 AND score > 20) "
    "SELECT topic_id, pattern, count(DISTINCT id) AS n_items, CAST(sum(score) AS BIGINT) AS score_sum, CAST(sum(descendants) AS BIGINT) AS descendants_sum, avg(score) AS mean_score "
    "FROM topics JOIN good ON title LIKE pattern GROUP BY ALL HAVING count(DISTINCT id) > 1",
)
def _join1(spark, d):
    h = table(spark, d, "hackernews").where(F.col("type").isin(1, 5) & (F.col("deleted") == 0) & (F.col("score") > 20)).select("id", "title", "score", "descendants")
    per = wildcard_join(h, table(spark, d, "topics"), "title", "pattern").groupBy("topic_id", "pattern")
    out = per.agg(F.countDistinct("id").alias("n_items"), F.sum("score").alias("score_sum"), F.sum("descendants").alias("descendants_sum"), F.avg("score").alias("mean_score"))
    return out.where("n_items > 1").orderBy(F.desc("score_sum"), "topic_id")


@query(
    "wildcard_join_cast",
    "SELECT h.id, t.topic_id FROM hackernews h JOIN topics t ON h.title LIKE t.pattern WHERE CAST(h.type AS VARCHAR) IN ('1', '5') AND CAST(CAST(h.score AS VARCHAR) AS INT) BETWEEN 5 AND 50",
)
def _join_cast(spark, d):
    h = _titles(spark, d, "type", "score").where("cast(type as string) in ('1', '5') and cast(cast(score as string) as int) between 5 and 50")
    return wildcard_join(h, table(spark, d, "topics"), "title", "pattern").select("id", "topic_id")


def _semi_anti(name: str, how: str, word: str) -> None:
    @query(name, f"SELECT h.id FROM hackernews h WHERE h.type = 1 AND {word} (SELECT 1 FROM blocklists b WHERE h.url LIKE b.host_pattern)")
    def run(spark, d):
        h = table(spark, d, "hackernews").where("type = 1").select("id", "url")
        return wildcard_join(h, table(spark, d, "blocklists"), "url", "host_pattern", how=how).select("id")


_semi_anti("wildcard_semi", "semi", "EXISTS")
_semi_anti("wildcard_anti", "anti", "NOT EXISTS")


@query(
    "topics_without_blocked",
    "WITH stories AS (SELECT * FROM hackernews WHERE type IN (1, 5) AND deleted = 0), bad AS (SELECT DISTINCT s.id FROM stories s JOIN blocklists b ON s.url LIKE b.host_pattern OR s.text LIKE b.host_pattern) "
    "SELECT topic_id, id, \"by\" AS account, title, url, text, score FROM stories JOIN topics ON title LIKE pattern WHERE id NOT IN (SELECT id FROM bad)",
)
def _join2(spark, d):
    h = table(spark, d, "hackernews").where(F.col("type").isin(1, 5) & (F.col("deleted") == 0) & F.col("title").isNotNull())
    h = h.select("id", F.col("by").alias("account"), "title", "url", "text", "score")
    blocked = table(spark, d, "blocklists")
    clean = wildcard_join(wildcard_join(h, blocked, "url", "host_pattern", how="anti"), blocked, "text", "host_pattern", how="anti")
    return wildcard_join(clean, table(spark, d, "topics"), "title", "pattern").drop("pattern")


@query(
    "thread_coherence",
    "WITH told AS (SELECT s.id AS story, c.id AS answer, c.by AS account, s.title, c.text FROM hackernews c JOIN hackernews s ON s.id = c.parent AND s.type IN (1, 5) AND s.deleted = 0 WHERE c.type = 2 AND c.deleted = 0) "
    "SELECT topic_id, pattern, count(DISTINCT story) AS n_stories, count(DISTINCT answer) AS n_answers, count(DISTINCT account) AS n_accounts FROM topics JOIN told ON title LIKE pattern AND text LIKE pattern GROUP BY ALL HAVING count(DISTINCT answer) > 4",
)
def _join3(spark, d):
    h = table(spark, d, "hackernews").where("deleted = 0")
    stories = h.where(F.col("type").isin(1, 5) & F.col("title").isNotNull()).select(F.col("id").alias("story"), "title")
    answers = h.where("type = 2 and text is not null").select(F.col("parent").alias("story"), F.col("id").alias("answer"), F.col("by").alias("account"), "text")
    both = conjunctive_join(stories.join(answers, "story"), ("title", "text"), table(spark, d, "topics"), "pattern")
    out = both.groupBy("topic_id", "pattern").agg(F.countDistinct("story").alias("n_stories"), F.countDistinct("answer").alias("n_answers"), F.countDistinct("account").alias("n_accounts"))
    return out.where("n_answers > 4").orderBy(F.desc("n_answers"), "topic_id")


@query(
    "literal_hits",
    "WITH l AS (SELECT DISTINCT literal FROM (SELECT unnest(regexp_split_to_array(pattern, '[%_]')) AS literal FROM topics) WHERE length(literal) > 0) "
    "SELECT h.id, l.literal, CAST(i AS INT) AS position FROM hackernews h JOIN l ON contains(h.title, l.literal), unnest(range(1, length(h.title) - length(l.literal) + 2)) AS u(i) WHERE substr(h.title, i, length(l.literal)) = l.literal",
)
def _hits(spark, d):
    p = prepare_patterns(table(spark, d, "topics"), "pattern")
    return literal_hits(_titles(spark, d), "title", p.select(F.explode(literals(F.col("like_pattern"))).alias("l")), "l").drop("title")


@query(
    "literal_positions",
    "SELECT h.id, p.literal, CAST(i AS INT) AS position FROM hackernews h, (VALUES ('an'), ('aa')) p(literal), unnest(range(1, greatest(length(h.title) - length(p.literal) + 2, 1))) AS u(i) WHERE substr(h.title, i, length(p.literal)) = p.literal",
)
def _positions(spark, d):
    t = _titles(spark, d)
    parts = [t.select("id", F.lit(w).alias("literal"), F.explode(literal_positions(F.col("title"), w)).alias("position")) for w in ("an", "aa")]
    return parts[0].unionByName(parts[1])


@query(
    "pattern_stats",
    "SELECT topic_id, CASE WHEN pattern IS NULL THEN NULL WHEN pattern NOT LIKE '%!%%' ESCAPE '!' AND pattern NOT LIKE '%!_%' ESCAPE '!' THEN 'exact' WHEN length(replace(replace(pattern, '%', ''), '_', '')) = 0 THEN 'length' ELSE 'literal' END AS kind, "
    "CAST(len(list_filter(regexp_split_to_array(pattern, '[%_]'), lambda x: length(x) > 0)) AS INT) AS n_literals, CAST(length(pattern) - length(replace(pattern, '_', '')) AS INT) AS n_underscores, CAST(length(replace(pattern, '%', '')) AS INT) AS min_len FROM topics",
)
def _stats(spark, d):
    return prepare_patterns(table(spark, d, "topics"), "pattern").select("topic_id", F.col("like_kind").alias("kind"), F.col("like_literals").alias("n_literals"), F.col("like_underscores").alias("n_underscores"), F.col("like_min_len").alias("min_len"))


@query("pattern_segments", "SELECT topic_id, CAST(i - 1 AS INT) AS place, parts[i] AS segment FROM (SELECT topic_id, regexp_split_to_array(pattern, '%+') AS parts FROM topics), unnest(range(1, len(parts) + 1)) AS u(i)")
def _segments(spark, d):
    return table(spark, d, "topics").select("topic_id", F.posexplode(segments(spark_like_column(F.col("pattern")))).alias("place", "segment"))


@query("pattern_folded", "SELECT topic_id, regexp_replace(regexp_replace(regexp_replace(pattern, '%(_+)', '\\1%', 'g'), '%(_+)', '\\1%', 'g'), '%+', '%', 'g') AS folded FROM topics")
def _folded(spark, d):
    return table(spark, d, "topics").select("topic_id", fold_wildcards(spark_like_column(F.col("pattern"))).alias("folded"))


@query(
    "pattern_skeleton",
    "WITH s AS (SELECT topic_id, CAST(i - 1 AS INT) AS place, parts[i] AS segment FROM (SELECT topic_id, regexp_split_to_array(pattern, '%+') AS parts FROM topics), unnest(range(1, len(parts) + 1)) AS u(i)) "
    "SELECT topic_id, place, array_to_string(list_filter(regexp_split_to_array(segment, '_+'), lambda x: length(x) > 0), '|') AS literals, array_to_string(list_transform(regexp_split_to_array(segment, '[^_]+'), lambda x: length(x)), ',') AS gaps FROM s",
)
def _skeleton(spark, d):
    s = table(spark, d, "topics").select("topic_id", F.posexplode(skeleton(spark_like_column(F.col("pattern")))).alias("place", "s"))
    return s.select("topic_id", "place", F.array_join("s.literals", "|").alias("literals"), F.array_join(F.transform("s.gaps", lambda g: g.cast("string")), ",").alias("gaps"))


@query(
    "literal_occurrences",
    "SELECT literal, count(*) AS n_places, array_to_string(list_sort(list(DISTINCT topic_id)), ',') AS topics FROM (SELECT topic_id, unnest(regexp_split_to_array(pattern, '[%_]')) AS literal FROM topics) WHERE length(literal) > 0 GROUP BY literal",
)
def _occurrences(spark, d):
    p = prepare_patterns(table(spark, d, "topics"), "pattern").select("topic_id", F.explode(literals(F.col("like_pattern"))).alias("literal"))
    topics = F.concat_ws(",", F.transform(F.array_sort(F.collect_set("topic_id")), lambda x: x.cast("string")))
    return p.groupBy("literal").agg(F.count(F.lit(1)).alias("n_places"), topics.alias("topics"))


@query("generated_join", "SELECT h.id, t.topic_id FROM hackernews h JOIN topics t ON h.title ILIKE t.pattern WHERE h.type = 1")
def _generated(spark, d):
    _titles(spark, d, "type").where("type = 1").createOrReplaceTempView("wl_texts")
    table(spark, d, "topics").createOrReplaceTempView("wl_patterns")
    small = measure(prepare_patterns(table(spark, d, "topics"), "pattern")).size <= MAX_BROADCAST
    return spark.sql(like_join_sql("wl_texts", "wl_patterns", ["t.id", "p.topic_id"], "title", "pattern", ignore_case=True, order_by=["t.id", "p.topic_id"], broadcast=small))


@query("csv_all_items", "SELECT id, deleted, type, \"by\", time, text, dead, parent, poll, url, score, title, descendants FROM hackernews")
def _csv_all(spark, d):
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(tables.as_items(table(spark, d, "hackernews")), path)
    return tables.read_csv(spark, path, tables.ITEMS, line_sep="\n")


# Rows, bytes, corpus digest, pairs and their digest of two of the synthetic workloads.
PUBLISHED = [("long_text_M=1k", 1000, 3498782, "facf65c6cf27d2f4", 1719, "78be4e47d20db721"), ("wildcards_M=100", 2000, 698678, "2f5f992a5ca0f0dd", 5866, "d8b61f584999a0fe")]
_WORKLOADS = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({t} AS BIGINT), CAST({b} AS BIGINT), '{x}', CAST({k} AS BIGINT), '{y}')" for n, t, b, x, k, y in PUBLISHED) + ") v(name, n_texts, n_bytes, corpus_digest, n_pairs, pairs_digest)"
_MEASURES = "name string, n_texts long, n_bytes long, corpus_digest string, n_pairs long, pairs_digest string"


@query("workload_digests", _WORKLOADS)
def _workloads(spark, d):
    rows = []
    for name, *_ in PUBLISHED:
        texts, patterns = workload.generate(workload.SPECS[name])
        pairs = [tuple(r) for r in wildcard_join(*workload.frames(spark, workload.SPECS[name]), "text", "pattern").select("text_id", "pattern_id").collect()]
        rows.append((name, len(texts), sum(map(len, texts)), workload.corpus_digest(texts, patterns), len(pairs), workload.pairs_digest(pairs)))
    return spark.createDataFrame(rows, _MEASURES)


@query("expected_values", _WORKLOADS)
def _expected(spark, d):
    path = f"{scratch_dir(spark)}/expected-{uuid.uuid4().hex}"
    tables.write_expected(spark, PUBLISHED, path, "name, texts, bytes, corpus, pairs, result")
    names = [x.split(" ") for x in _MEASURES.split(", ")]
    return tables.read_expected(spark, path).select(*[F.col(f"_c{i}").cast(k).alias(n) for i, (n, k) in enumerate(names)])


CORPUS_PATTERNS = [(1, "%RED!_%"), (2, "_O_ %"), (3, "%ring"), (4, "R__ %"), (5, "%!%%"), (6, "%l% bolt"), (7, None), (8, "blue gear")]
_CORPUS = "(VALUES " + ", ".join(f"({i}, {'NULL' if x is None else sql_text(x)})" for i, x in CORPUS_PATTERNS) + ") c(pattern_id, pattern)"


@query("corpus_directory", f"SELECT CAST(p_partkey AS BIGINT) AS text_id, CAST(pattern_id AS BIGINT) AS pattern_id, pattern_id % 2 = 1 AS labelled FROM part JOIN {_CORPUS} ON p_name ILIKE pattern ESCAPE '!'")
def _corpus(spark, d):
    path = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    texts = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("text_id"), F.col("p_name").alias("text"))
    patterns = spark.createDataFrame(CORPUS_PATTERNS, "pattern_id long, pattern string")
    labels = wildcard_join(texts, patterns.where("pattern_id % 2 = 1"), "text", "pattern", escape="!", ignore_case=True).select("text_id", "pattern_id")
    tables.write_corpus(tables.Corpus(texts, patterns, labels, True, "!"), path)
    back = tables.read_corpus(spark, path)
    pairs = wildcard_join(back.texts, back.patterns, "text", "pattern", escape=back.escape, ignore_case=back.ilike).select("text_id", "pattern_id")
    marked = pairs.join(back.labels.withColumn("labelled", F.lit(True)), ["text_id", "pattern_id"], "left")
    return marked.withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query("jsonl_items", "SELECT id, deleted, type, \"by\", time, text, dead, parent, poll, url, score, title, descendants FROM hackernews")
def _jsonl(spark, d):
    path = f"{scratch_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    tables.write_jsonl(tables.as_items(table(spark, d, "hackernews")), path)
    return tables.read_jsonl(spark, path, tables.ITEMS)


@query("distinct_literals", "SELECT count(DISTINCT x) AS n FROM (SELECT unnest(regexp_split_to_array(pattern, '[%_]')) AS x FROM topics) WHERE length(x) > 0")
def _distinct(spark, d):
    p = prepare_patterns(table(spark, d, "topics"), "pattern")
    return p.select(F.explode(literals(F.col("like_pattern"))).alias("x")).agg(F.countDistinct("x").alias("n"))


@query("one_text_many", "SELECT h.id, string_agg(t.topic_id, ',' ORDER BY t.topic_id) AS topics FROM (SELECT DISTINCT id, title FROM hackernews) h JOIN topics t ON h.title LIKE t.pattern GROUP BY h.id")
def _many(spark, d):
    pairs = wildcard_join(_titles(spark, d).dropDuplicates(["id"]), table(spark, d, "topics"), "title", "pattern")
    return pairs.groupBy("id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("topic_id")), lambda x: x.cast("string"))).alias("topics"))


@query("text_lengths", "SELECT doc_id, CAST(length(text) AS INT) AS n_points, CAST(strlen(text) AS INT) AS n_bytes, lower(text) = text AS is_lower FROM documents")
def _lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", code_points(F.col("text")).alias("n_points"), F.octet_length("text").alias("n_bytes"), (F.lower("text") == F.col("text")).alias("is_lower"))


@query(
    "strict_utf8",
    "SELECT doc_id, text AS strict, length(text) AS n_points, strlen(text) AS n_bytes, true AS valid, false AS valid_broken, text || chr(65533) || '!' AS mended FROM documents WHERE text IS NOT NULL",
)
def _utf8(spark, d):
    whole = F.col("text").cast("binary")
    broken = F.concat(whole, F.unhex(F.lit("E282")), F.lit("!").cast("binary"))
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", strict_text(whole).alias("strict"), code_points(F.col("text")).cast("long").alias("n_points"), F.octet_length("text").cast("long").alias("n_bytes"), is_text(whole).alias("valid"), is_text(broken).alias("valid_broken"), valid_text(broken).alias("mended"))


@query("score_stats", "SELECT type, quantile_disc(score, 0.5) AS median, avg(score) AS mean, count(score) AS n FROM hackernews WHERE score IS NOT NULL GROUP BY type")
def _stats2(spark, d):
    return table(spark, d, "hackernews").where("score is not null").groupBy("type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)").cast("int").alias("median"), F.avg("score").alias("mean"), F.count("score").alias("n"))


@query("stream_wildcard_join", PAIRS)
def _stream(spark, d):
    h = table(spark, d, "hackernews")
    s = spark.readStream.schema(h.schema).parquet(f"{d}/hackernews.parquet*").where("title is not null").select("id", "title")
    return drain(probe_stream(s, table(spark, d, "topics"), "title", "pattern").select("id", "topic_id"))


@query(
    "stream_windowed_counts",
    "WITH p AS (SELECT h.time, t.topic_id FROM hackernews h JOIN topics t ON h.title LIKE t.pattern) "
    "SELECT CAST(date_trunc('day', time) AS DATE) AS day, topic_id, count(*) AS n FROM p WHERE date_trunc('day', time) + INTERVAL 1 DAY <= (SELECT max(time) - INTERVAL 7 DAY FROM p) GROUP BY ALL",
)
def _windows(spark, d):
    """Matches per day, of the days that end at least seven days before the newest match: others may still grow."""
    h = table(spark, d, "hackernews")
    s = spark.readStream.schema(h.schema).parquet(f"{d}/hackernews.parquet*").where("title is not null").select("id", "title", "time")
    counts = windowed_counts(probe_stream(s, table(spark, d, "topics"), "title", "pattern"), "time", ["topic_id"])
    return drain(counts).select(F.to_date("window.start").alias("day"), "topic_id", "n")


# --- 1: a few keys holding most records ----------------------------------------------------------


def _hot(h: DataFrame, field: str) -> DataFrame:
    h = h.withColumn("parent", F.nullif("parent", F.lit(0)))
    return hotkeys.hot_keys(h.select(F.col(field).alias("k"), "time", "score", "id"), "k", "time", "score", "id").select(F.lit(field).alias("field"), "hot_key")


@query(
    "p1_found",
    """WITH k AS (SELECT 'by' AS field, "by" AS hot_key, count(*) AS c FROM hackernews WHERE "by" IS NOT NULL GROUP BY 2
UNION ALL SELECT 'parent', CAST(parent AS VARCHAR), count(*) FROM hackernews WHERE parent IS NOT NULL AND parent <> 0 GROUP BY 2)
SELECT field, hot_key FROM k WHERE c * 50 >= (SELECT count(*) FROM hackernews)""",
)
def p1_found(spark, d):
    h = table(spark, d, "hackernews")
    return _hot(h, "by").unionByName(_hot(h, "parent"))


def _activity(name: str, field: str) -> None:
    @query(
        name,
        f"""WITH r AS (SELECT CAST("{field}" AS VARCHAR) AS key, time, score, lag(time) OVER (PARTITION BY "{field}" ORDER BY time NULLS LAST, id) AS before FROM hackernews WHERE "{field}" IS NOT NULL AND CAST("{field}" AS VARCHAR) <> '0'),
g AS (SELECT *, CASE WHEN time IS NOT NULL AND before IS NOT NULL THEN epoch_us(time) - epoch_us(before) END AS gap FROM r)
SELECT key, count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time, CAST(floor(max(gap) / 1000000) AS BIGINT) AS max_gap_s,
CAST(count(*) FILTER (gap > 86400000000) + (CASE WHEN count(time) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bursts, CAST(coalesce(sum(score), 0) AS BIGINT) AS value_sum FROM g GROUP BY key""",
    )
    def run(spark, d):
        h = table(spark, d, "hackernews").withColumn("parent", F.nullif("parent", F.lit(0)))
        return hotkeys.KeyedOrder(h, field, "time", "score", "id").results()


_activity("p1_accounts", "by")
_activity("p1_parents", "parent")

# --- 2: rows that fail to parse ------------------------------------------------------------------

_F = '(?:[^",\\r\\n]*|"(?:[^"]|"")*")'
_WHOLE = "^" + ",".join([f"({_F})"] * 13) + "$"
_NAMES = [f.name for f in rejects.ITEM_FIELDS]
_INT = "regexp_full_match({0}, '-?[0-9]+') AND try_cast({0} AS INT) IS NOT NULL"
_FLAG = "({0} IS NULL OR {0} IN ('0', '1'))"
_CLEAN = "({0} IS NULL OR NOT regexp_matches({0}, '[\\x{{FFFD}}\\x7F\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]'))"
P2_CTE = (
    "WITH m AS (SELECT *, coalesce(regexp_matches(payload, $re$" + _WHOLE + "$re$), false) AS fits FROM raw_items), "
    + "x AS (SELECT m.*, regexp_extract(payload, $re$" + _WHOLE + "$re$, [" + ", ".join(f"'f_{n}'" for n in _NAMES) + "]) AS f FROM m), "
    + "v AS (SELECT x.*, " + ", ".join(f"""nullif(CASE WHEN left(f.f_{n}, 1) = '"' THEN replace(substr(f.f_{n}, 2, length(f.f_{n}) - 2), '""', '"') ELSE f.f_{n} END, '') AS v_{n}""" for n in _NAMES) + " FROM x), "
    + "ok AS (SELECT v.*, fits AND v_id IS NOT NULL AND v_type IS NOT NULL AND v_time IS NOT NULL AND v_type IN ('1','2','3','4','5') AND "
    + _INT.format("v_id") + " AND regexp_full_match(v_time, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND try_cast(v_time AS TIMESTAMP) IS NOT NULL AND "
    + " AND ".join(_FLAG.format(f"v_{n}") for n in ("deleted", "dead")) + " AND "
    + " AND ".join(f"(v_{n} IS NULL OR (" + _INT.format(f"v_{n}") + "))" for n in ("parent", "poll", "score", "descendants")) + " AND "
    + " AND ".join(_CLEAN.format(f"v_{n}") for n in ("text", "title")) + " AS valid FROM v) "
)


@query("p2_found", P2_CTE + "SELECT record_id FROM ok WHERE NOT coalesce(valid, false)")
def p2_found(spark, d):
    return rejects.rejected(rejects.check_records(table(spark, d, "raw_items")), "record_id").select("record_id").distinct()


@query("p2_loaded", P2_CTE + "SELECT record_id, " + ", ".join(f'CAST(v_{f.name} AS {"VARCHAR" if f.sql == "string" else "TIMESTAMP" if f.kind == "time" else f.sql.upper()}) AS "{f.name}"' for f in rejects.ITEM_FIELDS) + " FROM ok WHERE valid")
def p2_loaded(spark, d):
    return rejects.load_valid(rejects.check_records(table(spark, d, "raw_items")), "record_id")


_FIT = "CASE WHEN length({0}) >= 2 AND left({0}, 1) = '\"' AND right({0}, 1) = '\"' THEN NOT contains(replace(substr({0}, 2, length({0}) - 2), '\"\"', ''), '\"') ELSE NOT regexp_matches({0}, '[\"\\r\\n]') END"
_RULE = {
    "int": "NOT coalesce(" + _INT + ", false)",
    "choice": "{0} NOT IN {1}",
    "time": "NOT (regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND try_cast({0} AS TIMESTAMP) IS NOT NULL)",
    "clean": "NOT " + _CLEAN,
}
_FAULTS = ["CASE WHEN payload IS NULL THEN 'no record' END", "CASE WHEN broken THEN 'quoting' END", "CASE WHEN NOT broken AND len(f) <> 13 THEN 'columns:' || len(f) END"]
for _f in rejects.ITEM_FIELDS:
    if _f.required:
        _FAULTS.append(f"CASE WHEN whole AND v_{_f.name} IS NULL THEN 'missing:{_f.name}' END")
    if _f.kind in _RULE:
        _FAULTS.append(f"CASE WHEN whole AND v_{_f.name} IS NOT NULL AND " + _RULE[_f.kind].format(f"v_{_f.name}", "(" + ", ".join(map(sql_text, _f.choices)) + ")") + f" THEN 'invalid:{_f.name}' END")
P2_REASONS = (
    "WITH a AS (SELECT *, string_split(array_to_string(list_transform(string_split(payload, '\"'), lambda s, i: CASE WHEN i % 2 = 1 THEN replace(s, ',', '<~next~>') ELSE s END), '\"'), '<~next~>') AS f FROM raw_items), "
    "b AS (SELECT *, (length(payload) - length(replace(payload, '\"', ''))) % 2 = 1 OR NOT list_bool_and(list_transform(f, lambda x: " + _FIT.format("x") + ")) AS broken FROM a), w AS (SELECT *, coalesce(NOT broken AND len(f) = 13, false) AS whole FROM b), "
    "v AS (SELECT w.*, " + ", ".join(f"CASE WHEN whole THEN nullif(CASE WHEN left(f[{i}], 1) = '\"' THEN replace(substr(f[{i}], 2, length(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END, '') END AS v_{n}" for i, n in enumerate(_NAMES, 1)) + " FROM w), "
    "r AS (SELECT record_id, load_batch, list_filter([" + ", ".join(_FAULTS) + "], lambda x: x IS NOT NULL) AS faults FROM v) SELECT record_id, load_batch, array_to_string(faults, '; ') AS reason FROM r WHERE len(faults) > 0"
)


@query("p2_rejected", P2_REASONS)
def p2_rejected(spark, d):
    return rejects.rejected(rejects.check_records(table(spark, d, "raw_items")), "record_id", "load_batch").select("record_id", "load_batch", "reason")


# --- 5: parent-child links to full hierarchies ---------------------------------------------------


def _forest(spark, d, paths: bool = True) -> tuple[hierarchy.Forest, DataFrame]:
    items = table(spark, d, "hackernews").select("id", "parent")
    return hierarchy.build_forest(items.unionByName(table(spark, d, "standing_threads").select("id", "parent")), paths=paths), items


_NODES = "n AS (SELECT id, nullif(max(parent), 0) AS parent FROM (SELECT id, parent FROM hackernews UNION ALL SELECT id, parent FROM standing_threads) WHERE id IS NOT NULL GROUP BY id)"
_TREE = (
    f"WITH RECURSIVE {_NODES}, t AS (SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path, parent IS NULL AS rooted FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) "
    "UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.id, t.rooted FROM t JOIN n ON n.parent = t.id)"
)


@query(
    "p5_found",
    _TREE + ", u AS (SELECT id, parent FROM n WHERE id NOT IN (SELECT id FROM t)), w AS (SELECT id AS start, id AS cur, [id] AS path FROM u UNION ALL SELECT w.start, u.parent, list_append(w.path, u.parent) FROM w JOIN u ON u.id = w.cur WHERE NOT list_contains(w.path[:-2], w.cur)) "
    "SELECT start AS id, min(list_aggregate(list_slice(path, list_position(path, cur), len(path)), 'min')) AS cycle_id FROM w WHERE list_contains(path[:-2], cur) AND start IN (SELECT id FROM hackernews) GROUP BY start",
)
def p5_found(spark, d):
    forest, items = _forest(spark, d, paths=False)
    cyc = forest.cycles().select(F.col("id").cast("int").alias("id"), F.col("cycle_id").cast("int").alias("cycle_id"))
    return cyc.join(items.select("id"), "id", "left_semi")


@query("p5_paths", _TREE + " SELECT CAST(id AS BIGINT) AS id, CAST(root AS BIGINT) AS root, depth, path, rooted FROM t")
def p5_paths(spark, d):
    forest, _ = _forest(spark, d)
    return forest.placed.select("id", "root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "rooted")


@query("p5_descendants", _TREE + " SELECT CAST(a AS BIGINT) AS ancestor, count(*) AS n_descendants, CAST(max(depth - k) AS INT) AS height FROM (SELECT t.depth, unnest(string_split(path, '/')[:-2]) AS a, unnest(range(0, depth)) AS k FROM t WHERE depth > 0) GROUP BY 1")
def p5_descendants(spark, d):
    forest, _ = _forest(spark, d)
    return forest.descendant_counts()


_PAIRS = (
    f"WITH RECURSIVE {_NODES}, w AS (SELECT n.id AS d, p.id AS a, [n.id, p.id] AS path FROM n JOIN n p ON p.id = n.parent WHERE p.id <> n.id "
    "UNION ALL SELECT w.d, p.id, list_append(w.path, p.id) FROM w JOIN n x ON x.id = w.a JOIN n p ON p.id = x.parent WHERE NOT list_contains(w.path, p.id))"
)


@query("p5_pairs", _PAIRS + " SELECT CAST(a AS BIGINT) AS ancestor, CAST(d AS BIGINT) AS descendant, CAST(len(path) - 1 AS INT) AS distance FROM w")
def p5_pairs(spark, d):
    forest, _ = _forest(spark, d)
    return forest.all_descendants()


@query("p5_counts", _PAIRS + " SELECT CAST(n.id AS BIGINT) AS id, count(w.d) AS n_descendants, CAST(coalesce(max(len(w.path) - 1), 0) AS INT) AS height FROM n LEFT JOIN w ON w.a = n.id GROUP BY n.id")
def p5_counts(spark, d):
    forest, _ = _forest(spark, d)
    return forest.all_descendant_counts()


# --- 6: references to records that do not exist --------------------------------------------------


def _references(spark, d) -> tuple[dict[str, DataFrame], DataFrame]:
    on = lambda x: F.coalesce(F.col(x), F.lit(0).cast("smallint")) == 1
    tables = {n: table(spark, d, n).select("id", (on("deleted") | on("dead")).alias("flag"), "time") for n in ("hackernews", "standing_threads")}
    return tables, table(spark, d, "hackernews").select("id", F.col("parent").alias("key"), F.col("time").alias("child_time"))


_REFS = """WITH p AS (SELECT id, min(tab) AS tab, bool_or(coalesce(deleted, 0) = 1 OR coalesce(dead, 0) = 1) AS flagged, min(time) AS time FROM
(SELECT id, 'hackernews' AS tab, deleted, dead, time FROM hackernews UNION ALL SELECT id, 'standing_threads', deleted, dead, time FROM standing_threads) GROUP BY id),
r AS (SELECT DISTINCT id, parent, time FROM hackernews WHERE parent IS NOT NULL AND parent <> 0),
j AS (SELECT r.id, r.parent, r.time, p.id AS pid, coalesce(p.tab, 'none') AS ref_table, p.flagged, p.time AS ptime FROM r LEFT JOIN p ON p.id = r.parent),
o AS (SELECT *, 'missing' AS reason FROM j WHERE pid IS NULL UNION ALL SELECT *, 'deleted' FROM j WHERE flagged UNION ALL SELECT *, 'late' FROM j WHERE ptime > time)"""


@query("p6_found", _REFS + " SELECT DISTINCT id, reason FROM o")
def p6_found(spark, d):
    return orphans.find_orphans(*_references(spark, d)).select("id", "reason").distinct()


@query("p6_report", _REFS + " SELECT ref_table, strftime(time, '%Y-%m') AS month, reason, count(*) AS n_refs, count(DISTINCT parent) AS n_keys FROM o GROUP BY 1, 2, 3")
def p6_report(spark, d):
    return orphans.orphan_report(*_references(spark, d))
