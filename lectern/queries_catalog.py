"""Queries of the catalog's targets on the driver's tables, with SQL for comparison; `queries` takes them in.

Parts are courses, suppliers books, customers users (every seventh a doctor), nations categories, regions school stages, and
the priorities of orders college stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .plans import checked, diagnose, flagged
from .plans.catalog import targets
from .registry import query
from .sources import table


def _cols(df, **names):
    return df.select(*[F.expr(c).alias(n) for n, c in names.items()])


def _targets(s, d):
    courses = _cols(table(s, d, "part"), id="p_partkey", doctor_id="p_partkey % 1500", category_id="p_partkey % 40", status="CASE WHEN p_partkey % 3 > 0 THEN 'published' ELSE 'draft' END", title="p_name", subtitle="p_brand", description="p_type", language="CASE WHEN p_partkey % 2 = 0 THEN 'ar' ELSE 'en' END", academic_year="p_size", course_level="CAST(p_size % 4 AS STRING)", published_at="CASE WHEN p_partkey % 5 > 0 THEN make_date(2000 + p_size, 1, 1) END")
    books = _cols(table(s, d, "supplier"), id="s_suppkey", doctor_id="s_suppkey * 7", category_id="s_nationkey", status="CASE WHEN s_suppkey % 4 > 0 THEN 'published' ELSE 'draft' END", title="s_name", subtitle="CAST(NULL AS STRING)", description="CAST(s_acctbal AS STRING)", language="'ar'", published_at="CAST(NULL AS DATE)")
    users = _cols(table(s, d, "customer"), id="c_custkey", name="c_name", role="CASE WHEN c_custkey % 7 = 0 THEN 'doctor' ELSE 'student' END", created_at="date_add(DATE'2000-01-01', CAST(c_nationkey AS INT))")
    categories = _cols(table(s, d, "nation"), id="n_nationkey", name_en="n_name", name_ar="lower(n_name)", slug="concat('c', n_nationkey)", parent_id="n_regionkey", display_order="n_nationkey % 6", is_active="n_nationkey % 9 > 0", created_at="DATE'2001-01-01'", pre_college_stage_id="CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END", college_stage_id="CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 5 + 1 END")
    stages = _cols(table(s, d, "region"), id="r_regionkey", name_en="r_name", name_ar="lower(r_name)", stage="concat('stage ', r_regionkey % 2)", year_number="r_regionkey", display_order="CAST(NULL AS INT)", is_active="r_regionkey <> 3")
    colleges = _cols(table(s, d, "orders").select("o_orderpriority").distinct(), id="CAST(substr(o_orderpriority, 1, 1) AS BIGINT)", name_en="o_orderpriority", name_ar="CAST(NULL AS STRING)", faculty="substr(o_orderpriority, 3)", year_number="CAST(substr(o_orderpriority, 1, 1) AS BIGINT)", display_order="1", is_active="true")
    return targets(courses, books, users, categories, stages, colleges)


PLANS = {
    "courses": {"filters": [{"column": "title", "op": "contains", "value": "RING"}, {"column": "academic_year", "op": "lte", "value": "30"}, {"column": "level_type", "op": "in", "value": ["PRE_college", "other"]}, {"column": "secret", "op": "eq", "value": "x"}], "text": "brand", "sort": "newest", "limit": 40},
    "books": {"filters": [{"column": "category_slug", "op": "in", "value": ["C1", "c2", "c7"]}], "sort": "unknown", "limit": 200},
    "users": {"filters": [{"table": "courses", "column": "academic_year", "op": "gte", "value": 20}, {"table": "educational_levels", "column": "type", "op": "eq", "value": "College"}, {"table": "nowhere", "column": "x", "op": "eq", "value": 1}]},
    "categories": {"filters": [{"table": "users", "column": "name", "op": "contains", "value": "customer"}, {"table": "books", "column": "language", "op": "eq", "value": "AR"}], "limit": 7},
    "educational_levels": {"filters": [{"table": "courses", "column": "title", "op": "contains", "value": "widget"}, {"column": "year_number", "op": "gte", "value": "-1"}], "text": "a"},
}

_BASE = """co AS (SELECT p_partkey AS id, p_partkey % 1500 AS doctor_id, p_partkey % 40 AS category_id, p_name AS title, p_brand AS subtitle, p_type AS description, p_size AS yr, CASE WHEN p_partkey % 5 > 0 THEN make_date(2000 + CAST(p_size AS INT), 1, 1) END AS pub FROM part WHERE p_partkey % 3 > 0),
 bo AS (SELECT s_suppkey AS id, s_suppkey * 7 AS doctor_id, s_nationkey AS category_id, s_name AS title FROM supplier WHERE s_suppkey % 4 > 0),
 dr AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 7 = 0),
 lv AS (SELECT 'pre_college' AS type, r_regionkey AS id, r_name AS name_en, lower(r_name) AS name_ar, 'stage ' || r_regionkey % 2 AS grp, r_regionkey AS yr, NULL AS ord FROM region WHERE r_regionkey <> 3 UNION ALL SELECT DISTINCT 'college', CAST(substr(o_orderpriority, 1, 1) AS BIGINT), o_orderpriority, NULL, substr(o_orderpriority, 3), CAST(substr(o_orderpriority, 1, 1) AS BIGINT), 1 FROM orders),
 ca AS (SELECT n_nationkey AS id, n_name AS name_en, 'c' || n_nationkey AS slug, n_nationkey % 6 AS ord, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS pre, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 5 + 1 END AS col FROM nation WHERE n_nationkey % 9 > 0),
 cl AS (SELECT ca.*, coalesce(p.type, c.type) AS type FROM ca LEFT JOIN lv p ON p.type = 'pre_college' AND p.id = pre LEFT JOIN lv c ON c.type = 'college' AND c.id = col),
 it AS (SELECT doctor_id, category_id FROM co UNION ALL SELECT doctor_id, category_id FROM bo),
 at_ AS (SELECT 'pre_college' AS type, pre AS lid, id FROM ca WHERE pre IS NOT NULL UNION ALL SELECT 'college', col, id FROM ca WHERE col IS NOT NULL),
 x1 AS (SELECT 'courses' AS target, co.id::VARCHAR AS key, title ILIKE '%RING%' AS f0, yr <= 30 AS f1, coalesce(cl.type = 'pre_college', false) AS f2, title ILIKE '%brand%' OR subtitle ILIKE '%brand%' OR description ILIKE '%brand%' AS f3, row_number() OVER (ORDER BY pub DESC NULLS LAST, co.id DESC) AS o FROM co JOIN dr ON dr.id = co.doctor_id LEFT JOIN cl ON cl.id = co.category_id),
 x2 AS (SELECT 'books' AS target, bo.id::VARCHAR AS key, coalesce(cl.slug IN ('c1', 'c2', 'c7'), false) AS f0, true AS f1, true AS f2, true AS f3, row_number() OVER (ORDER BY title, bo.id) AS o FROM bo JOIN dr ON dr.id = bo.doctor_id LEFT JOIN cl ON cl.id = bo.category_id),
 x3 AS (SELECT 'users' AS target, dr.id::VARCHAR AS key, dr.id IN (SELECT doctor_id FROM co WHERE yr >= 20) AS f0, dr.id IN (SELECT doctor_id FROM it JOIN cl ON cl.id = category_id WHERE cl.type = 'college') AS f1, true AS f2, true AS f3, row_number() OVER (ORDER BY name, id) AS o FROM dr),
 x4 AS (SELECT 'categories' AS target, ca.id::VARCHAR AS key, ca.id IN (SELECT category_id FROM it JOIN dr ON dr.id = doctor_id) AS f0, ca.id IN (SELECT category_id FROM bo) AS f1, true AS f2, true AS f3, row_number() OVER (ORDER BY ord, name_en, id) AS o FROM ca),
 x5 AS (SELECT 'educational_levels' AS target, type || ':' || id AS key, EXISTS (SELECT 1 FROM at_ JOIN co ON co.category_id = at_.id WHERE at_.type = lv.type AND at_.lid = lv.id AND title ILIKE '%widget%') AS f0, yr >= -1 AS f1, coalesce(name_en ILIKE '%a%', false) OR coalesce(name_ar ILIKE '%a%', false) OR grp ILIKE '%a%' AS f2, true AS f3, row_number() OVER (ORDER BY type, ord NULLS LAST, yr NULLS LAST, id) AS o FROM lv),
 xs AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3 UNION ALL SELECT * FROM x4 UNION ALL SELECT * FROM x5),
 lm AS (SELECT unnest(['courses', 'books', 'users', 'categories', 'educational_levels']) AS target, unnest([40, 50, 20, 7, 20]) AS most, unnest([4, 1, 2, 2, 3]) AS parts)"""


@query(f"WITH {_BASE}, r AS (SELECT target, key, row_number() OVER (PARTITION BY target ORDER BY o) AS position FROM xs WHERE f0 AND f1 AND f2 AND f3) SELECT target, key, CAST(position AS INT) AS position FROM r JOIN lm USING (target) WHERE position <= most")
def catalog_targets(s, d):
    out = None
    for name, target in _targets(s, d).items():
        good = checked(PLANS[name], target)
        rows, names = flagged(target, good["filters"], good["text"])
        met = rows.filter(" AND ".join(names)).orderBy(*target.order(good["sort"])).limit(good["limit"])
        # of the page's rows alone
        part = met.select(F.lit(name).alias("target"), F.concat_ws(":", *target.keys).alias("key"), F.row_number().over(Window.orderBy(*target.order(good["sort"]))).alias("position"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_BASE} SELECT target, p.position, CASE p.position WHEN -1 THEN count(*) FILTER (WHERE f0 AND f1 AND f2 AND f3) WHEN 0 THEN count(*) FILTER (WHERE f0) WHEN 1 THEN count(*) FILTER (WHERE f1) WHEN 2 THEN count(*) FILTER (WHERE f2) ELSE count(*) FILTER (WHERE f3) END AS n FROM xs JOIN lm USING (target), (SELECT CAST(unnest(range(-1, 4)) AS INT) AS position) p WHERE p.position < parts GROUP BY target, p.position")
def catalog_targets_diagnosis(s, d):
    out = None
    for name, target in _targets(s, d).items():
        part = diagnose(PLANS[name], target).select(F.lit(name).alias("target"), "position", "n")
        out = part if out is None else out.unionByName(part)
    return out
