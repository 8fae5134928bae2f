"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.lstrip().removeprefix("WITH ")
            with_, rest = ("WITH RECURSIVE", body.removeprefix("RECURSIVE ")) if body.startswith("RECURSIVE ") else ("WITH", body)
            SQL[f.__name__] = f"{with_} {VIEWS}{',' if body != sql.lstrip() else ''} {rest}"
        return f

    return register


#: The domain views of covara.sources.views in SQL.
VIEWS = """course AS (SELECT n_nationkey AS course_id, n_name AS code, r_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey),
document AS (SELECT o_orderkey AS document_id, c_nationkey AS course_id, cast(month(o_orderdate) AS integer) AS case_number, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'faculty' ELSE 'self_study' END AS guide_kind FROM orders JOIN customer ON o_custkey = c_custkey),
topic AS (SELECT p_partkey AS stable_id, p_brand AS system, p_name AS subdomain, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'AAMC' ELSE 'USMLE' END AS framework FROM part),
link AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, l_partkey AS framework_id, cast(1 - 5 * l_discount AS decimal(3, 2)) AS confidence, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_returnflag = 'A' THEN 'approved' WHEN l_linestatus = 'F' THEN 'pending' END AS status, l_shipdate AS created_at FROM lineitem),
scope AS (SELECT DISTINCT course_id, system FROM course, topic WHERE course_id NOT IN (23, 24) AND (cast(substr(system, 7) AS integer) - 1 + 3 * course_id) % 25 < 8),
live AS (SELECT * FROM link WHERE status IS DISTINCT FROM 'rejected'),
fact AS (SELECT live.*, document.course_id, case_number, guide_kind, code, module, system, subdomain, framework FROM live JOIN document USING (document_id) JOIN course USING (course_id) JOIN topic ON framework_id = stable_id)"""
