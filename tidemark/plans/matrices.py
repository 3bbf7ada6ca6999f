"""Query of a test matrix's problems: parts as tests, brands as families, sizes as buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.matrices import problems
from ..registry import query
from .inputs import table

_FAMILIES = [f"Brand#{i}" for i in range(1, 28)]
_BUCKETS = [f"b{i}" for i in range(12)]


@query(
    "matrix_problems",
    """WITH r AS (SELECT p_partkey % 1900 AS test_id, p_brand AS family, 'b' || (p_size % 11) AS bucket, p_size AS size, p_retailprice AS price FROM part),
f AS (SELECT 'Brand#' || unnest(range(1, 28)) AS family), b AS (SELECT 'b' || unnest(range(0, 12)) AS bucket)
SELECT 'DUPLICATE' AS problem, test_id::VARCHAR AS detail, count(*) AS n FROM r GROUP BY test_id HAVING count(*) > 1
UNION ALL SELECT 'SIZE_TOO_LARGE', test_id::VARCHAR, count(*) FROM r WHERE size > 48 GROUP BY test_id UNION ALL SELECT 'PRICE_TOO_LOW', test_id::VARCHAR, count(*) FROM r WHERE price < 910 GROUP BY test_id
UNION ALL SELECT 'MISSING_family', family, 0 FROM f WHERE family NOT IN (SELECT family FROM r) UNION ALL SELECT 'MISSING_PAIR', family || ':' || bucket, 0 FROM f, b WHERE (family, bucket) NOT IN (SELECT (family, bucket) FROM r)
UNION ALL SELECT 'TOO_MANY', '', count(*) FROM r WHERE size > 10 HAVING count(*) > 100""",
)
def matrix_problems(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "part").select((c("p_partkey") % 1900).alias("test_id"), c("p_brand").alias("family"), F.concat(F.lit("b"), (c("p_size") % 11).cast("string")).alias("bucket"), c("p_size").alias("size"), c("p_retailprice").alias("price"))
    checks = {"SIZE_TOO_LARGE": c("size") > 48, "PRICE_TOO_LOW": c("price") < 910}
    return problems(rows, "test_id", checks, {"family": _FAMILIES}, ("family", "bucket", _FAMILIES, _BUCKETS), (c("size") > 10, 100))
