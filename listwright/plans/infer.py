"""Inference and reachability over the region - nation - customer tree and the part tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import infer
from listwright.operators.infer import Rule
from listwright.operators.references import top_concepts
from listwright.plans.references import tagged
from listwright.plans.registry import also, query

TOP, PART_OF, BROADER, NARROWER = vocab.SKOS + "topConceptOf", vocab.DCT + "isPartOf", vocab.SKOS + "broader", vocab.SKOS + "narrower"


def spo(df, s, p, o):
    return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))


def tree(t):
    """Customers are top concepts of their nation, nations part of their region."""
    c = spo(t.customer, tagged("customer", "c_custkey"), TOP, tagged("nation", "c_nationkey"))
    n = spo(t.nation, tagged("nation", "n_nationkey"), PART_OF, tagged("region", "n_regionkey"))
    return c.unionByName(n)


TREE = f"""WITH tr AS (SELECT 'customer:' || c_custkey AS subject, '{TOP}' AS predicate, 'nation:' || c_nationkey AS object FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, '{PART_OF}', 'region:' || n_regionkey FROM nation),
c AS (SELECT 'customer:' || c_custkey AS c, 'nation:' || c_nationkey AS n, 'region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


@query("infer_part_of", TREE + f"SELECT * FROM tr UNION SELECT c, '{PART_OF}', r FROM c")
def part_of(spark, t):
    return infer.infer_part_of(tree(t))


@query(
    "infer_inverse",
    TREE + f"""SELECT * FROM tr UNION SELECT object, '{vocab.SKOS}hasTopConcept', subject FROM tr WHERE predicate = '{TOP}'
      UNION SELECT object, '{vocab.DCT}hasPart', subject FROM tr WHERE predicate = '{PART_OF}'""",
)
def inverse(spark, t):
    return infer.infer_inverse(tree(t))


BROADER_SQL = f"""WITH b AS (SELECT 'customer:' || c_custkey AS subject, '{BROADER}' AS predicate, 'nation:' || c_nationkey AS object FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, '{NARROWER}', 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def broader(t):
    c = t.customer
    return spo(c, tagged("customer", "c_custkey"), BROADER, tagged("nation", "c_nationkey")).unionByName(
        spo(c, tagged("nation", "c_nationkey"), NARROWER, tagged("customer", "c_custkey"))
    )


@query(
    "infer_subproperty",
    BROADER_SQL + """SELECT * FROM b UNION SELECT subject, predicate || 'Transitive', object FROM b
      UNION SELECT subject, regexp_replace(predicate, '#.*', '#semanticRelation'), object FROM b""",
)
def subproperty(spark, t):
    return infer.infer_subproperty(broader(t))


@query(
    "infer_scheme_membership",
    TREE + f"""SELECT * FROM tr UNION SELECT subject, '{vocab.IN_SCHEME}', object FROM tr WHERE predicate = '{TOP}'
      UNION SELECT subject, '{vocab.RDF_TYPE}', '{vocab.SKOS}Concept' FROM tr WHERE predicate = '{TOP}'""",
)
def membership(spark, t):
    return infer.infer_scheme_membership(tree(t))


PART_TREE = """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
"""


def part_edges(t):
    return t.part.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


@query("transitive_closure", PART_TREE + "SELECT src, dst FROM c")
def closure(spark, t):
    return infer.transitive_closure(part_edges(t))


WIDER, ABOVE = "http://x.org/wider", "http://x.org/above"
RULES = [
    Rule((("?x", WIDER, "?y"),), (("?x", ABOVE, "?y"),)),
    Rule((("?x", ABOVE, "?y"), ("?y", WIDER, "?z")), (("?x", ABOVE, "?z"),)),
    Rule((("?x", WIDER, "0"),), (("?x", vocab.RDF_TYPE, "http://x.org/First"),)),
]


@query(
    "apply_rules",
    PART_TREE + f"""SELECT cast(src AS VARCHAR) AS subject, '{WIDER}' AS predicate, cast(dst AS VARCHAR) AS object FROM e
      UNION ALL SELECT cast(src AS VARCHAR), '{ABOVE}', cast(dst AS VARCHAR) FROM c
      UNION ALL SELECT cast(src AS VARCHAR), '{vocab.RDF_TYPE}', 'http://x.org/First' FROM e WHERE dst = 0""",
)
def rules(spark, t):
    e = part_edges(t)
    return infer.apply_rules(spo(e, F.col("src").cast("string"), WIDER, F.col("dst").cast("string")), RULES)


# Parts are schemes, part p leads to 2p and 2p + 1; every brand starts at its least part.
@query(
    "scheme_reachability",
    """WITH RECURSIVE themes AS (SELECT p_brand AS theme, min(p_partkey) AS scheme FROM part GROUP BY p_brand),
       r AS (SELECT theme, scheme, 0 AS depth FROM themes
         UNION ALL SELECT theme, p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = r.scheme AND p_partkey <> r.scheme)
       SELECT theme, scheme, min(depth) AS depth FROM r GROUP BY theme, scheme""",
)
def reachability(spark, t):
    themes = t.part.groupBy(F.col("p_brand").alias("theme")).agg(F.min("p_partkey").alias("scheme"))
    links = part_edges(t).select(
        F.col("dst").alias("scheme"), F.array("src").alias("pos"), F.col("src").alias("target")
    )
    return infer.scheme_reachability(themes, links).select("theme", "scheme", "depth")


@query(
    "leaf_schemes",
    """WITH RECURSIVE themes AS (SELECT p_brand AS theme, min(p_partkey) AS scheme FROM part GROUP BY p_brand),
       r AS (SELECT theme, scheme, 0 AS depth FROM themes
         UNION ALL SELECT theme, p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = r.scheme AND p_partkey <> r.scheme),
       f AS (SELECT theme, scheme, min(depth) AS depth FROM r GROUP BY theme, scheme)
       SELECT theme, arg_max(scheme, cast(depth AS BIGINT) * 1000000000 + scheme) AS leaf FROM f GROUP BY theme""",
)
def leaves(spark, t):
    themes = t.part.groupBy(F.col("p_brand").alias("theme")).agg(F.min("p_partkey").alias("scheme"))
    links = part_edges(t).select(
        F.col("dst").alias("scheme"), F.array("src").alias("pos"), F.col("src").alias("target")
    )
    return infer.leaf_schemes(infer.scheme_reachability(themes, links))


# Regions are theme schemes of which one is complete; its nations are the themes.
@query(
    "resolve_all_themes",
    """WITH linked AS (SELECT c_nationkey, min(c_custkey) AS first FROM customer WHERE c_acctbal >= 0 GROUP BY c_nationkey),
       complete AS (SELECT n_regionkey, bool_and(first IS NOT NULL) AS ok FROM nation LEFT JOIN linked ON n_nationkey = c_nationkey GROUP BY n_regionkey),
       chosen AS (SELECT n_regionkey FROM complete ORDER BY ok DESC, n_regionkey LIMIT 1)
       SELECT n_name AS label, 'nation:' || n_nationkey AS theme, 'customer:' || first AS scheme
       FROM nation JOIN chosen USING (n_regionkey) JOIN linked ON n_nationkey = c_nationkey""",
)
def all_themes(spark, t):
    schemes = t.region.select(tagged("Thema", "r_regionkey").alias("id"), F.col("r_regionkey").cast("bigint").alias("pos")).unionByName(
        t.customer.select(tagged("customer", "c_custkey").alias("id"), (F.col("c_custkey") + 100).alias("pos"))
    )
    tops = t.nation.select(
        tagged("Thema", "n_regionkey").alias("scheme"), F.col("n_nationkey").alias("pos"), tagged("nation", "n_nationkey").alias("concept")
    )
    see = t.customer.where("c_acctbal >= 0").select(
        tagged("nation", "c_nationkey").alias("src"), F.col("c_custkey").alias("pos"), tagged("customer", "c_custkey").alias("ref")
    )
    concepts = t.nation.select(tagged("nation", "n_nationkey").alias("id"), F.col("n_name").alias("pref_label"))
    return infer.resolve_all_themes(schemes, tops, see, concepts)


@query(
    "compose_theme_fields",
    """WITH f AS (SELECT 'region:' || n_regionkey AS theme, 'nation:' || n_nationkey AS scheme, n_nationkey AS ord, c_custkey AS pos, 'customer:' || c_custkey AS concept, c_mktsegment = 'MACHINERY' AS is_feature
         FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 0),
       w AS (SELECT *, row_number() OVER (PARTITION BY theme, is_feature ORDER BY ord DESC, pos) AS r FROM f)
       SELECT theme, scheme, ord, pos, concept, is_feature FROM w WHERE NOT is_feature OR r = 1""",
)
def compose(spark, t):
    chain = t.nation.select(
        tagged("region", "n_regionkey").alias("theme"), tagged("nation", "n_nationkey").alias("scheme"), F.col("n_nationkey").alias("ord")
    )
    edges = t.customer.select(
        tagged("nation", "c_nationkey").alias("src"), F.col("c_custkey").alias("pos"), tagged("customer", "c_custkey").alias("ref")
    )
    concepts = t.customer.select(tagged("customer", "c_custkey").alias("id"))
    fields = t.customer.where("c_acctbal >= 0").select(
        tagged("customer", "c_custkey").alias("concept"), (F.col("c_mktsegment") == "MACHINERY").alias("is_feature")
    )
    return infer.compose_theme_fields(chain, top_concepts(edges, concepts), fields).select(
        "theme", "scheme", "ord", "pos", "concept", "is_feature"
    )


@query(
    "deepest_wins",
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS is_feature,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber DESC, l_partkey, l_suppkey) AS r FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, is_feature FROM w WHERE NOT is_feature OR r = 1""",
)
def deepest(spark, t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("is_feature"))
    return infer.deepest_wins(rows, ["l_orderkey"], "is_feature", "l_linenumber", ["l_partkey", "l_suppkey"])


@also("related_components_long", short=0)
@query(
    "related_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS g, 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
       both_ways AS (SELECT g, a, b FROM e UNION ALL SELECT g, b, a FROM e),
       r AS (SELECT g, a AS node, a AS seen FROM both_ways UNION SELECT r.g, r.node, b.b FROM r JOIN both_ways b ON r.g = b.g AND r.seen = b.a)
       SELECT g, node, min(seen) AS component FROM r GROUP BY g, node""",
)
def components(spark, t, **sizes):
    edges = t.lineitem.select(
        F.col("l_orderkey").alias("g"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")
    )
    return infer.related_components(edges, "g", **sizes)


# Lists are named by part names; a part's first word makes it similar to lists that hold the word.
@query(
    "bridge_schemes",
    """WITH RECURSIVE lists AS (SELECT DISTINCT 'list:' || replace(p_name, ' ', '-') AS id FROM part),
       links AS (SELECT DISTINCT replace(split_part(p_name, ' ', 1) || ':' || p_partkey, '-', '_') AS concept, 'list:' || replace(p_name, ' ', '-') AS target FROM part),
       step AS (SELECT DISTINCT id AS scheme, target FROM lists JOIN links
         ON contains(replace(id, '-', '_'), split_part(concept, ':', 1)) OR contains(concept, split_part(replace(id, '-', '_'), ':', 2))),
       r AS (SELECT p_type AS theme, min('list:' || replace(p_name, ' ', '-')) AS scheme FROM part GROUP BY p_type
         UNION SELECT r.theme, step.target FROM r JOIN step ON r.scheme = step.scheme)
       SELECT theme, scheme FROM r""",
)
def bridge(spark, t):
    name = F.concat(F.lit("list:"), F.translate("p_name", " ", "-"))
    schemes = t.part.select(name.alias("id")).distinct()
    see = t.part.select(
        F.concat(F.substring_index("p_name", " ", 1), F.lit(":"), "p_partkey").alias("src"), F.lit(0).alias("pos"), name.alias("ref")
    )
    reached = t.part.groupBy(F.col("p_type").alias("theme")).agg(F.min(name).alias("scheme")).select(
        "theme", "scheme", F.lit(0).alias("depth"), F.array().cast("array<array<bigint>>").alias("path")
    )
    return infer.bridge_schemes(reached, see, schemes).select("theme", "scheme")
