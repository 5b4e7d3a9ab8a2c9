"""The registered queries over the fixture tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregate, encoders, fewshot, homogeneous, ingest, merge, metrics, model, sampling, tasks, typed
from ..sources.catalog import read_table
from .shape import with_position
from .specs import BatchSpec, FewShotSpec, ModelSpec, SampleSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# The graph: relations of the fixture tables

PLACED = "orders:placed_by:customer"
LINE = "lineitem:line_of:orders"
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
LINE_ID_SQL = "cast('0x' || substr(md5(concat_ws('|', 'line', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))), 1, 15) AS BIGINT)"


def customers(spark: SparkSession, d: str, cutoff: bool = True) -> DataFrame:
    c = read_table(spark, d, "customer")
    if cutoff:
        c = c.withColumn("cutoff", F.expr("timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 AS INT))"))
    return sampling.seeds(c, "customer", "c_custkey", "cutoff" if cutoff else None)


def orders_of_customers(spark: SparkSession, d: str) -> DataFrame:
    return ingest.edges_of(read_table(spark, d, "orders"), f"tail of {PLACED}", "o_custkey", "o_orderkey", "o_orderdate")


def customers_of_orders(spark: SparkSession, d: str) -> DataFrame:
    return ingest.edges_of(read_table(spark, d, "orders"), f"head of {PLACED}", "o_orderkey", "o_custkey")


def lines(spark: SparkSession, d: str) -> DataFrame:
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    text = F.concat_ws("|", F.lit("line"), *[F.col(k).cast("string") for k in LINE_KEY[:-1]], shipped)
    return read_table(spark, d, "lineitem").withColumn("line_id", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


def lines_of_orders(spark: SparkSession, d: str) -> DataFrame:
    return ingest.edges_of(lines(spark, d), f"tail of {LINE}", "l_orderkey", "line_id", "l_shipdate")


_SEEDS = """seeds AS (SELECT c_custkey AS root_id, md5(concat_ws('|', 'root', 'customer', c_custkey)) AS inst_id, NULL AS parent_inst, 0 AS hop, 'customer' AS node_type,
  c_custkey AS row_id, NULL AS edge_type, {cutoff} AS cutoff FROM customer)"""
_CUTOFF = "TIMESTAMP '1997-01-01' + to_days((c_custkey % 1000)::INT)"


def _hop(name: str, source: str, hop: int, edge: str, to_type: str, table: str, src: str, dst: str, ts: str | None, fanout: int | None) -> str:
    """A hop: neighbours in order of time, how many are old enough, positions drawn among them by Floyd's method, and the rows there."""
    when, older = ts or "NULL::TIMESTAMP", "f.cutoff IS NULL OR e.ts IS NULL OR e.ts < f.cutoff"
    first = "0" if fanout is None else f"greatest(n - {fanout}, 0)"
    draw = f"cast('0x' || substr(md5(concat_ws('|', '42', '{hop}', inst_id, '{edge}', x[1])), 1, 15) AS BIGINT) % (x[1] + 1)"
    floyd = f"list_reduce(list_prepend([]::BIGINT[], list_transform(range({first}, n), lambda j: [j])), lambda s, x: list_append(s, CASE WHEN list_contains(s, {draw}) THEN x[1] ELSE {draw} END))"
    return f"""{name}_e AS (SELECT {src} AS src, {dst} AS dst, {when} AS ts, row_number() OVER (PARTITION BY {src} ORDER BY {when} NULLS FIRST, {dst}) - 1 AS pos FROM {table}),
{name}_n AS (SELECT f.root_id, f.inst_id, f.row_id, f.cutoff, count(*) AS n FROM {source} f JOIN {name}_e e ON f.row_id = e.src WHERE {older} GROUP BY ALL),
{name}_d AS (SELECT root_id, inst_id, row_id AS src, cutoff, unnest({floyd if fanout is not None else "range(0, n)"}) AS pos FROM {name}_n),
{name} AS (SELECT root_id, md5(concat_ws('|', 'path', inst_id, '{edge}', pos)) AS inst_id, inst_id AS parent_inst, {hop} AS hop, '{to_type}' AS node_type,
  dst AS row_id, '{edge}' AS edge_type, cutoff FROM {name}_d JOIN {name}_e USING (src, pos))"""


_H1 = _hop("h1", "seeds", 1, f"tail of {PLACED}", "orders", "orders", "o_custkey", "o_orderkey", "o_orderdate", 5)
_H2 = _hop("h2", "h1", 2, f"tail of {LINE}", "lineitem", "lineitem", "l_orderkey", LINE_ID_SQL, "l_shipdate", 5)
_TWO = f"WITH {_SEEDS.format(cutoff=_CUTOFF)}, {_H1}, {_H2}, every AS (SELECT * FROM seeds UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) "


def _two_hops(spark: SparkSession, d: str) -> DataFrame:
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d), ("orders", LINE, "lineitem"): lines_of_orders(spark, d)}
    return sampling.sample(customers(spark, d), "customer", edges, SampleSpec(hops=2, fanout=5))


@query(f"WITH {_SEEDS.format(cutoff=_CUTOFF)}, {_H1} SELECT root_id, inst_id, row_id, edge_type FROM h1")
def neighbor_sample_1hop(spark, d):
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d)}
    return sampling.sample(customers(spark, d), "customer", edges, SampleSpec(hops=1, fanout=5)).where("hop = 1").select("root_id", "inst_id", "row_id", "edge_type")


@query(_TWO + "SELECT root_id, inst_id, parent_inst, hop::INT AS hop, node_type, row_id, edge_type, cutoff FROM every")
def neighbor_sample_2hop(spark, d):
    return _two_hops(spark, d)


_BACK = f"""WITH {_SEEDS.format(cutoff="NULL::TIMESTAMP")}, {_hop("h1", "seeds", 1, f"tail of {PLACED}", "orders", "orders", "o_custkey", "o_orderkey", "o_orderdate", 3)},
{_hop("h2", "h1", 2, f"head of {PLACED}", "customer", "orders", "o_orderkey", "o_custkey", None, 3)},
every AS (SELECT * FROM seeds UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) """


@query(_BACK + "SELECT root_id, inst_id, hop::INT AS hop, node_type, row_id FROM every")
def neighbor_sample_nocutoff(spark, d):
    """Walks back to the customer too: each arrival is an instance of its own."""
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d), ("orders", PLACED, "customer"): customers_of_orders(spark, d)}
    return sampling.sample(customers(spark, d, cutoff=False), "customer", edges, SampleSpec(hops=2, fanout=3)).select("root_id", "inst_id", "hop", "node_type", "row_id")


@query(f"WITH {_SEEDS.format(cutoff=_CUTOFF)}, {_hop('h1', 'seeds', 1, f'tail of {PLACED}', 'orders', 'orders', 'o_custkey', 'o_orderkey', 'o_orderdate', None)} SELECT root_id, row_id FROM h1")
def neighbor_sample_unlimited(spark, d):
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d)}
    return sampling.sample(customers(spark, d), "customer", edges, SampleSpec(hops=1, fanout=None)).where("hop = 1").select("root_id", "row_id")


@query(_TWO + "SELECT root_id, inst_id, row_id, o_totalprice, o_orderstatus FROM every JOIN orders ON row_id = o_orderkey WHERE node_type = 'orders'")
def subgraph_nodes(spark, d):
    found = sampling.with_features(_two_hops(spark, d), read_table(spark, d, "orders"), "orders", "o_orderkey", ["o_totalprice", "o_orderstatus"])
    return found.select("root_id", "inst_id", "row_id", "o_totalprice", "o_orderstatus")


@query(_TWO + "SELECT root_id, parent_inst AS src_inst, inst_id AS dst_inst, edge_type FROM every WHERE parent_inst IS NOT NULL")
def subgraph_edges(spark, d):
    return sampling.sub_edges(_two_hops(spark, d))


@query(_TWO + ", n AS (SELECT node_type, count(*) AS n FROM every GROUP BY 1) SELECT node_type, n, coalesce(sum(n) OVER (ORDER BY node_type <> 'customer', node_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n")
def graph_unify_offsets(spark, d):
    return sampling.type_offsets(_two_hops(spark, d), "customer")


_NODES = ", z AS (SELECT *, row_number() OVER (ORDER BY node_type <> 'customer', node_type, inst_id) - 1 AS node, dense_rank() OVER (ORDER BY node_type <> 'customer', node_type) - 1 AS type_code FROM every) "


@query(_TWO + _NODES + "SELECT node, type_code::INT AS type_code, node_type, inst_id, root_id, hop::INT AS hop, row_id FROM z")
def graph_unify_nodes(spark, d):
    """All instances of a sample numbered as one graph, type after type."""
    return homogeneous.numbered_nodes(_two_hops(spark, d), "customer")


@query(_TWO + _NODES + "SELECT p.node AS src, c.node AS dst, (dense_rank() OVER (ORDER BY c.edge_type) - 1)::INT AS relation, c.edge_type FROM z c JOIN z p ON p.inst_id = c.parent_inst")
def graph_unify_edges(spark, d):
    """Its edges between those numbers, with a code for each relation."""
    nodes = _two_hops(spark, d)
    return homogeneous.unify(nodes, sampling.sub_edges(nodes), "customer")[1]


@query(_TWO + "SELECT root_id, count(*) FILTER (hop = 1) AS n_orders, count(*) FILTER (hop = 2) AS n_lines, round(avg(o_totalprice), 4) AS mean_price FROM every LEFT JOIN orders ON node_type = 'orders' AND row_id = o_orderkey GROUP BY root_id")
def sampled_customer_summary(spark, d):
    """What a sample is for: features of sampled rows, aggregated per root."""
    prices = read_table(spark, d, "orders").select(F.lit("orders").alias("node_type"), F.col("o_orderkey").alias("row_id"), "o_totalprice")
    rows = _two_hops(spark, d).join(prices, ["node_type", "row_id"], "left")
    return rows.groupBy("root_id").agg(F.sum((F.col("hop") == 1).cast("long")).alias("n_orders"), F.sum((F.col("hop") == 2).cast("long")).alias("n_lines"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(_BACK + """SELECT root_id, inst_id, hop::INT AS hop, x.name, x.value FROM every JOIN customer ON node_type = 'customer' AND row_id = c_custkey,
  (SELECT unnest(['customer___c_name', 'customer___c_mktsegment']) AS name, unnest([c_name, c_mktsegment]) AS value) x WHERE hop > 0 OR x.name <> 'customer___c_mktsegment'""")
def mask_sampled_roots(spark, d):
    """The target column is hidden in the roots; a root that is reached again keeps it."""
    c = read_table(spark, d, "customer")
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d), ("orders", PLACED, "customer"): customers_of_orders(spark, d)}
    found = sampling.with_features(sampling.sample(customers(spark, d, cutoff=False), "customer", edges, SampleSpec(hops=2, fanout=3)), c, "customer", "c_custkey", ["c_name", "c_mktsegment"])
    pairs = F.array(*[F.struct(F.lit(f"customer___{n}").alias("name"), F.col(n).alias("value")) for n in ("c_name", "c_mktsegment")])
    return tasks.mask_sampled(found.select("root_id", "inst_id", "hop", F.explode(pairs).alias("x")).select("root_id", "inst_id", "hop", "x.*"), F.array(F.lit("customer___c_mktsegment")))


# Catalogue and adjacency

#: Edge types that the tables' rows name: SQL of the head, the name and the tail by table.
EDGE_PARTS = (
    ("orders", "'orders'", "'placed_' || o_orderpriority", "'customer'"),
    ("part", "'part'", "'made_by_' || p_brand", "p_type"),
    ("documents", "'documents'", "'in_' || source", "lang"),
    ("documents", "lang", "'reverse_in_' || source", "'documents'"),
    ("documents", "lang", "source || '-self_loop'", "lang"),
    ("documents", "'documents'", "'beside_' || lang", "'documents'"),
    ("events", "'events'", "event_type", "'user'"),
)
_EDGES = "e AS (" + " UNION ".join(f"SELECT {h} || ':' || {n} || ':' || {t} AS edge_type FROM {table}" for table, h, n, t in EDGE_PARTS) + "), p AS (SELECT edge_type, string_split(edge_type, ':')[1] AS head_type, string_split(edge_type, ':')[2] AS rel, string_split(edge_type, ':')[3] AS tail_type FROM e WHERE edge_type IS NOT NULL)"
_KEPT_EDGES = _EDGES + ", k AS (SELECT * FROM p WHERE NOT ends_with(rel, '-self_loop') AND NOT starts_with(rel, 'reverse_'))"
_DIRECTED = _KEPT_EDGES + """, d AS (SELECT 'head of ' || edge_type AS directed, 'out' AS direction, head_type AS from_type, tail_type AS to_type FROM k
  UNION ALL SELECT 'tail of ' || edge_type, 'in', tail_type, head_type FROM k WHERE head_type <> tail_type)"""


def edge_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The distinct edge types of all rows, each table's made distinct before they meet."""
    parts = [read_table(spark, d, table).selectExpr(f"{h} || ':' || {n} || ':' || {t} AS edge_type").distinct() for table, h, n, t in EDGE_PARTS]
    return ingest.parse_edges(reduce(DataFrame.unionByName, parts).where("edge_type IS NOT NULL").distinct())


@query(f"WITH {_EDGES} SELECT * FROM p")
def edge_catalog_parse(spark, d):
    return ingest.unique_edge_types(edge_catalogue(spark, d))


@query(f"WITH {_KEPT_EDGES} SELECT * FROM k")
def edge_filter(spark, d):
    return ingest.filter_edges(edge_catalogue(spark, d))


@query(f"WITH {_DIRECTED} SELECT * FROM d")
def edge_union_bidirectional(spark, d):
    return ingest.edge_directions(ingest.filter_edges(edge_catalogue(spark, d)))


@query(f"WITH {_DIRECTED} SELECT directed, from_type AS head, to_type AS tail FROM d")
def edge_name_ends(spark, d):
    """Ends of a directed name, read from the name alone."""
    e = ingest.edge_directions(ingest.filter_edges(edge_catalogue(spark, d))).select("directed")
    return e.select("directed", scalar.directed_head(F.col("directed")).alias("head"), scalar.directed_tail(F.col("directed")).alias("tail"))


_FEATURES = """v AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), f AS (SELECT table_name AS node_type, column_name AS "column", table_name || '___' || column_name AS name, false AS is_target FROM information_schema.columns
  WHERE table_name IN ('customer', 'documents', 'orders') UNION ALL SELECT 'user', event_type, 'user___' || event_type, false FROM v
  UNION ALL SELECT 'user', 'text_' || event_type, 'user___text_' || event_type, false FROM v WHERE n * 5 > (SELECT count(*) FROM events)
  UNION ALL SELECT DISTINCT source, 'grade', source || '___grade', true FROM documents)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """Columns of tables, of users (one per event type, with a text version where a type has over a fifth of all events) and, as targets, of sources."""
    out = ingest.feature_catalogue({t: read_table(spark, d, t) for t in ("customer", "documents", "orders")})
    events = read_table(spark, d, "events")
    kinds, every = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), events.count()
    named = lambda df, t, c, k, target: df.select(t.alias("node_type"), c.alias("column"), ingest.qualified(t, c).alias("name"), F.lit(k).alias("dtype"), F.lit(target).alias("is_target"))
    out = out.unionByName(named(kinds, F.lit("user"), F.col("event_type"), "bigint", False))
    out = out.unionByName(named(kinds.where(F.col("n") * 5 > every), F.lit("user"), F.concat(F.lit("text_"), "event_type"), "array<float>", False))
    return out.unionByName(named(read_table(spark, d, "documents").select("source").distinct(), F.col("source"), F.lit("grade"), "bigint", True))


@query(f"WITH {_FEATURES} SELECT name FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.node_type = f.node_type AND g.\"column\" = 'text_' || f.\"column\")")
def feature_supersede(spark, d):
    return ingest.supersede(features(spark, d)).select("name")


@query(f"WITH {_FEATURES} SELECT node_type, count(*) AS n_features, bool_or(is_target) AS is_target FROM f GROUP BY 1")
def target_types(spark, d):
    return ingest.target_types(features(spark, d))


@query(f"WITH {_FEATURES} SELECT node_type, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1")
def completion_types(spark, d):
    return tasks.completion_types(features(spark, d))


@query("""WITH t AS (SELECT 'orders' AS node_type, o_orderkey AS row_id, epoch_us(o_orderdate) AS ts FROM orders UNION ALL SELECT 'customer', c_custkey, 0 FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_suppkey = 1 THEN 1 ELSE 0 END FROM supplier)
SELECT node_type, row_id, CASE WHEN bool_and(ts = 0) OVER (PARTITION BY node_type) THEN -9223372036854775808 ELSE ts END::BIGINT AS ts FROM t""")
def static_timestamp(spark, d):
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = read_table(spark, d, "orders").select(F.lit("orders").alias("node_type"), F.col("o_orderkey").alias("row_id"), micros.alias("ts"))
    rows = rows.unionByName(read_table(spark, d, "customer").select(F.lit("customer").alias("node_type"), F.col("c_custkey").alias("row_id"), F.lit(0).cast("long").alias("ts")))
    rows = rows.unionByName(read_table(spark, d, "supplier").select(F.lit("supplier").alias("node_type"), F.col("s_suppkey").alias("row_id"), (F.col("s_suppkey") == 1).cast("long").alias("ts")))
    return ingest.static_times(rows)


@query("SELECT n_nationkey AS nation___n_nationkey, n_name AS nation___n_name, n_regionkey AS nation___n_regionkey FROM nation")
def qualify_columns(spark, d):
    return ingest.qualify_columns(read_table(spark, d, "nation"), "nation")


@query("""SELECT c_custkey AS src, count(o_orderkey) AS degree, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS neighbours
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def adjacency_list(spark, d):
    return ingest.adjacency(read_table(spark, d, "customer"), orders_of_customers(spark, d), "c_custkey").withColumn("neighbours", F.array_join("neighbours", ","))


@query("SELECT o_orderkey AS src, count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def out_degree(spark, d):
    return ingest.out_degree(read_table(spark, d, "orders"), lines_of_orders(spark, d), "o_orderkey")


@query("""WITH g AS (SELECT c_custkey AS src, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT src, degree, coalesce(sum(degree) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pointer FROM g""")
def csr_pointer(spark, d):
    return ingest.pointers(ingest.out_degree(read_table(spark, d, "customer"), orders_of_customers(spark, d), "c_custkey"))


@query(f"SELECT 'head of {LINE}' AS edge_type, {LINE_ID_SQL} AS src, l_orderkey AS dst, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def neighbor_time_denorm(spark, d):
    back = ingest.reversed_edges(lines_of_orders(spark, d), f"head of {LINE}")
    return ingest.denormalize_times(back, read_table(spark, d, "orders"), "o_orderkey", "o_orderdate").select("edge_type", "src", "dst", "ts")


@query(f"""WITH {_DIRECTED}, t AS (SELECT lang AS node_type, count(*) AS num FROM documents GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1 UNION ALL SELECT 'documents', count(*) FROM documents
  UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT r_name, count(*) FROM region GROUP BY 1)
SELECT node_type, num, coalesce(string_agg(directed, ',' ORDER BY directed), '') AS edges FROM t LEFT JOIN d ON node_type = from_type GROUP BY 1, 2""")
def metadata_join(spark, d):
    """Counted node types with the edges that leave them; a region has none."""
    from ..sources.catalog import joined_metadata

    types = (("documents", "lang"), ("part", "p_type"), ("documents", "'documents'"), ("orders", "'orders'"), ("region", "r_name"))
    nodes = [read_table(spark, d, table).groupBy(F.expr(kind).alias("node_type")).agg(F.count(F.lit(1)).alias("num")) for table, kind in types]
    directions = ingest.edge_directions(ingest.filter_edges(edge_catalogue(spark, d)))
    return joined_metadata(reduce(DataFrame.unionByName, nodes), directions).withColumn("edges", F.array_join("edges", ","))


# Tasks and batches

_TASK_ROWS = """h AS (SELECT doc_id, toxic, quality, cast('0x' || substr(md5(concat_ws('|', '42', doc_id)), 1, 15) AS BIGINT) % 100 AS b FROM labels),
r AS (SELECT 'toxic' AS task, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'valid' ELSE 'test' END AS split, doc_id AS row_id, toxic::DOUBLE AS label FROM h
  UNION ALL SELECT 'quality', CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'valid' ELSE 'test' END, doc_id, quality::DOUBLE FROM h)"""


def task_rows(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "labels").withColumn("split", tasks.split_of(F.col("doc_id")))
    one = lambda t: labels.select(F.lit(t).alias("task"), "split", F.col("doc_id").alias("row_id"), F.col(t).cast("double").alias("label"))
    return one("toxic").unionByName(one("quality"))


@query(f"WITH {_TASK_ROWS} SELECT * FROM r")
def task_split_union(spark, d):
    rows = task_rows(spark, d)
    return tasks.union_splits({s: rows.where(F.col("split") == s).drop("split") for s in tasks.SPLITS}).select("task", "split", "row_id", "label")


@query(f"WITH {_TASK_ROWS}, n AS (SELECT task, split, count(*) AS n FROM r GROUP BY 1, 2) SELECT task, split, n, coalesce(sum(n) OVER (PARTITION BY task ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n")
def split_offsets(spark, d):
    return tasks.split_offsets(task_rows(spark, d))


@query(f"WITH {_TASK_ROWS} SELECT * FROM r WHERE split = 'train' OR label = 1")
def positive_pairs(spark, d):
    return tasks.positive_pairs(task_rows(spark, d))


#: Tasks on the documents of each source: column, type, target type, metric. Regression on another type than the seeds' is to be left out.
TASK_KINDS = (("lang", "retrieval", "lang", "hr@1"), ("n_chars", "regression", "documents", "rmse"), ("toxic", "retrieval", "labels", "retrieval_auroc"), ("quality", "regression", "labels", "mae"))
_KINDS = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({x!r}, {t!r}, {y!r}, {m!r})" for x, t, y, m in TASK_KINDS) + ") AS v(target, task_type, target_type, metric))"
_TASKS = _KINDS + """, g AS (SELECT source, min(lang) <> max(lang) AS l, min(n_chars) <> max(n_chars) AS n, min(text) <> max(text) AS x FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT target || '@' || source AS task, task_type, 'documents' AS seed_type, target_type, source, target, l, n, x FROM g, k)"""


def task_table(spark: SparkSession, d: str) -> DataFrame:
    """TASK_KINDS for each source; a feature with one value in all of a source's documents isn't allowed."""
    docs = read_table(spark, d, "documents").where("source IS NOT NULL")
    names = ("lang", "n_chars", "text")
    varied = docs.groupBy("source").agg(*[(F.min(c) != F.max(c)).alias(c) for c in names])
    every = F.array(*[F.lit(f"documents___{c}") for c in (*names, "text_lang")])
    allowed = F.concat(F.array(F.lit("documents___text_lang")), *[F.when(F.col(c), F.array(F.lit(f"documents___{c}"))).otherwise(F.array().cast("array<string>")) for c in names])
    kinds = F.array(*[F.struct(F.lit(x).alias("target"), F.lit(t).alias("task_type"), F.lit(y).alias("target_type"), F.lit(m).alias("metric")) for x, t, y, m in TASK_KINDS])
    each = varied.select("source", every.alias("all_features"), allowed.alias("allowed_features"), F.explode(kinds).alias("k"))
    return each.select(F.concat("k.target", F.lit("@"), "source").alias("task"), "k.task_type", F.lit("documents").alias("seed_type"), "k.target_type", "k.metric", "all_features", "allowed_features", "k.target", "source")


@query(f"WITH {_TASKS} SELECT task, task_type, seed_type, target_type FROM t WHERE task_type <> 'regression' OR target_type = seed_type")
def matching_types(spark, d):
    return tasks.matching_types(task_table(spark, d)).select("task", "task_type", "seed_type", "target_type")


@query(f"WITH {_TASKS} SELECT task, CASE WHEN task_type = 'regression' THEN target_type ELSE seed_type END AS seed_type, CASE WHEN task_type = 'regression' THEN seed_type ELSE target_type END AS target_type FROM t")
def swap_roles(spark, d):
    return tasks.swap_roles(task_table(spark, d)).select("task", "seed_type", "target_type")


@query(f"""WITH {_TASKS}, h AS (SELECT task, unnest(['documents___lang', 'documents___n_chars', 'documents___text', 'documents___text_lang']) AS name, unnest([l AND target <> 'lang', n AND target <> 'n_chars', x, target <> 'lang']) AS seen FROM t)
SELECT task, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT coalesce(seen, false)), '') AS masked FROM h GROUP BY 1""")
def masked_features(spark, d):
    """Both versions of the target column are masked, whatever is allowed."""
    target = ingest.qualified(F.lit("documents"), F.col("target"))
    return task_table(spark, d).select("task", F.array_join(tasks.masked_features(F.col("all_features"), F.col("allowed_features"), target), ",").alias("masked"))


@query("SELECT c_custkey AS row_id, u.name, u.value FROM customer, (SELECT unnest(['customer___c_acctbal', 'customer___c_mktsegment']) AS name, unnest([c_acctbal::VARCHAR, c_mktsegment]) AS value) u WHERE u.name <> 'customer___c_acctbal'")
def column_mask(spark, d):
    c = read_table(spark, d, "customer")
    names = ("c_acctbal", "c_mktsegment")
    long = c.select(F.col("c_custkey").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f"customer___{n}").alias("name"), F.col(n).cast("string").alias("value")) for n in names])).alias("x")).select("row_id", "x.*")
    return tasks.mask_rows(long, F.array(F.lit("customer___c_acctbal")))


def _selector(name: str, selector: str, where: str) -> None:
    def f(spark, d):
        table = task_table(spark, d)
        return tasks.select_tasks(table, selector, table.select(F.col("source").alias("group_name"), "task")).select("task")
    f.__name__ = f"task_select_{name}"
    query(f"WITH {_TASKS} SELECT task FROM t WHERE {where}")(f)


_selector("all", "ALLTASK", "true")
_selector("retrieval", "RETTASK", "task_type = 'retrieval'")
_selector("regression", "REGTASK", "task_type = 'regression'")
_selector("except", "EXCEPT__toxic@src0", "task <> 'toxic@src0'")
_selector("group", "src3", "source = 'src3'")
_selector("list", "toxic@src1,n_chars@src2", "task IN ('toxic@src1', 'n_chars@src2')")

_NUMBERED = "(row_number() OVER (PARTITION BY task ORDER BY {order}) - 1)"
_DRAW = "md5(concat_ws('|', '42', task, row_id))"


@query(f"WITH {_TASK_ROWS} SELECT task, row_id, ({_NUMBERED.format(order='row_id')} // 32)::BIGINT AS batch_id, ({_NUMBERED.format(order='row_id')} % 32)::BIGINT AS slot FROM r")
def batch_sequential(spark, d):
    return tasks.batches(task_rows(spark, d), BatchSpec(size=32)).select("task", "row_id", "batch_id", "slot")


@query(f"WITH {_TASK_ROWS} SELECT task, row_id, ({_NUMBERED.format(order=f'{_DRAW}, row_id')} // 32)::BIGINT AS batch_id, ({_NUMBERED.format(order=f'{_DRAW}, row_id')} % 32)::BIGINT AS slot FROM r")
def batch_shuffled(spark, d):
    return tasks.batches(task_rows(spark, d), BatchSpec(size=32, shuffle=True)).select("task", "row_id", "batch_id", "slot")


@query(f"WITH {_TASK_ROWS}, b AS (SELECT DISTINCT task, batch_id FROM (SELECT task, ({_NUMBERED.format(order='row_id')} // 32)::BIGINT AS batch_id FROM r)) SELECT task, batch_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', task, batch_id)), task, batch_id) - 1 AS place FROM b")
def batch_order(spark, d):
    return tasks.batch_order(tasks.batches(task_rows(spark, d), BatchSpec(size=32)))


@query(f"WITH {_TASK_ROWS} SELECT task, row_id FROM r QUALIFY {_NUMBERED.format(order=f'{_DRAW}, row_id')} < floor(count(*) OVER (PARTITION BY task) * 0.25)")
def downsample_ratio(spark, d):
    return tasks.downsample_ratio(task_rows(spark, d), 0.25).select("task", "row_id")


@query(f"WITH {_TASK_ROWS} SELECT task, row_id FROM r QUALIFY {_NUMBERED.format(order=f'{_DRAW}, row_id')} < 50")
def downsample_absolute(spark, d):
    return tasks.downsample_absolute(task_rows(spark, d), 50).select("task", "row_id")


@query(f"""WITH {_TASK_ROWS}, n AS (SELECT *, {_NUMBERED.format(order='row_id')} AS pos, count(*) OVER (PARTITION BY task) AS n FROM r),
s AS (SELECT DISTINCT task, n, floor(n * CASE task WHEN 'toxic' THEN 1.5 ELSE 0.5 END)::BIGINT AS wanted FROM n),
d AS (SELECT task, n, u.draw AS draw, cast('0x' || substr(md5(concat_ws('|', '42', task, u.draw)), 1, 15) AS BIGINT) % n AS pos FROM s, unnest(range(wanted)) AS u(draw))
SELECT d.task, d.draw, n.row_id FROM d JOIN n ON d.task = n.task AND d.pos = n.pos""")
def sample_with_replacement(spark, d):
    return tasks.sample_with_replacement(task_rows(spark, d), {"toxic": 1.5}, default=0.5).select("task", "draw", "row_id")


@query("""WITH c AS (SELECT *, cast('0x' || substr(md5(concat_ws('|', '42', c_custkey)), 1, 15) AS BIGINT) % 3 AS i FROM customer)
SELECT c_custkey AS row_id, ['c_name', 'c_nationkey', 'c_mktsegment'][i + 1] AS hidden, [c_name, c_nationkey::VARCHAR, c_mktsegment][i + 1] AS target, (i = 0)::VARCHAR || ',' || (i = 1)::VARCHAR || ',' || (i = 2)::VARCHAR AS mask FROM c""")
def completion_mask(spark, d):
    rows = tasks.completion_mask(read_table(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])
    return rows.withColumn("mask", F.array_join(F.transform("mask", lambda x: x.cast("string")), ","))


@query("""WITH s AS (SELECT doc_id, toxic, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, cast('0x' || substr(md5(concat_ws('|', '42', doc_id)), 1, 15) AS BIGINT) % 100 AS b FROM labels)),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos FROM s)
SELECT pos, doc_id, toxic FROM r WHERE split = 'valid' AND pos IN (SELECT pos FROM r WHERE split = 'test')""")
def split_lookup(spark, d):
    """The validation rows at the positions that the test split has."""
    rows = read_table(spark, d, "labels").select("doc_id", "toxic", tasks.split_of(F.col("doc_id")).alias("split"))
    parts = [with_position(rows.where(F.col("split") == s), "doc_id") for s in ("valid", "test")]
    return tasks.split_lookup(parts[0], "valid", parts[1].select("pos")).select("pos", "doc_id", "toxic")


_SAMPLED_FEATURES = """v AS (SELECT root_id, inst_id, x.name, x.value FROM every JOIN customer ON node_type = 'customer' AND row_id = c_custkey,
  (SELECT unnest(['customer___c_name', 'customer___c_mktsegment', 'customer___c_nationkey']) AS name, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value) x)"""


@query(_BACK + ", " + _SAMPLED_FEATURES + """, k AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY md5(concat_ws('|', '42', inst_id, name)), name) AS nth FROM v)
SELECT inst_id, name AS hidden, value AS target FROM k WHERE nth = 1""")
def completion_mask_sampled(spark, d):
    """One column of every sampled instance is hidden, also of those behind the roots."""
    return tasks.completion_mask_sampled(_sampled_features(spark, d))


@query(_BACK + ", " + _SAMPLED_FEATURES + """, k AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY md5(concat_ws('|', '42', inst_id, name)), name) AS nth FROM v)
SELECT root_id, inst_id, name, value FROM k WHERE nth > 1""")
def completion_rest_sampled(spark, d):
    """What is left to see of them."""
    values = _sampled_features(spark, d)
    return tasks.mask_hidden(values, tasks.completion_mask_sampled(values)).select("root_id", "inst_id", "name", "value")


def _sampled_features(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d), ("orders", PLACED, "customer"): customers_of_orders(spark, d)}
    names = ["c_name", "c_mktsegment", "c_nationkey"]
    found = sampling.with_features(sampling.sample(customers(spark, d, cutoff=False), "customer", edges, SampleSpec(hops=2, fanout=3)), c, "customer", "c_custkey", names)
    pairs = F.array(*[F.struct(F.lit(f"customer___{n}").alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    return found.select("root_id", "inst_id", F.explode(pairs).alias("x")).select("root_id", "inst_id", "x.*")


# Encoders

_DICTIONARY = """v AS (SELECT DISTINCT 0 AS part, 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT DISTINCT 1, 'source', source FROM documents),
c AS (SELECT row_number() OVER (ORDER BY part, value) - 1 AS code, "column", value FROM v)"""


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return encoders.dictionary({n: docs.select(F.col(n).alias("value")) for n in ("lang", "source")})


@query(f"WITH {_DICTIONARY} SELECT * FROM c")
def dictionary_build(spark, d):
    return _dictionary(spark, d)


@query(f"WITH {_DICTIONARY} SELECT doc_id, code FROM documents JOIN c ON \"column\" = 'source' AND value = source")
def dictionary_encode(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("value"))
    return encoders.encode(docs, _dictionary(spark, d), "source").select("doc_id", "code")


@query("SELECT doc_id, source AS value FROM documents")
def dictionary_decode(spark, d):
    codes = _dictionary(spark, d)
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("value"))
    return encoders.decode(encoders.encode(docs, codes, "source").select("doc_id", "code"), codes).select("doc_id", "value")


@query("SELECT vec_id, dense_rank() OVER (ORDER BY embedding) - 1 AS code FROM embeddings")
def dictionary_of_vectors(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("value"))
    return encoders.encode(e, encoders.dictionary({"embedding": e}), "embedding").select("vec_id", "code")


@query("SELECT p_partkey, i::INT AS pos, round(cos(p_size::DOUBLE * pow(10, -2 + 3 * i::DOUBLE / 7)), 6) AS x FROM part, range(8) AS r(i)")
def cosine_bank(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", F.posexplode(encoders.encode_column(p, "p_size", 8)).alias("pos", "x")).withColumn("x", F.round("x", 6))


_EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_UNNEST = "SELECT vec_id, unnest(range(0, 64))::INT AS pos, round(unnest({v}), 6) AS x FROM e"


def _vectors(spark: SparkSession, d: str, f) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(f(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_EMB}, " + "m AS (SELECT *, list_avg(v) AS m FROM e), s AS (SELECT *, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) AS s FROM m) SELECT vec_id, unnest(range(0, 64))::INT AS pos, round(unnest(list_transform(v, lambda x: (x - m) / sqrt(s + 0.00001::DOUBLE))), 6) AS x FROM s")
def layer_norm(spark, d):
    return _vectors(spark, d, scalar.layer_norm)


@query(f"WITH {_EMB} " + _UNNEST.format(v="list_transform(v, lambda x: x * 3 / sqrt(list_dot_product(list_transform(v, lambda y: y * 3), list_transform(v, lambda y: y * 3))))"))
def l2_normalize(spark, d):
    return _vectors(spark, d, lambda v: scalar.l2_normalize(F.transform(v, lambda x: x.cast("double") * 3)))


@query("SELECT vec_id, unnest(range(0, 10))::INT AS pos, unnest(list_transform(range(0, 10), lambda i: i = label)) AS hit FROM embeddings")
def one_hot_mask(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.posexplode(scalar.one_hot(F.col("label"), 10)).alias("pos", "hit"))


@query(f"WITH {_EMB}, m AS (SELECT *, list_avg(v) AS m FROM e), s AS (SELECT *, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) AS s FROM m) SELECT vec_id, round(list_dot_product(list_transform(v, lambda x: (x - m) / sqrt(s + 0.00001::DOUBLE)), list_transform(range(1, 65), lambda i: 1.0::DOUBLE / i)), 6) AS y FROM s")
def float_decoder(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.round(encoders.decode_floats(F.col("embedding"), [1.0 / i for i in range(1, 65)]), 6).alias("y"))


def _floats_sql(source: str, key: str, value: str, weights) -> str:
    """CTEs that end in h3 (key, v): the frozen encoder's three layers, each output as a sum of products."""
    number = lambda x: f"({float(x)!r})::DOUBLE"
    parts = [f"h0 AS (SELECT {key}, [{value}::DOUBLE] AS v FROM {source})"]
    for i, (w, bias) in enumerate(weights):
        outputs = [" + ".join(f"v[{k + 1}] * {number(x)}" for k, x in enumerate(column)) + f" + {number(b)}" for column, b in zip(w.T, bias, strict=True)]
        parts.append(f"a{i} AS (SELECT {key}, [{', '.join(outputs)}] AS v FROM h{i})")
        parts.append(f"m{i} AS (SELECT *, list_avg(v) AS m FROM a{i}), s{i} AS (SELECT *, sqrt(list_avg(list_transform(v, lambda x: (x - m) * (x - m))) + 0.00001::DOUBLE) AS s FROM m{i})")
        parts.append(f"n{i} AS (SELECT {key}, list_transform(v, lambda x: (x - m) / s) AS v FROM s{i}), h{i + 1} AS (SELECT {key}, list_transform(v, lambda x: x / (1 + exp(-x))) AS v FROM n{i})")
    return ", ".join(parts)


@query(f"WITH {_floats_sql('customer', 'c_custkey', 'c_acctbal', encoders.float_weights(16))} SELECT c_custkey, unnest(range(0, 16))::INT AS pos, round(unnest(v), 6) AS x FROM h3")
def float_encoder(spark, d):
    out = encoders.float_encoder(read_table(spark, d, "customer"), "c_custkey", "c_acctbal", encoders.float_weights(16))
    return out.select("c_custkey", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round("x", 6))


def text_dictionary(spark: SparkSession, d: str, table: str, column: str) -> DataFrame:
    """value, emb of a text column: its codes in order, and the vector that the table of vectors has for each code."""
    codes = encoders.dictionary({column: read_table(spark, d, table).select(F.col(column).alias("value"))})
    return codes.join(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("code"), F.col("embedding").alias("emb")), "code").select("value", "emb")


_BANK = "list_transform(range(0, 64), lambda i: cos({x}::DOUBLE * pow(10, -2 + 3 * i::DOUBLE / 63)))"
_TEXT = "(SELECT value, embedding::DOUBLE[] AS v FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT {c} AS value FROM {t})) JOIN embeddings ON vec_id = code)"


@query(f"""WITH f AS (SELECT c_custkey AS row_id, [{_BANK.format(x="c_nationkey")}, t.v] AS v, [false, false] AS m FROM customer JOIN {_TEXT.format(c="c_mktsegment", t="customer")} t ON t.value = c_mktsegment)
SELECT row_id, (c.i)::INT AS col, p.j::INT AS pos, round(v[c.i + 1][p.j + 1], 6) AS x, m[c.i + 1] AS masked FROM f, range(2) AS c(i), range(64) AS p(j)""")
def typed_features(spark, d):
    """Columns of mixed types as one array of vectors a row."""
    rows = read_table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id")
    found = typed.column_vectors(rows, ["c_nationkey", "c_mktsegment"], 64, texts={"c_mktsegment": text_dictionary(spark, d, "customer", "c_mktsegment")})
    each = found.select("row_id", F.posexplode(F.arrays_zip("feats", "mask")).alias("col", "f")).select("row_id", "col", F.col("f.mask").alias("masked"), F.posexplode("f.feats").alias("pos", "x"))
    return each.withColumn("x", F.round("x", 6))


def sampled_input(spark: SparkSession, d: str) -> typed.ModelInput:
    """Customers and their sampled orders, the customers' segment masked in the roots."""
    tables = {
        "customer": typed.FeatureTable(read_table(spark, d, "customer"), "c_custkey", ("c_nationkey", "c_mktsegment"), {"c_mktsegment": text_dictionary(spark, d, "customer", "c_mktsegment")}),
        "orders": typed.FeatureTable(read_table(spark, d, "orders"), "o_orderkey", ("o_orderstatus", "o_custkey", "o_orderkey"), {"o_orderstatus": text_dictionary(spark, d, "orders", "o_orderstatus")}),
    }
    edges = {("customer", PLACED, "orders"): orders_of_customers(spark, d)}
    return typed.sampled_input(customers(spark, d), "customer", edges, SampleSpec(hops=1, fanout=5), tables, 64, hidden={"customer": ("c_mktsegment",)})


@query(f"""WITH {_SEEDS.format(cutoff=_CUTOFF)}, {_H1}, every AS (SELECT * FROM seeds UNION ALL SELECT * FROM h1),
z AS (SELECT *, row_number() OVER (ORDER BY node_type <> 'customer', node_type, inst_id) - 1 AS node FROM every),
f AS (SELECT node, node_type, [{_BANK.format(x="c_nationkey")}, t.v] AS v, [false, true] AS m FROM z JOIN customer ON node_type = 'customer' AND row_id = c_custkey JOIN {_TEXT.format(c="c_mktsegment", t="customer")} t ON t.value = c_mktsegment
  UNION ALL SELECT node, node_type, [t.v, {_BANK.format(x="o_custkey")}, {_BANK.format(x="o_orderkey")}], [false, false, false] FROM z JOIN orders ON node_type = 'orders' AND row_id = o_orderkey JOIN {_TEXT.format(c="o_orderstatus", t="orders")} t ON t.value = o_orderstatus)
SELECT node, node_type, u.i::INT AS col, m[u.i + 1] AS masked, round(list_sum(list_transform(v[u.i + 1], lambda x, j: x * j)), 5) AS x FROM f, unnest(range(len(v))) AS u(i)""")
def sampled_model_input(spark, d):
    """The model's input for a sample over two node types, in one call; each vector by its sum weighted with positions."""
    nodes = sampled_input(spark, d).nodes
    each = nodes.select("node", "node_type", F.posexplode(F.arrays_zip("feats", "mask")).alias("col", "f"))
    weighted = F.transform("f.feats", lambda x, j: x * (j + 1))
    return each.select("node", "node_type", "col", F.col("f.mask").alias("masked"), F.round(scalar.total(weighted), 5).alias("x"))


@query(f"WITH {_SEEDS.format(cutoff=_CUTOFF)}, {_H1}, every AS (SELECT * FROM seeds UNION ALL SELECT * FROM h1), z AS (SELECT *, row_number() OVER (ORDER BY node_type <> 'customer', node_type, inst_id) - 1 AS node FROM every) SELECT p.node AS center, c.edge_type AS rel, c.node AS nbr, 0 AS relation FROM z c JOIN z p ON p.inst_id = c.parent_inst")
def sampled_model_edges(spark, d):
    """Its edges, as messages go along them."""
    return sampled_input(spark, d).edges


@query(f"WITH e AS (SELECT vec_id, label, embedding FROM embeddings), n AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS code, event_type FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, event_type, round(list_sum(embedding::DOUBLE[]), 5) AS x FROM events JOIN n USING (event_type) JOIN e ON vec_id = code")
def name_lookup(spark, d):
    """Vectors of names (here of event types) looked up for the rows that carry the name."""
    names = text_dictionary(spark, d, "events", "event_type").withColumnRenamed("value", "name")
    found = typed.with_vectors(read_table(spark, d, "events").select("event_id", "event_type"), names, "event_type")
    return found.select("event_id", "event_type", F.round(scalar.total(F.col("emb")), 5).alias("x"))


def _names_sql(names: str, width: int = 32) -> str:
    """SQL of encoders.name_vector for the names of a query: signed counts of hashed words over their norm; 0 for a place no word falls on."""
    return f"""words AS (SELECT DISTINCT name, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM (SELECT name, regexp_extract_all(replace(replace(lower(name), '_', ' '), ':', ' '), '[^ ]+') AS ws FROM ({names}))),
hashed AS (SELECT name, ('0x' || substr(md5(word), 1, 2))::INT % {width} AS pos, 2 * (('0x' || substr(md5(word), 11, 2))::INT % 2) - 1 AS s FROM words),
placed AS (SELECT name, pos, sum(s)::DOUBLE AS x FROM hashed GROUP BY 1, 2), z AS (SELECT name, sqrt(sum(x * x)) AS norm FROM placed GROUP BY 1)
SELECT z.name, p.pos::INT AS pos, round(CASE WHEN norm > 0 THEN coalesce(x, 0) / norm ELSE 0 END, 6) AS x FROM z CROSS JOIN range({width}) AS p(pos) LEFT JOIN placed ON placed.name = z.name AND placed.pos = p.pos"""


def _places(vectors: DataFrame) -> DataFrame:
    return vectors.select("name", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_FEATURES}, " + _names_sql("SELECT name FROM f"))
def name_embedding(spark, d):
    return _places(encoders.name_vectors(features(spark, d).select("name")))


@query(f"WITH {_DIRECTED}, " + _names_sql("SELECT directed AS name FROM d UNION SELECT 'fewshot'"))
def edge_name_embedding(spark, d):
    return _places(encoders.edge_name_vectors(ingest.edge_directions(ingest.filter_edges(edge_catalogue(spark, d)))))


# Few-shot

_DRAWS = """k AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS time_rank, rank() OVER (ORDER BY ts) - 1 AS n_before FROM events),
d AS (SELECT event_id AS root_id, u.i::INT AS draw, cast('0x' || substr(md5(concat_ws('|', '42', event_id, u.i)), 1, 15) AS BIGINT) % n_before AS time_rank FROM k, unnest(range({k})) AS u(i) WHERE n_before > 0),
x AS (SELECT root_id, draw, event_id AS example_id FROM d JOIN k USING (time_rank))"""


def _draws(spark: SparkSession, d: str, spec: FewShotSpec) -> tuple[DataFrame, DataFrame]:
    events = read_table(spark, d, "events")
    ranked = fewshot.time_ranked(events, "event_id", "ts")
    return fewshot.draw(ranked, events.select(F.col("event_id").alias("row_id")), spec), events


@query(f"WITH {_DRAWS.format(k=3)} SELECT * FROM x")
def fewshot_draw(spark, d):
    return _draws(spark, d, FewShotSpec(k=3))[0]


_EVENT_VECTOR = "embedding::DOUBLE[]"


_RERANKED = f"""WITH {_DRAWS.format(k=6)}, v AS (SELECT event_id AS row_id, {_EVENT_VECTOR} AS emb FROM events JOIN embeddings ON cast(json_extract_string(props, '$.k') AS BIGINT) = vec_id),
s AS (SELECT root_id, draw, example_id, list_dot_product(a.emb, b.emb) AS score FROM x JOIN v a ON a.row_id = root_id JOIN v b ON b.row_id = example_id)
SELECT root_id, draw, example_id, round(score, 5) AS score, (row_number() OVER (PARTITION BY root_id ORDER BY score DESC, example_id, draw))::INT AS rank FROM s QUALIFY rank <= 2"""


@query(_RERANKED)
def fewshot_rerank(spark, d):
    spec = FewShotSpec(k=2, rerank_factor=3)
    draws, events = _draws(spark, d, spec)
    return fewshot.rerank(draws, event_vectors(spark, d), spec).withColumn("score", F.round("score", 5))


@query(_RERANKED)
def fewshot_rerank_masked(spark, d):
    """The events' value is a column too, but masked in the roots, so that examples are chosen by the rest alone."""
    spec = FewShotSpec(k=2, rerank_factor=3)
    draws, events = _draws(spark, d, spec)
    rows = events.select(F.col("event_id").alias("row_id"), F.get_json_object("props", "$.k").cast("long").alias("vec_id"), "user_id")
    side = read_table(spark, d, "embeddings").select("vec_id", scalar.doubles(F.col("embedding")).alias("v"))
    side = F.broadcast(side) if side.count() <= typed.TEXT_ROWS else side

    def encoded(masked):
        def make(df):
            found = typed.column_vectors(df.join(side, "vec_id"), ["user_id"], 64).withColumn("feats", F.concat(F.array("v"), "feats"))
            return found.withColumn("emb", fewshot.flat_vector(masked))

        return make

    return fewshot.rerank_rows(draws, rows, encoded([]), spec, encoded([1])).withColumn("score", F.round("score", 5))


def event_vectors(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    return read_table(spark, d, "events").select(F.col("event_id").alias("row_id"), k.alias("vec_id")).join(e, "vec_id").select("row_id", "emb")


_ROOT, _EXAMPLE = "md5(concat_ws('|', 'root', 'events', root_id))", "md5(concat_ws('|', 'example', 'events', root_id, draw))"
BY = "events:by:customer"


@query(f"WITH {_DRAWS.format(k=3)} SELECT root_id, {_ROOT} AS src_inst, {_EXAMPLE} AS dst_inst, 'fewshot' AS edge_type FROM x")
def fewshot_link_edges(spark, d):
    return fewshot.link_edges(_draws(spark, d, FewShotSpec(k=3))[0], "events")


_EVENT_USERS = f"""s AS (SELECT event_id AS root_id, {_ROOT.replace("root_id", "event_id")} AS inst, event_id, user_id FROM events
  UNION ALL SELECT root_id, {_EXAMPLE}, event_id, user_id FROM x JOIN events ON event_id = example_id)"""


def event_graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All instances of the events' sample, of their examples' samples, and the draws."""
    draws, events = _draws(spark, d, FewShotSpec(k=3))
    edges = {("events", BY, "customer"): ingest.edges_of(events, f"head of {BY}", "event_id", "user_id")}
    roots = sampling.seeds(events, "events", "event_id", "ts")
    spec = SampleSpec(hops=1, fanout=5)
    return sampling.sample(roots, "events", edges, spec), sampling.sample(fewshot.example_seeds(draws, roots, "events"), "events", edges, spec), draws


@query(f"""WITH {_DRAWS.format(k=3)}, {_EVENT_USERS} SELECT root_id, inst AS src_inst, md5(concat_ws('|', 'path', inst, 'head of {BY}', 0)) AS dst_inst, 'head of {BY}' AS edge_type FROM s
UNION ALL SELECT root_id, {_ROOT}, {_EXAMPLE}, 'fewshot' FROM x""")
def fewshot_merge_graphs(spark, d):
    """The edges of the main sample, of the examples' samples, and the links from roots to examples."""
    main, few, draws = event_graphs(spark, d)
    return fewshot.merge_graphs(sampling.sub_edges(main), sampling.sub_edges(few), fewshot.link_edges(draws, "events"))


@query(f"""WITH {_DRAWS.format(k=3)}, {_EVENT_USERS}, e AS (SELECT root_id, inst AS src_inst, md5(concat_ws('|', 'path', inst, 'head of {BY}', 0)) AS dst_inst, 'head of {BY}' AS edge_type FROM s
  UNION ALL SELECT root_id, {_ROOT}, {_EXAMPLE}, 'fewshot' FROM x),
i AS (SELECT 'events' AS node_type, inst AS inst_id FROM s UNION ALL SELECT 'customer', dst_inst FROM e WHERE edge_type <> 'fewshot'),
z AS (SELECT inst_id, row_number() OVER (ORDER BY node_type <> 'events', node_type, inst_id) - 1 AS node FROM i)
SELECT a.node AS src, b.node AS dst, CASE edge_type WHEN 'fewshot' THEN 0 ELSE 1 END AS relation, edge_type FROM e JOIN z a ON a.inst_id = src_inst JOIN z b ON b.inst_id = dst_inst""")
def graph_unify_fewshot(spark, d):
    """Roots, their examples, the samples of both and the links between them as one numbered graph."""
    main, few, draws = event_graphs(spark, d)
    edges = fewshot.merge_graphs(sampling.sub_edges(main), sampling.sub_edges(few), fewshot.link_edges(draws, "events"))
    return homogeneous.unify(main.unionByName(few), edges, "events", keep=())[1]


@query(f"""WITH {_DRAWS.format(k=3)}, {_EVENT_USERS} SELECT s.root_id, inst AS inst_id, event_type, value FROM s JOIN events USING (event_id) WHERE inst <> {_ROOT.replace("root_id", "s.root_id")}""")
def fewshot_example_nodes(spark, d):
    """The examples' instances with features of their rows."""
    few = event_graphs(spark, d)[1]
    found = sampling.with_features(few, read_table(spark, d, "events"), "events", "event_id", ["event_type", "value"])
    return found.select("root_id", "inst_id", "event_type", "value")


@query("""WITH s AS (SELECT c_custkey AS root_id, md5(concat_ws('|', 'root', 'customer', c_custkey)) AS inst FROM customer),
e AS (SELECT root_id, inst, l_suppkey AS dst, row_number() OVER (PARTITION BY root_id ORDER BY l_suppkey) - 1 AS pos FROM s JOIN orders ON o_custkey = root_id JOIN lineitem ON l_orderkey = o_orderkey)
SELECT root_id, md5(concat_ws('|', 'path', inst, 'tail of supplier:sold_to:customer', pos)) AS inst_id, dst AS row_id FROM e""")
def neighbor_sample_parallel_edges(spark, d):
    """A customer and a supplier have an edge for every line: each is a neighbour of its own."""
    sold = read_table(spark, d, "orders").join(read_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = {("customer", "supplier:sold_to:customer", "supplier"): ingest.edges_of(sold, "tail of supplier:sold_to:customer", "o_custkey", "l_suppkey")}
    found = sampling.sample(customers(spark, d, cutoff=False), "customer", edges, SampleSpec(hops=1, fanout=None))
    return found.where("hop = 1").select("root_id", "inst_id", "row_id")


# Aggregation

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_REL_EDGES = "g AS (SELECT user_id AS center, event_type AS rel, cast(json_extract_string(props, '$.k') AS BIGINT) AS nbr FROM events)"
_RELS = "w AS (SELECT t.rel, embedding::DOUBLE[] AS w FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(EVENT_TYPES)) + ") AS t(rel, i) JOIN embeddings ON vec_id = i)"
_MEAN_MAX = f"""{_EMB}, {_RELS}, u AS (SELECT vec_id, unnest(range(0, 64))::INT AS pos, unnest(v) AS x FROM e),
m AS (SELECT center, rel, pos, avg(x) AS x FROM g JOIN u ON nbr = vec_id GROUP BY 1, 2, 3),
wu AS (SELECT rel, unnest(range(0, 64))::INT AS pos, unnest(w) AS w FROM w),
b AS (SELECT center, pos, max(x * w) AS x FROM m JOIN wu USING (rel, pos) GROUP BY 1, 2)"""


def _relation_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = read_table(spark, d, "events").select(F.col("user_id").alias("center"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").cast("long").alias("nbr"))
    vectors = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("emb"))
    names = spark.createDataFrame(list(enumerate(EVENT_TYPES)), "row_id long, rel string")
    return edges, vectors, vectors.join(names, "row_id").select("rel", F.col("emb").alias("w"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("center", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_REL_EDGES}, {_MEAN_MAX} SELECT c_custkey AS center, p.pos, round(coalesce(b.x, 0), 6) AS x FROM customer CROSS JOIN (SELECT unnest(range(0, 64))::INT AS pos) p LEFT JOIN b ON b.center = c_custkey AND b.pos = p.pos")
def relation_mean_max(spark, d):
    edges, vectors, relations = _relation_inputs(spark, d)
    centers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("center"))
    return _flat(aggregate.relation_mean_max(edges, vectors, relations, centers, 64))


@query(f"WITH {_REL_EDGES.replace('user_id AS center', 'user_id AS old')}, g2 AS (SELECT nbr AS center, rel, old AS nbr FROM g), {_MEAN_MAX.replace('FROM g JOIN', 'FROM g2 JOIN')} SELECT vec_id AS center, p.pos, round(coalesce(b.x, 0), 6) AS x FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64))::INT AS pos) p LEFT JOIN b ON b.center = vec_id AND b.pos = p.pos")
def relation_mean_max_rev(spark, d):
    edges, vectors, relations = _relation_inputs(spark, d)
    return _flat(aggregate.relation_mean_max(aggregate.reverse(edges), vectors, relations, vectors.select(F.col("row_id").alias("center")), 64))


@query(f"WITH {_REL_EDGES}, {_EMB}, u AS (SELECT vec_id, unnest(range(0, 64))::INT AS p, unnest(v) AS x FROM e), m AS (SELECT center, rel, p, avg(x) AS x FROM g JOIN u ON nbr = vec_id GROUP BY 1, 2, 3) SELECT center, rel, (p + 64 * r.k)::INT AS pos, round(x * (r.k + 1), 6) AS x FROM m, range(8) AS r(k)")
def relation_mean_wide(spark, d):
    """Means of vectors of 512 numbers: one vector a group goes through the shuffle."""
    edges, vectors, _ = _relation_inputs(spark, d)
    wide = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.transform("emb", lambda x: x.cast("double") * k)))
    means = aggregate.relation_mean(edges, vectors.select("row_id", wide.alias("emb")), 512)
    return means.select("center", "rel", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""WITH c AS (SELECT c_custkey, [[1.0, c_acctbal / 1000, 0.5], [2.0, -1.0, c_nationkey], [0.0, 1.0, 1.0]]::DOUBLE[][] AS v, [c_acctbal / 5000, 0.3, c_nationkey / 10.0]::DOUBLE[] AS s,
  [c_custkey % 2 = 0, c_custkey % 3 = 0, c_custkey % 5 = 0] AS m FROM customer),
u AS (SELECT c_custkey, unnest(range(1, 4)) AS i, v, s, m FROM c), l AS (SELECT c_custkey, v[i] AS v, exp(s[i]) AS w FROM u WHERE NOT m[i]),
p AS (SELECT c_custkey, pos, sum(w * v[pos + 1]) / sum(w) AS x FROM l, range(3) AS r(pos) GROUP BY 1, 2)
SELECT c.c_custkey, q.pos::INT AS pos, round(coalesce(x, 0), 6) AS x FROM c CROSS JOIN range(3) AS q(pos) LEFT JOIN p ON p.c_custkey = c.c_custkey AND p.pos = q.pos""")
def attention_pool(spark, d):
    c = read_table(spark, d, "customer")
    row = lambda *x: F.array(*[v.cast("double") if not isinstance(v, float) else F.lit(v) for v in x])
    bal, nat, key = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    columns = F.array(row(1.0, bal / 1000, 0.5), row(2.0, -1.0, nat), row(0.0, 1.0, 1.0))
    c = c.select("c_custkey", columns.alias("v"), row(bal / 5000, 0.3, nat / 10).alias("s"), F.array(key % 2 == 0, key % 3 == 0, key % 5 == 0).alias("m"))
    return c.select("c_custkey", F.posexplode(aggregate.attention_pool(F.col("v"), F.col("s"), F.col("m"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_EMB}, u AS (SELECT label, unnest(range(0, 64))::INT AS pos, unnest(v) AS x FROM e) SELECT label AS node_type, pos, round(avg(x), 6) AS x FROM u GROUP BY 1, 2")
def column_mean_default(spark, d):
    v = read_table(spark, d, "embeddings").select(F.col("label").alias("node_type"), F.col("embedding").alias("emb"))
    return encoders.default_task_vector(v).withColumn("x", F.round("x", 6))


@query()
def model_forward(spark, d):
    """Customers linked by the vectors of their events; stand-in weights."""
    spec = ModelSpec(width=8, layers=2, heads=2)
    c = read_table(spark, d, "customer")
    feats = F.array(encoders.encode_column(c, "c_nationkey", 8), encoders.encode_column(c, "c_custkey", 8))
    nodes = c.select(F.col("c_custkey").alias("row_id"), feats.alias("feats"), F.array(F.lit(False), F.col("c_custkey") % 2 == 0).alias("mask"))
    names = [encoders.name_vector(n, 8) for n in ("customer nation", "customer key")]
    edges = read_table(spark, d, "events").select(F.col("user_id").alias("center"), F.col("event_type").alias("rel"), F.get_json_object("props", "$.k").cast("long").alias("nbr"))
    relations = spark.createDataFrame([(t, encoders.name_vector(t, 8)) for t in EVENT_TYPES], "rel string, emb array<double>")
    return model.forward(nodes, names, edges, relations, spec, model.random_weights(spec)).select("row_id", F.posexplode("emb").alias("pos", "x"))


@query()
def model_forward_sampled(spark, d):
    """The forward pass over a sample of two node types; stand-in weights."""
    spec, given = ModelSpec(width=64, layers=2, heads=4), sampled_input(spark, d)
    nodes = given.nodes.select(F.col("node").alias("row_id"), "node_type", "feats", "mask")
    return model.forward(nodes, given.names, given.edges, given.relations, spec, model.random_weights(spec)).select("row_id", F.posexplode("emb").alias("pos", "x"))


# Heads and metrics

_PROTO = f"{_EMB}, pu AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM e), pm AS (SELECT label, pos, avg(x) AS x FROM pu GROUP BY 1, 2), proto AS (SELECT label AS class_id, list(x ORDER BY pos) AS c FROM pm GROUP BY 1)"
_RAW = _PROTO + ", s AS (SELECT vec_id AS row_id, label, class_id, list_dot_product(v, c) AS score FROM e CROSS JOIN proto)"
_SCORES = _PROTO + ", s AS (SELECT vec_id AS row_id, label, class_id, round(list_dot_product(v, c), 6) AS score FROM e CROSS JOIN proto)"


def classified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector and a label, and a vector for each class."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("emb"), F.col("label").cast("long").alias("label"))
    means = [F.avg(F.get("emb", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(64)]
    classes = e.groupBy(F.col("label").alias("class_id")).agg(*means).select("class_id", F.array(*[f"m{i}" for i in range(64)]).alias("emb"))
    return e, classes


def scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, classes = classified(spark, d)
    return metrics.class_scores(e, classes).withColumn("score", F.round("score", 6)), e.select("row_id", "label")


@query(f"WITH {_SCORES} SELECT row_id, class_id::BIGINT AS class_id, score FROM s")
def class_scores(spark, d):
    return scores(spark, d)[0]


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 10")
def class_candidates(spark, d):
    """The first num_class rows of the seeds' type: the limit is the operator."""
    return metrics.class_candidates(read_table(spark, d, "embeddings"), "vec_id", 10).select("vec_id", "label")


_REGRESSION = "SELECT o_totalprice AS y, coalesce(sum(l_extendedprice), 0) AS o FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice"


def _regression(spark: SparkSession, d: str) -> DataFrame:
    o = lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("output"))
    rows = read_table(spark, d, "orders").join(o, "o_orderkey", "left")
    return rows.select(F.coalesce("output", F.lit(0.0)).alias("output"), F.col("o_totalprice").alias("label"))


@query(f"SELECT round(-sqrt(avg((o - y) * (o - y))), 4) AS rmse FROM ({_REGRESSION})")
def metric_rmse(spark, d):
    return metrics.compute(metrics.drop_padding(_regression(spark, d)), "rmse").select(F.round("rmse", 4).alias("rmse"))


@query(f"SELECT round(-avg(abs(o - y)), 4) AS mae FROM ({_REGRESSION})")
def metric_mae(spark, d):
    return metrics.compute(_regression(spark, d), "mae").select(F.round("mae", 4).alias("mae"))


@query(f"SELECT round(avg((o - y) * (o - y)), 2) AS loss FROM ({_REGRESSION})")
def loss_squared(spark, d):
    return _regression(spark, d).agg(F.round(metrics.squared_loss(F.col("output"), F.col("label")), 2).alias("loss"))


@query(f"WITH {_RAW}, b AS (SELECT row_id, label, first(class_id ORDER BY score DESC, class_id) AS c FROM s GROUP BY 1, 2) SELECT avg((c = label)::INT::DOUBLE) AS hr1 FROM b")
def metric_hr1(spark, d):
    return metrics.compute_folded(*classified(spark, d), "hr@1")


@query(f"WITH {_RAW} SELECT row_id, first(class_id ORDER BY score DESC, class_id)::BIGINT AS class_id, round(max(score), 6) AS top, round(ln(sum(exp(score))), 6) AS log_total, label::BIGINT AS label, round(max(score) FILTER (class_id = label), 6) AS own FROM s GROUP BY row_id, label")
def class_folds(spark, d):
    """What is known of all classes of a row, without a row for each."""
    folds = metrics.class_folds(*classified(spark, d))
    return folds.select("row_id", "class_id", F.round("top", 6).alias("top"), F.round("log_total", 6).alias("log_total"), "label", F.round("own", 6).alias("own"))


def _with(pair: tuple[DataFrame, DataFrame], metric: str) -> tuple[DataFrame, str, DataFrame]:
    return pair[0], metric, pair[1]


_AUC = "({r} - {p} * ({p} + 1) / 2) / ({p} * {n})"


@query(f"""WITH l AS (SELECT n_chars::DOUBLE AS score, toxic FROM labels JOIN documents USING (doc_id)),
k AS (SELECT toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM l),
a AS (SELECT sum(toxic)::DOUBLE AS p, sum(1 - toxic)::DOUBLE AS n, sum(CASE WHEN toxic = 1 THEN r END)::DOUBLE AS r FROM k)
SELECT round({_AUC.format(r='r', p='p', n='n')}, 6) AS auroc FROM a""")
def metric_auroc(spark, d):
    rows = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.lit(1).alias("k"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("positive"))
    return metrics.auroc(rows, ["k"]).select(F.round("auroc", 6).alias("auroc"))


@query(f"""WITH {_SCORES}, z AS (SELECT row_id, label, class_id, CASE WHEN bool_and(score BETWEEN 0 AND 1) OVER () THEN score ELSE score - ln(sum(exp(score)) OVER (PARTITION BY row_id)) END AS p FROM s),
k AS (SELECT class_id, (class_id = label)::INT AS pos, rank() OVER (PARTITION BY class_id ORDER BY p) + (count(*) OVER (PARTITION BY class_id, p) - 1) / 2.0 AS r FROM z),
a AS (SELECT class_id, sum(pos)::DOUBLE AS p, sum(1 - pos)::DOUBLE AS n, sum(CASE WHEN pos = 1 THEN r END)::DOUBLE AS r FROM k GROUP BY 1)
SELECT round(avg({_AUC.format(r='r', p='p', n='n')}), 5) AS auroc FROM a WHERE p > 0 AND n > 0""")
def metric_auroc_multiclass(spark, d):
    return metrics.compute(*_with(scores(spark, d), "retrieval_auroc")).select(F.round("auroc", 5).alias("auroc"))


@query(f"WITH {_RAW}, z AS (SELECT row_id, max(CASE WHEN class_id = label THEN score END) - ln(sum(exp(score))) AS v FROM s GROUP BY 1) SELECT round(avg(v), 6) AS logloss FROM z")
def metric_logloss(spark, d):
    return metrics.compute_folded(*classified(spark, d), "retrieval_logloss").select(F.round("logloss", 6).alias("logloss"))


@query(f"WITH {_SCORES}, z AS (SELECT row_id, max(CASE WHEN class_id = label THEN score END) - ln(sum(exp(score))) AS v FROM s GROUP BY 1) SELECT round(-avg(v), 6) AS loss FROM z")
def loss_cross_entropy(spark, d):
    return metrics.cross_entropy(*scores(spark, d)).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_PROTO} SELECT vec_id, round(1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 6) AS loss FROM e JOIN proto ON label = class_id")
def loss_cosine(spark, d):
    e = read_table(spark, d, "embeddings")
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(64)]
    proto = e.groupBy("label").agg(*means).select("label", F.array(*[f"m{i}" for i in range(64)]).alias("c"))
    return e.join(proto, "label").select("vec_id", F.round(1 - scalar.cosine(F.col("embedding"), F.col("c")), 6).alias("loss"))


_EPOCHS = "m AS (SELECT c_nationkey AS task, c_custkey % 7 AS epoch, round(avg(c_acctbal) / 1000) AS value FROM customer GROUP BY 1, 2)"


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("task"), (F.col("c_custkey") % 7).alias("epoch")).agg(F.round(F.avg("c_acctbal") / 1000).alias("value"))


@query(f"WITH {_EPOCHS} SELECT task, first(epoch ORDER BY value DESC, epoch) AS epoch, max(value) AS value FROM m GROUP BY 1")
def best_epoch(spark, d):
    return metrics.best_epoch(_epochs(spark, d), ["task"])


@query(f"WITH {_EPOCHS} SELECT round(avg(value), 6) AS average FROM m")
def metric_average(spark, d):
    return metrics.metric_average(_epochs(spark, d)).select(F.round("average", 6).alias("average"))


# Merge

_HALVES = "a AS (SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation WHERE n_regionkey <= 2), b AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS v, n_regionkey AS r FROM nation WHERE n_regionkey >= 1)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), F.col("n_regionkey").alias("r"))
    return n.where("r <= 2"), n.where("r >= 1").withColumn("v", F.when(F.col("r") == 2, F.lower("v")).otherwise(F.col("v")))


@query(f"WITH {_HALVES} SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v, coalesce(b.r, a.r) AS r FROM a FULL JOIN b ON a.k = b.k")
def dataset_merge(spark, d):
    return merge.merge(*_halves(spark, d), ["k"])


@query(f"WITH {_HALVES} SELECT a.k, 'v' AS \"column\", a.v AS left, b.v AS right FROM a JOIN b ON a.k = b.k WHERE a.v <> b.v")
def dataset_merge_conflicts(spark, d):
    return merge.conflicts(*_halves(spark, d), ["k"], ["v", "r"])


@query("SELECT vec_id AS name, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE * 0.25))), 6) AS gap FROM embeddings")
def vector_gap(spark, d):
    a = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("emb"))
    b = a.withColumn("emb", F.transform("emb", lambda x: x * 1.25))
    return merge.vector_gap(a, b).withColumn("gap", F.round("gap", 6))


@query("SELECT vec_id AS name, label FROM embeddings")
def checked_vector_union(spark, d):
    """Two overlapping dictionaries that agree: every name once."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("emb"), "label")
    return merge.checked_union(e.where("label <= 6"), e.where("label >= 4")).select("name", "label")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return sampled_customer_summary(spark, d)


