"""The named queries of the engine and their oracle SQL; each runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.functions import linalg, machines, scalars
from heddle.operators import bitmaps, keyed, relational, sortedtable, webgraph
from heddle.session import shared_dir, shared_uri
from heddle.sources import mirror, text
from heddle.sources.tables import load

QUERIES: dict = {}
ORACLES: dict = {}
R = relational


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def scratch(spark, name: str) -> str:
    """A new folder where driver and executors both write."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))


# Scans, projections, predicates, sorts and limits


@query("flagship_topk", "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus FROM orders ORDER BY k DESC LIMIT 5")
def flagship_topk(spark, sf_dir):
    return R.top(keyed_orders(spark, sf_dir), ["k"], 5, descending=True).select("k", "o_orderstatus")


@query("scan_table", "SELECT * FROM nation")
def scan_table(spark, sf_dir):
    return load(spark, sf_dir, "nation")


KINDS = ("calm", "dark", "fast", "loud", "odd")
LITERAL = """SELECT CAST(n AS VARCHAR) AS id, 'Item ' || (n * 7) % 298 || ' of ' || n AS title,
  list_reduce(list_transform(range(1 + n % 3), lambda i: ['calm', 'dark', 'fast', 'loud', 'odd'][1 + (n + 2 * i) % 5]), lambda a, b: a || '|' || b) AS kinds
  FROM (SELECT range AS n FROM range(1, 299))"""


def literal_rows():
    """298 records with a string id, a title and one to three kinds in one column."""
    return [(str(n), f"Item {n * 7 % 298} of {n}", "|".join(KINDS[(n + 2 * i) % 5] for i in range(1 + n % 3))) for n in range(1, 299)]


@query("scan_literal", LITERAL)
def scan_literal(spark, sf_dir):
    return text.literal(spark, literal_rows(), "id string, title string, kinds string")


@query("explode_kinds", "SELECT id, unnest(string_split(kinds, '|')) AS kind FROM (" + LITERAL + ")")
def explode_kinds(spark, sf_dir):
    """The packed multi-valued column as rows."""
    return scan_literal(spark, sf_dir).select("id", F.explode(F.split("kinds", r"\|")).alias("kind"))


@query("shuffle_order", "SELECT c_custkey, row_number() OVER (ORDER BY md5('shuffle:' || c_custkey), c_custkey) AS place FROM customer")
def shuffle_order(spark, sf_dir):
    """A seeded random order with places, by key prefixes so that no task sorts everything."""
    return relational.shuffled(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "shuffle", "place")


@query("project_reorder", "SELECT o_totalprice AS price, o_orderkey AS k, o_totalprice AS price_again FROM orders")
def project_reorder(spark, sf_dir):
    return R.project(load(spark, sf_dir, "orders"), [3, 0, 3], ["price", "k", "price_again"])


for _op, _name in (("=", "filter_eq"), (">", "filter_gt"), ("<", "filter_lt")):
    query(_name, f"SELECT CAST(o_orderkey AS VARCHAR) AS k, o_custkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) {_op} '200'")(
        lambda spark, sf_dir, op=_op: R.where(keyed_orders(spark, sf_dir), "k", op, "200").select("k", "o_custkey")
    )


@query("sort_multi", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 100")
def sort_multi(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return R.top(df, ["l_shipdate", "l_orderkey", "l_linenumber"], 100, descending=True)


@query("limit_after_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def limit_after_sort(spark, sf_dir):
    return R.top(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 10)


# Keyed tables


@query("oc_put_upsert", "SELECT o_custkey, last.o_orderkey AS o_orderkey, last.o_totalprice AS o_totalprice, inserted_at FROM (SELECT o_custkey, arg_max({'o_orderkey': o_orderkey, 'o_totalprice': o_totalprice}, o_orderkey) AS last, min(o_orderkey) AS inserted_at FROM orders GROUP BY o_custkey)")
def oc_put_upsert(spark, sf_dir):
    return keyed.upsert(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("oc_put_flags", "SELECT o_custkey, o_orderkey, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS inserted FROM orders")
def oc_put_flags(spark, sf_dir):
    return keyed.put_flags(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("oc_get", "SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000042'")
def oc_get(spark, sf_dir):
    return keyed.get(load(spark, sf_dir, "customer"), "c_name", "Customer#000000042").select("c_name", "c_mktsegment")


@query("oc_delete", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)")
def oc_delete(spark, sf_dir):
    """Customers without those who placed an order with a key divisible by three."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    gone = load(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return keyed.delete(customers, gone, "c_custkey")


@query("oc_delete_flags", "SELECT DISTINCT 2 * o_custkey AS c_custkey, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = 2 * o_custkey) AS existed FROM orders")
def oc_delete_flags(spark, sf_dir):
    """Requests to delete twice the key of each customer with orders, half of which no customer has."""
    gone = load(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("c_custkey"))
    return keyed.delete_flags(load(spark, sf_dir, "customer"), gone, "c_custkey")


@query("oc_range_scan", "SELECT c_name, c_mktsegment FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000200' ORDER BY c_name")
def oc_range_scan(spark, sf_dir):
    return keyed.range_scan(load(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), "c_name", "Customer#000000100", "Customer#000000200")


@query("oc_workload", "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_totalprice FROM orders WHERE o_orderkey % 2 = 1 AND CAST(o_orderkey AS VARCHAR) BETWEEN '1' AND '5' ORDER BY k")
def oc_workload(spark, sf_dir):
    """Put every order by its key as a string, delete every second key, scan a range."""
    table = keyed.upsert(keyed_orders(spark, sf_dir).select("k", "o_orderkey", "o_totalprice"), "k", "o_orderkey")
    rest = keyed.delete(table, table.filter("o_orderkey % 2 = 0").select("k"), "k")
    return keyed.range_scan(rest.select("k", "o_totalprice"), "k", "1", "5")


@query("range_count", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderkey AS VARCHAR) BETWEEN '3' AND '4'")
def range_count(spark, sf_dir):
    return keyed_orders(spark, sf_dir).filter(F.col("k").between("3", "4")).agg(F.count("*").alias("n"))


@query("min_max_key", "SELECT min(CAST(o_orderkey AS VARCHAR)) AS first_key, max(CAST(o_orderkey AS VARCHAR)) AS last_key FROM orders")
def min_max_key(spark, sf_dir):
    return keyed_orders(spark, sf_dir).agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query("string_compare", "SELECT c_custkey, CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END AS ordering FROM customer")
def string_compare(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", keyed.compare(F.col("c_name"), F.col("c_mktsegment")).alias("ordering"))


@query("probe_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def probe_semi(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("probe_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderkey % 5 = 0)")
def probe_anti(spark, sf_dir):
    some = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_orderkey % 5 = 0")
    return load(spark, sf_dir, "customer").select("c_custkey").join(some, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def _asof(spark, sf_dir, backward):
    probes = load(spark, sf_dir, "events").select("event_id", "ts")
    keys = load(spark, sf_dir, "orders").select("o_orderdate")
    return keyed.asof(probes, keys, "ts", "o_orderdate", backward, lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")))


@query("asof_nulls", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts END AS at, (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= CASE WHEN event_id % 3 > 0 THEN ts END) AS match FROM events")
def asof_nulls(spark, sf_dir):
    """Every third probe without a value: kept, without a match."""
    probes = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("at"))
    return keyed.asof(probes, load(spark, sf_dir, "orders").select("o_orderdate"), "at", "o_orderdate", True, lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")))


query("asof_floor", "SELECT event_id, ts, (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= ts) AS match FROM events")(lambda s, d: _asof(s, d, True))
query("asof_ceiling", "SELECT event_id, ts, (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= ts) AS match FROM events")(lambda s, d: _asof(s, d, False))

# Sorted tables


def items(spark, sf_dir):
    """Customers as items; one table covers the keys that share all but three digits."""
    return load(spark, sf_dir, "customer").select(
        F.substring("c_name", 1, 15).alias("tbl"), F.col("c_name").alias("k"), F.col("c_mktsegment").alias("v"), sortedtable.item_size(F.col("c_name"), F.col("c_mktsegment")).alias("size")
    )


ITEMS = "SELECT substr(c_name, 1, 15) AS tbl, c_name AS k, c_mktsegment AS v, CAST(8 + octet_length(encode(c_name)) + octet_length(encode(c_mktsegment)) AS INTEGER) AS size FROM customer"
FOLD = f"""
WITH RECURSIVE items AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY k) AS rn FROM ({ITEMS})),
fold AS (
  SELECT tbl, k, size, rn, 0 AS block, size AS filled FROM items WHERE rn = 1
  UNION ALL
  SELECT i.tbl, i.k, i.size, i.rn, CASE WHEN f.filled > 4000 THEN f.block + 1 ELSE f.block END,
         CASE WHEN f.filled > 4000 THEN i.size ELSE f.filled + i.size END
  FROM fold f JOIN items i ON i.tbl = f.tbl AND i.rn = f.rn + 1)
"""


@query("sstable_block_packing", FOLD + "SELECT tbl, k, size, block FROM fold")
def sstable_block_packing(spark, sf_dir):
    return sortedtable.pack_blocks(items(spark, sf_dir), "tbl", "k", "size")


@query("sstable_build_blocks", FOLD + "SELECT tbl, block, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY tbl, block")
def sstable_build_blocks(spark, sf_dir):
    return sortedtable.block_index(sstable_block_packing(spark, sf_dir), "tbl", "k", "size").select("tbl", "block", "items", "bytes")


@query("sstable_block_index", FOLD + "SELECT tbl, block, min(k) AS start_key, max(k) AS end_key FROM fold GROUP BY tbl, block")
def sstable_block_index(spark, sf_dir):
    return sortedtable.block_index(sstable_block_packing(spark, sf_dir), "tbl", "k", "size").select("tbl", "block", "start_key", "end_key")


@query("sstable_block_offsets", FOLD + "SELECT tbl, block, max(k) AS end_key, CAST(coalesce(sum(sum(size)) OVER (PARTITION BY tbl ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM fold GROUP BY tbl, block")
def sstable_block_offsets(spark, sf_dir):
    index = sortedtable.block_index(sstable_block_packing(spark, sf_dir), "tbl", "k", "size")
    return sortedtable.block_offsets(index, "tbl").select("tbl", "block", "end_key", "offset")


def sorted_customers(spark, sf_dir):
    path = scratch(spark, "sorted-customer")
    sortedtable.write_sorted(load(spark, sf_dir, "customer"), "c_name", path)
    return spark.read.parquet(path)


@query("sstable_scan", "SELECT * FROM customer")
def sstable_scan(spark, sf_dir):
    return sorted_customers(spark, sf_dir)


@query("sstable_point_get", "SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000777'")
def sstable_point_get(spark, sf_dir):
    return keyed.get(sorted_customers(spark, sf_dir), "c_name", "Customer#000000777").select("c_name", "c_mktsegment")


@query("sstable_point_miss", "SELECT c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000777x'")
def sstable_point_miss(spark, sf_dir):
    return keyed.get(sorted_customers(spark, sf_dir), "c_name", "Customer#000000777x").select("c_name", "c_mktsegment")


@query("sstable_range_scan", "SELECT c_name, c_mktsegment FROM customer WHERE c_name BETWEEN 'Customer#000000050' AND 'Customer#000000150' ORDER BY c_name")
def sstable_range_scan(spark, sf_dir):
    return keyed.range_scan(sorted_customers(spark, sf_dir).select("c_name", "c_mktsegment"), "c_name", "Customer#000000050", "Customer#000000150")


# Bloom filters


@query("bloom_params", "SELECT o_custkey, ((greatest(count(*) * 10, 64) + 63) // 64) * 64 AS n_bits, ((greatest(count(*) * 10, 64) + 63) // 64) * 8 AS n_bytes, 6 AS n_hashes FROM orders GROUP BY o_custkey")
def bloom_params(spark, sf_dir):
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.select("o_custkey", sortedtable.bloom_bits(F.col("n")).alias("n_bits"), sortedtable.bloom_bytes(F.col("n")).alias("n_bytes"), F.lit(sortedtable.bloom_hashes()).alias("n_hashes"))


BLOOM_BITS = 1 << 20


def _fnv(column: str) -> str:
    return f"""list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, 2 * octet_length(encode({column})), 2), lambda i: CAST('0x' || substr(hex(encode({column})), i, 2) AS HUGEINT))),
      lambda h, b: xor((h * 1099511628211) % 18446744073709551616, b))"""


def _positions(source: str) -> str:
    return f"""SELECT k, CAST(i AS INTEGER) AS i, CAST((h % 4294967296 + i * (h // 4294967296)) % {BLOOM_BITS} AS BIGINT) AS position
      FROM (SELECT k, {_fnv("k")} AS h FROM ({source})), range(6) t(i)"""


@query("bloom_bit_positions", _positions("SELECT c_name AS k FROM customer"))
def bloom_bit_positions(spark, sf_dir):
    keys = load(spark, sf_dir, "customer").select(F.col("c_name").alias("k"))
    return sortedtable.bloom_positions(keys, "k", F.lit(BLOOM_BITS), sortedtable.bloom_hashes())


@query("bloom_build", f"SELECT DISTINCT position FROM ({_positions('SELECT c_name AS k FROM customer')})")
def bloom_build(spark, sf_dir):
    return bloom_bit_positions(spark, sf_dir).select("position").distinct()


PROBES = "SELECT c_name AS k FROM customer UNION SELECT s_name FROM supplier"


@query("bloom_maybe_contains", f"WITH built AS (SELECT DISTINCT position FROM ({_positions('SELECT c_name AS k FROM customer')})), probed AS ({_positions(PROBES)}) SELECT k, count(b.position) = 6 AS maybe FROM probed p LEFT JOIN built b ON p.position = b.position GROUP BY k")
def bloom_maybe_contains(spark, sf_dir):
    """Stored keys and strangers against the filter; true for every stored key."""
    probes = load(spark, sf_dir, "customer").select(F.col("c_name").alias("k")).union(load(spark, sf_dir, "supplier").select("s_name")).distinct()
    probed = sortedtable.bloom_positions(probes, "k", F.lit(BLOOM_BITS), sortedtable.bloom_hashes())
    built = bloom_build(spark, sf_dir).withColumnRenamed("position", "set_position")
    hits = probed.join(built, F.col("position") == F.col("set_position"), "left")
    return hits.groupBy("k").agg((F.count("set_position") == sortedtable.bloom_hashes()).alias("maybe"))


# Bitmaps


@query("bitmap_build", "SELECT CASE WHEN o_custkey > 0 THEN 1 + (o_custkey - 1) // 32768 ELSE 0 END AS bucket, count(DISTINCT o_custkey) AS members FROM orders GROUP BY 1")
def bitmap_build(spark, sf_dir):
    return bitmaps.cardinality(bitmaps.build(load(spark, sf_dir, "orders"), "o_custkey"))


@query("bitmap_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS member FROM customer")
def bitmap_membership(spark, sf_dir):
    """Each customer key against the bitmap of ordered keys, by bucket."""
    built = bitmaps.build(load(spark, sf_dir, "orders"), "o_custkey")
    probes = load(spark, sf_dir, "customer").select("c_custkey", F.bitmap_bucket_number("c_custkey").alias("bucket"), F.bitmap_bit_position("c_custkey").alias("at"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col("at") % 8).cast("int")) == 1
    return probes.join(built, "bucket", "left").select("c_custkey", F.coalesce(bit, F.lit(False)).alias("member"))


def _nations(spark, sf_dir):
    return bitmaps.build(load(spark, sf_dir, "customer"), "c_nationkey"), bitmaps.build(load(spark, sf_dir, "supplier"), "s_nationkey")


@query("bitmap_union", "SELECT CAST(CASE WHEN k > 0 THEN 1 + (k - 1) // 32768 ELSE 0 END AS BIGINT) AS bucket, count(*) AS members FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) GROUP BY 1")
def bitmap_union(spark, sf_dir):
    return bitmaps.cardinality(bitmaps.union(*_nations(spark, sf_dir)))


@query("bitmap_intersect", "SELECT CAST(CASE WHEN k > 0 THEN 1 + (k - 1) // 32768 ELSE 0 END AS BIGINT) AS bucket, count(*) AS members FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) GROUP BY 1")
def bitmap_intersect(spark, sf_dir):
    return bitmaps.cardinality(bitmaps.intersect(*_nations(spark, sf_dir)))


@query("roaring_containers", "SELECT x >> 16 AS bucket, count(*) AS entries, min(x & 65535) AS low, max(x & 65535) AS high, CASE WHEN count(*) > 4096 THEN 'bitmap' ELSE 'array' END AS kind FROM (SELECT DISTINCT l_orderkey * 7 AS x FROM lineitem) GROUP BY 1")
def roaring_containers(spark, sf_dir):
    return bitmaps.containers(load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7).alias("x")), "x")


WAH = """
WITH grouped AS (SELECT v // 31 AS grp, bit_or(CAST(1 AS BIGINT) << CAST(v % 31 AS INTEGER)) AS word FROM (SELECT CAST(floor(o_totalprice / 10) AS BIGINT) AS v FROM orders UNION SELECT p_partkey + 100000 FROM part) GROUP BY 1),
marked AS (SELECT *, CASE WHEN word = 2147483647 THEN 'fill1' ELSE 'literal' END AS kind, coalesce(lag(grp) OVER (ORDER BY grp) + 1, 0) AS before FROM grouped),
ones AS (SELECT grp, grp - row_number() OVER (ORDER BY grp) AS island FROM marked WHERE kind = 'fill1')
"""


def _runs(spark, sf_dir):
    """Order totals in tens, and part keys above them: gaps, literals and dense stretches."""
    values = load(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 10).alias("x")).union(load(spark, sf_dir, "part").select(F.col("p_partkey") + 100000))
    return bitmaps.runs(bitmaps.groups(values, "x"))


@query("wah_rle_runs", WAH + """SELECT 'fill0' AS kind, before AS start, grp - before AS length, CAST(0 AS BIGINT) AS word FROM marked WHERE grp > before
UNION ALL SELECT 'fill1', min(grp), count(*), CAST(2147483647 AS BIGINT) FROM ones GROUP BY island
UNION ALL SELECT kind, grp, CAST(1 AS BIGINT), word FROM marked WHERE kind = 'literal'""")
def wah_rle_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query("wah_rle_roundtrip", "SELECT CAST(floor(o_totalprice / 10) AS BIGINT) AS x FROM orders UNION SELECT p_partkey + 100000 FROM part")
def wah_rle_roundtrip(spark, sf_dir):
    return bitmaps.decode(_runs(spark, sf_dir))


@query("wah64_rle_roundtrip", "SELECT CAST(floor(o_totalprice / 10) AS BIGINT) AS x FROM orders UNION SELECT p_partkey + 100000 FROM part")
def wah64_rle_roundtrip(spark, sf_dir):
    """The same with groups of 63 bits."""
    values = load(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 10).alias("x")).union(load(spark, sf_dir, "part").select(F.col("p_partkey") + 100000))
    return bitmaps.decode(bitmaps.runs(bitmaps.groups(values, "x", 63), 63), 63)


# Pages and links


@query("pages_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def pages_scan(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


LINKS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages"""
NORMAL = """CASE WHEN starts_with(link, 'https') THEN link WHEN starts_with(link, 'http') THEN 'https' || substr(link, 5)
  WHEN starts_with(link, '//') THEN 'https:' || link WHEN starts_with(link, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || link
  ELSE rtrim(url, '/') || '/' || ltrim(link, '/') END"""


def _links(spark, sf_dir):
    return webgraph.links(load(spark, sf_dir, "pages"))


def _absolute(spark, sf_dir):
    found = _links(spark, sf_dir)
    return found.withColumn("target", webgraph.absolute(F.col("link"), F.col("url"), webgraph.site(F.col("url"))))


@query("page_links", f"SELECT page_id, link FROM ({LINKS})")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "link")


@query("url_normalize", f"SELECT page_id, link, {NORMAL} AS target FROM ({LINKS})")
def url_normalize(spark, sf_dir):
    return _absolute(spark, sf_dir).select("page_id", "link", "target")


@query("url_filter_ext", f"SELECT page_id, target FROM (SELECT page_id, {NORMAL} AS target FROM ({LINKS})) WHERE regexp_extract(target, '(\\.[^./]*)$', 1) = '' OR contains(regexp_extract(target, '(\\.[^./]*)$', 1), '.html')")
def url_filter_ext(spark, sf_dir):
    return _absolute(spark, sf_dir).filter(webgraph.followed(F.col("target"))).select("page_id", "target")


def _mirror_sql(url: str) -> str:
    local = f"'/mirror' || substr({url}, length(regexp_extract({url}, '^(https?://[^/]+)', 1)) + 1)"
    return f"'file:///' || rtrim(split_part({local}, '#', 1), '/') || '/index.html' || regexp_extract({local}, '(#.*)$', 1)"


def _mirrored(df, column):
    return df.withColumn("base", webgraph.site(F.col(column))).withColumn("mirror", webgraph.mirror_path(F.col(column), F.col("base"), "/mirror"))


@query("mirror_path", f"SELECT page_id, {_mirror_sql('url')} AS mirror FROM pages")
def mirror_path(spark, sf_dir):
    return _mirrored(load(spark, sf_dir, "pages"), "url").select("page_id", "mirror")


# Every link of a page as it is, and so changed that it leads elsewhere: off-site, to a file, with https, with two fragments.
VARIED = f"""SELECT page_id, url, unnest([link, 'https://other.example' || link, 'http://other.example' || link, '//other.example' || link, link || '.png', link || '#a', link || '#a#b',
  'http://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || link, 'sub' || link]) AS link FROM ({LINKS})"""
HOST = "lower(regexp_extract({}, '^https?://([^/?#]+)', 1))"


@query("link_rewrite", f"""SELECT page_id, link, CASE WHEN starts_with(link, 'https') THEN link
  WHEN regexp_extract(target, '(\\.[^./]*)$', 1) <> '' AND NOT contains(regexp_extract(target, '(\\.[^./]*)$', 1), '.html') THEN target
  WHEN {HOST.format('target')} <> {HOST.format('url')} THEN target
  WHEN len(string_split(target, '#')) > 2 THEN NULL ELSE {_mirror_sql('target')} END AS mirror
  FROM (SELECT page_id, url, link, {NORMAL} AS target FROM ({VARIED}))""")
def link_rewrite(spark, sf_dir):
    """Links of pages as their mirror has them: links into it, kept https links, absolute links to files and other sites."""
    link, host = F.col("link"), F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    other = [F.concat(F.lit(x), link) for x in ("https://other.example", "http://other.example", "//other.example")]
    varied = [link, *other, *(F.concat(link, F.lit(x)) for x in (".png", "#a", "#a#b")), F.concat(F.lit("http://"), host, link), F.concat(F.lit("sub"), link)]
    links = _links(spark, sf_dir).select("page_id", "url", F.explode(F.array(*varied)).alias("link"))
    return links.select("page_id", "link", webgraph.rewritten(F.col("link"), F.col("url"), "/mirror").alias("mirror"))


@query("crawl_frontier", f"SELECT DISTINCT {NORMAL} AS target FROM ({LINKS}) EXCEPT SELECT url FROM pages")
def crawl_frontier(spark, sf_dir):
    seen = load(spark, sf_dir, "pages").select(F.col("url").alias("target"))
    return _absolute(spark, sf_dir).select("target").distinct().join(seen, "target", "left_anti")


@query("crawl_reachable", "WITH RECURSIVE size AS (SELECT max(o_custkey) AS n FROM orders), edges AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % n + 1 AS dst FROM orders, size), seen(node) AS (SELECT min(o_custkey) FROM orders UNION SELECT dst FROM edges JOIN seen ON src = node) SELECT node FROM seen")
def crawl_reachable(spark, sf_dir):
    """The crawl loop on a graph of customers: an order links its customer to the one its number points to."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    size = orders.agg(F.max("o_custkey").alias("n"))
    edges = orders.join(F.broadcast(size)).select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % F.col("n") + 1).alias("dst"))  # one row
    return webgraph.reachable(edges, orders.agg(F.min("o_custkey").alias("node"))).select("node")


# Matrices, numbers and machines


@query("matmul", "WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 6) AS v FROM cells a JOIN cells b USING (vec_id) GROUP BY a.i, b.i")
def matmul(spark, sf_dir):
    """The transposed embedding matrix times the matrix."""
    m = linalg.cells(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return linalg.matmul(linalg.transpose(m), m).select("i", "j", F.round("v", 6).alias("v"))


@query("transpose", "SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, vec_id AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def transpose(spark, sf_dir):
    return linalg.transpose(linalg.cells(load(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query("matrix_index", "SELECT vec_id, CAST(embedding[3 * 16 + 5 + 1] AS DOUBLE) AS v FROM embeddings")
def matrix_index(spark, sf_dir):
    """Each embedding as four rows of sixteen: the element at row 3, column 5."""
    return load(spark, sf_dir, "embeddings").select("vec_id", linalg.element(F.col("embedding"), 16, F.lit(3), F.lit(5)).cast("double").alias("v"))


@query("matrix_equal", "SELECT 'transposed twice' AS pair, bool_and(embedding = embedding) AS equal FROM embeddings UNION ALL SELECT 'least vector halved', bool_and(CASE WHEN vec_id = (SELECT min(vec_id) FROM embeddings) THEN list_transform(embedding, lambda x: x / 2) ELSE embedding END = embedding) FROM embeddings")
def matrix_equal(spark, sf_dir):
    """A matrix against itself transposed twice, and against itself with one row changed."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = linalg.cells(rows, "vec_id", "embedding")
    least = rows.agg(F.min("vec_id").alias("least"))
    changed = rows.join(F.broadcast(least)).select("vec_id", F.when(F.col("vec_id") == F.col("least"), F.transform("embedding", lambda x: x / 2)).otherwise(F.col("embedding").cast("array<double>")).alias("embedding"))  # one row
    pair = lambda name, other: linalg.equal(m, other).select(F.lit(name).alias("pair"), "equal")
    return pair("transposed twice", linalg.transpose(linalg.transpose(m))).union(pair("least vector halved", linalg.cells(changed, "vec_id", "embedding")))


@query("grid_fill", "SELECT a.range AS i, b.range AS j, a.range + b.range AS v FROM range(100) a, range(100) b")
def grid_fill(spark, sf_dir):
    cells = spark.range(100 * 100).select((F.col("id") / 100).cast("long").alias("i"), (F.col("id") % 100).alias("j"))
    return cells.withColumn("v", F.col("i") + F.col("j"))


FIBONACCI = "WITH RECURSIVE fib(n, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM fib WHERE n < 40) SELECT n, a AS value FROM fib"


@query("fibonacci", FIBONACCI)
def fibonacci(spark, sf_dir):
    return spark.range(41).select(F.col("id").cast("int").alias("n"), scalars.fibonacci(F.col("id")).alias("value"))


@query("cone_volume", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity * l_tax * 1.0471975512, 6) AS volume FROM lineitem")
def cone_volume(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.cone_volume(F.col("l_quantity"), F.col("l_tax")), 6).alias("volume"))


@query("vm_add_wrap", "SELECT o_orderkey, ((o_orderkey & 255) + (o_custkey & 255)) & 255 AS wrapped FROM orders")
def vm_add_wrap(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.wrap(scalars.wrap(F.col("o_orderkey"), 8) + scalars.wrap(F.col("o_custkey"), 8), 8).alias("wrapped"))


@query("vm_sub_wrap", "SELECT o_orderkey, ((o_orderkey & 255) - (o_custkey & 255)) & 255 AS wrapped FROM orders")
def vm_sub_wrap(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.wrap(scalars.wrap(F.col("o_orderkey"), 8) - scalars.wrap(F.col("o_custkey"), 8), 8).alias("wrapped"))


@query("vm_sum_to_n", "SELECT p_partkey, CAST((p_size * (p_size + 1) // 2) % 256 AS BIGINT) AS total FROM part")
def vm_sum_to_n(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scalars.sum_to_n(F.col("p_size")).alias("total"))


@query("vm_word16", "SELECT o_orderkey, (o_orderkey * 3 - o_custkey) & 65535 AS word FROM orders")
def vm_word16(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.wrap(F.col("o_orderkey") * 3 - F.col("o_custkey"), 16).alias("word"))


# Counts up in cell 4 and adds the counter to cell 3 until the counter is the input.
REGISTER_SUM = """
load r1 1
beqz r1 29
load r1 4
addi r1 1
store r1 4
load r2 3
add r2 r1
store r2 3
load r2 1
sub r2 r1
beqz r2 2
jump 14
load r1 3
store r1 0
halt"""
STACK_SUM = "push 1\nbeqz 14\npush 2\nadd\nstore 2\npushi 1\npush 1\nsub\nstore 1\njump 8\npush 2\nstore 0\nhalt"


def _machine(program, ops, run):
    answer = machines.machine_column(machines.assemble(program, ops), run)
    return lambda spark, sf_dir: load(spark, sf_dir, "part").select("p_partkey", answer(F.col("p_size").cast("long"), F.lit(0).cast("long")).alias("answer"))


SUM_SQL = "SELECT p_partkey, CAST((p_size * (p_size + 1) // 2) % 256 AS INTEGER) AS answer FROM part"
query("vm_register_program", SUM_SQL)(_machine(REGISTER_SUM, machines.REGISTER_OPS, machines.run_register))
query("vm_stack_program", SUM_SQL)(_machine(STACK_SUM, machines.STACK_OPS, machines.run_stack))

WORD_SUM = bytes([machines.WORD_LOAD, 1, 64, machines.WORD_LOAD, 2, 66, machines.WORD_ADD, 1, 2, machines.WORD_ADD | 16, 1, 7, machines.WORD_SUB, 1, 2, machines.WORD_STORE, 1, 68, machines.WORD_HALT])


@query("vm_word_program", "SELECT o_orderkey, CAST((o_orderkey + 7) & 65535 AS INTEGER) AS answer FROM orders")
def vm_word_program(spark, sf_dir):
    """The 16-bit machine: loads two words, adds, adds 7, subtracts, stores."""
    answer = machines.word_column(WORD_SUM, (64, 66), 68)
    return load(spark, sf_dir, "orders").select("o_orderkey", answer(F.col("o_orderkey"), F.col("o_custkey")).alias("answer"))


# Arrays, maps, text, encodings


def _per_customer(spark, sf_dir):
    """Orders of a customer as a map of order key to days since 1992, and as an array of order keys."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("days"))
    grouped = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "days")).alias("entries"))
    return grouped.select("o_custkey", F.map_from_entries("entries").alias("m"), F.transform("entries", lambda e: e["o_orderkey"]).alias("a"))


@query("array_sum", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def array_sum(spark, sf_dir):
    return _per_customer(spark, sf_dir).select("o_custkey", scalars.array_sum(F.col("a")).alias("total"))


@query("map_sum_kv", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, CAST(sum(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS value_sum FROM orders GROUP BY o_custkey")
def map_sum_kv(spark, sf_dir):
    return _per_customer(spark, sf_dir).select("o_custkey", scalars.array_sum(F.map_keys("m")).alias("key_sum"), scalars.array_sum(F.map_values("m")).alias("value_sum"))


@query("map_size", "SELECT o_custkey, CAST(count(*) AS INTEGER) AS entries FROM orders GROUP BY o_custkey")
def map_size(spark, sf_dir):
    return _per_customer(spark, sf_dir).select("o_custkey", F.size("m").alias("entries"))


@query("pangram", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]'))) = 26 AS pangram FROM documents")
def pangram(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalars.pangram(F.col("text")).alias("pangram"))


@query("str_octet_length", "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents")
def str_octet_length(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"))


def _tabbed(spark, sf_dir):
    """Table rows as tab-separated lines."""
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.lit("end")).alias("line"))


@query("str_detab", "SELECT c_custkey, list_reduce([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, 'end'], lambda a, x: rpad(a, CAST(8 * (length(a) // 8 + 1) AS INTEGER), ' ') || x) AS line FROM customer")
def str_detab(spark, sf_dir):
    return _tabbed(spark, sf_dir).select("c_custkey", scalars.detab(F.col("line")).alias("line"))


@query("str_entab", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || chr(9) || c_name || CASE WHEN length(c_name) % 8 = 7 THEN ' ' ELSE chr(9) END || c_mktsegment || CASE WHEN length(c_mktsegment) % 8 = 7 THEN ' ' ELSE chr(9) END || 'end' AS line FROM customer")
def str_entab(spark, sf_dir):
    """The inverse: lines with blanks up to the next stop, back to tabs; a stop one column away stays a blank."""
    return _tabbed(spark, sf_dir).select("c_custkey", scalars.entab(scalars.detab(F.col("line"))).alias("line"))


@query("hex_bin_conv", "SELECT p_partkey, hex(p_partkey) AS as_hex, bin(p_partkey) AS as_bin, CAST('0x' || hex(p_partkey) AS BIGINT) AS back FROM part")
def hex_bin_conv(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.hex("p_partkey").alias("as_hex"), F.bin("p_partkey").alias("as_bin"), F.conv(F.hex("p_partkey"), 16, 10).cast("long").alias("back"))


@query("utf8_hex", "SELECT doc_id, hex(encode(text)) AS bytes FROM documents")
def utf8_hex(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("bytes"))


@query("twos_complement", "SELECT p_partkey, ((~p_partkey) + 1) & 255 AS negated, CASE WHEN p_size + 230 > 255 THEN true ELSE false END AS overflows, CASE WHEN p_size + 2147483620 <= 2147483647 THEN CAST(p_size + 2147483620 AS INTEGER) END AS checked, -128 AS least FROM part")
def twos_complement(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scalars.negate(F.col("p_partkey"), 8).alias("negated"), (F.col("p_size") + 230 > 255).alias("overflows"),
        scalars.checked_add(F.col("p_size").cast("int"), F.lit(2147483620)).alias("checked"), F.lit(scalars.least_value(8)).alias("least"))


@query("date_weekday", "SELECT o_orderkey, dayname(o_orderdate) AS weekday FROM orders")
def date_weekday(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("weekday"))


@query("variant_int", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def variant_int(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


SHAPE = "CASE WHEN p_partkey % 2 = 0 THEN 'rect' ELSE 'circle' END"


@query("shape_measures", f"SELECT p_partkey, {SHAPE} AS kind, round(CASE {SHAPE} WHEN 'rect' THEN p_size * p_retailprice ELSE pi() * p_size * p_size END, 4) AS area, round(CASE {SHAPE} WHEN 'rect' THEN 2 * (p_size + p_retailprice) ELSE 2 * pi() * p_size END, 4) AS perimeter FROM part")
def shape_measures(spark, sf_dir):
    shapes = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "rect").otherwise("circle").alias("kind"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    args = F.col("kind"), F.col("a"), F.col("b")
    return shapes.select("p_partkey", "kind", F.round(scalars.area(*args), 4).alias("area"), F.round(scalars.perimeter(*args), 4).alias("perimeter"))


@query("float_bits", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN CAST(CAST(CAST(l_extendedprice AS DOUBLE) AS BIT) AS BIGINT) END AS bits FROM lineitem")
def float_bits(spark, sf_dir):
    """The bits of prices, and null for those left out."""
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice").cast("double"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.float_bits(price).alias("bits"))


@query("type_name", "SELECT event_id, 'map<bigint,string>' AS kind FROM events")
def type_name(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.expr("typeof(map(event_id, event_type))").alias("kind"))


# Files


@query("mirror_files", "SELECT 'page-' || page_id || '/index.html' AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def mirror_files(spark, sf_dir):
    """One file a page below a new shared folder."""
    folder = shared_uri(spark, f"mirror-{uuid.uuid4().hex}")
    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("/index.html")).alias("path"), "html")
    return mirror.write_pages(pages, folder)


def word_file(spark, sf_dir):
    """A sorted word list as one text file: the names of the first thousand customers."""
    path = scratch(spark, "words")
    R.top(load(spark, sf_dir, "customer").select("c_name").distinct(), ["c_name"], 1000).coalesce(1).write.text(path)
    return path


WORDS = "SELECT DISTINCT c_name AS word FROM customer ORDER BY word LIMIT "


@query("text_source_limit", WORDS + "100")
def text_source_limit(spark, sf_dir):
    """A word list, read with a limit on rows."""
    return text.lines(spark, word_file(spark, sf_dir), 100, "word")


@query("text_source_all", WORDS + "1000")
def text_source_all(spark, sf_dir):
    """The same without a limit."""
    return text.lines(spark, word_file(spark, sf_dir), 0, "word")


@query("text_first_line", WORDS + "1")
def text_first_line(spark, sf_dir):
    return text.first_line(spark, word_file(spark, sf_dir), "word")


@query("path_exists", "SELECT * FROM (VALUES ('orders.parquet', true), ('nowhere.parquet', false)) AS t(name, found)")
def path_exists(spark, sf_dir):
    names = ("orders.parquet", "nowhere.parquet")
    return text.literal(spark, [(n, text.exists(spark, f"{sf_dir}/{n}")) for n in names], "name string, found boolean")


@query("dir_entry_count")
def dir_entry_count(spark, sf_dir):
    return dir_listing(spark, sf_dir).agg(F.count("*").alias("entries"))


@query("dir_listing")
def dir_listing(spark, sf_dir):
    """Name and size of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(sf_dir).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"))
