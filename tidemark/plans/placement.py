"""Queries over placement, replicas, clocks, summaries and membership, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vclock
from ..operators import bloom, cluster, folds, merkle, replicas, ring, snapshot
from ..operators.maintain import drop_oldest
from ..session import table
from . import sqlhash
from .store import CRC, CRC_TABLE, LATEST

NODES = ("node-1", "node-2", "node-3")
FIVE = ("node-1", "node-2", "node-3", "node-4", "node-5")
ALIVE = ["node-1", "node-3", "node-4", "node-5"]
MAX_HINTS = 1000
CACHE_SECONDS = 86_400 * 3  # requests of the test tables come minutes apart


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "replica_log").select("key").distinct()


def ring_owner(spark, d):
    return ring.owner(_keys(spark, d), "key", ring.Ring(NODES))


def ring_preference_list(spark, d):
    return ring.place(_keys(spark, d), "key", ring.Ring(FIVE)).select("key", F.array_join("replicas", ",").alias("replicas"))


def ring_distribution(spark, d):
    return ring.shares(_keys(spark, d), "key", ring.Ring(NODES)).select("node", "n", F.round("percent", 6).alias("percent"))


def ring_key_movement(spark, d):
    before = ring.Ring(NODES)
    return ring.movement(_keys(spark, d), "key", before, before.add("node-4"))


def ring_sloppy_quorum(spark, d):
    r = ring.Ring(FIVE)
    return ring.place(_keys(spark, d), "key", r).select("key", F.array_join(ring.sloppy(F.col("replicas"), ALIVE, 3, r), ",").alias("replicas"))


def hint_fallback_pairs(spark, d):
    r = ring.Ring(FIVE)
    placed = ring.place(_keys(spark, d), "key", r).withColumn("chosen", ring.sloppy(F.col("replicas"), ALIVE, 3, r))
    return placed.select("key", F.explode(ring.hint_targets(F.col("replicas"), F.col("chosen"))).alias("p")).select("key", "p.fallback", "p.target")


def ring_vnode_ranges(spark, d):
    return ring.Ring(NODES).table(spark)


def ring_range_shares(spark, d):
    return ring.Ring(NODES).table(spark).groupBy("node").agg(F.sum("width").alias("width"), F.count(F.lit(1)).alias("vnodes"))


def ring_display_sample(spark, d):
    """Every tenth virtual node in the order of the ring, as a display would draw."""
    return snapshot.global_rank(ring.Ring(NODES).table(spark), [F.col("pos")], "i").filter("i % 10 = 0").select("pos", "node", "vnode")


def replica_fanout(spark, d):
    placed = ring.place(table(spark, d, "replica_write").filter("key <> ''").select("key"), "key", ring.Ring(FIVE))
    return ring.fan_out(placed).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


def is_primary(spark, d):
    placed = ring.place(_keys(spark, d), "key", ring.Ring(FIVE))
    return placed.select((F.col("replicas")[0] == "node-2").alias("primary")).groupBy("primary").agg(F.count(F.lit(1)).alias("n"))


def vc_increment(spark, d):
    rows = table(spark, d, "wal_record").filter(F.col("node").isNotNull())
    return rows.groupBy(vclock.text(vclock.increment(F.col("vc"), F.col("node"))).alias("clock")).agg(F.count(F.lit(1)).alias("n"))


def vc_merge(spark, d):
    return vclock.merge_all("vc", ["key"], table(spark, d, "wal_record")).select("key", vclock.text(F.col("vc")).alias("clock"))


def _clock_pairs(spark, d):
    log = table(spark, d, "replica_log").filter(F.col("version").isNotNull()).select("node", "key", "version", "vc")
    a = log.filter("node = 'node-1'").select("key", "version", F.col("vc").alias("a"))
    b = log.filter("node = 'node-2'").select("key", "version", F.col("vc").alias("b"))
    return a.join(b, ["key", "version"])


def vc_compare(spark, d):
    return _clock_pairs(spark, d).select(vclock.compare(F.col("a"), F.col("b")).alias("order")).groupBy("order").agg(F.count(F.lit(1)).alias("n"))


def vc_compare_nullable(spark, d):
    return _clock_pairs(spark, d).select(vclock.compare_nullable(F.col("a"), F.col("b")).alias("order"), vclock.is_zero(F.col("a")).alias("zero")).groupBy("order", "zero").agg(F.count(F.lit(1)).alias("n"))


def vc_siblings(spark, d):
    return replicas.siblings(table(spark, d, "replica_log"))


def quorum_read_latest(spark, d):
    return replicas.quorum_read(table(spark, d, "replica_log")).select("key", "version", F.hex("value").alias("value"), "visible", "holders")


def quorum_ack_check(spark, d):
    acks = table(spark, d, "replica_write").filter("key <> ''").select("key", F.col("target_node").isNotNull().alias("ok"))
    return replicas.ack_check(acks, 2)


def read_repair_majority(spark, d):
    return replicas.majority_repair(replicas.node_entries(table(spark, d, "replica_log")), F.hex("value"))


def repair_plan_version(spark, d):
    return replicas.repair_plan(table(spark, d, "replica_log"))


def anti_entropy_actions(spark, d):
    return replicas.sync_actions(table(spark, d, "replica_log"), "node-1", "node-2")


def keyset_difference(spark, d):
    log = table(spark, d, "replica_log")
    return replicas.missing_keys(log.filter("node = 'node-1'"), log.filter("node = 'node-2'"))


def incarnation_merge(spark, d):
    return replicas.newest_incarnation(table(spark, d, "cluster_member")).select("node", "incarnation", "state")


def membership_merge(spark, d):
    known = replicas.newest_incarnation(table(spark, d, "cluster_member"))
    met = table(spark, d, "replica_write").filter("target_node is not null").select(F.col("target_node").alias("node"))
    return replicas.merge_members(known, met, F.lit(None).cast("timestamp_ntz")).select("node", "state", "incarnation")


def liveness_states(spark, d):
    members = replicas.newest_incarnation(table(spark, d, "cluster_member")).withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    now = members.agg(F.max("last_seen")).first()[0]
    return replicas.liveness(members, F.lit(now) + F.expr("interval 45 seconds")).select("node", "liveness")


def gossip_merge(spark, d):
    m = table(spark, d, "cluster_member").select("node", F.col("incarnation").alias("heartbeat"), "state")
    return replicas.merge_gossip(m.filter("incarnation = 1"), m.filter("incarnation > 1"))


def registry_first(spark, d):
    """First registration of each node wins: its record of the lowest incarnation, then address."""
    return table(spark, d, "cluster_member").groupBy("node").agg(F.min(F.struct("incarnation", "address")).alias("m")).select("node", "m.incarnation", "m.address")


def healthy_nodes(spark, d):
    return replicas.newest_incarnation(table(spark, d, "cluster_member")).filter("state = 'alive'").select("node")


def fencing_check(spark, d):
    """Records of a member and whether their incarnation is the current one."""
    m = table(spark, d, "cluster_member")
    current = m.groupBy("node").agg(F.max("incarnation").alias("current"))
    return m.join(current, "node").select("node", "incarnation", (F.col("incarnation") == F.col("current")).alias("valid"))


def member_counts(spark, d):
    return replicas.newest_incarnation(table(spark, d, "cluster_member")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def random_peers(spark, d):
    """Three members other than node-1 in an order drawn by hash."""
    return cluster.random_peers(table(spark, d, "cluster_member"), 3, 42, "node-1")


def _hints(spark, d):
    rows = table(spark, d, "replica_write").filter("key <> '' and target_node is not null")
    return rows.select("key", F.col("target_node").alias("target"), "req_id", "sent_at", (F.col("req_id") % 13).cast("int").alias("attempts"))


def hints_for_node(spark, d):
    return _hints(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("attempts") < 10).alias("pending"))


def hint_outbox(spark, d):
    """Hints still to be sent when those of even request numbers have been delivered."""
    h = _hints(spark, d)
    return folds.undelivered_hints(h, h.filter("req_id % 2 = 0")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def hint_overflow(spark, d):
    h = _hints(spark, d).select("req_id", "key", "target").distinct()
    return drop_oldest(h, [F.col("req_id"), F.col("key"), F.col("target")], MAX_HINTS).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("req_id").alias("first"))


def peer_stats(spark, d):
    """Replication by peer: requests whose key is there count as delivered unless their number says another attempt is due."""
    w = table(spark, d, "replica_write").filter("target_node is not null").withColumn("sent_us", F.unix_micros(F.col("sent_at").cast("timestamp")))
    tries = F.col("req_id") % 13
    return cluster.peer_stats(w, "target_node", tries < 6, tries, "sent_us")


def _node_rows(spark, d, node):
    entries = replicas.node_entries(table(spark, d, "replica_log").filter(F.col("node") == node))
    return entries.filter(~F.col("tombstone")).select("key", "value")


def merkle_leaves(spark, d):
    return merkle.leaves(_node_rows(spark, d, "node-1")).select("lo", "hi", F.array_join("keys", "|").alias("keys"), "hash")


def merkle_root(spark, d):
    return merkle.root(_node_rows(spark, d, "node-1"))


def merkle_diff_keys(spark, d):
    return merkle.diff_keys(_node_rows(spark, d, "node-1"), _node_rows(spark, d, "node-2"))


def merkle_bucket_root(spark, d):
    return merkle.bucket_root(spark, merkle.bucket_roots(_keys(spark, d)))


def bloom_params(spark, d):
    counts = table(spark, d, "replica_log").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    m, k = bloom.bloom_size_columns(F.col("n"), F.lit(0.01))
    return counts.select("node", "n", m.alias("m"), k.alias("k"))


def bloom_membership(spark, d):
    asked = table(spark, d, "kv_request").filter("key <> ''")
    shards, n, m, k = bloom.build_shards(table(spark, d, "wal_record").filter("key <> ''"), "key", asked=asked.select("key").distinct().count())
    return bloom.might_contain(asked, "key", shards, n, m, k)


def merkle_diff_tree(spark, d):
    return merkle.diff_leaves(_node_rows(spark, d, "node-1"), _node_rows(spark, d, "node-2"))


def merkle_weak_root(spark, d):
    return merkle.weak_root(_keys(spark, d))


def vc_merge_pairs(spark, d):
    """Clocks of equal versions on both nodes merged."""
    return _clock_pairs(spark, d).groupBy(vclock.text(vclock.merge(F.col("a"), F.col("b"))).alias("clock")).agg(F.count(F.lit(1)).alias("n"))


def replicated_put(spark, d):
    """Write requests with the answers of their replicas while one of five nodes is down."""
    rows = table(spark, d, "replica_write").filter("key <> ''").select("key", "req_id", "vector_clock")
    return cluster.replicated(rows, ring.Ring(FIVE), ALIVE, 3).groupBy("acks", "met").agg(F.count(F.lit(1)).alias("n"), F.count("vector_clock").alias("clocks"))


def replicated_delete(spark, d):
    return cluster.replicated_delete(table(spark, d, "kv_request"), ring.Ring(FIVE), ALIVE, 3, version=9).select("key", "version", "acks", "met")


def replica_rows(spark, d):
    """Whole rows as each replica gets them."""
    rows = table(spark, d, "replica_log").select("key", "version", "tombstone")
    return cluster.replica_rows(rows, ring.Ring(FIVE)).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"), F.count_if("tombstone").alias("dead"))


def quorum_read_some(spark, d):
    """Every key read from the first living one of its two replicas."""
    got = cluster.quorum_read_some(table(spark, d, "replica_log"), ring.Ring(("node-1", "node-2")), ["node-1", "node-2"], 1, 2)
    return got.select("key", F.col("answers").cast("long").alias("answers"), "met", "version", F.hex("value").alias("value"), "visible")


def node_batch_get(spark, d):
    got = cluster.node_batch_get(table(spark, d, "replica_log"), "node-1", table(spark, d, "replica_log").filter("node = 'node-2' or version % 3 = 0"))
    return got.select("key", "version", F.hex("value").alias("value"), "tombstone", "found")


def node_receive(spark, d):
    rows = cluster.received(table(spark, d, "replica_write").filter("key <> ''"), "node-2")
    return rows.groupBy("taken", "target_node").agg(F.count(F.lit(1)).alias("n"))


def gossip_ring(spark, d):
    """Positions by node once gossip has told of the members."""
    grown = cluster.gossip_ring(ring.Ring(NODES), table(spark, d, "cluster_member"))
    return grown.table(spark).groupBy("node").agg(F.count(F.lit(1)).alias("vnodes"))


def membership_projection(spark, d):
    return cluster.projection(replicas.newest_incarnation(table(spark, d, "cluster_member")))


def membership_marks(spark, d):
    """Members never seen are marked dead, then those that sent something come back."""
    known = replicas.newest_incarnation(table(spark, d, "cluster_member"))
    met = table(spark, d, "replica_write").filter("target_node is not null").select(F.col("target_node").alias("node"))
    now = F.lit(None).cast("timestamp_ntz")
    marked = cluster.mark_dead(known, known.filter("last_seen is null or node = 'node-1'"), now)
    return replicas.merge_members(marked, met, now).select("node", "state", "incarnation")


def registry_state(spark, d):
    """The registry after all have registered, one left for good, one is leaving, and the last health checks."""
    m = table(spark, d, "cluster_member")
    known = cluster.register(None, m.filter("incarnation = 1"), ["incarnation"])
    known = cluster.register(known, m, ["incarnation"])
    known = cluster.set_state(cluster.unregister(known, ["node-3"]), "node-2", cluster.LEAVING)
    e = table(spark, d, "events").select(F.concat(F.lit("node-"), (F.col("event_id") % 4 + 1).cast("string")).alias("node"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return cluster.checked(known, e, ["event_id"])


def registry_lookup(spark, d):
    """Nodes by address."""
    known = cluster.register(None, table(spark, d, "cluster_member"), ["incarnation"])
    return known.groupBy("address").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))


def row_cache_read(spark, d):
    """Rows of the last reads that a row cache of some days still answers with, none of them overwritten since."""
    asked = table(spark, d, "kv_request").filter("key <> '' and asked_at is not null")
    cached = asked.groupBy("key").agg(F.max("log_end").alias("version"), F.max(F.col("asked_at").cast("timestamp")).alias("cached_at"))
    writes = table(spark, d, "wal_record").filter("key <> ''").select("key", F.col("lsn").alias("version"))
    now = cached.agg(F.max("cached_at")).first()[0]
    return cluster.cached_rows(cached, writes, F.lit(now), CACHE_SECONDS).select("key", "version")


def cluster_status(spark, d):
    """One row of a status page: members by state, positions, keys and tombstones."""
    m = replicas.newest_incarnation(table(spark, d, "cluster_member")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("state") == "alive").alias("alive"))
    s = snapshot.stats(table(spark, d, "wal_record"))
    row = s.select(F.struct("*")).scalar()
    return m.withColumn("s", row).select("members", "alive", "s.live_keys", "s.tombstones", "s.max_version", F.lit(len(ring.Ring(NODES).positions)).cast("long").alias("positions"))


QUERIES = {f.__name__: f for f in (
    ring_owner, ring_preference_list, ring_distribution, ring_key_movement, ring_sloppy_quorum, hint_fallback_pairs, ring_vnode_ranges, ring_range_shares, ring_display_sample,
    replica_fanout, is_primary, vc_increment, vc_merge, vc_compare, vc_compare_nullable, vc_siblings, quorum_read_latest, quorum_ack_check, read_repair_majority,
    repair_plan_version, anti_entropy_actions, keyset_difference, incarnation_merge, membership_merge, liveness_states, gossip_merge, registry_first, healthy_nodes,
    fencing_check, member_counts, random_peers, hints_for_node, hint_outbox, hint_overflow, peer_stats, merkle_leaves, merkle_root, merkle_diff_keys,
    merkle_bucket_root, bloom_params, bloom_membership, merkle_diff_tree, merkle_weak_root, vc_merge_pairs, replicated_put, replicated_delete, replica_rows, quorum_read_some,
    node_batch_get, node_receive, gossip_ring, membership_projection, membership_marks, registry_state, registry_lookup, row_cache_read, cluster_status)}


def _ring(nodes: tuple[str, ...], name: str = "ring") -> str:
    return f"""{name}_l AS (SELECT node, i AS vnode, hex(encode(node || '#vnode' || i)) AS h FROM (VALUES {', '.join(f"('{n}')" for n in nodes)}) n(node), range(150) r(i)),
{name} AS (SELECT node, vnode, {CRC} AS pos FROM {name}_l, crc_table)"""


_KEYS = f"key_hex AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM replica_log), keys AS (SELECT key, {CRC} AS crc FROM key_hex, crc_table)"


def _prefs(name: str = "ring", out: str = "prefs", keys: str = "keys") -> str:
    """Per key its nodes in clockwise order: by the least distance to one of their positions."""
    return f"""{out} AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY dist) AS rn FROM (
  SELECT key, node, min((pos - crc + 4294967296) % 4294967296) AS dist FROM {keys}, {name} GROUP BY key, node))"""


_BASE3 = f"WITH {CRC_TABLE}, {_ring(NODES)}, {_KEYS}, {_prefs()}"
_BASE5 = f"WITH {CRC_TABLE}, {_ring(FIVE)}, {_KEYS}, {_prefs()}"
_SLOPPY = """, ranked AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN rn <= 3 THEN rn ELSE 100 END, node) AS q, rn FROM prefs WHERE node <> 'node-2'),
chosen AS (SELECT * FROM ranked WHERE q <= 3)"""
_RANGES = f"""WITH {CRC_TABLE}, {_ring(NODES)}, w AS (SELECT pos, node, CAST(vnode AS INT) AS vnode,
  (pos - coalesce(lag(pos) OVER (ORDER BY pos), (SELECT max(pos) FROM ring)) + 4294967296) % 4294967296 AS width FROM ring)"""
_ENTRIES = """WITH entries AS (SELECT node, key, version, ts_ns, tombstone, value FROM (SELECT *, row_number() OVER
  (PARTITION BY node, key ORDER BY version DESC NULLS LAST, ts_ns DESC NULLS LAST, tombstone DESC, value DESC NULLS LAST) AS rn FROM replica_log) WHERE rn = 1)"""
_MEMBERS = """WITH m AS (SELECT node, incarnation, last_seen, state FROM (SELECT *, row_number() OVER
  (PARTITION BY node ORDER BY incarnation DESC, last_seen DESC NULLS LAST, state DESC, address DESC) AS rn FROM cluster_member) WHERE rn = 1)"""
_CLOCKS = """WITH c AS (SELECT a.vc AS a, b.vc AS b FROM replica_log a JOIN replica_log b ON a.key = b.key AND a.version = b.version AND a.node = 'node-1' AND b.node = 'node-2'),
k AS (SELECT *, list_distinct(list_concat(coalesce(map_keys(a), []), coalesce(map_keys(b), []))) AS ks FROM c),
f AS (SELECT *, len(list_filter(ks, lambda x: coalesce(a[x], 0) < coalesce(b[x], 0))) > 0 AS less, len(list_filter(ks, lambda x: coalesce(a[x], 0) > coalesce(b[x], 0))) > 0 AS more FROM k)"""
_ORDER = "CASE WHEN less AND more THEN 'CONCURRENT' WHEN less THEN 'BEFORE' WHEN more THEN 'AFTER' ELSE 'EQUAL' END"
def _odd(hash_: str) -> str:
    return f"list_transform([{hash_}], lambda o: o + CAST(1 - o % 2 AS UHUGEINT))[1]"


def _weak(name: str, first: int) -> str:
    return "(" + " + ".join(f"(({name} >> {8 * i}) & 255) * {first + i}" for i in range(8)) + ")"


def _leaves(node: str, n: str = "") -> str:
    """The tree of a node by halving: iv has all its intervals with their paths, leaf the hashes of those of up to four keys."""
    return f"""e{n} AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS pos FROM entries WHERE node = '{node}' AND NOT tombstone),
iv{n}(lo, hi, path) AS (SELECT CAST(0 AS BIGINT), (SELECT count(*) FROM e{n}), CAST(1 AS BIGINT) UNION ALL
  SELECT CASE s WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE s WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END, path * 2 + s FROM iv{n}, (VALUES (0), (1)) t(s) WHERE hi - lo > 4),
leaf{n} AS (SELECT lo, hi, path, list(key ORDER BY pos) AS keys, sha256(unhex(string_agg('00' || hex(encode(key)) || '00' || coalesce(hex(value), '') || '00', '' ORDER BY pos))) AS hash
  FROM iv{n} JOIN e{n} ON e{n}.pos >= lo AND e{n}.pos < hi WHERE hi - lo <= 4 GROUP BY lo, hi, path)"""


def _merkle(node: str, up: str = "up") -> str:
    base = _ENTRIES.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_leaves(node)}"
    if not up:
        return f"{base}, {_leaves('node-2', '2')}"
    # nodes meet their sibling one round after the deeper of both is there: a round for each level, from the deepest up
    return base + """, depth AS (SELECT CAST(max(floor(log2(path))) AS BIGINT) AS top FROM leaf),
lv(d, lo, hi, path, hash) AS (SELECT top, lo, hi, path, hash FROM leaf, depth UNION ALL
  SELECT d - 1, min(lo), max(hi), CASE WHEN deep THEN path // 2 ELSE path END, CASE WHEN deep THEN sha256(unhex(string_agg(hash, '' ORDER BY path))) ELSE any_value(hash) END
  FROM (SELECT *, floor(log2(path)) >= d AS deep, CASE WHEN floor(log2(path)) >= d THEN path // 2 ELSE -path END AS pair FROM lv WHERE d > 0) GROUP BY d, pair, deep, CASE WHEN deep THEN path // 2 ELSE path END),
up AS (SELECT * FROM lv WHERE d = 0)"""


_HINTS = "WITH h AS (SELECT key, target_node AS target, req_id, CAST(req_id % 13 AS INT) AS attempts FROM replica_write WHERE key <> '' AND target_node IS NOT NULL)"

SQL = {
    "ring_owner": f"{_BASE3} SELECT key, node FROM prefs WHERE rn = 1",
    "ring_preference_list": f"{_BASE5} SELECT key, string_agg(node, ',' ORDER BY rn) AS replicas FROM prefs WHERE rn <= 3 GROUP BY key",
    "ring_distribution": f"{_BASE3} SELECT node, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM keys), 6) AS percent FROM prefs WHERE rn = 1 GROUP BY node",
    "ring_key_movement": f"""WITH {CRC_TABLE}, {_ring(NODES)}, {_ring((*NODES, 'node-4'), 'ring4')}, {_KEYS}, {_prefs()}, {_prefs('ring4', 'prefs4')}
SELECT a.node AS old_node, b.node AS new_node, count(*) AS n FROM prefs a JOIN prefs4 b ON a.key = b.key WHERE a.rn = 1 AND b.rn = 1 AND a.node <> b.node GROUP BY ALL""",
    "ring_sloppy_quorum": f"{_BASE5}{_SLOPPY} SELECT key, string_agg(node, ',' ORDER BY q) AS replicas FROM chosen GROUP BY key",
    "hint_fallback_pairs": f"""{_BASE5}{_SLOPPY}, fb AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY q) AS i FROM chosen WHERE rn > 3),
dead AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY rn) AS i FROM prefs WHERE rn <= 3 AND node = 'node-2')
SELECT fb.key, fb.node AS fallback, dead.node AS target FROM fb JOIN dead ON fb.key = dead.key AND fb.i = dead.i""",
    "ring_vnode_ranges": f"{_RANGES} SELECT pos, node, vnode, width FROM w",
    "ring_range_shares": f"{_RANGES} SELECT node, CAST(sum(width) AS BIGINT) AS width, count(*) AS vnodes FROM w GROUP BY node",
    "ring_display_sample": f"{_RANGES} SELECT pos, node, vnode FROM (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM w) WHERE i % 10 = 0",
    "replica_fanout": f"""WITH {CRC_TABLE}, {_ring(FIVE)}, wk AS (SELECT key, count(*) AS n, hex(encode(key)) AS h FROM replica_write WHERE key <> '' GROUP BY key),
keys AS (SELECT key, n, {CRC} AS crc FROM wk, crc_table), {_prefs()}
SELECT node, CAST(sum(n) AS BIGINT) AS n, count(*) AS keys FROM prefs JOIN keys USING (key) WHERE rn <= 3 GROUP BY node""",
    "is_primary": f"{_BASE5} SELECT node = 'node-2' AS primary, count(*) AS n FROM prefs WHERE rn = 1 GROUP BY 1",
    "vc_increment": """WITH e AS (SELECT lsn, node, vc, row_number() OVER () AS r FROM wal_record WHERE node IS NOT NULL),
p AS (SELECT r, unnest(map_entries(vc)) AS x, node FROM e), q AS (SELECT r, x.key AS k, x.value + CASE WHEN x.key = node THEN 1 ELSE 0 END AS v FROM p
  UNION ALL SELECT r, node, 1 FROM e WHERE vc IS NULL OR NOT list_contains(map_keys(vc), node))
SELECT clock, count(*) AS n FROM (SELECT r, string_agg(k || '=' || v, ',' ORDER BY k) AS clock FROM q GROUP BY r) GROUP BY clock""",
    "vc_merge": """WITH p AS (SELECT key, unnest(map_entries(vc)) AS x FROM wal_record), q AS (SELECT key, x.key AS k, max(x.value) AS v FROM p GROUP BY ALL),
t AS (SELECT key, string_agg(k || '=' || v, ',' ORDER BY k) AS clock FROM q GROUP BY key)
SELECT w.key, coalesce(t.clock, '') AS clock FROM (SELECT DISTINCT key FROM wal_record) w LEFT JOIN t ON w.key IS NOT DISTINCT FROM t.key""",
    "vc_compare": f"{_CLOCKS} SELECT {_ORDER} AS order, count(*) AS n FROM f GROUP BY 1".replace("AS order", 'AS "order"'),
    "vc_compare_nullable": f"""{_CLOCKS} SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'EQUAL' WHEN a IS NULL THEN 'BEFORE' WHEN b IS NULL THEN 'AFTER' ELSE {_ORDER} END AS "order",
  coalesce(cardinality(a), 0) = 0 AS zero, count(*) AS n FROM f GROUP BY 1, 2""",
    "vc_siblings": """WITH r AS (SELECT key, vc, row_number() OVER () AS r FROM replica_log WHERE key IS NOT NULL), x AS (SELECT r, unnest(map_entries(vc)) AS e FROM r),
t AS (SELECT r, string_agg(e.key || '=' || e.value, ',' ORDER BY e.key) AS clock FROM x GROUP BY r),
c AS (SELECT r.key, coalesce(t.clock, '') AS clock, any_value(coalesce(r.vc, MAP {})) AS vc FROM r LEFT JOIN t USING (r) GROUP BY 1, 2)
SELECT key, clock FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.key = a.key AND b.clock <> a.clock
  AND len(list_filter(map_keys(a.vc), lambda k: a.vc[k] > coalesce(b.vc[k], 0))) = 0 AND len(list_filter(map_keys(b.vc), lambda k: b.vc[k] > coalesce(a.vc[k], 0))) > 0)""",
    "quorum_read_latest": f"""{_ENTRIES}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC NULLS LAST, ts_ns DESC NULLS LAST, tombstone DESC, value DESC NULLS LAST) AS rn FROM entries)
SELECT b.key, b.version, hex(b.value) AS value, NOT b.tombstone AS visible, (SELECT count(*) FROM entries e WHERE e.key = b.key AND e.version IS NOT DISTINCT FROM b.version) AS holders FROM best b WHERE rn = 1""",
    "quorum_ack_check": """WITH a AS (SELECT key, count(target_node) AS acks FROM replica_write WHERE key <> '' GROUP BY key)
SELECT key, acks, acks >= 2 AS met, (SELECT bool_and(acks >= 2) FROM a) AS all_met FROM a""",
    "read_repair_majority": f"""{_ENTRIES}, v AS (SELECT key, hex(value) AS v, count(*) AS w FROM entries GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY w DESC, v NULLS LAST) AS rn FROM v)
SELECT key, v AS winner, CAST(CASE WHEN coalesce(v, '') = '' THEN 0 ELSE n - w END AS BIGINT) AS repairs FROM r WHERE rn = 1""",
    "repair_plan_version": f"""{_ENTRIES} SELECT e.key, e.node, e.version AS has, t.wants FROM entries e JOIN (SELECT key, max(version) AS wants FROM entries GROUP BY key) t ON e.key = t.key
WHERE coalesce(e.version, -1) < t.wants""",
    "anti_entropy_actions": f"""{_ENTRIES}, a AS (SELECT * FROM entries WHERE node = 'node-1' AND NOT tombstone), b AS (SELECT * FROM entries WHERE node = 'node-2' AND NOT tombstone)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'pull' WHEN b.key IS NULL THEN 'push' WHEN coalesce(a.version, -1) < coalesce(b.version, -1) THEN 'pull'
  WHEN coalesce(a.version, -1) > coalesce(b.version, -1) THEN 'push' ELSE 'none' END AS action FROM a FULL JOIN b ON a.key = b.key
WHERE a.key IS NULL OR b.key IS NULL OR a.version IS DISTINCT FROM b.version OR a.value IS DISTINCT FROM b.value""",
    "keyset_difference": "SELECT DISTINCT key FROM replica_log WHERE node = 'node-1' AND key NOT IN (SELECT key FROM replica_log WHERE node = 'node-2')",
    "incarnation_merge": f"{_MEMBERS} SELECT node, incarnation, state FROM m",
    "membership_merge": f"""{_MEMBERS}, c AS (SELECT DISTINCT target_node AS node FROM replica_write WHERE target_node IS NOT NULL)
SELECT coalesce(m.node, c.node) AS node, CASE WHEN c.node IS NOT NULL THEN 'alive' ELSE m.state END AS state,
  CAST(CASE WHEN m.node IS NULL THEN 1 WHEN c.node IS NOT NULL AND m.state <> 'alive' THEN m.incarnation + 1 ELSE m.incarnation END AS INT) AS incarnation FROM m FULL JOIN c ON m.node = c.node""",
    "liveness_states": f"""{_MEMBERS}, n AS (SELECT max(last_seen) + INTERVAL 45 SECOND AS now FROM m) SELECT node, CASE WHEN last_seen IS NULL OR now - last_seen > INTERVAL 60 SECOND THEN 'dead'
  WHEN now - last_seen > INTERVAL 30 SECOND THEN 'suspect' ELSE 'alive' END AS liveness FROM m, n""",
    "gossip_merge": """SELECT node, heartbeat, state FROM (SELECT node, incarnation AS heartbeat, state, row_number() OVER (PARTITION BY node ORDER BY incarnation DESC, incarnation = 1 DESC, state DESC) AS rn
  FROM cluster_member WHERE incarnation >= 1) WHERE rn = 1""",
    "registry_first": "SELECT node, incarnation, address FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY incarnation, address) AS rn FROM cluster_member) WHERE rn = 1",
    "healthy_nodes": f"{_MEMBERS} SELECT node FROM m WHERE state = 'alive'",
    "fencing_check": "SELECT node, incarnation, incarnation = max(incarnation) OVER (PARTITION BY node) AS valid FROM cluster_member",
    "member_counts": f"{_MEMBERS} SELECT state, count(*) AS n FROM m GROUP BY state",
    "hints_for_node": f"{_HINTS} SELECT target, count(*) AS n, count(*) FILTER (attempts < 10) AS pending FROM h GROUP BY target",
    "hint_outbox": f"{_HINTS} SELECT target, count(*) AS n FROM h WHERE attempts < 10 AND NOT EXISTS (SELECT 1 FROM h d WHERE d.key = h.key AND d.target = h.target AND d.req_id % 2 = 0) GROUP BY target",
    "hint_overflow": f"""{_HINTS}, u AS (SELECT DISTINCT req_id, key, target FROM h), r AS (SELECT *, row_number() OVER (ORDER BY req_id, key, target) AS rn, count(*) OVER () AS n FROM u)
SELECT target, count(*) AS n, min(req_id) AS first FROM r WHERE n < {MAX_HINTS} OR rn > n // 10 GROUP BY target""",
    "peer_stats": """SELECT target_node, count(*) FILTER (req_id % 13 < 6) AS success, count(*) FILTER (req_id % 13 BETWEEN 6 AND 9) AS pending, count(*) FILTER (req_id % 13 >= 10) AS failures,
  max(epoch_us(sent_at)) FILTER (req_id % 13 < 6) AS last_sync FROM replica_write WHERE target_node IS NOT NULL GROUP BY target_node""",
    "random_peers": f"""WITH n AS (SELECT DISTINCT node FROM cluster_member WHERE node <> 'node-1'), {sqlhash.hash_texts('h', 'n', 'node', 'node')}
SELECT node FROM h ORDER BY {sqlhash.signed(sqlhash.hash_int(42, 'hash'))}, node LIMIT 3""",
    "merkle_leaves": _ENTRIES.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS pos FROM entries WHERE node = 'node-1' AND NOT tombstone),
iv(lo, hi) AS (SELECT CAST(0 AS BIGINT), (SELECT count(*) FROM e) UNION ALL
  SELECT CASE s WHEN 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE s WHEN 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM iv, (VALUES (0), (1)) t(s) WHERE hi - lo > 4)
SELECT lo, hi, string_agg(key, '|' ORDER BY pos) AS keys, sha256(unhex(string_agg('00' || hex(encode(key)) || '00' || coalesce(hex(value), '') || '00', '' ORDER BY pos))) AS hash
FROM iv JOIN e ON e.pos >= lo AND e.pos < hi WHERE hi - lo <= 4 GROUP BY lo, hi""",
    "merkle_diff_keys": f"""{_ENTRIES}, a AS (SELECT * FROM entries WHERE node = 'node-1' AND NOT tombstone), b AS (SELECT * FROM entries WHERE node = 'node-2' AND NOT tombstone)
SELECT coalesce(a.key, b.key) AS key FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR coalesce(hex(a.value), '') <> coalesce(hex(b.value), '')""",
    "bloom_params": """SELECT node, n, m, CAST(greatest(1, round(m / n * ln(2.0))) AS BIGINT) AS k FROM (
  SELECT node, count(*) AS n, CAST(ceil(-count(*) * ln(0.01) / pow(ln(2.0), 2)) AS BIGINT) AS m FROM replica_log GROUP BY node)""",
    "bloom_membership": f"""WITH w AS (SELECT DISTINCT key FROM wal_record WHERE key <> ''), r AS (SELECT DISTINCT key FROM kv_request WHERE key <> ''), u AS (SELECT key FROM w UNION SELECT key FROM r),
{sqlhash.hash_texts('h1', 'u', 'key', 'key')}, h AS (SELECT key, hash AS h1, {_odd(sqlhash.hash_int(1, 'hash'))} AS h2 FROM h1),
n AS (SELECT (SELECT count(*) FROM w) AS n, (SELECT count(*) FROM r) AS asked), c AS (SELECT CAST(greatest(0, ceil(log2(greatest(1, n, asked) / 16384.0))) AS INTEGER) AS sb, n FROM n),
m AS (SELECT sb, CAST(ceil(-x * ln(0.01) / pow(ln(2.0), 2)) AS BIGINT) AS m, x FROM (SELECT sb, ceil(n / pow(2, sb) * 1.02) + 1 AS x FROM c)),
k AS (SELECT *, CAST(greatest(1, round(m / x * ln(2.0))) AS BIGINT) AS k FROM m),
p AS (SELECT key, CASE WHEN sb = 0 THEN 0 ELSE h1 // CAST(pow(2, 64 - sb) AS UHUGEINT) END AS shard, unnest(list_transform(range(k), lambda i: ((h1 + CAST(i AS UHUGEINT) * h2) % CAST('18446744073709551616' AS UHUGEINT)) % CAST(m AS UHUGEINT))) AS place FROM h, k),
b AS (SELECT DISTINCT shard, place FROM p WHERE key IN (SELECT key FROM w))
SELECT key FROM p JOIN b USING (shard, place) WHERE key IN (SELECT key FROM r) GROUP BY key HAVING count(*) = (SELECT k FROM k)""",
    "merkle_root": _merkle("node-1") + " SELECT hash FROM up WHERE lo = 0 AND hi = (SELECT count(*) FROM e)",
    "merkle_diff_tree": _merkle("node-1", "") + """ SELECT DISTINCT key FROM (
  SELECT unnest(keys) AS key FROM leaf a WHERE NOT EXISTS (SELECT 1 FROM leaf2 b WHERE b.path = a.path AND b.hash = a.hash) UNION ALL
  SELECT unnest(keys) FROM leaf2 a WHERE NOT EXISTS (SELECT 1 FROM leaf b WHERE b.path = a.path AND b.hash = a.hash))""",
    "merkle_bucket_root": """WITH k AS (SELECT key, sha256(key) AS d FROM (SELECT DISTINCT key FROM replica_log)),
b AS (SELECT key, d, list_sum(list_transform(range(1, 33), lambda j: j * CAST('0x' || substr(d, 2 * j - 1, 2) AS BIGINT))) % 1024 AS bucket FROM k),
c AS (SELECT bucket, list_reduce(list(d ORDER BY key), lambda x, y: sha256(unhex(x || y))) AS h FROM b GROUP BY bucket)
SELECT list_reduce(list_prepend('', list(h ORDER BY bucket)), lambda x, y: sha256(unhex(x || y))) AS hash FROM c""",
    "merkle_weak_root": f"""WITH RECURSIVE k AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM replica_log),
l(n, pos, h) AS (SELECT CAST((SELECT count(*) FROM k) AS BIGINT), row_number() OVER (ORDER BY key) - 1, CAST(list_sum(list_transform(range(1, length(h) // 2 + 1), lambda j: j * CAST('0x' || substr(h, 2 * j - 1, 2) AS BIGINT))) AS BIGINT) FROM k
UNION ALL SELECT (n + 1) // 2, a, CASE WHEN c = 1 THEN x ELSE {_weak('x', 1)} + {_weak('y', 9)} END FROM (SELECT n, pos // 2 AS a, count(*) AS c, min_by(h, pos) AS x, max_by(h, pos) AS y FROM l WHERE n > 1 GROUP BY n, pos // 2))
SELECT {" || ".join(f"lpad(lower(hex((h >> {8 * i}) & 255)), 2, '0')" for i in range(8))} AS hash FROM l WHERE n = 1""",
    "vc_merge_pairs": _CLOCKS.split(",\nf AS")[0] + """, r AS (SELECT *, row_number() OVER () AS id FROM k), x AS (SELECT id, unnest(ks) AS n, a, b FROM r),
t AS (SELECT id, string_agg(n || '=' || greatest(coalesce(a[n], 0), coalesce(b[n], 0)), ',' ORDER BY n) AS clock FROM x GROUP BY id)
SELECT coalesce(clock, '') AS clock, count(*) AS n FROM r LEFT JOIN t ON r.id = t.id GROUP BY 1""",
    "replicated_put": f"""WITH {CRC_TABLE}, {_ring(FIVE)}, wk AS (SELECT key, count(*) AS n, count(vector_clock) AS clocks, hex(encode(key)) AS h FROM replica_write WHERE key <> '' GROUP BY key),
keys AS (SELECT key, n, clocks, {CRC} AS crc FROM wk, crc_table), {_prefs()}, a AS (SELECT key, CAST(count(*) AS INTEGER) AS acks FROM prefs WHERE rn <= 3 AND node <> 'node-2' GROUP BY key)
SELECT acks, acks >= 3 AS met, CAST(sum(n) AS BIGINT) AS n, CAST(sum(clocks) AS BIGINT) AS clocks FROM a JOIN keys USING (key) GROUP BY 1, 2""",
    "replicated_delete": f"""WITH {CRC_TABLE}, {_ring(FIVE)}, wk AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM kv_request WHERE key <> ''), keys AS (SELECT key, {CRC} AS crc FROM wk, crc_table), {_prefs()}
SELECT key, CAST(9 AS BIGINT) AS version, CAST(count(*) AS INTEGER) AS acks, count(*) >= 3 AS met FROM prefs WHERE rn <= 3 AND node <> 'node-2' GROUP BY key""",
    "replica_rows": f"{_BASE5} SELECT p.node, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions, count(*) FILTER (tombstone) AS dead FROM replica_log r JOIN prefs p ON r.key = p.key WHERE p.rn <= 3 GROUP BY p.node",
    "quorum_read_some": f"""WITH {CRC_TABLE}, {_ring(('node-1', 'node-2'))}, {_KEYS}, {_prefs()}, {_ENTRIES.removeprefix('WITH ')}
SELECT p.key, CAST(count(e.key) AS BIGINT) AS answers, true AS met, any_value(e.version) AS version, any_value(hex(e.value)) AS value, coalesce(bool_or(NOT e.tombstone), false) AS visible
FROM prefs p LEFT JOIN entries e ON e.key = p.key AND e.node = p.node WHERE p.rn = 1 GROUP BY p.key""",
    "node_batch_get": f"""{_ENTRIES}, k AS (SELECT DISTINCT key FROM replica_log WHERE key <> '' AND (node = 'node-2' OR version % 3 = 0))
SELECT k.key, e.version, hex(e.value) AS value, e.tombstone, e.key IS NOT NULL AS found FROM k LEFT JOIN entries e ON e.key = k.key AND e.node = 'node-1'""",
    "node_receive": "SELECT CASE WHEN coalesce(target_node, 'node-2') = 'node-2' THEN 'stored' ELSE 'hint' END AS taken, target_node, count(*) AS n FROM replica_write WHERE key <> '' GROUP BY 1, 2",
    "gossip_ring": "SELECT node, CAST(150 AS BIGINT) AS vnodes FROM (SELECT node FROM cluster_member UNION SELECT unnest(['node-1', 'node-2', 'node-3'])) WHERE node IS NOT NULL",
    "membership_projection": f"{_MEMBERS.replace('SELECT node, incarnation, last_seen, state FROM', 'SELECT node, incarnation, last_seen, state, address FROM')} SELECT node, address, epoch_us(last_seen) // 1000 AS heartbeat_ms, state FROM m",
    "membership_marks": f"""{_MEMBERS}, d AS (SELECT node, incarnation, CASE WHEN last_seen IS NULL OR node = 'node-1' THEN 'dead' ELSE state END AS state FROM m), c AS (SELECT DISTINCT target_node AS node FROM replica_write WHERE target_node IS NOT NULL)
SELECT coalesce(d.node, c.node) AS node, CASE WHEN c.node IS NOT NULL THEN 'alive' ELSE d.state END AS state,
  CAST(CASE WHEN d.node IS NULL THEN 1 WHEN c.node IS NOT NULL AND d.state <> 'alive' THEN d.incarnation + 1 ELSE d.incarnation END AS INT) AS incarnation FROM d FULL JOIN c ON d.node = c.node""",
    "registry_state": """WITH f AS (SELECT node, address, state FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY incarnation, address, state) AS rn FROM cluster_member) WHERE rn = 1 AND node <> 'node-3'),
c AS (SELECT 'node-' || (event_id % 4 + 1) AS node, arg_max(event_type <> 'error', event_id) AS ok FROM events GROUP BY 1)
SELECT f.node, address, CASE WHEN f.node = 'node-2' THEN 'leaving' WHEN state IN ('leaving', 'down') OR ok IS NULL THEN state WHEN ok THEN 'healthy' ELSE 'unhealthy' END AS state FROM f LEFT JOIN c ON f.node = c.node""",
    "registry_lookup": """SELECT address, min(node) AS node, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY incarnation, address, state) AS rn FROM cluster_member) WHERE rn = 1 GROUP BY address""",
    "row_cache_read": f"""WITH c AS (SELECT key, max(log_end) AS version, max(asked_at) AS asked FROM kv_request WHERE key <> '' AND asked_at IS NOT NULL GROUP BY key), w AS (SELECT key, max(lsn) AS lsn FROM wal_record WHERE key <> '' GROUP BY key)
SELECT c.key, c.version FROM c LEFT JOIN w ON c.key = w.key WHERE (w.lsn IS NULL OR c.version > w.lsn) AND asked + INTERVAL {CACHE_SECONDS} SECOND >= (SELECT max(asked) FROM c)""",
    "cluster_status": f"""{_MEMBERS}, {LATEST} SELECT (SELECT count(*) FROM m) AS members, (SELECT count(*) FROM m WHERE state = 'alive') AS alive, count(*) FILTER (NOT tombstone) AS live_keys,
  count(*) FILTER (tombstone) AS tombstones, max(ver) AS max_version, CAST(450 AS BIGINT) AS positions FROM latest""",
}
