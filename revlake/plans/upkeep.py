"""Registered queries of the inbox, deliveries, retention, and the smaller relational sites around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.operators import asof, diff, ingest, paging, queues, retention
from revlake.plans.catalog import FLOOR, query

# -- inbox and streams, in batch form


@query("WITH e AS (SELECT event_id % 7 AS stream, user_id % 60 AS batch, event_id FROM events), g AS (SELECT stream, batch, count(*) AS n, max(event_id) AS cursor FROM e GROUP BY 1, 2) SELECT stream, batch, cursor AS event_id, 'rescan' AS kind FROM g WHERE n > 24 UNION ALL SELECT stream, batch, event_id, 'event' FROM e JOIN g USING (stream, batch) WHERE n <= 24")
def overflow_collapse(t):
    rows = t.events.select((F.col("event_id") % 7).alias("stream"), (F.col("user_id") % 60).alias("batch"), "event_id")
    return ingest.collapsed(rows, ["stream", "batch"], "event_id", 24)


@query("SELECT user_id, event_id, reason, CAST(0 AS BIGINT) AS restart FROM (SELECT user_id, event_id, CASE WHEN root <> lag(root) OVER w THEN 'root_changed' WHEN cursor < lag(cursor) OVER w THEN 'ids_wrapped' END AS reason FROM (SELECT user_id, event_id, event_id % 91 AS cursor, event_type = 'error' AS root FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE reason IS NOT NULL")
def discontinuity(t):
    rows = t.events.select("user_id", "event_id", F.col("event_id").alias("arrival"), (F.col("event_id") % 91).alias("cursor"), (F.col("event_type") == "error").alias("root"))
    return ingest.discontinuities(rows, ["user_id"], "cursor", "root").select("user_id", "event_id", "reason", "restart")


SETTLED = "SELECT *, CASE WHEN sequence % 10 < 3 THEN sequence % 2 END AS operation FROM inbox"


@query(f"""WITH i AS ({SETTLED}), r AS (SELECT authority, sequence, sequence % 3 % 2 AS operation FROM inbox)
    SELECT authority, r.sequence, r.operation, CASE WHEN coalesce(applied, -1) >= i.through THEN CASE WHEN i.operation IS NOT DISTINCT FROM r.operation THEN 'replay' ELSE 'conflict' END
        WHEN coalesce(applied, -1) <> i.predecessor OR coalesce(i.operation <> r.operation, false) THEN 'conflict' ELSE 'advance' END AS outcome
    FROM r JOIN i USING (authority, sequence) LEFT JOIN checkpoints USING (authority, stream)""")
def settlement_cas(t):
    inbox = t.inbox.withColumn("operation", F.when(F.col("sequence") % 10 < 3, F.col("sequence") % 2))
    requests = t.inbox.select("authority", "sequence", (F.col("sequence") % 3 % 2).alias("operation"))
    return ingest.settlements(requests, inbox, t.checkpoints, "authority", "stream").select("authority", "sequence", "operation", "outcome")


@query("SELECT authority, sequence FROM inbox JOIN checkpoints USING (authority, stream) WHERE applied >= through AND authority NOT IN (SELECT authority FROM inbox WHERE bytes % 11 = 0)")
def inbox_gc(t):
    return ingest.collectable(t.inbox, t.checkpoints, t.inbox.where("bytes % 11 = 0"), "authority", "stream").select("authority", "sequence")


@query("SELECT authority, sequence FROM inbox i WHERE NOT (EXISTS (SELECT 1 FROM checkpoints c WHERE c.authority = i.authority AND c.stream = i.stream AND c.applied >= i.through) AND i.authority NOT IN (SELECT authority FROM inbox WHERE bytes % 11 = 0))")
def inbox_drain(t):
    gone = ingest.collectable(t.inbox, t.checkpoints, t.inbox.where("bytes % 11 = 0"), "authority", "stream").select("authority", "sequence")
    return t.inbox.select("authority", "sequence").join(gone, ["authority", "sequence"], "left_anti")


@query("SELECT authority, bool_and(coalesce(applied, -1) >= fence) AS reached FROM (SELECT authority, stream, min(through) AS fence FROM inbox GROUP BY 1, 2) LEFT JOIN checkpoints USING (authority, stream) GROUP BY 1")
def barrier(t):
    return ingest.covered(t.inbox.groupBy("authority", "stream").agg(F.min("through").alias("fence")), t.checkpoints, "authority", "stream")


@query("SELECT authority, sequence, stream FROM inbox JOIN checkpoints USING (authority, stream) JOIN (SELECT authority, stream, max(through) - 100 AS target FROM inbox GROUP BY 1, 2) USING (authority, stream) WHERE applied < through AND through <= target QUALIFY row_number() OVER (PARTITION BY authority ORDER BY sequence) = 1")
def targeted_record(t):
    target = t.inbox.groupBy("authority", "stream").agg((F.max("through") - 100).alias("target"))
    rows = t.inbox.join(t.checkpoints, ["authority", "stream"]).join(target, ["authority", "stream"]).where("applied < through AND through <= target")
    return rows.groupBy("authority").agg(F.min_by(F.struct("sequence", "stream"), "sequence").alias("r")).select("authority", "r.*")


@query("SELECT authority, count(*) FILTER (coalesce(applied, -1) < through) AS unapplied, count(*) FILTER (bytes % 11 = 0) AS expectations, count(*) FILTER (coalesce(applied, -1) < through) + count(*) FILTER (bytes % 11 = 0) = 0 AS free FROM inbox LEFT JOIN checkpoints USING (authority, stream) GROUP BY 1")
def reservation_fence(t):
    rows = t.inbox.join(t.checkpoints, ["authority", "stream"], "left")
    g = rows.groupBy("authority").agg(F.count_if(F.coalesce("applied", F.lit(-1)) < F.col("through")).alias("unapplied"), F.count_if(F.col("bytes") % 11 == 0).alias("expectations"))
    return g.withColumn("free", F.col("unapplied") + F.col("expectations") == 0)


@query("SELECT authority, stream, applied, n_records FROM checkpoints JOIN (SELECT authority, stream, count(*) AS n_records FROM inbox GROUP BY 1, 2) USING (authority, stream) WHERE (authority, stream) > (2, 1) ORDER BY authority, stream LIMIT 51")
def applied_checkpoints(t):
    sizes = t.inbox.groupBy("authority", "stream").agg(F.count("*").alias("n_records"))
    return paging.keyset(t.checkpoints.join(sizes, ["authority", "stream"]), ["authority", "stream"], (2, 1), 50).select("authority", "stream", "applied", "n_records")


@query("SELECT tenant, kind, object_id, revision, CAST(row_number() OVER (PARTITION BY tenant ORDER BY kind, revision) - 1 AS BIGINT) AS position FROM (SELECT tenant, CASE WHEN tombstone THEN 1 ELSE 2 END AS kind, object_id, revision FROM staged WHERE provider)")
def client_feed(t):
    rows = t.staged.where("provider").select("tenant", F.when(F.col("tombstone"), 1).otherwise(2).alias("kind"), "object_id", "revision")
    return asof.numbered(rows, ["tenant"], ["kind", "revision"], "position")


# -- deliveries


@query("SELECT presentation, revision, CASE WHEN state = 'awaiting' AND c_custkey IS NULL THEN 'unknown' ELSE state END AS new_state FROM deliveries LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) ON c_custkey = presentation")
def owner_lost(t):
    alive = t.customer.where("c_acctbal > 2000").select(F.col("c_custkey").alias("presentation"))
    return queues.recovered(t.deliveries, alive, "presentation", "state", ("awaiting",)).select("presentation", "revision", "new_state")


@query("SELECT presentation, revision, CASE WHEN state IN ('pending', 'awaiting') AND revision <= acked THEN 'satisfied' ELSE state END AS new_state FROM deliveries LEFT JOIN (SELECT presentation, max(revision) AS acked FROM deliveries WHERE state = 'acked' GROUP BY 1) USING (presentation)")
def ack_satisfies(t):
    acked = t.deliveries.where("state = 'acked'").groupBy("presentation").agg(F.max("revision").alias("acked"))
    done = F.col("state").isin("pending", "awaiting") & (F.col("revision") <= F.col("acked"))
    return t.deliveries.join(acked, "presentation", "left").select("presentation", "revision", F.when(done, "satisfied").otherwise(F.col("state")).alias("new_state"))


@query("SELECT o_orderkey AS activation, c_name AS presentation, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS causes FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2")
def activation_events(t):
    j = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_orderkey").alias("activation"), F.col("c_name").alias("presentation")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return g.select("activation", "presentation", F.array_join(F.transform("c", lambda x: x["l_partkey"].cast("string")), ",").alias("causes"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS position FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def ordered_causes(t):
    rows = t.lineitem.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return asof.dense_number(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], "position").select("l_orderkey", "l_linenumber", "l_partkey", "position")


# -- retention


@query("SELECT v.object_id, v.revision FROM versions v JOIN floors USING (tenant) WHERE v.mount AND v.revision >= floor")
def changes_above_floor(t):
    from revlake.plans.catalog import _floors

    return t.versions.where("mount").join(F.broadcast(_floors(t)), "tenant").where("revision >= floor").select("object_id", "revision")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAYS <= TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def expired_leases(t):
    old = t.orders.where(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS") <= F.lit("1997-01-01").cast("timestamp"))
    return retention.unreferenced(old.select("o_orderkey"), "o_orderkey", t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


@query("SELECT kind, CAST(sum(bytes) AS BIGINT) AS n_bytes, ceiling, coalesce(sum(bytes) > ceiling, false) AS exceeded FROM (SELECT source AS kind, strlen(text) AS bytes, CASE source WHEN 'src0' THEN 100000 WHEN 'src1' THEN 1000000000 END AS ceiling FROM documents) GROUP BY kind, ceiling")
def storage_quota(t):
    return retention.quotas(t.documents.select(F.col("source").alias("kind"), F.octet_length("text").alias("size")), "kind", "size", {"src0": 100000, "src1": 1000000000})


@query("SELECT o_custkey AS tenant, count(*) % 4 AS phase, (count(*) + 1) % 4 AS next_phase FROM orders GROUP BY 1")
def phase_rotation(t):
    return t.orders.groupBy(F.col("o_custkey").alias("tenant")).agg(F.count("*").alias("n")).select("tenant", (F.col("n") % 4).alias("phase"), ((F.col("n") + 1) % 4).alias("next_phase"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = c_custkey)")
def collectable_owners(t):
    named = lambda df, c: df.select(F.col(c).alias("c_custkey"))
    return retention.unreferenced(t.customer.select("c_custkey"), "c_custkey", named(t.orders.where("o_orderstatus = 'P'"), "o_custkey"), named(t.events.where("event_type = 'error'"), "user_id"), named(t.supplier, "s_suppkey"), named(t.benchmark, "item_id"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, max(l_suppkey) AS owner FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey WHERE n_regionkey <> 1 AND (owner IS NULL OR owner <> c_custkey)")
def abandoned_preparations(t):
    owner = t.lineitem.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_suppkey").alias("owner"))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation.where("n_regionkey <> 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.join(owner, "o_orderkey", "left").where("owner IS NULL OR owner <> c_custkey").select("o_orderkey")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 65")
def recovery_page(t):
    j = t.customer.where("c_acctbal < 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return paging.keyset(j, ["c_custkey"], None, 64).select("c_custkey", "c_name", "n_name")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) ORDER BY o_orderkey LIMIT 33")
def first_owner_stages(t):
    free = t.orders.join(t.lineitem.where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")
    first = free.agg(F.min("o_custkey").alias("o_custkey"))
    return paging.keyset(free.join(F.broadcast(first), "o_custkey"), ["o_orderkey"], None, 32).select("o_custkey", "o_orderkey")


@query("SELECT object_id, revision, (SELECT count(*) FROM staged WHERE name = 'error') > 32 AS more FROM staged WHERE name = 'error' ORDER BY object_id, revision LIMIT 32")
def reclaim_page(t):
    rows = t.staged.where("name = 'error'").select("object_id", "revision")
    page = rows.orderBy("object_id", "revision").limit(32)
    probe = rows.limit(33).agg((F.count("*") > 32).alias("more"))
    return page.join(F.broadcast(probe))


@query("SELECT o_orderkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def closed_rows(t):
    retired = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where("o_orderstatus = 'F'").join(retired, "o_custkey", "left_semi").select("o_orderkey")


# -- indexes, staging, guards


@query("SELECT count(*) AS violations FROM (SELECT DISTINCT tenant, parent_id FROM staged WHERE NOT tombstone) s LEFT JOIN live_before b ON b.tenant = s.tenant AND b.object_id = s.parent_id WHERE b.object_id IS NULL")
def referential_check(t):
    asked = asof.live(t.staged).select("tenant", F.col("parent_id").alias("object_id")).distinct()
    return asked.join(asof.live(t.current(t.r1)), ["tenant", "object_id"], "left_anti").agg(F.count("*").alias("violations"))


@query("SELECT c_custkey, coalesce(nullif(a.n, 0), b.n, s.s_suppkey, -1) AS source FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) b ON b.user_id = c_custkey LEFT JOIN supplier s ON s.s_suppkey = c_custkey")
def priority_coalesce(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("a"))
    b = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("b"))
    s = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("s"))
    j = t.customer.select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").join(s, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce(F.nullif(F.col("a"), F.lit(0)), "b", "s", F.lit(-1)).alias("source"))


@query("SELECT tenant, object_id, revision FROM before WHERE tenant <> 2 UNION ALL SELECT tenant, object_id, max(revision) FROM staged WHERE tenant = 2 GROUP BY 1, 2")
def replace_index(t):
    staged = t.staged.where("tenant = 2").groupBy("tenant", "object_id").agg(F.max("revision").alias("revision"))
    return t.current(t.r1).where("tenant <> 2").select("tenant", "object_id", "revision").unionByName(staged)


@query("SELECT DISTINCT lower(hex(encode(name))) AS content FROM staged WHERE NOT tombstone AND hex(encode(name)) > '63' QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1")
def distinct_content(t):
    last = asof.latest(t.staged.where("not tombstone AND hex(name) > '63'"), ["object_id"], "revision")
    return last.select(F.lower(F.hex("name")).alias("content")).distinct()


@query("SELECT s.object_id, s.tenant, b.revision AS predecessor, s.revision, b.revision IS NULL AS first FROM (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1) s JOIN heads USING (tenant) LEFT JOIN before b USING (object_id)")
def stage_targets(t):
    old = t.current(t.r1).select("object_id", F.col("revision").alias("predecessor"))
    rows = asof.latest(t.staged, ["object_id"], "revision").join(t.heads, "tenant").join(old, "object_id", "left")
    return rows.select("object_id", "tenant", "predecessor", "revision", F.col("predecessor").isNull().alias("first"))


@query("SELECT object_id, revision FROM versions v WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.object_id = v.object_id AND b.revision = v.revision) ORDER BY object_id, revision LIMIT 256")
def copy_missing(t):
    have = t.current(t.r1).select("object_id", "revision")
    return t.versions.select("object_id", "revision").join(have, ["object_id", "revision"], "left_anti").orderBy("object_id", "revision").limit(256)


@query("SELECT tenant, head, n_objects, applied FROM heads LEFT JOIN (SELECT tenant, count(*) AS n_objects FROM live_all GROUP BY 1) USING (tenant) LEFT JOIN (SELECT tenant, max(revision) AS applied FROM before WHERE tenant <> 1 GROUP BY 1) USING (tenant)")
def state_lookup(t):
    n = t.live_all.groupBy("tenant").agg(F.count("*").alias("n_objects"))
    applied = t.current(t.r1).where("tenant <> 1").groupBy("tenant").agg(F.max("revision").alias("applied"))
    return t.heads.join(n, "tenant", "left").join(applied, "tenant", "left").select("tenant", "head", "n_objects", "applied")


@query(f"SELECT object_id, revision FROM latest_all v WHERE NOT (tombstone AND revision < {FLOOR} AND NOT EXISTS (SELECT 1 FROM staged s WHERE s.object_id = v.object_id))")
def guarded_delete(t):
    rows = t.latest_all
    gone = rows.where(F.col("tombstone") & (F.col("revision") < t.floor)).join(t.staged, "object_id", "left_anti").select("object_id")
    return rows.join(gone, "object_id", "left_anti").select("object_id", "revision")


@query(f"WITH flat AS (SELECT tenant, object_id, revision FROM copies QUALIFY row_number() OVER (PARTITION BY tenant, object_id, revision ORDER BY source_revision DESC, publication DESC) = 1), kept AS (SELECT * FROM flat WHERE revision >= {FLOOR}) SELECT (SELECT count(*) FROM (SELECT * FROM kept EXCEPT SELECT tenant, object_id, revision FROM versions)) AS extra, (SELECT count(*) FROM (SELECT tenant, object_id, revision FROM versions EXCEPT SELECT * FROM kept)) AS dropped, (SELECT count(*) FROM kept) AS n")
def lineage_flattening(t):
    flat = asof.latest(t.copies, ["tenant", "object_id", "revision"], "source_revision", "publication").select("tenant", "object_id", "revision").where(F.col("revision") >= t.floor)
    sides: DataFrame = diff.set_changed(flat, t.versions.select("tenant", "object_id", "revision"))
    counts = sides.agg(F.count_if(F.col("side") == "removed").alias("extra"), F.count_if(F.col("side") == "added").alias("dropped"))
    return counts.join(F.broadcast(flat.agg(F.count("*").alias("n"))))
