"""The registered queries of the revisioned-catalog operators over the driver's tables, each with its SQL.

Model: events are versions (tenant = user_id % 4, object = user_id, revision = event_id + 1), staged deltas and inbox
records; orders are deliveries and publications; customers, nations and regions are a tree; documents are blobs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions import scalars
from revlake.operators import asof, diff, graph, ingest, mutations, paging, queues, retention
from revlake.plans.store import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Bounds in SQL, as shares of the head revision, so that what is read grows with the table; Tables has them as numbers.
HEAD = "(SELECT max(event_id) + 1 FROM events)"
R1, R2, FLOOR = f"({HEAD} * 2 // 5)", f"({HEAD} * 4 // 5)", f"({HEAD} * 3 // 10)"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def versions(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return self.events.select((u % 4).alias("tenant"), u.alias("object_id"), (e % 7 + u % 3).alias("parent_id"), (e + 1).alias("revision"), F.col("event_type").alias("name"), F.col("value").alias("size"), (F.col("event_type") == "error").alias("tombstone"), (e % 3 != 0).alias("mount"), (e % 2 == 0).alias("provider"))

    @property
    def inbox(self) -> DataFrame:
        b = F.floor(F.col("event_id") / 50)
        return self.events.groupBy(b.alias("sequence")).agg((F.min("event_id") - 1).alias("predecessor"), F.max("event_id").alias("through"), F.sum(F.octet_length("props")).cast("long").alias("bytes"), F.count("*").alias("n_events")).withColumn("authority", F.floor(F.col("sequence") / 10)).withColumn("stream", F.col("sequence") % 3)

    @property
    def checkpoints(self) -> DataFrame:
        return self.inbox.where("sequence % 10 < 4").groupBy("authority", "stream").agg(F.max("through").alias("applied"))

    @property
    def deliveries(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "F", "acked").when(F.col("o_orderstatus") == "O", "pending").otherwise("awaiting")
        return self.orders.select(F.col("o_custkey").alias("presentation"), F.col("o_orderkey").alias("revision"), state.alias("state"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("deadline"))

    @cached_property
    def head(self) -> int:
        return self.events.agg(F.max("event_id")).first()[0] + 1

    @property
    def r1(self) -> int:
        return self.head * 2 // 5

    @property
    def r2(self) -> int:
        return self.head * 4 // 5

    @property
    def floor(self) -> int:
        return self.head * 3 // 10

    @property
    def staged(self) -> DataFrame:
        return self.versions.where(F.col("revision").between(self.r1 + 1, self.r2))

    @property
    def latest_all(self) -> DataFrame:
        return asof.latest(self.versions, ["object_id"], "revision")

    @property
    def live_all(self) -> DataFrame:
        return asof.live(self.latest_all)

    @property
    def containers(self) -> DataFrame:
        return self.staged.where("name = 'click' AND provider AND tenant <> 3").select("tenant", (F.col("tenant") % 2).alias("domain"), F.col("parent_id").alias("container_id")).distinct()

    @property
    def copies(self) -> DataFrame:
        """Versions as they were copied into three publications."""
        v = self.versions
        put = lambda rows, n, plus: rows.select("*", F.lit(n).alias("publication"), (F.col("tenant") * 10 + plus).alias("source_revision"))
        return put(v.where(F.col("revision") <= self.r2), 1, 1).unionByName(put(v.where(F.col("revision") > self.r1), 2, 2)).unionByName(put(v.where("mount"), 3, 2))

    @property
    def heads(self) -> DataFrame:
        return self.versions.groupBy("tenant").agg(F.max("revision").alias("head"))

    def current(self, bound: int) -> DataFrame:
        return asof.as_of(self.versions, ["object_id"], "revision", bound)


#: The same model in SQL.
BASE = {
    "versions": "SELECT user_id % 4 AS tenant, user_id AS object_id, event_id % 7 + user_id % 3 AS parent_id, event_id + 1 AS revision, event_type AS name, value AS size, event_type = 'error' AS tombstone, event_id % 3 <> 0 AS mount, event_id % 2 = 0 AS provider FROM events",
    "inbox": "SELECT *, CAST(floor(sequence / 10) AS BIGINT) AS authority, sequence % 3 AS stream FROM (SELECT CAST(floor(event_id / 50) AS BIGINT) AS sequence, min(event_id) - 1 AS predecessor, max(event_id) AS through, CAST(sum(strlen(props)) AS BIGINT) AS bytes, count(*) AS n_events FROM events GROUP BY 1)",
    "checkpoints": "SELECT authority, stream, max(through) AS applied FROM inbox WHERE sequence % 10 < 4 GROUP BY 1, 2",
    "deliveries": "SELECT o_custkey AS presentation, o_orderkey AS revision, CASE o_orderstatus WHEN 'F' THEN 'acked' WHEN 'O' THEN 'pending' ELSE 'awaiting' END AS state, o_orderdate + INTERVAL 30 DAYS AS deadline FROM orders",
    "before": f"SELECT * FROM versions WHERE revision <= {R1} QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1",
    "after": f"SELECT * FROM versions WHERE revision <= {R2} QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1",
    "staged": f"SELECT * FROM versions WHERE revision > {R1} AND revision <= {R2}",
    "latest_all": "SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1",
    "floors": f"SELECT tenant, min(revision) + {FLOOR} + tenant * {FLOOR} // 6 AS floor FROM versions GROUP BY 1",
    "live_before": "SELECT * FROM before WHERE NOT tombstone",
    "live_after": "SELECT * FROM after WHERE NOT tombstone",
    "live_all": "SELECT * FROM latest_all WHERE NOT tombstone",
    "containers": "SELECT DISTINCT tenant, tenant % 2 AS domain, parent_id AS container_id FROM staged WHERE name = 'click' AND provider AND tenant <> 3",
    "copies": f"SELECT *, 1 AS publication, tenant * 10 + 1 AS source_revision FROM versions WHERE revision <= {R2} UNION ALL SELECT *, 2, tenant * 10 + 2 FROM versions WHERE revision > {R1} UNION ALL SELECT *, 3, tenant * 10 + 2 FROM versions WHERE mount",
    "heads": "SELECT tenant, max(revision) AS head FROM versions GROUP BY 1",
    "publications": "SELECT o_orderkey AS publication, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderkey - 1 END AS predecessor, o_custkey AS authority FROM orders",
    "tree": "SELECT 'R' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name FROM customer",
}


def _with(sql: str) -> str:
    """Adds the definitions that the SQL uses, in order."""
    import re

    used, todo = set(), [sql]
    while todo:
        for name in BASE:
            if name not in used and re.search(rf"\b{name}\b", todo[-1]):
                used.add(name)
                todo.insert(0, BASE[name])
        todo.pop()
    head = ", ".join(f"{n} AS ({BASE[n]})" for n in BASE if n in used)
    recursive = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
    if not head:
        return sql
    body = re.sub(r"^WITH (RECURSIVE )?", ", ", sql)
    return f"WITH {recursive}{head}{'' if body.startswith(',') else ' '}{body}"


def query(sql: str | None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = _with(sql)
        return f

    return add


# -- reads as of a revision, pages


@query("SELECT object_id, parent_id, revision, name, size FROM before WHERE NOT tombstone AND mount AND object_id > 20 ORDER BY object_id LIMIT 51")
def snapshot_page(t):
    return paging.keyset(asof.live(t.current(t.r1)).where("mount"), ["object_id"], (20,), 50).select("object_id", "parent_id", "revision", "name", "size")


@query("SELECT revision, object_id, name FROM versions WHERE tenant = 1 AND (revision > 100 OR (revision = 100 AND object_id > 5)) ORDER BY revision, object_id LIMIT 138")
def changes_since(t):
    return paging.keyset(t.versions.where("tenant = 1"), ["revision", "object_id"], (100, 5), 137).select("revision", "object_id", "name")


@query("SELECT l.item_id % 500 AS position, d.doc_id IS NOT NULL AS found, d.source FROM benchmark l LEFT JOIN documents d ON d.doc_id = l.item_id * 37")
def keyed_lookup(t):
    request = t.benchmark.select((F.col("item_id") % 500).alias("position"), (F.col("item_id") * 37).alias("doc_id"))
    return paging.keyed_lookup(request, t.documents.select("doc_id", "source"), ["doc_id"]).select("position", "found", "source")


@query("SELECT authority, sequence, bytes, running_bytes FROM (SELECT authority, sequence, bytes, CAST(sum(bytes) OVER (PARTITION BY authority ORDER BY sequence) AS BIGINT) AS running_bytes, row_number() OVER (PARTITION BY authority ORDER BY sequence) AS rn FROM inbox) WHERE (running_bytes <= 2000 OR rn = 1) AND rn <= 256")
def byte_bounded_page(t):
    return paging.byte_bounded(t.inbox, "sequence", "bytes", 2000, 256, ["authority"]).select("authority", "sequence", "bytes", "running_bytes")


@query("SELECT tenant, revision, parent_id FROM (SELECT *, lag(parent_id) OVER (PARTITION BY tenant ORDER BY revision) AS p FROM versions) WHERE p IS NOT NULL AND NOT parent_id > p")
def page_order_check(t):
    return paging.order_violations(t.versions, ["tenant"], "revision", ["parent_id"], few_groups=True).select("tenant", "revision", "parent_id")


@query("SELECT object_id, revision, size FROM versions ORDER BY object_id, revision LIMIT 101")
def page_with_lookahead(t):
    return paging.keyset(t.versions, ["object_id", "revision"], None, 100).select("object_id", "revision", "size")


@query("SELECT object_id, parent_id, revision FROM before WHERE NOT tombstone AND parent_id IN (SELECT DISTINCT user_id % 5 FROM events WHERE event_type = 'click')")
def working_set_snapshot(t):
    containers = t.events.where("event_type = 'click'").select((F.col("user_id") % 5).alias("parent_id")).distinct()
    return asof.live(t.current(t.r1)).join(containers, "parent_id", "left_semi").select("object_id", "parent_id", "revision")


@query("SELECT url_kind, parts, n FROM (SELECT split_part(url, '/', 1) AS url_kind, len(string_split(url, '/')) AS parts, count(*) AS n FROM pages GROUP BY 1, 2)")
def path_split(t):
    p = F.split("url", "/")
    return t.pages.groupBy(p[0].alias("url_kind"), F.size(p).cast("long").alias("parts")).agg(F.count("*").alias("n"))


@query("SELECT object_id, revision, name FROM versions WHERE revision IN (SELECT max(revision) FROM versions)")
def head_lookup(t):
    return t.versions.orderBy(F.desc("revision")).limit(1).select("object_id", "revision", "name")


@query("SELECT source, doc_id FROM (SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 40 OFFSET 60)")
def sorted_scan_stage(t):
    return t.documents.select("source", "doc_id").orderBy("source", "doc_id").offset(60).limit(40)


# -- joins and windows over versions


@query("SELECT object_id, revision, name FROM latest_all")
def latest_version(t):
    return asof.latest(t.versions, ["object_id"], "revision").select("object_id", "revision", "name")


@query("SELECT object_id, revision FROM versions v WHERE NOT EXISTS (SELECT 1 FROM versions w WHERE w.object_id = v.object_id AND w.revision > v.revision)")
def latest_no_newer(t):
    return asof.latest(t.versions, ["object_id"], "revision").select("object_id", "revision")


@query("SELECT object_id, revision, name, size FROM before WHERE NOT tombstone")
def as_of_join(t):
    return asof.live(t.current(t.r1)).select("object_id", "revision", "name", "size")


@query("SELECT tenant, object_id, revision FROM versions JOIN floors USING (tenant) WHERE revision <= floor QUALIFY row_number() OVER (PARTITION BY tenant, object_id ORDER BY revision DESC) = 1")
def as_of_floor_join(t):
    floors = t.versions.groupBy("tenant").agg(F.min("revision").alias("m")).select("tenant", (F.col("m") + t.floor + F.floor(F.col("tenant") * t.floor / 6)).alias("floor"))
    return asof.as_of_floor(t.versions, ["tenant", "object_id"], "revision", F.broadcast(floors), "tenant", "floor").select("tenant", "object_id", "revision")


@query("SELECT tenant, object_id, revision, publication FROM copies QUALIFY row_number() OVER (PARTITION BY tenant, object_id, revision ORDER BY source_revision DESC, publication DESC) = 1")
def lineage_version_dedup(t):
    return asof.latest(t.copies, ["tenant", "object_id", "revision"], "source_revision", "publication").select("tenant", "object_id", "revision", "publication")


@query("""SELECT tenant, revision, presentation, scope_parent, kind, object_id, publication FROM (
    SELECT tenant, revision, 1 AS presentation, parent_id AS scope_parent, CASE WHEN tombstone THEN 1 ELSE 2 END AS kind, object_id, publication, source_revision FROM copies WHERE mount
    UNION ALL SELECT tenant, revision, 2, parent_id, CASE WHEN tombstone THEN 1 ELSE 2 END, object_id, publication, source_revision FROM copies WHERE provider)
    QUALIFY row_number() OVER (PARTITION BY tenant, revision, presentation, scope_parent, kind, object_id ORDER BY source_revision DESC, publication DESC) = 1""")
def lineage_change_dedup(t):
    return _changes(t)[0]


def _changes(t) -> tuple[DataFrame, DataFrame]:
    """Change rows of all publications without their copies, and all of them."""
    each = F.explode(F.array_compact(F.array(F.when(F.col("mount"), 1), F.when(F.col("provider"), 2))))
    rows = t.copies.withColumn("presentation", each).withColumn("kind", F.when(F.col("tombstone"), 1).otherwise(2)).withColumnRenamed("parent_id", "scope_parent")
    key = ["tenant", "revision", "presentation", "scope_parent", "kind", "object_id"]
    return asof.latest(rows, key, "source_revision", "publication").select(*key, "publication"), rows


@query("SELECT c.object_id, c.revision, v.name, v.tombstone FROM (SELECT tenant, object_id, revision FROM versions WHERE mount) c JOIN versions v USING (tenant, object_id, revision)")
def change_version_join(t):
    return t.versions.where("mount").select("tenant", "object_id", "revision").join(t.versions, ["tenant", "object_id", "revision"]).select("object_id", "revision", "name", "tombstone")


@query("SELECT tenant, parent_id, revision, CAST(row_number() OVER (PARTITION BY tenant, parent_id ORDER BY revision, name) - 1 AS BIGINT) AS sequence FROM versions")
def change_sequencing(t):
    return asof.numbered(t.versions, ["tenant", "parent_id"], ["revision", "name"], "sequence").select("tenant", "parent_id", "revision", "sequence")


@query("SELECT object_id, kind, CAST(CASE kind WHEN 'upsert' THEN 2147483648 ELSE 0 END + row_number() OVER (PARTITION BY parent_id ORDER BY object_id, revision) - 1 AS BIGINT) AS sequence FROM (SELECT *, CASE WHEN tombstone THEN 'delete' ELSE 'upsert' END AS kind FROM staged)")
def deletes_first(t):
    rows = t.staged.withColumn("kind", F.when(F.col("tombstone"), "delete").otherwise("upsert"))
    numbered = asof.dense_number(rows, ["parent_id"], ["object_id", "revision"], "n")
    return numbered.select("object_id", "kind", (F.col("n") + F.when(F.col("kind") == "upsert", F.lit(2**31)).otherwise(0)).alias("sequence"))


@query("SELECT c_custkey, CAST(1000 + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS ticket FROM customer")
def ticket_allocation(t):
    return queues.tickets(t.customer.select("c_custkey"), "c_custkey", 1000)


@query("WITH q AS (SELECT o_custkey AS owner, min(o_orderkey) AS ticket FROM orders GROUP BY 1), s AS (SELECT owner, row_number() OVER (ORDER BY ticket) AS turn FROM q QUALIFY turn <= 4) SELECT owner, ticket, turn IS NOT NULL AS served, CAST(CASE WHEN turn IS NULL THEN ticket ELSE (SELECT max(ticket) FROM q) + turn END AS BIGINT) AS new_ticket FROM q LEFT JOIN s USING (owner)")
def fair_queue(t):
    return queues.rotated(t.orders.groupBy(F.col("o_custkey").alias("owner")).agg(F.min("o_orderkey").alias("ticket")), "ticket", 4)


# -- aggregates


@query("SELECT count(*) AS violations FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey * 2 WHERE c.c_custkey IS NULL")
def violation_count(t):
    return t.orders.select((F.col("o_custkey") * 2).alias("c_custkey")).join(t.customer, "c_custkey", "left_anti").agg(F.count("*").alias("violations"))


@query("SELECT o_orderstatus, count(*) AS total, count(c.c_custkey) AS matched FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 GROUP BY 1")
def matched_vs_total(t):
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    return t.orders.join(c, "o_custkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("total"), F.count("hit").alias("matched"))


@query("SELECT n_regionkey, count(DISTINCT n_nationkey) AS owners, min(n_name) AS first_owner FROM nation GROUP BY 1")
def distinct_owner_check(t):
    return t.nation.groupBy("n_regionkey").agg(F.count_distinct("n_nationkey").alias("owners"), F.min("n_name").alias("first_owner"))


@query("SELECT authority, count(*) AS n_rows, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS n_bytes, CAST(coalesce(sum(n_events), 0) AS BIGINT) AS n_events FROM inbox GROUP BY 1")
def inbox_measure(t):
    return t.inbox.groupBy("authority").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.sum("n_events").cast("long").alias("n_events"))


@query(f"""WITH lease AS (SELECT DISTINCT tenant, object_id AS domain FROM versions WHERE revision > {R2} AND (tenant < 2 OR name <> 'error')),
    ack AS (SELECT tenant, object_id AS domain, max(revision) AS observed FROM versions WHERE name <> 'error' AND revision > {R1} GROUP BY 1, 2),
    held AS (SELECT tenant, count(*) > count(observed) AS open, min(observed) AS held FROM lease LEFT JOIN ack USING (tenant, domain) GROUP BY 1),
    anchor AS (SELECT tenant, min(revision) AS opened FROM versions WHERE name = 'view' AND revision > {R1} GROUP BY 1),
    applied AS (SELECT tenant, max(revision) AS applied FROM before WHERE tenant <> 1 GROUP BY 1)
    SELECT tenant, CAST(greatest(CASE WHEN applied IS NULL OR coalesce(open, false) THEN {FLOOR} ELSE least(head, applied, coalesce(opened, head), coalesce(held, head)) END, {FLOOR}) AS BIGINT) AS floor
    FROM heads LEFT JOIN applied USING (tenant) LEFT JOIN held USING (tenant) LEFT JOIN anchor USING (tenant)""")
def safe_floor(t):
    v = t.versions
    leases = v.where((F.col("revision") > t.r2) & F.expr("tenant < 2 OR name <> 'error'")).select("tenant", F.col("object_id").alias("domain")).distinct()
    seen = v.where((F.col("revision") > t.r1) & (F.col("name") != "error")).groupBy("tenant", F.col("object_id").alias("domain")).agg(F.max("revision").alias("observed"))
    applied = t.current(t.r1).where("tenant <> 1").groupBy("tenant").agg(F.max("revision").alias("applied"))
    tenants = t.heads.join(applied, "tenant", "left").withColumn("floor", F.lit(t.floor))
    return retention.safe_floor(tenants, [v.where((F.col("name") == "view") & (F.col("revision") > t.r1)).select("tenant", F.col("revision").alias("at"))], leases, seen)


@query("SELECT user_id, sha256(string_agg(strlen(CAST(event_id AS VARCHAR)) || ':' || event_id || strlen(event_type) || ':' || event_type, '' ORDER BY event_id)) AS fingerprint FROM events GROUP BY 1")
def ordered_fingerprint(t):
    return t.events.groupBy("user_id").agg(scalars.ordered_fingerprint(F.col("event_id"), F.col("event_type")).alias("fingerprint"))


@query("SELECT conv_id, list_reduce(list_prepend('', list(text ORDER BY turn, text)), lambda s, x: sha256(s || x)) AS digest FROM conversations GROUP BY 1")
def chained_digest(t):
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.select("conv_id", F.aggregate("r", F.lit(""), lambda s, x: F.sha2(F.concat(s, x["text"]).cast("binary"), 256)).alias("digest"))


@query("SELECT tenant FROM (SELECT tenant, bit_or(CAST(CASE name WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 0 END AS BIGINT)) AS bits, count(DISTINCT object_id) AS n, bool_and(size > -1000000) AS fine FROM versions GROUP BY 1) WHERE bits & 3 = 3 AND n > 1 AND fine")
def all_backends_ready(t):
    bit = F.when(F.col("name") == "click", 1).when(F.col("name") == "view", 2).when(F.col("name") == "purchase", 4).otherwise(0)
    return t.versions.groupBy("tenant").agg(F.bit_or(bit).alias("bits"), F.count_distinct("object_id").alias("n"), F.bool_and(F.col("size") > -1000000).alias("fine")).where("bits & 3 = 3 AND n > 1 AND fine").select("tenant")


@query("SELECT object_id, bool_and(parent_id < 6) AS suppressed FROM versions GROUP BY 1")
def origin_suppressed(t):
    return t.versions.groupBy("object_id").agg(F.bool_and(F.col("parent_id") < 6).alias("suppressed"))


# -- diffs and merges


@query(f"""SELECT a.object_id, a.parent_id, a.name, a.mount, a.provider, a.size, CASE WHEN b.parent_id = a.parent_id AND b.name = a.name AND b.mount = a.mount AND b.provider = a.provider THEN b.revision ELSE {R2} END AS metadata_revision, CASE WHEN b.size = a.size THEN b.revision ELSE {R2} END AS content_revision,
    NOT coalesce(b.parent_id = a.parent_id AND b.name = a.name AND b.mount = a.mount AND b.provider = a.provider AND b.size = a.size, false) AS changed FROM after a LEFT JOIN before b USING (object_id)""")
def after_image(t):
    now = t.current(t.r1).withColumn("metadata_revision", F.col("revision")).withColumn("content_revision", F.col("revision"))
    return diff.after_image(t.current(t.r2), now, ["object_id"], ["parent_id", "name", "mount", "provider"], ["size"], t.r2)


@query("""SELECT object_id, p AS presentation, scope_parent, kind FROM (
    SELECT coalesce(o.object_id, n.object_id) AS object_id, 0 AS p, o.parent_id AS scope_parent, 'delete' AS kind FROM (SELECT * FROM before WHERE NOT tombstone) o FULL JOIN (SELECT * FROM after WHERE NOT tombstone) n USING (object_id) WHERE coalesce(o.mount, false) AND (NOT coalesce(n.mount, false) OR o.parent_id IS DISTINCT FROM n.parent_id)
    UNION ALL SELECT coalesce(o.object_id, n.object_id), 0, n.parent_id, 'upsert' FROM (SELECT * FROM before WHERE NOT tombstone) o FULL JOIN (SELECT * FROM after WHERE NOT tombstone) n USING (object_id) WHERE coalesce(n.mount, false) AND (NOT coalesce(o.mount, false) OR o.parent_id IS DISTINCT FROM n.parent_id OR o.revision IS DISTINCT FROM n.revision)
    UNION ALL SELECT coalesce(o.object_id, n.object_id), 1, o.parent_id, 'delete' FROM (SELECT * FROM before WHERE NOT tombstone) o FULL JOIN (SELECT * FROM after WHERE NOT tombstone) n USING (object_id) WHERE coalesce(o.provider, false) AND (NOT coalesce(n.provider, false) OR o.parent_id IS DISTINCT FROM n.parent_id)
    UNION ALL SELECT coalesce(o.object_id, n.object_id), 1, n.parent_id, 'upsert' FROM (SELECT * FROM before WHERE NOT tombstone) o FULL JOIN (SELECT * FROM after WHERE NOT tombstone) n USING (object_id) WHERE coalesce(n.provider, false) AND (NOT coalesce(o.provider, false) OR o.parent_id IS DISTINCT FROM n.parent_id OR o.revision IS DISTINCT FROM n.revision))""")
def change_events(t):
    return diff.change_events(asof.live(t.current(t.r1)), asof.live(t.current(t.r2)), ["object_id"], "parent_id", ["mount", "provider"], ~F.col("old.revision").eqNullSafe(F.col("new.revision")))


@query("SELECT a.object_id, a.revision FROM before a WHERE NOT a.tombstone AND NOT EXISTS (SELECT 1 FROM after b WHERE b.object_id = a.object_id AND NOT b.tombstone)")
def vanished_objects(t):
    return asof.live(t.current(t.r1)).join(asof.live(t.current(t.r2)), "object_id", "left_anti").select("object_id", "revision")


@query("SELECT a.tenant FROM (SELECT tenant, CAST(sum(revision) AS BIGINT) AS s FROM after GROUP BY 1) a LEFT JOIN (SELECT tenant, CAST(sum(revision) AS BIGINT) AS s FROM before GROUP BY 1) b USING (tenant) WHERE a.s IS DISTINCT FROM b.s")
def changed_tenants(t):
    s = lambda df: df.groupBy("tenant").agg(F.sum("revision").alias("fingerprint"))
    return diff.unchanged_suppressed(s(t.current(t.r2)), s(t.current(t.r1)), ["tenant"], "fingerprint").select("tenant")


@query("SELECT object_id, name, size FROM before b WHERE object_id NOT IN (SELECT object_id FROM staged) UNION ALL SELECT object_id, name, size FROM (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1) WHERE NOT tombstone")
def latest_action_merge(t):
    staged = t.staged.withColumn("action", F.when(F.col("tombstone"), "delete").otherwise("upsert"))
    return diff.merge_latest(t.current(t.r1).select("object_id", "name", "size"), staged, ["object_id"], "revision", "action")


@query("SELECT l_partkey % 100 AS k, 'removed' AS side FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 100 NOT IN (SELECT l_suppkey % 60 FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1 UNION ALL SELECT l_suppkey % 60, 'added' FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey % 60 NOT IN (SELECT l_partkey % 100 FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1")
def set_changed(t):
    a = t.lineitem.where("l_returnflag = 'A'").select((F.col("l_partkey") % 100).alias("k"))
    return diff.set_changed(a, t.lineitem.where("l_returnflag = 'N'").select((F.col("l_suppkey") % 60).alias("k")))


@query("SELECT count(*) FILTER (b.object_id IS NULL) AS added, (SELECT count(*) FROM before x WHERE NOT EXISTS (SELECT 1 FROM after y WHERE y.object_id = x.object_id AND y.parent_id = x.parent_id)) AS removed FROM after a LEFT JOIN before b ON a.object_id = b.object_id AND a.parent_id = b.parent_id")
def set_diff(t):
    a, b = (t.current(r).select("object_id", "parent_id") for r in (t.r1, t.r2))
    both = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), ["object_id", "parent_id"], "full_outer")
    return both.agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"))


@query("SELECT parent_id, count(DISTINCT name) AS variants FROM staged GROUP BY 1 HAVING count(DISTINCT name) > 1")
def plan_merge_conflicts(t):
    return diff.plan_conflicts(t.staged, ["parent_id"], "name")


@query("SELECT a.object_id, a.name FROM after a LEFT JOIN before b USING (object_id) WHERE a.name IS DISTINCT FROM b.name")
def suppress_unchanged(t):
    return diff.unchanged_suppressed(t.current(t.r2), t.current(t.r1), ["object_id"], "name").select("object_id", "name")


@query("""WITH plan AS (SELECT object_id AS logical, parent_id AS input, provider AS by_provider FROM staged),
    ext AS (SELECT DISTINCT parent_id AS input FROM staged WHERE name = 'error'), prov AS (SELECT DISTINCT parent_id AS input FROM staged WHERE provider AND name = 'purchase')
    SELECT logical, bool_or(p.input IS NOT NULL) AND NOT bool_or(e.input IS NOT NULL) AND bool_and(by_provider) AS provider_caused
    FROM plan LEFT JOIN ext e USING (input) LEFT JOIN prov p USING (input) GROUP BY 1""")
def causal_partition(t):
    plan = t.staged.select(F.col("object_id").alias("logical"), F.col("parent_id").alias("input"), F.col("provider").alias("by_provider"))
    paths = lambda where: t.staged.where(where).select(F.col("parent_id").alias("input")).distinct()
    return diff.causal_partition(plan, paths("name = 'error'"), paths("provider AND name = 'purchase'"))


@query("WITH last AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1) SELECT object_id, revision, name FROM before WHERE object_id NOT IN (SELECT object_id FROM last) UNION ALL SELECT object_id, revision, name FROM last WHERE NOT tombstone")
def index_merge(t):
    last = asof.latest(t.staged, ["object_id"], "revision")
    return diff.index_merge(t.current(t.r1).select("object_id", "revision", "name"), last.where("tombstone"), asof.live(last), ["object_id"])


@query("SELECT b.object_id, coalesce(a.size, b.size) AS size FROM before b LEFT JOIN after a ON a.object_id = b.object_id AND a.revision > b.revision")
def correlated_update(t):
    new = t.current(t.r2).select("object_id", F.col("revision").alias("r"), F.col("size").alias("s"))
    return t.current(t.r1).join(new, "object_id", "left").select("object_id", F.when(F.col("r") > F.col("revision"), F.coalesce("s", "size")).otherwise(F.col("size")).alias("size"))


@query("""SELECT p.object_id, 'live_child' AS problem FROM after p WHERE p.tombstone AND p.revision > """ + R1 + """ AND EXISTS (SELECT 1 FROM live_before c WHERE c.tenant = p.tenant AND c.parent_id = p.object_id AND c.object_id NOT IN (SELECT object_id FROM staged))
    UNION ALL SELECT p.object_id, 'name_taken' FROM live_after p WHERE p.revision > """ + R1 + """ AND p.mount AND EXISTS (SELECT 1 FROM live_before c WHERE c.tenant = p.tenant AND c.parent_id = p.parent_id AND c.name = p.name AND c.mount AND c.object_id NOT IN (SELECT object_id FROM staged))
    UNION ALL SELECT p.object_id, 'no_parent' FROM live_after p WHERE p.revision > """ + R1 + """ AND NOT EXISTS (SELECT 1 FROM live_after c WHERE c.tenant = p.tenant AND c.object_id = p.parent_id)""")
def prepared_conflicts(t):
    prepared = t.current(t.r2).where(F.col("revision") > t.r1)
    foreign = asof.live(t.current(t.r1)).join(t.staged.select("object_id"), "object_id", "left_anti")
    return diff.prepared_conflicts(prepared, foreign, asof.live(t.current(t.r2)))


@query("SELECT tenant, parent_id, name, count(*) AS n FROM after WHERE NOT tombstone AND mount GROUP BY 1, 2, 3 HAVING count(*) > 1")
def live_name_conflicts(t):
    return asof.live(t.current(t.r2)).where("mount").groupBy("tenant", "parent_id", "name").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT v.object_id, v.revision FROM versions v JOIN before b USING (object_id) JOIN floors f ON f.tenant = v.tenant WHERE v.revision <= b.revision AND v.revision <= f.floor")
def anchor_copy(t):
    floors = t.versions.groupBy("tenant").agg(F.min("revision").alias("m")).select("tenant", (F.col("m") + t.floor + F.floor(F.col("tenant") * t.floor / 6)).alias("floor"))
    heads = t.current(t.r1).select("object_id", F.col("revision").alias("head"))
    return t.versions.join(heads, "object_id").join(F.broadcast(floors), "tenant").where("revision <= head AND revision <= floor").select("object_id", "revision")


@query("SELECT object_id, count(*) AS n FROM (SELECT object_id FROM before WHERE NOT tombstone UNION ALL SELECT object_id FROM after WHERE NOT tombstone AND provider) GROUP BY 1 HAVING count(*) <> 1")
def exactly_one_binding(t):
    both = asof.live(t.current(t.r1)).select("object_id").unionByName(asof.live(t.current(t.r2)).where("provider").select("object_id"))
    return both.groupBy("object_id").agg(F.count("*").alias("n")).where("n <> 1")


@query("SELECT a.object_id FROM after a JOIN before b USING (object_id) WHERE a.parent_id <> b.parent_id")
def binding_conflicts(t):
    old = t.current(t.r1).select("object_id", F.col("parent_id").alias("was"))
    return t.current(t.r2).join(old, "object_id").where("parent_id <> was").select("object_id")


@query("SELECT k, arg_min(origin, priority) AS origin FROM (SELECT o_custkey AS k, 'order' AS origin, 1 AS priority FROM orders UNION ALL SELECT c_custkey, 'customer', 2 FROM customer) GROUP BY 1")
def first_non_empty(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin"), F.lit(1).alias("priority")).unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"), F.lit(2).alias("priority")))
    return rows.groupBy("k").agg(F.min_by("origin", "priority").alias("origin"))


@query("SELECT object_id FROM before UNION SELECT object_id FROM staged")
def candidate_keys(t):
    return t.current(t.r1).select("object_id").union(t.staged.select("object_id")).distinct()


# -- graphs


@query("WITH RECURSIVE up(publication, predecessor, depth) AS (SELECT publication, predecessor, 0 FROM publications WHERE publication = 39 UNION ALL SELECT p.publication, p.predecessor, depth + 1 FROM publications p JOIN up ON p.publication = up.predecessor) SELECT publication, CAST(depth AS INTEGER) AS depth FROM up")
def publication_lineage(t):
    edges = t.orders.select(F.col("o_orderkey").alias("child"), F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderkey") - 1).alias("parent"))
    known = t.orders.select(F.col("o_orderkey").alias("node"))
    found = graph.lineage(edges, known.where("node = 39"))
    return found.join(known, "node", "left_semi").select(F.col("node").alias("publication"), "depth")


@query("WITH RECURSIVE up(node) AS (SELECT node FROM tree WHERE node LIKE 'C%' AND name LIKE '%1' UNION SELECT t.parent FROM tree t JOIN up ON t.node = up.node WHERE t.parent IS NOT NULL) SELECT node FROM up")
def active_publications(t):
    tree = _tree(t)
    return graph.closure(tree.select(F.col("node").alias("child"), "parent"), tree.where("node LIKE 'C%' AND name LIKE '%1'").select("node")).select("node")


def _tree(t) -> DataFrame:
    r = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("node"), F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


@query("WITH RECURSIVE down(node) AS (SELECT node FROM tree WHERE parent IS NULL AND node <> 'R1' UNION ALL SELECT t.node FROM tree t JOIN down ON t.parent = down.node) SELECT (SELECT count(*) FROM tree) - count(*) AS unreached FROM down")
def tree_cycle_check(t):
    tree = _tree(t)
    seen = graph.closure(tree.select(F.col("parent").alias("child"), F.col("node").alias("parent")), tree.where("parent IS NULL AND node <> 'R1'").select("node"))
    return graph.unreachable(tree.select("node"), seen).agg(F.count("*").alias("unreached"))


@query("SELECT c.node AS leaf, r.name || '/' || n.name || '/' || c.name AS path FROM tree c JOIN tree n ON c.parent = n.node JOIN tree r ON n.parent = r.node")
def resolve_path(t):
    tree = _tree(t)
    up = lambda a: tree.select(F.col("node").alias(f"{a}_node"), F.col("parent").alias(f"{a}_parent"), F.col("name").alias(f"{a}_name"))
    paths = up("c").join(up("n"), F.col("c_parent") == F.col("n_node")).join(up("r"), F.col("n_parent") == F.col("r_node"))
    paths = paths.select(F.col("c_node").alias("request"), F.array("r_name", "n_name", "c_name").alias("parts"), F.lit("").alias("at"))
    entries = tree.select(F.coalesce("parent", F.lit("")).alias("parent"), "name", "node")
    return graph.resolve(paths, entries, 3).select(F.col("at").alias("leaf"), F.array_join("parts", "/").alias("path"))


@query("SELECT parent_id, count(*) AS children FROM after WHERE NOT tombstone GROUP BY 1")
def child_count(t):
    return graph.child_count(asof.live(t.current(t.r2)), "parent_id")


@query("SELECT p.object_id FROM before p WHERE p.tombstone AND EXISTS (SELECT 1 FROM after c WHERE c.parent_id = p.object_id AND NOT c.tombstone)")
def orphan_guard(t):
    return t.current(t.r1).where("tombstone").join(asof.live(t.current(t.r2)).select(F.col("parent_id").alias("object_id")), "object_id", "left_semi").select("object_id")


# -- inbox and streams, in batch form


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS ordinal FROM events WHERE event_id > 100")
def event_ordinal(t):
    return asof.dense_number(t.events.where("event_id > 100"), ["user_id", "event_type"], ["event_id"], "ordinal").select("user_id", "event_id", "ordinal")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL AND NOT turn > p")
def batch_order_check(t):
    return paging.order_violations(t.conversations, ["conv_id"], "turn", ["turn"]).select("conv_id", "turn")


@query("SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS expected FROM conversations WHERE turn <> 2) WHERE expected IS NOT NULL AND turn <> expected")
def gap_detection(t):
    return ingest.gaps(t.conversations.where("turn <> 2"), ["conv_id"], "turn").select("conv_id", "turn", "expected")


@query("SELECT authority, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS n_bytes, count(*) > 8 OR sum(bytes) > 5000 AS overflow FROM inbox GROUP BY 1")
def inbox_quota(t):
    return ingest.quota(t.inbox, "authority", 8, "bytes", 5000)


@query("SELECT authority, greatest(coalesce(min(CASE WHEN coalesce(applied, -1) < through THEN sequence END) - 1, max(sequence)), max(CASE WHEN authority % 2 = 0 THEN authority * 10 + 5 END)) AS watermark FROM inbox LEFT JOIN checkpoints USING (authority, stream) GROUP BY 1")
def contiguous_watermark(t):
    stored = t.inbox.where("authority % 2 = 0").select("authority", (F.col("authority") * 10 + 5).alias("floor")).distinct()
    return ingest.contiguous_watermark(t.inbox, t.checkpoints, "authority", "stream", stored)


@query("SELECT authority, sequence, stream FROM inbox LEFT JOIN checkpoints USING (authority, stream) WHERE coalesce(applied, -1) < through QUALIFY row_number() OVER (PARTITION BY authority ORDER BY sequence) = 1")
def next_inbox_record(t):
    return ingest.next_record(t.inbox, t.checkpoints, "authority", "stream")


@query("SELECT authority, min(sequence) AS sequence FROM inbox i WHERE NOT EXISTS (SELECT 1 FROM checkpoints c WHERE c.authority = i.authority AND c.stream = i.stream AND c.applied >= i.through) GROUP BY 1")
def next_unapplied(t):
    return ingest.next_record(t.inbox, t.checkpoints, "authority", "stream").select("authority", "sequence")


@query("WITH ops AS (SELECT DISTINCT user_id % 50 AS op, event_type AS path, user_id % 50 * 100 AS start, user_id % 50 * 100 + 60 AS stop FROM events), seen AS (SELECT op, count(DISTINCT o.path) AS seen FROM ops o JOIN events e ON e.event_type = o.path AND e.event_id > o.start AND e.event_id <= o.stop GROUP BY 1) SELECT op, count(DISTINCT path) AS wanted, coalesce(max(seen), 0) AS seen, coalesce(max(seen), 0) = count(DISTINCT path) AS matched FROM ops LEFT JOIN seen USING (op) GROUP BY 1")
def echo_correlation(t):
    u = F.col("user_id") % 50
    ops = t.events.select(u.alias("op"), F.col("event_type").alias("path"), (u * 100).alias("start"), (u * 100 + 60).alias("stop")).distinct()
    return ingest.echoes(t.events.select(F.col("event_type").alias("path"), F.col("event_id").alias("sequence")), ops, "path")


@query("SELECT event_id, CASE WHEN event_id & 1 <> 0 THEN 'removed' WHEN event_id & 2 <> 0 THEN 'renamed' WHEN event_id & 4 <> 0 THEN 'created' WHEN event_id & 8 <> 0 THEN 'modified' ELSE 'metadata' END AS kind FROM events")
def event_kind(t):
    return t.events.select("event_id", scalars.event_kind(F.col("event_id")).alias("kind"))


@query("SELECT r.tenant, latest_desired, count(*) FILTER (q.revision <= a.applied) AS released FROM (SELECT tenant, max(revision) AS latest_desired FROM versions GROUP BY 1) r JOIN versions q USING (tenant) JOIN (SELECT tenant, max(revision) AS applied FROM before GROUP BY 1) a USING (tenant) GROUP BY 1, 2")
def coalesce_waiters(t):
    return queues.coalesced(t.versions, "tenant", "revision", t.current(t.r1).groupBy("tenant").agg(F.max("revision").alias("applied")))


# -- deliveries


@query("""WITH q AS (SELECT presentation, revision, CASE WHEN state = 'awaiting' AND revision < (SELECT max(revision) FROM deliveries WHERE state = 'awaiting') THEN 'acked' ELSE state END AS state FROM deliveries)
    SELECT presentation, revision FROM q c WHERE state = 'pending' AND (SELECT count(*) FROM q WHERE state = 'awaiting') < 2
    AND NOT EXISTS (SELECT 1 FROM q a WHERE a.presentation = c.presentation AND a.state = 'awaiting')
    AND NOT EXISTS (SELECT 1 FROM q n WHERE n.presentation = c.presentation AND n.state = 'pending' AND n.revision > c.revision)
    ORDER BY revision, presentation LIMIT 1""")
def outbox_claim(t):
    # all but the newest awaited delivery have been acknowledged, so one place of the window of two is taken
    last = t.deliveries.where("state = 'awaiting'").agg(F.max("revision").alias("_last"))
    state = F.when((F.col("state") == "awaiting") & (F.col("revision") < F.col("_last")), "acked").otherwise(F.col("state"))
    rows = t.deliveries.join(F.broadcast(last)).withColumn("state", state)
    return queues.claimable(rows, "presentation", "revision", "state", 2, ("awaiting",)).select("presentation", "revision")


@query("SELECT presentation, revision, CASE WHEN state = 'pending' AND revision < max(revision) OVER (PARTITION BY presentation) THEN 'superseded' ELSE state END AS new_state FROM deliveries")
def outbox_supersede(t):
    return queues.superseded(t.deliveries, "presentation", "revision", "state").select("presentation", "revision", "new_state")


@query("SELECT presentation, revision FROM deliveries WHERE state = 'awaiting' AND deadline <= TIMESTAMP '1996-01-01'")
def expired_deliveries(t):
    return queues.expired(t.deliveries, "deadline", F.lit("1996-01-01").cast("timestamp"), "state", ("awaiting",)).select("presentation", "revision")


@query("SELECT DISTINCT parent_id FROM staged WHERE parent_id IN (SELECT user_id % 5 FROM events)")
def signal_targets(t):
    held = t.events.select((F.col("user_id") % 5).alias("parent_id")).distinct()
    return t.staged.select("parent_id").distinct().join(held, "parent_id", "left_semi")


@query("SELECT revision, object_id FROM versions WHERE revision >= (SELECT max(revision) - 4096 + 1 FROM versions)")
def topology_changes(t):
    head = t.versions.agg(F.max("revision").alias("head"))
    return t.versions.join(F.broadcast(head)).where("revision >= head - 4095").select("revision", "object_id")


@query("""WITH act AS (SELECT o_custkey AS presentation, o_orderkey AS activation FROM orders WHERE o_orderstatus = 'O'), cause AS (SELECT DISTINCT l_orderkey AS activation, l_suppkey % 5 AS cause FROM lineitem),
    newest AS (SELECT presentation, max(activation) AS newer FROM act GROUP BY 1)
    SELECT presentation, newer, count(*) AS missing FROM (SELECT DISTINCT n.presentation, n.newer, c.cause FROM newest n JOIN act a ON a.presentation = n.presentation AND a.activation < n.newer JOIN cause c ON c.activation = a.activation
    WHERE NOT EXISTS (SELECT 1 FROM cause x WHERE x.activation = n.newer AND x.cause = c.cause)) GROUP BY 1, 2""")
def causes_superset(t):
    act = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("presentation"), F.col("o_orderkey").alias("activation"), F.col("o_orderkey").alias("revision"))
    return queues.not_included(t.lineitem.select(F.col("l_orderkey").alias("activation"), (F.col("l_suppkey") % 5).alias("cause")).distinct(), act)


# -- retention


@query("""WITH v AS (SELECT tenant, object_id, revision, name FROM copies QUALIFY row_number() OVER (PARTITION BY tenant, object_id, revision ORDER BY source_revision DESC, publication DESC) = 1),
    change AS (SELECT DISTINCT object_id, revision FROM copies JOIN floors USING (tenant) WHERE mount AND revision > floor AND publication = 3)
    SELECT v.object_id, v.revision FROM v JOIN floors f USING (tenant) WHERE v.revision >= f.floor
    OR v.revision = (SELECT max(b.revision) FROM v b WHERE b.tenant = v.tenant AND b.object_id = v.object_id AND b.revision <= f.floor)
    OR EXISTS (SELECT 1 FROM v h WHERE h.name = 'purchase' AND h.object_id = v.object_id AND h.revision = v.revision)
    OR EXISTS (SELECT 1 FROM change c WHERE c.object_id = v.object_id AND c.revision = v.revision)""")
def retained_versions(t):
    v = asof.latest(t.copies, ["tenant", "object_id", "revision"], "source_revision", "publication").select("tenant", "object_id", "revision", "name")
    changes = t.copies.where("mount AND publication = 3").join(F.broadcast(_floors(t)), "tenant").where("revision > floor").select("object_id", "revision")
    return retention.retained_versions(v, F.broadcast(_floors(t)), ["object_id"], "revision", [v.where("name = 'purchase'"), changes]).select("object_id", "revision")


def _floors(t) -> DataFrame:
    return t.versions.groupBy("tenant").agg(F.min("revision").alias("m")).select("tenant", (F.col("m") + t.floor + F.floor(F.col("tenant") * t.floor / 6)).alias("floor"))


@query("""SELECT tenant, revision, scope_parent, object_id, publication FROM (SELECT tenant, revision, parent_id AS scope_parent, CASE WHEN tombstone THEN 1 ELSE 2 END AS kind, object_id, publication, source_revision FROM copies WHERE mount)
    JOIN floors USING (tenant) WHERE revision > floor QUALIFY row_number() OVER (PARTITION BY tenant, revision, scope_parent, kind, object_id ORDER BY source_revision DESC, publication DESC) = 1""")
def retained_changes(t):
    rows = _changes(t)[1].where("presentation = 1").join(F.broadcast(_floors(t)), "tenant").where("revision > floor")
    return asof.latest(rows, ["tenant", "revision", "scope_parent", "kind", "object_id"], "source_revision", "publication").select("tenant", "revision", "scope_parent", "object_id", "publication")


@query("SELECT publication FROM publications WHERE publication NOT IN (SELECT predecessor FROM publications WHERE predecessor IS NOT NULL) AND publication NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orphan_publications(t):
    p = t.orders.select(F.col("o_orderkey").alias("publication"))
    before = t.orders.where("o_orderkey % 40 <> 0").select((F.col("o_orderkey") - 1).alias("publication"))
    return retention.unreferenced(p, "publication", before, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("publication")))


@query("SELECT object_id, revision FROM latest_all WHERE tombstone AND object_id NOT IN (SELECT parent_id FROM latest_all WHERE NOT tombstone) AND object_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tombstone_gc(t):
    now = asof.latest(t.versions, ["object_id"], "revision")
    return retention.unreferenced(now.where("tombstone"), "object_id", asof.live(now).select(F.col("parent_id").alias("object_id")), t.labels.where("toxic = 1").select(F.col("doc_id").alias("object_id"))).select("object_id", "revision")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def unreferenced_blobs(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return retention.unreferenced(d.select("hash").distinct(), "hash", d.join(t.labels, "doc_id", "left_semi").select("hash"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT item_id FROM benchmark) AS referenced FROM documents")
def blob_referenced(t):
    used = t.labels.select("doc_id").unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"))).distinct().withColumn("hit", F.lit(True))
    return t.documents.select("doc_id").join(used, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("referenced"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION ALL SELECT s_suppkey FROM supplier)")
def authority_referenced(t):
    used = t.orders.select(F.col("o_custkey").alias("c_custkey")).unionByName(t.supplier.select(F.col("s_suppkey").alias("c_custkey")))
    return t.customer.select("c_custkey").join(used, "c_custkey", "left_semi")


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderkey > o.o_orderkey) AND o_orderstatus = 'F'")
def compactable_operations(t):
    return retention.has_newer(t.orders, ["o_custkey"], "o_orderkey").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")


@query("SELECT object_id, revision FROM versions v WHERE name = 'click' AND EXISTS (SELECT 1 FROM versions n WHERE n.object_id = v.object_id AND n.name = 'click' AND n.revision > v.revision)")
def compactable_attempts(t):
    return retention.has_newer(t.versions.where("name = 'click'"), ["object_id"], "revision").select("object_id", "revision")


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE (c_mktsegment IS NULL OR c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def compactable_mutations(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").where("c_mktsegment IS NULL OR c_mktsegment = 'BUILDING'").select("o_orderkey")
    return retention.unreferenced(rows, "o_orderkey", t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), t.events.where("event_type = 'error'").select(F.col("event_id").alias("o_orderkey")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def retired_owners(t):
    return retention.unreferenced(t.customer.select("c_custkey"), "c_custkey", t.orders.select(F.col("o_custkey").alias("c_custkey")), t.supplier.select(F.col("s_suppkey").alias("c_custkey")))


@query("SELECT object_id FROM before WHERE object_id NOT IN (SELECT object_id FROM staged WHERE name = 'purchase' AND mount)")
def retiring_members(t):
    return t.current(t.r1).join(t.staged.where("name = 'purchase' AND mount"), "object_id", "left_anti").select("object_id")


@query("SELECT o.o_custkey, count(*) AS missing FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 7) GROUP BY 1")
def missing_retirements(t):
    receipts = t.lineitem.where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(receipts, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("missing"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey > 50 ORDER BY o_orderkey LIMIT 101")
def committed_targets(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return paging.keyset(j, ["o_orderkey"], (50,), 100).select("o_orderkey", "c_name", "n_name")


@query("SELECT kind, id FROM (SELECT 'supplier' AS kind, s_suppkey AS id FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer) ORDER BY kind, id LIMIT 101")
def retained_identities(t):
    both = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")).unionByName(t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))
    return paging.keyset(both, ["kind", "id"], None, 100)


@query("SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def prior_owner(t):
    busy = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return t.customer.join(busy, "c_custkey", "left").where("c_acctbal < 0 OR hit").select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN l.n IS NULL THEN 'drop' WHEN o_orderstatus = 'F' THEN 'settle' ELSE 'keep' END AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) l ON l_orderkey = o_orderkey")
def expectation_settlement(t):
    seen = t.lineitem.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.join(seen, "o_orderkey", "left").select("o_orderkey", F.when(F.col("n").isNull(), "drop").when(F.col("o_orderstatus") == "F", "settle").otherwise("keep").alias("outcome"))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 WHERE c_custkey IS NULL OR (o_orderstatus NOT IN ('F', 'O') AND c_acctbal > 0)")
def settlement_violations(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    return t.orders.join(c, F.col("c_custkey") == F.col("o_custkey") * 2, "left").where("c_custkey IS NULL OR (o_orderstatus NOT IN ('F', 'O') AND c_acctbal > 0)").select("o_orderkey")


@query("SELECT count(*) AS valid FROM (SELECT DISTINCT user_id % 40 AS object_id FROM events) s JOIN after a USING (object_id) WHERE NOT a.tombstone AND a.provider")
def valid_containers(t):
    staged = t.events.select((F.col("user_id") % 40).alias("object_id")).distinct()
    return asof.live(t.current(t.r2)).where("provider").join(staged, "object_id", "left_semi").agg(F.count("*").alias("valid"))


@query("SELECT (SELECT count(*) FROM (SELECT object_id, revision FROM before EXCEPT SELECT object_id, revision FROM after)) AS lost, (SELECT count(*) FROM (SELECT object_id, revision FROM after EXCEPT SELECT object_id, revision FROM before)) AS gained")
def compaction_validate(t):
    a, b = (t.current(r).select("object_id", "revision") for r in (t.r1, t.r2))
    return diff.set_changed(a, b).agg(F.count_if(F.col("side") == "removed").alias("lost"), F.count_if(F.col("side") == "added").alias("gained"))


# -- scalars


@query("""WITH n AS (SELECT n_nationkey, unnest([n_name, n_name || 'É', n_name || 'e' || chr(769), n_name || 'Straße', n_name || 'ΣΊΣΥΦΟΣ']) AS name FROM nation)
    SELECT name, CASE WHEN n_nationkey % 3 = 0 THEN nfc_normalize(name) ELSE replace(replace(lower(nfc_normalize(name)), 'ß', 'ss'), 'ς', 'σ') END AS key FROM n""")
def name_key(t):
    n = F.col("n_name")
    names = F.array(n, F.concat(n, F.lit("É")), F.concat(n, F.lit("e\u0301")), F.concat(n, F.lit("Straße")), F.concat(n, F.lit("ΣΊΣΥΦΟΣ")))
    return t.nation.select("n_nationkey", F.explode(names).alias("name")).select("name", scalars.name_key(F.col("name"), F.col("n_nationkey") % 3 == 0).alias("key"))


@query("SELECT event_id, substr(sha256('revlake.object' || chr(0) || CAST(event_id AS VARCHAR)), 1, 32) AS object_id FROM events")
def derive_object_id(t):
    return t.events.select("event_id", scalars.object_id(F.col("event_id").cast("string").cast("binary")).alias("object_id"))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS encoded, octet_length(unhex(substr(sha256(text), 1, 32))) AS n_bytes, true AS same, doc_id & 5 <> 0 AS member FROM documents")
def identity_codec(t):
    raw = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    encoded = F.lower(F.hex(raw))
    return t.documents.select("doc_id", encoded.alias("encoded"), F.octet_length(F.unhex(encoded)).cast("long").alias("n_bytes"), (F.unhex(encoded) == raw).alias("same"), (F.col("doc_id").bitwiseAND(5) != 0).alias("member"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH r AS (SELECT o_orderkey AS request, o_custkey % 4 AS tenant, o_orderkey // 2 AS mutation, o_orderpriority AS digest FROM orders),
    o AS (SELECT *, CASE WHEN request = min(request) OVER (PARTITION BY mutation) AND mutation NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'apply'
        WHEN digest = coalesce((SELECT min('1-URGENT') FROM lineitem WHERE l_linenumber = 7 AND l_orderkey = mutation), first(digest) OVER (PARTITION BY mutation ORDER BY request)) THEN 'replay' ELSE 'conflict' END AS outcome FROM r)
    SELECT request, outcome, CASE WHEN outcome = 'apply' THEN coalesce(head, 0) + row_number() OVER (PARTITION BY tenant, outcome ORDER BY request) END AS revision FROM o LEFT JOIN heads USING (tenant)""")
def optimistic_commit(t):
    requests = t.orders.select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 4).alias("tenant"), F.floor(F.col("o_orderkey") / 2).alias("mutation"), F.col("o_orderpriority").alias("digest"))
    known = t.lineitem.where("l_linenumber = 7").select(F.col("l_orderkey").alias("mutation"), F.lit("1-URGENT").alias("digest")).distinct()
    judged = kept(mutations.settled(requests, known, "mutation", "digest"))
    applied = mutations.with_revisions(judged.where("outcome = 'apply'"), t.heads, "tenant", "request").select("request", "outcome", "revision")
    return applied.unionByName(judged.where("outcome <> 'apply'").select("request", "outcome", F.lit(None).cast("long").alias("revision")))
