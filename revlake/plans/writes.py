"""Registered queries of the write side: lookups, scans, mutations, promotion of snapshots and publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlake.functions import scalars
from revlake.operators import asof, diff, graph, mutations, paging
from revlake.plans.catalog import R1, R2, query
from revlake.plans.store import kept

# -- lookups and scans


@query("SELECT object_id, revision, name, size FROM live_all WHERE object_id = 7")
def object_lookup(t):
    return asof.live(asof.latest(t.versions.where("object_id = 7"), ["object_id"], "revision")).select("object_id", "revision", "name", "size")


@query("SELECT object_id, revision FROM live_all WHERE tenant = 1 AND parent_id = 3 AND mount AND lower(name) = 'click'")
def name_lookup(t):
    return t.live_all.where("tenant = 1 AND parent_id = 3 AND mount").where(scalars.name_key(F.col("name")) == "click").select("object_id", "revision")


@query("SELECT object_id, revision, name, publication FROM copies WHERE object_id = 7 AND revision = (SELECT min(revision) FROM versions WHERE object_id = 7) QUALIFY row_number() OVER (PARTITION BY object_id, revision ORDER BY source_revision DESC, publication DESC) = 1")
def exact_revision(t):
    own = t.copies.where("object_id = 7")
    first = own.agg(F.min("revision").alias("revision"))
    return asof.latest(own.join(F.broadcast(first), "revision"), ["object_id", "revision"], "source_revision", "publication").select("object_id", "revision", "name", "publication")


@query("SELECT split_part(url, '/', 1) AS root, url AS relative FROM pages ORDER BY root, relative LIMIT 257")
def path_scan_page(t):
    rows = t.pages.select(F.split("url", "/")[0].alias("root"), F.col("url").alias("relative"))
    return paging.keyset(rows, ["root", "relative"], None, 256)


@query("SELECT position, n_name FROM (VALUES (0, 3), (1, 99), (2, 7)) AS r(position, k) LEFT JOIN nation ON n_nationkey = k")
def values_lookup(t):
    request = t.spark.createDataFrame([(0, 3), (1, 99), (2, 7)], "position int, n_nationkey int")
    return paging.keyed_lookup(request, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).select("position", "n_name")


@query("SELECT object_id, max(revision) AS revision FROM versions WHERE tenant = 2 GROUP BY 1")
def pruned_scan(t):
    # laid out by tenant, so that a tenant's read touches its folders alone
    rows = kept(t.versions.select("tenant", "object_id", "revision"), "tenant")
    return rows.where("tenant = 2").groupBy("object_id").agg(F.max("revision").alias("revision"))


@query("SELECT object_id, parent_id FROM live_all WHERE object_id <> parent_id")
def without_root(t):
    return t.live_all.where("object_id <> parent_id").select("object_id", "parent_id")


@query("SELECT o_orderkey FROM orders o WHERE NOT (o_orderstatus = 'P' OR o_totalprice > 200000 OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'))")
def none_of_three(t):
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("NOT (o_orderstatus = 'P' OR o_totalprice > 200000)").join(returned, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT r_name, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey = l_orderkey AND c_acctbal > 0 GROUP BY 1")
def active_view_join(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey OR s_suppkey = o_orderkey)")
def either_key_join(t):
    # an OR of two keys, unpivoted: one equi-join instead of a nested loop
    keys = t.orders.select("o_orderkey", F.explode(F.array("o_custkey", "o_orderkey")).alias("s_suppkey"))
    return keys.join(t.supplier.select("s_suppkey"), "s_suppkey", "left_semi").select("o_orderkey").distinct()


@query("SELECT coalesce(c.c_custkey, o.k) AS k, greatest(coalesce(c.c_acctbal, o.v), coalesce(o.v, c.c_acctbal)) AS v FROM customer c FULL JOIN (SELECT o_custkey + 100 AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) o ON o.k = c.c_custkey")
def upsert_latest(t):
    new = t.orders.groupBy((F.col("o_custkey") + 100).alias("k")).agg(F.max("o_totalprice").alias("new"))
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("old"))
    return old.join(new, "k", "full_outer").select("k", F.greatest("old", "new").alias("v"))


@query("SELECT tenant, count(*) AS n_objects, CAST(coalesce(sum(strlen(name)), 0) AS BIGINT) AS n_bytes FROM live_all GROUP BY 1")
def object_counters(t):
    return t.live_all.groupBy("tenant").agg(F.count("*").alias("n_objects"), F.sum(F.octet_length("name")).cast("long").alias("n_bytes"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS keys FROM events GROUP BY 1")
def compacted_keys(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("keys"))


# -- mutations

CREATES = "SELECT o_orderkey AS request, o_custkey % 4 AS tenant, o_orderkey % 60 AS parent_id, o_orderpriority AS name, o_totalprice AS size, o_orderstatus <> 'F' AS mount, o_orderkey % 2 = 0 AS provider FROM orders"


def _creates(t) -> DataFrame:
    o = F.col
    return t.orders.select(o("o_orderkey").alias("request"), (o("o_custkey") % 4).alias("tenant"), (o("o_orderkey") % 60).alias("parent_id"), o("o_orderpriority").alias("name"), o("o_totalprice").alias("size"), (o("o_orderstatus") != "F").alias("mount"), (o("o_orderkey") % 2 == 0).alias("provider"))


def _created(t) -> DataFrame:
    fit = mutations.parents_of(_creates(t), t.live_all).where("there").where(scalars.valid_name(F.col("name")))
    return kept(mutations.with_revisions(fit, t.heads, "tenant", "request").withColumn("object_id", F.col("request") + 1000000))


@query(f"WITH c AS ({CREATES}), fit AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM live_all p WHERE p.tenant = c.tenant AND p.object_id = c.parent_id)) SELECT request + 1000000 AS object_id, tenant, parent_id, CAST(head + row_number() OVER (PARTITION BY tenant ORDER BY request) AS BIGINT) AS revision, name, size FROM fit JOIN heads USING (tenant)")
def create_version(t):
    return mutations.created(_created(t)).select("object_id", "tenant", "parent_id", "revision", "name", "size")


@query(f"WITH c AS ({CREATES}), fit AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM live_all p WHERE p.tenant = c.tenant AND p.object_id = c.parent_id)), v AS (SELECT *, CAST(head + row_number() OVER (PARTITION BY tenant ORDER BY request) AS BIGINT) AS revision FROM fit JOIN heads USING (tenant)) SELECT request + 1000000 AS object_id, 0 AS presentation, parent_id AS scope_parent, 'upsert' AS kind, revision AS object_revision FROM v WHERE mount UNION ALL SELECT request + 1000000, 1, parent_id, 'upsert', revision FROM v WHERE provider")
def create_changes(t):
    rows = mutations.created(_created(t)).select("object_id", F.struct("parent_id", "revision", "mount", "provider").alias("n"))
    return mutations.changes_of(rows, mutations.scoped(None, {c: F.col(f"n.{c}") for c in ("parent_id", "revision", "mount", "provider")}, ["mount", "provider"], F.lit(True)), "object_id")


#: Each live object as of R1 takes on what the newest staged row of it says.
REVISED = f"SELECT b.object_id, b.tenant, b.revision AS old_revision, b.parent_id AS old_parent, b.name AS old_name, b.size AS old_size, b.mount AS old_mount, b.provider AS old_provider, r.parent_id, r.name, r.size, r.mount, r.provider, {R2} + 1 AS revision FROM live_before b JOIN (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY revision DESC) = 1) r USING (object_id)"


def _revised(t) -> DataFrame:
    requests = asof.latest(t.staged, ["object_id"], "revision").withColumn("revision", F.lit(t.r2 + 1).cast("long"))
    return mutations.revised(asof.live(t.current(t.r1)), requests.drop("tombstone"))


@query(f"WITH r AS ({REVISED}) SELECT object_id, parent_id, name, size, CASE WHEN parent_id <> old_parent OR name <> old_name OR mount <> old_mount OR provider <> old_provider THEN revision ELSE old_revision END AS metadata_revision, CASE WHEN size <> old_size THEN revision ELSE old_revision END AS content_revision FROM r")
def revise_move(t):
    n = F.col("new")
    return _revised(t).select("object_id", n["parent_id"].alias("parent_id"), n["name"].alias("name"), n["size"].alias("size"), n["metadata_revision"].alias("metadata_revision"), n["content_revision"].alias("content_revision"))


@query(f"""WITH r AS (SELECT *, parent_id <> old_parent OR name <> old_name OR mount <> old_mount OR provider <> old_provider AS meta FROM ({REVISED}))
    SELECT object_id, 0 AS presentation, old_parent AS scope_parent, 'delete' AS kind, old_revision AS object_revision FROM r WHERE old_mount AND (NOT mount OR parent_id <> old_parent)
    UNION ALL SELECT object_id, 0, parent_id, 'upsert', revision FROM r WHERE mount AND (NOT old_mount OR meta)
    UNION ALL SELECT object_id, 1, old_parent, 'delete', old_revision FROM r WHERE old_provider AND (NOT provider OR parent_id <> old_parent)
    UNION ALL SELECT object_id, 1, parent_id, 'upsert', revision FROM r WHERE provider AND (NOT old_provider OR meta)""")
def revise_changes(t):
    return mutations.changes_of(_revised(t), mutations.scoped(mutations.side("old"), mutations.side("new"), ["mount", "provider"], F.col("metadata_changed")), "object_id")


DELETES = "SELECT DISTINCT user_id % 4 AS tenant, user_id % 200 AS object_id FROM events WHERE event_type = 'purchase'"


@query(f"WITH d AS ({DELETES}) SELECT tenant, object_id, CASE WHEN object_id = 0 THEN 'root' WHEN NOT EXISTS (SELECT 1 FROM live_all v WHERE v.tenant = d.tenant AND v.object_id = d.object_id) THEN 'missing' WHEN EXISTS (SELECT 1 FROM live_all v WHERE v.tenant = d.tenant AND v.parent_id = d.object_id) THEN 'not_empty' END AS reason FROM d")
def delete_tombstone(t):
    asked = t.events.where("event_type = 'purchase'").select((F.col("user_id") % 4).alias("tenant"), (F.col("user_id") % 200).alias("object_id")).distinct()
    return mutations.deletable(asked, t.live_all, F.col("object_id") == 0).select("tenant", "object_id", "reason")


@query(f"""WITH p AS (SELECT a.tenant, a.object_id AS source, min(b.object_id) AS target FROM live_all a JOIN live_all b ON b.tenant = a.tenant AND b.object_id = a.object_id + 4 WHERE a.object_id % 8 = a.tenant GROUP BY 1, 2)
    SELECT t.object_id, t.parent_id, t.name, t.size, false AS mount, false AS provider, true AS tombstone FROM p JOIN live_all s ON s.object_id = p.source JOIN live_all t ON t.object_id = p.target
    UNION ALL SELECT s.object_id, t.parent_id, t.name, s.size, s.mount OR t.mount, s.provider OR t.provider, false FROM p JOIN live_all s ON s.object_id = p.source JOIN live_all t ON t.object_id = p.target""")
def replace_over(t):
    pairs = t.live_all.where("object_id % 8 = tenant").select("tenant", F.col("object_id").alias("source"), (F.col("object_id") + 4).alias("target")).join(t.heads, "tenant").withColumn("revision", F.col("head") + 1)
    return mutations.replaced(pairs, t.live_all).select("object_id", "parent_id", "name", "size", "mount", "provider", "tombstone")


@query("""WITH a AS (SELECT o_custkey AS operation, o_orderkey AS request, o_orderkey % 3 AS expected, o_orderstatus = 'P' AS committed FROM orders)
    SELECT operation, request, CAST(n + 1 AS BIGINT) AS epoch, CASE WHEN done THEN 'refused' WHEN expected <> n THEN 'stale' WHEN committed THEN 'committed' ELSE 'claimed' END AS state
    FROM (SELECT *, row_number() OVER w - 1 AS n, coalesce(bool_or(committed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM a WINDOW w AS (PARTITION BY operation ORDER BY request))""")
def claim_machine(t):
    a = t.orders.select(F.col("o_custkey").alias("operation"), F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 3).alias("expected"), (F.col("o_orderstatus") == "P").alias("committed"))
    return mutations.claims(a, "operation", "epoch").select("operation", "request", "epoch", "state")


@query(f"""WITH c AS ({CREATES}) SELECT request, 'no_parent' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM live_all p WHERE p.tenant = c.tenant AND p.object_id = c.parent_id)
    UNION ALL SELECT request, 'not_one_shape' FROM c WHERE CAST(mount AS INT) + CAST(provider AS INT) <> 1
    UNION ALL SELECT request, 'name_taken' FROM c WHERE EXISTS (SELECT 1 FROM live_all p WHERE p.tenant = c.tenant AND p.parent_id = c.parent_id AND p.name = lower(c.name) AND p.mount)""")
def intent_violations(t):
    c = _creates(t)
    taken = t.live_all.where("mount").select("tenant", "parent_id", F.col("name").alias("key"))
    problems = [
        (mutations.parents_of(c, t.live_all).where("not there"), "no_parent"),
        (c.where(F.col("mount").cast("int") + F.col("provider").cast("int") != 1), "not_one_shape"),
        (c.withColumn("key", scalars.name_key(F.col("name"))).join(taken, ["tenant", "parent_id", "key"], "left_semi"), "name_taken"),
    ]
    out = [df.select("request", F.lit(p).alias("problem")) for df, p in problems]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT object_id, max(revision) FILTER (publication = 2) AS private, max(revision) FILTER (publication <> 2) AS published, CASE WHEN max(revision) FILTER (publication = 2) > coalesce(max(revision) FILTER (publication <> 2), 0) THEN 'promote' ELSE 'discard' END AS fate FROM copies GROUP BY 1 HAVING count(*) FILTER (publication = 2) > 0")
def private_promotion(t):
    mine = F.col("publication") == 2
    g = t.copies.groupBy("object_id").agg(F.max(F.when(mine, F.col("revision"))).alias("private"), F.max(F.when(~mine, F.col("revision"))).alias("published")).where("private is not null")
    return g.withColumn("fate", F.when(F.col("private") > F.coalesce("published", F.lit(0)), "promote").otherwise("discard"))


@query("SELECT tenant, CASE WHEN tenant % 2 <> coalesce(k.version, 0) THEN 'moved' WHEN applied < k.applied0 THEN 'regression' ELSE 'saved' END AS outcome, CAST(coalesce(k.version, 0) + CASE WHEN tenant % 2 = coalesce(k.version, 0) AND NOT coalesce(applied < k.applied0, false) THEN 1 ELSE 0 END AS BIGINT) AS version FROM (SELECT tenant, max(revision) AS applied FROM before GROUP BY 1) LEFT JOIN (SELECT tenant, 1 AS version, max(revision) * (tenant % 3) AS applied0 FROM staged WHERE tenant > 0 GROUP BY tenant) k USING (tenant)")
def state_save(t):
    saves = t.current(t.r1).groupBy("tenant").agg(F.max("revision").alias("applied")).withColumn("expected", F.col("tenant") % 2)
    known = t.staged.where("tenant > 0").groupBy("tenant").agg(F.max("revision").alias("m")).select("tenant", F.lit(1).alias("version"), (F.col("m") * (F.col("tenant") % 3)).alias("applied"))
    return mutations.saved_state(known, saves, "tenant", ["applied"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_violations(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# -- snapshots: before image, events, versions, current rows


@query(f"SELECT b.object_id, b.tenant, b.revision, {R2} AS target_revision FROM before b JOIN (SELECT DISTINCT tenant, object_id FROM versions WHERE mount) owned ON owned.tenant = b.tenant AND owned.object_id = b.object_id JOIN (SELECT DISTINCT tenant FROM staged) root ON root.tenant = b.tenant")
def before_image(t):
    owned = t.versions.where("mount").select("tenant", "object_id").distinct()
    roots = t.staged.select("tenant").distinct()
    return t.current(t.r1).join(owned, ["tenant", "object_id"]).join(roots, "tenant").select("object_id", "tenant", "revision", F.lit(t.r2).cast("long").alias("target_revision"))


CHANGED = "b.revision IS DISTINCT FROM a.revision"


@query(f"""SELECT b.object_id, c.domain, CASE WHEN a.object_id IS NULL OR NOT a.provider THEN 'delete' ELSE 'upsert' END AS kind, CASE WHEN a.object_id IS NULL OR NOT a.provider THEN b.revision ELSE a.revision END AS object_revision
    FROM live_before b LEFT JOIN live_after a USING (object_id) JOIN containers c ON c.tenant = b.tenant AND c.container_id = b.parent_id WHERE (a.object_id IS NULL OR {CHANGED}) AND (b.provider OR coalesce(a.provider, false))
    UNION ALL SELECT a.object_id, c.domain, 'upsert', a.revision FROM live_after a LEFT JOIN live_before b USING (object_id) JOIN containers c ON c.tenant = a.tenant AND c.container_id = a.parent_id
    WHERE {CHANGED} AND a.provider AND (b.object_id IS NULL OR NOT b.provider OR b.parent_id <> a.parent_id)""")
def working_set_events(t):
    changed = ~F.col("old.revision").eqNullSafe(F.col("new.revision"))
    found = diff.working_set_events(asof.live(t.current(t.r1)), asof.live(t.current(t.r2)), ["object_id"], "parent_id", "provider", changed, t.containers)
    return found.select("object_id", "domain", "kind", "object_revision")


PROMOTED = f"""SELECT b.object_id, b.tenant, b.parent_id, {R2} AS revision, b.name, b.size, true AS tombstone, false AS mount, false AS provider FROM live_before b WHERE b.object_id NOT IN (SELECT object_id FROM live_after)
    UNION ALL SELECT a.object_id, a.tenant, a.parent_id, a.revision, a.name, a.size, a.tombstone, a.mount, a.provider FROM live_after a LEFT JOIN live_before b USING (object_id) WHERE {CHANGED}"""


def _promoted(t) -> DataFrame:
    changed = ~F.col("old.revision").eqNullSafe(F.col("new.revision"))
    return diff.promoted(t.current(t.r1), asof.live(t.current(t.r2)), ["object_id"], changed, t.r2)


@query(PROMOTED)
def tombstone_versions(t):
    return _promoted(t)


@query(f"WITH p AS ({PROMOTED}) SELECT object_id, revision, name, tombstone FROM before WHERE object_id NOT IN (SELECT object_id FROM p) UNION ALL SELECT object_id, revision, name, tombstone FROM p")
def apply_current(t):
    return diff.folded(t.current(t.r1), _promoted(t), ["object_id"]).select("object_id", "revision", "name", "tombstone")


@query(f"WITH p AS ({PROMOTED}) SELECT tenant, count(*) AS n_rows, count(*) FILTER (tombstone) AS n_deleted, greatest(max(p.revision), max(head)) AS head FROM p JOIN heads USING (tenant) GROUP BY 1")
def commit_rows(t):
    rows = _promoted(t).groupBy("tenant").agg(F.count("*").alias("n_rows"), F.count_if("tombstone").alias("n_deleted"), F.max("revision").alias("top"))
    return rows.join(t.heads, "tenant").select("tenant", "n_rows", "n_deleted", F.greatest("top", "head").alias("head"))


@query("SELECT tenant, page, count(*) AS n_rows, CAST(sum(strlen(name)) AS BIGINT) AS n_bytes, count(*) <= 256 AND sum(strlen(name)) <= 2097152 AS fits FROM (SELECT tenant, name, CAST(floor((row_number() OVER (PARTITION BY tenant ORDER BY revision) - 1) / 256) AS BIGINT) AS page FROM staged) GROUP BY 1, 2")
def staged_pages(t):
    rows = asof.numbered(t.staged.select("tenant", "revision", "name"), ["tenant"], ["revision"], "n").withColumn("page", F.floor(F.col("n") / 256))
    return rows.groupBy("tenant", "page").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("name")).cast("long").alias("n_bytes")).withColumn("fits", (F.col("n_rows") <= 256) & (F.col("n_bytes") <= 2097152))


@query("SELECT v.object_id, v.revision, 9 AS publication FROM versions v JOIN (SELECT DISTINCT tenant, object_id FROM before WHERE mount) b USING (tenant, object_id) JOIN (SELECT tenant, max(revision) AS head FROM before GROUP BY 1) h USING (tenant) WHERE v.revision <= h.head")
def copy_versions(t):
    owned = t.current(t.r1).where("mount").select("tenant", "object_id").distinct()
    head = t.current(t.r1).groupBy("tenant").agg(F.max("revision").alias("head"))
    return t.versions.join(owned, ["tenant", "object_id"]).join(head, "tenant").where("revision <= head").select("object_id", "revision", F.lit(9).alias("publication"))


@query("SELECT c.object_id, c.revision, c.kind FROM (SELECT tenant, object_id, revision, CASE WHEN tombstone THEN 'delete' ELSE 'upsert' END AS kind FROM versions WHERE provider) c JOIN (SELECT DISTINCT tenant, object_id FROM before WHERE mount) b USING (tenant, object_id) WHERE c.revision <= (SELECT max(revision) FROM before)")
def copy_changes(t):
    owned = t.current(t.r1).where("mount").select("tenant", "object_id").distinct()
    head = t.current(t.r1).agg(F.max("revision").alias("head"))
    rows = t.versions.where("provider").withColumn("kind", F.when(F.col("tombstone"), "delete").otherwise("upsert")).join(owned, ["tenant", "object_id"], "left_semi")
    return rows.join(F.broadcast(head)).where("revision <= head").select("object_id", "revision", "kind")


@query("""WITH p AS (SELECT authority, CAST(floor(sequence % 10 / 4) AS BIGINT) AS page, sha256(string_agg(sequence || ':' || through, ',' ORDER BY sequence)) AS d FROM inbox GROUP BY 1, 2)
    SELECT authority, list_reduce(list_prepend('', list(d ORDER BY page)), lambda s, x: sha256(s || x)) AS digest FROM p GROUP BY 1""")
def chained_pages(t):
    row = F.concat(F.col("sequence").cast("string"), F.lit(":"), F.col("through").cast("string"))
    pages = t.inbox.groupBy("authority", F.floor(F.col("sequence") % 10 / 4).alias("page")).agg(F.array_sort(F.collect_list(F.struct("sequence", row.alias("r")))).alias("rows"))
    pages = pages.select("authority", "page", F.sha2(F.array_join(F.transform("rows", lambda x: x["r"]), ",").cast("binary"), 256).alias("d"))
    chain = pages.groupBy("authority").agg(F.array_sort(F.collect_list(F.struct("page", "d"))).alias("pages"))
    return chain.select("authority", F.aggregate("pages", F.lit(""), lambda s, x: F.sha2(F.concat(s, x["d"]).cast("binary"), 256)).alias("digest"))


@query("SELECT coalesce(a.o_custkey, c.c_custkey) AS member, CASE WHEN a.o_custkey IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON a.o_custkey = c.c_custkey WHERE a.o_custkey IS NULL OR c.c_custkey IS NULL")
def fleet_coverage(t):
    covered = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("member")).distinct()
    wanted = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("member"))
    both = covered.withColumn("_c", F.lit(True)).join(wanted.withColumn("_w", F.lit(True)), "member", "full_outer")
    return both.where("_c IS NULL OR _w IS NULL").select("member", F.when(F.col("_c").isNull(), "missing").otherwise("extra").alias("problem"))


# -- scalars


@query("SELECT doc_id, octet_length(encode(source)) BETWEEN 1 AND 255 AND source NOT IN ('.', '..') AND NOT regexp_matches(source, '[/\\x00-\\x1f\\x7f]') AS valid, strlen(text) BETWEEN 1 AND 4096 AND NOT contains(text, chr(0)) AS valid_link FROM documents")
def valid_names(t):
    return t.documents.select("doc_id", scalars.valid_name(F.col("source")).alias("valid"), scalars.valid_link(F.col("text")).alias("valid_link"))


@query("SELECT n_nationkey, repeat('00', n_nationkey) AS zeros FROM nation")
def zero_blob(t):
    return t.nation.select("n_nationkey", F.hex(F.unhex(F.repeat(F.lit("00"), F.col("n_nationkey")))).alias("zeros"))


MUTATION = """SELECT o_orderkey, lower(lpad(hex(o_orderkey), 16, '0')) || substr(sha256(unhex(hex('revlake.mutation' || chr(0)) || lpad(hex(strlen(o_orderstatus)), 8, '0') || hex(o_orderstatus) || lpad(hex(o_orderkey), 16, '0')
    || lpad(hex(strlen(o_orderpriority)), 8, '0') || hex(o_orderpriority) || sha256(CAST(o_custkey AS VARCHAR)))), 1, 48) AS mutation FROM orders"""


def _mutations(t) -> DataFrame:
    return t.orders.select("o_orderkey", scalars.mutation_id(F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_orderpriority"), F.sha2(F.col("o_custkey").cast("string").cast("binary"), 256)).alias("mutation"))


@query(MUTATION)
def derive_mutation_id(t):
    return _mutations(t)


@query(f"WITH m AS ({MUTATION}) SELECT mutation, o_orderkey AS target FROM m")
def mutation_revision(t):
    return _mutations(t).select("mutation", scalars.target_revision(F.col("mutation")).alias("target"))


@query("SELECT event_id, CAST(CAST('0x' || substr(sha256(unhex(hex('revlake.inode' || chr(0)) || substr(sha256(CAST(event_id AS VARCHAR)), 1, 32))), 1, 16) AS UBIGINT) AS VARCHAR) AS inode FROM events")
def stable_inode(t):
    return t.events.select("event_id", scalars.stable_inode(F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 32)).alias("inode"))


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS parent, url = 'http:' OR starts_with(url, 'http:/') AS below FROM pages")
def parent_path(t):
    return t.pages.select("page_id", scalars.parent_path(F.col("url")).alias("parent"), scalars.is_below(F.col("url"), F.lit("http:")).alias("below"))


@query("SELECT doc_id, CASE WHEN strlen(source) + strlen(lang) + strlen(text) <= 1000 THEN sha256(unhex(lpad(hex(strlen(source)), 8, '0') || hex(source) || lpad(hex(strlen(lang)), 8, '0') || hex(lang) || lpad(hex(strlen(text)), 8, '0') || hex(text))) END AS digest FROM documents")
def budgeted_digest(t):
    return t.documents.select("doc_id", scalars.budgeted_digest([F.col("source"), F.col("lang"), F.col("text")], 1000).alias("digest"))


@query("SELECT object_id, revision FROM (SELECT object_id, revision, size, lag(size) OVER (PARTITION BY object_id ORDER BY revision) AS p FROM versions) WHERE size < p")
def convergence_regressions(t):
    w = Window.partitionBy("object_id").orderBy("revision")
    return t.versions.withColumn("p", F.lag("size").over(w)).where("size < p").select("object_id", "revision")


# -- trees


@query("WITH RECURSIVE up(start, node) AS (SELECT node, parent FROM tree WHERE parent IS NOT NULL UNION ALL SELECT up.start, t.parent FROM up JOIN tree t ON t.node = up.node WHERE t.parent IS NOT NULL) SELECT start, node AS ancestor FROM up")
def ancestor_walk(t):
    from revlake.plans.catalog import _tree

    tree = _tree(t).select(F.col("node").alias("child"), "parent")
    return graph.ancestors(tree).select(F.col("child").alias("start"), F.col("parent").alias("ancestor"))


@query("WITH RECURSIVE up(node) AS (SELECT publication FROM publications WHERE publication % 97 = 13 UNION SELECT p.predecessor FROM publications p JOIN up ON p.publication = up.node WHERE p.predecessor IS NOT NULL) SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.node = l_orderkey) GROUP BY 1")
def pending_targets(t):
    # the closure inside NOT EXISTS is worked out once, by path doubling as publications are chains, then an anti-join
    edges = t.orders.select(F.col("o_orderkey").alias("child"), F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderkey") - 1).alias("parent"))
    roots = t.orders.where("o_orderkey % 97 = 13").select(F.col("o_orderkey").alias("node"))
    seen = graph.lineage(edges, roots).select(F.col("node").alias("l_orderkey"))
    return t.lineitem.join(seen.hint("merge"), "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))
