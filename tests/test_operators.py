import pytest
from pyspark.sql import functions as F

from revlake.functions import scalars
from revlake.operators import asof, diff, graph, ingest, paging, queues, retention
from revlake.sources import blobs, manifest, schema
from revlake.streaming import ledger


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tombstone_hides_older_live_versions(spark):
    v = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "id int, revision int, tombstone boolean")
    assert rows(asof.live(asof.as_of(v, ["id"], "revision", 5)).select("id")) == [(2,)]
    assert rows(asof.live(asof.as_of(v, ["id"], "revision", 1)).select("id")) == [(1,), (2,)]
    assert "WindowGroupLimit" in asof.latest(v, ["id"], "revision")._jdf.queryExecution().toString()


def test_pages_join_up_and_anchors(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    seen, after = [], None
    while True:
        got, after = paging.page(df, ["k", "id"], after, 13)
        seen += [tuple(r) for r in got]
        if after is None:
            break
    assert len(seen) == 100 and [x[::-1] for x in seen] == sorted(x[::-1] for x in seen)
    paging.check_anchor(3, 3, 9)
    with pytest.raises(paging.StaleAnchorError):
        paging.check_anchor(2, 3, 9)


def test_byte_bounded_gives_the_first_row_anyway(spark):
    df = spark.createDataFrame([(1, 1, 900), (1, 2, 50), (2, 1, 10), (2, 2, 10)], "g int, k int, b int")
    assert rows(paging.byte_bounded(df, "k", "b", 100, 9, ["g"]).select("g", "k")) == [(1, 1), (2, 1), (2, 2)]


def test_order_violations_and_gaps(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 3)], "g int, at int, n long")
    assert rows(paging.order_violations(df, ["g"], "at", ["n"]).select("at")) == [(2,)]
    assert rows(ingest.gaps(df, ["g"], "n").select("n", "expected")) == [(3, 2), (3, 4)]


def test_after_image_carries_revisions(spark):
    now = spark.createDataFrame([(1, "a", 5, 3, 4), (2, "b", 6, 3, 4)], "id int, name string, size int, metadata_revision long, content_revision long")
    staged = spark.createDataFrame([(1, "a", 9), (2, "c", 6), (3, "d", 1)], "id int, name string, size int")
    out = diff.after_image(staged, now, ["id"], ["name"], ["size"], 8).select("id", "metadata_revision", "content_revision", "changed")
    assert rows(out) == [(1, 3, 8, True), (2, 8, 4, True), (3, 8, 8, True)]


def test_merge_latest_action_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    staged = spark.createDataFrame([(1, "x", 1, "upsert"), (1, "x", 2, "delete"), (3, "c", 1, "delete"), (3, "c", 2, "upsert")], "id int, name string, n int, action string")
    assert rows(diff.merge_latest(base, staged, ["id"], "n", "action")) == [(2, "b"), (3, "c")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "child int, parent int")
    seen = graph.closure(edges, spark.createDataFrame([(1,)], "node int"))
    assert rows(seen) == [(1, 0), (2, 1), (3, 2)]


def test_deep_lineage(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "child int, parent int")
    assert graph.closure(edges, spark.createDataFrame([(0,)], "node int")).count() == 13


def test_queue(spark):
    q = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending"), (2, 3, "awaiting"), (2, 4, "pending"), (3, 9, "pending")], "p int, r int, s string")
    assert rows(queues.claimable(q, "p", "r", "s", 2, ("awaiting",)).select("p", "r")) == [(1, 2)]
    assert rows(queues.superseded(q, "p", "r", "s").where("new_state = 'superseded'").select("p", "r")) == [(1, 1)]
    assert rows(queues.tickets(q.select("r"), "r", 10).select("r", "ticket")) == [(1, 11), (2, 12), (3, 13), (4, 14), (9, 15)]


def test_retention(spark):
    v = spark.createDataFrame([(7, 1, 1), (7, 1, 5), (7, 1, 9), (7, 2, 2), (8, 3, 1), (8, 3, 2)], "tenant int, id int, revision int")
    floors = spark.createDataFrame([(7, 6), (8, 1)], "tenant int, floor int")
    pins = spark.createDataFrame([(1, 1)], "id int, revision int")
    kept = lambda *p: rows(retention.retained_versions(v, floors, ["id"], "revision", list(p)).select("id", "revision"))
    assert kept(pins) == [(1, 1), (1, 5), (1, 9), (2, 2), (3, 1), (3, 2)]
    assert kept(pins.limit(0)) == [(1, 5), (1, 9), (2, 2), (3, 1), (3, 2)]


def test_safe_floor_waits_for_every_lease(spark):
    tenants = spark.createDataFrame([(1, 50, 40, 10), (2, 50, 40, 10), (3, 50, None, 10), (4, 50, 40, 45)], "tenant int, head long, applied long, floor long")
    anchors = spark.createDataFrame([(1, 30)], "tenant int, at long")
    leases = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "tenant int, domain string")
    seen = spark.createDataFrame([(1, "a", 35), (2, "a", 20)], "tenant int, domain string, observed long")
    # held by its anchor; a lease has not been acknowledged; nothing applied; never back
    assert rows(retention.safe_floor(tenants, [anchors], leases, seen)) == [(1, 30), (2, 10), (3, 10), (4, 45)]


def test_claim_respects_the_window(spark):
    q = spark.createDataFrame([(1, 1, "pending"), (1, 2, "acked"), (2, 3, "awaiting"), (3, 4, "awaiting")], "p int, r int, s string")
    assert rows(queues.claimable(q, "p", "r", "s", 2, ("awaiting",))) == []
    # an older pending row under a newer acknowledged one is still claimed
    assert rows(queues.claimable(q, "p", "r", "s", 3, ("awaiting",)).select("p", "r")) == [(1, 1)]


def test_numbered_is_dense_within_keys(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS n").unionByName(spark.createDataFrame([(None, 5), (None, 6)], "k long, n long"))
    got = asof.numbered(df, ["k"], ["n"], "at").collect()
    for k in (0, 1, 2, None):
        own = sorted((r.n, r["at"]) for r in got if r.k == k)
        assert [a for _, a in own] == list(range(len(own)))


def test_long_chains_take_few_rounds(spark):
    edges = spark.range(1, 1000).selectExpr("id AS child", "id - 1 AS parent")
    seen = graph.lineage(edges, spark.createDataFrame([(999,)], "node long"))
    assert seen.count() == 1000 and seen.where("depth <> 999 - node").count() == 0
    up = graph.ancestors(edges.where("child < 40"))
    assert up.count() == 39 * 40 // 2 and up.where("distance <> child - parent").count() == 0
    with pytest.raises(RecursionError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "child int, parent int"))


def test_row_rules_and_opened_store(spark, tmp_path):
    key = lambda n: bytes([n]) * 16
    good = ("t", key(1), key(2), 1, 1, 1, "a", "a", 1, 420, 5, b"h", "", 4, 3, 2, 1, True, True, False)
    bad = [(*good[:10], -1, *good[11:]), (*good[:13], 1, 2, 2, 1, *good[17:]), (*good[:1], b"short", *good[2:])]
    table = spark.createDataFrame([good, *bad], schema.VERSIONS)
    assert sorted(r.rule for r in schema.row_violations(table).collect()) == ["identity", "proof order", "size"]
    table.write.parquet(f"{tmp_path}/v")
    assert schema.opened(spark, f"{tmp_path}/v", schema.VERSIONS).count() == 4
    with pytest.raises(schema.SchemaMismatch):
        schema.opened(spark, f"{tmp_path}/v", schema.INBOX)


def test_applied_stream_is_published_once(spark, tmp_path):
    from revlake.streaming import apply

    table = manifest.Table(spark, f"{tmp_path}/t", apply.SCHEMA)
    batch = spark.createDataFrame([("a", 1, "upsert", "f1", "i1", "x"), ("a", 2, "upsert", "f2", "i1", "y"), ("b", 1, "upsert", "f3", "i2", "z")], apply.CHANGE)
    first = apply.apply_batch(batch, 0, table)
    assert apply.apply_batch(batch, 0, table).revision == first.revision == 1
    assert rows(table.read().select("object_id", "fingerprint")) == [("a", "f2"), ("b", "f3")]
    # unchanged ones are suppressed, so nothing is published; a delete is; a new id of a known identity is a rename
    assert apply.apply_batch(batch.where("revision = 2"), 1, table).revision == 1
    moved = spark.createDataFrame([("b", 3, "delete", None, "i2", None), ("c", 3, "upsert", "f3", "i2", "z2")], apply.CHANGE)
    assert rows(apply.renames(moved, table.read())) == [("b", "c")]
    assert apply.apply_batch(moved, 2, table).revision == 2
    assert rows(table.read().select("object_id")) == [("a",), ("c",)]
    with pytest.raises(apply.SnapshotRequired):
        apply.apply_batch(moved.withColumn("revision", F.lit(9).cast("long")), 3, table, expected_from=5)
    repaired = apply.repair(lambda: batch.where("object_id = 'b'"), table, "r1")
    assert repaired.revision == 3 and rows(table.read().select("object_id")) == [("b",)]


def test_names_and_flags(spark):
    df = spark.createDataFrame([("Straße",), ("ABC",), ("é",), ("a/b",), ("",), (None,)], "n string")
    got = {r.n: (r.k, r.v) for r in df.select("n", scalars.name_key(F.col("n")).alias("k"), scalars.valid_name(F.col("n")).alias("v")).collect()}
    assert got["Straße"] == ("strasse", True) and got["ABC"][0] == "abc" and got["é"][0] == "é"
    assert not got["a/b"][1] and not got[""][1] and got[None] == (None, False)
    assert [r.k for r in spark.range(4).select(scalars.event_kind(F.col("id")).alias("k")).collect()] == ["metadata", "removed", "renamed", "removed"]


def test_commit_log(spark, tmp_path):
    t = manifest.Table(spark, f"{tmp_path}/t", "id int")
    first = t.commit(spark.createDataFrame([(1,)], "id int"), t.head(), "m1", "d1")
    assert t.commit(spark.createDataFrame([(1,)], "id int"), t.head(), "m1", "d1") == first
    with pytest.raises(manifest.MutationConflict):
        t.commit(spark.createDataFrame([(1,)], "id int"), t.head(), "m1", "other")
    t.commit(spark.createDataFrame([(2,)], "id int"), first, "m2", "d2")
    with pytest.raises(manifest.HeadMoved):
        t.commit(spark.createDataFrame([(3,)], "id int"), first, "m3", "d3")
    assert rows(t.read()) == [(1,), (2,)] and rows(t.read(first)) == [(1,)]


def test_blobs_and_schema(spark):
    b = blobs.staged(spark.createDataFrame([("x",), ("x",), ("y",)], "c string"), "c")
    assert b.count() == 2
    assert blobs.opened(b.select("hash"), b).count() == 2
    with pytest.raises(schema.SchemaMismatch):
        schema.attested(b, schema.VERSIONS)


def test_ledger_is_exactly_once(spark, tmp_path):
    one = spark.createDataFrame([("s", "e", 1, "d1"), ("s", "e", 2, "d2")], "stream string, epoch string, cursor long, digest string")
    path = f"{tmp_path}/ledger"
    ledger.append_batch(one, 0, path)
    ledger.append_batch(one, 0, path)
    ledger.append_batch(one, 1, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ledger.DigestConflict):
        ledger.append_batch(one.withColumn("digest", F.lit("x")), 2, path)


def test_streams(spark, tmp_path):
    from revlake.sources import connector

    spark.dataSource.register(connector.RevisionLog)
    log = tmp_path / "log"
    log.mkdir()
    (log / f"{1:012d}.jsonl").write_text('{"object_id": "a", "action": "upsert", "name": "x"}\n')
    (log / f"{2:012d}.jsonl").write_text('{"object_id": "a", "action": "delete"}\n{"object_id": "b", "action": "upsert"}\n')
    assert spark.read.format("revision_log").option("path", str(log)).load().count() == 3
    assert rows(connector.snapshot(spark, str(log)).select("object_id", "revision")) == [("b", 2)]
    src = tmp_path / "src"
    spark.createDataFrame([("t", 3), ("t", 9), ("u", 4)], "tenant string, revision long").write.parquet(str(src))
    stream = spark.readStream.schema("tenant string, revision long").parquet(str(src))
    q = ledger.coalesced(stream).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("newest")) == [("t", 9), ("u", 4)]


def test_nothing_that_grows_is_broadcast_for_pending_targets(spark):
    from revlake.plans import catalog, writes  # noqa: F401  writes registers the query

    plan = catalog.QUERIES["pending_targets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
