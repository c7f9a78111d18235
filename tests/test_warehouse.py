import os
import sys

import pytest

from tidemark.functions import signing
from tidemark.sources import warehouse as wh
from tidemark.sources.worktree import read_worktree


def tree(root):
    (root / "dir/deep").mkdir(parents=True)
    (root / "a.txt").write_text("hello")
    (root / "dir/b.txt").write_text("world")
    (root / "dir/deep/c.bin").write_bytes(b"\x07" * 200_000)
    return root


@pytest.fixture
def store(spark, tmp_path):
    return wh.Warehouse.init(spark, str(tree(tmp_path / "w")))


def contents(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(root) for f in files if wh.STORE not in d}


def statuses(frame):
    return {(r["path"], r["status"]) for r in frame.collect()}


def test_worktree_source(spark, tmp_path):
    root = tree(tmp_path / "t")
    (root / ".hidden").write_text("x")
    os.symlink("a.txt", root / "link")
    rows = {r["path"]: r for r in read_worktree(spark, str(root), hashed=True).collect()}
    assert set(rows) == {"a.txt", ".hidden", "link", "dir/b.txt", "dir/deep/c.bin"}
    assert rows["link"]["kind"] == "symlink" and rows["link"]["content"] is None
    assert rows["a.txt"]["content"] == __import__("hashlib").sha256(b"hello").hexdigest()
    assert rows["a.txt"]["mtime_secs"] * 10**9 + rows["a.txt"]["mtime_nanos"] == os.stat(root / "a.txt").st_mtime_ns


def test_snapshot_drift_revert_and_undo(store):
    root = store.root
    before = contents(root)
    first = store.snap("one")
    assert statuses(store.status()) == set() and store.show().count() == 3
    open(f"{root}/a.txt", "w").write("changed")
    open(f"{root}/new.txt", "w").write("n")
    os.unlink(f"{root}/dir/b.txt")
    assert statuses(store.status()) == {("a.txt", "modified"), ("new.txt", "added"), ("dir/b.txt", "deleted")}
    with pytest.raises(wh.Dirty):
        store.revert(first)
    second = store.snap("two", actor="alice")
    assert statuses(store.diff(first)) == {("a.txt", "modified"), ("new.txt", "added"), ("dir/b.txt", "deleted")}
    open(f"{root}/bob.txt", "w").write("b")
    store.snap("three", actor="bob")
    assert [r["message"] for r in store.log().collect()] == ["three", "two", "one"]
    assert store.resolve(second[:10].upper()) == second
    # alice's work goes, bob's stays
    store.revert_actor("alice")
    assert contents(root) == before | {"bob.txt": b"b"}
    report = {(r["path"], r["action"]) for r in store.revert(second).collect()}
    assert ("a.txt", "restored") in report and ("bob.txt", "removed") in report
    assert contents(root)["a.txt"] == b"changed"
    store.revert(first)
    assert contents(root) == before
    assert store.verify(objects=True)["valid"] and store.verify(objects=True)["corrupt"] == 0


def test_forged_stamp_is_caught_by_full_scan(store):
    store.snap()
    path = f"{store.root}/a.txt"
    info = os.stat(path)
    open(path, "w").write("HELLO")
    os.utime(path, ns=(info.st_atime_ns, info.st_mtime_ns))
    assert statuses(store.status()) == set()
    assert statuses(store.status(full=True)) == {("a.txt", "modified")}


def test_ignored_and_excluded(store):
    open(f"{store.root}/{wh.IGNORE_FILE}", "w").write("# note\n deep \n")
    os.makedirs(f"{store.root}/.git")
    open(f"{store.root}/.git/x", "w").write("x")
    store.snap()
    assert {r["path"] for r in store.show().collect()} == {"a.txt", "dir/b.txt", wh.IGNORE_FILE}


def test_guard(store):
    ok = store.guard([sys.executable, "-c", "open('made.txt', 'w').write('1')"])
    assert ok.process_exit_code() == 0 and ok.drift == [("made.txt", "added")] and not ok.reverted
    bad = store.guard([sys.executable, "-c", "open('worse.txt', 'w').write('1'); raise SystemExit(3)"], revert="on-fail")
    assert bad.process_exit_code() == 3 and bad.reverted and not os.path.exists(f"{store.root}/worse.txt")
    head = store.head()
    with pytest.raises(OSError):
        store.guard(["/no/such/command"])
    assert store.head() == head


def test_lock_keeps_others_out(store):
    with store.lock(), pytest.raises(wh.Locked):
        store.snap()


def test_audit_tampering_is_found(store):
    store.snap("x")
    store.snap("y")
    path = os.path.join(store.path, "audit.jsonl")
    text = open(path).read()
    open(path, "w").write(text.replace('"snap"', '"span"', 1))
    out = store.verify()
    assert not out["valid"] and out["first_bad"] == 1
    open(path, "w").write(text + "no json\n")
    with pytest.raises(wh.Corrupt):
        store.verify()


def test_signatures(spark, tmp_path):
    pub = signing.generate(spark, str(tmp_path / "key"))
    with pytest.raises(FileExistsError):
        signing.generate(spark, str(tmp_path / "key"))
    key = signing.load(str(tmp_path / "key"))
    assert key[1] == pub
    doc = signing.signed_document(spark, "f/v1", {"a": "é"}, key)
    assert signing.opened(spark, doc, "f/v1", pub)["a"] == "é"
    for broken in (doc.replace("\\u00e9", "e"), doc.replace("f/v1", "g/v1"), "{}", "[]", doc[:-3]):
        with pytest.raises(signing.BadSignature):
            signing.opened(spark, broken, "f/v1")
    os.chmod(tmp_path / "key", 0o644)
    with pytest.raises(PermissionError):
        signing.load(str(tmp_path / "key"))
    # RFC 8032, test 2
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert signing.sign(spark, seed, "r").startswith("92a009a9f0d4cab8720e820b5f642540")


def test_purge_and_certificate(spark, store, tmp_path):
    signing.generate(spark, str(tmp_path / "key"))
    key = signing.load(str(tmp_path / "key"))
    open(f"{store.root}/secret.txt", "w").write("only here")
    open(f"{store.root}/dir/twin.bin", "wb").write(b"\x07" * 200_000)
    first = store.snap()
    out = store.purge("secret.txt", key)
    assert out["chunks_removed"] == 1 and out["manifests_touched"] == 1 and out["live_removed"]
    assert store.verify_certificate(out["certificate"], key[1], objects=True)["path"] == "secret.txt"
    twin = store.purge("dir/twin.bin", key)
    assert twin["chunks_removed"] == 0 and twin["chunks_retained_shared"] >= 1
    with pytest.raises(wh.Purged):
        store.revert(first, force=True)
    with pytest.raises(wh.Purged):
        store.purge("secret.txt", key)
    open(f"{store.root}/again.txt", "w").write("only here")
    store.snap()
    assert "again.txt" not in {r["path"] for r in store.show().collect()}
    assert store.verify(objects=True)["corrupt"] == 0


def test_pull_anchor_and_orders(spark, store, tmp_path):
    signing.generate(spark, str(tmp_path / "key"))
    key = signing.load(str(tmp_path / "key"))
    first = store.snap("one")
    other = wh.Warehouse.init(spark, str(tmp_path / "peer"))
    got = other.pull(store, "peer:1")
    assert got["manifests_fetched"] == 1 and got["fetched"] > 0 and os.path.exists(os.path.join(other.path, "remotes", "peer_1"))
    assert other.pull(store, "peer:1")["fetched"] == 0
    assert other.show(first).count() == 3
    with pytest.raises(wh.WarehouseError):
        store.anchor(os.path.join(store.path, "anchors"), key)
    a = store.anchor(str(tmp_path / "anchors"), key)
    b = store.anchor(str(tmp_path / "anchors"), key)
    assert store.verify_anchor(a)["audit_len"] == 2 and store.verify_anchor(b, key[1], prev=a)
    with pytest.raises(wh.Corrupt):
        store.verify_anchor(a, prev=b)
    with pytest.raises(wh.Corrupt):
        other.verify_anchor(a)
    order = store.order(first, key)
    with pytest.raises(wh.WarehouseError):
        other.apply_order(order)
    other.trust(key[1])
    other.trust(key[1])
    with pytest.raises(wh.WarehouseError):
        other.trust("00" * 32)
    other.apply_order(order, source=store)
    assert contents(other.root) == contents(store.root)
    path = os.path.join(store.path, "audit.jsonl")
    text = open(path).read().splitlines(keepends=True)
    open(path, "w").write("".join(text[1:]))
    with pytest.raises(wh.Corrupt):
        store.verify_anchor(a)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from tidemark import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    root = tree(tmp_path / "c")
    monkeypatch.chdir(root)
    assert cli.main(["status"]) == 1, "no store yet"
    assert cli.main(["init"]) == 0 and cli.main(["snap", "-m", "first"]) == 0
    (root / "a.txt").write_text("other")
    capsys.readouterr()
    assert cli.main(["status"]) == 0
    assert capsys.readouterr().out == "~ a.txt\n0 added, 1 modified, 0 deleted\n"
    assert cli.main(["revert", "head"]) == 1
    assert cli.main(["revert", "head", "--force"]) == 0 and (root / "a.txt").read_text() == "hello"
    assert cli.main(["guard", "--", sys.executable, "-c", "raise SystemExit(7)"]) == 7
    capsys.readouterr()
    assert cli.main(["log"]) == 0 and "first" in capsys.readouterr().out
    assert cli.main(["--key", str(tmp_path / "k"), "anchor", "keygen"]) == 0
    assert cli.main(["--key", str(tmp_path / "k"), "anchor", "create", str(tmp_path / "anchors")]) == 0
    assert cli.main(["verify", "--objects"]) == 0
    assert cli.main(["show", "ffff"]) == 1


def test_change_source(spark, tmp_path):
    from tidemark.sources.changes import ChangeReader

    root = tree(tmp_path / "s")
    reader = ChangeReader(str(root))
    start = reader.initialOffset()
    (root / "a.txt").write_text("longer than before")
    os.unlink(root / "dir/b.txt")
    rows, end = reader.read(start)
    assert [p for _, p in rows] == ["a.txt", "dir/b.txt"]
    assert [p for _, p in reader.readBetweenOffsets(start, end)] == ["a.txt", "dir/b.txt"]
    assert list(reader.read(end)[0]) == []


def test_audit_log_takes_any_characters(store):
    """Control characters, quotes and other scripts: one canonical form in writer and verifier."""
    store.snap("bad \x1b message")
    for part in ("".join(map(chr, range(0x20))), 'a "quoted" \\u001b \\ text', "é 北京 \u2028 \x7f 😀"):
        store.record("note", part)
    out = store.verify()
    assert out["valid"] and out["entries"] == 5
    assert [r["detail"] for r in store.audit().orderBy("line_no").collect()][2] == "".join(map(chr, range(0x20)))


def test_orders_and_certificates_are_bound_to_their_warehouse(spark, store, tmp_path):
    signing.generate(spark, str(tmp_path / "key"))
    key = signing.load(str(tmp_path / "key"))
    first = store.snap("one")
    other = wh.Warehouse.init(spark, str(tree(tmp_path / "other")))
    open(f"{other.root}/mine.txt", "w").write("mine")
    other.snap("own work")
    other.trust(key[1])
    before = contents(other.root)
    with pytest.raises(wh.Corrupt):
        other.apply_order(store.order(first, key), source=store, force=True)
    assert contents(other.root) == before
    out = store.purge("a.txt", key)
    (tmp_path / "other/.tidemark/tombstones.jsonl").write_text(open(f"{store.path}/tombstones.jsonl").read())
    assert store.verify_certificate(out["certificate"])["path"] == "a.txt"
    with pytest.raises(wh.Corrupt):
        other.verify_certificate(out["certificate"])


def test_forged_manifests_are_not_pulled(spark, store, tmp_path):
    """A peer that adds an entry under an id that doesn't hash it, or changes a header."""
    first = store.snap("one")
    peer = wh.Warehouse.init(spark, str(tmp_path / "peer"))
    extra = store.entries(first).limit(1).withColumn("path", wh.F.lit("planted.sh"))
    store._append(extra, "entries", "snapshot_id")
    with pytest.raises(wh.Corrupt):
        peer.pull(store)
    assert peer.entries().isEmpty() and peer.snapshots().isEmpty()


def test_limits_hold_for_each_manifest_of_a_pull(spark, store, tmp_path, monkeypatch):
    for k in range(3):
        open(f"{store.root}/a.txt", "w").write(f"version {k}")
        store.snap(f"s{k}")
    monkeypatch.setattr(wh, "MOST_FILES", 4)
    peer = wh.Warehouse.init(spark, str(tmp_path / "peer"))
    assert peer.pull(store)["manifests_fetched"] == 3
    monkeypatch.setattr(wh, "MOST_FILES", 2)
    with pytest.raises(wh.Corrupt):
        wh.Warehouse.init(spark, str(tmp_path / "strict")).pull(store)


@pytest.mark.parametrize("swapped", [0, 1])
def test_a_purge_that_dies_is_ended_by_the_next_writer(spark, store, tmp_path, monkeypatch, swapped):
    """Before the first folder is swapped, and after it."""
    signing.generate(spark, str(tmp_path / "key"))
    for k in range(6):
        open(f"{store.root}/secret{k}.txt", "w").write(f"only here {k}")
    first = store.snap("one")
    doomed = store.entries(first).where("path = 'secret0.txt'").select(wh.F.explode("chunks").alias("hash"))
    kept = {r["hash"] for r in store.chunks().collect()} - {doomed.first()[0]}
    doomed = spark.createDataFrame(doomed.collect(), "hash string")
    real = wh.Warehouse._end_sweep
    with monkeypatch.context() as m:
        m.setattr(wh.Warehouse, "_end_sweep", lambda self: None)
        store._sweep(doomed)
    journal = __import__("json").loads(open(f"{store.path}/sweep").read())
    if swapped:
        for p in journal["full"][:1]:
            import shutil

            shutil.rmtree(f"{store.path}/chunks/prefix={p}")
            os.rename(f"{store.path}/{journal['staging']}/prefix={p}", f"{store.path}/chunks/prefix={p}")
    assert wh.Warehouse._end_sweep is real
    with store.lock():
        pass
    rows = [r["hash"] for r in store.chunks().collect()]
    assert sorted(rows) == sorted(kept) and not os.path.exists(f"{store.path}/sweep")


def test_tables_on_another_file_system(spark, tmp_path):
    """The tables' folder is a URI; the worktree holds pointers only."""
    w = wh.Warehouse.init(spark, str(tree(tmp_path / "w")), f"file://{tmp_path}/far/tables")
    first = w.snap("one")
    assert (tmp_path / "far/tables/chunks").is_dir() and not os.listdir(f"{w.path}/chunks")
    open(f"{w.root}/a.txt", "w").write("changed")
    w.revert(first, force=True)
    assert contents(w.root)["a.txt"] == b"hello"
    hash_ = w.entries(first).where("path = 'a.txt'").first()["chunks"][0]
    assert w.object(hash_) == b"hello"
    with pytest.raises(wh.MissingObject):
        w.object("00" * 32)


def test_files_that_change_while_they_are_read(spark, store, monkeypatch):
    """What one look saw is stored and the path is marked."""
    real = wh.Warehouse.pieces

    def late(self, wanted):
        open(f"{self.root}/a.txt", "w").write("changed between the looks")
        return real(self, wanted)

    monkeypatch.setattr(wh.Warehouse, "pieces", late)
    snapshot_id = store.snap("one")
    row = store.snapshots().where(wh.F.col("snapshot_id") == snapshot_id).first()
    assert row["unstable"] == ["a.txt"]
    monkeypatch.undo()
    store.revert(snapshot_id, force=True)
    assert contents(store.root)["a.txt"] == b"changed between the looks"


def test_guard_keeps_the_commands_own_dashes(spark, tmp_path, monkeypatch, capsys):
    from tidemark import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(tree(tmp_path / "c"))
    assert cli.main(["init"]) == 0
    assert cli.main(["guard", "--", sys.executable, "-c", "import sys; raise SystemExit(len(sys.argv))", "--", "f"]) == 3
    capsys.readouterr()
    assert cli.main(["log"]) == 0 and "3 files" in capsys.readouterr().out
    key = str(tmp_path / "k")
    assert cli.main(["--key", key, "anchor", "keygen"]) == 0
    assert cli.main(["--key", key, "anchor", "next", str(tmp_path / "anchors")]) == 0 and len(os.listdir(tmp_path / "anchors")) == 1
    assert cli.main(["--key", key, "anchor", "schedule", str(tmp_path / "anchors"), "--print"]) == 0
    assert "<integer>300</integer>" in capsys.readouterr().out
