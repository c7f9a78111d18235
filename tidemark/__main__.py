"""Command line: python -m tidemark <command>. Exit codes: 0, 1 for a refusal, guard passes its command's on."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tidemark.functions import signing
from tidemark.operators import history, undo
from tidemark.sources.warehouse import Warehouse, WarehouseError, find_root
from tidemark.streaming import periodic

MARKS = {"added": "+", "modified": "~", "deleted": "-", "touched": "."}
KEY = "TIDEMARK_KEY"


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Versions of a file tree as Spark tables.")
    p.add_argument("--key", default=os.environ.get(KEY), help="file of the signing key")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple, **kwargs) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **kwargs)
        for flags, options in arguments:
            c.add_argument(*flags, **options)
        return c

    flag = {"action": "store_true"}
    add("init", (["dir"], {"nargs": "?", "default": "."}), (["--tables"], {"help": "URI of a folder for the tables"}))
    add("snap", (["-m", "--message"], {"default": ""}), (["--actor"], {"default": os.environ.get("TIDEMARK_ACTOR")}))
    add("log", (["-n"], {"type": int, "default": 20}))
    add("show", (["id"], {"nargs": "?", "default": "head"}))
    add("status", (["id"], {"nargs": "?", "default": "head"}), (["--full"], flag))
    add("diff", (["old"], {}), (["new"], {"nargs": "?", "default": "head"}))
    add("revert", (["id"], {"nargs": "?"}), (["--actor"], {}), (["--keep-extra"], flag), (["--force"], flag))
    add("watch", (["--checkpoint"], {}))
    add("verify", (["--objects"], flag))
    add("pull", (["peer"], {}))
    add("guard", (["--revert"], {"choices": ["never", "on-fail", "always"], "default": "never"}), (["--full"], flag), (["cmd"], {"nargs": argparse.REMAINDER}))
    add("purge", (["path"], {"nargs": "?"}), (["--out"], {}), (["--verify"], {}), (["--pubkey"], {}))
    add("fleet", (["action"], {"choices": ["trust", "order", "apply"]}), (["value"], {}), (["--out"], {}), (["--from"], {"dest": "source"}), (["--force"], flag))
    add("anchor", (["action"], {"choices": ["keygen", "pubkey", "create", "next", "schedule", "verify"]}), (["value"], {"nargs": "?"}), (["--every"], {"type": int, "default": periodic.DEFAULT_INTERVAL}), (["--print"], {"action": "store_true", "dest": "show", "help": "the text for an external scheduler instead"}), (["--pubkey"], {}), (["--prev"], {}))
    return p


def print_changes(changes) -> None:
    """One line for each path, then totals, which leave touched files out."""
    counts = dict.fromkeys(MARKS, 0)
    for row in changes.orderBy("path").toLocalIterator():
        counts[row["status"]] += 1
        print(MARKS[row["status"]], row["path"])
    print(", ".join(f"{counts[s]} {s}" for s in ("added", "modified", "deleted")))


def write_out(text: str, path: str | None) -> None:
    if path:
        with open(path, "x") as file:
            file.write(text)
    else:
        print(text)


def run(args: argparse.Namespace) -> int:
    spark = session()
    if args.command == "init":
        Warehouse.init(spark, args.dir, args.tables)
        return 0
    if args.command == "anchor" and args.action in ("keygen", "pubkey"):
        print(signing.generate(spark, args.key) if args.action == "keygen" else signing.load(args.key)[1])
        return 0
    w = Warehouse(spark, find_root("."))
    key = lambda: signing.load(args.key)
    if args.command == "snap":
        print(w.snap(args.message, args.actor))
    elif args.command == "log":
        from tidemark.functions.scalars import shown_time

        head = w.head()
        for r in w.log(args.n).withColumn("shown", shown_time(history.F.col("timestamp_secs"))).collect():
            print(r["snapshot_id"][:12], r["shown"], f"{r['files']} files", r["message"], "(HEAD)" if r["snapshot_id"] == head else "")
    elif args.command == "show":
        for r in w.show(args.id).toLocalIterator():
            print(f"{r['size']:>12} {r['path']}")
    elif args.command == "status":
        print_changes(w.status(args.id, args.full))
    elif args.command == "diff":
        print_changes(w.diff(args.old, args.new))
    elif args.command == "revert":
        report = w.revert_actor(args.actor) if args.actor else w.revert(args.id, args.keep_extra, args.force)
        for r in report.orderBy("path").toLocalIterator():
            print(r["action"], r["path"])
    elif args.command == "watch":
        from tidemark.sources.changes import stream_changes
        from tidemark.streaming.watch import watch

        watch(stream_changes(spark, w.root), lambda _, paths: print(*paths, sep="\n", flush=True), args.checkpoint).awaitTermination()
    elif args.command == "verify":
        out = w.verify(args.objects)
        print(", ".join(f"{k} {v}" for k, v in out.items()))
        return 0 if out["valid"] and not out.get("corrupt") else 1
    elif args.command == "pull":
        print(", ".join(f"{k} {v}" for k, v in w.pull(Warehouse(spark, args.peer)).items()))
    elif args.command == "guard":
        report = w.guard(args.cmd[1:] if args.cmd[:1] == ["--"] else args.cmd, args.revert, args.full)
        for path, status in report.drift:
            print(MARKS[status], path)
        return report.process_exit_code()
    elif args.command == "purge":
        if args.verify:
            with open(args.verify) as file:
                print(w.verify_certificate(file.read(), args.pubkey)["path"])
        else:
            write_out(w.purge(args.path, key())["certificate"], args.out)
    elif args.command == "fleet":
        if args.action == "trust":
            w.trust(args.value)
        elif args.action == "order":
            write_out(w.order(args.value, key()), args.out)
        else:
            with open(args.value) as file:
                w.apply_order(file.read(), Warehouse(spark, args.source) if args.source else None, args.force)
    elif args.command == "anchor":
        if args.action in ("create", "next"):
            print(w.anchor(args.value, key()))
        elif args.action == "schedule" and args.show:
            command = [sys.executable, "-m", "tidemark", "--key", os.path.abspath(args.key), "anchor", "next", os.path.abspath(args.value)]
            print(periodic.agent_text(f"tidemark.anchor.{w.warehouse_id()[:12]}", command, args.every), end="")
        elif args.action == "schedule":
            periodic.anchor_every(w, args.value, key(), args.every)
        else:
            print(w.verify_anchor(args.value, args.pubkey, args.prev)["audit_len"])
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (WarehouseError, history.AmbiguousReference, undo.NoChanges, signing.BadSignature, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
