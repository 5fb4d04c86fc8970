"""Command line: scan, clean, known, ignored, history, pack. Exit codes: 0 done, 1 something failed, 2 refused, 130 stopped."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsieve.operators import books, groups, history, memory, removal
from leafsieve.options import GroupingOptions, check_run
from leafsieve.plans import apply, reports, undo
from leafsieve.plans.progress import Watch, ticking
from leafsieve.plans.scan import BOOKS, PAGES, scan, scan_changes
from leafsieve.runtime import materialize
from leafsieve.sources import known_list
from leafsieve.sources.bucketed import Table

#: Of the documents that commands print.
VERSION = 1
#: Versions of a kept table that may still be read, and seconds between lines of progress.
KEEP, TELL = 3, 2.0
TABLES = {
    "books": BOOKS, "pages": PAGES,
    "known": "sid string, note string, tags string, source string, created_at double, thumbnail binary", "known_hashes": "sid string, dhash bigint",
    "ignored": "gid string, note string, created_at double", "ignored_hashes": "gid string, dhash bigint",
    "runs": "id bigint, started_at double, source string, pinned boolean",
    "items": "id bigint, run_id bigint, archive string, output string, backup string, removed bigint, pages array<string>, bytes_freed bigint, converted boolean,"
    " output_size bigint, output_mtime_ns bigint, restored_at double",
    "settings": "name string, value string",
}


#: What tells the rows of a table apart, or what they belong to.
KEYS = {"books": "archive", "pages": "archive", "known": "sid", "known_hashes": "sid", "ignored": "gid", "ignored_hashes": "gid", "runs": "id", "items": "id", "settings": "name"}
#: Buckets of the tables that grow with the pictures; the others have one.
BUCKETS = {"books": 16, "pages": 256}


class Store:
    """The tables that are kept between runs, in a folder that driver and executors share.

    A folder without a scheme is one of this machine, which will do where all runs in one process only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        if "://" not in folder:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError(f"--store {folder}: executors do not see a folder of this machine; name a shared one, such as hdfs://…, or file:///… if it is mounted everywhere")
            folder = f"file://{os.path.abspath(folder)}"
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.folder}/{name}", TABLES[name], KEYS[name], BUCKETS.get(name, 1))

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def write(self, name: str, df: DataFrame) -> None:
        """In place of what is there, which ``df`` may read."""
        self.table(name).overwrite(df)
        self.table(name).vacuum(keep=KEEP)

    def put(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """In place of the rows of the same keys; only buckets that have such are written."""
        self.table(name).put(rows, gone)
        self.table(name).vacuum(keep=KEEP)

    def settings(self) -> dict:
        """What the last scan was asked for; before any, the defaults."""
        kept = {r.name: json.loads(r.value) for r in self.read("settings").collect()}  # a row per setting
        return asdict(GroupingOptions()) | kept

    def journal(self, run: str) -> str:
        """The folder of a run's journal, which tasks write to by its path."""
        if not self.folder.startswith("file:"):
            raise ValueError(f"--store {self.folder}: books are rewritten by tasks that note what they do in files; name a folder that is mounted on all machines as file:///…")
        return os.path.join(self.folder.removeprefix("file://"), "journal", run)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leafsieve")
    top.add_argument("--store", default=os.path.expanduser("~/.leafsieve"), help="folder of the kept tables")
    commands = top.add_subparsers(dest="command", required=True)
    match = argparse.ArgumentParser(add_help=False)
    match.add_argument("paths", nargs="+")
    match.add_argument("--exclude", action="append", default=[])
    for name, default in (("threshold", 0), ("min-pages", 2), ("min-archives", 2), ("edge-window", 3)):
        match.add_argument(f"--{name}", type=int, default=default)
    for name in ("include-flat", "include-first", "skip-last", "exact-only", "no-cache"):
        match.add_argument(f"--{name}", action="store_true")
    commands.add_parser("scan", parents=[match])
    clean = commands.add_parser("clean", parents=[match])
    clean.add_argument("--all", action="store_true")
    clean.add_argument("--group", action="append", default=[])
    clean.add_argument("--known", action="store_true")
    clean.add_argument("--max-fraction", type=float, default=removal.MAX_FRACTION)
    clean.add_argument("--edges", type=int)
    clean.add_argument("--protect", action="append", default=[])
    for name in ("plan", "backup-dir", "output", "quarantine"):
        clean.add_argument(f"--{name}")
    for name in ("leave-cbr", "no-backup", "dry-run", "yes"):
        clean.add_argument(f"--{name}", action="store_true")
    for command, kinds in (("known", ("list", "export", "import", "forget", "clear")), ("ignored", ("list", "forget", "clear")), ("history", ("list", "restore", "export", "pin", "unpin", "clean", "sweep")), ("pack", ("export", "import"))):
        sub = commands.add_parser(command)
        sub.add_argument("action", choices=kinds)
        sub.add_argument("argument", nargs="?")
    return top


def _tell_scan(seen: dict) -> None:
    left = "" if seen["eta"] is None else f", {seen['eta']:.0f} s left"
    print(f"{seen['books']} of {seen['of']} books, {seen['bytes']} of {seen['of_bytes']} bytes read{left}", file=sys.stderr)


def _scan(args: argparse.Namespace, spark: SparkSession, store: Store) -> tuple[DataFrame, DataFrame, groups.Groups, GroupingOptions]:
    options = GroupingOptions(
        args.threshold, args.min_pages, args.min_archives, args.include_flat, not args.include_first, args.skip_last, args.edge_window
    ).check()
    missing = [p for p in args.paths if not os.path.exists(p)]
    if missing:
        raise ValueError(f"no such path: {missing[0]}")
    ignored = known = None
    watch = Watch(spark, _tell_scan, TELL)
    if args.no_cache:
        archives, pages = scan(spark, args.paths, None, args.exclude, watch)
    else:
        found = scan_changes(spark, args.paths, (store.read("books"), store.read("pages")), args.exclude, watch)
        store.put("settings", spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(options).items()], TABLES["settings"]))
        store.put("pages", found.pages, found.gone)
        store.put("books", found.books, found.gone)
        archives, pages = (store.read(name).join(found.files.select("archive"), "archive", "left_semi") for name in ("books", "pages"))
        ignored = memory.ignored_hash_map(store.read("ignored"), store.read("ignored_hashes")).select("dhash")
        known = store.read("known_hashes").select("dhash")
    made = groups.build_groups(pages, archives, options, ignored, known)
    kept = materialize(made.groups.where("kind = 'exact'") if args.exact_only else made.groups, "groups")
    members = materialize(made.members.join(kept.select("gid"), "gid", "left_semi"), "members")
    return archives, pages, groups.Groups(kept, members), options


def run_scan(args, spark, store, out) -> int:
    archives, pages, made, _ = _scan(args, spark, store)
    totals = _library(archives)
    out.write(f'{{"version": {VERSION}, "library": {json.dumps(totals, ensure_ascii=False)}, "groups": [')
    for row in reports.group_rows(made.groups, made.members).orderBy("position", "rank").toLocalIterator():
        out.write(("," if row.position and not row.rank else "") + row.text)
    out.write('], "duplicate_books": [')
    for k, row in enumerate(reports.pair_documents(books.pair_order(books.duplicate_books(pages, archives))).toLocalIterator()):
        out.write(("," if k else "") + row.document)
    out.write("]}\n")
    return int(totals["unreadable"] > 0)


def run_clean(args, spark, store, out) -> int:
    check_run(args.max_fraction, choose_all=args.all, groups=tuple(args.group), known_only=args.known)
    back = apply.recover([p for p in args.paths if os.path.isdir(p)], dry_run=args.dry_run)
    archives, _, made, _ = _scan(args, spark, store)
    chosen = made.groups if args.all else groups.group_filter(made.groups, "known") if args.known else groups.select_groups(made.groups, args.group)
    decided = chosen.withColumn("decision", F.lit("delete"))
    kept = removal.off_edge(made.members, archives, args.edges) if args.edges else None
    gone = materialize(removal.pages_to_remove(made.members, decided, kept), "gone")
    plans = removal.split_by_fraction(removal.build_plans(gone, archives), args.max_fraction)
    plans = materialize(plans, "drafts")
    looked = apply.look_at(plans)
    plans = removal.split_protected(removal.split_cbr(plans, looked), args.protect)
    reason = (
        F.when(F.col("protected"), removal.PROTECTED).when(F.col("leave") & F.lit(args.leave_cbr), removal.LEFT).when(F.col("over"), removal.OVER_LIMIT)
    )
    plans = materialize(plans.withColumn("reason", reason), "plans")
    todo = plans.where("reason is null")
    if args.plan:
        records = removal.plan_records(todo.select("archive", "original_pages", "removed"), plans.where("reason is not null").select("archive", "original_pages", "removed", "reason"), args.dry_run)
        (reports.write_plan_csv if args.plan.endswith(".csv") else reports.write_plan_json)(records, args.plan)
    if not args.yes and not args.dry_run:
        raise ValueError("nothing was changed: confirm with --yes, or look with --dry-run")
    policy = apply.Policy(not args.no_backup, args.backup_dir, args.output, args.quarantine, False, args.dry_run)
    run = f"{int(time.time())}-{uuid.uuid4().hex[:6]}"
    root = os.path.commonpath([os.path.abspath(p if os.path.isdir(p) else os.path.dirname(p)) for p in args.paths])
    journal = store.journal(run)
    short = [r.asDict() for r in apply.shortfall(todo, looked, policy).collect()]  # a row per volume
    if short:  # a run that can't end is not begun, and a dry run says so too
        json.dump({"version": VERSION, "dry_run": args.dry_run, "space_shortfall": short, "removed": 0, "bytes_freed": 0, "failed": 0}, out, indent=2)
        return 1
    count = todo.count()
    try:
        with ticking(lambda: {"done": apply.progress(journal)}, lambda seen: print(f"{seen['done']} of {count} books cleaned", file=sys.stderr), TELL):
            results = apply.apply_removals(todo, policy, journal, root=root)
    except KeyboardInterrupt:
        apply.cancel(journal)  # tasks end with the book that they are at
        raise
    remembered = 0 if args.dry_run else _remember(store, results, todo, gone, made)
    report = {"version": VERSION, "dry_run": args.dry_run, "recovered": len(back), "library": _library(archives), **removal.clean_report(results).first().asDict()}
    report |= {"space_shortfall": [], "remembered": remembered, "spared_mid_book": kept.join(decided.select("gid"), "gid", "left_semi").count() if kept is not None else 0}
    report["skipped"] = {r.reason: r.n for r in plans.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    report["left_unchanged"] = [r.archive for r in books.in_order(plans.where(F.col("reason") == removal.LEFT)).select("archive").toLocalIterator()]
    report["results"] = [r.asDict() for r in books.in_order(results).toLocalIterator()]
    json.dump(report, out, indent=2)
    return int(report["failed"] > 0)


def _library(archives: DataFrame) -> dict:
    """Totals, and the books that can't be read, in order."""
    bad = books.in_order(archives.where(F.coalesce("error", F.lit("")) != ""))
    return books.library_totals(archives).first().asDict() | {"errors": [{"path": r.archive, "error": r.error} for r in bad.toLocalIterator()]}


def _remember(store: Store, results: DataFrame, plans: DataFrame, gone: DataFrame, made: groups.Groups) -> int:
    """Learn the groups of which a page went, how many they are, and note the run."""
    done = results.where("error is null and not skipped")
    learned = materialize(memory.learn_from_run(gone, made.members, done.select("archive")), "learned")
    now = time.time()
    new = made.groups.join(learned.select("sid").distinct(), F.col("gid") == F.col("sid"), "left_semi").select(
        F.col("gid").alias("sid"), F.concat(F.col("page_count"), F.lit(" copies in "), F.col("archive_count"), F.lit(" book(s)")).alias("note"), F.lit("removed").alias("source"),
        F.lit("").alias("tags"), F.lit(None).cast("binary").alias("thumbnail"), F.lit(0).cast("long").alias("at"),
    )
    old = store.read("known")
    times = old.select("sid", "created_at")
    known = memory.merge_known(old.select("sid", "note", "source", "tags", "thumbnail"), new).join(times, "sid", "left")
    store.write("known", known.withColumn("created_at", F.coalesce("created_at", F.lit(now))))
    store.write("known_hashes", memory.merge_hashes(store.read("known_hashes"), learned))
    items = history.record_run(results, plans)
    count = learned.select("sid").distinct().count()
    if items.isEmpty():
        return count
    runs = store.read("runs")
    number = (runs.agg(F.max("id")).first()[0] or 0) + 1
    one = store.spark.createDataFrame([(number, now, "cli", False)], TABLES["runs"])
    store.write("runs", runs.unionByName(one))
    none = {c: F.lit(None).cast(t) for c, t in (("output_size", "long"), ("output_mtime_ns", "long"), ("restored_at", "double"))}
    fresh = items.withColumn("run_id", F.lit(number).cast("long")).withColumn("id", F.xxhash64("run_id", "archive")).withColumns(none)
    store.write("items", store.read("items").unionByName(fresh.select(*store.read("items").columns)))
    return count


def run_known(args, spark, store, out) -> int:
    known, hashes = store.read("known"), store.read("known_hashes")
    if args.action == "list":
        for r in memory.known_entries(known, hashes).toLocalIterator():
            print(r.sid, r.hashes, r.source, r.note, r.tags, sep="\t", file=out)
        return 0
    if args.action == "clear":
        store.write("known", known.limit(0))
        store.write("known_hashes", hashes.limit(0))
        return 0
    if not args.argument:
        raise ValueError("a file or an id is asked for")
    if args.action == "export":
        known_list.write_known(known, hashes, args.argument)
    elif args.action == "import":
        _import_known(store, known_list.read_known(spark, args.argument))
    else:
        hit = known.where(F.col("sid").startswith(args.argument.strip().lower())).select("sid")
        if hit.count() != 1:
            raise ValueError(f"{args.argument} names no entry, or several")
        hit = materialize(hit, "hit")
        store.write("known", memory.forget(known, hit))
        store.write("known_hashes", memory.forget(hashes, hit))
    return 0


def _import_known(store: Store, entries: DataFrame) -> None:
    old = store.read("known")
    new = entries.select("sid", "note", "source", "tags", "thumbnail", F.lit(0).cast("long").alias("at"))
    merged = memory.merge_known(old.select("sid", "note", "source", "tags", "thumbnail"), new).join(old.select("sid", "created_at"), "sid", "left")
    fresh = entries.select("sid", F.explode("hashes").alias("dhash"))
    store.write("known", merged.withColumn("created_at", F.coalesce("created_at", F.lit(time.time()))))
    store.write("known_hashes", memory.merge_hashes(store.read("known_hashes"), fresh))


def run_history(args, spark, store, out) -> int:
    items = undo.with_status(store.read("items"))
    if args.action == "list":
        for r in history.run_totals(store.read("runs"), items).orderBy(F.desc("id")).toLocalIterator():
            print(r.id, r.removed, r.bytes_freed, r.restorable, sep="\t", file=out)
    elif args.action in ("pin", "unpin"):
        store.write("runs", history.pin(store.read("runs"), int(args.argument), args.action == "pin"))
    elif args.action in ("clean", "sweep"):  # backups of one run, or all that are found, but for those that a pinned run needs
        if args.action == "clean":
            found = items.where((F.col("run_id") == int(args.argument)) & F.col("backup").isNotNull()).select(F.col("backup").alias("path")).distinct()
        else:
            folders = undo.backup_folders(items)
            if args.argument:
                folders = folders.unionByName(spark.createDataFrame([(os.path.abspath(args.argument),)], "folder string"))
            found = undo.find_backups(spark, folders).select("path")
        print(*undo.delete_files(history.backups_to_clean(found, items, store.read("runs"))), sep="\t", file=out)
    elif args.action == "export":
        history.history_csv(store.read("runs"), items).write.csv(args.argument, header=True)
    else:
        own = items.where(F.col("run_id") == int(args.argument))
        done = undo.restore_items(own, store.journal(f"restore-{args.argument}"))
        store.put("items", undo.mark_all_restored(store.read("items").join(done.select("id"), "id", "left_semi"), done))
        for r in done.orderBy("archive").toLocalIterator():
            print(r.archive, r.why or "restored", sep="\t", file=out)
        return int(not done.where("why is not null").isEmpty())
    return 0


def run_ignored(args, spark, store, out) -> int:
    entries, hashes = store.read("ignored"), store.read("ignored_hashes")
    if args.action == "list":
        counted = entries.join(hashes.groupBy("gid").agg(F.count("*").alias("n")), "gid", "left").orderBy(F.desc("created_at"), "gid")
        for r in counted.toLocalIterator():
            print(r.gid, r.n or 0, r.note, sep="\t", file=out)
        return 0
    gone = entries.select("gid")
    if args.action == "forget":
        gone = entries.where(F.col("gid") == (args.argument or "").strip().lower()).select("gid")
        if gone.isEmpty():
            raise ValueError(f"{args.argument} is not ignored")
    gone = materialize(gone, "gone")
    store.put("ignored_hashes", hashes.limit(0), gone)
    store.put("ignored", entries.limit(0), gone)
    return 0


def run_pack(args, spark, store, out) -> int:
    if not args.argument:
        raise ValueError("a file is asked for")
    if args.action == "export":
        listed = memory.ignored_hash_map(store.read("ignored"), store.read("ignored_hashes"))
        hexed = listed.groupBy("gid").agg(F.collect_set(F.lower(F.lpad(F.hex("dhash"), 16, "0"))).alias("hashes"))
        known_list.write_pack(store.read("known"), store.read("known_hashes"), hexed.join(store.read("ignored"), "gid"), store.settings(), args.argument)
        return 0
    settings, known, ignored = known_list.read_pack(spark, args.argument)
    _import_known(store, known)
    entries, hashes = memory.widen_ignored(
        store.read("ignored").select("gid", "note"), store.read("ignored_hashes"), ignored.select("gid", "note"), ignored.select("gid", F.explode("hashes").alias("dhash"))
    )
    entries, hashes = materialize(entries, "ignored"), materialize(hashes, "hashes")
    store.write("ignored", entries.withColumn("created_at", F.lit(time.time())))
    store.write("ignored_hashes", hashes)
    json.dump(known_list.setting_changes(store.settings(), settings), out)
    return 0


RUN = {"scan": run_scan, "clean": run_clean, "known": run_known, "ignored": run_ignored, "history": run_history, "pack": run_pack}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        args = parser().parse_args(argv)
    except SystemExit as ended:
        return int(ended.code or 0)
    spark = spark or SparkSession.builder.appName("leafsieve").getOrCreate()
    try:
        return RUN[args.command](args, spark, Store(spark, args.store), out)
    except ValueError as refused:
        print(f"leafsieve: {refused}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return 130


if __name__ == "__main__":
    sys.exit(main())
