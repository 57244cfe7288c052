"""The command line: python -m stratafile [--catalogue PATH] VERB ..."""

from __future__ import annotations

import argparse
import sys

from .errors import CatalogueError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratafile", description="Analyses catalogues of files over many drives.")
    top.add_argument("--catalogue", help="the catalogue's folder; else STRATAFILE_CATALOGUE or the user's data folder")
    top.add_argument("--rows", type=int, default=100, help="rows to show")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args, under=verbs, **more):
        p = under.add_parser(name, **more)
        for a in args:
            flags, options = (a, {}) if isinstance(a, str) else a
            p.add_argument(*([flags] if isinstance(flags, str) else flags), **options)
        return p

    def group(name: str):
        return verb(name).add_subparsers(dest="what", required=True)

    flag, number = {"action": "store_true"}, {"type": int}
    drive = group("drive")
    verb("add", "label", "path", ("--role", {"default": "source"}), ("--readonly", flag), ("--backend", {"default": "local"}), "--remote", under=drive)
    for x in ("remove", "online", "offline", "info"):
        verb(x, "label", under=drive)
    verb("list", under=drive)
    verb("scan", ("label", {"nargs": "?"}), ("path", {"nargs": "?"}), ("--all", flag), ("--include-hidden", flag), ("--follow-symlinks", flag), ("--max-depth", number))
    verb("status", ("--space", flag))
    query = group("query")
    verb("duplicates", "--drive", ("--min-size", number), ("--same-drive", flag), ("--limit", {"type": int, "default": 50}), under=query)
    verb("unclassified", "--drive", ("--limit", number), under=query)
    verb("category", "name", under=query)
    verb("large-files", "--min-size", ("--limit", {"type": int, "default": 50}), under=query)
    verb("backup-unique", ("drive", {"nargs": "?"}), under=query)
    verb("files", "--category", "--extension", ("--min-size", number), "--contains", "--drive", ("--limit", number), under=query)
    verb("classify", "--config", ("--auto", flag))
    plan = group("plan")
    verb("create", "type", "--source", "--target", "--category", ("--group", number), ("--original", number), ("--max-bytes", number), under=plan)
    verb("list", "--status", under=plan)
    for x in ("show", "approve"):
        verb(x, ("id", number), under=plan)
    verb("migrate", ("id", number), ("--execute", flag), ("--dry-run", flag))
    verb("rollback", ("id", number), ("--execute", flag), ("--dry-run", flag))
    verb("verify", "--drive")
    verb("report")
    verb("export", "format", "path")
    policy = group("policy")
    for x in ("validate", "show"):
        verb(x, "path", under=policy)
    for p in (verb("apply", "path", under=policy), verb("run-policy", "path")):
        p.add_argument("--execute", action="store_true")
        p.add_argument("--dry-run", action="store_true")
    verb("import", "path", ("--apply-trash", flag), ("--clear-existing", flag), under=group("rmlint"))
    verb("refresh", ("drive", {"nargs": "?"}), ("--algorithm", {"default": "blake3"}), ("--rehash", flag), under=group("dedup"))
    verb("serve", help="the tools over standard input and output")
    return top


def run(args: argparse.Namespace, c) -> object:
    """What the verb gives: a frame, a text, or nothing. c: the catalogue."""
    from .operators import rules
    from .plans import policy as policies

    v = f"{args.verb} {args.what}" if hasattr(args, "what") else args.verb
    if v == "drive add":
        return f"drive {c.drive_add(args.label, args.path if args.backend == 'local' else None, args.role, args.readonly or None, args.backend, args.remote)}"
    if v == "drive list":
        return c.drive_table()
    if v in ("drive online", "drive offline"):
        return c.drive_online(args.label, args.what == "online")
    if v in ("drive remove", "drive info"):
        return getattr(c, f"drive_{args.what}")(args.label)
    if v == "scan":
        if not args.label and not args.all:
            raise CatalogueError("a label or --all is needed")
        return c.scan(args.label, args.path, include_hidden=args.include_hidden, follow_symlinks=args.follow_symlinks, max_depth=args.max_depth)
    if v == "status":
        return c.space_check() if args.space else c.status()
    if v == "query duplicates":
        return c.query_duplicates(args.min_size, args.drive, args.same_drive, args.limit)
    if v == "query unclassified":
        return c.query_unclassified(args.drive, args.limit)
    if v == "query category":
        return c.query_category(args.name)
    if v == "query large-files":
        return c.query_large_files(policies.size_of(args.min_size) if args.min_size else 100 * 1024 * 1024, args.limit)
    if v == "query backup-unique":
        return c.query_backup_unique(args.drive)
    if v == "query files":
        return c.query_files(args.category, args.extension, args.min_size, args.contains, args.drive, args.limit)
    if v == "classify":
        by = rules.from_file(args.config) if args.config else []
        return c.classify_auto(rule_set=by) if args.auto else c.review(by)
    if v == "plan create":
        return f"plan {c.plan_create(args.type, args.source, args.target, args.category, args.group, args.original, args.max_bytes)}"
    if v == "plan list":
        return c.plan_list(args.status)
    if v in ("plan show", "plan approve"):
        return getattr(c, f"plan_{args.what}")(args.id)
    if v in ("migrate", "rollback"):
        if args.execute == args.dry_run:
            raise CatalogueError("say --execute or --dry-run")
        if v == "migrate":
            return c.migrate_execute(args.id, execute=args.execute)
        from .plans import planner

        return c.rollback(args.id) if args.execute else planner.rollback_order(c.steps, args.id)
    if v == "verify":
        return c.verify(full=True, drive=args.drive)
    if v == "report":
        return c.text_report()
    if v == "export":
        return c.export(args.format, args.path)
    if v in ("policy validate", "policy show"):
        return str(c.policy_validate(args.path))
    if v in ("policy apply", "run-policy"):
        return f"plans {c.policy_apply(args.path, dry_run=args.dry_run or not args.execute, execute=args.execute)}"
    if v == "rmlint import":
        return c.rmlint_import(args.path, args.apply_trash, args.clear_existing)
    if v == "dedup refresh":
        return c.dedup_refresh(args.drive, args.algorithm, args.rehash)
    from .tools import serve

    return serve(c)


def main(words: list[str] | None = None) -> int:
    args = parser().parse_args(words)
    from pyspark.sql import DataFrame, SparkSession

    from .api import Catalogue

    spark = SparkSession.builder.appName("stratafile").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        found = run(args, Catalogue(spark, args.catalogue))
        if isinstance(found, DataFrame):
            found.show(args.rows, truncate=False)
        elif found is not None:
            print(found)
        return 0
    except CatalogueError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
