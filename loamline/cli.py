"""Command line: analyse a git repository, keep runs, list and serve them."""

from __future__ import annotations

import argparse
import re
import sys
from datetime import UTC, datetime
from pathlib import Path

from .operators import activity, code, compare, knowledge
from .plans.analysis import Analysis
from .session import local_session
from .sources.git import Repository
from .sources.runs import RunStore


def window(text: str) -> int:
    if not (m := re.fullmatch(r"(\d+)d", text)):
        raise argparse.ArgumentTypeError(f"{text!r} isn't a number of days like 90d")
    return int(m[1])


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loamline", description="Change-history and source-tree analytics")
    p.add_argument("repo_path", nargs="?")
    p.add_argument("--window", type=window, default=90, metavar="DAYS", help="days to look back, like 90d")
    for name in ("knowledge", "coupling", "anemic", "complexity", "god-class", "clustering", "effort", "dx"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--at", metavar="REF", help="look from this commit, tag, branch or date")
    p.add_argument("--from", dest="from_ref", metavar="REF")
    p.add_argument("--to", dest="to_ref", metavar="REF")
    p.add_argument("--all", dest="run_all", action="store_true", help="all analyses, kept as a run")
    p.add_argument("--db", metavar="PATH", default=str(Path.home() / ".loamline" / "runs"), help="folder of the run store")
    p.add_argument("--list-runs", action="store_true")
    p.add_argument("--serve", action="store_true")
    p.add_argument("--port", type=int, default=8000)
    args = p.parse_args(argv)
    if not (args.list_runs or args.serve):
        if args.repo_path is None:
            p.error("repo_path is required")
        if args.at and (args.from_ref or args.to_ref):
            p.error("--at cannot be combined with --from/--to")
        if bool(args.from_ref) != bool(args.to_ref):
            p.error("--from and --to require each other")
        if args.run_all and args.from_ref:
            p.error("--all cannot be combined with --from/--to")
    return args


def show(title: str, frame, *order: str, k: int = 20) -> None:
    total = frame.count()
    print(f"\n{title}")
    frame.orderBy(*(activity.F.desc(c[1:]) if c[0] == "-" else c for c in order)).limit(k).show(k, truncate=60)
    if total > k:
        print(f"... and {total - k} more")


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = local_session()
    store = RunStore(spark, f"file://{Path(args.db).expanduser().resolve()}")
    if args.list_runs:
        store.list_runs().show(100, truncate=False)
        return 0
    if args.serve:
        from .plans.api import serve

        print(f"http://127.0.0.1:{args.port}/api/repos")
        serve(store, args.port).serve_forever()
    try:
        repo = Repository(args.repo_path)
        now = repo.resolve(args.at) if args.at else datetime.now(UTC)
        before, after = (repo.resolve(r) if r else None for r in (args.from_ref, args.to_ref))
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if not repo.commit_count():
        print("no commits")
        return 0
    ref = args.at if args.at and not re.match(r"\d{4}-", args.at) else "HEAD"
    a = Analysis(spark, repo.changes(spark), repo.sizes(spark), repo.sources(spark, ref), after or now, args.window, str(repo.path))
    if before:
        each = a.compared(before).withColumn("moved", activity.F.abs("score_delta"))
        show("Comparison", each, "-moved", "file_path")
        compare.counts(each).show()
        return 0
    repo.summary(spark).show(truncate=False)
    show("Hotspots", a.hotspots(), "-hotspot_score", "file_path")
    activity.effort_distribution(a.hotspots()).orderBy("threshold").show()
    if args.knowledge or args.run_all:
        show("Knowledge", a.knowledge(), "-knowledge_concentration", "file_path")
        knowledge.gini(a.changes, a.now, a.days).show()
    if args.coupling or args.run_all:
        show("Coupling", a.pairs(), "-coupling_strength", "file_a", "file_b")
        show("PAIN", a.pain(), "-pain_score", "file_path")
    if args.anemic or args.run_all:
        show("Anemic classes", code.classes(a.read), "-ams", "file_path")
        code.anemic_report(a.read).show()
    if args.complexity or args.run_all:
        show("Complexity", code.functions(a.read), "-cyclomatic_complexity", "file_path", "line_number")
        code.complexity_report(code.functions(a.read)).show()
    if args.god_class or args.run_all:
        show("God classes", code.god_classes(a.read), "-god_class_score", "file_path")
    if args.clustering or args.run_all:
        found = a.clusters()
        print(f"\nClusters: k {found['k']}, silhouette {found['silhouette']}")
        for frame in (found["summaries"], found["drift"]):
            if frame is not None:
                frame.show(truncate=False)
    if args.effort or args.run_all:
        found = a.effort()
        print(f"\nEffort: alpha {found['alpha']}, R2 {found['r_squared']}, coefficients {found['coefficients']}")
        show("Relative effort", found["files"], "-rei_score", "file_path")
    if args.dx or args.run_all:
        report, load = a.experience()
        report.show(truncate=False)
        show("Cognitive load", load, "-composite_load", "file_path", k=10)
    if args.run_all:
        print(f"run {a.save(store)} kept in {args.db}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
