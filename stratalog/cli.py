"""Command line over the job drivers. Exit codes: 0 complete, 2 partial, 1 failed."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators.facts import LIMITS
from .sources import remote
from .sources.remote import Credentials


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog")
    p.add_argument("--pretty", action="store_true", help="indented rows with sorted keys")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args):
        c = sub.add_parser(name)
        for a, how in args:
            c.add_argument(a, **how)

    pos, opt = (lambda n: (n, {})), (lambda n, **k: (n, k))
    how = [opt("--exclude", action="append"), opt("--no-content-capture", action="store_true"), *[opt(f"--{k.replace('_', '-')}-max-bytes", type=int) for k in LIMITS]]
    add("build", pos("repository"), pos("output"), opt("--repo-id"), *how)
    add("verify", pos("artifact"))
    add("reduce", pos("artifact"), pos("output"))
    add("classify-concepts", pos("reduced"), pos("output"))
    add("verify-reduced", pos("reduced"), opt("--artifact"))
    add("verify-concept-candidates", pos("concepts"), pos("reduced"))
    add("build-concept-index", pos("concepts"))
    add("verify-concept-index", pos("concepts"))
    add("candidates", pos("concepts"), pos("concept"), opt("--min-strength", default="moderate"), opt("--mechanism"))
    add("export-selected", pos("artifact"), pos("output"), opt("--evidence-id", action="append", default=[]), opt("--request"), opt("--reduced"), opt("--context-lines", type=int, default=10))
    add("verify-export", pos("pack"), opt("--artifact"))
    add("cas-index", pos("artifact"), opt("--counts", action="store_true", help="totals instead of rows"))
    add("boundaries", pos("artifact"), opt("--protocol", choices=["http", "kafka"], default="http"))
    auth = [opt("--auth", choices=["auto", "none", "token", "basic", "helper", "ssh"], default="auto"), *[opt(f"--{k}-env", default=getattr(Credentials, f"{k}_env")) for k in ("token", "user", "password")]]
    chosen = [opt("--ref", default="HEAD"), opt("--selectors"), opt("--repository-limit", type=int), *how, *auth]
    add("discover-project", pos("base"), pos("project"), *auth)
    add("discover-organization", pos("base"), pos("organization"), *auth)
    add("batch", pos("urls"), pos("output"), *chosen)
    add("batch-project", pos("base"), pos("project"), pos("output"), *chosen)
    add("batch-organization", pos("base"), pos("organization"), pos("output"), *chosen)
    add("compact", pos("folder"))
    add("vacuum", pos("folder"), opt("--older-than", type=float, default=86_400, help="seconds"))
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("stratalog").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(df, pretty: bool = False) -> None:
    """All rows, as JSON lines or indented, a partition at a time; their number goes to stderr."""
    n = 0
    for n, r in enumerate(df.toJSON().toLocalIterator(), 1):
        print(json.dumps(json.loads(r), ensure_ascii=False, sort_keys=True, indent=2) if pretty else r)
    print(f"{n} rows", file=sys.stderr)


def _config(a):
    from .plans.build import Config

    given = {k: getattr(a, f"{k}_max_bytes") for k in LIMITS}
    return Config(a.exclude, not a.no_content_capture, {k: v for k, v in given.items() if v is not None})


def _credentials(a) -> Credentials:
    return Credentials(a.token_env, a.user_env, a.password_env, a.auth)


def _found(a):
    """Repositories of a list of addresses, of a project or of an organization, page by page."""
    if a.command == "batch":
        return [{"repository_name": u.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"), "clone_url": u, "scope_key": "batch"} for u in a.urls.split(",")]
    if a.command.endswith("project"):
        return remote.project_pages(a.base, a.project, _credentials(a))
    return remote.organization_pages(a.base, a.organization, _credentials(a))


def _verdict(show, wrong) -> str:
    show(wrong)
    return "failed" if wrong.head(1) else "complete"


def main(argv: list[str] | None = None, spark=None) -> int:
    from .operators import classify, export, scan
    from .plans import batch, build

    a = _parser().parse_args(argv)
    spark = spark or session()
    show = lambda df: _show(df, a.pretty)
    status = "complete"
    if a.command == "build":
        repo = a.repo_id or os.path.basename(os.path.abspath(a.repository))
        t = build.build(spark, {repo: a.repository}, a.output, how=_config(a))
        show(t["probe_status"])
        status = "partial" if t["probe_status"].filter("status <> 'complete'").head(1) else "complete"
    elif a.command == "verify":
        status = _verdict(show, build.verify_artifact(spark, a.artifact))
    elif a.command == "verify-reduced":
        status = _verdict(show, build.verify_reduced(spark, a.reduced, a.artifact))
    elif a.command == "verify-concept-candidates":
        status = _verdict(show, build.verify_candidates(spark, a.concepts, a.reduced))
    elif a.command == "verify-concept-index":
        status = _verdict(show, build.verify_index(spark, a.concepts))
    elif a.command == "reduce":
        show(build.reduce_tables(spark, a.artifact, a.output)["counts"])
    elif a.command == "classify-concepts":
        show(build.classify_tables(spark, a.reduced, a.output))
    elif a.command == "build-concept-index":
        show(build.build_index(spark, a.concepts))
    elif a.command == "candidates":
        show(classify.lookup(build.read(spark, a.concepts, "candidates"), a.concept, a.min_strength, a.mechanism))
    elif a.command == "export-selected":
        ids = list(a.evidence_id)
        if a.request:
            with open(a.request, encoding="utf-8") as f:
                ids += json.load(f)["evidence_ids"]
        n = build.export_selected(spark, a.artifact, ids, a.output, a.reduced, a.context_lines)
        show(n)
        status = n.first()["status"]
    elif a.command == "verify-export":
        status = _verdict(show, export.verify_pack(spark, a.pack, build.read(spark, a.artifact, "files") if a.artifact else None))
    elif a.command == "cas-index":
        index = build.read(spark, a.artifact, "cas_index")
        show(scan.cas_counts(index) if a.counts else index)
    elif a.command == "boundaries":
        show(build.read(spark, a.artifact, f"boundaries_{a.protocol}"))
    elif a.command in ("discover-project", "discover-organization"):
        show(remote.repositories_table(spark, _found(a)))
    elif a.command.startswith("batch"):
        repos = remote.repositories_table(spark, _found(a), a.ref)
        chosen = batch.select(repos, remote.read_selectors(spark, a.selectors) if a.selectors else None, a.repository_limit)
        c = _config(a)
        s = batch.summary(batch.run(spark, chosen, a.output, _credentials(a), excluded=c.excluded, capture=c.capture, limits=c.limits))
        show(s)
        status = s.first()["status"]
    elif a.command == "compact":
        build.tables.compact(spark, a.folder)
    elif a.command == "vacuum":
        for gone in build.tables.vacuum(spark, a.folder, older_than=a.older_than):
            print(gone)
    return {"complete": 0, "partial": 2}.get(status, 1)


if __name__ == "__main__":
    sys.exit(main())
