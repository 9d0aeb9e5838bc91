"""Remote repositories: paged discovery, credentials, commit lookup and shallow checkouts.

Discovery and commit lookup are the control plane and run on the driver; checkouts run in tasks, one per repository. Secrets
come from the environment (of the workers too), never enter a DataFrame and are masked in messages.
"""

from __future__ import annotations

import base64
import json
import os
import re
import shutil
import subprocess
import tempfile
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

_COMMIT = re.compile(r"[0-9a-fA-F]{7,64}")


@dataclass(frozen=True)
class Credentials:
    """Where a secret stands in the environment: a token, or a user and a password."""

    token_env: str = "GIT_TOKEN"
    user_env: str = "GIT_USERNAME"
    password_env: str = "GIT_PASSWORD"
    mode: str = "auto"  # auto, none, token, basic; helper and ssh leave it to git's own credential helper or keys

    def header(self) -> str | None:
        """Authorization value. ``auto`` refuses a half-given pair and a choice between both kinds."""
        get = lambda n: os.environ.get(n, "")
        token, user, password = get(self.token_env), get(self.user_env), get(self.password_env)
        if self.mode == "auto":
            if bool(user) != bool(password):
                raise ValueError("user name and password are given only in part")
            if token and user:
                raise ValueError("both a token and a password are given; choose one")
        if self.mode in ("none", "helper", "ssh") or self.mode == "auto" and not (token or user):
            return None
        if self.mode not in ("auto", "token", "basic"):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.mode == "token" or self.mode == "auto" and token:
            if not token:
                raise ValueError("the token is missing")
            return "Bearer " + token
        if not (user and password):
            raise ValueError("user name or password is missing")
        return "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()

    def mask(self, text: str, limit: int = 4000) -> str:
        """A message without secrets, and of bounded length: values from the environment, and what follows an
        authorization scheme."""
        values = sorted(filter(None, (os.environ.get(n) for n in (self.token_env, self.user_env, self.password_env))), key=len, reverse=True)
        secret = "|".join([r"(?P<scheme>(?i:authorization:\s*(?:basic|bearer)\s+))\S+", *map(re.escape, values)])
        plain = re.sub(secret, lambda m: (m["scheme"] or "") + "<redacted>", text.strip())
        return plain[:limit] + "…<truncated>" * (len(plain) > limit)


def strip_user(url: str) -> str:
    p = urllib.parse.urlsplit(url.strip())
    if p.scheme in ("http", "https", "ssh") and p.hostname:
        return urllib.parse.urlunsplit((p.scheme, p.hostname + (f":{p.port}" if p.port else ""), p.path, p.query, p.fragment))
    return url.strip()


def _get(url: str, header: str | None, opener: Callable | None):
    req = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": header} if header else {}))
    with (opener or urllib.request.urlopen)(req, timeout=60) as answer:
        return json.loads(answer.read()), dict(answer.headers)


def project_pages(base: str, project: str, credentials: Credentials = Credentials(), opener=None, page: int = 100) -> Iterator[dict]:
    """Repositories of a project, from pages that say where the next one starts."""
    start, header = 0, credentials.header()
    while True:
        body, _ = _get(f"{base.rstrip('/')}/rest/api/1.0/projects/{urllib.parse.quote(project)}/repos?limit={page}&start={start}", header, opener)
        for r in body.get("values", []):
            links = (r.get("links") or {}).get("clone") or []
            url = next((x["href"] for x in links if str(x.get("name", "")).startswith("http")), None)
            if url:
                yield {"repository_name": r.get("slug") or r.get("name"), "clone_url": strip_user(url), "scope_key": project}
        if body.get("isLastPage", True):
            return
        following = body.get("nextPageStart")
        if not isinstance(following, int) or following <= start:
            raise ValueError("the next page does not move on")
        start = following


def organization_pages(base: str, organization: str, credentials: Credentials = Credentials(), opener=None, page: int = 50) -> Iterator[dict]:
    """Repositories of an organization, page by page until a Link header has no next, the total is reached, or a page is
    short. Empty repositories are left out, archived ones kept."""
    number, seen, header = 1, 0, credentials.header()
    while True:
        body, headers = _get(f"{base.rstrip('/')}/api/v1/orgs/{urllib.parse.quote(organization)}/repos?limit={page}&page={number}", header, opener)
        low = {k.lower(): v for k, v in headers.items()}
        seen += len(body)
        for r in body:
            if not r.get("empty") and r.get("clone_url"):
                yield {"repository_name": r.get("name"), "clone_url": strip_user(r["clone_url"]), "scope_key": organization}
        total, link = low.get("x-total-count"), low.get("link")
        more = 'rel="next"' in link if link is not None else seen < int(total) if total is not None else len(body) == page
        if not body or not more:
            return
        number += 1


def repositories_table(spark: SparkSession, found, ref: str = "HEAD") -> DataFrame:
    """Discovered repositories with normalised ids; names that share an id are told apart by their address."""
    schema = "repository_name string, clone_url string, scope_key string"
    df = spark.createDataFrame([(r["repository_name"], r["clone_url"], r["scope_key"]) for r in found], schema).distinct()
    plain = S.normalize_repository_id(F.concat_ws("_", "scope_key", "repository_name"))
    df = df.withColumn("_id", plain)
    n = df.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    rid = F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat("_id", F.lit("_"), F.substring(F.sha2("clone_url", 256), 1, 8)))
    return df.join(n, "_id").select(rid.alias("repository_id"), "repository_name", F.col("clone_url").alias("repository_url"), "scope_key", F.lit(ref).alias("requested_ref"))


def read_selectors(spark: SparkSession, path: str) -> DataFrame:
    """Selectors of a text file, one a line, # starts a comment; an empty file is an error. Keeps their order."""
    rows = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
    rows = [x for x in rows if x and not x.startswith("#")]
    if not rows:
        raise ValueError("the selector file names nothing")
    return spark.createDataFrame(list(enumerate(rows)), "position long, selector string")


def _git(args: list[str], header: str | None, **how) -> subprocess.CompletedProcess:
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0"}
    if header:  # by environment: not in the command line
        env |= {"GIT_CONFIG_COUNT": "1", "GIT_CONFIG_KEY_0": "http.extraHeader", "GIT_CONFIG_VALUE_0": f"Authorization: {header}"}
    return subprocess.run(["git", *args], env=env, capture_output=True, text=True, timeout=how.pop("timeout", 600), **how)


def remote_commit(url: str, ref: str = "HEAD", credentials: Credentials = Credentials()) -> str:
    """Commit that a ref names; a ref that is a commit already needs no lookup."""
    if _COMMIT.fullmatch(ref):
        return ref.lower()
    got = _git(["ls-remote", url, ref], credentials.header(), timeout=120)
    lines = [x.split("\t") for x in got.stdout.splitlines() if "\t" in x]
    if got.returncode or not lines:
        raise RuntimeError(credentials.mask(got.stderr or "the ref was not found"))
    exact = [c for c, name in lines if name in (ref, f"refs/heads/{ref}", f"refs/tags/{ref}^{{}}")]
    return (exact or [lines[0][0]])[0]


def is_transient(log: str) -> bool:
    low = log.casefold()
    return not any(x in low for x in S.PERMANENT_FAILURES) and any(x in low for x in S.TRANSIENT_FAILURES)


class Checkout:
    """A shallow clone in a temporary folder that goes in any case."""

    def __init__(self, url: str, ref: str = "HEAD", credentials: Credentials = Credentials(), attempts: int = 3, sleep=time.sleep):
        self.url, self.ref, self.credentials, self.attempts, self.sleep = url, ref, credentials, attempts, sleep

    def __enter__(self) -> tuple[str, str]:
        self.top = tempfile.mkdtemp(prefix="checkout-")
        try:
            return self._clone()
        except BaseException:
            shutil.rmtree(self.top, ignore_errors=True)
            raise

    def _clone(self) -> tuple[str, str]:
        header = self.credentials.header()
        for n in range(1, self.attempts + 1):
            tree = os.path.join(self.top, f"tree{n}")
            got = _git(["init", "-q", tree], None)
            # one commit of depth; a server that gives no single commits is asked for all of them
            for depth in (["--depth", "1"], []) if _COMMIT.fullmatch(self.ref) else (["--depth", "1"],):
                wanted = [] if _COMMIT.fullmatch(self.ref) and not depth else [self.ref]
                got = _git(["fetch", "-q", *depth, self.url, *(wanted or ["+refs/*:refs/remote/*"])], header, cwd=tree)
                if not got.returncode:
                    got = _git(["checkout", "-q", "--detach", "FETCH_HEAD" if wanted else self.ref], None, cwd=tree)
                if not got.returncode or is_transient(got.stderr):
                    break
            if not got.returncode:
                return tree, _git(["rev-parse", "HEAD"], None, cwd=tree).stdout.strip()
            if n == self.attempts or not is_transient(got.stderr):
                raise RuntimeError(self.credentials.mask(got.stderr))
            self.sleep(min(2.0, 0.25 * 2 ** (n - 1)))
        raise AssertionError

    def __exit__(self, *_):
        shutil.rmtree(self.top, ignore_errors=True)


def checkout_rows(credentials: Credentials, excluded: list[str] | None = None, max_bytes: int = 1 << 62):
    """Files of repositories (repo_id, url, ref), one checkout at a time in the task that reads it; it is gone when its rows
    are out. A repository that fails gives one row without a path, with the masked message as its error."""
    from .filetree import EXCLUDED_DIRECTORIES, batch, read_file, walk

    skip = set(EXCLUDED_DIRECTORIES if excluded is None else excluded)

    def run(batches):
        for b in batches:
            for repo, url, ref in zip(*[c.to_pylist() for c in b.columns]):
                rows, held = [], 0
                try:
                    with Checkout(url, ref, credentials) as (tree, _):
                        for path, _ in walk(tree, skip):
                            rows.append((repo, path, *read_file(tree, path, max_bytes)))
                            held += len(rows[-1][4] or b"")
                            if len(rows) >= 1000 or held >= 8 << 20:
                                yield batch(rows)
                                rows, held = [], 0
                except (RuntimeError, OSError, ValueError, subprocess.SubprocessError) as e:
                    rows.append((repo, None, False, None, None, credentials.mask(str(e)) or type(e).__name__))
                if rows:
                    yield batch(rows)

    return run


def checkouts(repositories: DataFrame, credentials: Credentials = Credentials(), excluded: list[str] | None = None) -> DataFrame:
    """Raw file rows of ``repositories`` (repo_id, url, ref), a task per repository; nothing of them stays on a machine."""
    from ..workers import ship
    from .filetree import SCHEMA

    ship(repositories.sparkSession)
    n = max(1, repositories.count())
    rows = repositories.select("repo_id", "url", "ref").repartition(n)
    return rows.mapInArrow(checkout_rows(credentials, excluded), SCHEMA)
