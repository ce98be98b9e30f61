"""Git sources, on the driver: local repositories, clones, pinned snapshots, change sets. Commands have time limits."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a difference and lines of a log that are read.
MAX_DIFF_BYTES, LOG_LINES = 10 * 1024 * 1024, 20
_SHA = re.compile(r"[0-9a-fA-F]{40}\Z")
_NAME = re.compile(r"[A-Za-z0-9._-]+\Z")


def git(args: Sequence[str], cwd: str | None = None, timeout: float = 30, token: str | None = None) -> str:
    """Output of a git command; the token is taken out of errors."""
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, errors="replace", timeout=timeout)
    if done.returncode:
        said = done.stderr.strip() or f"git {args[0]} failed"
        raise RuntimeError(said.replace(token, "***") if token else said)
    return done.stdout


def local_repo(path: str) -> tuple[str, str | None]:
    """Real path and commit of a local folder; the commit is None where it is no repository."""
    full = os.path.realpath(os.path.expanduser(path.strip()))
    if not os.path.isdir(full):
        raise ValueError(f"not a folder: {path}")
    try:
        return full, git(["rev-parse", "HEAD"], full, 10).strip()
    except (RuntimeError, OSError):
        return full, None


def clone(owner: str, name: str, root: str, url: str | None = None, token: str | None = None) -> tuple[str, str]:
    """Path and commit of a clone that is brought up to date; a clone that can't be is made anew."""
    if not (_NAME.match(owner) and _NAME.match(name)):
        raise ValueError("bad repository name")
    path = os.path.join(root, owner, name)
    source = url or f"https://{f'x-access-token:{token}@' if token else ''}github.com/{owner}/{name}.git"
    if os.path.isdir(os.path.join(path, ".git")):
        try:
            if git(["rev-parse", "--is-shallow-repository"], path, 10).strip() == "true":
                git(["fetch", "--unshallow"], path, 300, token)
            git(["pull", "--ff-only"], path, 120, token)
        except (RuntimeError, subprocess.TimeoutExpired):
            shutil.rmtree(path)
    if not os.path.isdir(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        git(["clone", source, path], timeout=300, token=token)
    return path, git(["rev-parse", "HEAD"], path, 10).strip()


def snapshot(source: str, sha: str, root: str, name: str) -> str:
    """A checkout at a commit, kept by the commit and used again."""
    if not _SHA.match(sha):
        raise ValueError("bad commit id")
    path = os.path.join(root, f"{name}-{sha[:12]}")
    if os.path.isdir(path) and git(["rev-parse", "HEAD"], path, 10).strip() == sha:
        return path
    shutil.rmtree(path, ignore_errors=True)
    git(["clone", source, path], timeout=300)
    git(["checkout", sha], path, 60)
    return path


def default_branch(path: str) -> str:
    try:
        return git(["symbolic-ref", "--short", "refs/remotes/origin/HEAD"], path, 10).strip().split("/", 1)[-1] or "main"
    except RuntimeError:
        return "main"


def changes(spark: SparkSession, path: str, since: str) -> tuple[DataFrame, str, int, str]:
    """Changed files, the difference, the number of commits and the last lines of the log since a commit."""
    if not _SHA.match(since):
        raise ValueError("bad commit id")
    span = f"{since}..HEAD"
    names = [(x,) for x in git(["diff", "--name-only", "-z", span], path).split("\0") if x]
    diff = git(["diff", span], path, 60).encode()[:MAX_DIFF_BYTES].decode(errors="ignore")
    count = int(git(["rev-list", "--count", span], path).strip() or 0)
    log = git(["log", "--no-merges", "--oneline", f"-{LOG_LINES}", span], path)
    return spark.createDataFrame(names, "file_path string"), diff, count, log
