"""Commits of Git repositories as rows, one for each changed file."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = "%x01%H%x02%an%x02%ae%x02%cI%x02%B%x03"
_FILE = re.compile(r"^diff --git (?:\"?[ab]/(.*?)\"?) (?:\"?[ab]/(.*?)\"?)$", re.M)
SCHEMA = "repo string, sha string, author_name string, author_email string, cmt_date string, message string, path string, diff string"


def _commits(out: Iterator[str]) -> Iterator[str]:
    """The log cut into commits, read as it comes."""
    held = ""
    for line in out:
        if line.startswith("\x01") and held:
            yield held
            held = ""
        held += line
    if held:
        yield held


def git_commits(repos: DataFrame, repo: str = "repo", branch: str = "HEAD", rows: int = 1000) -> DataFrame:
    """SC01: (repo, sha, author_name, author_email, cmt_date, message, path, diff) of a branch's commits, a row for each file.

    A diff goes from the commit to its first parent (so additions show as removals), that of a first commit to nothing. repos has a row for each
    repository's folder, which all executors must see; each is read by one task as a stream. A folder that is no repository fails.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for at in b["_repo"]:
                cmd = ["git", "-C", at, "-c", "core.quotePath=false", "log", branch, "-p", "-R", "--root", "--no-color", "--no-renames", "--diff-merges=first-parent", f"--format={_FIELDS}"]
                p = subprocess.Popen(cmd, stdout=subprocess.PIPE)
                got = []
                for c in _commits(x.decode("utf-8", "replace") for x in p.stdout):
                    head, _, body = c.partition("\x03")
                    sha, name, mail, date, message = head[1:].split("\x02", 4)
                    files = list(_FILE.finditer(body))
                    for f, nxt in zip(files, [*files[1:], None]):
                        got.append((at, sha, name, mail, date, message.strip("\n"), f.group(1) or f.group(2), body[f.start() : nxt.start() if nxt else len(body)].rstrip("\n")))
                    if len(got) >= rows:
                        yield pd.DataFrame(got, columns=cols)
                        got = []
                if p.wait():
                    raise RuntimeError(f"git log failed on {at}")
                if got:
                    yield pd.DataFrame(got, columns=cols)

    return repos.select(F.col(repo).alias("_repo")).mapInPandas(run, SCHEMA)


def capped(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """SC02, the test mode of a scan: nothing at all if it has more than `most` rows. Only so many are counted."""
    return rows.limit(0) if rows.limit(most + 1).count() > most else rows
