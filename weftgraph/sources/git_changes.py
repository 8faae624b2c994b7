"""Changes of a git work tree: name-status and hunk records as tables, from git's own output."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
FILES = "path string, old_path string, status string"
HUNKS = "path string, old_start int, old_lines int, new_start int, new_lines int"
_STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified"}
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], check=True, capture_output=True, text=True, errors="replace").stdout


def diff_arguments(mode: str, revision: str | None = None, until: str | None = None) -> list[str]:
    """git diff's arguments for the modes working, staged, commit and range."""
    if mode == "working":
        return ["HEAD"]
    if mode == "staged":
        return ["--cached"]
    if mode == "commit" and revision:
        return [f"{revision}^", revision]
    if mode == "range" and revision and until:
        return [revision, until]
    raise ValueError("mode must be working, staged, commit or range, with its revisions")


def parse_status(text: str) -> list[tuple[str, str | None, str]]:
    """Records of `git diff --name-status -z`."""
    parts, out = text.split("\0"), []
    i = 0
    while i < len(parts) and parts[i]:
        kind = parts[i][0]
        if kind in "RC":
            out.append((parts[i + 2], parts[i + 1] if kind == "R" else None, _STATUS[kind]))
            i += 3
        else:
            out.append((parts[i + 1], None, _STATUS.get(kind, "modified")))
            i += 2
    return out


def parse_hunks(text: str) -> tuple[list[tuple[str, int, int, int, int]], set[str]]:
    """Hunks of `git diff --unified=0`, and the paths of binary files."""
    hunks, binary, old, new = [], set(), None, None
    for line in text.splitlines():
        if line.startswith("diff --git "):
            old = new = None
            if m := re.match(r"diff --git a/(.*) b/(.*)$", line):
                old, new = m[1], m[2]
        elif line.startswith("Binary files "):
            binary.add(new)
        elif m := _HUNK.match(line):
            n = [int(x) if x else 1 for x in (m[1], m[2], m[3], m[4])]
            hunks.append((new or old, *n))
    return hunks, binary


def read_changes(spark: SparkSession, repo: str, mode: str = "working", revision: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """files (FILES) and hunks (HUNKS) of one change. A root commit is compared with the empty tree; untracked files count as added."""
    args = diff_arguments(mode, revision, until)
    if mode == "commit" and len(_git(repo, "rev-list", "--parents", "-n", "1", revision).split()) == 1:
        args[0] = EMPTY_TREE
    files = parse_status(_git(repo, "diff", "--name-status", "-z", "-M", *args))
    hunks, binary = parse_hunks(_git(repo, "diff", "--unified=0", "--no-color", "-M", *args))
    if mode == "working":
        files += [(p, None, "added") for p in _git(repo, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
    files = [(p, o, "binary" if p in binary else s) for p, o, s in files]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(hunks, HUNKS)


def read_snapshot(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """path, content of every file of a revision."""
    paths = [p for p in _git(repo, "ls-tree", "-r", "-z", "--name-only", revision).split("\0") if p]
    return spark.createDataFrame([(p, _git(repo, "show", f"{revision}:{p}")) for p in paths], "path string, content string")
