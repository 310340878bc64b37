"""A git repository on the driver's disk: its log, sizes, sources and refs as frames."""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import numstat

LOG_FORMAT = f"{numstat.MARK}%H %aI %aN %aE"
#: Lines handed to the executors at a time.
BATCH = 200_000


class Repository:
    def __init__(self, path: str):
        self.path = Path(path)
        if not (self.path / ".git").is_dir():
            raise ValueError(f"not a git repository: {path}")

    def run(self, *args: str) -> str:
        done = subprocess.run(["git", "-C", str(self.path), *args], capture_output=True, text=True, errors="replace")
        if done.returncode:
            raise RuntimeError(done.stderr.strip())
        return done.stdout

    def changes(self, spark: SparkSession, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """The log between two moments, parsed on the executors. An empty or unreadable log gives no rows."""
        limits = [f"--{k}={v.isoformat()}" for k, v in (("since", since), ("until", until)) if v]
        try:
            text = self.run("log", "--numstat", f"--format={LOG_FORMAT}", *limits)
        except RuntimeError:
            text = ""
        rows = [(i, line) for i, line in enumerate(text.split("\n"))]
        lines = spark.createDataFrame(rows, "place int, line string").withColumn("log", F.lit(str(self.path)))
        return numstat.parse(lines)

    def commit_count(self) -> int:
        try:
            return int(self.run("rev-list", "--count", "HEAD"))
        except (RuntimeError, ValueError):
            return 0

    def commit_dates(self) -> tuple[datetime | None, datetime | None]:
        """Author dates of the first and the last commit of the log; none without commits."""
        try:
            dates = self.run("log", "--format=%aI").split()
        except RuntimeError:
            dates = []
        return (datetime.fromisoformat(dates[-1]), datetime.fromisoformat(dates[0])) if dates else (None, None)

    def summary(self, spark: SparkSession) -> DataFrame:
        first, last = self.commit_dates()
        return spark.createDataFrame([(str(self.path), self.commit_count(), first, last)], "repo_path string, commit_count long, first_commit_date timestamp, last_commit_date timestamp")

    def sizes(self, spark: SparkSession, ref: str = "HEAD") -> DataFrame:
        rows = []
        for line in self.run("ls-tree", "-r", "-l", ref).splitlines():
            _, _, _, rest = line.split(None, 3)
            size, _, path = rest.partition("\t")
            if size.strip().isdigit():
                rows.append((path, int(size)))
        return spark.createDataFrame(rows, "file_path string, file_size long")

    def paths(self, ending: str, ref: str = "HEAD") -> list[str]:
        return sorted(p for p in self.run("ls-tree", "-r", "--name-only", ref).splitlines() if p.endswith(ending))

    def sources(self, spark: SparkSession, ref: str = "HEAD") -> DataFrame:
        rows = [(p, self.run("show", f"{ref}:{p}")) for e in (".py", ".java") for p in self.paths(e, ref)]
        return spark.createDataFrame(rows, "file_path string, source string")

    def resolve(self, ref: str) -> datetime:
        """A date, or else the author date of what git knows by that name; ValueError if it knows none."""
        try:
            at = datetime.fromisoformat(ref)
            return at if at.tzinfo else at.replace(tzinfo=UTC)
        except ValueError:
            pass
        try:
            return datetime.fromisoformat(self.run("log", "-1", "--format=%aI", ref, "--").strip())
        except (RuntimeError, ValueError) as e:
            raise ValueError(f"unknown ref: {ref}") from e
