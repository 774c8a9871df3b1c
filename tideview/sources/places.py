"""Finding a place in a feed without reading all of it.

A feed laid out by log file (one folder ``file_seq=<number>`` for each, see ``write_changes``) is searched from the newest
file back: one file, then the two before it, then four, until something is found. Only those folders are
read, so what lies near the end is found at the cost of the end, and never more than the whole feed is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tideview.sources.feed import parse_changes

FILE_COLUMN = "file_seq"


def feed_files(lines: DataFrame) -> list[int]:
    """Numbers of the log files that a feed's folders hold, newest first; only names of files are looked at."""
    found = {int(m.group(1)) for f in lines.inputFiles() if (m := re.search(rf"/{FILE_COLUMN}=(\d+)/", f))}
    return sorted(found, reverse=True)


def newest_first(
    spark: SparkSession, path: str, find: Callable[[DataFrame], Row | None], *, key: str | None = None
) -> tuple[Row | None, int]:
    """What ``find`` gives for the newest changes of a feed in which it finds anything, and how many log files were read for it.

    ``find`` takes changes and returns a row or None. A feed that is not laid out by log file is read as a whole.
    """
    lines = spark.read.text(path)
    files = feed_files(lines) if FILE_COLUMN in lines.columns else []
    done, step = 0, 1
    while done < len(files):
        some = files[done : done + step]
        changes, _ = parse_changes(lines.filter(F.col(FILE_COLUMN).between(some[-1], some[0])).select("value"), key=key)
        done, step = done + len(some), 2 * step
        found = find(changes)
        if found is not None:
            return found, done
    # lines without a log file's number, or all of them
    rest = lines.filter(F.col(FILE_COLUMN).isNull()) if files else lines
    return find(parse_changes(rest.select("value"), key=key)[0]), done
