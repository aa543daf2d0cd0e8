"""Read-only SQL for guests: only published views, one SELECT, limits on length, rows, bytes and time.

A statement runs in a session of its own with the published views; files can't be queried by path there. Sessions share saved
tables and global views, so the analysed plan is checked: a statement that reads one of them is rejected before it runs. The
text is checked only for what the plan can't tell.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LENGTH = 4000
ROWS = 200
BYTES = 256 * 1024
SECONDS = 3.0
#: Functions that reach outside the query, and clauses that guests don't get.
FORBIDDEN = re.compile(r"\b(java_method|reflect|input_file_name|input_file_block_\w+|current_user|session_user|version|assert_true|raise_error|range|read_files)\s*\(|\btransform\s+using\b|\bwith\s+recursive\b", re.I)
_LITERALS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)


class Rejected(ValueError):
    """A statement that may not run."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False


def checked(sql: str) -> str:
    """The statement, if it may run."""
    if not sql or not sql.strip():
        raise Rejected("the statement is empty")
    if len(sql) > LENGTH:
        raise Rejected(f"the statement is longer than {LENGTH} characters")
    bare = _LITERALS.sub(" ", sql).strip().rstrip(";").strip()
    if ";" in bare:
        raise Rejected("only one statement is allowed")
    if not re.match(r"(select|with)\b", bare, re.I):
        raise Rejected("only SELECT and WITH are allowed")
    if re.search(r"\b(insert|update|delete|merge|create|drop|alter|truncate|set|reset|cache|uncache|refresh|analyze|load|add|use|grant|revoke)\s+(into|table|view|database|schema|function|or|temporary|jar|file|overwrite)\b", bare, re.I):
        raise Rejected("the statement would change something")
    if found := FORBIDDEN.search(bare.replace("`", "")):
        raise Rejected(f"{found[0]} isn't allowed")
    return sql.strip().rstrip(";")


#: Relations of the shared catalog in an analysed plan.
_SHARED = re.compile(r"(?:SubqueryAlias|Relation|View \(`?)\s*`?(?:spark_catalog|global_temp)`?\.", re.I)


def only_published(df: DataFrame) -> None:
    """Reject a statement whose plan reads anything but the session's own views, or does more than read."""
    plan = df._jdf.queryExecution().analyzed().treeString()
    if _SHARED.search(plan):
        raise Rejected("only published views can be read")
    if re.search(r"^\W*(?:\w*Command|Insert|Create|Drop|Alter|Set|Append|Overwrite|Replace)\w*\b", plan):
        raise Rejected("the statement would change something")


def guest(spark: SparkSession, views: dict[str, str]) -> SparkSession:
    """A session with these views alone: name to the path of a Parquet table."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, path in views.items():
        own.read.parquet(path).createOrReplaceTempView(name)
    return own


def run(session: SparkSession, sql: str, rows: int = ROWS, size: int = BYTES, seconds: float = SECONDS) -> Answer:
    """The first rows of a statement within the limits; raises Rejected for statements that may not run and TimeoutError
    for those that take too long."""
    statement = checked(sql)
    tag = f"guest-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        session.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    session.addTag(tag)
    timer.start()
    try:
        df = session.sql(statement)
        only_published(df)
        found = df.limit(rows + 1).collect()
    except Rejected:
        raise
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the statement took more than {seconds} s") from None
        raise Rejected(re.sub(r"(file:|hdfs:|/)[^\s'`\"]*", "...", str(e).splitlines()[0])) from None
    finally:
        timer.cancel()
        session.removeTag(tag)
    out, held = Answer(df.columns, truncated=len(found) > rows), 0
    for r in found[:rows]:
        item = r.asDict(recursive=True)
        held += len(json.dumps(item, default=str).encode())
        if held > size:
            out.truncated = True
            break
        out.rows.append(item)
    return out
