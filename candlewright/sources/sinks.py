"""Results to files: tables, metrics, reports, manifests; keys for cached artifacts."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that would give the outcome away in a title seen before it.
OUTCOME_WORDS = ("utility", "mfe", "mae", "gross", "net")


#: A result that the driver writes holds aggregates; more rows than these are no result.
MOST_ROWS = 100_000


def _few(rows: DataFrame) -> list:
    """The rows of a small result; ValueError for more than ``MOST_ROWS``."""
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write a table instead")
    return found


def write_table(rows: DataFrame, path: str, partition_by: Sequence[str] = ("symbol",), files: int = 8) -> None:
    """A partitioned table, at most ``files`` files a partition value: rows of a value meet in so many tasks, however hot it is."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in partition_by]), F.lit(files))
    rows.repartition(*partition_by, salt).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(value: Any, path: str | Path) -> None:
    """A small result (a dict, or a DataFrame of aggregates) as one JSON file."""
    if isinstance(value, DataFrame):
        value = [r.asDict(recursive=True) for r in _few(value)]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str))


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def markdown_table(rows: DataFrame, digits: int = 4) -> str:
    """A result of aggregates as a Markdown table, in the order of ``rows``."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in _few(rows)])


def write_report(body: str, path: str | Path, marker: str = "<!-- notes below this line are kept -->") -> None:
    """Write a report; what an earlier report holds after the marker is kept."""
    path = Path(path)
    kept = "\n"
    if path.exists():
        kept = path.read_text().partition(marker)[2] or kept
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"{body.rstrip()}\n\n{marker}{kept}")


def cache_key(settings: dict, sources: Sequence[str | Path] = (), code: Sequence[str | Path] = ()) -> str:
    """Twelve hex digits that change with the settings, a source file's size or time, or the code's bytes."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode())
    for s in sources:
        stat = Path(s).stat()
        digest.update(f"{stat.st_size}/{stat.st_mtime_ns}".encode())
    for c in sorted(map(str, code)):
        digest.update(Path(c).read_bytes())
    return digest.hexdigest()[:12]


def content_hash(rows: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order; repeated rows count."""
    h = F.xxhash64(*[F.col(c) for c in rows.columns]).cast("decimal(38,0)")
    r = rows.agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{r['s']}:{r['n']}".encode()).hexdigest()[:16]


def manifest(inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], settings: dict, repo: str | Path = ".") -> dict:
    """What a run read and made: content hashes, settings, versions, and the state of the code."""
    import pyspark

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", str(repo), *args], capture_output=True, text=True).stdout.strip()

    return {
        "inputs": {k: content_hash(v) for k, v in inputs.items()},
        "outputs": {k: content_hash(v) for k, v in outputs.items()},
        "settings": cache_key(settings),
        "pyspark": pyspark.__version__,
        "commit": git("rev-parse", "HEAD"),
        "changed": bool(git("status", "--porcelain")),
    }


# The formats of titles.
def review_titles() -> tuple[Column, Column]:
    """(decision title, outcome title) of a review row; the first holds nothing that lies after the decision.

    Uses review_set, place, event_id, prediction, decision_ts, split, trigger_type and episode_age, and the
    outcome columns for the second. NULL trigger and age are left out.
    """
    decision = F.concat_ws(
        " ",
        F.concat("review_set", F.lit(" #"), F.col("place").cast("string")),
        F.concat(F.lit("id="), F.col("event_id").cast("string")),
        F.format_string("pred=%.3f", F.col("prediction")),
        F.date_format("decision_ts", "yyyy-MM-dd HH:mm"),
        F.concat(F.lit("("), F.col("split"), F.lit(")")),
        F.when(F.col("trigger_type") != "", F.concat(F.lit("trig="), F.col("trigger_type"))),
        F.when(F.col("episode_age").isNotNull(), F.concat(F.lit("ep_age="), F.col("episode_age").cast("string"))),
    )
    outcome = F.format_string("| utility=%.3f mfe=%.2f mae=%.2f gross=%+.1fbp net=%+.1fbp", F.col("short_utility"), F.col("mfe_short"), F.col("mae_short"), F.col("gross_return") * 1e4, F.col("net_return") * 1e4)
    return decision, F.concat_ws(" ", decision, outcome)
