"""Writers: reports, documents, tables with row numbers, appended votes, published messages."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(value: Any, digits: int = 4) -> Any:
    """Numbers of a report rounded all the way down, what is not finite left out as null."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, digits) for v in value]
    return value


def report_json(report: dict) -> str:
    """A small report as text that is the same for the same report: sorted keys, rounded, a new line at the end."""
    return json.dumps(rounded(report), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def report_markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """Frames as Markdown tables, every row; rows come partition by partition."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("n/a" if v is None else str(rounded(v)) for v in row) + " |" for row in df.toLocalIterator()]
    return "\n".join(out) + "\n"


def terminal(title: str, tables: dict[str, DataFrame]) -> str:
    """Frames as aligned columns under headings, for a terminal; numbers to the right."""
    out = [title, "=" * len(title)]
    for name, df in tables.items():
        rows = [["n/a" if v is None else str(rounded(v)) for v in row] for row in df.toLocalIterator()]
        wide = [max(map(len, column)) for column in zip(df.columns, *rows)]
        right = [kind in ("int", "bigint", "double", "float") for _, kind in df.dtypes]
        lines = [" ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(row, wide, right)).rstrip() for row in [df.columns, *rows]]
        out += ["", name, "-" * len(name), *lines]
    return "\n".join(out) + "\n"


def manifest_json(name: str, config: dict, inputs: list[str], stages: list[dict], outputs: list[str]) -> str:
    """A run's manifest: what ran with what, on what, and what each stage did; the digest names the configuration."""
    import hashlib

    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return report_json({"name": name, "config": config, "config_sha256": digest, "inputs": sorted(inputs), "stages": stages, "outputs": sorted(outputs), "ok": all(s.get("ok", False) for s in stages)})


def write_wav(samples, rate: int, path: str, bits: int = 24) -> None:
    """One clip as a file of 24- or 16-bit samples."""
    from cadence.sources.recordings import encode, head

    data = encode(samples, bits // 8)
    with open(path, "wb") as f:
        f.write(head(len(samples), rate, bits // 8) + data + b"\0" * (len(data) % 2))


def drift(before: Column, after: Column, most: float = 0.05) -> Column:
    """Whether a length of seconds has drifted by more than most."""
    return F.abs(before - after) > most


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON with keys in order and nulls left out."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")).write.mode("overwrite").text(path)


def document(lines: DataFrame, keys: list[str], order: str, text: str, header: str) -> DataFrame:
    """One text for each key: the header and its lines in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return lines.groupBy(*keys).agg(F.concat(F.lit(header), body, F.lit("\n")).alias("text"))


def tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """Tab-separated rows; with an order, numbered from one (for tables of a configuration's size)."""
    held = df if order is None else df.select(F.row_number().over(Window.orderBy(order)).alias("index"), *df.columns)
    held.write.mode("overwrite").csv(path, sep="\t")


def append_vote(vote: DataFrame, path: str) -> int:
    """Append votes and tell how many there are now."""
    vote.write.mode("append").csv(path, header=True)
    return vote.sparkSession.read.csv(path, header=True).count()


def message_name(priority: Column, at: Column, sequence: Column, sender: Column, to: Column) -> Column:
    """The name by which messages sort: priority, time, sequence."""
    return F.concat_ws("_", priority, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.format_string("%06d", sequence.cast("long")), F.lit("from"), sender, F.lit("to"), to)


def publish(df: DataFrame, path: str) -> None:
    """Write all or nothing: Spark's committer moves a job's files in when all of them are written."""
    df.write.mode("append").parquet(path)


def generated(df: DataFrame, text: str) -> DataFrame:
    """Rows with the digest of their generated text."""
    return df.withColumn("sha256", F.sha2(text, 256))
