"""Commands over files. Exit 0 fine, 2 wrong use or input.

``metrics`` and ``spec`` read records and briefs; ``inspect``, ``analyze``, ``score``, ``master``, ``silence`` and ``restore`` read recordings (WAV);
``melody``, ``riser`` and ``transition`` write one.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import mastering, signal, tones, voice
from cadence.operators import metrics as M
from cadence.plans.documents import edit_document, markdown
from cadence.plans.staged import PRESETS, edit_spec
from cadence.session import session
from cadence.sources import documents, records, sinks


def analyse(rows: DataFrame, goal: str) -> dict[str, DataFrame]:
    """The frames of a report: input, outcome, quality, summaries, ranking, insights, questions."""
    scored = M.score(M.derive(rows), goal).withColumn("row_number", F.monotonically_increasing_id())
    found = M.insights(scored, goal)
    return {
        "input": M.input_summary(scored), "outcome": M.outcome(found), "groups": M.summarize(scored).orderBy("dimension", F.desc("n"), "label"),
        "ranking": M.rank(scored, "goal_score", "row_number").select("side", "place", "id", "platform", "goal_score", "views", "average_watch_time_s", "completion_proxy", "topic", "hook_type"),
        "insights": found, "missing": M.missing_for_goal(scored, goal), "duplicates": M.duplicates(scored, "id"), "warnings": M.warnings(scored), "questions": M.next_questions(scored, goal),
    }


def metrics(spark: SparkSession, args: argparse.Namespace) -> str:
    rows = M.typed(records.read(spark, args.input).drop("record", "row_number")).persist()
    try:
        if not rows.limit(1).count():
            raise ValueError("no rows")
        return shown("metrics", analyse(rows, args.goal), args.format)
    finally:
        rows.unpersist()


def spec(spark: SparkSession, args: argparse.Namespace) -> str:
    """The short table of an edit and its whole document, one for each brief."""
    held = documents.briefs(spark, args.input)
    whole = edit_document(held).select("document")
    if args.format == "markdown":
        return "\n".join(markdown(r["document"].asDict(recursive=True)) for r in whole.toLocalIterator())
    return shown("spec", {"spec": edit_spec(held), "document": whole if args.format == "json" else whole.select("document.platform_note", F.size("document.timeline").alias("beats"))}, args.format)


def shown(title: str, tables: dict[str, DataFrame], form: str) -> str:
    if form == "json":
        return sinks.report_json({name: [r.asDict(recursive=True) for r in df.toLocalIterator()] for name, df in tables.items()})
    return sinks.report_markdown(title, tables) if form == "markdown" else sinks.terminal(title, tables)


def clips(spark: SparkSession, path: str) -> DataFrame:
    """Recordings as one row each (path, rate, samples), at the rate that all kernels work at."""
    blocks = documents.wav(spark, path).groupBy("path", "rate").agg(F.array_sort(F.collect_list(F.struct("block", "samples"))).alias("b"))
    return mastering.admit(blocks.select("path", "rate", F.flatten("b.samples").alias("samples")))


def levels(held: DataFrame) -> DataFrame:
    """Frames of 10 ms with their level and whether there is speech in them, as the voice report reads them."""
    return mastering.speech_frames(held, ["path"], ms=10)


def inspect(spark: SparkSession, args: argparse.Namespace) -> str:
    held = clips(spark, args.input)
    facts = held.select("path", "rate", F.size("samples").alias("samples"), F.round(F.size("samples") / mastering.RATE, 3).alias("seconds"))
    return shown("inspect", {"file": facts, "voice": voice.report(levels(held), ["path"])}, args.format)


def analyze(spark: SparkSession, args: argparse.Namespace) -> str:
    held = clips(spark, args.input)
    return shown("analyze", {"levels": signal.measure(held, ["path"]), "loudness": mastering.measures(held, ["path"])}, args.format)


def score(spark: SparkSession, args: argparse.Namespace) -> str:
    return shown("score", {"score": voice.report(levels(clips(spark, args.input)), ["path"]).select("path", "score", "verdict")}, args.format)


def written(held: DataFrame, args: argparse.Namespace, title: str) -> str:
    """One changed recording to the output, and what was done; several are an error."""
    rows = held.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} recording: name one file")
    row = rows[0]
    if not args.output:
        raise ValueError("--output is needed")
    sinks.write_wav(row["samples"], mastering.RATE, args.output)
    args.output = None  # what is printed is the report
    return sinks.report_json({title: {"samples": len(row["samples"]), "stages": list(row["stages"]) if "stages" in held.columns else [title]}})


def master(spark: SparkSession, args: argparse.Namespace) -> str:
    held = clips(spark, args.input)
    if args.dry_run:
        switches = F.struct(F.lit(args.dehum).alias("dehum"), *[F.lit(False).alias(k) for k in ("no_eq", "no_comp", "no_limit", "no_loudnorm")])
        from cadence.plans.staged import chain

        return shown("master", {"stages": spark.range(1).select(F.array_join(chain(switches), " > ").alias("stages"))}, args.format)
    return written(mastering.master(held, args.preset, dehum=args.dehum, lufs=args.lufs), args, "master")


def silence(spark: SparkSession, args: argparse.Namespace) -> str:
    """Recordings without their long pauses: of a pause above the level's trigger its target stays."""
    return written(mastering.without_pauses(clips(spark, args.input), ["path"], *mastering.PAUSES[args.level]), args, "silence")


def restore(spark: SparkSession, args: argparse.Namespace) -> str:
    return written(mastering.mend(clips(spark, args.input), declip=args.declip, dehum=args.dehum), args, "restore")


def tonal(spark: SparkSession, args: argparse.Namespace) -> str:
    """An element on its own, as a file, and its notes."""
    notes: list[dict] = []
    if args.command == "melody":
        x, notes = tones.melody(args.mood, args.bars, args.bpm, args.seed)
    elif args.command == "riser":
        x = tones.riser(args.mood, args.dur, args.tail, args.style)
    else:
        x = tones.transition(args.mood, args.to, args.dur)
    if not args.output:
        raise ValueError("--output is needed")
    sinks.write_wav(x, mastering.RATE, args.output)
    args.output = None
    return sinks.report_json({args.command: {"samples": len(x), "notes": notes}})


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cadence")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, **options: dict) -> None:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        own.add_argument("--format", default="json", choices=["json", "markdown", "terminal"])
        own.add_argument("--output", "-o")
        for option, how in options.items():
            own.add_argument(f"--{option.replace('_', '-')}", **how)

    source, number, flag = {"required": True}, {"type": float}, {"action": "store_true"}
    add("metrics", metrics, input=source, goal={"default": "all", "choices": [*M.GOALS, "cross-platform"]})
    add("spec", spec, input=source)
    for name, run in (("inspect", inspect), ("analyze", analyze), ("score", score), ("silence", silence)):
        add(name, run, input=source)
    commands.choices["silence"].add_argument("--level", default="medium", choices=list(mastering.PAUSES))
    add("master", master, input=source, preset={"choices": list(PRESETS)}, lufs=number, dehum={"type": int}, dry_run=flag)
    add("restore", restore, input=source, declip=flag, dehum={"type": int})
    mood = {"default": "hope", "choices": list(tones.MOODS)}
    add("melody", tonal, mood=mood, bars={"type": int, "default": 4}, bpm=number, seed={"type": int, "default": 0})
    add("riser", tonal, mood=mood, dur=number | {"default": 3.0}, tail=number | {"default": 0.5}, style={"default": "notes", "choices": ["notes", "glide"]})
    add("transition", tonal, mood=mood, to=mood | {"default": "calm"}, dur=number | {"default": 2.0})
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        text = args.run(session("*", "cadence"), args)
        if args.output:
            Path(args.output).write_text(text, encoding="utf-8")
        else:
            print(text, end="")
    except Exception as e:  # noqa: BLE001  whatever is wrong with the input is told, not raised
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
