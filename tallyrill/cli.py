"""Command line: run, validate, schema and inspect."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from . import inspect, metrics, sinks
from .plans import ir
from .plans.compiler import Compiled, compile_pipeline
from .plans.validate import ValidationError, validate
from .streaming.windows import end_input


def session() -> SparkSession:
    return SparkSession.builder.appName("tallyrill").config("spark.sql.session.timeZone", "UTC").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()


def _inputs(spark: SparkSession, p: ir.Pipeline, given: list[str]) -> dict[str, str]:
    """ID=PATH options; a stdin source without one is read from standard input, spooled to a file that all executors can read."""
    out = dict(x.split("=", 1) for x in given)
    for s in p.sources:
        if isinstance(s, ir.Stdin) and s.id not in out:
            folder = shared_folder(spark, "input").removeprefix("file://")
            if "://" in folder:
                raise SystemExit(f"source {s.id}: standard input can't be put into {folder}; give --input {s.id}=PATH")
            Path(folder).mkdir(parents=True, exist_ok=True)
            with open(f"{folder}/{s.id}.jsonl", "w") as f:
                shutil.copyfileobj(sys.stdin, f)
            out[s.id] = f"{folder}/{s.id}.jsonl"
    return out


def emit(compiled: Compiled) -> None:
    """Bounded input: each sink in turn. Lines are fetched a partition at a time."""
    for sink, df in compiled.sinks().values():
        if isinstance(sink, ir.OtlpSink):
            sinks.export(df, sink.endpoint)
            continue
        ordered = df.orderBy("ts_nanos", "name")
        for row in sinks.lines(ordered, sink.format).toLocalIterator():
            print(row["line"], flush=True)


def stream(compiled: Compiled, checkpoint: str, marks: str | None = None) -> None:
    """Unbounded input: a query for each sink, until one fails. With ``marks``, until what is there now has been read; then the input ends, and all windows fire."""
    if marks is None:
        queries = started(compiled, checkpoint, False)
        if queries:
            queries[0].sparkSession.streams.awaitAnyTermination()
        return
    for passes in range(2 + ir.windows_deep(compiled.pipeline)):
        if passes:  # a window after a window that counts records needs a mark after what the first one's made fire
            end_input(next(iter(compiled.frames.values())).sparkSession, marks)
        queries = started(compiled, checkpoint, True)
        try:
            while any(q.isActive for q in queries):
                time.sleep(0.1)
                if any(q.exception() for q in queries):
                    break
            for q in queries:
                if e := q.exception():
                    raise e
        finally:
            for q in queries:
                q.stop()


def started(compiled: Compiled, checkpoint: str, drain: bool) -> list[StreamingQuery]:
    queries = []
    for sink, df in compiled.sinks().values():
        def write(batch: DataFrame, _: int, sink: ir.Sink = sink) -> None:
            if isinstance(sink, ir.OtlpSink):
                sinks.export(batch, sink.endpoint)
            else:
                for row in sinks.lines(batch, sink.format).toLocalIterator():
                    print(row["line"], flush=True)

        writer = metrics.observed(df, sink.id).writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint}/{sink.id}").foreachBatch(write)
        queries.append((writer.trigger(availableNow=True) if drain else writer).start())
    return queries


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder in spark.checkpoint.dir; a temporary one only where all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return f"{at.rstrip('/')}/tallyrill-{what}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise SystemExit(f"--{what} (or spark.checkpoint.dir) must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"tallyrill-{what}-")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyrill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a pipeline")
    checked = commands.add_parser("validate", help="parse and check a pipeline")
    commands.add_parser("schema", help="print the JSON Schema of pipelines")
    look = commands.add_parser("inspect", help="show the windows left open at the end of bounded input")
    for p in (run, checked, look):
        p.add_argument("file", type=Path)
    for p in (run, look):
        p.add_argument("--input", action="append", default=[], metavar="ID=PATH", help="where a source's lines are")
        p.add_argument("--records", type=int, default=100, help="how many records a generator makes of bounded input")
        p.add_argument("--keep-late", action="store_true", help="of bounded input: windows take all records, however late, in any order; faster")
    run.add_argument("--stream", action="store_true", help="read without end")
    run.add_argument("--drain", action="store_true", help="with --stream: end the input when all that is there has been read, let all windows fire, and stop")
    run.add_argument("--checkpoint", help="with --stream: where offsets and state are kept")
    run.add_argument("--metrics", action="store_true", help="print each node's counts to standard error at the end")
    look.add_argument("--node", action="append", default=[], metavar="ID")
    look.add_argument("--checkpoint", help="of a running stream: where its state is kept; with --sink")
    look.add_argument("--sink", help="the sink whose query is looked at")
    look.add_argument("--watch", action="store_true", help="with --checkpoint: show the state again whenever it has changed")
    look.add_argument("--times", type=int, help="with --watch: stop after so many looks")
    a = parser.parse_args(args)
    if a.command == "schema":
        print(ir.schema_text())
        return 0
    try:
        p = ir.load(a.file)
        validate(p)
    except (OSError, ir.ParseError, ValidationError) as e:
        print(f"{a.file}: {e}", file=sys.stderr)
        return 1
    if a.command == "validate":
        print("ok")
        return 0
    spark = session()
    if a.command == "inspect" and a.checkpoint:
        at, spec = f"{a.checkpoint}/{a.sink}", inspect.last_window(p, a.sink)
        for nodes in inspect.watch(lambda: [inspect.stream_snapshot(spark, at, spec)], times=a.times if a.watch else 1):
            print(inspect.render(nodes), end="", flush=True)
        return 0
    live = a.command == "run" and a.stream
    checkpoint = (a.checkpoint or shared_folder(spark, "checkpoint")) if live else None
    marks = None
    if live and a.drain:
        marks = f"{checkpoint}/end-of-input"
        path = spark._jvm.org.apache.hadoop.fs.Path(marks)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    compiled = compile_pipeline(spark, p, _inputs(spark, p, a.input), stream=live, exact=None if a.keep_late else True, records=a.records, marks=marks)
    if a.command == "inspect":
        print(inspect.render(inspect.snapshot(compiled, a.node)), end="")
    elif live:
        stream(compiled, checkpoint, marks)
    else:
        emit(compiled)
        if a.metrics:
            for row in metrics.collect(compiled):
                print(json.dumps(row), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
