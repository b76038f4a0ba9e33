"""Command line: ``spark-submit ferrytrace/jobs/run.py <job> ...``"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ferrytrace.jobs import delivery_jobs as jobs  # noqa: E402
from ferrytrace.operators.filters import split_list  # noqa: E402
from ferrytrace.session import build_session, new_area  # noqa: E402
from ferrytrace.sources import files, generated  # noqa: E402
from ferrytrace.sources.topics import KEYED_PRODUCER, FileTopics, KafkaTopics  # noqa: E402
from ferrytrace.streaming import flows  # noqa: E402


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)

    def add(name: str, summary: str, *options: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name, help=summary)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        return command

    def topic_options(command: argparse.ArgumentParser) -> None:
        command.add_argument("--topic", required=True)
        place = command.add_mutually_exclusive_group(required=True)
        place.add_argument("--bootstrap-servers")
        place.add_argument("--topic-root", help="directory of file topics")
        command.add_argument("--partitions", type=int, default=8)
        command.add_argument("--batch-size", default=KEYED_PRODUCER["batch.size"])
        command.add_argument("--acks", default=KEYED_PRODUCER["acks"])

    def filter_options(command: argparse.ArgumentParser) -> None:
        command.add_argument("--filter-column", default="country")
        command.add_argument("--filter-values", default="LU,DE,BE")
        command.add_argument("--run-id", default="run")
        command.add_argument("--metrics", help="table to append the run's metrics to")

    for name, summary in (
        ("publish", "filter CSV and publish keyed JSON"),
        ("publish-packed", "filter CSV and publish many rows per message"),
    ):
        command = add(name, summary, "input")
        topic_options(command)
        filter_options(command)
        command.add_argument("--key", default="station_id")
        command.add_argument("--batch-kb", type=int, default=10)
    filter_options(add("save", "filter CSV into CSV parts", "input", "output"))
    topic_options(add("publish-lines", "publish data lines of headed files", "input"))
    rows = add("publish-rows", "publish CSV rows as JSON", "input")
    rows.add_argument("--key", default="station_id")
    topic_options(rows)
    topic_options(add("throughput-publish", "publish JSON lines and rate it", "input"))
    topic_options(add("throughput-read", "read a topic and rate it"))
    measure = add("measure", "arrival measures of a topic")
    measure.add_argument("--started", help="UTC time the reader began")
    topic_options(measure)
    receive = add("receive", "measures of a reader that stops at an idle gap or a target")
    receive.add_argument("--idle-s", type=int, default=30)
    receive.add_argument("--target", type=int, default=0, help="messages to stop after; 0: none")
    receive.add_argument("--started", help="UTC time the reader began")
    receive.add_argument("--metrics", help="table to append the measures to")
    topic_options(receive)
    cube = add("cube-stream", "stream JSON numbers, add their cube", "output")
    cube.add_argument("--seconds", type=float, help="stop after this time; default: when drained")
    topic_options(cube)
    generate = add("generate", "write generated readings as CSV", "output")
    generate.add_argument("--size-gb", type=float, default=1.0)
    return parser


def _topics(args):
    if args.topic_root:
        return FileTopics(args.topic_root)
    producer = {**KEYED_PRODUCER, "acks": args.acks, "batch.size": args.batch_size}
    return KafkaTopics(args.bootstrap_servers, producer)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"ferrytrace-{args.job}")
    result = None
    if args.job in ("publish", "publish-packed", "save"):
        chosen = {
            "column": args.filter_column,
            "values": split_list(args.filter_values),
            "run_id": args.run_id,
        }
    if args.job == "publish":
        result = jobs.publish_filtered(
            spark, args.input, _topics(args), args.topic, key=args.key, partitions=args.partitions, **chosen
        )
    elif args.job == "publish-packed":
        result = jobs.publish_packed(
            spark, args.input, _topics(args), args.topic, batch_kb=args.batch_kb,
            partitions=args.partitions, **chosen,
        )
    elif args.job == "save":
        result = jobs.save_filtered(spark, args.input, args.output, **chosen)
    elif args.job == "publish-lines":
        jobs.publish_lines(spark, args.input, _topics(args), args.topic, args.partitions)
    elif args.job == "publish-rows":
        jobs.publish_rows(spark, args.input, _topics(args), args.topic, args.key, args.partitions)
    elif args.job == "throughput-publish":
        result = jobs.throughput_publish(spark, args.input, _topics(args), args.topic, args.partitions)
    elif args.job == "throughput-read":
        result = jobs.throughput_read(spark, _topics(args), args.topic)
    elif args.job == "measure":
        result = jobs.measure_topic(spark, _topics(args), args.topic, args.started)
    elif args.job == "receive":
        result = jobs.receive_topic(spark, _topics(args), args.topic, args.idle_s, args.target, args.started)
    elif args.job == "cube-stream":
        stream = _topics(args).read_stream(spark, args.topic)
        bounded = args.seconds is None
        query = flows.append_files(
            flows.parse_and_cube(stream), args.output, new_area(spark, "checkpoint"), bounded
        )
        flows.drain(query, args.seconds)
    elif args.job == "generate":
        files.write_csv(generated.readings_of_size(spark, args.size_gb), args.output)
    if result is not None:
        result.show(truncate=False, vertical=True)
        if getattr(args, "metrics", None):
            files.append_metrics(result, args.metrics)


if __name__ == "__main__":
    main()
