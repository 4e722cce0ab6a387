"""``python -m rasterloom run|validate|schema|flow``"""

from __future__ import annotations

import argparse
import json
import sys

from .errors import FlowError
from .plans import flow


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("rasterloom")
    sub = top.add_subparsers(dest="what", required=True)
    for name in ("run", "validate", "flow"):
        p = sub.add_parser(name)
        p.add_argument("--builtin")
        p.add_argument("--file")
        p.add_argument("--set", action="append", default=[])
        if name == "run":
            for k in ("--input", "--out", "--work"):
                p.add_argument(k)
            p.add_argument("--no-qc", action="store_true")
    sub.add_parser("schema")
    a = top.parse_args(argv)
    if a.what == "schema":
        print(json.dumps(flow.schema(), indent=1))
        return 0
    try:
        graph = flow.override(flow.builtin(a.builtin) if a.builtin else flow.Graph.read(open(a.file).read()), a.set)
        if a.what == "flow":
            print(flow.complete(graph).text())
            return 0
        issues = flow.validate(graph)
        for i in issues:
            print(f"{i.kind}: {i.where}: {i.text}", file=sys.stderr)
        if any(i.kind == "error" for i in issues):
            return 1
        if a.what == "run":
            from pyspark.sql import SparkSession

            from .plans.record import RunRecord

            spark = SparkSession.builder.getOrCreate()
            tokens = {k: v for k, v in (("input", a.input), ("out", a.out), ("work", a.work)) if v}
            record = RunRecord(spark, a.out, graph, list(argv if argv is not None else sys.argv[1:]), tokens) if a.out else None

            def heard(name, **facts):
                print(name, facts, file=sys.stderr)
                if record:
                    record.event(name, **facts)

            try:
                flow.run(spark, graph, tokens, a.work, skip_sinks=a.no_qc, on_event=heard)
            except BaseException as e:
                if record:
                    record.finish("interrupted" if isinstance(e, KeyboardInterrupt) else "failed", str(e) or type(e).__name__)
                raise
            if record:
                record.finish("ok")
        return 0
    except FlowError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
